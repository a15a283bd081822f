"""Streaming forms of the counters, averages and windows (an extension).

Every function takes a streaming DataFrame of events and gives a streaming
DataFrame; ``settle`` runs one over what is there and returns the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def success_counts(events: DataFrame, by: str = "job") -> DataFrame:
    """Running Beta counters of each job."""
    return events.groupBy(by).agg((F.count_if(F.col("ok")) + 1).alias("alpha"), (F.count_if(~F.col("ok")) + 1).alias("beta"))


def health(events: DataFrame, by: str = "job") -> DataFrame:
    """Hits and the moving latency of each job, in order of arrival within a batch by (ts, event_id); state is three numbers a job."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ok, bad, lat = state.get if state.exists else (0, 0, 0)
        for row in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples(index=False):
            ok, bad = ok + bool(row.ok), bad + (not row.ok)
            lat = int(row.latency) if lat == 0 else int(0.7 * lat + 0.3 * row.latency)
        state.update((ok, bad, lat))
        yield pd.DataFrame([(key[0], ok, bad, lat, ok / (ok + bad) / (1 + lat / 1000))], columns=[by, "n_ok", "n_fail", "latency", "score"])

    kind = events.schema[by].dataType.simpleString()
    rows = events.select(by, "ts", "event_id", "ok", "latency")
    return rows.groupBy(by).applyInPandasWithState(update, f"{by} {kind}, n_ok long, n_fail long, latency long, score double", "ok long, bad long, lat long", "update", GroupStateTimeout.NoTimeout)


def window_counts(events: DataFrame, length: str, late: str, by: str = "event_type") -> DataFrame:
    """Counts in windows of event time; events later than ``late`` behind the newest are dropped, and windows are then final."""
    w = F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Each key's first event, forgotten ``late`` behind the newest."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def settle(stream: DataFrame, mode: str = "update") -> DataFrame:
    """Run a stream over all that is available and return the last row of each batch's output, in a table of the session."""
    spark: SparkSession = stream.sparkSession
    name = f"stream_{uuid.uuid4().hex}"
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
