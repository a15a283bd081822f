"""State kept over events: counters, moving averages, limits.

Folds whose next step needs the last one's result run over events sorted within
partitions, a key's events in one task, with the state of one key in memory at a
time; everything else is a grouping.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ordered_fold(df: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, object], None], result: Callable[[dict], tuple], schema: str) -> DataFrame:
    """(key, result) after a fold over each key's rows in order; memory holds one state and one batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        state, now, out, any_ = None, None, [], False
        for frame in frames:
            for row in frame.itertuples(index=False):
                k = getattr(row, key)
                if not any_ or k != now:
                    if any_:
                        out.append((now, *result(state)))
                    state, now, any_ = start(), k, True
                step(state, row)
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if any_:
            out.append((now, *result(state)))
        yield pd.DataFrame(out, columns=names)

    laid = df.repartition(key).sortWithinPartitions(key, *order)
    return laid.mapInPandas(run, schema)


def success_rates(df: DataFrame, by: str = "job", least: float = 0.5) -> DataFrame:
    """(by, alpha, beta, expected, run): Beta counters from 1 and 1, one more for each success or failure."""
    a = df.groupBy(by).agg((F.count_if(F.col("ok")) + 1).alias("alpha"), (F.count_if(~F.col("ok")) + 1).alias("beta"))
    return a.withColumn("expected", F.col("alpha") / (F.col("alpha") + F.col("beta"))).withColumn("run", F.col("expected") >= least)


def health(df: DataFrame, by: str = "job", default_ms: int = 1000) -> DataFrame:
    """(by, n_ok, n_fail, latency, score, timeout_ms): hits times a latency penalty; the latency moves by 0.3 each event, cut to whole numbers."""

    def step(m: dict, row) -> None:
        m["ok" if row.ok else "bad"] += 1
        m["lat"] = int(row.latency) if m["lat"] == 0 else int(0.7 * m["lat"] + 0.3 * row.latency)

    def result(m: dict) -> tuple:
        n = m["ok"] + m["bad"]
        wait = default_ms if n < 5 else min(max(int(m["lat"] * 2.5) * 2, default_ms), 5 * default_ms)
        return m["ok"], m["bad"], m["lat"], m["ok"] / n / (1 + m["lat"] / 1000), wait

    kind = df.schema[by].dataType.simpleString()
    return ordered_fold(df.select(by, "ts", "event_id", "ok", "latency"), by, ["ts", "event_id"], lambda: {"ok": 0, "bad": 0, "lat": 0}, step, result, f"{by} {kind}, n_ok long, n_fail long, latency long, score double, timeout_ms long")


def request_rate(df: DataFrame, by: str = "job", begin: int = 3, least: int = 1, most: int = 10) -> DataFrame:
    """(by, rate): halved on status 429, one less on 5xx, one more while over half the quota is left, one less under a tenth."""

    def step(m: dict, row) -> None:
        r = m["r"]
        if row.status == 429:
            r //= 2
        elif row.status >= 500:
            r -= 1
        elif row.quota > 0.5:
            r += 1
        elif 0 < row.quota < 0.1:
            r -= 1
        m["r"] = min(max(r, least), most)

    kind = df.schema[by].dataType.simpleString()
    return ordered_fold(df.select(by, "ts", "event_id", "status", "quota"), by, ["ts", "event_id"], lambda: {"r": begin}, step, lambda m: (m["r"],), f"{by} {kind}, rate long")


def token_bucket(df: DataFrame, by: str = "job", per_second: float = 0.001, cap: float = 1.0) -> DataFrame:
    """(by, n_now, n_waited): events that found a whole token, and those that had to wait."""

    def step(m: dict, row) -> None:
        now = row.ts.timestamp()
        m["t"] = min(cap, m["t"] + max(0.0, now - m["at"]) * per_second) if m["at"] is not None else cap
        m["at"] = now
        if m["t"] >= 1:
            m["t"] -= 1
            m["now"] += 1
        else:
            m["waited"] += 1

    kind = df.schema[by].dataType.simpleString()
    return ordered_fold(df.select(by, "ts", "event_id"), by, ["ts", "event_id"], lambda: {"t": cap, "at": None, "now": 0, "waited": 0}, step, lambda m: (m["now"], m["waited"]), f"{by} {kind}, n_now long, n_waited long")


def survivors(df: DataFrame, key: str, order: list[str], capacity: int) -> DataFrame:
    """(key, last access): the ``capacity`` keys used last, as a cache of that size would hold them (a top-k)."""
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("last"))
    return last.orderBy(F.desc("last"), F.asc(key)).limit(capacity).select(key, *[F.col(f"last.{c}").alias(f"last_{c}") for c in order])


def intervals(df: DataFrame, by: str, ts: str = "ts") -> DataFrame:
    """(by, day, week, interval): how often to run by the events of the last day and week before the latest event of all."""
    end = df.agg(F.max(ts).alias("end"))
    x = df.crossJoin(F.broadcast(end))  # one row is broadcast
    age = lambda d: F.col(ts) > F.col("end") - F.expr(f"INTERVAL {d} DAYS")
    a = x.groupBy(by).agg(F.count_if(age(1)).alias("day"), F.count_if(age(7)).alias("week"))
    every = F.when(F.col("day") >= 50, "every 10m").when(F.col("week") / 7 >= 10, "every 30m").when(F.col("week") / 7 >= 1, "every 2h").otherwise("skip")
    return a.withColumn("interval", every)


def last_state(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last event."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def windows(df: DataFrame, length: str, slide: str | None = None, by: str = "event_type") -> DataFrame:
    """(by, start, n, total): events in windows of time (an extension)."""
    w = F.window("ts", length, slide or length)
    return df.groupBy(by, w.alias("w")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).cast("double").alias("total")).select(by, F.col("w.start").alias("start"), "n", "total")


def sessions(df: DataFrame, gap_minutes: int, by: str = "user_id") -> DataFrame:
    """(by, start, n): runs of events with less than the gap between them (an extension)."""
    w = F.session_window("ts", f"{gap_minutes} minutes")
    return df.groupBy(by, w.alias("w")).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")


def running(df: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """``df`` with the sum of ``value`` so far."""
    return df.withColumn("so_far", F.sum(value).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
