"""Texts as vectors, by embedders that are plugged in by name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: An embedder takes texts and gives (index, vector) of each, in any order.
Embedder = Callable[[list[str]], list[tuple[int, list[float]]]]
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def letters(texts: list[str]) -> list[tuple[int, list[float]]]:
    """How often each Latin letter stands in a text, whatever its case: a vector that needs no model."""
    return [(i, [float(t.lower().count(c)) for c in LETTERS]) for i, t in enumerate(texts)]


EMBEDDERS: dict[str, Embedder] = {"letters": letters}
BATCH = 256  #: texts that an embedder gets at once


def register(name: str, embedder: Embedder) -> None:
    EMBEDDERS[name] = embedder


def embed(df: DataFrame, id_col: str, text_col: str, embedder: str = "letters") -> DataFrame:
    """(id, vec) of each row: vectors of length 1, put back in the order of their texts; null for null and blank texts, all zeros for a vector of length 0.

    An embedder that leaves a text out or gives one twice is a fault.
    """
    fn = EMBEDDERS[embedder]
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, BATCH):
                batch = whole.slice(lo, BATCH)
                texts = batch.column(1).to_pylist()
                named = [i for i, t in enumerate(texts) if t and t.strip()]
                given = sorted(fn([texts[i] for i in named])) if named else []
                if [i for i, _ in given] != list(range(len(named))):
                    raise ValueError("an embedder must give one vector for each text")
                out: list = [None] * len(texts)
                for i, (_, v) in zip(named, given, strict=True):
                    x = np.asarray(v, np.float64)
                    n = np.linalg.norm(x)
                    out[i] = (x / n if n else x).tolist()
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["id", "vec"])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, vec array<double>")
