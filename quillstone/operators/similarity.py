"""Fingerprints and vectors.

``near_hashes`` finds pairs of fingerprints that differ in fewer than three bits
without comparing all: two differing bits leave one of three bands untouched.
``nearest`` is exact: queries come in blocks of bounded bytes, every task keeps
the best k of its rows for each query, and only those meet again.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = re.compile("[ \t\n\r.,;:!?]+")
BANDS = ((0, 22), (22, 21), (43, 21))  #: first bit and width of each band of a 64-bit fingerprint


def fingerprints(texts: list[str | None]) -> list[int | None]:
    """SimHash of each text: a bit is set if more words' SHA-1 hashes set it than not; None for text without words."""
    words = [[w for w in PARTS.split((t or "").lower()) if w] for t in texts]
    sizes = np.array([len(w) for w in words])
    if not sizes.sum():
        return [None] * len(texts)
    raw = b"".join(hashlib.sha1(w.encode()).digest()[:8] for ws in words for w in ws)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    has = np.flatnonzero(sizes)
    starts = np.concatenate([[0], np.cumsum(sizes[has])[:-1]])
    votes = np.add.reduceat(bits, starts, axis=0) > 0
    out: list[int | None] = [None] * len(texts)
    for i, h in zip(has.tolist(), np.packbits(votes, axis=1).view(">i8").reshape(-1).tolist(), strict=True):
        out[i] = h
    return out


def simhash(text: Column) -> Column:
    """A 64-bit fingerprint as a signed long, in Arrow batches; null for text without words."""

    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        rows, step = texts.to_pylist(), 2000
        return pa.array([h for i in range(0, len(rows), step) for h in fingerprints(rows[i : i + step])], pa.int64())

    return run(text)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits; 64 if either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def near_hashes(left: DataFrame, right: DataFrame, most: int = 2) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints of ``left`` (a) and ``right`` (b) with at most ``most`` < 3 differing bits; equal ones pair too."""
    band = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.shiftrightunsigned(F.col("h"), lo).bitwiseAND(F.lit((1 << n) - 1)).alias("v")) for i, (lo, n) in enumerate(BANDS)]))
    x = left.select(F.col("a").alias("h")).distinct().where("h IS NOT NULL").select(F.col("h").alias("a"), band.alias("band"))
    y = right.select(F.col("b").alias("h")).distinct().where("h IS NOT NULL").select(F.col("h").alias("b"), band.alias("band"))
    return x.join(y, "band").where(hamming(F.col("a"), F.col("b")) <= most).select("a", "b").distinct()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different length or without length."""
    n = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n).otherwise(0.0)


def euclid(a: Column, b: Column) -> Column:
    """The distance; the greatest double for vectors of different length."""
    d = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda t, x: t + x)
    return F.when(F.size(a) == F.size(b), F.sqrt(d)).otherwise(1.7976931348623157e308)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what an upsert leaves."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("r")).select(key, "r.*")


QUERY_BYTES = 32 << 20  #: bytes of the query vectors that are searched at once
SCORES, SLICE = 1 << 20, 1024  #: scores that are worked out at once, and of how many queries


def nearest(items: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(query, id, score, rank): the k best items (id, vec) of each query (query, vec), exact; ties go to the lower id.

    An item without a vector of the queries' length scores 0 by cosine and has no
    distance. Queries travel in blocks of at most ``query_bytes``; a block's pass over the
    items is one job stage, and more queries only mean more blocks.
    """
    first = queries.select(F.size("vec").alias("n")).where("n > 0").first()
    if first is None:
        return items.sparkSession.createDataFrame([], "query long, id long, score double, rank int")
    each = max(1, query_bytes // (8 * first["n"]))
    count = queries.count()
    blocks = -(-count // each)
    out = None
    for b in range(blocks):
        mine = queries.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "vec").toArrow()  # about query_bytes
        if not mine.num_rows:
            continue
        part = _block(items, mine, k, metric)
        out = part if out is None else out.unionByName(part)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc("id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _keep(score: np.ndarray, ids: np.ndarray, have: np.ndarray, least: np.ndarray, row: np.ndarray, s_: np.ndarray, mine: np.ndarray) -> None:
    """Put further scores of the queries ``row`` among the k best that ``score`` and ``ids`` hold, in their places."""
    k = score.shape[1]
    old, place = np.nonzero((np.arange(k)[None] < have[:, None]) & np.isin(np.arange(len(have)), row)[:, None])
    row, s_, mine = np.concatenate([old, row]), np.concatenate([score[old, place], s_]), np.concatenate([ids[old, place], mine])
    order = np.lexsort((mine, -s_, row))
    row, s_, mine = row[order], s_[order], mine[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    count = np.diff(np.r_[first, len(row)])
    place = np.arange(len(row)) - np.repeat(first, count)
    best = place < k
    score[row[best], place[best]], ids[row[best], place[best]] = s_[best], mine[best]
    have[row[first]] = np.minimum(count, k)
    full = row[first[count >= k]]
    least[full] = score[full, k - 1]


def _block(items: DataFrame, queries: pa.Table, k: int, metric: str) -> DataFrame:
    names = np.asarray(queries.column("query").combine_chunks())
    q = np.array(queries.column("vec").to_pylist(), np.float64)
    own = np.linalg.norm(q, axis=1) if metric == "cosine" else (q * q).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        have = np.zeros(len(q), np.int64)  # places of a query that are taken, in order from the first
        least = np.full(len(q), -np.inf)  # what an item must reach
        each = max(1, SCORES // SLICE)
        for batch in (whole.slice(i, each) for whole in batches for i in range(0, whole.num_rows, each)):
            mine, vec = np.asarray(batch.column(0)), batch.column(1)
            fits = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(vec), q.shape[1]), False))
            x = np.zeros((batch.num_rows, q.shape[1]))
            x[fits] = np.asarray(vec.filter(pa.array(fits)).flatten()).reshape(-1, q.shape[1])
            if metric != "cosine":
                mine, x = mine[fits], x[fits]
            size = np.linalg.norm(x, axis=1)[None] if metric == "cosine" else (x * x).sum(1)[None]
            for at in range(0, len(q), SLICE):
                part = q[at : at + SLICE]
                s_ = part @ x.T
                if metric == "cosine":
                    n = own[at : at + SLICE, None] * size
                    s_ = np.divide(s_, n, out=np.zeros_like(s_), where=n > 0)
                else:
                    s_ = -np.sqrt(np.maximum(own[at : at + SLICE, None] + size - 2 * s_, 0))
                row, col = np.nonzero(~(s_ < least[at : at + SLICE, None]))  # ties stay in, and what is no number
                if len(row):
                    _keep(score[at : at + SLICE], ids[at : at + SLICE], have[at : at + SLICE], least[at : at + SLICE], row, s_[row, col], mine[col])
        row, place = np.nonzero(np.arange(k)[None] < have[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids[row, place]), pa.array(score[row, place])], names=["query", "id", "score"])

    return items.select(F.col("id").cast("long"), F.col("vec").cast("array<double>")).mapInArrow(run, "query long, id long, score double")
