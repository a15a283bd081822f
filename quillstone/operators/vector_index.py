"""An index for nearest neighbours by cosine: inverted lists of centroids, searched in part or until the answer is exact.

Centroids are fitted by spherical k-means on a bounded sample and every vector is listed under the nearest one. A query
looks into the lists of its nearest centroids only. Each list has a radius, the largest distance from its
centroid, so that a list no nearer than a query's k-th neighbour can be left out for good: ``exact`` goes on into
the others.

Lists and the queries that look into them meet in blocks of bounded size: a long list is dealt to several
blocks, to each of which its queries go, and many queries of one list are dealt likewise. So no key is one task's work, and no
set of queries passes over all vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .planning import first_rows
from .store import cut

SAMPLE = 20_000  #: vectors on which centroids are fitted, at most
MOST_LISTS = 4096  #: centroids at most; they travel with the tasks
ROUNDS = 12  #: rounds of k-means
LIST_ROWS, LIST_QUERIES = 16_384, 2_048  #: vectors and queries of a block
RECALL, NEIGHBOURS, TRIALS = 0.95, 10, 256  #: part of so many neighbours that the lists looked into should hold, and the vectors on which that is tried


@dataclass
class VectorIndex:
    """Centroids of length 1, the listed vectors (list, id, vec) of length 1, the lists' sizes and radii, and how many lists a query looks into."""

    centroids: np.ndarray
    lists: DataFrame
    sizes: np.ndarray
    radii: np.ndarray
    probes: int


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, width)


def fit(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of length 1 of vectors of length 1; a centroid that loses all its vectors takes the one farthest from its own."""
    centroids = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = x @ centroids.T
        mine = near.argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, mine, x)
        lost = np.flatnonzero(np.bincount(mine, minlength=lists) == 0)
        sums[lost] = x[np.argsort(near[np.arange(len(x)), mine], kind="stable")[: len(lost)]]
        centroids = _unit(sums)
    return centroids


def probes_for(x: np.ndarray, centroids: np.ndarray, recall: float = RECALL) -> int:
    """The fewest lists that hold so much of the neighbours of some of the fitted vectors; theirs are farther off than those among all vectors, so it is rather too many."""
    k = min(NEIGHBOURS, len(x) - 1)
    if k < 1:
        return len(centroids)
    tried = np.linspace(0, len(x) - 1, min(TRIALS, len(x))).astype(int)
    scores = x[tried] @ x.T
    scores[np.arange(len(tried)), tried] = -np.inf
    best = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    mine = (x @ centroids.T).argmax(axis=1)
    place = np.argsort(np.argsort(-(x[tried] @ centroids.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, mine[best], 1).ravel())
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)]) + 1


def build(items: DataFrame, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex | None:
    """The index of ``items`` (id, vec). Vectors of another length than the first one's, of length 0 and nulls have no direction and are not listed.

    ``lists`` centroids (by default about twice the root of the number of vectors, 20 of the sample's vectors each at least) are fitted
    on the ``sample`` vectors that come first by a hash of their ids, on which it is also tried how many lists a query has to look into. None without vectors.
    """
    of = F.col("vec").cast("array<double>")
    first = items.where(F.size("vec") > 0).select(F.size("vec").alias("n")).first()
    if first is None:
        return None
    width = first["n"]
    some = items.select(F.col("id").cast("long"), of.alias("vec")).where((F.size("vec") == width) & F.exists("vec", lambda v: v != 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))
    fitted = _unit(_vectors(some.orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column(0).combine_chunks(), width))
    if not len(fitted):
        return None
    lists = lists or max(1, min(round(2 * some.count() ** 0.5), len(fitted) // 20, MOST_LISTS))
    centroids = fit(fitted, min(lists, len(fitted)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_vectors(batch.column(1), width))
            near = x @ centroids.T
            mine = near.argmax(axis=1)
            away = np.sqrt(np.maximum(2 - 2 * near[np.arange(len(x)), mine], 0)) if len(x) else np.zeros(0)
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(mine.astype(np.int32)), batch.column(0), vec, pa.array(away)], names=["list", "id", "vec", "away"])

    listed = cut(some.mapInArrow(run, "list int, id long, vec array<double>, away double"))
    sizes, radii = np.zeros(len(centroids), np.int64), np.zeros(len(centroids))
    for r in listed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # a row a centroid
        sizes[r["list"]], radii[r["list"]] = r["n"], r["r"]
    return VectorIndex(centroids, listed.drop("away"), sizes, radii, probes_for(fitted, centroids))


def _looks(queries: DataFrame, width: int, choose: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """(query, vec, list) of the lists that ``choose`` marks for queries (query, vec, ...)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(_vectors(batch.column(1), width))
            at, to = np.nonzero(choose(x, batch))
            vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(at) * width + 1, width, dtype=np.int32)), pa.array(x[at].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), vec, pa.array(to.astype(np.int32))], names=["query", "vec", "list"])

    return queries.mapInArrow(run, "query long, vec array<double>, list int")


def _scores(index: VectorIndex, looks: DataFrame, k: int) -> DataFrame:
    """(query, id, score) of the best k vectors of each query in each block of a list that it looks into."""
    width, spark = index.centroids.shape[1], looks.sparkSession
    asked = {r["list"]: r["n"] for r in looks.groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row a centroid
    dealt = [(c, -(-int(n) // LIST_ROWS), -(-asked.get(c, 0) // LIST_QUERIES)) for c, n in enumerate(index.sizes) if n and asked.get(c)]
    deals = F.broadcast(spark.createDataFrame(dealt, "list int, parts int, asks int"))  # MOST_LISTS rows at most
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = index.lists.join(deals, "list").withColumn("part", mine("id", "parts")).withColumn("ask", each("asks")).select("list", "part", "ask", "id", "vec")
    right = looks.join(deals, "list").withColumn("ask", mine("query", "asks")).withColumn("part", each("parts")).select("list", "part", "ask", "query", "vec")

    def score(items: pa.Table, queries: pa.Table) -> pa.Table:
        names, ids = queries.column("query").to_numpy(), items.column("id").to_numpy()
        x, q = (_vectors(t.column("vec").combine_chunks(), width) for t in (items, queries))
        s = np.round(q @ x.T, 12)
        keep = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
        return pa.table({"query": np.repeat(names, keep.shape[1]), "id": ids[keep].ravel(), "score": np.take_along_axis(s, keep, 1).ravel()})

    keys = ["list", "part", "ask"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, "query long, id long, score double")


def search(index: VectorIndex, queries: DataFrame, k: int = 10, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(query, id, score, rank): the k best vectors of each query (query, vec) in the lists of its ``probes`` nearest centroids (by default the index's number); ties go to the lower id.

    With ``exact``, further lists are searched as long as one of them may hold a better vector than the k-th, and the answer is that of a
    full comparison. Queries of another length than the index's, of length 0 and nulls have no answer.
    """
    centroids, radii, width, probes = index.centroids, index.radii, index.centroids.shape[1], probes or index.probes
    of = queries.select(F.col("query").cast("long"), F.col("vec").cast("array<double>").alias("vec")).where((F.size("vec") == width) & F.exists("vec", lambda v: v != 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v)))

    def nearest(x: np.ndarray) -> np.ndarray:
        marks = np.zeros((len(x), len(centroids)), bool)
        np.put_along_axis(marks, np.argsort(-(x @ centroids.T), axis=1, kind="stable")[:, :probes], True, 1)
        return marks

    looks = cut(_looks(of, width, lambda x, _: nearest(x)))
    found = _scores(index, looks, k)
    if exact:
        found = cut(first_rows(found, "query", [F.desc("score"), F.col("id")], k))
        last = found.groupBy("query").agg(F.min("score").alias("score"), F.count("*").alias("n"))
        reach = F.when(F.col("n") >= k, F.col("score")).otherwise(-2.0)

        def left(x: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            to = np.sqrt(np.maximum(2 - 2 * x @ centroids.T, 0)) - radii
            within = np.sqrt(np.maximum(2 - 2 * batch.column(2).to_numpy(zero_copy_only=False), 0))
            return (to <= within[:, None] + 1e-6) & ~nearest(x)

        more = cut(_looks(of.join(last, "query", "left").select("query", "vec", F.coalesce(reach, F.lit(-2.0)).alias("reach")), width, left))
        found = found.unionByName(_scores(index, more, k))
    return first_rows(found, "query", [F.desc("score"), F.col("id")], k, rank="rank")


def compared(index: VectorIndex, queries: DataFrame, probes: int | None = None) -> float:
    """The share of all pairs of queries and vectors that a search of so many lists compares."""
    centroids, width, probes = index.centroids, index.centroids.shape[1], probes or index.probes
    nearest = lambda x, _: np.argsort(np.argsort(-(x @ centroids.T), axis=1, kind="stable"), axis=1) < probes
    looks = _looks(queries.select(F.col("query").cast("long"), F.col("vec").cast("array<double>")), width, nearest).groupBy("list").count().collect()
    total = sum(r["count"] for r in looks) / min(probes, len(centroids)) * index.sizes.sum()
    return float(sum(r["count"] * index.sizes[r["list"]] for r in looks) / total)
