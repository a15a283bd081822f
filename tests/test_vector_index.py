"""The index of inverted lists against full comparison."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.operators import similarity as S
from quillstone.operators import vector_index as V

ITEMS, QUERIES = "id long, vec array<float>", "query long, vec array<float>"


def clustered(n, width, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, width))
    return centres[rng.integers(0, 30, n)] + rng.normal(size=(n, width)) * 0.6


@pytest.fixture(scope="module")
def data(spark):
    x = clustered(4000, 24, 1)
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], ITEMS).repartition(6).cache()
    queries = items.where("id % 50 = 0").select(F.col("id").alias("query"), "vec").cache()
    return items, queries


def rows(df):
    return sorted((r["query"], r["rank"], r["id"]) for r in df.collect())


def test_recall(data):
    items, queries = data
    index = V.build(items)
    assert index.sizes.sum() == items.count() and len(index.centroids) == 126
    want = {(q, i) for q, _, i in rows(S.nearest(items, queries, 10))}
    got = {(q, i) for q, _, i in rows(V.search(index, queries, 10))}
    recall, share = len(got & want) / len(want), V.compared(index, queries)
    assert recall >= 0.9 and share < 0.25 and index.probes < 20, (recall, share, index.probes)


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_given_vectors(spark, sf):
    """Vectors spread evenly, of which no list holds what belongs together: many lists are looked into."""
    d = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = d.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    index = V.build(d)
    want, got = ({(a, i) for a, _, i in rows(x)} for x in (S.nearest(d, q, 10), V.search(index, q, 10)))
    assert len(got & want) / len(want) >= 0.9 and V.compared(index, q) < 0.8


@pytest.mark.parametrize(("list_rows", "list_queries"), [(16384, 2048), (20, 3)])
def test_exact(data, monkeypatch, list_rows, list_queries):
    """Whatever the blocks and however few lists are looked into first."""
    monkeypatch.setattr(V, "LIST_ROWS", list_rows)
    monkeypatch.setattr(V, "LIST_QUERIES", list_queries)
    items, queries = data
    index = V.build(items, lists=40)
    assert rows(V.search(index, queries, 10, probes=1, exact=True)) == rows(S.nearest(items, queries, 10))


def test_ties_and_odd_vectors(spark):
    x = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0]), (7, [0.0, 5.0]), (7, [0.0, 5.0]), (8, [float("nan"), 1.0])]
    items = spark.createDataFrame(x, ITEMS)
    queries = spark.createDataFrame([(1, [5.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [0.0, 1.0])], QUERIES)
    got = {}
    for q, r, i in rows(V.search(V.build(items), queries, 2, exact=True)):
        got.setdefault(q, []).append(i)
    assert got == {1: [1, 2], 5: [7, 7]}
    assert V.build(items.where("id IN (4, 5)")) is None and V.build(items.limit(0)) is None
    assert V.search(V.build(items), queries.limit(0), 3).count() == 0


def test_more_neighbours_than_vectors(spark):
    items = spark.createDataFrame([(i, [float(i + 1), 1.0]) for i in range(5)], ITEMS)
    got = V.search(V.build(items, lists=3), items.select(F.col("id").alias("query"), "vec"), 9, probes=1, exact=True)
    assert got.count() == 25
