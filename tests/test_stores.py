"""Stores against a dictionary, faults midway, files and versions; snapshots; the contract of sources."""

from __future__ import annotations

import datetime
import glob
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from quillstone.sources import contract, files, stores

SCHEMA = "conv_id string, saved_at int, summary string"


def held(store):
    return {r["conv_id"]: (r["saved_at"], r["summary"]) for r in store.load().collect()}


def test_like_a_dictionary(spark, tmp_path):
    rng = random.Random(1)
    store, want = stores.packages(spark, f"file://{tmp_path}/s", SCHEMA), {}
    assert held(store) == {} and store.versions() == [] and store.compact() == 1
    for step in range(8):
        keys = [f"c{rng.randrange(12)}" for _ in range(5)]
        if step % 3 == 2:
            store.delete(spark.createDataFrame([(k,) for k in keys], "conv_id string"))
            for k in keys:
                want.pop(k, None)
        else:
            rows = [(k, step * 10 + i, None if i == 4 else f"v{step}.{i}") for i, k in enumerate(keys)]
            store.save(spark.createDataFrame(rows, SCHEMA))
            want |= {k: (t, v) for k, t, v in rows}
        if step % 4 == 3:
            store.compact()
            assert len(store.batches()) == 1
        assert held(store) == want
    assert [r["conv_id"] for r in store.list().collect()] == sorted(want, key=lambda k: (-want[k][0], k))
    assert held(stores.packages(spark, f"file://{tmp_path}/s", SCHEMA)) == want


def test_files_do_not_grow_with_keys(spark, tmp_path):
    store = stores.Store(spark, f"file://{tmp_path}/s", "k long, at int", ("k",), "at", buckets=4)
    store.save(spark.range(5000).select(F.col("id").alias("k"), F.lit(1).alias("at")))
    assert len(glob.glob(f"{tmp_path}/s/data/*/*.parquet")) <= 4 and store.load().count() == 5000


def test_a_write_that_fails_leaves_the_old_table(spark, tmp_path):
    store = stores.packages(spark, f"file://{tmp_path}/s", SCHEMA)
    store.save(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    bad = spark.range(100).select(F.col("id").cast("string").alias("conv_id"), F.when(F.col("id") == 77, F.raise_error(F.lit("midway"))).otherwise(F.lit("v")).alias("summary"), F.lit(2).alias("saved_at"))
    for write in (store.save, store.replace):
        with pytest.raises(Exception, match="midway"):
            write(bad.repartition(8))
        assert held(store) == {"a": (1, "x")} and store.versions() == [1]
    for rows in ([("", 1, "x")], [(None, 1, "x")], [("  ", 1, "x")]):
        with pytest.raises(Exception, match="needs conv_id"):
            store.save(spark.createDataFrame(rows, SCHEMA))
    assert held(store) == {"a": (1, "x")}
    store.vacuum()
    assert len(os.listdir(tmp_path / "s" / "data")) == 1 and held(store) == {"a": (1, "x")}


def test_two_writers(spark, tmp_path):
    one = stores.packages(spark, f"file://{tmp_path}/s", SCHEMA)
    one.save(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    with pytest.raises(stores.Taken):
        one._publish([], [], 0)
    assert held(one) == {"a": (1, "x")} and os.listdir(tmp_path / "s" / "drafts") in ([], [x for x in os.listdir(tmp_path / "s" / "drafts") if x.endswith(".crc")])


def test_versions_and_restore(spark, tmp_path):
    store = stores.packages(spark, f"file://{tmp_path}/s", SCHEMA)
    row = lambda *r: spark.createDataFrame([r], SCHEMA)
    store.save(row("a", 1, "x"))
    store.replace(row("b", 1, "y"))
    assert held(store) == {"b": (1, "y")} and [r["conv_id"] for r in store.load(1).collect()] == ["a"]
    store.restore(1)
    assert held(store) == {"a": (1, "x")} and store.versions() == [1, 2, 3]
    store.vacuum(keep=1)
    assert held(store) == {"a": (1, "x")} and store.versions() == [3]


def test_projects(spark, tmp_path):
    store = stores.projects(spark, f"file://{tmp_path}/p")
    rows = [("b", "brief", 1, "{}"), ("a", "brief", 1, "1"), ("a", "brief", 2, "2"), ("c", stores.artifact("outline", "patient"), 1, "{}")]
    store.save(spark.createDataFrame(rows, "project string, artifact string, t int, body string").select("project", "artifact", F.timestamp_seconds("t").alias("saved_at"), "body"))
    assert [r[0] for r in stores.project_names(store).collect()] == ["a", "b"]
    assert store.load().where("project = 'a'").first()["body"] == "2"
    for kind, who in (("brief", "patient"), ("outline", ""), ("other", "")):
        with pytest.raises(ValueError):
            stores.artifact(kind, who)


def test_corrections(spark, tmp_path):
    store = stores.corrections(spark, f"file://{tmp_path}/c")
    now = datetime.datetime(2026, 7, 31, 1, 30)
    stores.record(store, spark.createDataFrame([("", "trial", "missed"), (None, "odd", "x"), ("corr-1", "drug", "y")], "id string, type string, context string"), now)
    got = {r["context"]: r for r in store.load().collect()}
    assert got["missed"]["id"].startswith("corr-20260731-013000-") and got["x"]["type"] == "general" and {r["status"] for r in got.values()} == {"pending"} and got["y"]["timestamp"] == now
    stores.record(store, spark.createDataFrame([("corr-1", "drug", "y", "fixed")], "id string, type string, context string, status string"), now + datetime.timedelta(hours=1))
    assert store.load().count() == 3 and store.load().where("id = 'corr-1'").first()["status"] == "fixed"


def test_snapshots(spark, tmp_path):
    sheet = lambda *rows: spark.createDataFrame([(i, r) for i, r in rows], "row int, values array<string>")
    good = sheet((1, ["﻿a ", "b", "c"]), (2, ["1"]), (3, [None, "x"]), (5, ["2", "y", "z", "over"]), (6, [" ", "w"]), (7, None))
    names = ["a", "b", "c"]
    rows = sorted(tuple(r) for r in stores.snapshot(good, names).collect())
    assert rows == [(2, "1", "", ""), (3, "", "x", ""), (5, "2", "y", "z")]
    for bad in (sheet((1, ["a", "b"]), (2, ["1"])), sheet((2, ["1"])), sheet((1, names), (2, [" "])), sheet((1, None))):
        with pytest.raises(ValueError):
            stores.snapshot(bad, names)
    store = stores.Store(spark, f"file://{tmp_path}/s", "row int, a string, b string, c string", ("row",), "row")
    store.save(spark.createDataFrame([(9, "old", "", "")], "row int, a string, b string, c string"))
    assert stores.pull(store, good, names) == 2 and sorted(tuple(r) for r in store.load().collect()) == rows
    store.restore(1)
    assert [r["a"] for r in store.load().collect()] == ["old"]


def test_direction(spark):
    t = lambda *v: spark.createDataFrame([(i, x) for i, x in enumerate(v)], "row int, a string")
    base, other, third = t("x", "y"), t("x", "z"), t("q", "y")
    assert stores.direction(base, base, base) == stores.direction(base, other, other) == "same"
    assert stores.direction(base, base.repartition(3), other) == "pull" and stores.direction(base, other, base) == "push" and stores.direction(base, other, third) == "conflict"
    assert stores.direction(base, t("y", "x"), base) == "push"


def harvest(spark, tmp_path):
    rows = [(s, y, f"{s}{y}.{i}", f"Title {'liver' if i % 2 else 'lung'} {i}") for s in ("pubmed", "s2", "open alex") for y in (2018, 2019, 2020) for i in range(4)]
    df = spark.createDataFrame([*rows, ("s2", None, "n", "liver")], "source string, year int, id string, title string")
    contract.save_harvest(df, f"file://{tmp_path}/h")
    return f"file://{tmp_path}/h", rows


def test_contract(spark, tmp_path):
    path, rows = harvest(spark, tmp_path)
    ids = lambda df: sorted(r["id"] for r in df.collect())
    assert ids(contract.search(spark, path)) == sorted([r[2] for r in rows] + ["n"])
    got = contract.search(spark, path, enabled=("pubmed", "open alex"), years=(2019, 2020), words=("liver",))
    assert ids(got) == sorted(r[2] for r in rows if r[0] != "s2" and r[1] >= 2019 and "liver" in r[3])
    assert got.rdd.getNumPartitions() == 4
    one = contract.search(spark, path).where("source = 's2' AND year = 2018 AND id LIKE '%1'")
    assert ids(one) == ["s22018.1"] and one.rdd.getNumPartitions() == 1
    none = contract.search(spark, path, years=(1900, 1901))
    assert none.count() == 0 and contract.search(spark, f"file://{tmp_path}/nowhere").count() == 0
    assert contract.search(spark, path, limit=1).count() == 10
    assert contract.search(spark, path, limit=1, words=("liver",)).count() <= 10
    health = {r["source"]: r["ok"] for r in contract.health(spark, path, ("pubmed", "none")).collect()}
    assert health == {"pubmed": True, "none": False}


def test_contract_pushes_filters(spark, tmp_path):
    path, _ = harvest(spark, tmp_path)
    df = contract.search(spark, path, years=(2019, 2019), words=("liver",)).where("doi IS NULL")
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = [x for x in plan.splitlines() if x.strip(" +-:").startswith(("Filter", "*(1) Filter"))]
    assert all("year" not in x and "title" not in x for x in filters) and any("doi" in x for x in filters), plan


def test_contract_passes_over_faults(spark, tmp_path):
    at = tmp_path / "h" / "source=x" / "year=2020"
    at.mkdir(parents=True)
    (at / "a.json").write_text('{"id": "1", "title": "t", "cited_by": "no"}\nno json\n[1]\n{"id": 5}\n' + json.dumps({"id": "2", "cited_by": 3}))
    got = sorted((r["id"] or "", r["cited_by"] or 0) for r in contract.search(spark, f"file://{tmp_path}/h").collect())
    assert got == [("", 0), ("1", 0), ("2", 3)]


def test_reports(spark, tmp_path):
    df = spark.range(3000).select(F.col("id").alias("n"), F.when(F.col("id") == 1, "a|b <c>\n&").alias("text"))
    lines = [r["value"] for r in files.report(df.repartition(5), "R & D", ["n"]).collect()]
    assert lines[:6] == ["# R & D", "", "| n | text |", "|---|---|", "| 0 |  |", "| 1 | a\\|b <c> & |"] and len(lines) == 3004
    files.report(df.repartition(5), "R & D", ["n"], html=True).write.text(f"file://{tmp_path}/r")
    page = "".join(open(f).read() for f in sorted(glob.glob(f"{tmp_path}/r/part-*")))
    assert "<h1>R &amp; D</h1>" in page and "<td>a|b &lt;c&gt; &amp;</td>" in page and page.count("<tr>") == 3001 and page.rstrip().endswith("</html>")
