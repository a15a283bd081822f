"""Answer pages, ranges, shapes, logs and stores on literal rows."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillstone.sources import extras


def test_answers(spark):
    page = "<div class='a main'>Yes. <b>It</b> does.</div><ul id=refs><li><a href='https://x.y/1'>T1</a><p>S1 2020</p></li><li><p>no link</p></li><li><a>T2</a></li></ul><ul id=refs2><li><a href=z>no</a></li></ul>"
    d = spark.createDataFrame([(1, page), (2, None), (3, "<p>x")], "page_id int, html string")
    r = {x["page_id"]: x for x in extras.answers(d, ".none, .a.main", "#refs, #refs2", "li").collect()}
    assert r[1]["answer"] == "Yes. It does." and [(x["title"], x["url"], x["year"]) for x in r[1]["references"]] == [("T1", "https://x.y/1", 2020), ("T2", "", 0)]
    assert (r[2]["answer"], r[2]["references"]) == ("", []) and r[3]["answer"] == ""


def test_cell_range(spark):
    d = spark.createDataFrame([(json.dumps({"values": [["a", "b"], ["c"], ["", "z"], ["d", "e", "f"], [" ", "tail"]]}),)], "payload string")
    assert [tuple(r) for r in extras.cell_range(d, ("x", "y")).orderBy("row_n").collect()] == [(1, "a", "b"), (2, "c", ""), (3, "", "z"), (4, "d", "e")]


def test_shapes(spark):
    d = spark.createDataFrame([(json.dumps({"slides": [{"slide": 5, "shapes": [{"name": "t", "text": "T"}, {"name": "g", "table": [["a", "b"], ["c", None]]}]}]}),)], "payload string")
    assert [tuple(r) for r in extras.shapes(d).orderBy("shape", "row").collect()] == [(5, 0, 0, "T"), (5, 1, 0, "a | b"), (5, 1, 1, "c | ")]


def test_logs_and_links(spark):
    d = spark.createDataFrame([(i, i % 2) for i in range(10)], "id int, applied int")
    assert [r["id"] for r in extras.training_examples(d, 3).collect()] == [9, 7, 5]
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(extras.registry_of(F.lit("10.1056/NEJMoa2024020"))) == "NCT03298451" and one(extras.registry_of(F.lit("x"))) == ""
    assert [x["url"] for x in one(extras.paper_links(F.lit("10.1/x"), F.lit(""), F.lit("")))][0] == "https://doi.org/10.1/x" and one(extras.paper_links(F.lit(""), F.lit("u"), F.lit("l"))) == []


def test_store(spark):
    kv = lambda *x: spark.createDataFrame(list(x), "id int, v string")
    assert sorted(tuple(r) for r in extras.merge(kv((1, "a"), (2, "b")), kv((2, "c"), (3, "d"))).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert [r["id"] for r in extras.without(kv((1, "a"), (2, "b")), kv((2, ""), (9, ""))).collect()] == [1]
