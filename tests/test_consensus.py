"""Voters, briefs and cells of any depth."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import cells as K
from quillstone.operators import consensus as C


def test_voters(spark, monkeypatch):
    monkeypatch.setattr(C, "VOTERS", {})
    q = spark.createDataFrame([(1, "a", "b"), (2, "x", "x"), (3, None, "z")], "question int, p string, q string")
    C.register("p", C.expression(F.col("p"), 0.9))
    C.register("q", C.expression(F.col("q"), 0.5))
    C.register("row", lambda d: d.select("question", F.lit("b").alias("answer"), F.lit(0.1).alias("confidence")))
    got = {r["question"]: (r["answer"], round(r["agreement"], 3), r["agreed"], [tuple(a) for a in r["answers"]]) for r in C.decide(C.ask(q)).collect()}
    assert got == {1: ("b", 0.667, True, [("b", 2, 0.3), ("a", 1, 0.9)]), 2: ("x", 0.667, True, [("x", 2, 0.7), ("b", 1, 0.1)]), 3: (None, 0.333, False, [(None, 1, 0.9), ("z", 1, 0.5), ("b", 1, 0.1)])}
    assert C.decide(C.ask(q, [])).count() == 0 and C.ask(q, ["p", "p"]).count() == 6
    with pytest.raises(KeyError):
        C.ask(q, ["none"])


def test_ties(spark):
    v = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.5), (1, "b", 0.9), (1, "b", 0.0), (1, "c", None)], "question int, answer string, confidence double")
    assert C.decide(v, "avg_confidence").first()["answer"] == "a" and C.decide(v, "max_confidence").first()["answer"] == "b"


def test_briefs(spark):
    briefs = spark.createDataFrame([(1, ["fast", " ", None, "cheap"], ["rival"]), (2, None, None)], "project int, differentiators array<string>, competitors array<string>")
    items = spark.createDataFrame([(1, f"i{k}", f"t{k}" * 60, c, k) for k, c in enumerate([5, None, 9, 5, 7, 1])] + [(7, "o", "other", 3, 0)], "project int, id string, title string, cited_by long, ord int")
    got = sorted((r["project"], r["n"], r["item"] or r["claim"]) for r in C.brief_insights(briefs, items).collect())
    assert got == [(1, 1, "i2"), (1, 2, "i4"), (1, 3, "i0"), (1, 4, "i3"), (1, 5, "差异化优势: fast"), (1, 6, "差异化优势: cheap")]
    assert sorted((r["project"], r["part"], r["i"], r["text"][:5]) for r in C.swot(briefs, items).collect()) == [(1, "opportunity", 0, "结合最新政"), (1, "strength", 0, "fast"), (1, "strength", 1, "cheap"), (1, "threat", 0, "竞品 ri"), (2, "opportunity", 0, "结合最新政"), (2, "weakness", 0, "可检索的循")]


def test_cells(spark):
    deep = json.dumps([[[["a"]], {"text": "b", "type": "url", "link": "u"}], "c", 5, None, {"link": "x"}, {"value": "d", "text": 3}])
    cases = {
        None: [], "": [], "null": [], '""': [], '"x"': [("x", "text", "")], "12": [("12", "text", "")], "1.5": [("1.5", "text", "")], "true": [("true", "text", "")], "1e3": [("1000", "text", "")], "plain text": [("plain text", "text", "")],
        '{"rich_text": [{"text": "a"}, {"text": ""}]}': [("a", "text", "")], '{"rich_text": "a"}': [], '{"text": 5, "value": "v"}': [("v", "text", "")], '{"text": ""}': [("", "text", "")], '{"x": 1}': [], "[]": [], deep: [("a", "text", ""), ("b", "url", "u"), ("c", "text", ""), ("d", "text", "")],
        "[" * 500 + '"in"' + "]" * 500: [("in", "text", "")],
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, c string").select("i", K.cell_nodes(F.col("c")).alias("n")).orderBy("i").collect()
    assert [[(x["text"], x["type"], x["link"]) for x in r["n"]] for r in df] == list(cases.values())
    same = spark.createDataFrame([('["a", "b\\n"]', '"ab"'), ('"a"', '"b"'), (None, '""')], "a string, b string").select(K.same_cells(K.cell_nodes(F.col("a")), K.cell_nodes(F.col("b"))).alias("s")).collect()
    assert [r["s"] for r in same] == [True, False, True]
