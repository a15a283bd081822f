"""Answers of models, features of slides and citations, embedders, walks that stop."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import answers as A
from quillstone.operators import embedding as E
from quillstone.operators import graph as G


def column(spark, values, fn):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["x"] for r in df.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_first_objects(spark):
    cases = {
        'x {"a": 1} y': '{"a": 1}', '{"a": "}"} }': '{"a": "}"}', '{"a": "\\"}"} z': '{"a": "\\"}"}', '{"a": {"b": {}}, "c": []} {"d": 1}': '{"a": {"b": {}}, "c": []}', "none": "none", "": "", None: None, 'open {"a": {': '{"a": {', "{\\{}} rest": "{\\{}}", '{"a": "\\\\"} b}': '{"a": "\\\\"}',
    }
    assert column(spark, list(cases), A.first_object) == list(cases.values())


def test_fences(spark):
    cases = {" ```json\n{}\n``` ": "{}", "```JSON {}```": "{}", "```{}": "{}", "{}```": "{}", "{} ": "{}", "``` json {}": "json {}", None: "", "": ""}
    assert column(spark, list(cases), A.unfenced) == list(cases.values())
    assert column(spark, ['{"a": 1} tail', " {} {} x", "x {}", "{", None], A.recovered) == ['{"a": 1}', "{} {}", "x {}", "{", ""]


def test_entities_and_summaries(spark):
    whole = json.dumps({"symptoms": ["cough", "fever"], "phi_flags": None, "subjective": "s", "plan": "p", "alerts": ["x"], "confidence": 0.4})
    answers = [whole, f"Sure:\n```json\n{whole}\n```\nbye", whole + " and so on", "no", "[1]", None, "{}"]
    got = column(spark, answers, A.entities)
    assert [g and (g["symptoms"], g["medications"], g["phi_flags"]) for g in got] == [(["cough", "fever"], [], [])] * 3 + [None] * 3 + [([], [], [])]
    got = column(spark, answers, A.soap)
    assert [g and (g["subjective"], g["objective"], g["plan"], g["alerts"], g["confidence"]) for g in got] == [("s", "", "p", ["x"], 0.4)] * 3 + [None] * 3 + [("", "", "", [], 0.9)]


def test_slide_points(spark):
    cases = {
        "BCLC B 36.7%, Tumor 87.0": ["36.7", "36.7%", "87.0", "87.0%", "BCLC B", "BCLC", "tumor", "Tumor"], "RATIONALE-301 7 9% 6.47": ["301", "9", "9%", "6.47", "6.47%"], "12月 15人 120%": ["12", "15", "120", "120%"], "": [], None: [],
    }
    assert column(spark, list(cases), A.slide_data_points) == list(cases.values())


def test_citation_features(spark):
    got = column(spark, ["Qin S, et al. Lancet. 2025", "任宏, 等. 《中华肝脏病杂志》 2024;6(1):39-50 doi:10.3760/cma.j.cn(1)", "x", None], A.citation_features)
    assert [tuple(g) for g in got] == [("Qin", "Lancet", "2025", "", "", "", ""), ("任宏", "中华肝脏病杂志", "2024", "6", "1", "39-50", "10.3760/cma.j.cn(1)"), ("", "", "", "", "", "", ""), ("", "", "", "", "", "", "")]


def test_addresses(spark):
    urls = ["https://linkinghub.elsevier.com/x", "https://www.nejm.org/d", "https://example.org", "", None]
    assert column(spark, urls, A.publisher_label) == ["ScienceDirect", "NEJM", "出版商", "出版商", "出版商"]
    got = column(spark, urls, lambda c: A.paper_addresses(F.lit("10.1/x"), c))
    assert [len(g) for g in got] == [4, 4, 4, 3, 3] and got[0][0]["label"] == "ScienceDirect 全文" and got[4][0]["url"] == "https://doi.org/10.1/x"
    assert column(spark, ["", "备注 a", None], lambda c: A.paper_addresses(c, F.lit("u"))) == [[], [], []]
    assert column(spark, ["/a", "b", "http://c", "", None], A.absolute_link) == ["https://scholar.google.com/a", "https://scholar.google.com/b", "http://c", "", ""]


def test_embedders(spark, monkeypatch):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(["b a", None, " ", "zz", "123"])], "id int, text string")
    got = {r["id"]: r["vec"] for r in E.embed(d, "id", "text").collect()}
    assert got[1] is None and got[2] is None and np.allclose(got[0][:2], [2**-0.5] * 2) and got[3][25] == 1 and not any(got[4])
    E.register("backwards", lambda texts: [(i, [float(len(t)), 0.0]) for i, t in reversed(list(enumerate(texts)))])
    assert E.embed(d, "id", "text", "backwards").where("id = 3").first()["vec"] == [1.0, 0.0]
    E.register("short", lambda texts: [])
    with pytest.raises(Exception, match="one vector for each"):
        E.embed(d, "id", "text", "short").collect()


def test_walks_that_stop(spark):
    """A match ends its subtree only; of several sections with one id the last one seen is found."""
    rows = [("t", "a", None, 1), ("t", "b", "a", 2), ("t", "c", "b", 3), ("t", "d", None, 4), ("t", "e", "d", 5), ("u", "x", None, 1)]
    walked = G.outline(spark.createDataFrame(rows, "tree string, id string, parent string, turn int"), "tree")
    want = lambda *ids: spark.createDataFrame([("t", i) for i in ids], "tree string, id string")
    seen = lambda w: sorted((r["tree"], r["id"]) for r in G.pruned(walked, w, "tree").collect())
    assert seen(want("b")) == [("t", "a"), ("t", "b"), ("t", "d"), ("t", "e"), ("u", "x")]
    assert seen(want("a", "c")) == [("t", "a"), ("t", "d"), ("t", "e"), ("u", "x")]
    assert [tuple(r) for r in G.find_section(walked, want("b", "e"), "tree").collect()] == [("t", "e", "2.1")]
    assert [tuple(r) for r in G.find_section(walked, want("a", "c"), "tree").collect()] == [("t", "a", "1")]
    assert G.find_section(walked, want("none"), "tree").count() == 0
