"""Wider extraction and plans on literal rows."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstone.functions import extract as X
from quillstone.operators import planning as P


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_claim(spark):
    c = one(spark, X.claim(F.lit("China HCC 5-year survival rate only 14.4%, far below other cancers")))
    assert (c["geography"], c["disease"], c["indicator"], c["number"], c["unit"], c["target"], c["conclusion"]) == ("China", "HCC", "5-year survival", 14.4, "%", "其他癌种", "below_all")
    c = one(spark, X.claim(F.lit("中国肝癌发病率高于全球")))
    assert (c["geography"], c["disease"], c["indicator"], c["conclusion"], c["number"]) == ("中国", "肝癌", "发病率", "above", 0.0)


def test_windows(spark):
    line = "Smith A, et al. Lancet Oncol. 2020;21:100-110."
    w = one(spark, X.windows(F.lit("x " * 200 + line + " y" * 200 + " Gut " + "z " * 100)))
    assert len(w) == 1 and line in w[0]
    assert one(spark, X.windows(F.lit("nothing here"))) == []


@pytest.mark.parametrize("line, least", [("doi: 10.1000/x", 2), ("参考文献", 2), ("Smith A 2020", 2), ("plain words", 0)])
def test_line_score(spark, line, least):
    assert (one(spark, X.line_score(F.lit(line))) >= 2) == (least == 2)


def test_notes(spark):
    n = one(spark, X.notes(F.lit("位置1: 「a」 (b)\n- 疗效: 50%\n注: why\n疗效: 50%\nskip")))
    assert (n["visual"], n["data"], n["reasons"]) == (["a (b)"], ["疗效: 50%"], ["注: why"])


def test_keywords(spark):
    k = one(spark, X.keywords(F.lit("Finn RS. Gut 2020 HR 0.58, 14.4%"), F.lit("肝癌 肝癌 发表"), ("Sorafenib",), ("Gut",)))
    got = {x["term"]: x["confidence"] for x in k}
    assert got["14.4%"] == 0.9 and got["HR 0.58"] == 0.85 and got["肝癌"] == 0.6 and got["Gut"] == 0.5 and got["2020"] == 0.4 and got["Finn"] == 0.3
    assert [x["confidence"] for x in k] == sorted((x["confidence"] for x in k), reverse=True)


def brute_keywords(citation, context, known, journals, least, most):
    full = f"{citation or ''} {context or ''}"
    chinese = re.findall("[一-鿿]{2,4}", context or "")
    found = [(0.9, x + "%", "percentage") for x in re.findall(r"(\d+\.?\d*)\s*%", full, re.A)]
    found += [(0.85, t, "hr") for x in re.findall(r"HR\s*[=:]?\s*(\d+\.?\d*)", full, re.A | re.I) for t in (f"HR {x}", f"HR={x}", x)]
    found += [(0.85, w, "drug_or_trial") for w in known if w in full] + [(0.5, w, "journal") for w in journals if w in full]
    found += [(0.6 if chinese.count(w) > 1 else 0.4, w, "cn_term") for w in chinese]
    found += [(0.4, y, "year") for y in re.findall(r"(?<![0-9A-Za-z_])(?:19\d{2}|20\d{2})(?![0-9A-Za-z_])", full) if "发表" in (context or "") or "年份" in (context or "")]
    found += [(0.3, x, "author_surname") for x in re.findall(r"^\s*([A-Z][a-zA-Z\-]+)", citation or "")]
    best = [x for x in dict.fromkeys(found) if x[0] >= least and not any(y[1] == x[1] and y[0] > x[0] for y in found)]
    return sorted(best, key=lambda x: (-x[0], x[1].encode()))[:most]


@pytest.mark.parametrize("known, journals, least, most", [(("Gut", "2020", "0.58", "肝癌"), ("Gut", "肝癌", "生存"), 0.3, 12), (("HR 0.58",), ("2021", "Finn"), 0.4, 3), ((), (), 0.85, 5), (("Gut", "Gut"), (), 0.95, 5)])
def test_keywords_by_brute_force(spark, known, journals, least, most):
    r = random.Random(3)
    parts = ["Finn", " Gut ", "2020 ", "2021;", " HR 0.58 ", "hr=2020", "HR: 3.", " 14.4%", "7 %", "0.58 % ", " 肝癌 ", "肝癌生存期长", " 生存 ", " 年份 ", "发表 ", "x"]
    rows = [tuple("".join(r.choices(parts, k=r.randrange(9))) for _ in range(2)) for _ in range(300)] + [(None, None), ("", ""), (None, "发表 2020"), ("Finn", None)]
    got = spark.createDataFrame(rows, "citation string, context string").select("citation", "context", X.keywords(F.col("citation"), F.col("context"), known, journals, least, most).alias("k")).collect()
    assert [[tuple(x) for x in g["k"]] for g in got] == [brute_keywords(g["citation"], g["context"], known, journals, least, most) for g in got]


def test_keywords_are_worked_out_once(spark):
    from quillstone.plans.extraction import keyword_terms

    plan = keyword_terms(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter (size(" not in plan and "Filter ((size(" not in plan and plan.count(r"(?i)HR\s*[=:]?") == 1 and plan.count("concat_ws(") == 1


@pytest.mark.parametrize("term, has", [("14.4%", "14.4％"), ("HR 0.5", "HR = 0.5"), ("n=12", "n = 12"), ("a b", "ab")])
def test_term_variants(spark, term, has):
    assert has in one(spark, X.term_variants(F.lit(term)))


def test_locate(spark):
    d = spark.createDataFrame([("x Ｈello  wo rld, hello world ﬁn", "Hello world"), ("a", ""), (None, "q"), ("ﬁne", "fine")], "t string, q string")
    r = [[(p["start"], p["stop"]) for p in x["l"]] for x in d.select(X.locate("t", "q").alias("l")).collect()]
    assert r == [[(2, 15)], [], [], [(0, 3)]]


def test_search_clause(spark):
    q = lambda *v: one(spark, X.search_clause(*[F.lit(x) for x in v]))
    assert q("Abou-Alfa GK, et al", "Lancet Oncol", 2022, "t") == '"Abou-Alfa"[Author] AND "Lancet Oncol"[Journal] AND 2022[Date - Publication - Year]'
    assert q("", "ASCO meeting", 0, "one two three four") == '"one two three"[Title/Abstract]'


def test_markdown(spark):
    t = "a [b](https://c.d/e) f"
    n = one(spark, X.markdown_nodes(F.lit(t)))
    assert [(x["text"], x["type"]) for x in n] == [("a ", "text"), ("b", "url"), (" f", "text")]
    assert one(spark, X.markdown_of(X.markdown_nodes(F.lit(t)))) == t


def test_query_matrix(spark):
    schema = "project string, name string, company string, moa string, indications array<string>, competitors array<string>, terms array<string>"
    d = spark.createDataFrame([("p", "Drug", "", "PD-1", ["HCC"], ["Rival", ""], ["cost"]), ("q", "", "", "", [], [], ["cost"])], schema)
    r = {(x["project"], x["dimension"], x["query"]) for x in P.query_matrix(d).collect()}
    assert ("p", "literature", "Drug HCC clinical trial") in r and ("p", "competitor", "Rival HCC 临床 进展") in r and ("p", "literature", "HCC cost") in r
    assert {x for x in r if x[0] == "q"} == {("q", "policy", "药品审评审批 医保谈判 最新政策")}


def test_numbering_and_evidence(spark):
    d = spark.createDataFrame([("p", "literature", f"k{i % 8}", i) for i in range(12)] + [("p", "news", "n", 0)], "project string, dimension string, key string, ord int")
    n = P.numbered(d)
    assert {r["item"] for r in n.collect()} == {f"L{i:03d}" for i in range(1, 9)} | {"N001"}
    e = {r["section"]: r["items"] for r in P.evidence_of(n).collect()}
    assert e["4"] == "L001,L002,L003,L004,L005,L006" and e["1"] == "N001"


def test_outline_changes(spark):
    d = lambda *x: spark.createDataFrame([("t", *v) for v in x], "t string, title string, points int")
    r = P.outline_changes(d(("A", 1), ("b", 2)), d((" a", 3), ("C", 1)), "t").first()
    assert tuple(r)[1:] == (2, 2, 1, 1, 1)


def test_coverage(spark):
    truth = spark.createDataFrame([(1, "14.4% 12月"), (2, "3万"), (3, "none")], "k int, text string")
    seen = spark.createDataFrame([(1, ["14.4%"])], "k int, points array<string>")
    assert {r["unit"]: (r["wanted"], r["found"]) for r in P.coverage(truth, seen, "k").collect()} == {"%": (1, 1), "月": (1, 0), "万": (1, 0), "row": (3, 2)}


def test_step_matrix(spark):
    d = spark.createDataFrame([("p", "a", True), ("p", "b", True), ("p", "b", False)], "project string, step string, ok boolean")
    r = P.step_matrix(d, ["a", "b", "c"]).first()
    assert (r["a"], r["b"], r["c"], r["failed"]) == (True, False, None, "b")
