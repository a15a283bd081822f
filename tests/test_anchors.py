"""Anchors of slides against all lines, main files against their references, numbers of large groups."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillstone.operators import anchors as A
from quillstone.operators import planning as P


def brute(slides, lines, words, n, least):
    out = {}
    for slide, file, text in slides:
        asked = [w for w in words if w in (text or "")][: A.WORDS]
        scored = []
        for f, i, line in sorted(lines):
            if f == file:
                k = len(line)
                base = 5 if 5 <= k <= 100 else 3 if 100 < k <= 200 else -5 if k > 300 else 0
                score = base + sum(len(w) for w in asked if w in line)
                if score >= least:
                    scored.append((score, i, line))
        scored.sort(key=lambda x: -x[0])
        seen, mine = set(), []
        for score, i, line in scored:
            if line[: A.HEAD].lower() not in seen:
                seen.add(line[: A.HEAD].lower())
                mine.append((i, score, line))
        for r, x in enumerate(mine[:n], 1):
            out[slide, r] = x
    return out


def test_anchors(spark):
    rng = random.Random(4)
    words = ("aa", "bb", "cc", "dd ee", "补体", "zz")
    text = lambda n: " ".join(rng.choice([*words, "x", "yy", "Qq"]) for _ in range(n))
    lines = [(f, i, (text(rng.choice([1, 3, 20, 60, 120])) if rng.random() < 0.8 else "same head " * 6 + text(rng.choice([1, 90])))) for f in ("f", "g", "h") for i in range(40)]
    slides = [(k, rng.choice(["f", "g", "h", "none"]), text(rng.randint(0, 6))) for k in range(60)] + [(90, "f", None), (91, "g", "")]
    got = A.anchors(spark.createDataFrame(slides, "slide int, file string, text string"), spark.createDataFrame(lines, "file string, i int, text string"), words, 4)
    got = {(r["slide"], r["rank"]): (r["i"], r["score"], r["text"]) for r in got.collect()}
    assert got == brute(slides, lines, words, 4, A.LEAST) and len(got) > 150


def test_anchors_plan(spark):
    d = spark.createDataFrame([(1, "f", "TMA")], "slide int, file string, text string")
    df = A.anchors(d, spark.createDataFrame([("f", 1, "TMA and more")], "file string, i int, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert df.collect()[0]["score"] == 8


def test_main_files(spark):
    rows = [
        (1, "P4-1", False, "Finn R. J Hepatol 2020", "jhepatol-2020.pdf", None), (2, "P4-2", False, "Finn R. J Hepatol", "x-1.pdf", ("无任何关键词匹配", "finn, hepatol, jhepatol, j_hepatol, 2020")), (3, "P15-1_P16-1", False, "Finn", "x-1.pdf", None), (4, "P4-3", True, "Finn", "x-1.pdf", None),
        (5, "P3-1", False, "Finn", "finn.pdf", ("GLOBOCAN 错位", "GLOBOCAN/IARC PDF")), (6, "P3-1", False, "Finn", "GCO.IARC-1.pdf", None), (7, "P4-4", False, "Finn", None, None), (8, "P4-5", False, "肝癌 诊疗", "指南肝癌.pdf", None), (9, "P4-6", False, "xy", "a-2020.pdf", None), (10, "P4-7", False, None, "fi-nn.pdf", ("无任何关键词匹配", "2020")),
        (11, "P4-8", False, "Finn", "Fi-nn.pdf", None), (12, None, False, "Finn", "q.pdf", None),
    ]
    df = spark.createDataFrame([r[:5] for r in rows], "k int, row string, shared boolean, raw string, main string")
    m = A.file_mismatch(F.col("row"), F.col("shared"), F.col("raw"), {"year": F.lit(2020)}, F.col("main"), F.lit(None).cast("string"))
    got = {r["k"]: r["m"] and (r["m"]["kind"], r["m"]["expected"]) for r in df.select("k", m.alias("m")).collect()}
    assert got == {r[0]: r[5] for r in rows}


def test_numbers_beyond_three_figures(spark):
    items = spark.range(2005).select(F.when(F.col("id") < 1001, 1).otherwise(2).alias("project"), F.lit("literature").alias("dimension"), F.format_string("k%05d", F.col("id")).alias("key"), F.col("id").alias("ord"))
    got = P.numbered(items.repartition(5)).orderBy("project", "ord").collect()
    assert [r["item"] for r in got] == [f"L{n:03d}" for size in (1001, 1004) for n in range(1, size + 1)]
    few = P.numbered(items.where("ord >= 1001")).where("item >= 'L100' AND item < 'L101' OR item = 'L999'")
    assert {r["section"]: r["items"] for r in P.evidence_of(few, most=3).collect()} == {"4": "L100,L999,L1000", "6": "L100,L999,L1000"}


def test_first_rows(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(3)
    got = sorted(((r["g"], r["n"], r["i"]) for r in P.first_rows(df, "g", ["x", "i"], 7, rank="n").collect()), key=repr)
    want = [(g, k + 1, r[2]) for g in ("a", "b", None) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))[:7])]
    assert got == sorted(want, key=repr)


def test_ranked(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "a", "b", None]), rng.randrange(9), i) for i in range(500)]
    got = {r["i"]: r["n"] for r in P.ranked(spark.createDataFrame(rows, "g string, x int, i int"), ("g",), ("x", "i"), "n").collect()}
    want = {r[2]: k + 1 for g in ("a", "b", None) for k, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])))}
    assert got == want


def joined_rows(df):
    """The rows that each join of the plan of ``df`` gave."""
    rows = df.collect()
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        elif name != "ReusedExchangeExec":
            if "Join" in name:
                out.append(p.metrics().get("numOutputRows").get().value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    return rows, out


def test_slides_and_lines_of_one_word_are_not_paired(spark):
    slides = spark.range(2000).select(F.col("id").alias("slide"), F.lit("f").alias("file"), F.lit("a TMA and HUS").alias("text"))
    lines = spark.range(2000).select(F.lit("f").alias("file"), F.col("id").alias("i"), F.concat(F.col("id").cast("string"), F.lit(" of TMA")).alias("text"))
    rows, joined = joined_rows(A.anchors(slides, lines))
    assert len(rows) == 6000 and {(r["rank"], r["i"], r["score"]) for r in rows} == {(1, 0, 8), (2, 1, 8), (3, 2, 8)}
    assert joined and max(joined) <= 6000
