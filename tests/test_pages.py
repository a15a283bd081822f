"""Slides, placed documents, boxes and zones: literal cases and brute force."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import marks, placed, zones
from quillstone.operators.reconcile import context_lines


def line_marks(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, line string").select("i", marks.line_marks(marks.stripped(F.col("line"))).alias("m"))
    return [(r["m"]["marks"], r["m"]["kind"]) for r in df.orderBy("i").collect()]


def test_lines(spark):
    cases = {
        "中国肝癌新发和死亡病例占全球近半数1": ([1], "text"), "其他癌种3": ([3], "text"), "HBV感染率高1,2": ([1, 2], "text"), "中国肝癌患者肿瘤负荷大1-3": ([1, 2, 3], "text_range"), "《健康中国行动》2": ([2], "text"), "a 12-30": ([], "text"),
        "a 1-9": ([9], "text"), "a 9-3": ([3], "text"), "20": ([], "text"), "12.5": ([], "text"), "24.": ([], "text"), "PD-L1: 程序性死亡配体1; CTLA-4 相关蛋白4": ([], "text"), "anti PD-1": ([], "text"), "anti ctla4": ([4], "text"), "HCC 占比 7": ([7], "text"),
        "ORIENT-3": ([], "text"), "checkmate 9": ([], "text"), "N=12": ([], "text"), "HR= 0.5": ([], "text"), "J Hematol Oncol. 17(1): 13": ([], "text"), "N Engl J Med. 2020": ([], "text"), "Zhang, Huajun et al 2022": ([], "text"), "JCO 2013": ([13], "text"),
        "  率 4 　": ([4], "text"), "no mark": ([], "text"), "": ([], "text"), "标25": ([], "text"), "标0": ([], "text"), "标1,25, 3": ([1, 3], "text"),
    }
    assert line_marks(spark, list(cases)) == list(cases.values())


def test_marks_of_slides(spark):
    rows = [
        (1, 5, "T", 0, ["h", "方案9", "x"]), (1, 5, "T", 1, [" r ", "仑伐替尼5", "奥沙利铂+5‑FU+亚叶酸钙2"]), (1, 5, "T", 2, ["r", "T+A方案8,9", None]), (1, 5, "T", 3, ["r", "O+Y15,16", "仑伐替尼5"]), (1, 7, "U", 1, ["q", "雷管方案17,5", ""]), (2, 1, "V", 1, ["only"]), (2, 1, "V", 2, None),
    ]
    texts = [(1, 2, "S", "标题5\n其他8\n其他3"), (1, 1, "R", "其他3\n范围1-3"), (3, 1, "E", None), (3, 2, "E", "")]
    got = marks.citation_marks(spark.createDataFrame(texts, "slide int, shape int, name string, text string"), spark.createDataFrame(rows, "slide int, shape int, name string, row int, cells array<string>"))
    got = {(r["slide"], r["mark"]): (r["kind"], r["shape"], r["row"], r["column"], r["context"]) for r in got.collect()}
    assert got == {
        (1, 5): ("table", 7, 1, "方案名称", "雷管方案17,5"), (1, 17): ("table", 7, 1, "方案名称", "雷管方案17,5"), (1, 2): ("table", 5, 1, "药物", "奥沙利铂+5‑FU+亚叶酸钙2"), (1, 8): ("table", 5, 2, "方案名称", "T+A方案8,9"), (1, 9): ("table", 5, 2, "方案名称", "T+A方案8,9"),
        (1, 15): ("table", 5, 3, "方案名称", "O+Y15,16"), (1, 16): ("table", 5, 3, "方案名称", "O+Y15,16"), (1, 3): ("text", 1, None, None, "其他3"), (1, 1): ("text_range", 1, None, None, "范围1-3"),
    }
    none = spark.createDataFrame([], "slide int, shape int, name string, text string")
    assert marks.citation_marks(none, spark.createDataFrame([], "slide int, shape int, name string, row int, cells array<string>")).count() == 0


def test_marks_of_a_slide_in_parts(spark):
    n, long = marks.SHAPES, marks.ROWS
    rows = [(1, i, "T", 1, ["r", f"甲{i % 7}", f"乙{i % 5 + 90}"]) for i in range(0, 3 * n, 97)] + [(1, 3 * n, "U", i, [None, f"丙{i % 3}"]) for i in range(1, 3 * long, long // 5)] + [(2, 1, "V", 1, ["9", "x", None])]
    texts = [(1, i, "S", f"a {i % 20}\n b {i % 24}") for i in range(1, 3 * n, 61)] + [(2, 5 * n, "S", "c 1-2"), (2, 2 * n, "R", "d 2"), (2, 2 * n, "Q", "d 2")]
    want = {}
    for slide, shape, name, row, cells in rows:
        for col in (1, 2):
            x = (cells[col : col + 1] or [None])[0]
            if x and x[1:]:
                at = ((0, -shape, row, col, name, x, " | ".join(c or "" for c in cells)), ("table", shape, name, row, dict(marks.COLUMNS)[col], x, " | ".join(c or "" for c in cells)))
                want[slide, int(x[1:])] = min(at, want.get((slide, int(x[1:])), at))
    for slide, shape, name, text in texts:
        for place, x in enumerate(text.split("\n")):
            for mark in (1, 2) if "-" in x else (int(x.split()[-1]),):
                at = ((1, shape, place, 0, name, x.strip(), ""), ("text_range" if "-" in x else "text", shape, name, None, None, x.strip(), None))
                want[slide, mark] = min(at, want.get((slide, mark), at), key=lambda v: v[0])
    got = marks.citation_marks(
        spark.createDataFrame(texts, "slide int, shape int, name string, text string").repartition(5), spark.createDataFrame(rows, "slide int, shape int, name string, row int, cells array<string>").repartition(7)
    )
    assert {(r["slide"], r["mark"]): tuple(r)[2:] for r in got.collect()} == {k: v[1] for k, v in want.items()}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by" not in plan and plan.count("RepartitionByExpression [slide") == 2  # strings go once; a mark's places meet before they are sorted
    assert "try_cast" not in plan and "Filter ((size(" not in plan and plan.count(marks.TERM_LINE) == 1  # marks are worked out once


def document(cells, texts):
    box = {"l": 1.0, "t": 2.0, "r": 3.0, "b": 4.0, "coord_origin": "TOPLEFT"}
    tables = [{"prov": [{"page_no": p, "bbox": box}], "data": {"table_cells": [{"text": t, "bbox": box, "start_row_offset_idx": r, "start_col_offset_idx": c} for t, r, c in rows]}} for p, rows in cells]
    return json.dumps({"tables": tables, "texts": [{"text": t, "prov": [{"page_no": p, "bbox": box}] if p else []} for p, t in texts], "other": 1})


def test_points(spark):
    docs = [
        ("a", document([(4, [("BCLC b 36.7%", 0, 0), ("36.70", 0, 1), ("136.75", 1, 0)])], [(4, "rate 36.7 and so on, a long text of a page"), (8, "rate 36.7 and so on, a long text"), (8, "RATE"), (None, "hbv")])),
        ("b", document([], [(1, "x")])), ("c", "no json"), ("d", None), ("e", document([(2, [])], [])),
    ]
    points = [("a", "36.7"), ("a", "36.7"), ("a", "BCLC B"), ("a", "rate"), ("a", "HBV"), ("a", "absent"), ("a", ""), ("a", None), ("b", "36.7"), ("z", "x"), ("b", "X")]
    got = placed.find_points(placed.places(spark.createDataFrame(docs, "doc string, json string")), spark.createDataFrame(points, "doc string, point string"))
    got = sorted(((r["doc"], r["point"], r["variant"], r["equivalent"], r["page"], r["kind"], r["row"], r["col"]) for r in got.collect()), key=repr)
    assert got == sorted(
        [
            ("a", "36.7", "36.7", False, 4, "table_cell", 0, 0), ("a", "36.7", "36.7", False, 4, "table_cell", 0, 1), ("a", "36.7", "36.7", False, 4, "table_cell", 1, 0), ("a", "36.7", "36.7", False, 4, "text", None, None), ("a", "36.7", "36.7", False, 8, "text", None, None),
            ("a", "BCLC B", "BCLC B", False, 4, "table_cell", 0, 0), ("a", "rate", "rate", False, 4, "text", None, None), ("a", "rate", "rate", False, 8, "text", None, None), ("a", "rate", "rate", False, 8, "text", None, None), ("a", "HBV", "HBV", False, None, "text", None, None), ("b", "X", "X", False, 1, "text", None, None),
        ],
        key=repr,
    )


def test_points_by_brute_force(spark):
    rng = random.Random(7)
    piece = lambda n: "".join(rng.choice("ab1 .5%") for _ in range(n))
    docs = [(f"d{k}", [(rng.randint(1, 3), piece(rng.randint(0, 40))) for _ in range(12)]) for k in range(8)]
    points = [(d, piece(rng.randint(1, 4)).strip() or "a") for d, _ in docs for _ in range(6)]
    frame = spark.createDataFrame([(d, document([], t)) for d, t in docs], "doc string, json string")
    got = placed.find_points(placed.places(frame), spark.createDataFrame(points, "doc string, point string"))
    got = {(r["doc"], r["point"], r["page"], r["text"][:30], r["variant"]) for r in got.collect()}
    from quillstone.functions.text import number_variants

    writings = {r["point"]: r["v"] for r in spark.createDataFrame(points, "doc string, point string").select("point", number_variants(F.col("point")).alias("v")).collect()}
    want = set()
    for d, p in points:
        seen = set()
        for w in writings[p]:
            for page, text in dict(docs)[d]:
                if w.lower() in text.lower() and (page, text[:30]) not in seen:
                    seen.add((page, text[:30]))
                    want.add((d, p, page, text[:30], w))
    assert got == want and len(want) > 50


def test_forbidden_wording(spark):
    cases = {
        "Smith J, M.D., Jones A, Ph.D.": "text_pattern=author_pattern_hits_2", "write to a.b@c.org": "text_pattern=email", "see [1] and [2], [3]": "text_pattern=bracket_refs_3", "text\nReferences \n": "text_pattern=references_header", "doi: 10.1/x 2020; 12": "text_pattern=doi_journal_format",
        "Funding was none": "text_pattern=declaration_^Funding", "N Engl J Med 344": "text_pattern=journal_header", "x\nDownloaded from ab.cd": "text_pattern=downloaded_from", "plain text": None, "": None, None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string").select("i", zones.forbidden_text(F.col("t"), F.lit("text")).alias("r"), zones.forbidden_text(F.col("t"), F.lit("header")).alias("h")).orderBy("i").collect()
    assert [r["r"] for r in df] == list(cases.values()) and {r["h"] for r in df} == {"sensenova_type=header"}


def test_forbidden_places(spark):
    boxes = [((0, 745, 9, 760, 1), "page_bottom_8%"), ((0, 1, 9, 30, 3), "page_top_5%"), ((0, 50, 9, 170, 0), "page0_top_22%"), ((0, 50, 9, 170, 1), None), ((0, 100, 500, 400, 1), "too_large_83%x38%"), ((0, 100, 9, 600, 1), "height_too_large_62%"), ((0, None, 9, 600, 1), None)]
    df = spark.createDataFrame([(i, *map(lambda v: None if v is None else float(v), b[:4]), b[4]) for i, (b, _) in enumerate(boxes)], "i int, x1 double, y1 double, x2 double, y2 double, p int")
    got = df.select("i", zones.forbidden_place(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "p")], F.lit(600.0), F.lit(800.0)).alias("r")).orderBy("i").collect()
    assert [r["r"] for r in got] == [r and "geometry=" + r for _, r in boxes]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps(spark, seed):
    rng = random.Random(seed)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, size = rng.randrange(-300, 900), rng.randrange(-300, 900), rng.choice([1, 5, 64, 64, 200, 3000])
            out.append((i % 3, i, float(x), float(y), float(x + rng.randrange(0, size + 1)), float(y + rng.randrange(0, size + 1))))
        return out

    a, b = boxes(150), boxes(150)
    a += [(0, 900, 0.0, 0.0, 64.0, 64.0), (0, 901, 5.0, 5.0, 5.0, 9.0), (0, 902, None, 0.0, 1.0, 1.0)]
    b += [(0, 900, 64.0, 0.0, 128.0, 64.0), (0, 901, 64.0, 64.0, 65.0, 65.0), (0, 902, 63.5, 63.5, 64.0, 64.0), (1, 902, 0.0, 0.0, 64.0, 64.0)]
    cols = "page int, n int, x1 double, y1 double, x2 double, y2 double"
    got = zones.overlaps(spark.createDataFrame(a, cols), spark.createDataFrame(b, cols), ("page",))
    got = sorted((r["page"], r["left_n"], r["right_n"]) for r in got.collect())
    whole = lambda x: None not in x and x[2] < x[4] and x[3] < x[5]
    want = sorted((x[0], x[1], y[1]) for x in a for y in b if whole(x) and whole(y) and x[0] == y[0] and x[2] < y[4] and y[2] < x[4] and x[3] < y[5] and y[3] < x[5])
    assert got == want and len(want) > 500
    assert zones.overlaps(spark.createDataFrame([], cols), spark.createDataFrame([], cols), ("page",)).count() == 0


def test_overlaps_plan(spark):
    """The join is on tiles, not on pages alone."""
    cols = "page int, n int, x1 double, y1 double, x2 double, y2 double"
    df = zones.overlaps(spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0)], cols), spark.createDataFrame([(0, 1, 0.0, 0.0, 1.0, 1.0)], cols), ("page",))
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = next(x for x in plan.splitlines() if "Join" in x)
    assert all(c in join for c in ("page#", "at#", "tx#", "ty#")) and "Cartesian" not in plan and "NestedLoop" not in plan


def test_violations(spark):
    rows = [(1, "title", 10.0, 20.0, 300.0, 40.0, 0), (2, "names", 10.0, 100.0, 300.0, 120.0, 0), (3, "作者", 10.0, 200.0, 300.0, 220.0, 0), (4, "names", 10.0, 200.0, 300.0, 220.0, 0), (5, None, 10.0, 760.0, 12.0, 770.0, 1), (6, "1.\n2)\n", 10.0, 300.0, 300.0, 320.0, 1), (7, "[1] [2] [3]", 0.0, 300.0, 590.0, 720.0, 1), (8, "Lee A, et al. Gut 2020; 3(1): 4-5", 10.0, 300.0, 300.0, 320.0, 3)]
    df = spark.createDataFrame(rows, "i int, t string, x1 double, y1 double, x2 double, y2 double, p int")
    v = zones.violations(*[F.col(c) for c in ("t", "x1", "y1", "x2", "y2", "p")], F.lit(4), F.lit(600.0), F.lit(800.0))
    got = {r["i"]: [x["violation"] for x in r["v"]] for r in df.select("i", v.alias("v")).collect()}
    assert got == {1: ["page0_top_8%_title"], 2: ["page0_top_15%_title_or_author"], 3: ["page0_top_30%_CN_author"], 4: [], 5: ["bottom_8%_footer", "too_narrow"], 6: ["author_text", "ref_text", "numbered_list_only"], 7: ["too_wide_and_tall", "too_tall", "ref_numbers_only"], 8: ["ref_text", "ref_section"]}
    tall = df.where("i = 2").select(zones.violations(*[F.col(c) for c in ("t", "x1", "y1", "x2", "y2", "p")], F.lit(4), F.lit(600.0), F.lit(1600.0)).alias("v")).first()
    assert tall["v"] == []


def test_zones(spark, monkeypatch):
    monkeypatch.setattr(zones, "STRETCH", 4)
    rng = random.Random(3)
    rows = [(d, i, rng.choice([None, None, None, f"m{i}"])) for d in range(4) for i in range(30) if d != 3] + [(3, 29, None), (4, 100, "late"), (4, 3, None)]
    got = {(r["doc"], r["i"]): r["zone"] for r in zones.zones(spark.createDataFrame(rows, "doc int, i int, m string"), "m").collect()}
    last, want = {}, {}
    for d, i, m in sorted(rows, key=lambda r: r[:2]):
        last[d] = m or last.get(d)
        want[d, i] = last[d]
    assert got == want


def test_zone_rules(spark):
    lines = {
        "The Patients were treated": "RULE_2_AUTHOR", "Lee: A trial, et al. of 2020; doi": "RULE_13_REFERENCE", "FUNDING: none": "RULE_12_STATEMENT", "Received: 5 May": "RULE_10_SUBMISSION", "© 2020; all": "RULE_11_HEADER_FOOTER", "see: Nature!": "RULE_4_PUBLISHER", "Methods:": "RULE_5_ABSTRACT_HEADER",
        "a large heading; in letters of size": "RULE_3_TITLE", "a: b": None, "": None,
    }
    df = spark.createDataFrame(list(enumerate(lines)), "i int, t string")
    size = F.when(F.col("i") == 7, 20.0).otherwise(9.0)
    got = df.select("i", zones.zone_of(F.col("t"), F.lit(200.0), F.lit(220.0), F.lit(800.0), size).alias("z")).orderBy("i").collect()
    assert [r["z"] for r in got] == list(lines.values())


def test_context_lines(spark):
    rng = random.Random(9)
    tables = [(p, t, float(rng.randrange(-500, 2000))) for p in range(3) for t in range(12)]
    texts = [(p, float(rng.randrange(-700, 2200)), f"l{k}") for p in range(3) for k in range(60)]
    got = context_lines(spark.createDataFrame(tables, "page int, table int, y double"), spark.createDataFrame(texts, "page int, y double, line string"))
    got = {(r["page"], r["table"]): r["lines"] for r in got.collect()}
    want = {}
    for p, t, y in tables:
        near = sorted((ly, line) for q, ly, line in texts if q == p and y - 200 <= ly <= y + 100)[:3]
        if near:
            want[p, t] = " / ".join(line for _, line in near)
    assert got == want


def test_only_what_points_ask_for_is_posted(spark):
    from quillstone.operators import placed

    text = F.concat_ws(" ", *[F.md5(F.concat(F.col("id").cast("string"), F.lit(str(i)))) for i in range(3)])
    spots = spark.range(500).select(F.lit(1).alias("doc"), F.struct(F.lit(1).alias("rank"), F.lit(0).alias("table"), F.col("id").cast("int").alias("i")).alias("place"), F.lit("text").alias("kind"), F.lit(None).cast("int").alias("table"), F.lit(1).alias("page"), F.lit(None).cast(placed.BOX).alias("box"), F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.when(F.col("id") == 77, "it is qqzzyy here").otherwise(text).alias("text"))
    df = placed.find_points(spots, spark.createDataFrame([(1, "QqZzyy")], "doc int, point string"))
    assert [(r["variant"], r["text"]) for r in df.collect()] == [("QqZzyy", "it is qqzzyy here")]
    todo, spread = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            if name == "GenerateExec":
                spread.append(p.metrics().get("numOutputRows").get().value())
            todo += [p.children().apply(i) for i in range(p.children().size())]
    assert spread and max(spread) < 5000  # of 45,000 n-grams
