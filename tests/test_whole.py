"""Queries without SQL against brute force: every row of the tables takes part."""

from __future__ import annotations

import random

import __spark_entry__ as entry

QUERIES = entry.queries()


def test_numbered_segments_of_all_pages(spark, tmp_path):
    keys = [*range(1, 481), *range(4000, 4240)]
    spark.createDataFrame([(k, 1.0, "1") for k in keys], "o_orderkey long, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    from quillstone.sources.views import view

    lines = {r["k"]: r["line"] for r in view(spark, str(tmp_path), "cite_lines_v").collect()}
    want = {}
    for k in keys:
        if lines[k][0].isdigit():
            n, chars = want.get((k % 40, k // 4000), (0, 0))
            want[k % 40, k // 4000] = n + 1, chars + len(lines[k].replace("  ", " ").strip())
    got = {(r["page"], r["part"]): (r["n"], r["chars"]) for r in QUERIES["numbered_segments"](spark, str(tmp_path)).collect()}
    assert {page for page, _ in got} == set(range(40))
    assert got == want


def test_nearest_pairs_of_all_orders(spark, tmp_path):
    rng = random.Random(3)
    rows = [(o, n, float(rng.randint(1, 12)), round(rng.uniform(1, 99), 2)) for o in range(1, 60) for n in range(1, rng.randint(2, 8))]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = []
    for page in range(1, 60):
        names = sorted((q, f"n{n}") for o, n, q, _ in rows if o == page and n % 2)
        free = sorted((q, v) for o, n, q, v in rows if o == page and n % 2 == 0)
        for y, name in names:
            near = [(abs(q - y), i) for i, (q, _) in enumerate(free) if abs(q - y) < 3]
            if near:
                d, i = min(near)
                want.append((page, name, free[i][1], d))
                free[i] = (float("inf"), 0.0)
    got = [(r["page"], r["name"], r["value"], r["dist"]) for r in QUERIES["nearest_pairs"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want)
    assert {p % 4 for p, *_ in got} == {0, 1, 2, 3}


def test_rules_and_grades_read_whole_texts(spark, tmp_path):
    """Wording past the first hundreds of characters counts."""
    far = "plain words " * 60
    spark.createDataFrame([(1, 1, "user", far + "保证治愈"), (1, 2, "user", far), (3, 4, "user", far + "请咨询医生"), (6, 1, "user", far)], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(k, far + ("randomized" if k < 3 else "plain"), "en", "web", len(far)) for k in (1, 2, 3, 4)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: QUERIES[name](spark, str(tmp_path)).collect()
    assert ("ADV-16-CURE", "保证治愈") in {(r["rule"], r["matched"]) for r in run("rule_scan") if (r["conv_id"], r["turn"]) == (1, 1)}
    assert {r["conv_id"]: r["verdict"] for r in run("rule_verdicts")}[1] == "fail"
    assert any("ADV-16-CURE[fatal]" in r["note"] for r in run("rule_notes") if (r["conv_id"], r["turn"]) == (1, 1))
    assert {r["conv_id"] for r in run("presence_rules")} == {6}
    assert sum(r["n_trials"] for r in run("trial_flags")) == 2
    assert {r["kind"]: r["n"] for r in run("ref_types")}["RCT 试验"] == 2
    ratio = {r["conv_id"]: r["rct_ratio"] for r in run("fuse_citations")}
    assert ratio[2] == 1 and ratio[3] == 0


def test_nearest_of_uneven_vectors(spark):
    from quillstone.operators import similarity

    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [-1.0, 0.0])], "id long, vec array<double>").coalesce(1)
    queries = spark.createDataFrame([(9, [2.0, 0.0])], "query long, vec array<double>")
    got = {m: [(r["id"], r["score"]) for r in similarity.nearest(items, queries, 4, m).orderBy("rank").collect()] for m in ("cosine", "euclid")}
    assert got == {"cosine": [(1, 1.0), (2, 0.0), (3, 0.0), (4, -1.0)], "euclid": [(1, -1.0), (4, -3.0)]}
