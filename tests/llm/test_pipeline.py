"""The corpus pipeline against brute-force versions of its stages."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from quillstone.llm import language

from .test_contracts import brute_components, brute_hits, words

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward_rows():
    """Texts under null and repeated ids, copies of them under other ids, equal rows, and texts without a word."""
    rng = random.Random(8)
    a, b, c, d, e = (words(rng, 80) for _ in range(5))
    near = "edited " + a.split(" ", 1)[1]
    out = [(5, a), (5, b), (3, b), (None, c), (None, d), (None, a), (7, d + " "), (5, near), (9, e), (9, e), (11, None), (11, ""), (None, None), (None, None), (12, " \n")]
    return [(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(out)]


def brute_first_rows(rows):
    """One row of each component, told apart by text: the least id, null last; all rows without a word."""
    alone = [r for r in rows if not (r[1] or "").split()]
    rest = [r for r in rows if (r[1] or "").split()]
    # brute_components names a component by ids: number the rows instead
    group = [c for _, _, c in brute_components([(k, r[1]) for k, r in enumerate(rest)])]
    kept = {}
    for g, r in zip(group, rest, strict=True):
        kept.setdefault(g, []).append(r)
    return alone, list(kept.values())


def test_near_dup_stage_decides_by_row(spark):
    rows = awkward_rows()
    got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    alone, groups = brute_first_rows(rows)
    assert len(groups) == 5 and len(got) == len(alone) + len(groups)
    left = list(got)
    for r in alone:
        left.remove(r)
    for g in groups:
        least = min((r[0] for r in g if r[0] is not None), default=None)
        mine = [r for r in left if r in g]
        assert len(mine) == 1 and mine[0][0] == least
        # of equal texts under one id, the least of the other columns
        assert mine[0] == min(r for r in g if r[:2] == mine[0][:2])
    more = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS _th", "2 AS _kept", "3 AS c").repartition(5)
    assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, more, "").collect()), key=repr) == sorted(got, key=repr)
    assert corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([], DOCS), "").count() == 0


def corpus():
    """Documents in two languages, with copies, passages of the benchmark, personal data, null texts and null or repeated ids."""
    rng = random.Random(12)
    text = lambda letters, n=60: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6))) for _ in range(n))
    item = text("abcdef", 30)
    rows = [(k, text("abcdef" if k % 2 else "uvwxyz")) for k in range(40)]
    rows += [(100, rows[0][1]), (None, rows[1][1]), (3, text("abcdef")), (3, text("abcdef")), (None, text("uvwxyz")), (None, text("uvwxyz"))]
    rows += [(50, text("abcdef", 20) + " " + item + " " + text("abcdef", 20)), (None, item), (51, text("abcdef") + " a.b@example.com"), (52, None), (None, None), (53, ""), (54, "12 34")]
    return [(i, t, "aa" if set("abcdef") & set(t or "") else "bb", f"s{k % 3}", len(t or ""), "mine", k) for k, (i, t) in enumerate(rows)], [(1, item)]


def folder(spark, path, rows, items):
    # columns beside those of documents, some with names that the stages use themselves
    spark.createDataFrame(rows, DOCS + ", hits string, _th long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = corpus()
    sf = folder(spark, tmp_path, rows, items)
    model = language.fit(spark.createDataFrame(rows, DOCS + ", hits string, _th long"))
    known = []
    for r in rows:
        t = (r[1] or "").encode()
        lang, _, close = model.predict(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        if lang[0] != language.UNKNOWN and not close[0]:
            known.append(r[:5])
    assert len(known) >= 45
    alone, groups = brute_first_rows(known)
    first = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups]
    clean = [r for r in alone + first if not brute_hits(r[1], items)[1]]
    assert len(known) - len(clean) > 3 and sum(r[0] is None for r in clean) == 2 and sum(r[0] == 3 for r in clean) == 3
    out = corpus_pipeline.run(spark, sf).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in out), key=repr) == sorted(((r[0], len(r[1].split())) for r in clean), key=repr)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in out)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [], [(1, "a b c")])).collect() == []
