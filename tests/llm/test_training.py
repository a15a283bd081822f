"""What the fits learn from: whole texts."""

from __future__ import annotations

import random
import zlib

from quillstone.llm import common, language, quality

from .test_contracts import words


def test_quality_learns_from_junk_far_into_a_text(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, 260) + (" " + "qzx#qzx#" * 40 if i % 2 else " " + words(rng, 80))) for i in range(240)]
    assert min(len(t.encode()[:-420]) for _, t in rows) > 1024
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2) for i, _ in rows], "doc_id long, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(d, quality.fit(d, labels)).collect()}
    held = [i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] >= 0.5) == (i % 2 == 0) for i in held) / len(held) > 0.9


def test_language_learns_from_what_comes_after_a_shared_head(spark):
    rng = random.Random(4)
    head = "0123 - " * 300
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(60))
    rows = [(i, head + make("abcde" if i % 2 else "fghij"), "aa" if i % 2 else "bb") for i in range(80)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(d, language.fit(d)).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


def test_whole_texts_are_bounded_by_rows_not_by_prefixes(spark):
    rows = spark.createDataFrame([("a", h, bytearray(b"x" * (10 + h))) for h in range(9)] + [("b", 3, bytearray(b"y" * 500)), ("b", 4, None)], "key string, h long, text binary")
    assert {k: [len(t) for t in v] for k, v in common.whole_texts(rows, 4, 1000, 100).items()} == {"a": [10, 11, 12, 13], "b": [500, 0]}
    assert {k: [len(t) for t in v] for k, v in common.whole_texts(rows, 9, 40, 100).items()} == {"a": [10, 11, 12], "b": [500]}
    assert common.whole_texts(rows.limit(0), 4, 1000, 100) == {}
