"""op13 against brute force: whole texts encoded at once, all overlaps by comparison, counts over all texts."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from quillstone.llm import alignment
from tests.llm.test_contracts import DOCS, docs, empty, rows  # noqa: F401

T = alignment.Tokenizers(f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def intervals(ids, data):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at := at + len(data[i])))
    return out


def brute_text(text):
    ids = T.encode(text) if text else None
    if not ids:
        return None
    a, b = intervals(ids[0], T.a_bytes), intervals(ids[1], T.b_bytes)
    links = [(x, y) for x, s, e in a for y, t, f in b if s < f and t < e]
    cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
    groups = [(",".join(str(x) for x, s, e in a if lo <= s and e <= hi), ",".join(str(y) for y, s, e in b if lo <= s and e <= hi)) for lo, hi in zip([0, *cuts], cuts, strict=False)]
    return len(a), len(b), links, ";".join("|".join(g) for g in groups), len(groups)


def brute(rows):
    texts = [(r[0], brute_text(r[1])) for r in rows]
    count = Counter(p for _, t in texts if t for p in t[2])
    most = {}
    for (_, b), n in count.items():
        most[b] = max(n, most.get(b, 0))
    out = []
    for i, t in texts:
        if not t:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        out.append((i, t[0], t[1], t[4], len(t[2]), sum(count[p] == most[p[1]] for p in t[2]), sum(count[p] for p in t[2]), hashlib.sha256(t[3].encode()).hexdigest()))
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


ODD = [
    "<|endoftext|> and <s> </s> <unk> <0x41> <pad>", " ", "  ", "\n", "a  b", " a", "a ", "a b ", "\n\na b\n", "don't we'll  it's", "naïve café 中文字符 日本語 한국어", "▁", "foo▁bar baz", "foo ▁ bar",
    "tab\tand nbsp em ​ zero", "12345 6789 3.14", "😀😃 🇩🇪 é", "x" * 300, "\x00nul \x1c fs \x85 nel", "a\r\nb c", "... --- !!! ?", "  leading   inner  trailing   ", "ﬁ ligature ™ ½", "'s 't 're", "<0x0A>\n<0x0A>",
]


def test_whole_texts(spark):
    rng = random.Random(13)
    pool = [w for t in ODD for w in t.split(" ")] + ["the", "of", "Über", "ouêaux"]
    data = list(enumerate(ODD + [rng.choice(["", " "]).join(rng.choice(pool) + rng.choice([" ", " ", "  ", "\n"]) for _ in range(60)) for _ in range(30)]))
    d = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, pair long, n_a long")
    want = brute(data)
    assert sum(r[1] == 0 for r in want) < len(want) / 2
    assert as_rows(alignment.align(d)) == want


def test_contract_rows(spark, docs, rows, empty):  # noqa: F811
    want = brute(rows)
    assert as_rows(alignment.align(docs)) == want
    assert as_rows(alignment.align(empty)) == []


def test_rare_pairs(spark, docs, rows, monkeypatch):  # noqa: F811
    monkeypatch.setattr(alignment, "HEAVY", 20)
    assert as_rows(alignment.align(docs.repartition(3))) == brute(rows)


@pytest.mark.parametrize(("size", "kept", "row"), [(1, 3, 2), (20, 10, 5), (1 << 20, 1 << 20, 1 << 16)])
def test_pieces(monkeypatch, size, kept, row):
    monkeypatch.setattr(alignment, "PIECE", size)
    monkeypatch.setattr(alignment, "KEPT", kept)
    known = alignment.Segments(T)
    for text in [*ODD, " ".join(ODD[:5]), "one two  three\nfour one two five six " * 9]:
        got, want = alignment._align_text(known, memoryview(text.encode())), brute_text(text)
        assert got.whole == bool(want)
        if want:
            assert (*got.numbers, got.hash.hexdigest()) == (want[0], want[1], want[4], len(want[2]), hashlib.sha256(want[3].encode()).hexdigest())
            assert dict(zip(got.pairs.tolist(), got.times.tolist(), strict=True)) == Counter(a << 32 | b for a, b in want[2])


def test_segments_are_cut():
    assert T.parts


def test_long_text_rows(spark, monkeypatch):
    """A text with more distinct pairs than a row of the first pass holds."""
    import pyarrow as pa

    monkeypatch.setattr(alignment, "ROW", 10)
    text = " ".join(f"w{i} Wort{i}" for i in range(300))
    batch = pa.RecordBatch.from_arrays([pa.array([7, 8, None]), pa.array([0, 1, 2]), pa.array([text, None, "a b"])], names=["id", "row", "text"])
    from pyspark.sql.types import LongType

    out = pa.Table.from_batches(alignment._align(iter([batch]), f"{alignment.FOLDER}/{alignment.A_FILE}", f"{alignment.FOLDER}/{alignment.B_FILE}", alignment._first_schema(LongType()))).to_pylist()
    want = brute_text(text)
    mine = [r for r in out if r["row"] == 0]
    assert len(mine) > 10 and [r["n_a"] for r in mine] == [want[0]] + [None] * (len(mine) - 1) and {r["id"] for r in mine} == {7}
    assert Counter({x["pair"]: x["times"] for r in mine for x in r["links"]}) == Counter(a << 32 | b for a, b in want[2])
    assert [(r["id"], r["n_links"], r["links"]) for r in out if r["row"] == 1] == [(8, 0, [])]
