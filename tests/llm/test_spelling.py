"""op12 against brute force: counts, automata, near words, forms and roots."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from quillstone.llm import spelling
from quillstone.llm.common import Tables
from tests.llm.test_contracts import DOCS, docs, empty, rows  # noqa: F401


def brute_counts(rows):
    total = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    out = {}
    for w, n in counts.items():
        near = sorted((-m, v) for v, m in counts.items() if one_edit(w, v))
        form = near[0] if near and -near[0][0] >= 5 * n else None
        out[w] = [w, n, len(near), form and form[1], form and -form[0], w]
    for row in out.values():
        while out[row[5]][3]:
            row[5] = out[row[5]][3]
    return sorted(map(tuple, out.values()), key=repr)


def as_rows(df):
    return sorted((tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in df.collect()), key=repr)


def noisy(rng, letters="abcdé", most=9):
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, most))) for _ in range(25)]
    out = Counter()
    for w in base:
        out[w] = rng.choice([5, 9, 30, 160, 800])
        for _ in range(6):
            v, i = w, rng.randrange(len(w))
            v = rng.choice([v[:i] + v[i + 1 :], v[:i] + rng.choice(letters) + v[i:], v[:i] + rng.choice(letters) + v[i + 1 :]])
            if len(v) >= 6:
                out[v] += rng.choice([5, 6, 25, 150])
    return dict(out)


@pytest.mark.parametrize("seed", range(20))
def test_automaton(seed):
    rng = random.Random(seed)
    words = sorted(noisy(rng, "ab" if seed % 2 else "abcdé"))
    a = spelling.Automaton(words)
    assert a.count[0] == len(words) and len(a.edges) <= sum(map(len, words)) + 1
    for w in words:
        for half in (0, len(w) // 2, (len(w) - 1) // 2):
            assert {words[i] for i in a.near(w, half)} == {v for v in words if one_edit(w, v) and v[:half] == w[:half] and any(v[half:][:k] == w[half:][:k] for k in range(len(w) + 1))}
    # minimal: no two states have the same future
    futures = Counter((a.final[s], tuple((c, t) for c, (t, _) in a.edges[s].items())) for s in reachable(a))
    assert max(futures.values()) == 1


def reachable(a):
    seen, todo = {0}, [0]
    while todo:
        for to, _ in a.edges[todo.pop()].values():
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return seen


@pytest.mark.parametrize("block", [1 << 15, 40, 3])
def test_near_words(spark, monkeypatch, block):
    monkeypatch.setattr(spelling, "BLOCK", block)
    monkeypatch.setattr(spelling, "SEARCHES", 7)
    counts = noisy(random.Random(block), "abc", 8)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    # the limits are read in the driver and in the workers: small groups in one, small blocks in the other
    got = sorted((r["word"], r["near"], r["near_n"]) for r in spelling.near_words(Tables(spark), words).collect())
    assert got == sorted((w, v, counts[v]) for w in counts for v in counts if one_edit(w, v))


def test_blocks():
    """The search of postings in blocks of any size gives what one automaton gives."""
    import pyarrow as pa

    counts = noisy(random.Random(1), "abc", 8)
    posted = sorted((False, w[: len(w) // 2], 0, w, n, True) for w, n in counts.items())
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*posted, strict=True)], names=list("abcdef"))
    want = {(w, v) for w in counts for v in counts if one_edit(w, v) and w[: len(w) // 2] == v[: len(w) // 2] == v[: len(v) // 2]}
    for limit in (1, 5, 1000):
        spelling.BLOCK, old = limit, spelling.BLOCK
        try:
            found = {(a, b) for out in spelling._search(iter([batch])) for a, b in zip(*(c.to_pylist() for c in out.columns[:2]), strict=True)}
        finally:
            spelling.BLOCK = old
        assert want <= found and all(one_edit(a, b) for a, b in found)


def texts(seed):
    rng = random.Random(seed)
    counts = noisy(rng) | {"chainaa": 6, "chainab": 45, "chainbb": 300, "chaincb": 300}
    bag = [w.upper() if rng.random() < 0.2 else w for w, n in counts.items() for _ in range(n)]
    rng.shuffle(bag)
    cuts = sorted(rng.sample(range(len(bag)), 60))
    return [(i if i % 7 else None, rng.choice([" ", ", ", "\n", "1"]).join(bag[a:b])) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(bag)], strict=True))]


def test_whole(spark):
    data = texts(4) + [(500, None), (501, ""), (502, "ÀÉÿ×÷ÀÉÿ " * 6 + "Ğabcdefğ x1abcdef2"), (502, "ÀÉÿ×÷ÀÉÿ " * 6)]
    d = spark.createDataFrame([(*r, 1, 2, 3) for r in data], "doc_id long, text string, word long, n long, form long")
    want = brute(brute_counts(data))
    assert any(r[3] for r in want) and any(r[5] != r[3] and r[3] for r in want) and ("àÉÿ×÷àÉÿ" not in {r[0] for r in want})
    assert as_rows(spelling.variants(d)) == want


def test_contract_rows(spark, docs, rows, empty):  # noqa: F811
    assert as_rows(spelling.variants(docs)) == brute(brute_counts(rows))
    assert as_rows(spelling.variants(empty)) == []


@pytest.mark.parametrize("size", [1, 5, 1 << 20])
def test_pieces(size):
    text = "Ärger, straße|Überfluß 12 naïve-e Ünï× Ābc ﬁrst 中abcd中 " * 3
    want = Counter("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r).encode() for r in re.findall("[A-Za-zÀ-ÿ]+", text))
    assert spelling.runs_of(memoryview(text.encode()), size) == want


def test_long_words(spark):
    """Runs of a hundred thousand letters are words like others."""
    a, b = "ab" * 50_000, "ab" * 30_000 + "aab" + "ab" * 19_999
    c = "z" * 100_000
    data = [(i, f"{a} {c} {c[1:]}") for i in range(30)] + [(100 + i, b) for i in range(5)]
    got = {(r["word"], r["n"]): r for r in spelling.variants(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    counts = brute_counts(data)
    assert set(got) == set(counts.items())
    assert got[b, counts[b]]["form"] == a if counts[a] >= 5 * counts[b] else True
    assert got[c, counts[c]]["n_near"] >= 1
