"""op11 against brute force: fingerprints, links at the border of the distance, chains, hot cells and awkward rows."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from quillstone.llm import simhash
from quillstone.llm.common import Tables
from tests.llm.test_contracts import DOCS, docs, empty, rows, words  # noqa: F401


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    m = min(3, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + m]).encode(), seed=42) for i in range(len(w) - m + 1)] if m else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=3):
    label = {p: p for p in prints}

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    ps = sorted(label)
    for i, a in enumerate(ps):
        for b in ps[:i]:
            if (a ^ b).bit_count() <= distance:
                label[top(a)] = top(b)
    return {p: top(p) for p in ps}


def brute(rows):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    comp = brute_components({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[comp[p]] = min(i, least.get(comp[p], i))
    return sorted(((i, f"{p:016x}", least.get(comp[p])) for i, p in prints), key=repr)


def as_rows(df):
    return sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in df.collect()), key=repr)


def test_texts(spark, docs, rows, empty):  # noqa: F811
    assert as_rows(simhash.near_fingerprints(docs)) == brute(rows)
    assert as_rows(simhash.near_fingerprints(empty)) == []


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b c d", 5, 6, 7), (2, "a  B c\nd", 5, 6, 7), (3, None, None, None, None)], "doc_id long, text string, fp long, fingerprint long, component_id long")
    assert as_rows(simhash.near_fingerprints(d)) == brute([(1, "a b c d"), (2, "a b c d"), (3, None)])


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_pieces(size):
    rng = random.Random(size)
    for n in (0, 1, 2, 3, 50):
        text = " \n".join(words(rng, 1) for _ in range(n)) + " É\tX"
        assert simhash.fingerprint(memoryview(text.encode()), size) == brute_print(text)


def linked(spark, prints):
    points = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, 1) for p in sorted(prints)], "fp long, m long")
    return {r["fp"] % (1 << 64): r["comp"] for r in simhash.link_fingerprints(Tables(spark), points).collect()}


def same(spark, prints):
    got, want = linked(spark, prints), brute_components(prints)
    sizes = {}
    for p in prints:
        sizes.setdefault(want[p], set()).add(p)
    assert set(got) == {p for p in prints if len(sizes[want[p]]) > 1}
    assert len({(got[p], want[p]) for p in got}) == len({got[p] for p in got}) == len({want[p] for p in got})


def test_borders(spark):
    """Pairs at distances 1 to 5, both bits of a segment or one of each, and none else."""
    rng, prints = random.Random(5), set()
    for d in (1, 2, 3, 4, 5):
        for _ in range(60):
            p = rng.getrandbits(64)
            start = 2 * rng.randrange(29)
            bits = rng.sample(range(64), d) if rng.random() < 0.5 else range(start, start + d)
            prints |= {p, p ^ sum(1 << b for b in bits)}
    same(spark, prints)


def test_hot_cells(spark, monkeypatch):
    """Rings and clouds around one fingerprint, in lists of several blocks."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(6)
    prints = {0, (1 << 64) - 1}
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randint(4, 9))))
    chain = rng.getrandbits(64)
    for k in range(0, 60, 3):
        chain ^= 7 << k
        prints.add(chain)
    same(spark, prints)
