"""Benchmark texts of some size: what the tables take, and repeated windows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from quillstone.llm import decontaminate as d


def size_of(tables: d.Tables) -> int:
    words = {id(p.words): p.words for p in tables.patterns}.values()
    arrays = [x for o in (*tables.patterns, *words) for x in vars(o).values() if isinstance(x, np.ndarray)]
    return sum(x.nbytes for x in arrays)


def test_tables_take_a_small_multiple_of_their_text():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    tests = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 400))) for _ in range(1500)]
    text = sum(map(len, tests))
    assert text > 1_000_000
    tables = d.compile_patterns(pa.table({"item": [str(i) for i in range(len(tests))], "test": tests}))
    assert size_of(tables) < 16 * text


def test_repeated_windows_and_ties():
    """A window that items repeat, within one or between several, hits once and names each item once; bytes decide, not separators."""
    w = " ".join(f"w{i}" for i in range(10))
    tables = d.compile_patterns(pa.table({"item": ["a", "b", None, "c", "d"], "test": [f"{w} {w} {w}", w.replace(" ", ", "), w, "w1 w2", None]}))
    texts = [f"X {w.upper()} x", "w1-w2", "w1w2", "", w + " " + w]
    data, ends = np.frombuffer("".join(texts).encode(), np.uint8), np.cumsum([0, *map(len, texts)])
    n, hit, first, items = d.search(tables, data, ends)
    assert n.tolist() == [12, 2, 1, 0, 20]
    assert [int(hit[first[i] : first[i + 1]].sum()) for i in range(5)] == [10, 2, 0, 0, 20]
    assert {k: sorted(v) for k, v in items.items()} == {0: ["a", "b", "c"], 1: ["c"], 4: ["a", "b", "c"]}


def test_empty_benchmark():
    tables = d.compile_patterns(pa.table({"item": pa.array([], pa.string()), "test": pa.array([], pa.string())}))
    assert tables.patterns == [] and d.search(tables, np.frombuffer(b"a b", np.uint8), np.array([0, 3]))[0].tolist() == [2]
