"""Words that a polynomial hash modulo a power of two takes for one another."""

from __future__ import annotations

import pytest

from quillstone.llm import neardup


def thue_morse(n, a, b):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("size", [256, 1024, 4096, 65536])
def test_words_of_one_polynomial_hash_stay_apart(spark, size):
    one, two = thue_morse(size, "a", "b"), thue_morse(size, "b", "a")
    rows = [(1, one), (2, two), (3, f"w x y {one} z v"), (4, f"w x y {two} z v"), (5, one.upper()), (6, f"w x  y\n{one} z v")]
    got = {r["doc_id"]: (r["component_id"], r["n_shingles"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (2, 1), 3: (3, 2), 4: (4, 2), 5: (1, 1), 6: (3, 2)}
