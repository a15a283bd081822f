"""A text's language does not depend on the rows beside it."""

from __future__ import annotations

import random

import numpy as np

from quillstone.llm import language

from .test_contracts import words


def test_answers_do_not_depend_on_neighbours():
    rng = random.Random(9)
    model = language.train([words(rng, 30).encode() for _ in range(60)], [f"l{i % 3}" for i in range(60)])
    texts = [w.encode() for w in ("a", "", "ab", "é", "abc", "zzz", words(rng, 50), "", "b", "")]
    data, ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    together = model.margins(data, ends)
    for i, t in enumerate(texts):
        alone = model.margins(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert np.array_equal(together[i], alone[0])
        # and they are those of the features of training
        x = sum((model.table[g].sum(0, dtype=np.float64) for g in language.grams(np.frombuffer(t, np.uint8))), np.zeros(len(model.bias)))
        assert np.allclose(together[i], x / max(len(t), 1) + model.bias, atol=1e-5)
