"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit, a linear classifier
over hashed byte n-grams predicts on which side a text lies. Decoding adds up,
for each language, the logistic loss of its codeword against the predicted
margins, each bit weighted by how well it did in training; the language of least
loss wins, the score is the softmax over negative losses, and texts whose two
best languages are too close are flagged as ambiguous.

Training uses a sample of at most ``TRAIN_ROWS`` labelled rows, shared among the
languages, and the whole text of each; predictions use every byte of every text.
A language's sample ends earlier where its texts would take more than its share
of ``TRAIN_BYTES``.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without labelled rows all texts are ``und``; with one language all texts with a
letter get it, with score 1; equal losses go to the language first by code
point; rows without an id are not held out and train nothing; repeated rows stay
repeated; an empty table gives an empty table; extra columns travel along where
asked for.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, load, mix64, row_slices, text_buffers, whole_texts

TRAIN_ROWS = 4000
TRAIN_BYTES = 32 << 20  #: that all sampled texts may take on the driver
GRAMS = (1, 2, 3)  #: bytes of an n-gram
BITS = 12  #: log2 of the number of hashed n-gram features
MARGIN = 0.02  #: relative difference of the two least losses below which a text is ambiguous
UNKNOWN = "und"

#: ASCII letters fall to lower case, other ASCII bytes to a space; bytes of other characters stay.
FOLD = np.full(256, 32, np.uint8)
FOLD[128:] = np.arange(128, 256)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)


def codewords(n: int, seed: int = 3) -> np.ndarray:
    """n codewords as rows of +1 and -1: all splits for few languages, else the random matrix of the greatest least distance out of 200."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        tails = np.array(list(product((1, -1), repeat=n - 1)), np.int8)
        tails = tails[(tails == -1).any(1)]
        return np.concatenate([np.ones((len(tails), 1), np.int8), tails], 1).T
    rng, length, best, least = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n))), None, -1
    for _ in range(200):
        m = rng.choice(np.array([1, -1], np.int8), (n, length))
        apart = (length - m.astype(int) @ m.T.astype(int)) // 2
        d = apart[~np.eye(n, dtype=bool)].min()
        if d > least and (np.abs(m.sum(0)) < n).all():
            best, least = m, d
    return best


def grams(data: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of the n-grams that begin at each byte, for each length; those past the end repeat what is there."""
    x = FOLD[data].astype(np.uint64)
    out, key = [], np.zeros(len(x), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        key = (key << np.uint64(8)) | np.concatenate([x[n - 1 :], np.full(min(n - 1, len(x)), 32, np.uint64)])
        if n in GRAMS:
            out.append((mix64(key + np.uint64(n << 40)) >> np.uint64(64 - BITS)).astype(np.int32))
    return out


def has_letter(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122) & (data < 128)
    some = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = some[ends[1:]] > some[ends[:-1]]
    for i in np.flatnonzero(~out & (np.diff(ends) > 0)):
        out[i] = any(c.isalpha() for c in data[ends[i] : ends[i + 1]].tobytes().decode(errors="replace"))
    return out


class Model:
    def __init__(self, langs: list[str], table: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.langs, self.codes = langs, codewords(len(langs)).astype(np.float64)
        self.table, self.bias, self.trust = table.astype(np.float32), bias, trust

    def margins(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Signed margins of each text (rows) for each bit."""
        out = np.zeros((len(ends) - 1, len(self.bias)))
        size = np.diff(ends)
        some = np.flatnonzero(size)
        if len(some):
            # spaces after each text, as in training: no n-gram reaches into the next one
            gap = max(GRAMS) - 1
            first = ends[:-1] + gap * np.arange(len(size))
            padded = np.full(len(data) + gap * len(size), 32, np.uint8)
            padded[np.arange(len(data)) + gap * np.repeat(np.arange(len(size)), size)] = data
            total = np.zeros((len(padded), len(self.bias)), np.float32)
            for g in grams(padded):
                total += self.table[g]
            bounds = np.stack([first[some], first[some] + size[some]], 1).reshape(-1)
            out[some] = np.add.reduceat(total, bounds, axis=0, dtype=np.float64)[::2] / size[some, None]
        return out + self.bias

    def predict(self, data: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, score, ambiguous) of each of the texts laid end to end."""
        n = len(ends) - 1
        letters = has_letter(data, ends)
        if not self.langs:
            return [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
        loss = np.logaddexp(0, -self.margins(data, ends)[:, None, :] * self.codes[None]) @ self.trust
        best = loss.argmin(1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        score = np.where(letters, 1 / p.sum(1), 0.0)
        close = np.zeros(n, bool)
        if len(self.langs) > 1:
            two = np.partition(loss, 1, axis=1)
            close = (two[:, 1] - two[:, 0]) < MARGIN * np.maximum(two[:, 1], 1e-9)
        return [self.langs[b] if ok else UNKNOWN for b, ok in zip(best, letters, strict=True)], score, close & letters


def train(texts: list[bytes], langs: list[str], rounds: int = 150, rate: float = 0.5, decay: float = 1e-6) -> Model:
    """Logistic regression for every bit, all bits at once (Adam, full batch), classes weighted alike."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 1)), np.zeros(1), np.ones(1))
    y = np.array([names.index(x) for x in langs])
    codes = codewords(len(names)).astype(np.float32)
    x = np.zeros((len(texts), 1 << BITS), np.float32)
    for i, t in enumerate(texts):
        if t:
            for g in grams(np.frombuffer(t, np.uint8)):
                x[i] += np.bincount(g, minlength=1 << BITS)
            x[i] /= len(t)
    want = codes[y]
    weight = (1 / np.bincount(y)[y] / len(names)).astype(np.float32)[:, None]
    table, bias = np.zeros((1 << BITS, codes.shape[1]), np.float32), np.zeros(codes.shape[1], np.float32)
    state = [np.zeros_like(table), np.zeros_like(table), np.zeros_like(bias), np.zeros_like(bias)]
    for t in range(1, rounds + 1):
        z = x @ table + bias
        d = -want / (1 + np.exp(np.clip(want * z, -40, 40))) * weight
        for p, g, a, b in ((table, x.T @ d + decay * table, 0, 1), (bias, d.sum(0), 2, 3)):
            state[a] += 0.1 * (g - state[a])
            state[b] += 0.01 * (g * g - state[b])
            p -= rate * (state[a] / (1 - 0.9**t)) / (np.sqrt(state[b] / (1 - 0.99**t)) + 1e-8)
    right = ((x @ table + bias) * want > 0).mean(0)
    trust = np.clip(right, 0.01, 0.999)
    return Model(names, table, bias.astype(np.float64), trust / trust.sum() * len(trust) ** 0.5)


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS) -> Model:
    """A model of the languages named in rows whose crc32(id as text) mod 4 is not 2."""
    known = df.select(F.col(id_col).alias("_id"), F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).cast("string").alias("_text")).where(F.col("_lang").isNotNull() & (crc_mod("_id", 4) != 2))
    counts = {r[0]: r[1] for r in known.groupBy("_lang").count().collect()}  # a row for each language
    if not counts:
        return train([], [])
    each = max(1, train_rows // len(counts))
    draw = F.pmod(F.xxhash64(F.lit("language"), "_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, 1.3 * each / n))])
    chosen = known.where(draw < F.element_at(share, F.col("_lang"))).select(F.col("_lang").alias("key"), F.xxhash64("_id", "_text").alias("h"), F.col("_text").cast("binary").alias("text"))
    kept = whole_texts(chosen, each, TRAIN_BYTES // len(counts), 2 * train_rows)  # about 1.3 * train_rows rows looked at
    return train([t for v in kept.values() for t in v], [k for k, v in kept.items() for _ in v])


ANSWER = "lang_pred string, score double, ambiguous boolean"


def identify(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``df`` with lang_pred, score and ambiguous; columns of these names are replaced. Only the text goes to Python, only the answer comes back."""

    bound_batches(df.sparkSession)

    @F.arrow_udf(ANSWER)
    def predict(texts: pa.Array) -> pa.Array:
        data, ends = text_buffers(texts)
        langs, scores, close = [], [np.zeros(0)], [np.zeros(0, bool)]
        for lo, hi in row_slices(ends):
            lang, score, near = model.predict(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            langs += lang
            scores.append(score)
            close.append(near)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores)), pa.array(np.concatenate(close))], ["lang_pred", "score", "ambiguous"])

    given = [c for c in df.columns if c not in ("lang_pred", "score", "ambiguous")]
    return df.select(*[F.col(f"`{c}`") for c in given], predict(F.col(text_col).cast("string")).alias("_language")).select(*[F.col(f"`{c}`") for c in given], "_language.*")


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    x = identify(docs.select("doc_id", "text"), fit(docs))
    return x.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "ambiguous")


QUERIES = {"op6_language": op6_language}
ORACLES: dict[str, str] = {}
