"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Test strings are the windows of ``WINDOW`` consecutive words of every benchmark
item (an item of fewer words is one shorter window). For each window length m
there is a shift table over blocks of two words: how far a window that ends in
that block may move before any test string could end there. Texts are scanned
at the places that the shifts leave; where the shift is 0, the bucket of the
suffix block's hash selects the test strings, and a comparison of the words
themselves confirms the occurrence.

Many texts are scanned at once: each is cut into lanes of window ends, and one
numpy step moves all lanes on by their shifts.

The test strings travel to the executors with the task, as arrays of about ten times
the size of their text. They come in groups of at most about ``GROUP_BYTES`` of
benchmark text (an item longer than that is a group with others of its hash); beyond
one group, the groups are searched one after the other, each adding to the hits found
so far.

Defined cases: null and wordless texts have no words and no hits; items without
words have no windows; equal windows of several items count for each item; a
word inside several occurrences is hit once; repeated rows stay repeated; an
empty table gives an empty table, an empty benchmark no hits; null item ids are
left out of the lists of items, though their windows still hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PrefixHash, cut, load, map_batches, mix64, row_slices, text_buffers

WINDOW = 10  #: words of a test string
GROUP_BYTES = 4 << 20  #: benchmark text whose test strings are searched, and sent to executors, at once
PAIRS = 1 << 20  #: of a window and a test string of its bucket, looked at at once
LANE = 512  #: window ends that one lane scans

#: Upper-case ASCII letters fall to lower case; digits, letters and all bytes of non-ASCII characters make words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True


def words_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, word starts, word ends, first word of each text) of texts laid end to end."""
    low = LOWER[data]
    mask = IN_WORD[low]
    edge = np.zeros(len(mask) + 1, bool)
    edge[1:-1] = mask[1:] != mask[:-1]
    if len(mask):
        edge[0], edge[-1] = mask[0], mask[-1]
        inner = ends[1:-1]
        inner = inner[(inner > 0) & (inner < len(mask))]
        split = np.unique(inner[mask[inner] & mask[inner - 1]])  # a word ends where its text ends
    else:
        split = np.zeros(0, np.int64)
    at = np.flatnonzero(edge)
    if len(split):
        at = np.sort(np.concatenate([at, split, split]))
    starts, stops = at[::2], at[1::2]
    return low, starts, stops, np.searchsorted(starts, ends)


def _window_keys(h: np.ndarray, m: int, ends: np.ndarray) -> np.ndarray:
    key = np.zeros(len(ends), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(m):
            key = key * np.uint64(0x9E3779B97F4A7C15) + h[ends - m + 1 + j]
    return mix64(key)


def _block_keys(h: np.ndarray, size: int, ends: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(h[ends] if size == 1 else h[ends - 1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[ends])


def _bytes_at(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of all bytes of the words that begin at ``starts``."""
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


class Words:
    """Lower-cased texts with the places and hashes of their words."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.low, a, b, self.first = words_of(data, ends)
        small = np.int32 if len(data) < 1 << 31 else np.int64
        self.at, self.size = a.astype(small), (b - a).astype(small)
        self.h = PrefixHash(self.low).at(a, b)

    def same(self, mine: np.ndarray, other: Words, theirs: np.ndarray, m: int) -> np.ndarray:
        """Whether the ``m`` words that end with word ``mine`` are those of ``other`` that end with ``theirs``, byte by byte."""
        good = np.ones(len(mine), bool)
        for j in range(m):
            k = np.flatnonzero(good)
            x, y = mine[k] - j, theirs[k] - j
            even = self.size[x] == other.size[y]
            good[k[~even]] = False
            k, x, y = k[even], x[even], y[even]
            sizes = self.size[x].astype(np.int64)
            if len(k):
                equal = self.low[_bytes_at(self.at[x].astype(np.int64), sizes)] == other.low[_bytes_at(other.at[y].astype(np.int64), sizes)]
                good[k] = np.logical_and.reduceat(equal, np.cumsum(sizes) - sizes)
        return good


class Patterns:
    """Test strings of one length: shift table, suffix buckets, last words and items' numbers."""

    def __init__(self, m: int, words: Words, last: np.ndarray, item: np.ndarray):
        self.m, self.block, self.words = m, min(2, m), words
        h = words.h
        suffix, key = _block_keys(h, self.block, last), _window_keys(h, m, last)
        order = np.lexsort((item, key, suffix))
        suffix, key, last, item = suffix[order], key[order], last[order], item[order]
        # a window that an item holds several times counts once
        again = np.flatnonzero((suffix[1:] == suffix[:-1]) & (key[1:] == key[:-1]) & (item[1:] == item[:-1])) + 1
        again = again[words.same(last[again], words, last[again - 1], m)]
        suffix, key, last, item = (np.delete(x, again) for x in (suffix, key, last, item))
        bits = max(10, int(8 * min(len(last) * m, len(h))).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.shift = np.full(1 << bits, m - self.block + 1, np.uint8)
        for j in range(m - self.block, -1, -1):
            at = (_block_keys(h, self.block, last - j) & self.mask).astype(np.int64)
            self.shift[at] = np.minimum(self.shift[at], j)
        self.key, self.last, self.item = key, last.astype(np.int32), item.astype(np.int32)
        self.buckets, at = np.unique(suffix, return_index=True)
        self.bucket_at = np.append(at, len(suffix)).astype(np.int32)

    def scan(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Window ends where the shift is 0, in texts that begin at words ``first``."""
        lo, hi = first[:-1] + self.m - 1, first[1:]
        lanes = np.maximum(0, -(-(hi - lo) // LANE))
        text = np.repeat(np.arange(len(lo)), lanes)
        step = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = lo[text] + step * LANE
        stop = np.minimum(at + LANE, hi[text])
        found = []
        while len(at):
            move = self.shift[(_block_keys(h, self.block, at) & self.mask).astype(np.int64)]
            found.append(at[move == 0])
            at = at + np.maximum(move, 1)
            live = at < stop
            at, stop = at[live], stop[live]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def confirm(self, texts: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window ends, numbers of items) of the true occurrences."""
        none = np.zeros(0, np.int64)
        if not len(at) or not len(self.buckets):
            return none, none
        suffix = _block_keys(texts.h, self.block, at)
        k = np.minimum(np.searchsorted(self.buckets, suffix), len(self.buckets) - 1)
        good = self.buckets[k] == suffix
        at, k = at[good], k[good]
        keys = _window_keys(texts.h, self.m, at)
        ends, items = [none], [none]
        sizes = self.bucket_at[k + 1] - self.bucket_at[k]
        for lo, hi in row_slices(np.concatenate([[0], np.cumsum(sizes)]), PAIRS):
            n = sizes[lo:hi]
            who = lo + np.repeat(np.arange(hi - lo), n)
            test = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.bucket_at[k[lo:hi]], n)
            equal = self.key[test] == keys[who]
            who, test = who[equal], test[equal]
            equal = texts.same(at[who], self.words, self.last[test], self.m)
            ends.append(at[who[equal]])
            items.append(self.item[test[equal]])
        return np.concatenate(ends), np.concatenate(items)


class Tables:
    """Test strings of all lengths that occur, and the names of their items."""

    def __init__(self, patterns: list[Patterns], names: pa.Array):
        self.patterns, self.names = patterns, names


def compile_patterns(rows: pa.Table, window: int = WINDOW) -> Tables:
    """Tables for the windows of (item, test) rows: string ids and texts."""
    rows = rows.combine_chunks()
    names, tests = (rows.column(c).combine_chunks() if rows.num_rows else pa.array([], pa.string()) for c in ("item", "test"))
    words = Words(*text_buffers(tests))
    n = np.diff(words.first)
    length = np.minimum(n, window)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        mine = np.flatnonzero(length == m)
        count = n[mine] - m + 1
        item = np.repeat(mine, count)
        last = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count) + words.first[item] + m - 1
        out.append(Patterns(m, words, last, item))
    return Tables(out, names)


def search(tables: Tables, data: np.ndarray, ends: np.ndarray):
    """For texts laid end to end: (words of each text, hit flags of all words, first word of each text, items of each text that has some)."""
    texts = Words(data, ends)
    flags = np.zeros(len(texts.at) + 1, np.int32)
    items: dict[int, set] = defaultdict(set)
    if len(texts.at):
        for p in tables.patterns:
            e, item = p.confirm(texts, p.scan(texts.h, texts.first))
            np.add.at(flags, e - p.m + 1, 1)
            np.add.at(flags, e + 1, -1)
            if len(e):
                text = np.searchsorted(texts.first, e, "right") - 1
                found = np.unique(np.stack([text, item]), axis=1)
                for t, name in zip(found[0].tolist(), tables.names.take(pa.array(found[1])).to_pylist(), strict=True):
                    items[t].update(() if name is None else (name,))
    return np.diff(texts.first), np.cumsum(flags[:-1]) > 0, texts.first, items


def _runs(hit: np.ndarray) -> list[int]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
    return edge.astype(int).tolist()


def _one_pass(rows: DataFrame, tables: Tables, kept: str) -> DataFrame:
    names = rows.columns

    def fn(batch: pa.RecordBatch) -> Iterator[dict]:
        data, ends = text_buffers(batch.column(names.index("_text")))
        for lo, hi in row_slices(ends):
            n_words, hit, first, items = search(tables, data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
            old_hits = batch.column(names.index("_hits")).slice(lo, hi - lo).to_pylist()
            old_items = batch.column(names.index("_items")).slice(lo, hi - lo).to_pylist()
            hits = []
            for k in range(hi - lo):
                mine = hit[first[k] : first[k + 1]]
                if old_hits[k]:
                    mine = mine.copy()
                    for i, j in zip(old_hits[k][::2], old_hits[k][1::2], strict=True):
                        mine[i:j] = True
                hits.append(_runs(mine) if mine.any() else [])
            yield {n: batch.column(i).slice(lo, hi - lo) for i, n in enumerate(names) if n not in ("_hits", "_items", "_n")} | {
                "_n": n_words,
                "_hits": hits,
                "_items": [sorted({*(old_items[k] or ()), *items.get(k, ())}) for k in range(hi - lo)],
            }

    return map_batches(rows, fn, kept + ", _n long, _hits array<int>, _items array<string>")


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", group_bytes: int = GROUP_BYTES, window: int = WINDOW) -> DataFrame:
    """The columns of ``df`` and n_words, hits (word intervals: start, end, start, end ...) and items (ids as strings, sorted).

    Columns of ``df`` with one of these three names are replaced.
    """
    tests = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("test"))
    size = tests.agg(F.coalesce(F.sum(F.octet_length("test")), F.lit(0))).first()[0]
    groups = max(1, -(-size // group_bytes))
    given = [c for c in df.columns if c not in ("n_words", "hits", "items")]
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(given)], F.col(f"`{text_col}`").cast("string").alias("_text"), F.lit(0).cast("long").alias("_n"), F.array().cast("array<int>").alias("_hits"), F.array().cast("array<string>").alias("_items"))
    rows = rows.select(*[f"c{i}" for i, c in enumerate(given) if c != text_col], "_text", "_n", "_hits", "_items")
    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("_n", "_hits", "_items"))
    for g in range(groups):
        mine = tests.where(F.pmod(F.xxhash64("item", "test"), F.lit(groups)) == g).toArrow()  # bounded: about group_bytes of text
        rows = _one_pass(rows, compile_patterns(mine, window), kept)
        if g + 1 < groups:
            rows = cut(rows)
    out = [F.col("_text" if c == text_col else f"c{i}").alias(c) for i, c in enumerate(given)]
    return rows.select(*out, F.col("_n").alias("n_words"), F.col("_hits").alias("hits"), F.col("_items").alias("items"))


def n_hit_words(hits: str = "hits"):
    """Words inside the intervals: the ends less the starts."""
    signed = F.transform(hits, lambda x, i: F.when(i % 2 == 1, x).otherwise(-x))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    x = find_contamination(docs, load(spark, sf_dir, "benchmark"))
    return x.select(
        "doc_id",
        "n_words",
        n_hit_words().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "coalesce(regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"

OP1_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT item_id, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS s FROM bw),
ms AS (SELECT DISTINCT m FROM win),
dp AS (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m),
dw AS (SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s FROM dp),
occ AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN win USING (s, m)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

QUERIES = {"op1_decontaminate": op1_decontaminate}
ORACLES = {"op1_decontaminate": OP1_SQL}
