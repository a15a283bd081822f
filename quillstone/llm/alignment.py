"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Tokenizer A is a byte-level BPE, B a sentencepiece BPE with byte fallback. Both encode
a space and the text. The tokens of B are a static index of intervals, their starts and
ends in order; the bytes of each token of A are looked up in it by bisection, which lists the
tokens of B that they overlap. A gap between two tokens of B that no token of A spans is the
border of a group.

Neither tokenizer joins what stands before a space with the space, so a text falls at single
spaces between visible characters into segments that are encoded alike wherever they
stand: each is once more a space and a text. A task encodes each segment once, all new ones
of a batch in one call, and keeps the last ``KEPT`` or so of them. This holds if A has no normalizer and the usual pattern of
byte-level BPE, and no piece of B has a space behind another character; both are checked
when the files are read, and other tokenizers get whole texts.

A first pass writes each text's counts, its groups' hash and its distinct pairs of ids with the number of their
links, in rows of ``ROW`` pairs at most. Counts over all texts are sums of these. The second pass looks the counts up: those of the most
frequent pairs, at most ``HEAVY`` of them, are broadcast; the others, each in few texts, are joined.

Defined cases: null and empty texts, and texts whose joined bytes of either side are not the space
and the text, have no tokens and zeros; equal rows have equal results, each counted; among
pairs of one B id with the same highest count all are best; very long texts are encoded in pieces of ``PIECE`` bytes,
cut at such spaces (a text without any is encoded whole); an empty table gives an empty table; extra columns are ignored,
whatever their names; a null id stays null.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Tables, bound_batches, load, row_slices, text_buffers

FOLDER = "/opt/tokenizers"  #: where the files of public tokenizers are
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
PIECE = 1 << 20  #: bytes of a text that are taken apart at a time
KEPT = 200_000  #: segments after which a task forgets the ones it knows
ROW = 1 << 16  #: pairs of a row of the first pass
HEAVY = 1 << 20  #: pairs whose counts are broadcast

_CUT = re.compile(rb"[!-~] [!-~]")
_SPACE = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letters that byte-level BPE writes for bytes: printable Latin-1 stands for itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Tokenizers:
    """Both tokenizers: ids of a space and a text, and the bytes of each id."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        spec = json.loads(self.a.to_str())
        named = {i: t for t, i in self.a.get_vocab(with_added_tokens=True).items()}
        special = {t["id"] for t in spec["added_tokens"]}
        self.a_bytes = [b"" if i in special or i not in named else bytes(letters[c] for c in named[i]) for i in range(max(named) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_len, self.b_len = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.a_bytes, self.b_bytes))
        pre = spec["pre_tokenizer"] or {}
        usual = spec["normalizer"] is None and (pre.get("type"), pre.get("add_prefix_space"), pre.get("use_regex")) == ("ByteLevel", False, True)
        self.parts = usual and not any(re.search(r"[^▁]▁", p) for p in pieces)

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of A and B, or None if their bytes are not those of a space and ``text``."""
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        whole = (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        return a, b


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For tokens that end at these bytes: the first token of B that each token of A overlaps, and the one after the last."""
    a_starts, b_starts = np.concatenate([[0], a_ends[:-1]]), np.concatenate([[0], b_ends[:-1]])
    return np.searchsorted(b_ends, a_starts, "right"), np.searchsorted(b_starts, a_ends, "left")


def group_ends(first: np.ndarray, after: np.ndarray, n_b: int) -> np.ndarray:
    """The tokens of B whose gap to the next no token of A spans."""
    spans = np.zeros(n_b + 1, np.int64)
    np.add.at(spans, first, 1)
    np.add.at(spans, after - 1, -1)
    return np.flatnonzero(np.cumsum(spans)[:n_b] == 0)


class Segments:
    """What is known of segments: counts of tokens, groups and links, the links' pairs of ids, the groups' text."""

    def __init__(self, tokenizers: Tokenizers):
        self.tokenizers = tokenizers
        self.forget()

    def forget(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of A, of B, groups, links
        self.starts, self.pairs = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def split(self, text: str) -> list[str]:
        return _SPACE.split(text) if self.tokenizers.parts else [text]

    def learn(self, segments: list[str]) -> None:
        """Encode segments that aren't known yet; one whose bytes don't agree gets the number -1. Forgets the others first if they are many."""
        if len(self.at) > KEPT:
            self.forget()
        new = list(dict.fromkeys(s for s in segments if s not in self.at))
        plain = [s for s in new if s and not s[0].isspace() and not s[-1].isspace()]
        self._together(plain)
        for s in new:
            if s not in self.at:
                self._add([s], self.tokenizers.encode(s))

    def _together(self, segments: list[str]) -> None:
        """Encode segments in one call, in halves if one of them doesn't come back as its bytes."""
        if not segments:
            return
        ids = self.tokenizers.encode(" ".join(segments))
        if ids or len(segments) == 1:
            self._add(segments, ids)
        else:
            self._together(segments[: len(segments) // 2])
            self._together(segments[len(segments) // 2 :])

    def _add(self, segments: list[str], ids: tuple[list[int], list[int]] | None) -> None:
        if ids is None:
            self.at.update(dict.fromkeys(segments, -1))
            return
        a, b = (np.array(x, np.int64) for x in ids)
        a_ends, b_ends = np.cumsum(self.tokenizers.a_len[a]), np.cumsum(self.tokenizers.b_len[b])
        first, after = overlaps(a_ends, b_ends)
        n = after - first
        link_a = np.repeat(np.arange(len(a)), n)
        link_b = np.arange(len(link_a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        last_b = group_ends(first, after, len(b))
        last_a = np.searchsorted(a_ends, b_ends[last_b])
        ends = np.cumsum(np.fromiter((len(s.encode()) for s in segments), np.int64, len(segments)) + 1)
        # of each segment, the tokens, groups and links before its end
        marks = np.stack([np.searchsorted(a_ends, ends, "right"), np.searchsorted(b_ends, ends, "right"), np.searchsorted(b_ends[last_b], ends, "right")], axis=1)
        marks = np.concatenate([marks, np.searchsorted(link_a, marks[:, :1])], axis=1)
        a_text, b_text = list(map(str, ids[0])), list(map(str, ids[1]))
        texts, la, lb = [], 0, 0
        for i, j in zip((last_a + 1).tolist(), (last_b + 1).tolist(), strict=True):
            texts.append(f"{','.join(a_text[la:i])}|{','.join(b_text[lb:j])}")
            la, lb = i, j
        cuts = [0, *marks[:, 2].tolist()]
        base = len(self.groups)
        self.at.update((s, base + i) for i, s in enumerate(segments))
        self.groups += [";".join(texts[i:j]).encode() for i, j in zip(cuts, cuts[1:], strict=False)]
        self.numbers = np.concatenate([self.numbers, np.diff(marks, axis=0, prepend=0)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + marks[:, 3]])
        self.pairs = np.concatenate([self.pairs, a[link_a] << 32 | b[link_b]])

    def pairs_of(self, at: np.ndarray) -> np.ndarray:
        """The pairs of ids of all links of segments."""
        n = self.numbers[at, 3]
        return self.pairs[np.arange(n.sum()) + np.repeat(self.starts[at] - (np.cumsum(n) - n), n)]


def pieces(data: memoryview, size: int) -> Iterator[bytes]:
    """``data`` without the spaces at which it is cut, in pieces of about ``size`` bytes."""
    at = 0
    while True:
        cut = _CUT.search(data, at + size)
        if not cut:
            yield bytes(data[at:])
            return
        yield bytes(data[at : cut.start() + 1])
        at = cut.start() + 2


class _Text:
    """Sums over the segments of one text."""

    def __init__(self):
        self.numbers, self.hash, self.pairs, self.times, self.whole = np.zeros(4, np.int64), hashlib.sha256(), np.zeros(0, np.int64), np.zeros(0, np.int64), True

    def add(self, known: Segments, segments: list[str]) -> None:
        at = np.fromiter(map(known.at.__getitem__, segments), np.int64, len(segments))
        if not self.whole or at.min() < 0:
            self.whole = False
            return
        if self.numbers[0]:
            self.hash.update(b";")
        self.hash.update(b";".join(map(known.groups.__getitem__, at.tolist())))
        self.numbers += known.numbers[at].sum(axis=0)
        pairs = known.pairs_of(at)
        held, place = np.unique(np.concatenate([self.pairs, pairs]), return_inverse=True)
        self.times = np.bincount(place, np.concatenate([self.times, np.ones(len(pairs), np.int64)]), len(held)).astype(np.int64)
        self.pairs = held


def _align_text(known: Segments, data: memoryview) -> _Text:
    """A text by itself, piece by piece."""
    text = _Text()
    text.whole = len(data) > 0
    for piece in pieces(data, PIECE) if known.tokenizers.parts else [bytes(data)]:
        if not text.whole:
            break
        segments = known.split(piece.decode())
        known.learn(segments)
        text.add(known, segments)
    return text


def _align_texts(known: Segments, data: memoryview, ends: list[int]) -> Iterator[_Text]:
    """Texts in order; short ones are encoded together, as many as a piece holds."""
    for lo, hi in row_slices(np.array(ends), PIECE):
        if ends[hi] - ends[lo] > PIECE:
            yield from (_align_text(known, data[ends[k] : ends[k + 1]]) for k in range(lo, hi))
            continue
        split = [known.split(bytes(data[ends[k] : ends[k + 1]]).decode()) for k in range(lo, hi)]
        known.learn(list(chain.from_iterable(split)))
        for segments in split:
            text = _Text()
            text.whole = segments != [""]
            if text.whole:
                text.add(known, segments)
            yield text


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
LINK = T.StructType([T.StructField("pair", T.LongType()), T.StructField("times", T.LongType())])


def _first_schema(id_type: T.DataType) -> T.StructType:
    longs = [T.StructField(c, T.LongType()) for c in ("row", *NUMBERS)]
    return T.StructType([T.StructField("id", id_type), *longs, T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(LINK))])


@functools.cache
def _segments(a_path: str, b_path: str) -> Segments:
    return Segments(Tokenizers(a_path, b_path))


def _align(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Of each text (id, row, text) a row with its numbers and first pairs, and rows with the rest of its pairs, whose numbers are null."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, known = to_arrow_schema(schema), _segments(a_path, b_path)
    for batch in batches:
        data, ends = text_buffers(batch.column(2))
        view, ends = memoryview(data), ends.tolist()
        out: list[tuple] = []
        size = 0
        for i, text in enumerate(_align_texts(known, view, ends)):
            if not text.whole:
                out.append((i, [0] * 4, "", text.pairs[:0], text.times[:0]))
                continue
            for lo in range(0, len(text.pairs), ROW):
                numbers, name = ([None] * 4, None) if lo else (text.numbers.tolist(), text.hash.hexdigest())
                out.append((i, numbers, name, text.pairs[lo : lo + ROW], text.times[lo : lo + ROW]))
            size += len(text.pairs)
            if size >= 8 * ROW:
                yield _first_rows(batch, out, arrow)
                out, size = [], 0
        if out:
            yield _first_rows(batch, out, arrow)


def _first_rows(batch: pa.RecordBatch, out: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    at, numbers, names, pairs, times = zip(*out, strict=True)
    at, ends = pa.array(at), pa.array(np.cumsum([0, *map(len, pairs)]).astype(np.int32))
    links = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in (pairs, times)], names=["pair", "times"]))
    columns = [batch.column(0).take(at), batch.column(1).take(at), *[pa.array(c, pa.int64()) for c in zip(*numbers, strict=True)], pa.array(names, pa.string()), links.cast(arrow.field("links").type)]
    return pa.RecordBatch.from_arrays(columns, schema=arrow)


def align(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = FOLDER) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of ``df``; ``folder`` holds the files on every worker."""
    spark, tables = df.sparkSession, Tables(df.sparkSession)
    bound_batches(spark)
    a_path, b_path = f"{folder}/{A_FILE}", f"{folder}/{B_FILE}"
    rows = df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = _first_schema(df.schema[id_col].dataType)
    first = tables.write(rows.mapInArrow(functools.partial(_align, a_path=a_path, b_path=b_path, schema=schema), schema))
    links = first.select("row", F.explode("links").alias("link")).select("row", "link.pair", "link.times")
    counts = tables.write(links.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))))
    # a row for each id of B: at most its vocabulary
    highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("most")))
    counts = tables.write(counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))

    # the frequent pairs whose counts are broadcast: from that power of two on from which there are at most HEAVY
    level = F.floor(F.log2("n")).cast("int")
    least, total = 0, 0
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).orderBy(F.desc("level")).collect():  # 63 rows at most
        total += r["pairs"]
        if total > HEAVY:
            least = r["level"] + 1
            break
    n_best, count_sum = F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
    frequent = F.broadcast(counts.where(level >= least).select(F.col("pair").alias("known"), "n", "best"))
    sums = links.join(frequent, F.col("pair") == F.col("known"))
    if least:
        rare = links.join(F.broadcast(counts.where(level >= least).select("pair")), "pair", "left_anti").join(counts.where(level < least), "pair")
        sums = sums.select("row", "times", "n", "best").unionByName(rare.select("row", "times", "n", "best"))
    sums = sums.groupBy("row").agg(n_best, count_sum)
    out = first.where("n_a IS NOT NULL").select("row", "id", *NUMBERS, "groups_sha256").join(sums, "row", "left")
    return out.select(F.col("id").alias(id_col), *NUMBERS, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")], "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return align(load(spark, sf_dir, "documents"))


QUERIES = {"op13_alignment": op13_alignment}
ORACLES: dict[str, str] = {}
