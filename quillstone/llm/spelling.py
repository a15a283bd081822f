"""Spelling variants: forward and backward minimal acyclic automata whose words are numbered.

Words are counted over all texts. Of two words one edit apart, the shorter with m letters,
at least m // 2 letters are the same at the beginning or at the end. So each word is posted
under its beginning of half its length and, as the longer of two, of half of one less, and its
mirror image likewise; two words one edit apart share one of these postings.

A task takes its postings in order and builds a minimal acyclic automaton of the words of some
groups at a time, ``BLOCK`` words or more: forward of the words, backward of their mirror images. Each
state knows how many words lie behind it, so a path gives a word's number in order. A word
follows its exact half, then the rest of its letters with one error, and gets the numbers of
the words there, thus these words and their counts. What both directions find is one pair.
Groups of over ``BLOCK`` words are dealt: each part of the group has an automaton of its own, which
all words of the group search.

A word's form is its near word of the largest count (ties: the smallest in code-point order) if that is
``RATIO`` times its own at least; forms are followed by joins that double the steps until nothing changes. As counts
grow along a chain, it ends.

Defined cases: null and empty texts have no words; a null id counts as an empty one when letters are
dropped; repeated rows count again; very long texts are read in pieces of ``PIECE`` bytes, cut
between runs; a run of any length is a word (an automaton holds it whole); an empty table gives an empty table; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Tables, bound_batches, load, map_batches, text_buffers

LETTERS, OCCURRENCES = 6, 5  #: code points and occurrences that a word has at least
DROPPED = 199  #: runs whose checksum this divides lose a letter
RATIO = 5  #: times its own count that the count of a word's form must be
BLOCK = 1 << 15  #: words of an automaton from which it takes no further group
PIECE = 1 << 20  #: bytes of a text that are searched for runs at a time
SEARCHES = 1 << 14  #: words that search one automaton between two answers

# In UTF-8 the letters from U+00C0 to U+00FF are 0xC3 and one byte; 0xC3 begins nothing else.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
_OTHER = re.compile(rb"[^A-Za-z\x80-\xbf\xc3]")


def runs_of(data: memoryview, size: int = PIECE) -> Counter:
    """The lower-cased runs of letters of a UTF-8 text and how often each stands there."""
    found: Counter = Counter()
    at = 0
    while at < len(data):
        gap = _OTHER.search(data, at + size)
        end = gap.end() if gap else len(data)
        found.update(_RUN.findall(bytes(data[at:end]).lower()))
        at = end
    return found


def spelled(doc: bytes, run: bytes) -> str:
    """The word of a run of a document: itself, or short of a letter if DROPPED divides the checksum of both."""
    word, h = run.decode(), zlib.crc32(doc + b":" + run)
    at = h % len(word)
    return word if h % DROPPED else word[:at] + word[at + 1 :]


def _count_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    data, ends = text_buffers(batch.column(1))
    view, ends = memoryview(data), ends.tolist()
    total: Counter = Counter()
    for doc, a, b in zip(batch.column(0).to_pylist(), ends, ends[1:], strict=False):
        doc = (doc or "").encode()
        for run, n in runs_of(view[a:b]).items():
            if len(run) >= LETTERS and len(word := spelled(doc, run)) >= LETTERS:
                total[word] += n
    yield {"word": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())}


def word_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words with LETTERS and OCCURRENCES at least."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, _count_batch, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words; a word's number is its place among them.

    ``edges[s]`` maps a letter to the next state and the number of words that come before those through it.
    """

    def __init__(self, words: list[str]):
        self.edges: list[dict[str, tuple[int, int]]] = [{}]
        self.final, self.count = [False], [0]
        known: dict[tuple, int] = {}
        path, last = [0], ""
        for word in [*words, ""]:
            same = 0
            for a, b in zip(word, last, strict=False):
                if a != b:
                    break
                same += 1
            # what the last word has beyond the common beginning gets no further words: states alike become one
            while len(path) > same + 1:
                state = path.pop()
                self._close(state)
                key = (self.final[state], tuple(self.edges[state].items()))
                held = known.setdefault(key, state)
                if held != state and state == len(self.edges) - 1:
                    self.edges.pop(), self.final.pop(), self.count.pop()
                self.edges[path[-1]][last[len(path) - 1]] = (held, 0)
            for _ in word[same:]:
                path.append(len(self.edges))
                self.edges.append({})
                self.final.append(False)
                self.count.append(0)
            if word:
                self.final[path[-1]] = True
            last = word
        self._close(0)

    def _close(self, state: int) -> None:
        before = int(self.final[state])
        for letter, (to, _) in self.edges[state].items():
            self.edges[state][letter] = (to, before)
            before += self.count[to]
        self.count[state] = before

    def _ends(self, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that goes on from ``state`` with word[at:], or -1."""
        edges = self.edges
        for i in range(at, len(word)):
            step = edges[state].get(word[i])
            if step is None:
                return -1
            state, number = step[0], number + step[1]
        return number if self.final[state] else -1

    def near(self, word: str, half: int) -> set[int]:
        """Numbers of the words that have word[:half] and then differ by one inserted, deleted or replaced letter."""
        found: set[int] = set()
        state, number = 0, 0
        for i, letter in enumerate(word):
            if i >= half:
                # of equal letters in a row, only the first is left out, and only before the first is one more put in
                if i == half or letter != word[i - 1]:
                    found.add(self._ends(state, number, word, i + 1))
                for other, (to, before) in self.edges[state].items():
                    if other != letter:
                        found.add(self._ends(to, number + before, word, i + 1))
                    if i == half or other != word[i - 1]:
                        found.add(self._ends(to, number + before, word, i))
            step = self.edges[state].get(letter)
            if step is None:
                break
            state, number = step[0], number + step[1]
        else:
            for to, before in self.edges[state].values():
                if self.final[to]:
                    found.add(number + before)
        found.discard(-1)
        return found


class _Block:
    """Words of some groups, their automaton once it is needed, and the words that are to search it."""

    def __init__(self, backward: bool):
        self.backward, self.counts, self.queries, self.automaton = backward, {}, [], None

    def search(self) -> Iterator[pa.RecordBatch]:
        if self.automaton is None:
            self.words = sorted(self.counts)
            self.numbers = np.array([self.counts[w] for w in self.words], np.int64)
            self.automaton = Automaton(self.words)
        for lo in range(0, len(self.queries), SEARCHES):
            word, at = [], []
            for text, half in self.queries[lo : lo + SEARCHES]:
                found = self.automaton.near(text, half)
                word += [text] * len(found)
                at += found
            near = [self.words[i] for i in at]
            if self.backward:
                word, near = [w[::-1] for w in word], [w[::-1] for w in near]
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(self.numbers[np.array(at, int)])], names=["word", "near", "near_n"])
        self.queries = []


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers to postings that come by direction and group, a group's own words before others that search them."""
    block, group = None, None
    for batch in batches:
        for backward, key, deal, text, n, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != (backward, key, deal):
                if block and (block.backward != backward or len(block.counts) >= BLOCK or block.automaton):
                    yield from block.search()
                    block = None
                block, group = block or _Block(backward), (backward, key, deal)
            if own:
                block.counts[text] = n
            block.queries.append((text, len(key)))
            if not own and len(block.queries) >= SEARCHES:
                yield from block.search()
    if block:
        yield from block.search()


def near_words(tables: Tables, words: DataFrame) -> DataFrame:
    """(word, near, near_n) of the ordered pairs of ``words`` (word, n) that are one edit apart."""
    size = F.length("text")
    keys = F.array_distinct(F.array(F.floor(size / 2).cast("int"), F.floor((size - 1) / 2).cast("int")))
    sides = words.select("n", F.posexplode(F.array("word", F.reverse("word"))).alias("side", "text")).withColumn("half", F.explode(keys))
    posted = sides.select((F.col("side") == 1).alias("backward"), F.expr("left(text, half)").alias("key"), "text", "n")
    large = posted.groupBy("backward", "key").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK)
    large = tables.write(large.select("backward", "key", F.ceil(F.col("m") / BLOCK).cast("int").alias("deals")))
    dealt = posted.join(large, ["backward", "key"], "left").withColumn("deals", F.coalesce("deals", F.lit(1)))
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("text"), F.col("deals")).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    dealt = dealt.select("backward", "key", "deal", "text", "n", (F.col("deal") == F.col("mine")).alias("own"))
    placed = dealt.repartition("backward", "key", "deal").sortWithinPartitions("backward", "key", "deal", F.desc("own"))
    bound_batches(words.sparkSession)
    found = placed.mapInArrow(_search, "word string, near string, near_n long")
    return found.repartition("word").distinct()


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``df``."""
    tables = Tables(df.sparkSession)
    words = tables.write(word_counts(df, id_col, text_col))
    best = near_words(tables, words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    formed = words.join(best, "word", "left")
    often = -F.col("best.less") >= RATIO * F.col("n")
    formed = formed.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(often, F.col("best.near")).alias("form"), F.when(often, -F.col("best.less")).alias("form_n"))
    formed = tables.write(formed)
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        seen = Observation()
        far = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        steps = roots.join(far, "root", "left").observe(seen, F.count("far").alias("moved"))
        roots = tables.write(steps.select("word", F.coalesce("far", "root").alias("root")))
        if not seen.get["moved"]:
            break
    return formed.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling(spark, sf_dir: str) -> DataFrame:
    return variants(load(spark, sf_dir, "documents"))


QUERIES = {"op12_spelling": op12_spelling}
ORACLES: dict[str, str] = {}
