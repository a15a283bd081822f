"""MinHash near-duplicates: an inverted join on signature coordinates.

A text's set holds its distinct shingles of ``SHINGLE`` words, as 64-bit hashes.
Equal sets are one class, told apart by a 128-bit hash of the sorted set. Every
class has a signature of ``COORDS`` minima and is posted under its pairs of
coordinate and value. Two classes whose Jaccard similarity is 0.75 agree in
fewer than ``MATCHES`` coordinates with a probability of about 2e-5, so pairs
with fewer are not looked at. Classes that agree in MATCHES coordinates must
share one of the COORDS - MATCHES + 1 rarest pairs of each (the prefix), so only
those are posted; what a passage in many texts makes common is skipped. Along
with its posting a class carries one byte of each coordinate, on which matches
are counted before a pair is formed.

Pairs are not formed within whole posting lists. Each class is compared with the
most central class of a list (the one whose pairs of coordinate and value are the
most common, as those of an original are among its edited copies); agreement is
confirmed on the full sets. What then still has a match in another component is
compared on its shingles, again by prefix: two sets with similarity 0.75 share one of the rarest
floor(n / 4) + 1 shingles of each, and the places of the shared one bound the
overlap, so an edited copy whose own shingles fill its prefix meets nothing.
Within a component nothing is compared. Components come from label propagation
with shortcuts, over DataFrames, until no label changes.

What the links need of the texts is read once: those of classes with postings
meet their rows by hash and id, so copies of one text are spread. Intermediate
tables are Parquet in the shared checkpoint folder.

Defined cases: null, empty and wordless texts have an empty set and are linked
with nothing, each its own component; texts of fewer than five words have the
whole sequence as their one shingle; equal rows are linked (unless empty); a
null id never becomes a component's id unless the component has no other;
``kept`` then compares nulls as equal; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from .common import PrefixHash, Tables, load, map_batches, mix64, row_slices, text_buffers

SHINGLE = 5
SIMILARITY = 75  #: per cent of the union that the intersection must reach
COORDS, MATCHES = 64, 34
DEALT = 2048  #: rows of a shingle's list that one task compares with the rest of the list
WORDS8 = COORDS // 8
LONG_WORD = 256  #: bytes from which a word is hashed by a function that no word's structure defeats

#: Upper-case ASCII letters fall; tabs, line ends and spaces part the words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, bool)
IN_WORD[9:14] = IN_WORD[32] = False

_rng = np.random.default_rng(4)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDS, dtype=np.uint64)


def shingles(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct shingles of texts laid end to end, ordered by text, then hash."""
    low = LOWER[data]
    mask = np.zeros(len(low) + 2, bool)
    mask[1:-1] = IN_WORD[low]
    edge = mask[1:] != mask[:-1]
    inner = ends[1:-1]
    inner = inner[(inner > 0) & (inner < len(low))]
    split = np.unique(inner[mask[inner] & mask[inner + 1]])
    at = np.flatnonzero(edge)
    if len(split):
        at = np.sort(np.concatenate([at, split, split]))
    starts, stops = at[::2], at[1::2]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = PrefixHash(low).at(starts, stops)
    # words written to collide under a polynomial hash have 1,024 bytes at least: long words get another one
    for k in np.flatnonzero(stops - starts >= LONG_WORD).tolist():
        h[k] = xxhash.xxh3_64_intdigest(low[starts[k] : stops[k]].tobytes(), LONG_WORD)
    first = np.searchsorted(starts, ends)
    n = np.diff(first)
    text = np.repeat(np.arange(len(n)), n)
    width = np.minimum(n, SHINGLE)[text]
    begins = np.arange(len(h)) + width <= first[1:][text]
    at, text, width = np.flatnonzero(begins), text[begins], width[begins]
    key = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            key = np.where(j < width, mix64(key * np.uint64(0x9E3779B97F4A7C15) + h[np.minimum(at + j, len(h) - 1)]), key)
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (text[1:] != text[:-1]) | (key[1:] != key[:-1])
    return text[new], key[new]


def _sketch_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    data, ends = text_buffers(batch.column(2))
    for lo, hi in row_slices(ends):
        n = hi - lo
        text, key = shingles(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        count = np.bincount(text, minlength=n)
        has = np.flatnonzero(count)
        starts = np.searchsorted(text, has)
        sig = np.zeros((n, COORDS), np.uint32)
        name = np.zeros((n, 2), np.uint64)
        if len(has):
            with np.errstate(over="ignore"):
                for c in range(COORDS):
                    sig[has, c] = np.minimum.reduceat(((key * _MULTIPLY[c] + _ADD[c]) >> np.uint64(32)).astype(np.uint32), starts)
                name[has, 0] = np.add.reduceat(mix64(key), starts)
                name[has, 1] = np.add.reduceat(mix64(key ^ np.uint64(0xA5A5A5A5A5A5A5A5)), starts)
        bytes8 = (sig & np.uint32(255)).astype(np.uint8).view(np.int64).reshape(n, WORDS8)
        offsets = pa.array(np.arange(0, (n + 1) * COORDS, COORDS, dtype=np.int32))
        yield {
            "id": batch.column(0).slice(lo, n),
            "th": batch.column(1).slice(lo, n),
            "n": count,
            "k1": name[:, 0].view(np.int64),
            "k2": name[:, 1].view(np.int64),
            "sig": pa.ListArray.from_arrays(offsets, pa.array(sig.reshape(-1).view(np.int32))),
        } | {f"b{w}": np.ascontiguousarray(bytes8[:, w]) for w in range(WORDS8)}


def sketch(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, hash of the text, set size, two halves of the set's hash, signature, its low bytes) of each row."""
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("th"), F.col(text_col).cast("string"))
    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(rows, _sketch_batch, f"id {kind}, th long, n long, k1 long, k2 long, sig array<int>, " + ", ".join(f"b{w} long" for w in range(WORDS8)))


def _matches(a: str, b: str) -> Column:
    """How many of the signature bytes agree: an exclusive or, each byte folded onto its lowest bit, the ones counted."""
    total = F.lit(COORDS)
    for w in range(WORDS8):
        x = F.col(f"{a}.b{w}").bitwiseXOR(F.col(f"{b}.b{w}"))
        for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x0303030303030303), (1, 0x0101010101010101)):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(mask))
        total = total - F.bit_count(x)
    return total


def _close(a: str, b: str) -> Column:
    """What a pair of classes above the similarity must meet: sizes within it, and enough matching bytes."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY) & (_matches(a, b) >= MATCHES)


def _confirm_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    (xs, xe), (ys, ye) = text_buffers(batch.column(2)), text_buffers(batch.column(3))
    for lo, hi in row_slices(xe + ye):
        n = hi - lo
        data = np.concatenate([xs[xe[lo] : xe[hi]], ys[ye[lo] : ye[hi]]])
        ends = np.concatenate([xe[lo : hi + 1] - xe[lo], ye[lo + 1 : hi + 1] - ye[lo] + xe[hi] - xe[lo]])
        text, key = shingles(data, ends)
        size = np.bincount(text, minlength=2 * n)
        pair = text % n
        order = np.lexsort((key, pair))
        pair, key = pair[order], key[order]
        both = np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (key[1:] == key[:-1])], minlength=n)
        good = pa.array(100 * both >= SIMILARITY * (size[:n] + size[n:] - both))
        yield {"u": batch.column(0).slice(lo, n).filter(good), "v": batch.column(1).slice(lo, n).filter(good)}


def confirm(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(u, v) of the pairs (a, b, u, v) whose texts (c, text) a and b reach the similarity on their full sets."""
    x = pairs.join(texts.select(F.col("c").alias("a"), F.col("text").alias("x")), "a")
    y = x.join(texts.select(F.col("c").alias("b"), F.col("text").alias("y")), "b")
    return map_batches(y.select("u", "v", "x", "y"), _confirm_batch, "u long, v long")


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """(c, comp): the least node of each node's component, for the nodes of ``edges`` (u, v).

    Every round, a node takes the least label among itself and its neighbours,
    then the label of that label; rounds end when no label changes.
    """
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v")
    labels = tables.write(both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m")).select("c", F.least("c", "m").alias("comp")))
    while True:
        seen = Observation()
        near = both.join(labels.select(F.col("c").alias("v"), "comp"), "v").groupBy(F.col("u").alias("c")).agg(F.min("comp").alias("m"))
        step = labels.join(near, "c").select("c", F.col("comp").alias("old"), F.least("comp", "m").alias("mid"))
        jump = labels.select(F.col("c").alias("mid"), F.col("comp").alias("far"))
        new = step.join(jump, "mid").select("c", "old", F.least("mid", "far").alias("comp"))
        old, labels = labels, tables.write(new.observe(seen, F.count_if(F.col("comp") != F.col("old")).alias("changed")).select("c", "comp"))
        tables.drop(old)
        if not seen.get["changed"]:
            return labels


BYTES = [f"b{w}" for w in range(WORDS8)]


# A side that a join looks up by a key with hot values is written first, not joined straight
# from its aggregation: its size is known then, and the other side's hot key can be split.


def _star(tables: Tables, posted: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of a class and the most central class of one of its lists."""
    postings = posted.select("c", "n", "weight", *BYTES, F.explode("prefix").alias("token"))
    heads = postings.groupBy("token").agg(F.count("*").alias("m"), F.max(F.struct("weight", "c", "n", *BYTES)).alias("head")).where("m > 1")
    heads = tables.write(heads.select("token", *[F.col(f"head.{x}").alias(x) for x in ("c", "n", *BYTES)]))
    pairs = postings.alias("x").join(heads.alias("y"), "token").where(F.col("x.c") != F.col("y.c")).where(_close("x", "y"))
    return pairs.select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()


def _main(lists: DataFrame, key: str) -> DataFrame:
    """(key, main, all) of the lists of (key, comp) that hold several components: the largest one, and the rows of the list."""
    parts = lists.groupBy(key, "comp").agg(F.count("*").alias("m"))
    most = parts.groupBy(key).agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("most"))
    return most.where("parts > 1").select(key, F.col("most.comp").alias("main"), "all")


def _open_classes(tables: Tables, posted: DataFrame, comp: DataFrame) -> DataFrame:
    """(c, comp, n) of the classes that have a match in another component."""
    known = posted.join(comp, "c", "left").select("c", F.coalesce("comp", "c").alias("comp"), "n", *BYTES, F.explode("prefix").alias("token"))
    main = tables.write(_main(known.select("token", "comp"), "token").drop("all"))
    mixed = tables.write(known.join(main, "token"))
    rest = mixed.where("comp <> main")
    apart = F.col("x.comp") != F.col("y.comp")
    one = mixed.alias("x").join(rest.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & _close("x", "y"), "left_semi")
    two = rest.alias("x").join(mixed.alias("y"), (F.col("x.token") == F.col("y.token")) & apart & _close("x", "y"), "left_semi")
    out = tables.write(one.select("c", "comp", "n").union(two.select("c", "comp", "n")).distinct())
    tables.drop(mixed)
    return out


def _shingle_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    data, ends = text_buffers(batch.column(1))
    for lo, hi in row_slices(ends):
        text, key = shingles(data[ends[lo] : ends[hi]], ends[lo : hi + 1] - ends[lo])
        yield {"c": batch.column(0).slice(lo, hi - lo).take(pa.array(text)), "h": key.view(np.int64)}


def _by_shingles(tables: Tables, open_: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) and their components (u, v), those different, that the prefixes and places of their shingles leave."""
    every = tables.write(map_batches(texts.join(open_.select("c"), "c").select("c", "text"), _shingle_batch, "c long, h long"))
    shared = tables.write(every.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    own = every.join(shared, "h").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("own")).join(open_, "c")
    # shingles of one class only come first in the order; they fill places of the prefix, but meet nothing
    length = F.floor(F.col("n") * (100 - SIMILARITY) / 100).cast("int") + 1
    left = F.greatest(length - (F.col("n") - F.size("own")), F.lit(0)).cast("int")
    rows = own.select("c", "comp", "n", F.size("own").alias("k"), F.posexplode(F.slice("own", F.lit(1), left)).alias("i", "t"))
    rows = tables.write(rows.select("c", "comp", "n", (F.col("n") - F.col("k") + F.col("i")).alias("i"), F.col("t.h").alias("h")))
    tables.drop(every, shared)
    # a shingle of many classes is dealt to several tasks: one side by class, the other to each
    mixed = rows.join(tables.write(_main(rows, "h")), "h").withColumn("deals", F.ceil(F.col("all") / DEALT).cast("int")).drop("all")
    x = mixed.withColumn("deal", F.pmod(F.xxhash64("c"), F.col("deals")).cast("int")).alias("x")
    y = mixed.where("comp <> main").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.comp") == F.col("x.main")) | (F.col("x.c") < F.col("y.c")))
    most = F.least(F.col("x.n") - F.col("x.i"), F.col("y.n") - F.col("y.i"))
    enough = most * (100 + SIMILARITY) >= (F.col("x.n") + F.col("y.n")) * SIMILARITY
    ordered = [pick(f"x.{c}", f"y.{c}").alias(name) for c, name, pick in (("c", "a", F.least), ("c", "b", F.greatest), ("comp", "u", F.least), ("comp", "v", F.greatest))]
    return x.join(y, ["h", "deal"]).where(apart & enough).select(*ordered).distinct()


def _grouped(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, n, k1, k2) of each row of ``df``; (c, one, rep, k1, k2, n) of each class; (c, comp) of the classes that are linked."""
    tables = Tables(df.sparkSession)
    rows = tables.write(sketch(df, id_col, text_col))
    one = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("one")
    firsts = rows.where("n > 0").groupBy("k1", "k2", "n").agg(one, F.min("id").alias("rep"), *[F.first(b).alias(b) for b in ("sig", *BYTES)])
    classes = tables.write(firsts.withColumn("c", F.monotonically_increasing_id()))

    # of each class, the prefix of its pairs of coordinate and value, the rarest first, if enough of them are shared
    token = F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    pairs = classes.select("c", F.posexplode("sig").alias("i", "v")).select("c", token.alias("token"))
    shared = tables.write(pairs.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"))
    own = pairs.join(shared, "token").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("own")).where(F.size("own") >= MATCHES)
    prefix = F.transform(F.slice("own", F.lit(1), F.size("own") - (MATCHES - 1)), lambda t: t["token"])
    weight = F.floor(F.aggregate("own", F.lit(0.0), lambda s, x: s + F.log2(x["df"])))
    posted = own.select("c", weight.alias("weight"), prefix.alias("prefix")).join(classes.select("c", "n", "one", *BYTES), "c")
    posted = tables.write(posted)
    tables.drop(shared)

    # texts of the posted classes, from one row of each; the ids only spread the copies of a text, so any key made of them does
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    every = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    every = every.select("text", F.xxhash64("text").alias("th"), key.alias("key"))
    wanted = posted.select("c", F.col("one.th").alias("th"), F.col("one.id").alias("id")).select("c", "th", key.alias("key"))
    texts = tables.write(every.join(wanted, ["th", "key"]).groupBy("th", "key", "c").agg(F.first("text").alias("text")).select("c", "text"))

    star = _star(tables, posted).select("a", "b", F.col("a").alias("u"), F.col("b").alias("v"))
    links = tables.write(confirm(star, texts))
    comp = components(tables, links)
    open_ = _open_classes(tables, posted, comp)
    tables.drop(posted)
    cross = tables.write(_by_shingles(tables, open_, texts))
    further = tables.write(confirm(cross, texts))
    tables.drop(texts, open_, cross)
    joined = components(tables, further).withColumnRenamed("comp", "far")
    # classes linked by shingles only are components of their own so far
    single = further.select(F.col("u").alias("c")).union(further.select(F.col("v").alias("c"))).distinct().join(comp, "c", "left_anti").select("c", F.col("c").alias("comp"))
    whole = comp.unionByName(single).join(joined.withColumnRenamed("c", "comp"), "comp", "left").select("c", F.coalesce("far", "comp").alias("comp"))
    return rows.select("id", "n", "k1", "k2"), classes.select("c", "one", "rep", "k1", "k2", "n"), tables.write(whole)


def first_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th) of the first row of each component that has words, by id (null ids last), then by ``th``, the xxhash64 of the text."""
    _, classes, comp = _grouped(df, id_col, text_col)
    ids = classes.select("c", "one").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    return ids.groupBy("comp").agg(F.min("one").alias("one")).select("one.id", "one.th")


def wordless(text: str) -> Column:
    """Whether a text is null or has no word."""
    return F.coalesce(~F.col(text).rlike(r"[^\x09-\x0D\x20]"), F.lit(True))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``df``."""
    rows, classes, comp = _grouped(df, id_col, text_col)
    linked = classes.select("c", "rep").join(comp, "c")
    least = linked.select("c", "comp").join(linked.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("c", "least")
    named = classes.select("c", "k1", "k2", "n", "rep").join(least, "c", "left").select("k1", "k2", "n", F.coalesce("least", "rep").alias("component_id"))
    out = rows.join(named, ["k1", "k2", "n"], "left")
    component = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op4_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))


_WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), [])"

OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - least(len(w), {SHINGLE}) + 2)) AS i, least(len(w), {SHINGLE}) AS m, w FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + m - 1], ' ')) AS h FROM g),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS nn FROM s a JOIN s b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * nn >= {SIMILARITY} * (na.n + nb.n - nn)),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

QUERIES = {"op4_near_duplicates": op4_near_duplicates}
ORACLES = {"op4_near_duplicates": OP4_SQL}
