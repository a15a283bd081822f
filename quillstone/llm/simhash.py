"""SimHash near-duplicates: fingerprints embedded as counts of bits in segments, joined on a grid.

A fingerprint of 64 bits holds the majority vote of its text's shingle hashes on each
bit. Its 32 segments of two bits have 0, 1 or 2 bits set; those counts are its point.
A differing bit moves one count by one or, with another, not at all, so the
Manhattan distance of two points is at most the Hamming distance of their fingerprints.
Counts are written in unary (00, 01, 11), where that distance is the number of
differing bits of the codes.

The grid has a cell for each point of a half (16 counts). Of two points within
distance 3, one half is within distance 1: the halves are equal, or one count differs
by one. Every fingerprint stands in its cell of both halves; one whose counts of a half
have an odd sum is also posted in the cells next to it, whose sums are even. So two
close fingerprints share the list of a cell in which one of them stands.

Pairs are not formed within whole lists. Each entry is first compared with the head
of its list, the fingerprint there that most rows have. Entries of lists that still hold several
components are then compared across these, in blocks of at most about ``BLOCK`` entries
that numpy takes against each other: the distance of the points first, then the bits. A block gives a pair
of components once. Components come from label propagation. The lists hold distinct
fingerprints; rows meet their component by their fingerprint at the end.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like
any other; texts of one or two words have the whole sequence as their one shingle; very
long texts are hashed in pieces of ``PIECE`` bytes cut at white space, so a worker holds
the text's bytes and little more; equal rows have equal results; a bit set in just half
the hashes is 0; a null id never becomes a component's id unless the component has no
other; an empty table gives an empty table; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, load, map_batches, text_buffers
from .neardup import components

SHINGLE = 3
SEED = 42
DISTANCE = 3  #: bits in which linked fingerprints differ at most
PIECE = 1 << 20  #: bytes of a text that are split into words at a time
BLOCK = 2048  #: entries of a list that one comparison takes from each side

_GAP = re.compile(rb"[\x20\x09-\x0D]")
LOW = 0x5555555555555555  #: the lower bit of each segment


def pieces(data: memoryview, size: int) -> Iterator[bytes]:
    """``data`` in pieces of ``size`` bytes or a little more, cut at white space."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size)
        end = gap.end() if gap else len(data)
        yield bytes(data[at:end])
        at = end


def fingerprint(data: memoryview, size: int = PIECE) -> int:
    """The fingerprint of a UTF-8 text: bit i is set if it is in over half of the hashes of its shingles."""
    votes, n, words = np.zeros(64, np.int64), 0, []
    for piece in pieces(data, size):
        words += piece.lower().split()
        if len(words) >= SHINGLE:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-SHINGLE].tolist()]
            stops = (ends[SHINGLE - 1 :] - 1).tolist()
            h = np.fromiter((xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, len(stops))
            for lo in range(0, len(h), 1 << 16):
                votes += np.unpackbits(h[lo : lo + (1 << 16)].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
            n += len(h)
            words = words[1 - SHINGLE :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def _fingerprint_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    data, ends = text_buffers(batch.column(1))
    view, ends = memoryview(data), ends.tolist()
    prints = np.fromiter((fingerprint(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)), np.uint64, len(batch))
    yield {"id": batch.column(0), "fp": prints.view(np.int64)}


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of each row of ``df``, fp as a signed 64-bit number."""
    kind = df.schema[id_col].dataType.simpleString()
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), _fingerprint_batch, f"id {kind}, fp long")


def unary(fp: Column) -> Column:
    """The counts of the 32 segments in unary: the low bit of a segment if one bit is set, both if two are."""
    upper = F.shiftrightunsigned(fp, 1)
    one = fp.bitwiseOR(upper).bitwiseAND(F.lit(LOW))
    return one.bitwiseOR(F.shiftleft(fp.bitwiseAND(upper).bitwiseAND(F.lit(LOW)), 1))


def _cells(half: Column) -> Column:
    """(cell, home) of the cells in which a half's 32-bit code is posted: its own and, if its sum is odd, those at distance 1."""
    cells = [F.struct(half.alias("cell"), F.lit(True).alias("home"))]
    odd = F.bit_count(half) % 2 == 1
    for at in range(0, 32, 2):
        low, high = F.lit(1 << at), F.lit(2 << at)
        for bit, may in ((low, half.bitwiseAND(high) == 0), (high, half.bitwiseAND(low) != 0)):
            cells.append(F.when(odd & may, F.struct(half.bitwiseXOR(bit).alias("cell"), F.lit(False).alias("home"))))
    return F.array_compact(F.array(*cells))


def postings(points: DataFrame) -> DataFrame:
    """(list, fp, m, home) of the points (fp, m): the lists of both halves; ``home`` tells those that stand in the list's cell."""
    code = unary(F.col("fp"))
    halves = points.select("fp", "m", F.posexplode(F.array(code.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(code, 32))).alias("half", "code"))
    cells = halves.select("fp", "m", F.shiftleft(F.col("half").cast("long"), 32).alias("half"), F.explode(_cells(F.col("code"))).alias("at"))
    return cells.select(F.col("at.cell").bitwiseOR(F.col("half")).alias("list"), "fp", "m", F.col("at.home").alias("home"))


def _close(a: Column, b: Column) -> Column:
    """The distance of the points bounds that of the fingerprints from below; these are compared where it allows it."""
    near = F.bit_count(unary(a).bitwiseXOR(unary(b))) <= DISTANCE
    return near & (F.bit_count(a.bitwiseXOR(b)) <= DISTANCE)


def _unary(x: np.ndarray) -> np.ndarray:
    upper, low = x >> np.uint64(1), np.uint64(LOW)
    return ((x | upper) & low) | ((x & upper & low) << np.uint64(1))


def _blocks_batch(batch: pa.RecordBatch) -> Iterator[dict]:
    (xs, xe), (ys, ye) = (_entries(batch.column(c)) for c in (0, 1))
    u, v = [], []
    for i in range(len(batch)):
        (xf, xc, xh), (yf, yc, yh) = ([a[e[i] : e[i + 1]] for a in s] for s, e in ((xs, xe), (ys, ye)))
        near = np.bitwise_count(_unary(xf)[:, None] ^ _unary(yf)) <= DISTANCE
        near &= (xc[:, None] != yc) & (xh[:, None] | yh)
        at, to = np.nonzero(near)
        good = np.bitwise_count(xf[at] ^ yf[to]) <= DISTANCE
        links = np.unique(np.stack([xc[at[good]], yc[to[good]]]), axis=1)
        u.append(links.min(axis=0))
        v.append(links.max(axis=0))
    yield {"u": np.concatenate(u) if u else np.zeros(0, np.int64), "v": np.concatenate(v) if v else np.zeros(0, np.int64)}


def _entries(column: pa.ListArray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """Fingerprint, component and home of the entries of all lists, and the lists' ends."""
    entries, sizes = column.flatten(), column.value_lengths().to_numpy(zero_copy_only=False)
    fp, comp, home = (entries.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    return (fp.view(np.uint64), comp, home.astype(bool)), np.concatenate([[0], np.cumsum(sizes)])


def _across(tables: Tables, posted: DataFrame, comp: DataFrame) -> DataFrame:
    """(u, v): components of which two entries of one list are close; the largest component of a list isn't compared with itself."""
    known = posted.join(comp.withColumnRenamed("c", "fp"), "fp", "left").select("list", "fp", F.coalesce("comp", "fp").alias("comp"), "home")
    parts = known.groupBy("list", "comp").agg(F.count("*").alias("m"))
    mixed = parts.groupBy("list").agg(F.count("*").alias("parts"), F.sum("m").alias("all"), F.max(F.struct("m", "comp")).alias("most"))
    mixed = tables.write(mixed.where("parts > 1").select("list", F.col("most.comp").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("blocks")))
    held = tables.write(known.join(mixed, "list"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    # a block of a list is bounded, but a list in many blocks is not to meet in one task: the other side's blocks go to each of them
    own = held.groupBy("list", "blocks", block.alias("block")).agg(F.collect_list(F.struct("fp", "comp", "home")).alias("x"))
    rest = held.where("comp <> main").groupBy("list", "blocks", block.alias("other")).agg(F.collect_list(F.struct("fp", "comp", "home")).alias("y"))
    rest = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return map_batches(own.join(rest, ["list", "block"]).select("x", "y"), _blocks_batch, "u long, v long").distinct()


def link_fingerprints(tables: Tables, points: DataFrame) -> DataFrame:
    """(fp, comp) of the distinct fingerprints ``points`` (fp, m: its rows) that are linked with others; components are named by a fingerprint."""
    posted = postings(points)
    heads = posted.groupBy("list").agg(F.count("*").alias("n"), F.max(F.struct("home", "m", "fp")).alias("head"))
    heads = tables.write(heads.where("n > 1 and head.home").select("list", F.col("head.fp").alias("head")))
    shared = tables.write(posted.join(heads, "list"))
    star = shared.where((F.col("fp") != F.col("head")) & _close(F.col("fp"), F.col("head")))
    links = tables.write(star.select(F.least("fp", "head").alias("u"), F.greatest("fp", "head").alias("v")).distinct())
    comp = components(tables, links)
    further = tables.write(_across(tables, shared.select("list", "fp", "home"), comp))
    tables.drop(shared)
    joined = components(tables, further).withColumnRenamed("comp", "far")
    single = joined.select("c").join(comp, "c", "left_anti").select("c", F.col("c").alias("comp"))
    whole = comp.unionByName(single).join(joined.withColumnRenamed("c", "comp"), "comp", "left")
    return tables.write(whole.select(F.col("c").alias("fp"), F.coalesce("far", "comp").alias("comp")))


def near_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hexadecimal digits, component_id) of each row of ``df``."""
    tables = Tables(df.sparkSession)
    rows = tables.write(fingerprints(df, id_col, text_col))
    points = tables.write(rows.groupBy("fp").agg(F.count("*").alias("m"), F.min("id").alias("rep")))
    linked = points.select("fp", "rep").join(link_fingerprints(tables, points.select("fp", "m")), "fp")
    linked = tables.write(linked)
    least = linked.select("fp", "comp").join(linked.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("fp", "least")
    named = tables.write(points.select("fp", "rep").join(least, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")))
    out = rows.join(named, "fp", "left")
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_simhash(spark, sf_dir: str) -> DataFrame:
    return near_fingerprints(load(spark, sf_dir, "documents"))


QUERIES = {"op11_simhash": op11_simhash}
ORACLES: dict[str, str] = {}
