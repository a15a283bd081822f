"""Shared plumbing of the training-data operators.

Everything here is independent of the size of the input: batches reach Python
through Arrow and are cut into slices of bounded bytes before numpy touches
them, and intermediate tables go to the folder in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; bounds a worker's temporaries.
SLICE_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python, unless the session names another number.
BATCH_BYTES = 8 << 20


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``; make a folder only where none is named (tests)."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillstone-"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from the files, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # shuffle files of the steps before go once the driver's collector finds them unused; asking for it keeps disks from filling up
    spark.sparkContext._jvm.System.gc()
    return df.checkpoint(eager=True)


class Tables:
    """Intermediate tables of one run: Parquet in a folder of its own within the shared checkpoint folder.

    Unlike checkpointed rows they keep their columns apart and their sizes known, so
    that later steps read only what they use and small sides are broadcast. ``drop``
    removes one that nothing reads any more; the rest goes when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.folder = f"{spark.conf.get('spark.checkpoint.dir', None) or spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}"
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._tables: list[tuple[DataFrame, str]] = []
        atexit.register(self._remove, self.folder)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self._tables)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables.append((out, path))
        self._jvm.System.gc()  # the driver's collector finds shuffle files that nothing uses any more
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df, path in self._tables:
            if any(df is x for x in frames):
                self._remove(path)

    def _remove(self, path: str) -> None:
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self._conf).delete(at, True)


def crc_mod(column: str, m: int):
    """crc32(column as text) mod m; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)


def whole_texts(rows: DataFrame, each: int, most_bytes: int, most_rows: int) -> dict:
    """The first ``each`` texts of each key of ``rows`` (key, h, text), by h: whole texts, as many as ``most_bytes`` of a key hold, one at least.

    Sizes come to the driver first, so that it never holds more text than that (but for
    rows of equal h); ``most_rows`` bounds the rows looked at.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    got: dict = {}
    full = set()
    for r in rows.select("key", "h", size.alias("n")).orderBy("h", "key").limit(most_rows).collect():
        count, total, _ = got.get(r["key"], (0, 0, None))
        if count and total + r["n"] > most_bytes:
            full.add(r["key"])
        if r["key"] not in full and count < each:
            got[r["key"]] = (count + 1, total + r["n"], r["h"])
    if not got:
        return {}
    last = F.create_map(*[F.lit(v) for key, (_, _, h) in got.items() for v in (key, h)])
    texts: dict = {}
    for r in rows.where(F.col("h") <= F.try_element_at(last, F.col("key"))).select("key", "h", "text").orderBy("h", "key").limit(most_rows).collect():
        if len(mine := texts.setdefault(r["key"], [])) < got[r["key"]][0]:
            mine.append(bytes(r["text"] or b""))
    return texts


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary Arrow array as (bytes, offsets); nulls count as empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges (lo, hi) of about ``limit`` bytes; a longer text stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches, of which every running task holds some outside the heap, to BATCH_BYTES where nobody has chosen a size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, str(BATCH_BYTES))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict]], schema: str) -> DataFrame:
    """mapInArrow with ``fn`` giving dictionaries of equally long arrays for each input batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in fn(batch):
                arrays = [x if isinstance(x, pa.Array) and x.type == f.type else _cast(x, f.type) for x, f in zip(out.values(), arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def _cast(x, kind: pa.DataType) -> pa.Array:
    if isinstance(x, pa.ChunkedArray):
        x = x.combine_chunks()
    return x.cast(kind) if isinstance(x, pa.Array) else pa.array(x, kind)


#: Constants of the 64-bit finaliser of splitmix64.
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x *= MIX_1
        x ^= x >> np.uint64(27)
        x *= MIX_2
        x ^= x >> np.uint64(31)
    return x


class PrefixHash:
    """Prefix polynomial hashes mod 2^64 of a byte array: ``at(i, j)`` hashes bytes[i:j] for arrays i, j.

    H(i, j) = sum of (mixed byte at t) * BASE^(i - t) over t in [i, j); BASE is odd,
    so its powers are invertible. The bytes are mixed first, and the result is
    mixed again, so that the weak low bits of the modulus do not show.
    """

    BASE = np.uint64(0x9FB21C651E98DF25)
    INVERSE = np.uint64(pow(0x9FB21C651E98DF25, -1, 1 << 64))
    _bytes = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN)
    _powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))

    @classmethod
    def powers(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        """BASE^t and BASE^-t for t below n at least."""
        if len(cls._powers[0]) < n:
            size = 1 << max(12, (n - 1).bit_length())
            with np.errstate(over="ignore"):
                out = []
                for base in (cls.BASE, cls.INVERSE):
                    steps = np.full(size, base, np.uint64)
                    steps[0] = 1
                    out.append(np.multiply.accumulate(steps))
            cls._powers = tuple(out)
        return cls._powers

    def __init__(self, data: np.ndarray):
        up, self.down = self.powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.empty(len(data) + 1, np.uint64)
            self.sums[0] = 0
            np.cumsum(self._bytes[data] * up[: len(data)], out=self.sums[1:])

    def at(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.sums[j] - self.sums[i]) * self.down[i])

    def parts(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What ``equal`` needs of starts."""
        return i, self.sums[i], self.down[i]

    def equal(self, a: tuple, b: tuple, n: np.ndarray | int) -> np.ndarray:
        """Whether the pieces of ``n`` bytes from two ``parts`` have one hash; the last mixing, a bijection, is left out."""
        with np.errstate(over="ignore"):
            return (self.sums[a[0] + n] - a[1]) * a[2] == (self.sums[b[0] + n] - b[1]) * b[2]

    def rolling(self, size: int) -> np.ndarray:
        """Hashes of all pieces of ``size`` bytes, in order of their starts."""
        n = len(self.sums) - size
        with np.errstate(over="ignore"):
            return mix64((self.sums[size:] - self.sums[:n]) * self.down[:n])
