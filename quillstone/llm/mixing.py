"""Mixing sources to target weights, in DataFrame operations only.

Every source's texts are laid end to end, in an order that a hash of the id
fixes, and packed into blocks of ``BLOCK`` tokens, whatever the table's size; a source's last
block may be shorter. The output is a row of shards of ``SHARD_SLOTS`` block-sized
slots. A source has the whole slots of its expected number in a shard for certain; the slots that the
fractions leave are drawn, each with the fractions as probabilities, so that
the source counts of a shard are multinomial about what is expected and no source strays from its target by more
than a few blocks. The slots of one source, numbered
through all shards, are mapped to its blocks by keyed pseudorandom permutations of
the block indices, a new one for each pass through the source, and a join by block
index gives each text the tokens that are taken of it. No pass is begun beyond the
third, so no text is taken more than three times; slots beyond it stay empty.

No step brings a source together in one task: offsets are sums over buckets of
texts, then within a bucket; slots are numbered by groups of shards, then within a
group, and dealt out by source and shard; blocks are dealt by block index. The
table of sources has one row a source; its size is known when it is joined.

Defined cases: a null text has size 0, and null sources form one source, last in
order; texts of size 0 take nothing; a table without words has targets of 0;
further columns that have the name of a result give way to it;
repeated rows are rows of their own, each with its share of the tokens (only
rows equal in id and size are interchangeable); an empty table gives an empty
table; extra columns are ignored. Reruns agree, as every draw is a hash of
``seed``, source, shard and pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables, load

BLOCK = 32  #: tokens of a block
SHARD_SLOTS = 4096  #: slots of an output shard
GROUP_SHARDS = 1024  #: shards whose slots of a source are numbered in one task
CELLS = 1024  #: parts of the line of shares, by which slots meet their sources
BUCKET_ROWS = 65536  #: texts of a bucket, all sources together, once there are more than LEAST_BUCKETS of them
LEAST_BUCKETS = 64
MOST_PASSES = 3
SEED = 20240
ROUNDS = 4  #: of the keyed permutation
WALK = 64  #: steps of its walk back into the range: of n places fewer than sqrt(n) + 1 lie outside it

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(src, source_size, weight, target) from (src, size): weights 1, 2, 3, repeating, by code point, nulls last.

    A source is full once the level (tokens a unit of weight) reaches
    3 * size / weight. In order of that bound, the sources before the first
    that the remaining tokens cannot fill are full; the rest share by weight.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("src").asc_nulls_last())
    per = per.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("long"))
    cap = F.col("source_size") * 3
    level = Window.orderBy(cap / F.col("weight"), F.col("src").asc_nulls_last())
    total = Window.partitionBy()
    per = (
        per.withColumn("cap", cap)
        .withColumn("before", F.coalesce(F.sum("cap").over(level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("open", F.sum("weight").over(level.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(total))
    )
    water = (F.col("all") - F.col("before")) / F.col("open")
    # exact in integers: the source is not full if cap * open > (all - before) * weight
    free = F.col("cap").cast("decimal(38,0)") * F.col("open") > (F.col("all") - F.col("before")).cast("decimal(38,0)") * F.col("weight")
    first = F.min(F.when(free, F.struct(F.col("place"), water.alias("water")))).over(total)["water"]
    return per.withColumn("place", F.row_number().over(level)).withColumn("level", first).select(
        "src", "source_size", "weight", F.when((F.col("level").isNull()) | (F.col("level") * F.col("weight") >= F.col("cap")), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target")
    )


def _uniform(*parts) -> Column:
    """A number in [0, 1) that a hash of the parts fixes."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def drawn(shares: DataFrame, shards: int, slots: int, first: int = 0) -> DataFrame:
    """(shard, sid, n): the source counts of ``shards`` shards of ``slots`` slots each, numbered from ``first``.

    ``shares`` (sid, share) add up to 1. Each source has floor(slots * share) slots of a shard; a hash of its number draws the source of each
    slot left over by what the floors have cut off.
    """
    empty = shares.sparkSession.createDataFrame([], "shard long, sid int, n long")
    if not shards or not slots:
        return empty
    cut_ = shares.withColumn("sure", F.floor(F.col("share") * slots)).withColumn("part", F.col("share") * slots - F.col("sure"))
    left = slots - (cut_.agg(F.sum("sure")).first()[0] or 0)
    groups = -(-shards // GROUP_SHARDS)
    # a row a source and shard, made in groups so that no array of shards is long
    each = cut_.where("sure > 0").select("sid", "sure", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group")).repartition("sid", "group")
    of = F.sequence((F.col("group") * GROUP_SHARDS).cast("long"), (F.least((F.col("group") + 1) * GROUP_SHARDS, F.lit(shards)) - 1).cast("long"))
    sure = each.select(F.explode(of).alias("shard"), "sid", F.col("sure").cast("long").alias("n"))
    if left <= 0:
        return sure.withColumn("shard", F.col("shard") + first)
    line = Window.orderBy("sid")
    ends = F.sum("part").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) / F.sum("part").over(Window.partitionBy())
    lots = cut_.where("part > 0").select("sid", ends.alias("hi")).select("sid", F.coalesce(F.lag("hi").over(line), F.lit(0.0)).alias("lo"), "hi", F.lead("hi").over(line).isNull().alias("last"))
    lots = lots.withColumn("hi", F.when(F.col("last"), F.lit(2.0)).otherwise(F.col("hi")))  # whatever rounding leaves belongs to the last
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1))
    lots = lots.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    slot = shares.sparkSession.range(shards * left).select(F.floor(F.col("id") / left).alias("shard"), _uniform(F.lit(SEED), F.lit("slot"), F.col("id"), F.lit(first)).alias("u"))
    some = slot.withColumn("cell", F.floor(F.col("u") * CELLS)).join(lots, "cell").where("u >= lo AND u < hi").select("shard", "sid", F.lit(1).cast("long").alias("n"))
    return sure.unionByName(some).groupBy("shard", "sid").agg(F.sum("n").alias("n")).withColumn("shard", F.col("shard") + first)


def grid(n: Column) -> tuple[Column, Column]:
    """(ceil(sqrt(n)), ceil(n / that)): the sides of the least such grid with room for n places."""
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    return a, F.ceil(n / a).cast("long")


def _round(k: int, left: Column, right: Column, a: Column, b: Column, key: tuple[Column, ...]) -> tuple[Column, Column]:
    """One Feistel round on a row and a column of the grid."""
    if k % 2 == 0:
        return (left + F.pmod(F.xxhash64(F.lit(SEED), F.lit(k), right, *key), a)) % a, right
    return left, (right + F.pmod(F.xxhash64(F.lit(SEED), F.lit(k), left, *key), b)) % b


def permuted(df: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """``df`` (x, n, a, b, key ...), a and b the grid of n, with ``place``: that of x in a pseudorandom permutation of 0 ... n - 1 that the key fixes.

    Feistel rounds on the row and column of x in the grid permute a range a little
    larger than n; a place outside n is permuted again until it lies inside.
    """
    n, a, b, by = F.col("n"), F.col("a"), F.col("b"), tuple(F.col(k) for k in key)

    def again(y: Column) -> Column:
        left, right = F.floor(y / b), y % b
        for k in range(ROUNDS):
            left, right = _round(k, left, right, a, b, by)
        return (left * b + right).cast("long")

    out = df.withColumns({"_l": F.floor(F.col("x") / b), "_r": F.col("x") % b})
    for k in range(ROUNDS):  # a projection a round, so that each value is worked out once
        left, right = _round(k, F.col("_l"), F.col("_r"), a, b, by)
        out = out.withColumns({"_l": left, "_r": right})
    out = out.withColumn("_y", (F.col("_l") * b + F.col("_r")).cast("long"))
    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col("_y"), lambda s, _: F.when(s < n, s).otherwise(again(s)))
    return out.withColumn("place", F.when(F.col("_y") < n, F.col("_y")).otherwise(walk)).drop("_l", "_r", "_y")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", columns: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken, further ``columns``) for each row of ``df``.

    The numbers are made from ids, sources and sizes alone; with ``columns``,
    these travel along from the first read, written to the checkpoint folder.
    """
    columns = tuple(c for c in columns if c not in (id_col, "size", "source_size", "target", "taken"))
    spark = df.sparkSession
    tables = Tables(spark)
    rows = tables.write(df.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("src"), n_words(F.col(text_col)).alias("size"), *[F.col(c).alias(f"_x{k}") for k, c in enumerate(columns)]))
    targets = tables.write(source_targets(rows).withColumn("sid", F.row_number().over(Window.orderBy(F.col("src").asc_nulls_last())).cast("int")))
    n_rows, block = rows.count(), BLOCK
    buckets = max(LEAST_BUCKETS, -(-n_rows // BUCKET_ROWS))

    known = rows.join(targets.withColumnRenamed("src", "_src"), F.col("src").eqNullSafe(F.col("_src"))).drop("src", "_src")
    known = known.withColumn("bucket", F.pmod(F.xxhash64(F.lit(SEED), "_id", "size"), F.lit(buckets)).cast("int"))
    # offsets of the buckets within their source, then of the rows within their bucket
    packed = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = known.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size")).select("sid", "bucket", F.coalesce(F.sum("bucket_size").over(packed), F.lit(0)).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = known.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["sid", "bucket"]).withColumn("start", F.col("base") + F.col("within"))
    placed = tables.write(placed.withColumn("row", F.monotonically_increasing_id()).drop("base", "within", "bucket", "weight"))

    # slots of each source, numbered through the shards, and the blocks that they take
    blocks = targets.select("sid", "target", "source_size", F.ceil(F.col("source_size") / block).cast("long").alias("blocks"))
    wanted = blocks.where("target > 0").select("sid", (F.col("target") * F.col("blocks") / F.col("source_size")).alias("slots"))
    total = wanted.agg(F.coalesce(F.sum("slots"), F.lit(0.0))).first()[0]
    slots = math.ceil(total)
    shares = tables.write(wanted.select("sid", (F.col("slots") / F.lit(max(total, 1e-9))).alias("share")))
    full, tail = divmod(slots, SHARD_SLOTS)
    draws = drawn(shares, full, SHARD_SLOTS).unionByName(drawn(shares, 1 if tail else 0, tail, full))
    draws = tables.write(draws.withColumn("group", F.floor(F.col("shard") / GROUP_SHARDS)))
    group = Window.partitionBy("sid").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    groups = draws.groupBy("sid", "group").agg(F.sum("n").alias("m")).select("sid", "group", F.coalesce(F.sum("m").over(group), F.lit(0)).alias("base"))
    shard = Window.partitionBy("sid", "group").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = draws.withColumn("before", F.coalesce(F.sum("n").over(shard), F.lit(0))).join(groups, ["sid", "group"])
    blocks = blocks.select("sid", "blocks", *[side.alias(name) for side, name in zip(grid(F.col("blocks")), ("a", "b"), strict=True)])
    numbered = numbered.select("sid", "shard", (F.col("base") + F.col("before")).alias("first"), "n").join(blocks, "sid").repartition("sid", "shard")
    turns = numbered.select("sid", "blocks", "a", "b", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("slot")).where(F.col("slot") < F.col("blocks") * MOST_PASSES)
    turns = turns.select("sid", F.col("blocks").alias("n"), "a", "b", F.floor(F.col("slot") / F.col("blocks")).alias("turn"), (F.col("slot") % F.col("blocks")).alias("x"))
    taken = permuted(turns, ("sid", "turn")).select("sid", F.col("place").alias("block")).groupBy("sid", "block").agg(F.count("*").alias("times"))

    # the join by block index
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = placed.where("size > 0").select("row", "sid", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.greatest(F.col("start"), F.col("block") * block)
    got = parts.select("row", "sid", "block", overlap.alias("overlap")).join(taken, ["sid", "block"]).groupBy("row").agg(F.sum(F.col("overlap") * F.col("times")).alias("taken"))
    out = placed.join(got, "row", "left")
    return out.select(F.col("_id").alias(id_col), F.col("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *[F.col(f"_x{k}").alias(c) for k, c in enumerate(columns)])


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents"))


QUERIES = {"op3_mixing": op3_mixing}
ORACLES: dict[str, str] = {}
