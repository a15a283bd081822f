"""Plans of research and writing: queries, evidence, numbering, differences, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import cases, s
from .store import cut

#: Dimensions of research in order, the letters of their items, and the sections that take their evidence.
DIMENSIONS = ("literature", "news", "report", "policy", "competitor")
PREFIX = {"literature": "L", "news": "N", "report": "R", "policy": "P", "competitor": "C"}
SECTIONS = {"literature": ("4", "6"), "competitor": ("2",), "policy": ("1", "5"), "report": ("1",), "news": ("1",)}
MOST_EVIDENCE = 6


def rank_of(c: Column, order: tuple[str, ...]) -> Column:
    return cases([(c == v, i) for i, v in enumerate(order)], len(order))


def query_matrix(briefs: DataFrame) -> DataFrame:
    """(project, dimension, query) of briefs (project, name, company, moa, indications, competitors, terms); empty parts are left out."""
    name, ind = F.trim(s(F.col("name"))), F.trim(F.coalesce(F.get(F.filter("indications", lambda x: F.trim(x) != ""), F.lit(0)), F.lit("")))
    join = lambda *p: F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in p])
    lit = F.lit
    q = lambda dim, cond, text: F.when(cond, F.struct(lit(dim).alias("dimension"), text.alias("query")))
    has_name, has_ind = name != "", ind != ""
    fixed = F.array(
        q("literature", has_name, join(name, ind, lit("clinical trial"))),
        q("literature", has_name, join(name, lit("safety efficacy"))),
        q("literature", has_name & (s(F.col("moa")) != ""), join(name, F.col("moa"))),
        q("literature", has_ind, join(ind, lit("treatment guideline"))),
        q("news", has_name, join(name, lit("获批 上市 进展"))),
        q("news", s(F.col("company")) != "", join(F.col("company"), F.when(has_name, name).otherwise(ind), lit("动态"))),
        q("report", has_ind, join(ind, lit("市场规模 流行病学 研报"))),
        q("report", ~has_ind & has_name, join(name, lit("市场 竞争格局"))),
        q("policy", has_ind, join(ind, lit("医保 支付 政策"))),
        q("policy", lit(True), lit("药品审评审批 医保谈判 最新政策")),
    )
    rivals = F.filter("competitors", lambda x: F.trim(x) != "")
    others = F.transform(rivals, lambda c: F.struct(lit("competitor").alias("dimension"), join(F.trim(c), ind, lit("临床 进展")).alias("query")))
    alone = F.array(q("competitor", (F.size(rivals) == 0) & has_name, join(name, lit("同类 竞品 对比"))))
    terms = F.transform(F.filter("terms", lambda t: has_ind & (F.trim(t) != "")), lambda t: F.struct(lit("literature").alias("dimension"), join(ind, t).alias("query")))
    every = F.filter(F.concat(fixed, others, alone, terms), lambda x: x.isNotNull())
    return briefs.select("project", F.explode(F.array_distinct(every)).alias("q")).select("project", "q.*")


def numbered(items: DataFrame, by: str = "project", order: str = "ord") -> DataFrame:
    """``items`` (by, dimension, key, ...) with ids as ``L001``: the first row of each key, counted on within its dimension."""
    first = items.groupBy(by, "dimension", "key").agg(F.min_by(F.struct(*[c for c in items.columns if c not in (by, "dimension", "key")]), order).alias("r")).select(by, "dimension", "key", "r.*")
    prefix = cases([(F.col("dimension") == d, p) for d, p in PREFIX.items()], "X")
    n = F.col("_rank").cast("string")
    return ranked(first, (by, "dimension"), (order, "key"), "_rank").withColumn("item", F.concat(prefix, F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))).drop("_rank")


def evidence_of(items: DataFrame, by: str = "project", most: int = MOST_EVIDENCE) -> DataFrame:
    """(by, section, n, items): the sections' evidence in order of dimension, then item, at most so many each."""
    pairs = [F.struct(F.lit(d).alias("d"), F.lit(x).alias("section")) for d, xs in SECTIONS.items() for x in xs]
    x = items.withColumn("t", F.explode(F.array(*pairs))).where(F.col("t.d") == F.col("dimension"))
    # numbers of more than three figures come after the shorter ones
    x = x.select(by, F.col("t.section").alias("section"), "item", rank_of(F.col("dimension"), DIMENSIONS).alias("_dim"), F.length("item").alias("_size"))
    top = first_rows(x, f"{by},section", ["_dim", "_size", "item"], most, rank="r")
    g = top.groupBy(by, "section").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("r", "item"))).alias("i"))
    return g.select(by, "section", "n", F.array_join(F.transform("i", lambda v: v["item"]), ",").alias("items"))


def outline_changes(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """(by, n_before, n_after, added, removed, expanded): sections (by, title, points) matched by title without case."""
    side = lambda d, c: d.groupBy(by, F.lower(F.trim("title")).alias("_title")).agg(F.max("points").alias(c))
    x = side(before, "b").join(side(after, "a"), [by, "_title"], "full_outer")
    return x.groupBy(by).agg(F.count("b").alias("n_before"), F.count("a").alias("n_after"), F.count_if(F.col("b").isNull()).alias("added"), F.count_if(F.col("a").isNull()).alias("removed"), F.count_if(F.col("a") > F.col("b")).alias("expanded"))


def coverage(truth: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """(unit, wanted, found) for per cents, months and ten thousands: which of a text's figures were seen; ``row`` counts rows with half of theirs."""
    units = {"%": r"\d+\.?\d*%", "月": r"\d+\.?\d*月", "万": r"\d+\.?\d*万"}
    x = truth.join(seen, key, "left")
    for i, (_, p) in enumerate(units.items()):
        want = F.array_distinct(F.regexp_extract_all(s(F.col("text")), F.lit(p), F.lit(0)))
        x = x.withColumn(f"w{i}", F.size(want)).withColumn(f"h{i}", F.size(F.array_intersect(want, F.coalesce("points", F.array().cast("array<string>")))))
    total, hit = F.col("w0") + F.col("w1") + F.col("w2"), F.col("h0") + F.col("h1") + F.col("h2")
    good = (total == 0) | (hit / F.nullif(total, F.lit(0)) >= 0.5)
    a = x.agg(*[F.sum(f"{c}{i}").alias(f"{c}{i}") for i in range(3) for c in "wh"], F.count("*").alias("w3"), F.count_if(good).alias("h3"))
    rows = F.array(*[F.struct(F.lit(u).alias("unit"), F.coalesce(f"w{i}", F.lit(0)).cast("long").alias("wanted"), F.coalesce(f"h{i}", F.lit(0)).cast("long").alias("found")) for i, u in enumerate([*units, "row"])])
    return a.select(F.explode(rows).alias("r")).select("r.*")


def step_matrix(checks: DataFrame, steps: list[str], by: str = "project") -> DataFrame:
    """(by, a column for each step, failed): whether every check of a step passed; a step without checks is null."""
    p = checks.groupBy(by).pivot("step", steps).agg(F.bool_and("ok"))
    failed = F.filter(F.array(*[F.when(~F.col(f"`{x}`"), F.lit(x)) for x in steps]), lambda v: v.isNotNull())
    return p.withColumn("failed", F.array_join(failed, ","))


def by_priority(df: DataFrame, kind: str, order: tuple[str, ...], by: str, place: str) -> DataFrame:
    """``df`` with ``rank`` in its group: known kinds in their order, unknown ones last, then by ``place``."""
    return ranked(df.withColumn("_kind", rank_of(F.col(kind), order)), (by,), ("_kind", place), "rank").drop("_kind")


def ranked(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...], name: str) -> DataFrame:
    """``df`` with the place of each row in its group, from 1, in an order that should be total.

    Rows are laid out in ranges of group and order, so that a large group lies in several; a row counts on from what its
    group has in the ranges before. A range is a task's work, a group is not.
    """
    laid = cut(df.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    # a row a group and range
    parts = laid.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    same = [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(by)]
    counted = laid.withColumn("_here", here).join(parts, [(F.col("_part") == F.col("_p")), *same])
    return counted.withColumn(name, (F.col("_here") + F.col("_before")).cast("int")).drop("_here", "_before", "_part", "_p", *[f"_{i}" for i in range(len(by))])


SPREAD = 64  #: parts of a group whose first rows are found apart


def first_rows(df: DataFrame, by: str, order: list, n: int, rank: str = "_r") -> DataFrame:
    """The first n rows of each group, as of a source's page; with their place if ``rank`` names a column. ``by`` may name several columns with commas.

    Each group's first rows are found in SPREAD parts first, so that no task holds a large group.
    """
    keys = by.split(",")
    part = df.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(SPREAD)))
    some = part.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_part")
    out = some.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)
    return out.drop(rank) if rank == "_r" else out


def test_cases(corrections: DataFrame) -> DataFrame:
    """(id, name, body) of generated checks for corrections (id, kind, input, expected)."""
    name = F.concat(F.lit("test_"), F.regexp_replace("id", "[^a-zA-Z0-9]", "_"))
    body = cases([(F.col("kind") == "missing", F.format_string("assert %s in result", F.col("expected"))), (F.col("kind") == "wrong_value", F.format_string("assert parse(%s) == %s", F.col("input"), F.col("expected")))], F.format_string("# %s: %s", F.col("kind"), F.col("input")))
    return corrections.select("id", name.alias("name"), body.alias("body"))


def cached(requests: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """``requests`` with value and hit from a cache (key, value): the first value stored under the key."""
    one = cache.groupBy(key).agg(F.min("value").alias("value"))
    return requests.join(one, key, "left").withColumn("hit", F.col("value").isNotNull())
