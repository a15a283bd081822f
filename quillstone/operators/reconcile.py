"""Comparing tables: by key, by row, by neighbourhood."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import cases, s


def row_diff(left: DataFrame, right: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """(key, status, first, all): rows only left, only right, or in both with the columns that differ once trimmed."""
    a = left.select(key, F.struct(*columns).alias("a"))
    b = right.select(key, F.struct(*columns).alias("b"))
    x = a.join(b, key, "full_outer")
    names = F.filter(F.array(*[F.when(F.trim(s(F.col(f"a.{c}"))) != F.trim(s(F.col(f"b.{c}"))), F.lit(c)) for c in columns]), lambda v: v.isNotNull())
    status = cases([(F.col("b").isNull(), "left_only"), (F.col("a").isNull(), "right_only"), (F.size(names) > 0, "differs")], "same")
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return x.select(key, status.alias("status"), F.when(both, F.coalesce(F.get(names, F.lit(0)), F.lit(""))).otherwise("").alias("first"), F.when(both, F.array_join(names, ",")).otherwise("").alias("all"))


def alignment(table: DataFrame, downloads: DataFrame, highlights: DataFrame, key: str) -> DataFrame:
    """(key, three flags, issue): in which of the three a key occurs, and what is missing first."""
    parts = [d.select(key).distinct().withColumn(f, F.lit(True)) for d, f in ((table, "in_table"), (downloads, "in_downloads"), (highlights, "in_highlights"))]
    x = parts[0].join(parts[1], key, "full_outer").join(parts[2], key, "full_outer")
    x = x.select(key, *[F.coalesce(f, F.lit(False)).alias(f) for f in ("in_table", "in_downloads", "in_highlights")])
    return x.withColumn("issue", cases([(~F.col("in_table"), "not_in_table"), (~F.col("in_downloads"), "not_downloaded"), (~F.col("in_highlights"), "not_highlighted")], "aligned"))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done yet; an empty key is never done."""
    return df.join(done.select(key).where(s(F.col(key)) != "").distinct(), key, "left_anti")


def set_relations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(relation, n): keys in both, only left, only right."""
    x = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    return x.groupBy(cases([(F.col("l").isNull(), "right_only"), (F.col("r").isNull(), "left_only")], "both").alias("relation")).agg(F.count("*").alias("n"))


def neighbours(df: DataFrame, group: str, place: str, reach: int = 5) -> DataFrame:
    """``df`` with the number of its group's rows at most ``reach`` places away.

    Places are cut into stretches; each row goes to its own and the two beside
    it and is counted within a stretch, so a large group is many tasks' work.
    """
    width = 64 * reach
    stretch = F.floor(F.col(place) / width)
    ext = df.select(group, place, F.explode(F.array_distinct(F.array(F.floor((F.col(place) - reach) / width), stretch, F.floor((F.col(place) + reach) / width)))).alias("_s"))
    w = Window.partitionBy(group, "_s").orderBy(place).rangeBetween(-reach, reach)
    counted = ext.withColumn("near", F.count("*").over(w)).where(F.col("_s") == stretch).select(group, place, (F.col("near") - 1).alias("near"))
    return df.join(counted.distinct(), [group, place])


def reconcile(online: DataFrame, local: DataFrame, key: str, text: str) -> DataFrame:
    """(key, action, text): online rows without a local one are deleted; the longer normalized text wins; others stay."""
    a, b = online.select(key, F.col(text).alias("a")), local.select(key, F.col(text).alias("b"))
    x = a.join(b, key, "left")
    x_, y_ = T.normalized(F.col("a")), T.normalized(F.col("b"))
    action = cases([(F.col("b").isNull(), "delete"), (x_ == y_, "keep"), (F.length(y_) > F.length(x_), "overwrite")], "keep_online")
    return x.select(key, action.alias("action"), F.when(action == "overwrite", F.col("b")).otherwise(F.col("a")).alias(text))


def context_lines(tables: DataFrame, texts: DataFrame, page: str = "page", above: float = 200, below: float = 100, most: int = 3) -> DataFrame:
    """(page, table, lines): of each table (y), the first ``most`` texts (y, line) at most so far above or below, top to bottom.

    Pages are cut into bands as high as the reach of a table, which looks into two of them: no page's lines meet all of its tables.
    """
    high = above + below
    band = lambda y: F.floor(y / high)
    looked = F.explode(F.sequence(band(F.col("y") - above), band(F.col("y") + below)))
    x = tables.select(page, "table", F.col("y").alias("ty"), looked.alias("_band")).join(texts.select(page, F.col("y").alias("ly"), "line", band(F.col("y")).alias("_band")), [page, "_band"])
    near = x.where(F.col("ly").between(F.col("ty") - above, F.col("ty") + below))
    order = Window.partitionBy(page, "table").orderBy("ly", "line")
    first = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most)
    g = first.groupBy(page, "table").agg(F.array_sort(F.collect_list(F.struct("r", "line"))).alias("t"))
    return g.select(page, "table", F.array_join(F.transform("t", lambda v: v["line"]), " / ").alias("lines"))


def nearest_pairs(names: DataFrame, values: DataFrame, page: str = "page", reach: float = 3.0) -> DataFrame:
    """(page, name, value, dist): names (name, y), top to bottom, each take the closest value (value, y) within reach that none has taken.

    The choice depends on the ones before, so a page's names are folded in
    order, within its row; pages are small.
    """
    a = names.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y", "name"))).alias("a"))
    b = values.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("y", "value"))).alias("b"))
    places = F.transform("b", lambda v, i: F.struct(v["y"].alias("y"), v["value"].alias("value"), i.alias("i")))
    x = a.join(b, page).withColumn("b", places)
    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<name:string,value:double,dist:double>>").alias("out"))

    def take(acc: Column, n: Column) -> Column:
        gap = lambda v: F.abs(v["y"] - n["y"])
        free = F.filter("b", lambda v: (gap(v) < reach) & ~F.array_contains(acc["used"], v["i"]))
        best = F.array_min(F.transform(free, lambda v: F.struct(gap(v).alias("d"), v["i"].alias("i"), v["value"].alias("value"))))
        row = F.struct(n["name"].alias("name"), best["value"].alias("value"), best["d"].alias("dist"))
        return F.when(best.isNull(), acc).otherwise(F.struct(F.array_append(acc["used"], best["i"]).alias("used"), F.array_append(acc["out"], row).alias("out")))

    return x.select(page, F.explode(F.aggregate("a", start, take)["out"]).alias("p")).select(page, "p.*")


def inventory(files: DataFrame, citations: DataFrame, highlighted: DataFrame, key: str = "pnx") -> DataFrame:
    """(slide, number, key, digest, highlighted, citation), by slide and number: what a folder of files holds."""
    n = lambda i: F.regexp_extract(key, r"^P(\d+)-(\d+)", i).cast("int")
    x = files.join(highlighted.select(key).distinct().withColumn("_h", F.lit(True)), key, "left").join(citations.select(key, F.col("context").alias("citation")), key, "left")
    return x.select(n(1).alias("slide"), n(2).alias("number"), key, "digest", F.coalesce("_h", F.lit(False)).alias("highlighted"), F.coalesce("citation", F.lit("")).alias("citation"))


def first_of(df: DataFrame, candidates: tuple[str, ...]) -> Column:
    """The first of the candidate columns that the table has, else nulls."""
    for c in candidates:
        if c in df.columns:
            return F.col(c)
    return F.lit(None).cast("string")
