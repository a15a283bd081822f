"""Fusing citations of several sources, grading them, and counting votes.

All folds are groupings with partial aggregation; a hot key costs one row a
task. Ties are settled by order of input, then by name, so results are the same
on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import cases, group_key, s
from .similarity import near_hashes, simhash
from .store import cut


def richness(cited_by: Column, fwci: Column, n_sources: Column) -> Column:
    return F.coalesce(cited_by, F.lit(0)) + 10 * F.coalesce(fwci, F.lit(0.0)) + 5 * n_sources


def fuse_by(df: DataFrame, key: Column) -> DataFrame:
    """One row a key: the richest (of equals the first), with the sources of all. Needs ord, cited_by, fwci, source_origin."""
    rich = richness(F.col("cited_by"), F.col("fwci"), F.size("source_origin"))
    row = F.struct(*df.columns)
    best = df.groupBy(key.alias("group_key")).agg(F.max_by(row, F.struct(rich, -F.col("ord"))).alias("best"), F.collect_set("source_origin").alias("all"), F.count("*").alias("n_merged"))
    origins = F.array_sort(F.array_distinct(F.flatten("all")))
    out = best.select("group_key", *[F.col(f"best.{c}").alias(c) for c in df.columns if c != "source_origin"], origins.alias("source_origin"), "n_merged")
    return out.withColumn("richness", richness(F.col("cited_by"), F.col("fwci"), F.size("source_origin")))


def fuse_citations(df: DataFrame) -> DataFrame:
    """Copies with one PMID or DOI become one row; rows without identifiers stay alone."""
    key = group_key(F.col("pmid"), F.col("doi"))
    return fuse_by(df, F.when(key == "", F.concat(F.lit("ord:"), F.col("ord").cast("string"))).otherwise(key))


def fuse_citations_by_title(df: DataFrame, strict: bool = False) -> DataFrame:
    """As fuse_citations, and rows without identifiers join by title.

    Such a row belongs to the first identified group (by key) whose first
    title's fingerprint differs in fewer than three bits; with ``strict`` it is
    dropped there. Those left over form groups around the earliest of them:
    a fingerprint leads if no leader before it is near, and the others follow
    their earliest near leader.
    """
    keyed = cut(df.select("ord", group_key(F.col("pmid"), F.col("doi")).alias("_key"), simhash(F.col("title")).alias("_hash")))
    named = keyed.where("_key <> ''")
    firsts = named.groupBy("_key").agg(F.min_by("_hash", "ord").alias("_hash"))
    free = keyed.where("_key = ''")
    classes = cut(free.groupBy("_hash").agg(F.min("ord").alias("first")))
    near = near_hashes(classes.select(F.col("_hash").alias("a")), firsts.select(F.col("_hash").alias("b")).distinct())
    joins = near.join(firsts.withColumnRenamed("_hash", "b"), "b").groupBy(F.col("a").alias("_hash")).agg(F.min("_key").alias("_to"))
    rest = cut(classes.join(joins, "_hash", "left_anti"))
    hashes = rest.select("_hash", "first")
    pairs = near_hashes(hashes.select(F.col("_hash").alias("a")), hashes.select(F.col("_hash").alias("b")))
    pairs = pairs.join(hashes.select(F.col("_hash").alias("a"), F.col("first").alias("fa")), "a").join(hashes.select(F.col("_hash").alias("b"), F.col("first").alias("fb")), "b")
    before = cut(pairs.where("fb < fa").select("a", "b", "fb"))
    state = cut(hashes.select(F.col("_hash").alias("a"), F.lit(None).cast("boolean").alias("leads")))
    while not state.where("leads IS NULL").isEmpty():
        seen = before.join(state.select(F.col("a").alias("b"), F.col("leads").alias("lb")), "b").groupBy("a").agg(F.bool_or(F.coalesce("lb", F.lit(False))).alias("led"), F.bool_and(F.col("lb").isNotNull()).alias("known"))
        decided = F.when(F.col("leads").isNotNull(), F.col("leads")).when(F.coalesce("led", F.lit(False)), False).when(F.coalesce("known", F.lit(True)), True)
        state = cut(state.join(seen, "a", "left").select("a", decided.alias("leads")))
    leaders = state.where("leads").select(F.col("a").alias("b"))
    follow = before.join(leaders, "b").groupBy("a").agg(F.min_by("b", "fb").alias("to"))
    own = state.join(follow, "a", "left").select(F.col("a").alias("_hash"), F.concat(F.lit("hash:"), F.coalesce(F.coalesce("to", "a").cast("string"), F.lit(""))).alias("_to"))
    target = joins.withColumn("_joined", F.lit(True)).unionByName(own.withColumn("_joined", F.lit(False))).withColumnRenamed("_hash", "_at")
    placed = free.drop("_key").join(target, F.col("_hash").eqNullSafe(F.col("_at"))).drop("_at").withColumnRenamed("_to", "_key")
    if strict:
        placed = placed.where(~F.col("_joined"))
    keys = named.select("ord", "_key").unionByName(placed.select("ord", "_key"))
    return fuse_by(df.join(keys, "ord"), F.col("_key")).drop("_key")


def grade(df: DataFrame, as_of_year: int, by: str = "conv_id") -> DataFrame:
    """Score and letter of each package of citations: how many, from how many sources, how many trials, any of the last three years."""
    trial = T.is_trial(F.col("title"), F.col("abstract"), F.col("journal"))
    recent = (F.col("year") > 0) & (F.lit(as_of_year) - F.col("year") <= 3)
    a = df.groupBy(by).agg(F.count("*").alias("n_citations"), F.size(F.array_distinct(F.flatten(F.collect_set("source_origin")))).cast("long").alias("n_sources"), (F.count_if(trial) / F.count("*")).alias("rct_ratio"), F.coalesce(F.bool_or(recent), F.lit(False)).alias("recent"))
    score = (
        F.when(F.col("n_citations") >= 5, 2).otherwise(1)
        + cases([(F.col("n_sources") >= 3, 2), (F.col("n_sources") >= 2, 1)], 0)
        + cases([(F.col("rct_ratio") >= 0.5, 2), (F.col("rct_ratio") >= 0.25, 1)], 0)
        + F.col("recent").cast("int")
    )
    a = a.withColumn("score", score)
    return a.withColumn("grade", cases([(F.col("score") >= 6, "A"), (F.col("score") >= 4, "B"), (F.col("score") >= 2, "C")], "D"))


def fusion_score(df: DataFrame, as_of_year: int) -> DataFrame:
    """The documented ranking: 0.3 citations, 0.2 recency, 0.3 field-weighted impact, 0.2 sources, each against the greatest (an extension)."""
    top = df.agg(F.max("cited_by").alias("mc"), F.max("fwci").alias("mf"), F.max(F.size("source_origin")).alias("ms"))
    part = lambda a, b: F.when(F.col(b) > 0, a / F.col(b)).otherwise(0.0)
    recency = F.greatest(F.lit(0.0), 1 - (F.lit(as_of_year) - F.col("year")) / F.lit(20.0))
    score = 0.3 * part(F.col("cited_by"), "mc") + 0.2 * recency + 0.3 * part(F.col("fwci"), "mf") + 0.2 * part(F.size("source_origin"), "ms")
    return df.crossJoin(F.broadcast(top)).withColumn("fusion_score", score).drop("mc", "mf", "ms")  # one row is broadcast


def source_counts(df: DataFrame, sources: list[str]) -> DataFrame:
    """Rows of each source, 0 for a source without any."""
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in sources])).alias("origin"))
    return names.join(df.groupBy("origin").agg(F.count("*").alias("n")), "origin", "left").select("origin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def vote_candidates(df: DataFrame) -> DataFrame:
    """(question, answer, n, confidence, rank): answers by number, then average confidence, then name."""
    a = df.groupBy("question", "answer").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    order = Window.partitionBy("question").orderBy(F.desc("n"), F.desc(F.round("confidence", 9)), F.asc("answer"))
    return a.withColumn("rank", F.row_number().over(order))


def consensus(df: DataFrame) -> DataFrame:
    """(question, answer, agreement): the first candidate and its share of the votes; one pass, partially aggregated."""
    a = df.groupBy("question", "answer").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"))
    first = F.min(F.struct((-F.col("n")).alias("n"), (-F.round("confidence", 9)).alias("c"), F.col("answer").alias("answer")))
    return a.groupBy("question").agg(first.alias("w"), F.sum("n").alias("total")).select("question", F.col("w.answer").alias("answer"), (-F.col("w.n") / F.col("total")).alias("agreement"))


def duplicate_groups(df: DataFrame, digest: str = "digest", name: str = "pnx") -> DataFrame:
    """Groups of one digest with several names, and the name to keep: a real one, of the lowest slide, first by name."""
    pseudo = F.rlike(name, F.lit(r"^P\d+-\d+-P\d+-\d+$"))
    slide = F.coalesce(F.nullif(F.regexp_extract(name, r"^P(\d+)-", 1), F.lit("")).cast("int"), F.lit(999))
    g = df.groupBy(digest).agg(F.countDistinct(name).alias("n"), F.min(F.struct(pseudo.cast("int"), slide, F.col(name).alias("keep"))).alias("k"), F.min(name).alias("first"), F.max(name).alias("last"))
    return g.where("n > 1").select(digest, "n", F.col("k.keep").alias("keep"), "first", "last")


def merge_groups(df: DataFrame, key: str, name: str = "pnx", least: int = 2) -> DataFrame:
    """(key, n, members joined by dashes in order) of the groups with ``least`` members or more."""
    g = df.groupBy(key).agg(F.sort_array(F.collect_set(name)).alias("m"))
    return g.where(F.size("m") >= least).select(key, F.size("m").cast("long").alias("n"), F.array_join("m", "-").alias("merged"))


def insights(df: DataFrame, n: int = 4, by: str = "conv_id") -> DataFrame:
    """The n most cited items of each group, numbered I1 and on, as claims."""
    order = Window.partitionBy(by).orderBy(F.desc("cited_by"), F.asc("ord"))
    top = df.withColumn("r", F.row_number().over(order)).where(F.col("r") <= n)
    return top.select(by, F.concat(F.lit("I"), F.col("r").cast("string")).alias("insight"), F.concat(F.lit("关键证据: "), F.substring(s(F.col("title")), 1, 80)).alias("claim"), F.col("id").alias("item"))
