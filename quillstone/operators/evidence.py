"""Scores of claims against evidence, and lookups in reference tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ids import cases, has, paywalled, s

#: Names of one disease, group by group.
DISEASES = (
    ("肝癌", "hcc", "hepatocellular", "liver cancer", "肝细胞癌", "原发性肝癌"),
    ("肺癌", "lung cancer", "lung"),
    ("乳腺癌", "breast cancer", "breast"),
    ("胰腺癌", "pancreas", "pancreatic"),
    ("结直肠癌", "colorectal", "colon", "rectal"),
    ("胃癌", "stomach cancer", "gastric"),
    ("前列腺癌", "prostate", "prostate cancer"),
    ("宫颈癌", "cervical", "cervix"),
    ("卵巢癌", "ovarian", "ovary"),
    ("甲状腺癌", "thyroid"),
)
WEIGHTS = {"geography": 0.20, "disease": 0.30, "indicator": 0.20, "value": 0.20}  #: fixed values: shares of a claim's parts
THRESHOLD = 0.70


def same_disease(a: Column, b: Column) -> Column:
    x, y = F.lower(s(a)), F.lower(s(b))
    group = reduce(lambda p, q: p | q, [has(x, *g) & has(y, *g) for g in DISEASES])
    return (x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x) | group)


def set_conclusion(rows: DataFrame, by: str, subject: str = "subject", conclusion: str = "below", exclude: str = "肝癌") -> DataFrame:
    """(by, n_high, n_low, score): how well a table's rows (disease, value) bear out that the subject lies below or above them."""
    other = ~same_disease(F.col("disease"), F.lit(exclude))
    a = rows.groupBy(by).agg(F.count_if(other & (F.col("value") > F.col(subject))).alias("n_high"), F.count_if(other & (F.col("value") < F.col(subject))).alias("n_low"))
    high, low = F.col("n_high"), F.col("n_low")
    total = high + low
    if conclusion in ("below", "below_all"):
        score = cases([(low == 0, 1.0), ((low == 1) & (high >= 20), 0.95), ((low <= 3) & (high / total >= 0.85), 0.80)], high / total * 0.70)
    else:
        score = low / total
    return a.withColumn("score", F.when(total == 0, 0.0).otherwise(score))


def value_score(a: Column, b: Column) -> Column:
    """By relative difference: under 5 per cent 1, under 20 0.7, under 50 0.3; 0 means no value."""
    diff = F.abs(a - b) / F.nullif((a + b) / 2, F.lit(0.0))
    return cases([((a == 0) & (b == 0), 0.5), ((a == 0) | (b == 0), 0.0), (diff.isNull() | (diff < 0.05), 1.0), (diff < 0.20, 0.7), (diff < 0.50, 0.3)], 0.0)


def words_score(a: Column, b: Column, known: tuple[str, ...] = ()) -> Column:
    """1 if one holds the other, 0.9 for names of one disease, 0.6 for two known words, else 0."""
    x, y = F.lower(s(a)), F.lower(s(b))
    group = reduce(lambda p, q: p | q, [has(x, *g) & has(y, *g) for g in DISEASES[:6]])
    both = a.isin(*known) & b.isin(*known) if known else F.lit(False)
    return cases([((x == "") | (y == ""), 0.0), (F.contains(x, y) | F.contains(y, x), 1.0), (group, 0.9), (both, 0.6)], 0.0)


def claim_scores(evidence: DataFrame, by: str) -> DataFrame:
    """(by, a score for each part, score, highlight): the best evidence for each part of a claim, weighed together."""
    best = evidence.groupBy(by).agg(*[F.max(c).alias(c) for c in WEIGHTS])
    total = reduce(lambda p, q: p + q, [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()])
    return best.withColumn("score", total).withColumn("highlight", F.round("score", 9) >= THRESHOLD)


#: Texts in metadata that say nothing.
PLACEHOLDERS = ("untitled", "anonymous", "unspecified", "n/a", "na", "anon", "unknown", "test", "placeholder", "default", "匿名", "未指定", "无标题", "未知")


def real_metadata(x: Column) -> Column:
    return (F.trim(s(x)) != "") & ~F.lower(F.trim(s(x))).isin(*PLACEHOLDERS)


def completeness(*fields: Column) -> Column:
    return reduce(lambda a, b: a + b, [real_metadata(f).cast("int") for f in fields]) / len(fields)


def authenticity(title: Column, author: Column, subject: Column, creator: Column, created: Column, doi: Column, ref_title: Column, ref_authors: Column, ref_date: Column) -> Column:
    """(score, verified): 0.45 title, 0.30 author, 0.15 date, 0.10 metadata; without a DOI half the metadata's share, from 0.5 on."""
    complete = completeness(title, author, subject, creator)
    wrote = F.when(s(author) == "", 0.0).otherwise(F.coalesce(F.exists(ref_authors, lambda a: F.contains(F.lower(author), F.lower(a))), F.lit(False)).cast("double"))
    date = F.when(created.isNull() | ref_date.isNull(), 0.5).otherwise((created > ref_date).cast("double"))
    full = 0.45 * T.title_similarity(title, ref_title) + 0.30 * wrote + 0.15 * date + 0.10 * complete
    bare = s(doi) == ""
    score = F.when(bare, complete * 0.5).otherwise(full)
    return F.struct(score.alias("score"), (F.round(score, 9) >= F.when(bare, 0.50).otherwise(0.70)).alias("verified"))


def paper_match(expected: Column, actual: Column, least: float = 0.5) -> Column:
    """(score, ok) of a paper's (surname, journal, year, doi) against the cited one; what the paper does not say counts half and shrinks the scale."""
    parts, scale, wrong = [], F.lit(0.0), F.lit(False)
    for name, weight in (("surname", 0.3), ("journal", 0.3), ("year", 0.2), ("doi", 0.2)):
        e, a = F.lower(s(expected[name])), F.lower(s(actual[name]))
        near = F.contains(a, e) | F.contains(e, a)
        if name == "surname":
            got = cases([(e == a, weight), (near, weight / 2)], 0.0)
        elif name == "journal":
            got = F.when(near, weight).otherwise(0.0)
        elif name == "year":
            got = F.when(e == a, weight).otherwise(0.0)
        else:
            got = cases([(e == a, weight), (F.substring_index(e, "/", -1) == F.substring_index(a, "/", -1), weight / 2)], 0.0)
        both = (e != "") & (a != "")
        parts.append(F.when(both, got).when(e != "", weight / 2).otherwise(0.0))
        scale = scale + F.when((e != "") & (a == ""), 0.0).otherwise(weight)
        wrong = wrong | (both & (got == 0))
    score = F.when(scale > 0, reduce(lambda p, q: p + q, parts) / scale).otherwise(0.0)
    return F.struct(F.round(score, 3).alias("score"), ((score >= least) & ~wrong).alias("ok"))


def combine(main: DataFrame, fallback: DataFrame, key: str) -> DataFrame:
    """(key, value): the main source's value, the other's where the main has none."""
    return main.select(key, F.col("value").alias("m")).join(fallback.select(key, F.col("value").alias("f")), key, "full_outer").select(key, F.coalesce("m", "f").alias("value"))


def needs_fallback(verified: Column, doi: Column, hinted: Column) -> Column:
    return hinted | (~verified & paywalled(doi))


def enrich(df: DataFrame, reference: DataFrame, fields: tuple[str, ...], force: bool = False) -> DataFrame:
    """Fill ``fields`` from reference rows (pmid, doi, fields) with the same DOI, else the same PMID; only missing ones unless ``force``.

    A field is missing if it is null, empty or 0. ``log`` names what was filled.
    """
    value = F.struct(*fields)
    keys = [reference.where(s(F.col(k)) != "").groupBy(F.col(k).alias(f"_{k}")).agg(F.max(value).alias(f"_by_{k}")) for k in ("doi", "pmid")]
    x = df
    for k, r in zip(("doi", "pmid"), keys, strict=True):
        x = x.join(r, F.nullif(F.col(k), F.lit("")) == F.col(f"_{k}"), "left").drop(f"_{k}")
    hit = F.coalesce("_by_doi", "_by_pmid")
    missing = lambda c: F.col(c).isNull() | F.col(c).cast("string").isin("", "0", "0.0")
    take = {c: hit.isNotNull() & (F.lit(force) | missing(c)) for c in fields}
    log = F.filter(F.array(*[F.when(take[c], F.lit(c)) for c in fields]), lambda v: v.isNotNull())
    return x.withColumns({"log": log} | {c: F.when(take[c], hit[c]).otherwise(F.col(c)) for c in fields}).drop("_by_doi", "_by_pmid")


def verify_cascade(df: DataFrame, references: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """``df`` with method and title of the first of the (label, reference, key) lookups that succeeds; references are (key, title)."""
    x, labels, titles = df, [], []
    for i, (label, ref, key) in enumerate(references):
        one = ref.where(s(F.col(key)) != "").groupBy(F.col(key).alias(f"_k{i}")).agg(F.min("title").alias(f"_t{i}"))
        x = x.join(one, F.nullif(F.col(key), F.lit("")) == F.col(f"_k{i}"), "left")
        labels.append(F.when(F.col(f"_t{i}").isNotNull(), label))
        titles.append(F.col(f"_t{i}"))
    drop = [f"_{c}{i}" for c in "kt" for i in range(len(references))]
    return x.withColumns({"method": F.coalesce(*labels, F.lit("not_found")), "found_title": F.coalesce(*titles, F.lit(""))}).drop(*drop)


def alignment(points: DataFrame, texts: DataFrame, by: str) -> DataFrame:
    """(by, n, found, ratio): how many of an item's points (by, point) its text (by, text) holds, in any way to write them."""
    x = points.join(texts.withColumn("text", F.lower("text")), by)
    found = F.exists(T.number_variants(F.col("point")), lambda v: F.contains(F.col("text"), F.lower(v)))
    return x.groupBy(by).agg(F.count("*").alias("n"), F.count_if(found).alias("found")).withColumn("ratio", F.col("found") / F.col("n"))
