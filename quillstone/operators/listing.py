"""Orders, positions, lookups and small workflows over rows.

Orders are range-partitioned sorts, so no task holds a whole table. Positions are
numbered in two steps: within the ranges of a sort, then by the ranges' offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import cases, s
from .planning import ranked
from .store import cut

SEVERITIES = ("fatal", "warn", "info")
#: What a correction may become.
NEXT_STATUS = {"pending": "fixed", "fixed": "verified"}

# Trials by name, with drugs, disease, journal, year and number of the paper.
TRIALS = (
    ("HIMALAYA", ("tremelimumab", "durvalumab"), "hepatocellular carcinoma", "Hepatobiliary Surgery and Nutrition", 2022, "36016731"),
    ("HIMALAYA-Asian", ("tremelimumab", "durvalumab"), "hepatocellular carcinoma", "J Hepatol", 2025, "39089633"),
    ("HIMALAYA-PRO", ("tremelimumab", "durvalumab"), "hepatocellular carcinoma", "J Clin Oncol", 2024, "38805668"),
    ("IMbrave150", ("atezolizumab", "bevacizumab"), "hepatocellular carcinoma", "N Engl J Med", 2020, "32402160"),
    ("ORIENT-32", ("sintilimab", "IBI305"), "hepatocellular carcinoma", "Lancet Oncol", 2021, "34143971"),
    ("CheckMate 9L", ("tislelizumab", "sorafenib"), "hepatocellular carcinoma", "JAMA Oncol", 2023, "37796513"),
    ("CheckMate 459", ("nivolumab", "ipilimumab"), "hepatocellular carcinoma", "Lancet Oncol", 2022, "34914889"),
    ("CheckMate 9DW", ("nivolumab", "ipilimumab"), "hepatocellular carcinoma", "Lancet", 2025, "40349714"),
    ("REACH-2", ("lenvatinib",), "hepatocellular carcinoma", "Lancet", 2018, "29433850"),
    ("RESOLUTE-HEP", ("camrelizumab", "rivoceranib"), "hepatocellular carcinoma", "Lancet", 2023, "37499670"),
    ("CARES-310", ("camrelizumab", "rivoceranib"), "hepatocellular carcinoma", "Lancet Oncol", 2025, "41308676"),
    ("REFine", ("donafenib",), "hepatocellular carcinoma", "J Clin Oncol", 2021, "34185551"),
)
# Terms that count as data points of a slide.
POINT_TERMS = (
    "STRIDE T+A O+Y Len Lenvatinib Pembro NIVO IPI Durvalumab Tremelimumab Atezolizumab Bevacizumab Sorafenib Regorafenib Cabozantinib Ramucirumab Sintilimab Toripalimab"
    " Camrelizumab Tislelizumab Penpulimab Cadonilimab AK104 Donafenib Envafolimab Anlotinib Apatinib FOLFOX4 GEMOX HAIC TACE RFA PEI"
).split()
MOST_POINTS = 15


def top(scores: DataFrame, k: int, score: str = "score", key: str = "id") -> DataFrame:
    """The ``k`` rows of the highest score, ties by key."""
    return scores.orderBy(F.desc(score), key).limit(k)


def by_health(names: DataFrame, health: DataFrame, key: str, score: str = "score", unknown: float = 0.5) -> DataFrame:
    """(key, score), best first; a name that no event has spoken of gets ``unknown``."""
    return names.select(key).distinct().join(health.select(key, score), key, "left").select(key, F.coalesce(score, F.lit(unknown)).alias(score)).orderBy(F.desc(score), key)


def by_severity(findings: DataFrame, rule: str = "rule", where: tuple[str, ...] = ()) -> DataFrame:
    """``findings`` with ``rank``, in order of severity, rule and place."""
    rank = cases([(F.col("severity") == k, i) for i, k in enumerate(SEVERITIES)], len(SEVERITIES))
    return findings.withColumn("rank", rank.cast("int")).orderBy("rank", rule, *where)


def from_the_top(boxes: DataFrame, page: str, y: str = "y", key: str = "k") -> DataFrame:
    """Boxes of each page with ``place``, from 1 at its top down, in order."""
    return ranked(boxes, (page,), (y, key), "place").orderBy(page, "place")


def by_dimension(items: DataFrame, order: tuple[str, ...], column: str = "dimension", key: str = "id") -> DataFrame:
    """Items with ``rank``, the place of their dimension in ``order``, in order of it, then by key; unknown dimensions go last."""
    rank = cases([(F.col(column) == d, i) for i, d in enumerate(order)], len(order))
    return items.withColumn("rank", rank.cast("int")).orderBy("rank", key)


def dimensions(items: DataFrame, order: tuple[str, ...], column: str = "dimension") -> DataFrame:
    """(dimension, n) of the dimensions of ``order`` that have items, in that order."""
    held = items.where(F.col(column).isin(*order)).groupBy(column).agg(F.count("*").alias("n"))
    return held.orderBy(cases([(F.col(column) == d, i) for i, d in enumerate(order)], len(order)))


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``position``: 0, 1, ... in the given order, which should be total."""
    laid = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id()))
    # one row a partition comes together here
    ends = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = laid.groupBy("_part").agg(F.count("*").alias("_rows"), F.min("_n").alias("_least")).withColumn("_before", F.coalesce(F.sum("_rows").over(ends), F.lit(0)))
    return laid.join(F.broadcast(parts), "_part").withColumn("position", F.col("_n") - F.col("_least") + F.col("_before")).drop("_part", "_n", "_rows", "_least", "_before")


def position_diff(left: DataFrame, right: DataFrame, columns: tuple[str, ...], order: str) -> DataFrame:
    """(row, missing, differs) of the rows at one place of two tables; rows count from 2, after a header.

    Only rows of ``left`` are reported: ``missing`` where ``right`` has none at that place,
    else the names of the columns that differ.
    """
    a = positions(left.select(order, *columns), order).select("position", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = positions(right.select(order, *columns), order).select("position", F.lit(True).alias("there"), *[F.col(c).alias(f"b_{c}") for c in columns])
    differs = F.array_compact(F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]))
    x = a.join(b, "position", "left").select((F.col("position") + 2).alias("row"), F.col("there").isNull().alias("missing"), differs.alias("differs"))
    return x.select("row", "missing", F.when(F.col("missing"), F.array().cast("array<string>")).otherwise(F.col("differs")).alias("differs")).where("missing OR size(differs) > 0")


def mark_rows(marks: DataFrame, table: DataFrame, keys: tuple[str, ...] = ("slide", "mark")) -> DataFrame:
    """(keys, matched) of marks: whether a row of the table has the slide and the mark."""
    return marks.join(table.select(*keys).distinct().withColumn("matched", F.lit(True)), list(keys), "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def pending(log: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """(key, at) of corrections whose last entry is pending."""
    return log.groupBy(key).agg(F.max_by("status", at).alias("status"), F.max(at).alias(at)).where("status = 'pending'").select(key, at)


def status_steps(log: DataFrame, key: str = "id", at: str = "at") -> DataFrame:
    """(key, at, status, allowed): whether each entry may follow the one before; the first must be pending."""
    before = F.lag("status").over(Window.partitionBy(key).orderBy(at))
    allowed = F.when(before.isNull(), F.col("status") == "pending").otherwise(cases([(before == k, F.col("status") == v) for k, v in NEXT_STATUS.items()], False))
    return log.select(key, at, "status", allowed.alias("allowed"))


def year_mode(text: Column) -> Column:
    """The most frequent year from 1900 to 2099 written in a text, of equals the first; empty without one."""
    years = F.regexp_extract_all(s(text), F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1))
    counted = F.transform(F.array_distinct(years), lambda y, i: F.struct(F.size(F.filter(years, lambda z: z == y)).alias("n"), (-i).alias("place"), y.alias("year")))
    return F.coalesce(F.array_max(counted)["year"], F.lit(""))


def trial_lookup(df: DataFrame, name: str, trials=TRIALS) -> DataFrame:
    """``df`` with pmid, journal and query of the trial that it names, whatever the case; nulls where none has the name."""
    rows = [(n.upper(), p, j, " AND ".join(f'"{t}"[tiab]' for t in (*drugs, disease))) for n, drugs, disease, j, _, p in trials]
    known = df.sparkSession.createDataFrame(rows, "_name string, trial_pmid string, trial_journal string, trial_query string")
    return df.join(F.broadcast(known), F.upper(F.trim(F.col(name))) == F.col("_name"), "left").drop("_name")  # as many rows as ``trials``


def slide_points(text: Column) -> Column:
    """Data points of a slide's text: numbers of two characters at least, known terms, names of studies in capitals; each once, the first MOST_POINTS."""
    t = s(text)
    numbers = F.filter(F.regexp_extract_all(t, F.lit(r"\b(\d+(?:\.\d+)?)\s*%?"), F.lit(1)), lambda v: F.length(v) >= 2)
    terms = F.filter(F.array(*[F.lit(w) for w in POINT_TERMS]), lambda w: F.contains(t, w))
    studies = F.filter(F.regexp_extract_all(t, F.lit(r"\b([A-Z][A-Z\-]+(?:\d+)?)\b"), F.lit(1)), lambda v: F.length(v) >= 3)
    return F.slice(F.array_distinct(F.concat(numbers, terms, studies)), 1, MOST_POINTS)
