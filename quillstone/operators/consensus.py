"""Voters that answer questions, and what they agree on; insights and SWOT of a product's brief."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import s
from .planning import first_rows

#: A voter takes questions (question, ...) and gives (question, answer, confidence).
Voter = Callable[[DataFrame], DataFrame]
VOTERS: dict[str, Voter] = {}
LEAST_AGREEMENT = 0.6  #: fixed value: the share of votes from which voters agree
TIES = {"frequency": ("confidence", "answer"), "avg_confidence": ("confidence", "answer"), "max_confidence": ("highest", "answer")}  #: what settles equal numbers of votes


def register(name: str, voter: Voter) -> None:
    VOTERS[name] = voter


def expression(answer: Column, confidence: Column | float = 1.0) -> Voter:
    """A voter that reads its answer off the question's columns."""
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return lambda questions: questions.select("question", answer.cast("string").alias("answer"), sure.cast("double").alias("confidence"))


def ask(questions: DataFrame, voters: Iterable[str] | None = None) -> DataFrame:
    """(question, voter, answer, confidence): the votes of the named voters, by default of all; the same voter may be named several times."""
    names = sorted(VOTERS) if voters is None else list(voters)
    out = questions.limit(0).select("question", F.lit("").alias("voter"), F.lit("").alias("answer"), F.lit(0.0).alias("confidence"))
    for name in names:
        out = out.unionByName(VOTERS[name](questions).select("question", F.lit(name).alias("voter"), F.col("answer").cast("string"), F.col("confidence").cast("double")))
    return out


def candidates(votes: DataFrame) -> DataFrame:
    """(question, answer, n, confidence, highest) of each answer; a null answer is an answer."""
    return votes.groupBy("question", "answer").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"), F.max("confidence").alias("highest"))


def decide(votes: DataFrame, tie: str = "avg_confidence", least: float = LEAST_AGREEMENT) -> DataFrame:
    """(question, answer, agreement, agreed, answers): the most frequent answer, the share of votes that it has, whether that is enough, and all answers, the first ones first.

    Equal numbers are settled by average or highest confidence, then by name. A question without votes isn't there.
    """
    measure, name = TIES[tie]
    order = F.struct((-F.col("n")).alias("n"), (-F.coalesce(measure, F.lit(0.0))).alias("c"), F.col(name).alias("answer"), "confidence")
    g = candidates(votes).groupBy("question").agg(F.sort_array(F.collect_list(order)).alias("a"), F.sum("n").alias("total"))
    share = -F.get("a", F.lit(0))["n"] / F.col("total")
    every = F.transform("a", lambda x: F.struct(x["answer"].alias("answer"), (-x["n"]).alias("n"), x["confidence"].alias("confidence")))
    return g.select("question", F.get("a", F.lit(0))["answer"].alias("answer"), share.alias("agreement"), (share >= least).alias("agreed"), every.alias("answers"))


# Wording of insights and SWOT.
EVIDENCE, ADVANTAGE, WEAK, THREAT, CHANCE = "关键证据: ", "差异化优势: ", "可检索的循证文献不足, 证据链薄弱", ("竞品 ", " 的市场与证据压力"), "结合最新政策与临床未满足需求进行差异化定位 (见调研材料)"
ANCHORS, CLAIM = 4, 80  #: fixed values: works that become insights, letters of their titles


def _named(values: str) -> Column:
    return F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda v: F.trim(s(v)) != "")


def brief_insights(briefs: DataFrame, items: DataFrame) -> DataFrame:
    """(project, n, claim, dimension, item, advantage): the most cited literature (project, id, title, cited_by, ord) of each brief (project, differentiators), then what sets its product apart, numbered on."""
    works = items.select("project", "id", "title", F.coalesce("cited_by", F.lit(0)).alias("cited_by"), "ord").join(briefs.select("project").distinct(), "project")
    top = first_rows(works, "project", [F.desc("cited_by"), F.col("ord")], ANCHORS, rank="n")
    held = top.groupBy("project").agg(F.max("n").alias("last"))
    no = F.lit(None).cast("string")
    first = top.select("project", "n", F.concat(F.lit(EVIDENCE), F.substring(s(F.col("title")), 1, CLAIM)).alias("claim"), F.lit("literature").alias("dimension"), F.col("id").alias("item"), F.lit(False).alias("advantage"))
    apart = briefs.select("project", F.posexplode(_named("differentiators")).alias("i", "v")).join(held, "project", "left")
    rest = apart.select("project", (F.coalesce("last", F.lit(0)) + F.col("i") + 1).cast("int").alias("n"), F.concat(F.lit(ADVANTAGE), "v").alias("claim"), F.lit("competitor").alias("dimension"), no.alias("item"), F.lit(True).alias("advantage"))
    return first.unionByName(rest)


def swot(briefs: DataFrame, items: DataFrame) -> DataFrame:
    """(project, part, i, text): strengths are what sets a product apart, a weakness is that no literature was found, threats are its competitors, the chance is the same for all."""
    found = items.select("project").distinct().withColumn("found", F.lit(True))
    x = briefs.select("project", _named("differentiators").alias("apart"), _named("competitors").alias("rivals")).join(found, "project", "left")
    part = lambda name, texts: F.transform(texts, lambda v, i: F.struct(F.lit(name).alias("part"), i.alias("i"), v.alias("text")))
    weak = F.when(F.col("found").isNull(), F.array(F.lit(WEAK))).otherwise(F.array().cast("array<string>"))
    rows = F.concat(part("strength", F.col("apart")), part("weakness", weak), part("threat", F.transform("rivals", lambda v: F.concat(F.lit(THREAT[0]), v, F.lit(THREAT[1])))), part("opportunity", F.array(F.lit(CHANCE))))
    return x.select("project", F.explode(rows).alias("r")).select("project", "r.*")
