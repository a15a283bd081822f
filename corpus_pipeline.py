"""The corpus pipeline: STAGES of (name, function), each over all that the stage before kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All stages but the
last return the columns of documents:

1. language: texts without a letter, and texts whose two best languages cannot
   be told apart, go.
2. near_dup: one row of each group of near-duplicates stays, the first by id
   (null ids last), then by the text's hash, then by the other columns. Groups
   are of rows, not of ids: different texts under one id, or under none, all
   stay, and so do all texts without a word, as op4 links them with nothing.
3. decontaminate: documents with a benchmark passage go.
4. pii: personal data in the texts is replaced by its kind in brackets; n_chars
   is counted anew.
5. mix: how many words the mix takes of each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillstone.llm import decontaminate, language, mixing, neardup, pii
from quillstone.llm.common import ensure_checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark, docs, sf_dir):
    seen = language.identify(docs.select(*COLUMNS), language.fit(docs))
    return seen.where((F.col("lang_pred") != language.UNKNOWN) & ~F.col("ambiguous")).select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    docs = docs.select(*COLUMNS)
    # the id takes part in the key as a string, so that null ids meet too; the join and the grouping share one exchange of the texts
    key = lambda c: F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    rows = docs.where(~neardup.wordless("text")).withColumn("_th", F.xxhash64("text")).withColumn("_key", key("doc_id"))
    first = neardup.first_rows(docs).select(key("id").alias("_key"), F.col("th").alias("_th"))
    stay = rows.join(first, ["_th", "_key"], "left_semi")
    # equal texts under one id are one group: the least of their other columns stays
    one = stay.groupBy("_th", "_key").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.min(F.struct("lang", "source", "n_chars")).alias("_rest"))
    return one.select("doc_id", "text", "_rest.*").unionByName(docs.where(neardup.wordless("text"))).select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    found = decontaminate.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("hits") == 0).select(*COLUMNS)


def redact_pii(spark, docs, sf_dir):
    return pii.redact(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark, docs, sf_dir):
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("pii", redact_pii),
    ("mix", mix_sources),
]

#: Language identification and the trees of the PII stage are trained models: no SQL.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """The rows of the last stage; what lies between the stages goes to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{base}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
