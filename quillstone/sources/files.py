"""Tables and documents in files: strict CSV, office and text documents, logs, stores."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids

#: The header of the citation table.
HEADER = ("PPT页", "第几条", "引用语义（上下文）", "PPT中的文献引用 完整字段", "DOI", "类型", "对应PDF文件", "来源链接 → 阅读全文")
NAMES = ("page", "number", "context", "reference", "doi", "kind", "pdf", "link")  #: names of its columns here
BOM = "﻿"


def read_table(spark: SparkSession, path: str, header: tuple[str, ...] = HEADER, names: tuple[str, ...] = NAMES) -> DataFrame:
    """A CSV file whose header must be ``header``: a byte order mark is dropped, blank rows are skipped, short rows are filled with empty cells."""
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"empty csv: {path}")
    got = next(csv.reader([first[0][0].removeprefix(BOM)]))
    if len(got) != len(header):
        raise ValueError(f"column count mismatch: got {len(got)}, want {len(header)}")
    for i, (a, b) in enumerate(zip(got, header, strict=True)):
        if a.strip() != b:
            raise ValueError(f"column {i + 1} mismatch: got {a!r}, want {b!r}")
    schema = ", ".join(f"`{n}` string" for n in names)
    df = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, multiLine=True, quote='"', escape='"', mode="PERMISSIVE", encoding="UTF-8")
    blank = F.concat_ws("", *[F.trim(F.coalesce(F.col(n), F.lit(""))) for n in names]) == ""
    return df.where(~blank).select(*[F.coalesce(n, F.lit("")).alias(n) for n in names])


def write_table(df: DataFrame, path: str, header: tuple[str, ...] = HEADER, names: tuple[str, ...] = NAMES) -> None:
    """A CSV folder with ``header`` and a byte order mark at the head of each part."""
    if tuple(df.columns) != names:
        raise ValueError(f"columns are {df.columns}, not {list(names)}")
    titles = [BOM + header[0], *header[1:]]
    df.select(*[F.col(n).alias(t) for n, t in zip(names, titles, strict=True)]).write.csv(path, header=True, quote='"', escape='"', mode="overwrite", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def pages(df: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """(key, page, text): the pages of a text dump, parted by form feeds, from 1; empty ones are dropped."""
    x = df.select(key, F.posexplode(F.split(text, "\f")).alias("p", "t"))
    return x.where(F.trim(F.regexp_replace("t", r"\s+", " ")) != "").select(key, (F.col("p") + 1).alias("page"), F.col("t").alias("text"))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


W_TEXT, A_TEXT = re.compile(r">([^<]{1,1000})</w:t>"), re.compile(r">([^<]{1,500})</a:t>")
TAGS = re.compile(r"(?is)<(script|style|nav|footer|header)\b.*?</\1>")


def _joined(pattern: re.Pattern, xml: str) -> str:
    return " ".join(t for t in (m.strip() for m in pattern.findall(xml)) if t)


def office_pages(name: str, content: bytes) -> list[tuple[int, str]]:
    """(page, text) of a document: one page of a DOCX, a page for each slide of a PPTX with its notes, blocks of an HTML page, pages of a text."""
    kind = name.lower().rpartition(".")[2]
    if kind in ("docx", "pptx"):
        try:
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                names = z.namelist()
                if kind == "docx":
                    return [(1, _joined(W_TEXT, z.read("word/document.xml").decode("utf-8", "replace")))] if "word/document.xml" in names else []
                slides, notes = {}, {}
                for n in names:
                    for pattern, into in ((r"ppt/slides/slide(\d+)\.xml", slides), (r"ppt/notesSlides/notesSlide(\d+)\.xml", notes)):
                        if m := re.fullmatch(pattern, n):
                            into[int(m[1])] = _joined(A_TEXT, z.read(n).decode("utf-8", "replace"))
                return [(k, t + (f"\n[NOTES: {notes[k]}]" if notes.get(k) else "")) for k, t in sorted(slides.items())]
        except (zipfile.BadZipFile, KeyError):
            return []
    text = content.decode("utf-8", "replace")
    if kind in ("html", "htm"):
        blocks = re.findall(r"(?is)<(p|h[1-6]|li|div)\b[^>]*>(.*?)</\1>", TAGS.sub("", text))
        body = "\n\n".join(t for t in (re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", b)).strip() for _, b in blocks) if t)
        return [(1, re.sub(r"\n{3,}", "\n\n", body))] if body else []
    return [(i + 1, t) for i, t in enumerate(text.split("\f")) if t.strip()]


def documents(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, page, text) of all documents in a folder, read as binary files by Spark."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(p, n, t) for p, c in zip(frame.path, frame.content, strict=True) for n, t in office_pages(p, bytes(c))], columns=["path", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, page int, text string")


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(pnx, path, bytes, digest, valid, reason) of the PDF files whose name or folder begins with ``P<slide>-<mark>``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    key = F.coalesce(F.nullif(F.regexp_extract("path", r"/(P\d+-\d+(?:-P\d+-\d+)?)[^/]*\.pdf$", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"/(P\d+-\d+(?:-P\d+-\d+)?)/[^/]*$", 1), F.lit("")))
    x = files.withColumn("v", ids.pdf_validity(F.col("content")))
    return x.where(key.isNotNull()).select(key.alias("pnx"), "path", F.col("length").alias("bytes"), F.md5("content").alias("digest"), F.col("v.valid").alias("valid"), F.col("v.reason").alias("reason"))


def append_log(df: DataFrame, path: str) -> None:
    """Events appended as lines of JSON."""
    df.write.json(path, mode="append")


def progress(log: DataFrame) -> DataFrame:
    """(status, n) of a download log."""
    return log.groupBy("status").agg(F.count("*").alias("n"))


def done(log: DataFrame, key: str = "doi") -> DataFrame:
    """Keys that succeeded; empty keys never count as done."""
    return log.where((F.col("status") == "ok") & (F.coalesce(F.col(key), F.lit("")) != "")).select(key).distinct()


def adverse_events(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(term, arm1, arm2) of a trial's events that have figures for two arms at least."""
    schema = "events array<struct<term:string,stats:array<struct<groupId:string,numAffected:long>>>>"
    x = df.select(F.explode(F.from_json(payload, schema)["events"]).alias("e")).where(F.size("e.stats") >= 2)
    return x.select(F.col("e.term").alias("term"), F.col("e.stats")[0]["numAffected"].alias("arm1"), F.col("e.stats")[1]["numAffected"].alias("arm2"))


def report(df: DataFrame, title: str, order: list[str], html: bool = False) -> DataFrame:
    """(value) of the lines of a report, in order: a table of all rows of ``df``, in markdown or as a page. ``write.text`` puts it into files that follow one another.

    Bars are escaped in markdown, markup in pages; line breaks within a value become spaces; nulls are empty.
    """
    spark, names = df.sparkSession, df.columns
    plain = lambda c: F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"[\r\n]+", " ")
    if html:
        escaped = lambda c: F.replace(F.replace(F.replace(plain(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        row = F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escaped(F.col(f"`{n}`")), F.lit("</td>")) for n in names], F.lit("</tr>"))
        e = escape
        head = ["<!doctype html>", f'<html><head><meta charset="utf-8"><title>{e(title)}</title></head><body>', f"<h1>{e(title)}</h1>", "<table>", "<tr>" + "".join(f"<th>{e(n)}</th>" for n in names) + "</tr>"]
        tail = ["</table>", "</body></html>"]
    else:
        row = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(plain(F.col(f"`{n}`")), F.lit("|"), F.lit("\\|")) for n in names]), F.lit(" |"))
        head, tail = [f"# {title}", "", "| " + " | ".join(names) + " |", "|" + "---|" * len(names)], []
    fixed = [(0, i, x) for i, x in enumerate(head)] + [(2, i, x) for i, x in enumerate(tail)]
    keys = [F.col(c).alias(f"_o{i}") for i, c in enumerate(order)]
    body = df.select(F.lit(1).alias("_part"), F.lit(0).alias("_line"), *keys, row.alias("value"))
    frame = spark.createDataFrame(fixed, "_part int, _line int, value string").select("_part", "_line", *[F.lit(None).cast(df.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)], "value")
    return body.union(frame).orderBy("_part", "_line", *[f"_o{i}" for i in range(len(order))]).select("value")
