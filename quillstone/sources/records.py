"""Records of bibliographic services as citations.

Each function takes a DataFrame with one string column of raw payloads (JSON,
XML or HTML) and gives rows of one schema, ``COLUMNS``; ``union`` puts them
together and leaves out sources that are not enabled. Fetching is not done here:
payloads come from files or tables, through any Spark reader.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators.store import cut

COLUMNS = ("id", "title", "authors", "journal", "year", "pmid", "doi", "abstract", "cited_by", "fwci", "source_origin")


def _rows(df: DataFrame, origin: str, **given: Column) -> DataFrame:
    text = lambda k: F.coalesce(given.get(k, F.lit("")), F.lit("")).cast("string").alias(k)
    names = F.coalesce(F.filter(given["authors"], lambda a: F.coalesce(a, F.lit("")) != ""), F.array().cast("array<string>")) if "authors" in given else F.array().cast("array<string>")
    return df.select(
        F.concat(F.lit(f"{origin}:"), F.coalesce(given["id"], F.lit(""))).alias("id"),
        F.trim(F.coalesce(given["title"], F.lit(""))).alias("title"),
        names.alias("authors"),
        text("journal"),
        F.coalesce(given.get("year", F.lit(0)), F.lit(0)).cast("int").alias("year"),
        text("pmid"),
        text("doi"),
        text("abstract"),
        F.coalesce(given.get("cited_by", F.lit(0)), F.lit(0)).cast("long").alias("cited_by"),
        F.coalesce(given.get("fwci", F.lit(0.0)), F.lit(0.0)).cast("double").alias("fwci"),
        F.array(F.lit(origin)).alias("source_origin"),
    )


def openalex(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Works: the id's tail, the DOI without its address, the abstract from its inverted index (nested, or the field itself)."""
    schema = "id string, title string, publication_year int, doi string, ids struct<pmid:string>, pmid string, cited_by_count long, fwci double, authorships array<struct<author:struct<display_name:string>>>, primary_location struct<source:struct<display_name:string>>, abstract_inverted_index string"
    x = df.select(F.from_json(payload, schema).alias("w"))
    w = lambda c: F.col(f"w.{c}")
    index = w("abstract_inverted_index")
    nested = F.from_json(index, "inverted_index map<string,array<int>>")["inverted_index"]
    return _rows(
        x, "openalex", id=ids.tail_id(w("id")), title=w("title"), year=w("publication_year"), doi=ids.strip_doi_address(w("doi")), pmid=ids.tail_id(F.coalesce(w("pmid"), w("ids.pmid"))), fwci=w("fwci"), cited_by=w("cited_by_count"),
        journal=w("primary_location.source.display_name"), authors=F.transform(w("authorships"), lambda a: a["author"]["display_name"]), abstract=T.abstract_of(F.coalesce(nested, F.from_json(index, "map<string,array<int>>"))),
    )


def semantic_scholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Papers: the short summary stands for the abstract whenever there is one."""
    schema = "paperId string, title string, abstract string, year int, venue string, externalIds map<string,string>, citationCount long, tldr struct<text:string>, authors array<struct<name:string>>"
    x = df.select(F.from_json(payload, schema).alias("p"))
    p = lambda c: F.col(f"p.{c}")
    key = lambda k: F.try_element_at(p("externalIds"), F.lit(k))
    return _rows(x, "s2", id=p("paperId"), title=p("title"), year=p("year"), journal=p("venue"), cited_by=p("citationCount"), pmid=key("PubMed"), doi=key("DOI"), abstract=F.coalesce(F.nullif(p("tldr.text"), F.lit("")), p("abstract")), authors=F.transform(p("authors"), lambda a: a["name"]))


def crossref(df: DataFrame, payload: str = "payload") -> DataFrame:
    schema = "DOI string, title array<string>, author array<struct<family:string,given:string>>, `container-title` array<string>, published struct<`date-parts`:array<array<int>>>, `is-referenced-by-count` long"
    x = df.select(F.from_json(payload, schema).alias("m"))
    first = lambda c: F.get(F.col(f"m.`{c}`"), F.lit(0))
    return _rows(x, "crossref", id=F.col("m.DOI"), doi=F.col("m.DOI"), title=first("title"), journal=first("container-title"), year=F.get(F.get(F.col("m.published.`date-parts`"), F.lit(0)), F.lit(0)), cited_by=F.col("m.`is-referenced-by-count`"), authors=F.transform(F.col("m.author"), lambda a: a["family"]))


def clinical_trials(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Studies of a registry, by their number."""
    schema = "protocolSection struct<identificationModule:struct<nctId:string,briefTitle:string>,statusModule:struct<startDateStruct:struct<date:string>>,descriptionModule:struct<briefSummary:string>>"
    x = df.select(F.from_json(payload, schema)["protocolSection"].alias("s"))
    year = F.try_to_number(F.nullif(F.substring("s.statusModule.startDateStruct.date", 1, 4), F.lit("")), F.lit("9999"))
    return _rows(x, "registry", id=F.col("s.identificationModule.nctId"), title=F.col("s.identificationModule.briefTitle"), abstract=F.col("s.descriptionModule.briefSummary"), year=year)


def pubmed(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Document summaries (one ``DocSum`` a row): items by name; the year is the first of four digits between 1900 and 2100."""
    item = lambda n: F.xpath_string(payload, F.lit(f"DocSum/Item[@Name='{n}']"))
    year = F.filter(F.regexp_extract_all(item("PubDate"), F.lit(r"\d{4}"), F.lit(0)), lambda y: y.between("1900", "2100"))
    pmid = F.xpath_string(payload, F.lit("DocSum/Id"))
    return _rows(df, "pubmed", id=pmid, pmid=pmid, title=item("Title"), journal=F.coalesce(F.nullif(item("FullJournalName"), F.lit("")), item("Source")), doi=item("DOI"), year=F.get(year, F.lit(0)))


def listing(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Numbered lists in text: ``1. Title``, then authors and journal, then ``DOI:`` and ``PMID:`` lines."""
    block = F.explode(F.filter(F.split(F.col(payload), r"(?m)^(?=\d+\.\s)"), lambda b: F.rlike(b, F.lit(r"^\d+\.\s"))))
    x = df.select(block.alias("b"))
    lines = F.transform(F.split("b", "\n"), lambda v: F.trim(v))
    doi = F.regexp_extract("b", r"(?i)doi:\s*(10\.\d{4,9}/\S+)", 1)
    pmid = F.regexp_extract("b", r"(?i)pmid:\s*(\d+)", 1)
    second = F.coalesce(F.get(lines, F.lit(1)), F.lit(""))
    venue = T.authors_venue(F.when(F.rlike(second, F.lit(r"(?i)^(doi|pmid):")), F.lit("")).otherwise(second))
    return _rows(x, "listing", id=F.coalesce(F.nullif(pmid, F.lit("")), doi), title=F.regexp_replace(F.get(lines, F.lit(0)), r"^\d+\.\s+", ""), authors=venue["authors"], journal=venue["journal"], year=F.nullif(venue["year"], F.lit("")).cast("int"), doi=doi, pmid=pmid)


class _Results(HTMLParser):
    """Blocks of a result page: title and link, authors and venue, snippet, cited-by count."""

    FIELDS = {"gs_rt": "title", "gs_a": "venue", "gs_rs": "abstract"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.field, self.depth, self.link = None, 0, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if "gs_ri" in classes:
            self.blocks.append({"title": "", "venue": "", "abstract": "", "href": "", "links": ""})
        if not self.blocks or tag in ("br", "img"):
            return
        if self.field:
            self.depth += 1
        else:
            for c in classes:
                if c in self.FIELDS:
                    self.field, self.depth = self.FIELDS[c], 1
        if tag == "a":
            self.link = True
            if self.field == "title" and not self.blocks[-1]["href"]:
                self.blocks[-1]["href"] = a.get("href") or ""

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        if self.field:
            self.depth -= 1
            if self.depth <= 0:
                self.field = None

    def handle_data(self, data):
        if self.blocks:
            if self.field:
                self.blocks[-1][self.field] += data
            elif self.link:
                self.blocks[-1]["links"] += data + "\n"


def scholar(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Result pages: a row for each block with a title."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page in frame.iloc[:, 0]:
                p = _Results()
                p.feed(page or "")
                out += [b for b in p.blocks if b["title"].strip()]
            yield pd.DataFrame(out, columns=["title", "venue", "abstract", "href", "links"])

    x = df.select(payload).mapInPandas(run, "title string, venue string, abstract string, href string, links string")
    v = T.authors_venue(F.col("venue"))
    cited = F.nullif(F.regexp_extract("links", r"(?i)cited by (\d+)", 1), F.lit("")).cast("long")
    return _rows(x, "scholar", id=F.col("href"), title=F.regexp_replace("title", r"^\s*\[[A-Z]+\]\s*", ""), authors=v["authors"], journal=v["journal"], year=F.nullif(v["year"], F.lit("")).cast("int"), doi=ids.link_doi(F.col("href")), pmid=ids.link_pmid(F.col("href")), abstract=F.col("abstract"), cited_by=cited)


#: Readers by name; ``register`` adds others.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"openalex": openalex, "s2": semantic_scholar, "crossref": crossref, "registry": clinical_trials, "pubmed": pubmed, "listing": listing, "scholar": scholar}


def register(name: str, reader: Callable[[DataFrame], DataFrame]) -> None:
    READERS[name] = reader


def union(payloads: dict[str, DataFrame | Callable[[], DataFrame]], enabled: set[str] | None = None, limit: int | None = None, failed: list | None = None) -> DataFrame:
    """Citations of all enabled sources; ``limit`` keeps as many rows of each (the services' page size, a feature).

    A source may be given as a function that opens it. With ``failed``, each source is read
    and its rows are put into the shared folder at once; one that cannot be opened or read to its end is noted
    there, by name, and the others go on; if none is left, the last fault is raised.
    """
    out, fault = None, ValueError("no source is enabled")
    for name in sorted(payloads):
        if enabled is None or name in enabled:
            try:
                given = payloads[name]
                one = READERS[name](given() if callable(given) else given)
                one = one.limit(limit) if limit else one
                one = one if failed is None else cut(one)
            except Exception as e:
                if failed is None:
                    raise
                failed.append(name)
                fault = e
                continue
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise fault
    return out
