"""Answer pages, cell ranges, shapes, correction logs, registries of links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cases, s

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    __slots__ = ("tag", "attrs", "children", "parts")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children, self.parts = tag, attrs, [], []

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts).strip()

    def walk(self) -> Iterator[_Node]:
        for c in self.children:
            yield c
            yield from c.walk()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.stack = [self.root]

    def handle_starttag(self, tag, attrs):
        n = _Node(tag, {k: v or "" for k, v in attrs})
        self.stack[-1].children.append(n)
        self.stack[-1].parts.append(n)
        if tag not in VOID:
            self.stack.append(n)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].parts.append(data)


SIMPLE = re.compile(r"([a-zA-Z][\w-]*)?((?:[.#][\w-]+|\[[\w-]+\])*)$")


def _matches(n: _Node, selector: str) -> bool:
    """One simple selector: a tag, classes, an id, attributes that are there."""
    m = SIMPLE.match(selector)
    if not m or (m[1] and m[1].lower() != n.tag):
        return False
    classes = n.attrs.get("class", "").split()
    return all(p[1:] in classes if p[0] == "." else p[1:] == n.attrs.get("id") if p[0] == "#" else p[1:-1] in n.attrs for p in re.findall(r"[.#][\w-]+|\[[\w-]+\]", m[2]))


def _find(n: _Node, selectors: str) -> list[_Node]:
    """Nodes of the first selector of the list that finds any."""
    for sel in (x.strip() for x in selectors.split(",")):
        if sel and (got := [c for c in n.walk() if _matches(c, sel)]):
            return got
    return []


def answers(pages: DataFrame, answer: str, container: str, item: str, title: str = "a", snippet: str = "p", key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, answer, references): texts of the first answer selector that finds any, and the items (title, url, snippet, year) of the first container; an item needs a title or an address."""
    kind = pages.schema[key].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k, page in zip(frame.iloc[:, 0], frame.iloc[:, 1], strict=True):
                t = _Tree()
                t.feed(page or "")
                t.close()
                said = "\n\n".join(x for x in (n.text() for n in _find(t.root, answer)) if x)
                refs = []
                for box in _find(t.root, container)[:1]:
                    for n in _find(box, item):
                        a, p = _find(n, title)[:1], _find(n, snippet)[:1]
                        year = re.search(r"(?:19|20)\d{2}", n.text())
                        r = {"title": a[0].text() if a else "", "url": a[0].attrs.get("href", "") if a else "", "snippet": p[0].text() if p else "", "year": int(year[0]) if year else 0}
                        if r["title"] or r["url"]:
                            refs.append(r)
                out.append((k, said, refs))
            yield pd.DataFrame(out, columns=[key, "answer", "references"])

    return pages.select(key, html).mapInPandas(run, f"{key} {kind}, answer string, references array<struct<title:string,url:string,snippet:string,year:int>>")


def cell_range(df: DataFrame, names: tuple[str, ...], payload: str = "payload") -> DataFrame:
    """Rows of a spreadsheet range (JSON ``{"values": [[...], ...]}``) up to the last whose first cell is not blank; short rows are filled, long ones cut."""
    v = F.from_json(payload, "values array<array<string>>")["values"]
    x = df.select(F.posexplode(v).alias("row_n", "cells"))
    last = x.where(F.trim(s(F.get("cells", F.lit(0)))) != "").agg(F.max("row_n").alias("last"))
    rows = x.crossJoin(F.broadcast(last)).where(F.col("row_n") <= F.col("last"))  # one row is broadcast
    return rows.select((F.col("row_n") + 1).alias("row_n"), *[F.coalesce(F.get("cells", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def shapes(df: DataFrame, payload: str = "payload") -> DataFrame:
    """(slide, shape, row, text) of slides as JSON: texts of shapes, and the rows of their tables joined by bars."""
    schema = "slides array<struct<slide:int,shapes:array<struct<name:string,text:string,table:array<array<string>>>>>>"
    x = df.select(F.explode(F.from_json(payload, schema)["slides"]).alias("s")).select("s.slide", F.posexplode("s.shapes").alias("shape", "h"))
    lines = F.concat(F.when(s(F.col("h.text")) != "", F.array(F.col("h.text"))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform("h.table", lambda r: F.array_join(r, " | ", "")), F.array().cast("array<string>")))
    return x.select("slide", "shape", F.posexplode(lines).alias("row", "text"))


def training_examples(corrections: DataFrame, most: int = 50) -> DataFrame:
    """The last applied corrections (applied = 1), newest id first: as many as a prompt takes."""
    return corrections.where("applied = 1").orderBy(F.desc("id")).limit(most)


#: Papers whose trials are known by their registry number.
REGISTRY = {"10.1016/S2468-1253(21)00109-6": "NCT02329860", "10.1016/S1470-2045(23)00469-2": "NCT03713593", "10.1056/NEJMoa2024020": "NCT03298451"}


def registry_of(doi: Column) -> Column:
    return cases([(doi == d, n) for d, n in REGISTRY.items()], "")


def paper_links(doi: Column, verified: Column, label: Column) -> Column:
    """(label, url) of a paper: the verified address, the DOI, two searches; none without a DOI."""
    link = lambda a, b: F.struct(a.alias("label"), b.alias("url"))
    given = F.when(s(verified) != "", F.array(link(F.concat(s(label), F.lit(" 全文")), verified))).otherwise(F.array().cast("array<struct<label:string,url:string>>"))
    fixed = F.array(*[link(F.lit(a), F.concat(F.lit(b), doi)) for a, b in (("DOI 主链接", "https://doi.org/"), ("PubMed 搜索", "https://pubmed.ncbi.nlm.nih.gov/?term="), ("Europe PMC 搜索", "https://europepmc.org/search?query="))])
    return F.when((s(doi) == "") | F.startswith(s(doi), F.lit("备注")), F.array().cast("array<struct<label:string,url:string>>")).otherwise(F.concat(given, fixed))


def without(store: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """A store without the given ids; ids that it does not hold are ignored."""
    return store.join(ids.select(key).distinct(), key, "left_anti")


def merge(store: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A store after an upsert: a changed row replaces the stored one."""
    return without(store, changes, key).unionByName(changes)
