"""What answers of models and services hold: JSON within prose, entities and summaries; addresses of papers; features of slides and citations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .ids import cases, has, let, s

MARK = re.compile(r'\\.|["{}]', re.S)
AROUND = r"(?U)^\s+|\s+$"
FENCE = r"(?s)^(?:```json|```JSON|```)?(.*?)(?:```)?$"  #: fixed values: how a fenced block begins and ends


def unfenced(text: Column) -> Column:
    """A text without the fence around it and the white space around that."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s(text), AROUND, ""), FENCE, "$1"), AROUND, "")


def balanced(text: str | None) -> str | None:
    """The first object of a text, to its closing brace; braces within strings don't count. All from its opening brace where it isn't closed; the text itself without one."""
    if text is None or (start := text.find("{")) < 0:
        return text
    depth, inside = 0, False
    for m in MARK.finditer(text, start):
        c = m[0]
        if c == '"':
            inside = not inside
        elif c[0] == "\\":
            if not inside and len(c) > 1 and c[1] in '"{}':  # outside a string, a backslash hides nothing
                if c[1] == '"':
                    inside = True
                else:
                    depth += 1 if c[1] == "{" else -1
        elif not inside:
            depth += 1 if c == "{" else -1
        if depth == 0 and not inside:
            return text[start : m.end()]
    return text[start:]


def first_object(text: Column) -> Column:
    @pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(balanced, na_action="ignore")

    return run(text.cast("string"))


def recovered(text: Column) -> Column:
    """A text that begins with a brace, up to the last closing brace; others as they are."""
    return F.regexp_replace(F.regexp_replace(s(text), AROUND, ""), r"(?s)^(\{.*\})[^}]*$", "$1")


#: What is asked for of a clinical text, and its summary.
ENTITIES = ("symptoms", "medications", "lab_values", "diagnoses", "vital_signs", "procedures", "action_items", "contradictions", "missing_info", "phi_flags")
SOAP = ("subjective", "objective", "assessment", "plan")
SURE = 0.9  #: fixed value: the confidence of a summary that names none


def _parsed(answer: Column, schema: str, body) -> Column:
    """``body`` of the object of an answer, read as it stands without a fence, else up to its last brace; null where neither is an object."""
    bare = unfenced(F.regexp_replace(s(answer), r"(?s)^.*?```(?:json)?\n?(.*?)\n?```.*$", "$1"))
    is_object = lambda t: F.startswith(t, F.lit("{")) & F.try_parse_json(t).isNotNull()
    # each step is worked out once
    text = let(bare, lambda t: F.when(is_object(t), t).otherwise(let(recovered(t), lambda r: F.when(is_object(r), r))))
    return let(F.from_json(text, schema), lambda got: F.when(got.isNotNull(), body(got)))


def entities(answer: Column) -> Column:
    """A struct of arrays of texts, one for each of ENTITIES, empty where the answer has none of a kind; null for an answer that is no object."""
    none = F.array().cast("array<string>")
    return _parsed(answer, ", ".join(f"{e} array<string>" for e in ENTITIES), lambda got: F.struct(*[F.coalesce(got[e], none).alias(e) for e in ENTITIES]))


def soap(answer: Column) -> Column:
    """(subjective, objective, assessment, plan, alerts, missing_info, confidence) of an answer; null for one that is no object."""
    none = F.array().cast("array<string>")
    schema = ", ".join(f"{x} string" for x in SOAP) + ", alerts array<string>, missing_info array<string>, confidence double"
    return _parsed(answer, schema, lambda got: F.struct(*[s(got[x]).alias(x) for x in SOAP], *[F.coalesce(got[x], none).alias(x) for x in ("alerts", "missing_info")], F.coalesce(got["confidence"], F.lit(SURE)).alias("confidence")))


# Units that keep a number from being a per cent, and terms of slides.
UNITS, SLIDE_TERMS = "月年天人例周个", ("BCLC B", "BCLC C", "BCLC A", "BCLC", "HBV", "HCC", "AFP", "ALBI", "tumor", "Tumor", "diameter", "median", "overall survival", "OS", "Barcelona", "vascular", "thrombus")
NUMBER = rf"([0-9]+\.?[0-9]*)(%?)([{UNITS}]?)"


def slide_data_points(text: Column) -> Column:
    """Numbers of a slide with their per cent twins, then terms, each once, as they come.

    Single figures without decimals or a per cent sign say nothing. A number with the sign counts with and without it, one of up to 100 that
    no unit follows gets it. Terms count whatever their case.
    """
    return let(s(text), _slide_data_points)


def _slide_data_points(text: Column) -> Column:
    part = lambda i: F.regexp_extract_all(text, F.lit(NUMBER), F.lit(i))
    found = F.zip_with(F.zip_with(part(1), part(2), lambda v, p: F.struct(v.alias("v"), p.alias("p"))), part(3), lambda x, u: F.struct(x["v"].alias("v"), x["p"].alias("p"), u.alias("u")))
    number = lambda x: x["v"].cast("double")
    told = F.filter(found, lambda x: ~((number(x) < 10) & (x["p"] == "") & ~F.contains(x["v"], F.lit("."))))
    twin = lambda x: (x["p"] == "%") | ((number(x) <= 100) & (x["u"] == ""))
    points = F.flatten(F.transform(told, lambda x: F.when(twin(x), F.array(x["v"], F.concat(x["v"], F.lit("%")))).otherwise(F.array(x["v"]))))
    terms = let(F.lower(text), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t.lower())), F.lit(t)) for t in SLIDE_TERMS])))
    return F.array_distinct(F.concat(points, terms))


def citation_features(text: Column) -> Column:
    """(surname, journal, year, volume, issue, pages, doi) of a citation in Latin or Chinese writing; empty where it has none."""
    t = s(text)
    one = lambda p, i=1: F.regexp_extract(t, p, i)
    either = lambda *xs: F.coalesce(*[F.nullif(x, F.lit("")) for x in xs], F.lit(""))
    latin = F.regexp_replace(F.trim(one(r"([A-Z][a-zA-Z.\s]+?)\.?\s*20[0-9]{2}")), r"\.+$", "")
    vip = r"20[0-9]{2}\s*;\s*([0-9]+)\s*\(([0-9]+)\)\s*:\s*([0-9\-]+)"
    return F.struct(
        either(one(r"^\s*([A-Z][a-zA-Z\-]+)\s+[A-Z]"), one(r"^([\x{4e00}-\x{9fff}]{2,4})")).alias("surname"), either(latin, one("《([^》]+)》")).alias("journal"), one(r"(?<![0-9A-Za-z_])((?:19|20)[0-9]{2})(?![0-9A-Za-z_])").alias("year"),
        one(vip, 1).alias("volume"), one(vip, 2).alias("issue"), one(vip, 3).alias("pages"), one(r"10\.[0-9]{4,9}/[A-Za-z0-9._\-()/]+", 0).alias("doi"),
    )


# Publishers by parts of addresses, and where a paper is looked for.
PUBLISHERS = (
    (("linkinghub.elsevier.com", "sciencedirect.com"), "ScienceDirect"), (("nejm.org",), "NEJM"), (("thelancet.com", "lancet.com"), "The Lancet"), (("jamanetwork.com",), "JAMA Network"), (("ascopubs.org", "asco.org"), "ASCO"), (("aacrjournals.org",), "AACR"), (("nature.com",), "Nature"), (("wiley.com",), "Wiley"),
    (("springer.com", "biomedcentral.com", "bmc"), "BMC/Springer"), (("plos.org",), "PLOS"), (("oup.com",), "Oxford"), (("frontiersin.org",), "Frontiers"), (("sagepub.com",), "SAGE"), (("oncotarget.com",), "Oncotarget"), (("lww.com", "wolterskluwer"), "LWW"), (("mdpi.com",), "MDPI"),
    (("bmj.com",), "BMJ"), (("karger",), "Karger"), (("tandfonline.com",), "Taylor & Francis"), (("acs.org",), "ACS"), (("annualreviews.org",), "Annual Reviews"), (("pubmed.ncbi.nlm.nih.gov",), "PubMed"), (("europepmc.org",), "Europe PMC"),
)
SEARCHES = (("DOI 主链接", "https://doi.org/"), ("PubMed 搜索", "https://pubmed.ncbi.nlm.nih.gov/?term="), ("Europe PMC 搜索", "https://europepmc.org/search?query="))
NO_PAPER, FULL_TEXT, OTHER, SCHOLAR = "备注", " 全文", "出版商", "https://scholar.google.com"


def publisher_label(url: Column) -> Column:
    u = F.lower(s(url))
    return cases([(has(u, *parts), label) for parts, label in PUBLISHERS], OTHER)


def paper_addresses(doi: Column, verified: Column) -> Column:
    """(label, url) of the places of a paper: its verified address with its publisher's name, the DOI's, two searches; none without a DOI."""
    fixed = [F.struct(F.lit(label).alias("label"), F.concat(F.lit(url), doi).alias("url")) for label, url in SEARCHES]
    first = F.when(s(verified) != "", F.array(F.struct(F.concat(publisher_label(verified), F.lit(FULL_TEXT)).alias("label"), verified.alias("url")))).otherwise(F.array().cast("array<struct<label:string,url:string>>"))
    return F.when((s(doi) == "") | F.startswith(doi, F.lit(NO_PAPER)), F.array().cast("array<struct<label:string,url:string>>")).otherwise(F.concat(first, F.array(*fixed)))


def absolute_link(href: Column, base: str = SCHOLAR) -> Column:
    """A link of a result page in full; empty ones stay empty."""
    h = s(href)
    return cases([((h == "") | F.startswith(h, F.lit("http")), h), (F.startswith(h, F.lit("/")), F.concat(F.lit(base), h))], F.concat(F.lit(f"{base}/"), h))
