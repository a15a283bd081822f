"""Wider extraction: windows around journals, notes, keywords, claims, terms, links.

Lexicons are plain tables; of keywords with equal weight the longest wins, then
the first by name.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T
from .ids import cases, has, let, rx, s

VOLUME = r"\d{4}[;:,]\s*\d+|;\s*\d+[:\s]\d+[-–]\d+|\d+\s*\(\d+\)\s*:\s*\d+"
NAMED = r"[A-Z][a-z]+\s+[A-Z]{1,3}\b|et al"
DOI = r"10\.\d{4,9}/\S+"
REACH = 120


def windows(text: Column, reach: int = REACH) -> Column:
    """Stretches around journal names that also hold two of year, author, volume with pages, DOI; equal ones (without case and spaces) once.

    A window takes ``reach`` characters on either side of a name.
    """
    t = F.trim(F.regexp_replace(s(text), r"\s+", " "))
    parts = lambda t: F.struct(t.alias("t"), F.regexp_extract_all(t, F.lit(T.JOURNAL), F.lit(0)).alias("found"), F.split(t, T.JOURNAL, -1).alias("gaps"))
    total = lambda a, n: F.aggregate(F.slice(a, F.lit(1), n), F.lit(0), lambda x, y: x + F.length(y))
    signs = lambda w: sum((rx(w, p).cast("int") for p in (T.YEAR, NAMED, VOLUME)), rx(w, DOI).cast("int"))
    key = lambda w: F.lower(F.regexp_replace(w, r"\s+", ""))

    def stretches(p: Column) -> Column:
        def stretch(m: Column, i: Column) -> Column:
            start = total(p["gaps"], i + 1) + total(p["found"], i)
            lo = F.greatest(start - reach, F.lit(0))
            return F.substring(p["t"], lo + 1, start - lo + F.length(m) + reach)

        return F.filter(F.transform(p["found"], stretch), lambda w: (signs(w) >= 2) & (F.octet_length(w) >= 10))

    kept = let(let(t, parts), stretches)
    return let(F.transform(kept, lambda w: F.struct(key(w).alias("k"), w.alias("w"))), lambda ks: F.transform(F.filter(ks, lambda x, i: F.array_position(F.transform(ks, lambda y: y["k"]), x["k"]) == i + 1), lambda x: x["w"]))


def line_score(line: Column) -> Column:
    """Evidence that a line is a citation: one each for year, journal, volume, author, number; two each for DOI and PMID; a heading counts as enough."""
    low = F.lower(s(line))
    n = lambda c, w=1: c.cast("int") * w
    score = n(rx(line, T.YEAR)) + n(rx(line, T.JOURNAL)) + n(rx(line, VOLUME)) + n(has(low, "doi:") | rx(line, DOI), 2) + n(has(low, "pmid:"), 2) + n(rx(line, NAMED)) + n(T.ref_number(line).isNotNull())
    return F.when(has(low, "reference") | has(s(line), "参考文献"), F.greatest(score, F.lit(2))).otherwise(score)


# Words that route a line of notes.
DATA_WORDS = ("疗效:", "5年", "5-y", "OS率", "mOS", "OS HR", "OS", "TRAE", "随访", "mTTFS", "关键研究", "Grade 3/4", "STRIDE", "索拉非尼", "Len", "T+A", "O+Y", "n=", "vs", "ORR", "DCR", "PFS", "HR", "中位", "率:", "月:", "%", "桥头堡", "队列", "中国#")
REASON_WORDS = ("注:", "引文:", "跨文献", "4 与 3", "支持", "主张", "语义", "main finding", "长尾", "100%", "应证")


def notes(cell: Column) -> Column:
    """(visual, data, reasons): places as ``位置1: 「x」 (y)``, lines with figures and a medical word, lines that argue; each once."""
    lines = F.transform(F.split(s(cell), "\n"), lambda v: F.trim(F.regexp_replace(F.trim(v), "^[- ]+", "")))
    pick = lambda words, more: F.array_distinct(F.filter(lines, lambda v: (v != "") & has(v, *words) & more(v)))
    visual = F.zip_with(F.regexp_extract_all(s(cell), F.lit(r"位置\d+:\s*「(.+?)」\s*\((.+?)\)"), F.lit(1)), F.regexp_extract_all(s(cell), F.lit(r"位置\d+:\s*「(.+?)」\s*\((.+?)\)"), F.lit(2)), lambda a, b: F.concat(a, F.lit(" ("), b, F.lit(")")))
    return F.struct(visual.alias("visual"), pick(DATA_WORDS, lambda v: rx(v, "[0-9]")).alias("data"), pick(REASON_WORDS, lambda v: F.lit(True)).alias("reasons"))


def keywords(citation: Column, context: Column, known: tuple[str, ...], journals: tuple[str, ...], least: float = 0.3, most: int = 12) -> Column:
    """Terms (term, confidence, kind) by confidence: per cents 0.9, hazard ratios 0.85, known terms 0.85, frequent Chinese words 0.6 or 0.4, journals 0.5, years 0.4, the surname 0.3; ``most`` at most."""
    weights = {"percentage": 0.9, "hr": 0.85, "drug_or_trial": 0.85, "cn_term": 0.6, "journal": 0.5, "rare_cn_term": 0.4, "year": 0.4, "author_surname": 0.3}
    none = F.array().cast("array<string>")

    def terms(full: Column) -> Column:
        every = lambda p, i=0: F.regexp_extract_all(full, F.lit(p), F.lit(i))
        listed = lambda words: F.array_compact(F.array(*[F.when(F.contains(full, F.lit(w)), F.lit(w)) for w in words])) if words else none
        # Most texts have neither sign: a look for it costs less than the pattern.
        per_cent = F.when(F.contains(full, F.lit("%")), F.transform(every(r"(\d+\.?\d*)\s*%", 1), lambda x: F.concat(x, F.lit("%")))).otherwise(none)
        ratio = F.flatten(F.transform(every(r"(?i)HR\s*[=:]?\s*(\d+\.?\d*)", 1), lambda x: F.array(F.concat(F.lit("HR "), x), F.concat(F.lit("HR="), x), x)))
        chinese = F.regexp_extract_all(s(context), F.lit("[一-鿿]{2,4}"), F.lit(0))
        counted = let(chinese, lambda cs: F.struct(cs.alias("every"), F.filter(cs, lambda w: F.array_position(cs, w) < F.size(cs) - F.array_position(F.reverse(cs), w) + 1).alias("again")))
        years = F.when(has(s(context), "发表", "年份"), every(T.YEAR)).otherwise(none)
        surname = F.array_remove(F.array(F.regexp_extract(s(citation), r"^\s*([A-Z][a-zA-Z\-]+)", 1)), "")
        found = {"percentage": per_cent, "hr": ratio, "drug_or_trial": listed(known), "journal": listed(journals), "year": years, "author_surname": surname}
        return F.struct(*[v.alias(k) for k, v in found.items()], counted.alias("counted"))

    def items(weight: float, kinds: list[str], lists: list[Column]) -> Column:
        """Distinct terms of one weight, by term, then in the order of the kinds."""
        kind = lambda x: cases([(x["i"] == i, k.removeprefix("rare_")) for i, k in enumerate(kinds[1:], 1)], kinds[0].removeprefix("rare_"))
        tagged = [F.transform(v, (lambda i: lambda x: F.struct(x.alias("term"), F.lit(i).alias("i")))(i)) for i, v in enumerate(lists)]
        return F.transform(F.sort_array(F.concat(*tagged)), lambda x: F.struct(F.lit(weight).cast("double").alias("confidence"), x["term"].alias("term"), kind(x).alias("kind")))

    def ordered(found: Column) -> Column:
        of = {k: found["counted"]["again"] if k == "cn_term" else found["counted"]["every"] if k == "rare_cn_term" else found[k] for k in weights}
        out, above = [], none
        for weight in sorted({w for w in weights.values() if w >= least}, reverse=True):
            kinds = [k for k in weights if weights[k] == weight]
            out.append(items(weight, kinds, [F.array_except(of[k], above) for k in kinds]))  # a term counts with its highest weight
            above = F.concat(above, *[of[k] for k in kinds])
        return F.slice(F.concat(*out), 1, most) if out else F.array().cast("array<struct<confidence:double,term:string,kind:string>>")

    return let(let(F.concat_ws(" ", s(citation), s(context)), terms), ordered)


def term_variants(term: Column) -> Column:
    """Ways to write a per cent, a hazard ratio or a number of cases; without blanks too."""
    t = s(term)
    g = lambda p: F.regexp_extract(t, p, 1)
    p, h, n = g(r"^(\d+\.?\d*)\s*%$"), g(r"^HR\s*(\d+\.?\d*)$"), g(r"^n=(\d+)$")
    ways = lambda x, *fs: [F.when(x != "", F.concat(*[x if q is None else F.lit(q) for q in f])) for f in fs]
    out = [t, *ways(p, (None, "%"), (None, " %"), (None, "％")), *ways(h, ("HR", None), ("HR ", None), ("HR = ", None), ("HR=", None), (None,)), *ways(n, ("n = ", None), ("n= ", None), (" n ", None, " "))]
    out.append(F.when(F.contains(t, F.lit(" ")), F.replace(t, F.lit(" "), F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(F.array(*out), lambda v: v.isNotNull())))


# Lexicons of claims, with weights or meanings.
PLACES = {"中国": 1.0, "中国⼤陆": 1.0, "China": 1.0, "Chinese": 0.9, "美国": 0.7, "USA": 0.7, "United States": 0.7, "全球": 0.5, "global": 0.5, "worldwide": 0.5, "亚太": 0.8, "Asia": 0.8, "Asian": 0.7, "欧洲": 0.6, "Europe": 0.6, "European": 0.6, "日本": 0.7, "Japan": 0.7, "韩国": 0.7, "Korea": 0.7}
ILLNESSES = {"肝癌": 1.0, "HCC": 1.0, "hepatocellular": 1.0, "liver cancer": 1.0, "肝细胞癌": 1.0, "原发性肝癌": 1.0, "肝肿瘤": 0.9, "肺癌": 1.0, "lung cancer": 1.0, "Lung": 0.8, "胃癌": 1.0, "stomach cancer": 1.0, "gastric": 1.0, "乳腺癌": 1.0, "breast cancer": 1.0, "breast": 0.8, "结直肠癌": 1.0, "colorectal": 1.0, "colon": 0.8, "胰腺癌": 1.0, "pancreatic": 1.0, "pancreas": 1.0, "前列腺癌": 1.0, "prostate": 1.0, "卵巢癌": 1.0, "ovarian": 1.0, "宫颈癌": 1.0, "cervical": 1.0, "甲状腺癌": 1.0, "thyroid": 1.0}
MEASURES = {"5年生存率": 1.0, "5-year survival": 1.0, "five-year survival": 1.0, "5 year survival": 1.0, "survival rate": 0.9, "发病率": 1.0, "incidence": 1.0, "incident": 0.8, "死亡率": 1.0, "mortality": 1.0, "death rate": 0.8, "患病率": 1.0, "prevalence": 1.0, "新发病例": 0.9, "new cases": 0.9, "死亡病例": 0.9, "deaths": 0.9, "ORR": 1.0, "PFS": 1.0, "OS": 1.0, "overall survival": 1.0, "DCR": 1.0}
CONCLUSIONS = {"远低于其他": "below_all", "远低于": "below", "低于": "below", "显著低于": "significantly_below", "高于": "above", "远高于": "far_above", "显著高于": "significantly_above", "等于": "equal", "相似": "similar", "普遍高于": "mostly_above", "普遍低于": "mostly_below", "大多数": "majority", "far below other": "below_all", "far below": "below", "below other": "below_all", "below all": "below_all", "below": "below", "above all": "above_all", "above other": "above_all", "above": "above", "mostly above": "mostly_above", "mostly below": "mostly_below", "majority": "majority"}
OTHERS = ("其他癌种", "其他癌肿", "其他癌症", "其他 cancer", "other cancers", "other cancer types", "其他恶性肿瘤")


def _best(text: Column, weights: dict[str, float]) -> Column:
    low = F.lower(s(text))
    order = sorted(weights, key=lambda k: (-weights[k], -len(k.encode()), k))
    return cases([(F.contains(low, F.lit(k.lower())), k) for k in order], "")


def claim(text: Column) -> Column:
    """(geography, disease, indicator, value, number, unit, target, conclusion) of a sentence that claims something."""
    low = F.lower(s(text))
    per_cent, plain = F.regexp_extract(s(text), r"(\d+(?:\.\d+)?)\s*%", 1), F.regexp_extract(s(text), r"(\d+(?:\.\d+)?)", 1)
    number = F.when(per_cent != "", per_cent).otherwise(plain)
    order = sorted(CONCLUSIONS, key=lambda k: (-len(k.encode()), k))
    return F.struct(
        _best(text, PLACES).alias("geography"),
        _best(text, ILLNESSES).alias("disease"),
        _best(text, MEASURES).alias("indicator"),
        F.when(per_cent != "", F.regexp_extract(s(text), r"\d+(?:\.\d+)?\s*%", 0)).otherwise(plain).alias("value"),
        F.coalesce(F.nullif(number, F.lit("")).cast("double"), F.lit(0.0)).alias("number"),
        F.when(per_cent != "", "%").otherwise("").alias("unit"),
        F.when(has(low, *[o.lower() for o in OTHERS]), "其他癌种").otherwise(_best(text, ILLNESSES)).alias("target"),
        cases([(F.contains(low, F.lit(k.lower())), CONCLUSIONS[k]) for k in order], "").alias("conclusion"),
    )


def _clauses(authors: Column, journal: Column, year: Column) -> tuple[Column, Column, Column]:
    """(first surname, clause of the journal, clause of the year); clauses are null where there is nothing to search for."""
    name = F.trim(F.regexp_replace(F.trim(F.substring_index(s(authors), ",", 1)), r"\s*et al.*$", ""))
    surname = F.regexp_replace(F.substring_index(name, " ", 1), r"[.,;:]+$", "")
    meeting = rx(F.lower(s(journal)), "abstract|congress|conference|meeting|symposium|annual|presented|poster|asco|esmo")
    where = F.when((s(journal) != "") & ~meeting, F.concat(F.lit('"'), journal, F.lit('"[Journal]')))
    return surname, where, F.when(year.between(1990, 2030), F.concat(year.cast("string"), F.lit("[Date - Publication - Year]")))


def search_clause(authors: Column, journal: Column, year: Column, title: Column) -> Column:
    """Clauses for a bibliographic search, joined by AND: surname, journal, year, and three words of the title where there is at most one other."""
    surname, where, when = _clauses(authors, journal, year)
    author = F.when((F.octet_length(surname) >= 2) & ~T.mostly_chinese(surname), F.concat(F.lit('"'), surname, F.lit('"[Author]')))
    parts = F.filter(F.array(author, where, when), lambda p: p.isNotNull())
    words = F.filter(F.split(s(title), r"\s+"), lambda w: w != "")
    fragment = F.when((F.size(parts) <= 1) & (F.size(words) >= 3), F.array(F.concat(F.lit('"'), F.array_join(F.slice(words, 1, 3), " "), F.lit('"[Title/Abstract]')))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(parts, fragment), " AND ")


def wider_searches(authors: Column, journal: Column, year: Column) -> Column:
    """(name, query) of the searches that follow where a clause finds nothing, in the order in which they are tried: journal and year, surname, journal."""
    surname, where, when = _clauses(authors, journal, year)
    both = F.concat(where, F.lit(" AND "), when)
    who = F.when((F.octet_length(surname) >= 3) & ~T.mostly_chinese(surname), F.concat(F.lit('"'), surname, F.lit('"[Author]')))
    tried = (("relaxed", both), ("author", who), ("journal", F.coalesce(both, where)))
    return F.filter(F.array(*[F.struct(F.lit(n).alias("name"), q.alias("query")) for n, q in tried]), lambda t: t["query"].isNotNull())


def main_score(has_main: Column, measured: Column, hits: Column, terms: Column, triggered: Column) -> Column:
    """How far a main file bears out a slide: what was measured, else the share of terms that were found (1 at most), else 0.4 where a fallback was called for; null where nothing is known."""
    share = F.round(F.least(F.coalesce(hits, F.lit(0)) / terms, F.lit(1.0)), 2)
    return F.when(~F.coalesce(has_main, F.lit(False)), 0.0).when(measured.isNotNull(), measured).when(terms > 0, share).when(triggered, 0.4)


LINK = r"\[([^\]]+)\]\((https?://[^)\s]+)\)"


def markdown_nodes(text: Column) -> Column:
    """Segments (text, type, link) of markdown: links by their label, the rest as text."""
    t = s(text)
    labels, urls = (F.regexp_extract_all(t, F.lit(LINK), F.lit(i)) for i in (1, 2))
    gaps = F.split(t, LINK, -1)
    node = lambda a, b, c: F.struct(a.alias("text"), F.lit(b).alias("type"), c.alias("link"))
    blank = F.lit("").cast("string")
    pairs = F.struct(labels.alias("a"), urls.alias("b"))
    nodes = let(pairs, lambda p: F.flatten(F.transform(gaps, lambda g, i: F.array(node(g, "text", blank), node(F.coalesce(F.get(p["a"], i), F.lit("")), "url", F.coalesce(F.get(p["b"], i), F.lit("")))))))
    return F.filter(nodes, lambda n: n["text"] != "")


def markdown_of(nodes: Column) -> Column:
    return F.array_join(F.transform(nodes, lambda n: F.when(n["type"] == "url", F.concat(F.lit("["), n["text"], F.lit("]("), n["link"], F.lit(")"))).otherwise(n["text"])), "")


def fallback_score(name: Column, triggered: Column) -> Column:
    """How far a supplementary file bears out a page, by its name."""
    n = F.lower(s(name))
    return cases(
        [
            (has(n, "icmje", "disclosure"), 0.30), (has(n, "review", "standard"), 0.65), (has(n, "appendix"), 0.50), (has(n, "卫健委", "政府", "令汇编", "nhc", "gov", "regulation"), 0.75), (has(n, "bray", "caac"), 0.85),
            (has(n, "globocan") | (has(n, "2024") & has(n, "china")), 0.65), (has(n, "abstract", "asco", "esmo"), 0.55), (has(n, "nejm", "lancet"), 0.70), (triggered, 0.60),
        ],
        0.50,
    )


def page_verdict(citation: Column, page_text: Column) -> Column:
    """(verdict, score) of a document's first page: 2 for its journal, 1 for the year, 1 for an author."""
    t, low = s(page_text), F.lower(s(page_text))
    f = T.key_fields(citation)
    score = ((f["journal"] != "") & F.contains(low, F.lower(f["journal"]))).cast("int") * 2 + ((f["year"] != "") & F.contains(t, f["year"])).cast("int") + F.exists(f["authors"], lambda a: F.contains(low, F.lower(a))).cast("int")
    return F.struct(cases([(F.trim(t) == "", "no_text"), (score >= 3, "ok"), (score >= 1, "suspicious")], "mismatch").alias("verdict"), score.alias("score"))


# Folding of characters with the way back, which needs positions: Arrow batches.

#: Ligatures and what they stand for; characters that are dropped; umlauts as some documents write them.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}
DROPPED = " 　\n\r\t\xa0\xad​   "
UMLAUTS = (("€u", "ü"), ("€o", "ö"), ("€a", "ä"), ("€U", "Ü"), ("€O", "Ö"), ("€A", "Ä"))


def fold(text: str) -> tuple[str, list[int]]:
    """(folded text, for each of its characters the place in the text): half width, without blanks, ligatures taken apart."""
    for a, b in UMLAUTS:
        text = text.replace(a, b)
    out, at = [], []
    for i, c in enumerate(text):
        if c in DROPPED:
            continue
        k = chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else LIGATURES.get(c, c)
        out.append(k)
        at += [i] * len(k)
    return "".join(out), at


def places(text: str | None, sentence: str | None) -> list[dict]:
    folded, at = fold(text or "")
    key, _ = fold(sentence or "")
    found, i = [], folded.find(key) if key else -1
    while i >= 0:
        found.append({"start": at[i], "stop": at[i + len(key) - 1] + 1})
        i = folded.find(key, i + 1)
    return found


def locate(text: Column | str, sentence: Column | str) -> Column:
    """Every place (start, stop) of a sentence in a text, once both are folded."""

    @F.pandas_udf("array<struct<start:int,stop:int>>")
    def run(texts: pd.Series, sentences: pd.Series) -> pd.Series:
        return pd.Series([places(t, q) for t, q in zip(texts, sentences, strict=True)])

    return run(text, sentence)
