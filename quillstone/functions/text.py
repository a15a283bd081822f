"""Extraction from text as column expressions.

Word borders are ASCII: a letter, digit or underscore on the other side is no
border, whatever script surrounds it. Lengths that the rules state in bytes are
measured in bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .ids import cases, has, let, rx, s

NO_BEFORE, NO_AFTER = r"(?<![0-9A-Za-z_])", r"(?![0-9A-Za-z_])"


def word(pattern: str) -> str:
    return f"{NO_BEFORE}(?:{pattern}){NO_AFTER}"


# Names of journals, trials and drugs, as patterns, in order.
JOURNAL = word(
    r"Lancet(?:\s+Oncol|Oncol|Gastroenterol|Gastro)?|NEJM(?:\s+Evid|Evid)?|JAMA(?:\s+Oncol)?|N\.?\s*Engl\.?\s*J\.?\s*Med|J\.?\s*Clin\.?\s*(?:Oncol|Invest)|JNCC|J\.?\s*Natl\.?\s*Cancer\s+Inst|J\.?\s*Hepatol|JCO|JAMA\s+Oncol|Cancer\s+Cell"
    r"|Nat\.?\s*(?:Med|Immunol|Cancer|Commun|Rev|Biotechnol|Genet)|Cell|Hepatology|Gastroenterology|Gut|Br\s*J\s*Cancer|Ann\.?\s*Oncol|Sci\.?\s*(?:Transl|Immunol)|Sig\s*Transduct|Clin\.?\s*Cancer\s+Res|J\.?\s*Hematol|Science|Lancet\s*Glob"
    r"|Eur\.?\s*J\s*Cancer|Cell\s*Res|EMJ|Hepatol\s*Int|Liver\s*Cancer|Anticancer\s*Res|Br\s*J\s*Clin|JAMA\s+Intern\s+Med|Lancet\s*Diabetes\s*Endocrinol|Front\.?\s*(?:Oncol|Immunol)|Cancer\s*Res|medRxiv"
)
JOURNAL_2 = word("BMJ|medRxiv")
TRIAL = word(
    r"HIMALAYA|IMbrave150|CheckMate\s*(?:9DW|9X|040|227)|APOLLO|TREMENDOUS|REFLECT|SHARP|LEAP-?002|TRIPLET|CARES-?310|RATIONALE-?301|ORIENT-?32|HEPATORCH|EMERALD-?\w*|TALENTACE|TALENTOP|TIMES|CARES-?005|KEYNOTE-?\d*|RESORCE|CELESTIAL|METEOR|REACH-?2|GoBigger"
)
DRUG = word(
    "Tremelimumab|Durvalumab|Atezolizumab|Bevacizumab|Sintilimab|Tislelizumab|Camrelizumab|Pembrolizumab|Nivolumab|Ipilimumab|Sorafenib|Lenvatinib|Donafenib|Apatinib|Penpulimab|Anlotinib|Cabozantinib|Regorafenib|Quavonlimab|Teripalatide"
    "|Toripalimab|Selumetinib|Vandetanib|Axitinib|Sunitinib|Pazopanib"
)
YEAR = word(r"19\d{2}|20\d{2}")
AUTHOR = word(r"[A-Z][a-z]+(?:-[A-Z][a-z]+)*")
#: Capitalised words that end a list of authors.
AUTHOR_STOPS = (
    "Lancet NEJM JAMA Cell Hepatology Gastroenterology Gut Science Nature Cancer Br Ann Sig Eur Front BMJ Nat Clin "
    "Tremelimumab Durvalumab Atezolizumab Bevacizumab Sintilimab Tislelizumab Camrelizumab Pembrolizumab Nivolumab Ipilimumab Sorafenib Lenvatinib"
).split()


def first(text: Column, *patterns: str) -> Column:
    """The first match of the first pattern that matches; else empty."""
    found = [F.regexp_extract(s(text), p, 0) for p in patterns]
    return cases([(f != "", f) for f in found[:-1]], found[-1])


def authors(text: Column) -> Column:
    """Up to five capitalised names of three letters at least, before a journal or drug, in the first 200 characters."""
    names = F.filter(F.regexp_extract_all(F.substring(s(text), 1, 200), F.lit(AUTHOR), F.lit(0)), lambda w: F.length(w) >= 3)

    def cut(n: Column) -> Column:
        stop = F.filter(F.transform(n, lambda w, i: F.when(w.isin(*AUTHOR_STOPS), i)), lambda i: i.isNotNull())
        return F.slice(n, F.lit(1), F.least(F.coalesce(F.get(stop, F.lit(0)), F.size(n)), F.lit(5)))

    return let(names, cut)


def doi_tail(text: Column) -> Column:
    """What follows ``10.`` digits and a slash, without stops at its end."""
    return F.regexp_replace(F.regexp_extract(s(text), r"10\.\d+/([A-Za-z0-9._\-/]+)", 1), r"[,;. \t\n]+$", "")


def key_fields(text: Column) -> Column:
    return F.struct(
        authors(text).alias("authors"),
        first(text, JOURNAL, JOURNAL_2).alias("journal"),
        first(text, YEAR).alias("year"),
        first(text, TRIAL).alias("trial"),
        first(text, DRUG).alias("drug"),
        doi_tail(text).alias("doi_tail"),
    )


def normalized(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s(text), "[ \t\n]+", " ")))


def match_fields(fields: Column, text: Column) -> Column:
    """(score, matched, missing, reason): which of a citation's fields occur in a text."""
    return let(F.struct(fields.alias("f"), normalized(text).alias("t")), lambda x: _matched(x["f"], x["t"]))


def _matched(fields: Column, t: Column) -> Column:
    journal = F.lower(fields["journal"])
    found = F.array(
        *[
            F.struct(F.lit(name).alias("name"), given.alias("given"), there.alias("there"))
            for name, given, there in (
                ("authors", F.size(fields["authors"]) > 0, F.exists(fields["authors"], lambda a: F.contains(t, F.lower(a)))),
                ("year", fields["year"] != "", F.contains(t, fields["year"])),
                ("journal", journal != "", F.contains(t, journal) | F.contains(t, F.replace(journal, F.lit(" "), F.lit(""))) | F.contains(t, F.substring(journal, 1, 8))),
                ("trial", fields["trial"] != "", F.contains(t, F.lower(fields["trial"]))),
                ("drug", fields["drug"] != "", F.contains(t, F.lower(fields["drug"]))),
                ("doi_tail", fields["doi_tail"] != "", F.contains(t, F.lower(fields["doi_tail"]))),
            )
        ]
    )
    return let(found, _rated)


def _rated(found: Column) -> Column:
    pick = lambda there: F.transform(F.filter(found, lambda f: f["given"] & (f["there"] == there)), lambda f: f["name"])
    total = F.size(F.filter(found, lambda f: f["given"]))
    score = F.when(total > 0, F.size(pick(True)) / total).otherwise(0.0)
    reason = cases([(score == 1.0, "perfect match"), (score >= 0.5, "good match"), (score > 0, "partial match")], "no match")
    return F.struct(score.alias("score"), pick(True).alias("matched"), pick(False).alias("missing"), reason.alias("reason"))


PAGES = r"(\d{4}[;:,]\s*\d+|;\s*\d+[:\s]\d+[-–]\d+|\d+[-–]\d+)"


def ref_number(line: Column) -> Column:
    """A leading reference number as in ``12. Smith`` or ``12) Smith``; else null."""
    return F.nullif(F.regexp_extract(F.trim(line), r"^\[?([0-9]{1,3})\s*[.)\]]", 1), F.lit("")).cast("int")


def is_citation(line: Column) -> Column:
    """30 bytes at least, and a leading number, author and year, journal and pages, or two semicolons and a year."""
    author = rx(line, r"^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*,?") | has(F.lower(line), "et al")
    journal = rx(line, JOURNAL)
    year = rx(line, YEAR)
    pages = rx(line, PAGES) | rx(line, r"PMID:\s*\d+")
    return (F.octet_length(line) >= 30) & (ref_number(line).isNotNull() | (author & year) | (journal & pages) | ((F.regexp_count(line, F.lit(";")) >= 2) & year))


def volume_pages(line: Column) -> Column:
    """(volume, issue, pages) of ``Y;V(I):P``, ``Y;V:P`` or ``;V:P``."""
    part = lambda i: F.regexp_extract(line, r";\s*(\d+)\s*(?:\((\d+)\))?\s*:\s*(\d+(?:[-–]\d+)?)", i)
    return F.struct(part(1).alias("volume"), part(2).alias("issue"), part(3).alias("pages"))


def parse_citation(line: Column) -> Column:
    v = volume_pages(line)
    return F.struct(
        ref_number(line).alias("number"),
        F.trim(F.regexp_extract(line, r"^(?:\[?[0-9]{1,3}\s*[.)\]]\s*)?(.*?)(?:\.\s|$)", 1)).alias("authors"),
        first(line, JOURNAL, JOURNAL_2).alias("journal"),
        F.coalesce(F.try_element_at(F.regexp_extract_all(line, F.lit(YEAR), F.lit(0)), F.lit(-1)), F.lit("")).alias("year"),
        v["volume"].alias("volume"),
        v["issue"].alias("issue"),
        v["pages"].alias("pages"),
        F.regexp_extract(line, r"PMID:\s*(\d+)", 1).alias("pmid"),
        F.regexp_replace(F.regexp_extract(line, r"(?i)doi:\s*(10\.\d{4,9}/\S+)", 1), r"[.,;]+$", "").alias("doi"),
        first(line, TRIAL).alias("trial"),
    )


def split_numbered(text: Column) -> Column:
    """Segments of 20 bytes at least that begin with ``N.`` or ``N)`` and a capital; the whole text where there are fewer than two."""
    t = F.replace(s(text), F.lit("  "), F.lit(" "))
    parts = F.filter(F.transform(F.split(t, r"(?<![0-9])(?=[1-9][0-9]?\s*[.)]\s*[A-Z])"), lambda p: F.trim(p)), lambda p: rx(p, r"^[1-9][0-9]?\s*[.)]\s*[A-Z]") & (F.octet_length(p) >= 20))
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(t))


def expand_marks(marks: Column) -> Column:
    """``1, 3-5`` as [1, 3, 4, 5]: each number once, in order; ranges may run backwards, other parts are ignored."""
    parts = F.transform(F.split(s(marks), r"[,，]\s*"), lambda p: F.trim(p))
    num = lambda p, i: F.nullif(F.regexp_extract(p, r"^(\d{1,9})(?:\s*[-–—~]\s*(\d{1,9}))?$", i), F.lit("")).cast("int")

    def span(p: Column) -> Column:
        a, b = num(p, 1), F.coalesce(num(p, 2), num(p, 1))
        return F.when(a.isNotNull(), F.sequence(F.least(a, b), F.greatest(a, b))).otherwise(F.array().cast("array<int>"))

    return F.array_distinct(F.flatten(F.transform(parts, span)))


def number_variants(value: Column) -> Column:
    """Ways to write a number: with one to three decimals, without trailing zeros, with and without a per cent sign."""
    bare = lambda v: F.regexp_replace(v, "%+$", "")
    number = lambda b: F.when(rx(b, r"^-?\d+(\.\d+)?$"), b).cast("double")
    # each step is worked out once
    return let(s(value), lambda v: let(bare(v), lambda b: let(number(b), lambda n: F.when(n.isNull(), F.array(v)).otherwise(let(_decimals(b, n), lambda plain: _variants(v, b, n, plain))))))


def _decimals(bare: Column, number: Column) -> Column:
    """A number with one to three decimals, each behind what is left without its zeros, unless that is how it was written."""
    fixed = F.array(*[F.format_string(f"%.{p}f", number) for p in (1, 2, 3)])
    short = lambda f: F.regexp_replace(F.regexp_replace(f, "0+$", ""), r"\.$", "")
    return F.flatten(F.transform(fixed, lambda f: let(short(f), lambda a: F.when(a != bare, F.array(a, f)).otherwise(F.array(f)))))


def _variants(value: Column, bare: Column, number: Column, plain: Column) -> Column:
    both = F.flatten(F.transform(plain, lambda x: F.array(x, F.concat(x, F.lit("%")))))
    with_sign = F.array_distinct(F.concat(F.array(value), both, F.array(bare)))
    without = F.concat(F.array(value), plain)
    signed = F.transform(plain, lambda x: F.concat(x, F.lit("%")))
    return F.when(has(value, "%"), with_sign).when(number <= 100, F.array_distinct(F.concat(without, F.array(F.concat(bare, F.lit("%"))), signed))).otherwise(F.array_distinct(without))


def data_points(text: Column) -> Column:
    """Numbers worth looking up: those with a per cent sign or decimals, or of 10 and more; each once."""
    found = F.regexp_extract_all(s(text), F.lit(r"\d+(?:\.\d+)?%?"), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: F.endswith(x, F.lit("%")) | F.contains(x, F.lit(".")) | (F.length(x) >= 2)))


def unit_of(context: Column) -> Column:
    c, low = s(context), F.lower(s(context))
    return cases(
        [
            (has(c, "percentage", "百分比", "%", "ratio", "rate") & (has(c, "%") | has(low, "percent")), "percentage"),
            (has(c, "month", "月份", "月OS", "月生存", "月PFS", "median OS"), "month"),
            (has(c, "year", "年OS", "年生存", "5年", "5-year"), "year"),
        ],
        "",
    )


def fold_width(text: Column) -> Column:
    """Full-width forms to ASCII, the ideographic space to a space."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(s(text), wide, "".join(chr(c) for c in range(0x21, 0x7F)) + " ")


def authors_venue(text: Column) -> Column:
    """(authors, journal, year) of ``A Smith, B Lee - Journal, 2020``."""
    t = s(text)
    parted = F.contains(t, F.lit(" - "))
    head = F.when(parted, F.substring_index(t, " - ", 1)).otherwise("")
    venue = F.when(parted, F.substring(t, F.length(head) + 4, F.length(t))).otherwise(t)
    year = F.regexp_extract(venue, r"(\d{4})\s*$", 1)
    names = F.filter(F.transform(F.split(head, ", "), lambda p: F.trim(p)), lambda a: a != "")
    journal = F.trim(F.regexp_replace(F.regexp_replace(venue, r"\d{4}\s*$", ""), "[, ]+$", ""))
    return F.struct(names.alias("authors"), journal.alias("journal"), F.when(year.between("1900", "2100"), year).otherwise("").alias("year"))


def mostly_chinese(text: Column) -> Column:
    n = F.length(F.regexp_replace(s(text), r"[^一-鿿]", ""))
    return n > F.floor(F.length(s(text)) / 2)


def from_latin(text: Column) -> Column:
    """A text from its first Latin letter, comma or full stop on, trimmed; empty without one."""
    return F.trim(F.regexp_extract(s(text), r"(?s)[A-Za-z,.].*", 0))


#: Journal names in full and their abbreviations.
ABBREVIATIONS = {
    "lancet oncology": "Lancet Oncol",
    "new england journal of medicine": "N Engl J Med",
    "journal of hepatology": "J Hepatol",
    "jama oncology": "JAMA Oncol",
    "frontiers in oncology": "Front Oncol",
    "annals of oncology": "Ann Oncol",
}

#: Words that mark a report of a randomized trial.
TRIAL_WORDS = ("randomized", "randomised", "randomly assigned", "placebo-controlled", "double-blind", "rct", "controlled trial", "随机", "安慰剂", "对照")


def is_trial(title: Column, abstract: Column, journal: Column) -> Column:
    return has(F.lower(F.concat_ws(" ", s(title), s(abstract), s(journal))), *TRIAL_WORDS)


# Words that mark the parts of a clinical question, in order.
POPULATION = ("patient", "patients", "adult", "adults", "children", "men", "women", "糖尿病", "心衰", "高血压", "肿瘤", "抑郁")
INTERVENTION = ("aspirin", "statin", "metformin", "insulin", "vaccine", "surgery", "chemotherapy", "radiation", "therapy", "treatment", "阿司匹林", "他汀", "二甲双胍", "胰岛素", "免疫治疗", "手术")
OUTCOME = ("mortality", "survival", "outcome", "death", "risk", "adverse", "efficacy", "safety", "recurrence", "progression", "remission", "心血管死亡", "全因死亡", "住院", "不良事件", "复发", "缓解率")
VERSUS = r"(?i)(?:^|\s|[,.;:?!])(?:vs\.?|versus|compared\s+to|compared\s+with|与|和|对比)(?:\s|[,.;:?!]|$)"


def _phrase(q: Column, keyword: Column) -> Column:
    """The first word that holds the keyword (or is part of it), with the words beside it."""
    words = F.transform(F.filter(F.split(q, r"\s+"), lambda w: w != ""), lambda w: F.regexp_replace(w, "^[,.?:;]+|[,.?:;]+$", ""))
    hit = F.filter(F.transform(words, lambda w, i: F.when(F.contains(w, keyword) | F.contains(keyword, w), i)), lambda i: i.isNotNull())
    at = F.get(hit, F.lit(0))
    lo = F.greatest(at - 1, F.lit(0))
    return F.when(at.isNotNull(), F.array_join(F.slice(words, lo + 1, at - lo + 2), " ")).otherwise(keyword)


def _phrase_of(q: Column, words: tuple[str, ...]) -> Column:
    return cases([(F.contains(q, F.lit(w)), _phrase(q, F.lit(w))) for w in words], "")


def pico(question: Column) -> Column:
    """(population, intervention, comparator, outcome) of a question in words."""
    q = F.lower(s(question))
    versus = rx(q, VERSUS)
    parts = F.split(q, VERSUS, 2)
    after = F.coalesce(F.get(parts, F.lit(1)), F.lit(""))
    return F.struct(
        _phrase_of(q, POPULATION).alias("population"),
        F.when(versus, F.trim(F.get(parts, F.lit(0)))).otherwise(_phrase_of(q, INTERVENTION)).alias("intervention"),
        F.when(versus, F.trim(F.regexp_extract(after, "^([^,?;]*)", 1))).otherwise("").alias("comparator"),
        _phrase_of(q, OUTCOME).alias("outcome"),
    )


def abstract_of(index: Column) -> Column:
    """The text of an inverted index, a map of words to places; of words at one place the greatest stays."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    last = let(F.array_sort(places), lambda o: F.filter(o, lambda x, i: F.coalesce(F.get(o, i + 1)["p"] != x["p"], F.lit(True))))
    return F.array_join(F.transform(last, lambda x: x["w"]), " ")


def rich_cell(text: Column) -> Column:
    """Segments (text, type, link) of a text with addresses in it."""
    url = r"https?://[^\s)\]]+"
    links = F.regexp_extract_all(s(text), F.lit(url), F.lit(0))
    gaps = F.split(s(text), url, -1)
    node = lambda t, kind, link: F.struct(t.alias("text"), F.lit(kind).alias("type"), link.alias("link"))
    empty = F.lit("").cast("string")
    nodes = let(links, lambda us: F.flatten(F.transform(gaps, lambda g, i: F.array(node(g, "text", empty), node(F.coalesce(F.get(us, i), F.lit("")), "url", F.coalesce(F.get(us, i), F.lit("")))))))
    return F.filter(nodes, lambda n: n["text"] != "")


def cell_text(nodes: Column) -> Column:
    return F.regexp_replace(F.array_join(F.transform(nodes, lambda n: n["text"]), ""), "[\r\n]+$", "")


def json_inside(text: Column) -> Column:
    """The outermost braces of a text and what is between them, without a code fence; null if there are none."""
    return F.nullif(F.regexp_extract(s(text), r"(?s)\{.*\}", 0), F.lit(""))


def title_tokens(text: Column) -> Column:
    """Lower-case runs of ASCII letters, digits and Chinese characters, of two bytes at least, without stop words."""
    stop = "a an the of in on and or is are was were with from for to by at 的 在 和 与 或 是 了 将 对 等 从 中".split()
    runs = F.regexp_extract_all(F.lower(s(text)), F.lit(r"[a-z0-9一-鿿]+"), F.lit(0))
    return F.filter(runs, lambda w: ~w.isin(*stop) & (F.octet_length(w) > 1))


def title_similarity(a: Column, b: Column, multiset: bool = False) -> Column:
    """Jaccard similarity of two titles' tokens; with ``multiset``, the second title's repeats count again."""
    y = title_tokens(b) if multiset else F.array_distinct(title_tokens(b))

    def ratio(t: Column) -> Column:
        both = F.size(F.filter(t["y"], lambda w: F.array_contains(t["x"], w)))
        return F.when((F.size(t["x"]) == 0) | (F.size(t["y"]) == 0), 0.0).otherwise(both / (F.size(t["x"]) + F.size(t["y"]) - both))

    return let(F.struct(F.array_distinct(title_tokens(a)).alias("x"), y.alias("y")), ratio)
