"""Zones of pages that are not to be marked: by place, by wording, by the boxes that lie there.

Wording is told by patterns in the syntax that Java and RE2 share; ``J`` writes them for Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import cases, has, let, rx, s

# Kinds of content that are never marked.
FORBIDDEN_KINDS = tuple("title article_title section_title author authors affiliation correspondence reference references bibliography cited literature_cited header footer running_head journal_info acknowledgment acknowledgements".split())
# Wording of authors' lines, two of which tell such lines.
AUTHOR_WORDING = (
    r"M\.?D\.?", r"Ph\.?D\.?", r"Professor", r"Departments?\s+of\b", r"Department\s+of\b", r"University\s+of\b", r"Medical\s+Center", r"College\s+of\b", r"Hospital\b", r"Institute\s+of\b", r"^Correspondence",
    r"\*Correspondence", r"@[\w.]+\.[a-z]{2,}", r"et\s+al\.?$", r"^\d+[\s,]+[A-Z][a-z]+\s+[A-Z]", r"^From\s+the\b", r"^Affiliations?\b", r"^Author\s+contributions", r"^Authors?\b",
)
# Beginnings of statements.
STATEMENTS = (
    r"^Competing\s+interests", r"^Declaration\s+of\s+(competing\s+)?interests", r"^Conflicts?\s+of\s+interest", r"^Funding", r"^Funding\s+statement", r"^Author\s+contributions", r"^Authors'\s+contributions",
    r"^Data\s+availability", r"^Data\s+availability\s+statement", r"^Additional\s+information", r"^Supplementary\s+", r"^Ethics\s+(approval|statement|consent)", r"^Patient\s+consent", r"^Informed\s+consent",
)
EMAIL, BRACKETS = r"@[\w.]+\.[a-z]{2,}", r"\[\d+\]"
DEPARTMENT, UNIVERSITY, LETTER = r"Department\s+of\s+[A-Z]", r"University\s+of\s+[A-Z]", r"(?m)^\s*\*?Correspondence\b"
REFERENCES, DOI, VOLUME = r"(?im)^References\s*$", r"(?i)doi:\s*10\.\d+", r"\d{4}\s*;\s*\d+"
JOURNAL, SITE, DOWNLOADED = r"^N\s+Engl\s+J\s+Med\b", r"(?m)^www\.\w+\.\w+", r"(?m)^Downloaded\s+from\s+\w+\.\w+"

# Wording of lines that hold no findings: degrees, others' works, volumes, abbreviations.
DEGREES, OTHERS, QUARTER, ABBREVIATION = r"(MD|PhD|M\.D|Ph\.D|BSc|MSc)\s*;?\s*$", r"et al\.", "¼", r"^[A-Z]{2,}\s*[:：]\s*[a-zA-Z\x{4e00}-\x{9fff}]"

#: Letters as these patterns mean them: of Latin and Chinese writing.
W = r"\w\x{c0}-\x{24f}\x{4e00}-\x{9fff}"

# Wording of highlights that break a rule, by rule. Whatever the case, at any line.
BROKEN = {
    "author_text": (
        r"^\d+\.\s", r"\b(MD|PhD|M\.D|Ph\.D|BSc|MSc|RN|FACS|FACP)\b(\s*[,.;:]|\s*$)", rf"(Department of|Department\sof|^[{W}]+\s+(University|Hospital|Institute|College|School|Center|Centre))", r"(@\w+\.(edu|com|org|ac|cn|uk))",
        r"(Email:|E-?mail:|Corresponding author)", r"^\d{4}-\d{4}$", r"\bORCID\b", r"(University Medical Center|Medical Center|University Hospital)", r"(Professor|Prof\.|Dr\.|Doctor)", r"(Department|Institute) of [A-Z]\w+", rf"^[{W}\s,]+MD|^[{W}\s,]+PhD",
    ),
    "ref_text": (
        r"\b\d{4}\s*;\s*\d+(\s*\(\d+\))?\s*:\s*\d+([-–]\d+)?\.?\s*$", r"et\s+al\.", r"\b(Available from|Accessed|doi:|PMID:|PMCID:)", r"^\s*\d+\.\s+[A-Z][a-zA-Z]+(\s+[A-Z][a-zA-Z]+)*\s+[A-Z][a-z]",
        r"(http|https)://(www\.)?(doi\.org|pubmed|ncbi|elsevier|springer|wiley|nejm|lancet)", r"\d{4}\s*;\s*\d+", r"\d+\s*:\s*\d+[-–]\d+", r"^\d+[\.\)]\s+",
        r"\b(Lancet|N Engl J Med|Blood|JAMA|Br J Haematol|J Thromb Haemost|Nat Rev|Nat Med|Sci Transl Med|J Clin Invest|Hematology|Am J Hematol|J Am Soc Nephrol|Kidney Int|Transplantation|Biol Blood Marrow Transplant|BBMT|Clin Infect Dis|J Pediatr|Pediatrics|Nephrol Dial Transplant|Front Pediatr)\b.*\b\d{4}\b",
        # words end at their borders here, so that a line is not tried in every division of its letters
        r"^([a-z]{2,}\s+){1,3}[a-z]{2,}(\s+[a-z]+\b\.?){0,3}\s*(([a-z]+\b\.?\s*){0,5}|([a-z]+\b\.?\s*){0,4}[a-z]+)\d{4}",
    ),
    "keywords_text": (r"^\s*KEYWORDS?\s*[:：]", r"^\s*Key\s+words?\s*[:：]", r"^\s*关键词\s*[:：]", r"^\s*关键字\s*[:：]", r"^\s*主题词\s*[:：]"),
    "figure_caption": (r"^\s*Fig\.?\s*\d+", r"^\s*Figure\s+\d+", r"^\s*表\s*\d+", r"^\s*Table\s+\d+", r"^\s*图\s*\d+"),
    "declaration_text": (
        r"^\s*DECLARATION", r"^\s*Disclosure", r"^\s*AUTHOR\s+CONTRIBUTION", r"^\s*FUNDING", r"^\s*ACKNOWLEDGE?MENT", r"^\s*CONFLICT\s+OF\s+INTEREST", r"^\s*DATA\s+AVAILABILITY", r"^\s*Compliance with Ethics", r"^\s*Ethics",
        r"^\s*Additional Information", r"^\s*Supplementary", r"^\s*Publisher\s+Note", r"^\s*致谢\s*[:：]", r"^\s*利益冲突", r"^\s*基金资助", r"^\s*作者贡献", r"^\s*数据可用性",
    ),
    "citation_text": (r"^\s*CITATION\s*:", r"^\s*Received\s*:", r"^\s*Accepted\s*:", r"^\s*Published\s*:", r"^\s*Copyright\s*©"),
}
NUMBERS_ONLY, ITEMS_ONLY = r"\[\d+\]\s*\[\d+\]\s*\[\d+\]", r"^(\s*\d+[.)]\s*(\n|$))+$"

# Wording of the zones of a paper, each line being told alone.
AUTHOR_LINES = (rf"^[{W}\s,.]+(et al\.?|\*)?\s*[\d*,\s]*(\([^)]+\))?$", r"^[A-Z][a-z]+\s+[A-Z][a-z]?[\d*,\s]*$", r"^[A-Z][a-z]+(\s+[A-Z][a-z]+)*\s*[\d*,]+")
PUBLISHERS = (
    r"Frontiers in \w+", r"BMC \w+", "Mayo Clinic Proceedings", "Nature", "Bone Marrow Transplantation", "Blood Advances", "Lancet", "Cell", "NEJM", "JAMA", r"doi:?\s*10\.\d{4}/", r"doi\.org", r"Clin \w+", "Transplant Cell Ther",
    r"Annals? of \w+", r"Journal of \w+", r"Br J \w+", r"Eur \w+", rf"中华[{W}]",
)
HEADINGS = ("Abstract", "ABSTRACT", "Background", "BACKGROUND", "Methods", "METHODS", "Introduction", "INTRODUCTION", "Results", "RESULTS", "Conclusion", "CONCLUSION", "Discussion", "DISCUSSION", "Materials and Methods", "Aim", "Objective", "Case Report")
SUBMISSION = r"(?i)^(Received|Accepted|Published|Revised|Editor|Reviewer|Handling Editor|Publisher.?s Note)\b"
STATEMENT = (
    r"(?i)^(FUNDING|FUNDING STATEMENT|ACKNOWLEDGE?MENTS?|AUTHOR CONTRIBUTIONS?|CONFLICT OF INTEREST|DATA AVAILABILITY|CORRESPONDENCE|ETHICS STATEMENT|DECLARATION|DISCLOSURE|COMPETING INTERESTS?|COPYRIGHT|SUPPLEMENTARY MATERIALS?)\b"
)
LICENCE, PAGE_NUMBER, HEADER = r"(?i)reproduction in any medium|distribution or reproduction|distributed under", r"^\d{1,3}\s*$", r"(?i)Vol\.?\s*\d+|www\.|doi|ISSN|Chin J|J \w+\b"
CITED_INSIDE, DOI_WORD, AND_OTHERS = r"\(\s*[A-Z][a-z]+ et al\.?\s*,?\s*(19|20)\d{2}\s*\)", r"(?i)\bdoi\b", r"(?i)\bet al\b"
YEAR, PAGES, YEAR_VOLUME = r"\(\s*(19|20)\d{2}\s*\)", r"\d+\s*[:–-]\s*\d+", r"[（(]\s*(19|20)\d{2}\s*[)）][；;:]?\s*\d+\s*\(\d+\)"
TITLE_SIZE, TITLE_ZONE = 14.0, 0.40  #: fixed values: a title's least size of letters, the part of a page in which it stands

STRETCH = 512  #: lines of a document that one window holds


def J(pattern: str) -> str:
    """A pattern for Spark: only line feeds end lines, as in RE2."""
    return "(?d)" + pattern


def found(text: Column, pattern: str) -> Column:
    return rx(text, J(pattern))


def _percent(x: Column, places: int = 0) -> Column:
    return F.concat(F.format_string(f"%.{places}f", F.bround(x * 100, places)), F.lit("%"))


def forbidden_text(text: Column, kind: Column) -> Column:
    """Why a text is not to be marked: its kind, or the first wording that tells authors, references, statements or page headers; null if nothing does."""
    return let(s(text), lambda t: let(_authors(t), lambda authors: _forbidden(t, kind, authors)))


def _authors(t: Column) -> Column:
    return sum((found(t, "(?m)" + p).cast("int") for p in AUTHOR_WORDING[1:]), found(t, "(?m)" + AUTHOR_WORDING[0]).cast("int"))


def _forbidden(t: Column, kind: Column, authors: Column) -> Column:
    brackets = F.regexp_count(t, F.lit(BRACKETS))
    say = lambda x: F.concat(F.lit("text_pattern="), x if isinstance(x, Column) else F.lit(x))
    rules = [
        (kind.isin(*FORBIDDEN_KINDS), F.concat(F.lit("sensenova_type="), kind)),
        (authors >= 2, say(F.concat(F.lit("author_pattern_hits_"), authors.cast("string")))),
        (found(t, EMAIL), say("email")),
        (found(t, DEPARTMENT) & found(t, UNIVERSITY), say("affiliation_keywords")),
        (found(t, LETTER), say("correspondence_header")),
        (brackets >= 3, say(F.concat(F.lit("bracket_refs_"), brackets.cast("string")))),
        (found(t, REFERENCES), say("references_header")),
        (found(t, DOI) & found(t, VOLUME), say("doi_journal_format")),
        *[(found(t, "(?im)" + p), say("declaration_" + p[:20])) for p in STATEMENTS],
        (found(t, JOURNAL) | found(t, SITE), say("journal_header")),
        (found(t, DOWNLOADED), say("downloaded_from")),
    ]
    return cases(rules, F.lit(None).cast("string"))


def forbidden_place(x1: Column, y1: Column, x2: Column, y2: Column, page: Column, width: Column, height: Column) -> Column:
    """Why a box is not to be marked: foot and head of a page, the top of page 0, boxes that are too large; null if nothing speaks against it."""
    wide, tall = (x2 - x1) / width, (y2 - y1) / height
    rules = [
        (y1 > height * 0.92, "geometry=page_bottom_8%"),
        (y2 < height * 0.05, "geometry=page_top_5%"),
        ((page == 0) & (y2 < height * 0.22), "geometry=page0_top_22%"),
        ((wide > 0.7) & (tall > 0.3), F.concat(F.lit("geometry=too_large_"), _percent(wide), F.lit("x"), _percent(tall))),
        (tall > 0.5, F.concat(F.lit("geometry=height_too_large_"), _percent(tall))),
    ]
    return cases(rules, F.lit(None).cast("string"))


def is_body(text: Column, y1: Column, y2: Column, page: Column, height: Column) -> Column:
    """Whether a line may hold findings: three letters at least, outside the page's head and foot, no degrees, works, volumes or abbreviations."""
    t = F.trim(s(text))
    top = F.when(page == 0, height * 0.15).otherwise(height * 0.05)
    none = found(t, DEGREES) | found(t, OTHERS) | found(t, VOLUME) | has(t, QUARTER) | found(t, ABBREVIATION)
    return (F.length(t) >= 3) & (y1 >= top) & (y2 <= height * (1 - 0.08)) & ~none


def overlaps(left: DataFrame, right: DataFrame, on: tuple[str, ...], tile: float = 64.0) -> DataFrame:
    """Pairs of boxes (x1, y1, x2, y2) of ``left`` and ``right`` with equal keys that share an area; touching is no sharing.

    Their other columns are told apart by the names ``left_...`` and ``right_...``. A box has a level, by its size, at which
    tiles are at least as large as itself, so that it lies in four of them at most. It is posted in those and, at
    each higher level at which boxes exist, in the tiles that it lies in. Two boxes meet at
    the higher of their levels, and are reported by the tile that holds the corner at which their common area begins: once, wherever
    they lie, and no page's boxes are all compared. Boxes that are empty or have a null side share nothing.
    """
    level = F.greatest(F.ceil(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / tile)), F.lit(0)).cast("int")
    full = lambda df: df.where("x1 < x2 AND y1 < y2").withColumn("level", level)
    left, right = full(left), full(right)
    levels = sorted(r["level"] for r in left.select("level").union(right.select("level")).distinct().collect())  # a number a doubling of size
    size = F.col("at") * 1.0

    def posted(df: DataFrame, side: str) -> DataFrame:
        at = F.explode(F.filter(F.array(*[F.lit(n) for n in levels]).cast("array<int>"), lambda n: n >= F.col("level")))
        grid = df.withColumn("at", at).withColumn("size", tile * F.pow(F.lit(2.0), size))
        x, y = (F.sequence(F.floor(F.col(f"{c}1") / F.col("size")), F.floor(F.col(f"{c}2") / F.col("size"))) for c in "xy")
        grid = grid.withColumn("tx", F.explode(x)).withColumn("ty", F.explode(y))
        return grid.select(*on, "at", "tx", "ty", "size", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c not in on])

    if not levels:
        return posted(left, "left").join(posted(right, "right").drop("size"), [*on, "at", "tx", "ty"]).drop("at", "tx", "ty", "size", "left_level", "right_level")
    pairs = posted(left, "left").join(posted(right, "right").drop("size"), [*on, "at", "tx", "ty"]).where(F.col("at") == F.greatest("left_level", "right_level"))
    sharing = F.lit(True)
    for c in "xy":
        corner, end = F.greatest(f"left_{c}1", f"right_{c}1"), F.least(f"left_{c}2", f"right_{c}2")
        sharing = sharing & (corner < end) & (F.floor(corner / F.col("size")) == F.col(f"t{c}"))
    return pairs.where(sharing).drop("at", "tx", "ty", "size", "left_level", "right_level")


def violations(text: Column, x1: Column, y1: Column, x2: Column, y2: Column, page: Column, pages: Column, width: Column, height: Column) -> Column:
    """(violation, detail) of a highlight, in the order of the rules; where several zones of the top hold it, only the first counts.

    Pages taller than 1,500 are scans, with narrower zones. ``text`` is what the highlight covers.
    """
    return let(F.trim(s(text), F.lit(" \t\r\n\f\x0b")), lambda t: let(F.struct(*[_first(t, ps).alias(name) for name, ps in BROKEN.items()]), lambda broken: _violations(t, broken, x1, y1, x2, y2, page, pages, width, height)))


def _first(t: Column, patterns: tuple[str, ...]) -> Column:
    """The first of the patterns that ``t`` holds, null if none."""
    return cases([(found(t, "(?im)" + p), p) for p in patterns], F.lit(None).cast("string"))


def _violations(t: Column, broken: Column, x1: Column, y1: Column, x2: Column, y2: Column, page: Column, pages: Column, width: Column, height: Column) -> Column:
    scan = height > 1500
    zone = lambda narrow, usual: (page == 0) & (y1 < height * F.when(scan, narrow).otherwise(usual))
    title, author, chinese = zone(0.01, 0.08), zone(0.02, 0.15), zone(0.05, 0.30) & found(t, r"[\x{4e00}-\x{9fff}]")
    place = F.concat(F.format_string("y0=%.0f/%.0f=", y1, height), _percent(y1 / height, 1))
    wide, tall = (x2 - x1) / width, (y2 - y1) / height
    quoted = F.concat(F.lit("text="), F.substring(t, 1, 80))
    rules = [
        (title, "page0_top_8%_title", place),
        (~title & author, "page0_top_15%_title_or_author", place),
        (~title & ~author & chinese, "page0_top_30%_CN_author", place),
        (y1 > height * 0.92, "bottom_8%_footer", F.format_string("y0=%.0f", y1)),
        (y2 < height * F.when(scan, 0.005).otherwise(0.05), "top_5%_header", F.format_string("y1=%.0f", y2)),
        ((wide > 0.85) & (tall > 0.25), "too_wide_and_tall", F.concat(F.lit("w="), _percent(wide), F.lit(", h="), _percent(tall))),
        (tall > 0.5, "too_tall", F.concat(F.lit("h="), _percent(tall))),
        (x2 - x1 < 8, "too_narrow", F.format_string("w=%.0fpx", x2 - x1)),
    ]
    for name in BROKEN:
        first = broken[name]
        rules.append((first.isNotNull(), name, F.concat(F.lit("pat="), first, F.lit(", "), quoted)))
    rules += [(found(t, NUMBERS_ONLY), "ref_numbers_only", quoted), ((t != "") & found(t, ITEMS_ONLY), "numbered_list_only", quoted)]
    references = broken["ref_text"].isNotNull()
    where = F.concat(F.format_string("pno=%d/%d, y0=", page, pages - 1), _percent(y1 / height, 1))
    rules.append(((page >= pages - 1) & (y1 > height * 0.3) & references, "ref_section", where))
    return F.array_compact(F.array(*[F.when(rule, F.struct(F.lit(name).alias("violation"), detail.alias("detail"))) for rule, name, detail in rules]))


def zone_of(text: Column, y1: Column, y2: Column, height: Column, letters: Column) -> Column:
    """The zone that a line itself tells: authors, a reference, a statement, submission, head or foot, title, publisher, a heading; else null.

    The rules count in this order. ``letters`` is the largest size of the line's letters.
    """
    t = F.trim(F.regexp_replace(s(text), r"\s+", " "))
    n = F.length(t)
    any_of = lambda patterns, flags="": cases([(found(t, flags + p), True) for p in patterns], False)
    author = (n >= 3) & any_of(AUTHOR_LINES) & found(t, "[A-Z][a-z]+")
    reference = n.between(15, 200) & ~found(t, CITED_INSIDE) & (any_of((DOI_WORD, AND_OTHERS, YEAR_VOLUME)) | (found(t, YEAR) & found(t, PAGES)))
    edge = (y1 < height * 0.13) | (y2 > height * 0.90)
    head = (n <= 120) & (has(t, "©", "Copyright") | found(t, LICENCE) | (edge & (found(t, PAGE_NUMBER) | found(t, HEADER))))
    title = (n >= 10) & (y1 <= height * TITLE_ZONE) & (letters >= TITLE_SIZE)
    bare = F.rtrim(t, F.lit(":"))
    heading = cases([(F.startswith(bare, F.lit(h)) & (F.length(bare) < len(h) + 5), True) for h in HEADINGS], False)
    rules = [
        (author, "RULE_2_AUTHOR"), (reference, "RULE_13_REFERENCE"), ((n <= 60) & found(t, STATEMENT), "RULE_12_STATEMENT"), ((n <= 120) & found(t, SUBMISSION), "RULE_10_SUBMISSION"), (head, "RULE_11_HEADER_FOOTER"),
        (title, "RULE_3_TITLE"), (any_of(PUBLISHERS, "(?i)"), "RULE_4_PUBLISHER"), (heading, "RULE_5_ABSTRACT_HEADER"),
    ]
    return cases(rules, F.lit(None).cast("string"))


def zones(lines: DataFrame, marker: str, key: str = "doc", place: str = "i") -> DataFrame:
    """``lines`` with ``zone``: the last marker at or before each line of a document, null before the first.

    Lines are cut into stretches of STRETCH places: the last marker of each stretch is one row, of which a document's
    few are put in order, and within a stretch the lines follow on from the one before. So no task holds a long document's lines.
    """
    cut = lines.withColumn("_stretch", F.floor(F.col(place) / STRETCH))
    ends = cut.where(F.col(marker).isNotNull()).groupBy(key, "_stretch").agg(F.max_by(marker, place).alias("_last"))
    parts = cut.select(key, "_stretch").distinct().join(ends, [key, "_stretch"], "left")
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1))
    held = cut.join(parts.select(key, "_stretch", before.alias("_before")), [key, "_stretch"])
    within = F.last(marker, ignorenulls=True).over(Window.partitionBy(key, "_stretch").orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("zone", F.coalesce(within, "_before")).drop("_stretch", "_before")
