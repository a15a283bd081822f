"""Identifiers, links and file names as column expressions.

Empty strings mean missing, as everywhere in this library; null counts as empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def cases(pairs: list[tuple[Column, object]], default) -> Column:
    """The value of the first condition that holds."""
    col = lambda v: v if isinstance(v, Column) else F.lit(v)
    if not pairs:
        return col(default)
    return reduce(lambda chain, p: chain.when(p[0], col(p[1])), pairs[1:], F.when(pairs[0][0], col(pairs[0][1]))).otherwise(col(default))


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body and the lambdas in it use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def has(c: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def rx(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def canonical_id(raw: Column) -> Column:
    """A PMID of 4 to 10 digits, or a DOI without its address; else empty."""
    t = F.trim(s(raw))
    doi = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "^https://doi\\.org/", ""), "^http://doi\\.org/", ""), "^doi\\.org/", "")
    return cases([(rx(t, r"^[0-9]{4,10}$"), t), (rx(doi, r"^10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+$"), doi)], "")


def strip_doi_address(doi: Column) -> Column:
    """What follows the first ``doi.org/``, or all."""
    return F.regexp_replace(s(doi), r"^.*?doi\.org/", "")


def tail_id(url: Column) -> Column:
    return after_last(s(url), "/")


def link_doi(url: Column) -> Column:
    """The DOI after the last ``doi.org/``, without query and fragment."""
    return F.when(has(s(url), "doi.org/"), F.substring_index(F.substring_index(after_last(s(url), "doi.org/"), "?", 1), "#", 1)).otherwise("")


def link_pmid(url: Column) -> Column:
    u = s(url)
    old = F.substring_index(after_last(u, "/"), "?", 1)
    return cases([(has(u, "ncbi.nlm.nih.gov/pubmed/"), old)], F.regexp_extract(u, r"pubmed\.ncbi\.nlm\.nih\.gov/([0-9]+)", 1))


def host_doi(url: Column) -> Column:
    """The DOI in the path of a resolver's address."""
    path = F.regexp_extract(s(url), r"^https?://(?:doi\.org|dx\.doi\.org|www\.doi\.org|hdl\.handle\.net)/(10\.[^/?#]*/[^?#]*)", 1)
    return path


def url_slug(url: Column, fallback: Column) -> Column:
    return F.when(s(url) == "", F.concat(F.lit("ref-"), fallback.cast("string"))).otherwise(F.substring(F.regexp_replace(s(url), "[^a-zA-Z0-9]", "_"), 1, 60))


def group_key(pmid: Column, doi: Column) -> Column:
    """``pmid:`` and the PMID, else ``doi:`` and the DOI in lower case, else empty."""
    return cases([(s(pmid) != "", F.concat(F.lit("pmid:"), pmid)), (s(doi) != "", F.concat(F.lit("doi:"), F.lower(F.trim(doi))))], "")


def citation_key(pmid: Column, doi: Column, title: Column) -> Column:
    """As group_key, but the DOI as it is, and the title where both are missing."""
    words = F.lower(F.trim(F.regexp_replace(s(title), r"\s+", " ")))
    return cases([(s(pmid) != "", F.concat(F.lit("pmid:"), pmid)), (s(doi) != "", F.concat(F.lit("doi:"), doi))], F.concat(F.lit("title:"), words))


def doi_class(doi: Column) -> Column:
    d = s(doi)
    return cases(
        [
            (d == "", "unknown"),
            (rx(d, r"(?i)(/fig-\d+|/table-\d+|/figure(?![0-9A-Za-z_])|\.fig-\d+)"), "chart-figure"),
            (rx(d, r"(?i)(/response\d*$|/v\d+/response\d*$|-c\d+$|\.reply)"), "author-reply"),
            (rx(d, r"(?i)(/supplementary|/suppl_material|\.\d{3,4}$|/suppl($|/))"), "supplementary"),
        ],
        "research-paper",
    )


#: Registrants whose papers stand behind a paywall.
PAYWALLS = ("10.1016/", "10.1056/", "10.1002/", "10.1159/")


def paywalled(doi: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(F.lower(s(doi)), F.lit(p)) for p in PAYWALLS])


def link_class(url: Column) -> Column:
    """(type, expected status, backups) of a link, by the first class that fits."""
    u = F.lower(s(url))
    pdf = F.endswith(u, F.lit(".pdf")) | F.endswith(u, F.lit("/pdf"))

    def out(kind: str, status: int | None, *backups: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(status).cast("int").alias("status"), F.array(*[F.lit(b) for b in backups]).cast("array<string>").alias("backups"))

    return cases(
        [
            (u == "", out("EMPTY", None)),
            (F.startswith(u, F.lit("file://")), out("D_LOCAL", None)),
            (has(u, "wiley", "sciencedirect", "springer") & has(u, "/pdf", ".pdf"), out("A_OFFICIAL_PDF_PAYWALL", 403, "B_PMC", "C_DOI", "E_WAYBACK")),
            (pdf & has(u, "frontiersin.org", "mdpi.com"), out("A_OFFICIAL_PDF_OPEN", 200, "B_PMC", "E_WAYBACK", "D_LOCAL")),
            (pdf & has(u, "gco.iarc"), out("A_OFFICIAL_PDF", 200, "D_LOCAL", "E_WAYBACK")),
            (pdf, out("UNKNOWN", None)),
            (has(u, "ncbi.nlm.nih.gov/pmc/articles/", "pmc.ncbi.nlm.nih.gov"), out("B_PMC_PAGE", 200, "C_DOI", "E_WAYBACK", "D_LOCAL")),
            (F.startswith(u, F.lit("https://doi.org/")), out("C_DOI", 302, "B_PMC", "E_WAYBACK", "D_LOCAL")),
            (has(u, "archive.org"), out("E_WAYBACK", 200)),
            (has(u, "nhc.gov.cn"), out("G_GOV_PAGE", 200, "D_LOCAL", "E_WAYBACK")),
        ],
        out("UNKNOWN", None),
    )


def outdated_year(url: Column) -> Column:
    """The year in an address whose data have been replaced; else empty."""
    u = F.lower(s(url))
    year = F.regexp_extract(u, r"20\d{2}", 0)
    return F.when((year == "2022") & has(u, "gco.iarc"), year).otherwise("")


def markdown_links(text: Column) -> Column:
    """Addresses of markdown links, web first, then files, each once."""
    web = F.regexp_extract_all(s(text), F.lit(r"\]\((https?://[^)]+)\)"), F.lit(1))
    local = F.regexp_extract_all(s(text), F.lit(r"\]\((file://[^)]+)\)"), F.lit(1))
    return F.array_distinct(F.concat(web, local))


#: Words in a journal's name, in order, and its publisher.
PUBLISHERS = (
    (("Nature", "Sig Transduct"), "Springer Nature"),
    (("Lancet",), "Elsevier"),
    (("NEJM", "N Engl J Med"), "Massachusetts Medical Society"),
    (("J Clin Oncol",), "ASCO / Wolters Kluwer"),
    (("JAMA",), "AMA (American Medical Association)"),
    (("J Hepatol",), "Elsevier (EASL)"),
    (("Med Sci Monit",), "International Scientific Information"),
    (("Cancer",), "Wiley"),
    (("Ann Oncol",), "Elsevier"),
    (("J Natl Cancer Cent",), "Chinese Journal of Cancer (Elsevier)"),
    (("Front Oncol",), "Frontiers Media"),
    (("Gastroenterology",), "AGA (Elsevier)"),
    (("Liver Int",), "Wiley"),
    (("Medicine",), "Wolters Kluwer"),
    (("Frontiers",), "Frontiers Media"),
    (("Clin Cancer Res",), "AACR"),
    (("Int J Mol Sci",), "MDPI"),
    (("GLOBOCAN", "Global Cancer Observatory"), "IARC / WHO (Global Cancer Observatory)"),
    (("中国实用外科",), "国家卫生健康委员会医政司 (中国实用外科杂志)"),
)


def publisher(journal: Column) -> Column:
    return cases([(has(s(journal), *words), name) for words, name in PUBLISHERS], "")


def link_lifetime(doi: Column, journal: Column, kind: Column) -> Column:
    """timed, temporary or permanent, in this order."""
    j, d = F.lower(s(journal)), s(doi)
    timed = has(j, "globocan", "global cancer observatory") | has(F.lower(d), "caac")
    meeting = (s(kind) == "conference_abstract") | has(j, "asco", "esmo") | (has(j, "annonc") & has(d, "1494P"))
    return cases([(timed, "timed"), (meeting, "temporary")], "permanent")


def slug_file(x: Column) -> Column:
    """Every character but ASCII letters, digits, - and _ becomes _; empty is ``unnamed``."""
    return F.when(s(x) == "", "unnamed").otherwise(F.regexp_replace(s(x), "[^a-zA-Z0-9_-]", "_"))


def slug_title(x: Column) -> Column:
    """Runs of other characters become one _, doubled ones collapse once, ends are trimmed, 120 characters at most."""
    t = F.replace(F.regexp_replace(s(x), "[^a-zA-Z0-9._-]+", "_"), F.lit("__"), F.lit("_"))
    t = F.regexp_replace(t, r"^[_\-. ]+|[_\-. ]+$", "")
    return cases([(s(x) == "", "unknown"), (F.length(t) > 120, F.concat(F.substring(t, 1, 117), F.lit("...")))], t)


def slug_project(x: Column) -> Column:
    """Letters and digits of any script, -, _ and . stay, runs of others become one dash."""
    t = F.regexp_replace(F.regexp_replace(s(x), r"[^\p{L}\p{Nd}\-_.]+", "-"), "^-+|-+$", "")
    return F.when(t == "", "project").otherwise(t)


def slug_test(x: Column) -> Column:
    return F.regexp_replace(s(x), "[^a-zA-Z0-9]", "_")


def column_letter(i: Column) -> Column:
    """0 is A, 25 is Z, 26 is AA: up to three letters."""
    letter = lambda n: F.chr(F.lit(65) + n)
    n = i.cast("long")
    two, three = n - 26, n - 26 - 26 * 26
    div = lambda x, d: F.floor(x / d)
    return cases(
        [
            (n < 0, ""),
            (n < 26, letter(n)),
            (two < 26 * 26, F.concat(letter(div(two, 26)), letter(two % 26))),
        ],
        F.concat(letter(div(three, 676) % 26), letter(div(three, 26) % 26), letter(three % 26)),
    )


def format_bytes(n: Column) -> Column:
    """Bytes, whole KB or tenths of MB; halves go to the even figure."""
    m, k = F.bround(n / F.lit(1048576.0), 1), F.bround(n / F.lit(1024.0), 0)
    return cases([(n >= 1048576, F.format_string("%.1f MB", m)), (n >= 1024, F.format_string("%.0f KB", k))], F.format_string("%d B", n))


def short_doi(doi: Column) -> Column:
    return F.when(F.length(s(doi)) <= 40, s(doi)).otherwise(F.concat(F.substring(s(doi), 1, 37), F.lit("…")))


def signature(text: Column) -> Column:
    return F.substring(s(text), 1, 32)


def cache_key(paths: Column, prompt: Column) -> Column:
    part = lambda c: F.substring(F.md5(c.cast("binary")), 1, 16)
    return F.concat(part(s(prompt)), F.lit("_"), part(F.array_join(F.sort_array(paths), "|")))


def clean_doi(cite: Column, doi: Column) -> Column:
    return F.when(has(F.lower(s(cite)), "uptodate") | rx(s(cite), r"[一-鿿]{3,}"), F.lit(None)).otherwise(doi)


def ref_type(cite: Column, title: Column) -> Column:
    t = F.lower(F.concat(s(cite), F.lit(" "), s(title)))
    return cases(
        [
            (has(t, "指南", "共识", "guideline", "consensus", "标准"), "指南"),
            (has(t, "病例", "case report"), "病例报告"),
            (has(t, "rct", "randomized"), "RCT 试验"),
            (has(t, "registry", "survey", "调查"), "数据"),
        ],
        "文献",
    )


#: Producers of page images wrapped as PDF, and of real PDFs.
BAD_PRODUCERS = ("ReportLab PDF Library", "WeasyPrint", "Skia/PDF")
GOOD_PRODUCERS = ("Veeva Vault", "Adobe InDesign", "Adobe PDF Library", "Arbortext", "Acrobat Distiller", "XPP", "pdfmake")


def pdf_class(producer: Column, creator: Column, page_text: Column) -> Column:
    p = F.lower(s(producer))
    return cases(
        [
            (has(p, "reportlab pdf library"), "reportlab_wrap"),
            (has(p, "weasyprint"), "unknown"),
            (has(p, "skia/pdf") & has(s(creator), "Mozilla"), "chrome_screenshot"),
            (has(p, *[g.lower() for g in GOOD_PRODUCERS[:-1]]), "real_pdf"),
            (has(p, "pdfmake"), "meeting_abstract"),
            (has(s(page_text), "Image: fig2.png"), "reportlab_wrap"),
            (has(s(page_text), "An official website"), "chrome_screenshot"),
            (has(s(page_text), "Page 1 of") & has(s(page_text), "ASCO"), "meeting_abstract"),
        ],
        "unknown",
    )


def producer_check(producer: Column, creator: Column) -> Column:
    """(trusted, reason)."""
    p, c = F.lower(s(producer)), F.lower(s(creator))
    out = lambda ok, why: F.struct(F.lit(ok).alias("trusted"), F.lit(why).alias("reason"))
    pairs = [(has(p, "skia/pdf") & has(c, "mozilla"), out(False, "chrome_screenshot_combined"))]
    pairs += [(has(p, b.lower()), out(False, f"producer_blacklist: {b}")) for b in BAD_PRODUCERS]
    pairs += [(has(p, g.lower()), out(True, f"producer_whitelist: {g}")) for g in GOOD_PRODUCERS]
    return cases(pairs, out(False, "unknown_producer"))


def repair_strategy(kind: Column, doi: Column) -> Column:
    return cases(
        [
            (kind == "reportlab_wrap", "replace_with_real_pdf"),
            (kind == "chrome_screenshot", "find_oa_am"),
            ((kind == "unknown") & paywalled(doi), "abstract_as_main"),
            (kind == "unknown", "inspect_manually"),
        ],
        "keep_as_is",
    )


def download_tier(year: Column, journal: Column, status: Column, open_journals: tuple[str, ...]) -> Column:
    j = F.lower(s(journal))
    is_open = has(j, *[o.lower() for o in open_journals], "ann onc")
    y = F.coalesce(year, F.lit(0))
    return cases([((s(status) == "unverifiable") | (y == 0), "unavailable"), ((y <= 2022) & ~is_open, "sci-hub"), (is_open, "oa")], "nexus")


def pdf_validity(content: Column) -> Column:
    """(valid, reason, pages) of a file's bytes: header, objects, trailer and content, in this order."""
    t = F.decode(content, "ISO-8859-1")
    n = lambda p: F.regexp_count(t, F.lit(p))
    head = F.substring(t, 1, 200)
    size = F.octet_length(content)
    objs, ends, streams = n(" obj"), n("endobj"), n("\\nstream\\r?\\n")
    pages = n("/Type") + n("/Page\\n")
    objects = (objs > 0) & (ends > 0) & (F.abs(objs - ends) <= 1)
    trailer = has(t, "trailer") & has(t, "xref")
    content_ok = (pages > 0) | (streams > 0)
    header = F.startswith(t, F.lit("%PDF-"))
    reason = cases(
        [
            (size < 100, F.format_string("too small (%d bytes)", size)),
            (~header & has(head, "<!DOCTYPE html", "<html", "<HTML"), "HTML page (likely paywall/error), not PDF"),
            (~header & has(F.substring(t, 1, 100), "Page not found", "404"), "error page (404), not PDF"),
            (~header, "missing %PDF- header"),
            (~content_ok, "no /Type/Page entries and no streams"),
            (~objects, F.format_string("object mismatch: %d obj vs %d endobj", objs, ends)),
            (trailer, F.format_string("valid PDF, ~%d page(s), %d streams", pages, streams)),
        ],
        "",
    )
    return F.struct(((size >= 100) & header & objects & trailer & content_ok).alias("valid"), reason.alias("reason"), pages.alias("pages"))
