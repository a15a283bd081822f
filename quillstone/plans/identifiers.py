"""Queries over identifiers, links and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..sources.views import view, with_views

OPEN_JOURNALS = ("Front Oncol", "Int J Mol Sci")


def canonical_ids(spark, sf):
    r = view(spark, sf, "refs_v")
    return r.select("k", ids.canonical_id(F.col("raw")).alias("id"), ids.strip_doi_address(F.trim("raw")).alias("bare"), ids.tail_id(F.col("url")).alias("tail"))


def link_ids(spark, sf):
    r = view(spark, sf, "refs_v")
    return r.select("k", ids.link_doi(F.col("url")).alias("doi"), ids.link_pmid(F.col("url")).alias("pmid"), ids.host_doi(F.col("url")).alias("host_doi"), ids.url_slug(F.col("url"), F.col("k")).alias("slug"))


def group_keys(spark, sf):
    c = view(spark, sf, "citations_v")
    key = ids.group_key(F.col("pmid"), F.col("doi"))
    return c.groupBy(key.alias("key")).agg(F.count("*").alias("n"), F.countDistinct(ids.citation_key(F.col("pmid"), F.col("doi"), F.col("title"))).alias("n_keys"))


def doi_classes(spark, sf):
    r = view(spark, sf, "refs_v")
    return r.groupBy(ids.doi_class(F.trim("raw")).alias("class"), ids.paywalled(ids.canonical_id(F.col("raw"))).alias("paywalled")).agg(F.count("*").alias("n"))


def link_classes(spark, sf):
    r = view(spark, sf, "refs_v").withColumn("c", ids.link_class(F.col("url")))
    return r.groupBy(F.col("c.kind").alias("kind"), F.coalesce(F.col("c.status").cast("string"), F.lit("")).alias("status"), F.array_join("c.backups", ",").alias("backups"), ids.outdated_year(F.col("url")).alias("outdated")).agg(F.count("*").alias("n"))


def publishers(spark, sf):
    r = view(spark, sf, "refs_v")
    life = ids.link_lifetime(ids.canonical_id(F.col("raw")), F.col("journal"), F.lit(""))
    return r.groupBy("journal", ids.publisher(F.col("journal")).alias("publisher"), life.alias("lifetime")).agg(F.count("*").alias("n"))


def slugs(spark, sf):
    c = view(spark, sf, "citations_v").select("ord", F.substring("title", 1, 150).alias("t"))
    return c.select("ord", ids.slug_file(F.col("t")).alias("file"), ids.slug_title(F.col("t")).alias("title"), ids.slug_project(F.col("t")).alias("project"), ids.slug_test(F.col("t")).alias("test"))


def file_labels(spark, sf):
    r = view(spark, sf, "refs_v")
    key = ids.cache_key(F.array("url", "raw"), F.col("title"))
    return r.select("k", ids.column_letter(F.col("k") % 800).alias("col"), ids.format_bytes(F.col("n_bytes")).alias("size"), ids.short_doi(F.concat("raw", F.lit("/"), "url")).alias("doi"), ids.signature(F.col("url")).alias("sig"), key.alias("cache"))


def ref_types(spark, sf):
    c = view(spark, sf, "citations_v", whole=True)
    return c.groupBy(ids.ref_type(F.col("abstract"), F.col("title")).alias("kind")).agg(F.count("*").alias("n"), F.count(ids.clean_doi(F.col("abstract"), F.col("doi"))).alias("n_doi"))


def pdf_classes(spark, sf):
    r = view(spark, sf, "refs_v")
    kind = ids.pdf_class(F.col("producer"), F.col("creator"), F.col("page_text"))
    check = ids.producer_check(F.col("producer"), F.col("creator"))
    r = r.withColumn("kind", kind).withColumn("check", check)
    return r.groupBy("kind", F.col("check.trusted").alias("trusted"), F.col("check.reason").alias("reason"), ids.repair_strategy(F.col("kind"), ids.canonical_id(F.col("raw"))).alias("strategy")).agg(F.count("*").alias("n"))


def download_tiers(spark, sf):
    r = view(spark, sf, "refs_v")
    return r.groupBy("year", ids.download_tier(F.col("year"), F.col("journal"), F.lit("verified"), OPEN_JOURNALS).alias("tier")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (canonical_ids, link_ids, group_keys, doi_classes, link_classes, publishers, slugs, file_labels, ref_types, pdf_classes, download_tiers)}

_CANON = r"""CASE WHEN regexp_matches(trim(raw), '^[0-9]{4,10}$') THEN trim(raw)
  WHEN regexp_matches(regexp_replace(trim(raw), '^(https://|http://)?doi\.org/', ''), '^10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+$') THEN regexp_replace(trim(raw), '^(https://|http://)?doi\.org/', '') ELSE '' END"""
_PAY = f"regexp_matches(lower({_CANON}), '^10\\.(1016|1056|1002|1159)/')"
_PDF = """CASE WHEN producer LIKE 'ReportLab%' THEN 'reportlab_wrap' WHEN producer LIKE 'WeasyPrint%' THEN 'unknown' WHEN producer LIKE 'Skia/PDF%' AND creator LIKE '%Mozilla%' THEN 'chrome_screenshot'
  WHEN producer LIKE 'Adobe InDesign%' OR producer LIKE 'Acrobat Distiller%' THEN 'real_pdf' WHEN producer = 'pdfmake' THEN 'meeting_abstract'
  WHEN page_text LIKE 'Image: fig2%' THEN 'reportlab_wrap' WHEN page_text LIKE 'An official%' THEN 'chrome_screenshot' WHEN page_text LIKE 'Page 1 of%ASCO%' THEN 'meeting_abstract' ELSE 'unknown' END"""
_PUB = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(journal, '{w}')" for w in ws) + f" THEN '{p}'" for ws, p in ids.PUBLISHERS) + " ELSE '' END"

ORACLES = {
    "canonical_ids": f"SELECT k, {_CANON} AS id, regexp_replace(trim(raw), '^.*?doi\\.org/', '') AS bare, regexp_extract(url, '[^/]*$') AS tail FROM refs_v",
    "link_ids": r"""SELECT k, CASE WHEN contains(url, 'doi.org/') THEN regexp_extract(url, '.*doi\.org/([^?#]*)', 1) ELSE '' END AS doi,
      CASE WHEN contains(url, 'ncbi.nlm.nih.gov/pubmed/') THEN regexp_extract(url, '/([^/?]*)[^/]*$', 1) ELSE '' END AS pmid, regexp_extract(url, '^https?://(?:dx\.|www\.)?doi\.org/(10\.[^/]*/.*)', 1) AS host_doi,
      CASE WHEN url = '' THEN concat('ref-', k) ELSE left(regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g'), 60) END AS slug FROM refs_v""",
    "group_keys": r"""SELECT CASE WHEN pmid <> '' THEN 'pmid:' || pmid WHEN doi <> '' THEN 'doi:' || lower(trim(doi)) ELSE '' END AS key, count(*) AS n,
      count(DISTINCT CASE WHEN pmid <> '' THEN 'pmid:' || pmid WHEN doi <> '' THEN 'doi:' || doi ELSE 'title:' || lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) END) AS n_keys FROM citations_v GROUP BY 1""",
    "doi_classes": rf"""SELECT CASE WHEN trim(raw) = '' THEN 'unknown' WHEN regexp_matches(trim(raw), '(?i)/fig-\d+|/table-\d+|/figure\b|\.fig-\d+') THEN 'chart-figure'
      WHEN regexp_matches(trim(raw), '(?i)/response\d*$|-c\d+$|\.reply') THEN 'author-reply' WHEN regexp_matches(trim(raw), '(?i)/supplementary|/suppl_material|\.\d{{3,4}}$|/suppl($|/)') THEN 'supplementary' ELSE 'research-paper' END AS class,
      {_PAY} AS paywalled, count(*) AS n FROM refs_v GROUP BY 1, 2""",
    "link_classes": """SELECT kind, status, backups, outdated, count(*) AS n FROM (SELECT CASE WHEN url = '' THEN 'EMPTY' WHEN url LIKE 'file://%' THEN 'D_LOCAL' WHEN url LIKE '%wiley%' AND url LIKE '%/pdf%' THEN 'A_OFFICIAL_PDF_PAYWALL'
      WHEN (url LIKE '%.pdf' OR url LIKE '%/pdf') AND (url LIKE '%frontiersin.org%' OR url LIKE '%mdpi.com%') THEN 'A_OFFICIAL_PDF_OPEN' WHEN url LIKE '%.pdf' AND url LIKE '%gco.iarc%' THEN 'A_OFFICIAL_PDF'
      WHEN url LIKE '%.pdf' OR url LIKE '%/pdf' THEN 'UNKNOWN' WHEN url LIKE '%pmc.ncbi%' THEN 'B_PMC_PAGE' WHEN url LIKE 'https://doi.org/%' THEN 'C_DOI' WHEN url LIKE '%archive.org%' THEN 'E_WAYBACK' ELSE 'UNKNOWN' END AS kind,
      CASE kind WHEN 'A_OFFICIAL_PDF_PAYWALL' THEN '403' WHEN 'A_OFFICIAL_PDF_OPEN' THEN '200' WHEN 'A_OFFICIAL_PDF' THEN '200' WHEN 'B_PMC_PAGE' THEN '200' WHEN 'C_DOI' THEN '302' WHEN 'E_WAYBACK' THEN '200' ELSE '' END AS status,
      CASE kind WHEN 'A_OFFICIAL_PDF_PAYWALL' THEN 'B_PMC,C_DOI,E_WAYBACK' WHEN 'A_OFFICIAL_PDF_OPEN' THEN 'B_PMC,E_WAYBACK,D_LOCAL' WHEN 'A_OFFICIAL_PDF' THEN 'D_LOCAL,E_WAYBACK' WHEN 'B_PMC_PAGE' THEN 'C_DOI,E_WAYBACK,D_LOCAL' WHEN 'C_DOI' THEN 'B_PMC,E_WAYBACK,D_LOCAL' ELSE '' END AS backups,
      CASE WHEN url LIKE '%gco.iarc%2022%' THEN '2022' ELSE '' END AS outdated FROM refs_v) GROUP BY ALL""",
    "publishers": f"SELECT journal, {_PUB} AS publisher, CASE WHEN contains(lower(journal), 'globocan') THEN 'timed' ELSE 'permanent' END AS lifetime, count(*) AS n FROM refs_v GROUP BY ALL",
    "slugs": r"""SELECT ord, CASE WHEN t = '' THEN 'unnamed' ELSE regexp_replace(t, '[^a-zA-Z0-9_-]', '_', 'g') END AS file,
      CASE WHEN t = '' THEN 'unknown' WHEN length(u) > 120 THEN left(u, 117) || '...' ELSE u END AS title,
      CASE WHEN p = '' THEN 'project' ELSE p END AS project, regexp_replace(t, '[^a-zA-Z0-9]', '_', 'g') AS test
      FROM (SELECT ord, t, trim(replace(regexp_replace(t, '[^a-zA-Z0-9._-]+', '_', 'g'), '__', '_'), '_-. ') AS u, trim(regexp_replace(t, '[^\pL\p{Nd}\-_.]+', '-', 'g'), '-') AS p FROM (SELECT ord, left(title, 150) AS t FROM citations_v))""",
    "file_labels": """SELECT k, CASE WHEN i < 26 THEN chr(CAST(65 + i AS INT)) WHEN i < 702 THEN chr(CAST(65 + (i - 26) // 26 AS INT)) || chr(CAST(65 + (i - 26) % 26 AS INT)) ELSE 'A' || chr(CAST(65 + (i - 702) // 26 AS INT)) || chr(CAST(65 + (i - 702) % 26 AS INT)) END AS col,
      CASE WHEN n_bytes >= 1048576 THEN format('{:.1f} MB', n_bytes / 1048576.0) WHEN n_bytes >= 1024 THEN format('{:.0f} KB', n_bytes / 1024.0) ELSE format('{} B', n_bytes) END AS size,
      CASE WHEN length(d) <= 40 THEN d ELSE left(d, 37) || '…' END AS doi, left(url, 32) AS sig, left(md5(title), 16) || '_' || left(md5(CASE WHEN url < raw THEN url || '|' || raw ELSE raw || '|' || url END), 16) AS cache
      FROM (SELECT *, k % 800 AS i, raw || '/' || url AS d FROM refs_v)""",
    "ref_types": """SELECT CASE WHEN contains(t, 'rct') OR contains(t, 'randomized') THEN 'RCT 试验' ELSE '文献' END AS kind, count(*) AS n, count(*) AS n_doi FROM (SELECT lower(abstract || ' ' || title) AS t FROM citations_v) GROUP BY 1""",
    "pdf_classes": f"""SELECT kind, trusted, reason, CASE kind WHEN 'reportlab_wrap' THEN 'replace_with_real_pdf' WHEN 'chrome_screenshot' THEN 'find_oa_am' WHEN 'unknown' THEN CASE WHEN pay THEN 'abstract_as_main' ELSE 'inspect_manually' END ELSE 'keep_as_is' END AS strategy, count(*) AS n
      FROM (SELECT {_PDF} AS kind, producer LIKE 'Adobe%' OR producer LIKE 'Acrobat%' OR producer = 'pdfmake' AS trusted, {_PAY} AS pay,
      CASE WHEN producer LIKE 'Skia%' AND creator LIKE 'Mozilla%' THEN 'chrome_screenshot_combined' WHEN producer LIKE 'ReportLab%' THEN 'producer_blacklist: ReportLab PDF Library' WHEN producer LIKE 'Weasy%' THEN 'producer_blacklist: WeasyPrint'
      WHEN producer LIKE 'Skia%' THEN 'producer_blacklist: Skia/PDF' WHEN producer LIKE 'Adobe%' THEN 'producer_whitelist: Adobe InDesign' WHEN producer LIKE 'Acrobat%' THEN 'producer_whitelist: Acrobat Distiller' WHEN producer = 'pdfmake' THEN 'producer_whitelist: pdfmake' ELSE 'unknown_producer' END AS reason FROM refs_v) GROUP BY ALL""",
    "download_tiers": """SELECT year, CASE WHEN o THEN 'oa' WHEN year <= 2022 THEN 'sci-hub' ELSE 'nexus' END AS tier, count(*) AS n
      FROM (SELECT year, lower(journal) LIKE '%front oncol%' OR lower(journal) LIKE '%int j mol sci%' OR lower(journal) LIKE '%ann onc%' AS o FROM refs_v) GROUP BY ALL""",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
