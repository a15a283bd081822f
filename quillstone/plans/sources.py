"""Queries over the readers: payloads as the services send them, made from the views, read back as rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..operators import evidence as E
from ..operators.listing import positions
from ..operators.store import scratch
from ..sources import contract, stores
from ..sources import extras, files, records
from ..sources.views import view, with_views
from .identifiers import _CANON, _PAY

OPENALEX = """to_json(named_struct('id', concat('https://openalex.org/W', ord), 'title', title, 'publication_year', year, 'doi', CASE WHEN doi <> '' THEN concat('https://doi.org/', trim(doi)) END,
  'ids', named_struct('pmid', CASE WHEN pmid <> '' THEN concat('https://pubmed.ncbi.nlm.nih.gov/', pmid) END), 'cited_by_count', cited_by, 'fwci', fwci, 'authorships', array(named_struct('author', named_struct('display_name', origin))),
  'primary_location', named_struct('source', named_struct('display_name', journal)), 'abstract_inverted_index', map(concat('w', ord % 7), array(0, 2), 'x', array(1))))"""
S2 = """to_json(named_struct('paperId', concat('p', ord), 'title', title, 'abstract', concat('about ', origin), 'tldr', CASE WHEN ord % 2 = 0 THEN named_struct('text', concat('short ', ord)) END, 'year', year, 'venue', journal,
  'externalIds', map('DOI', trim(doi), 'PubMed', pmid), 'citationCount', cited_by, 'authors', array(named_struct('name', origin), named_struct('name', ''))))"""
CROSSREF = """to_json(named_struct('DOI', trim(doi), 'title', array(title), 'author', array(named_struct('family', origin, 'given', 'A')), 'container-title', array(journal), 'published', named_struct('date-parts', array(array(year, 1, 2))), 'is-referenced-by-count', cited_by))"""
REGISTRY = "to_json(named_struct('protocolSection', named_struct('identificationModule', named_struct('nctId', concat('NCT', lpad(ord, 8, '0')), 'briefTitle', title), 'statusModule', named_struct('startDateStruct', named_struct('date', concat(year, '-05'))), 'descriptionModule', named_struct('briefSummary', origin))))"
PUBMED = """concat('<DocSum><Id>', ord, '</Id><Item Name="PubDate">', year, ' Jan 5</Item><Item Name="Source">', origin, '</Item><Item Name="Title">Study ', ord, ' &amp; more</Item><Item Name="FullJournalName">', CASE WHEN ord % 2 = 0 THEN journal ELSE '' END, '</Item><Item Name="DOI">10.1/', ord, '</Item></DocSum>')"""
LISTING = r"""concat('1. Title ', ord, '\n', 'A ', origin, ', B Lee - ', journal, ', ', year, '\nDOI: 10.1000/', ord, '\n2. Second ', ord, '\nPMID: ', 100000 + ord, '\n')"""
SCHOLAR = """concat('<div class="gs_ri"><h3 class="gs_rt">[PDF] <a href="https://doi.org/10.4/', ord, '?x">Paper ', ord, '</a></h3><div class="gs_a">F ', origin, ' - ', journal, ', ', year, '</div><div class="gs_rs">snip ', ord % 9, '</div><a>Cited by ', cited_by, '</a></div>')"""


def _payloads(spark, sf, expr):
    return view(spark, sf, "citations_v").select(F.expr(expr).alias("payload"))


def _flat(x):
    return x.withColumns({"authors": F.array_join("authors", "|"), "source_origin": F.array_join("source_origin", "|")})


def _reader(name, reader, expr):
    def query(spark, sf):
        return _flat(reader(_payloads(spark, sf, expr)))

    query.__name__ = name
    return query


def citations_of_sources(spark, sf):
    given = {"crossref": _payloads(spark, sf, CROSSREF), "s2": _payloads(spark, sf, S2), "registry": _payloads(spark, sf, REGISTRY), "openalex": lambda: spark.read.parquet(f"{sf}/no_such_table.parquet")}
    return _flat(records.union(given, enabled={"crossref", "s2", "openalex"}, failed=[]))


def answer_pages(spark, sf):
    page = """concat('<div class="answer"><p>Yes ', ord, '</p></div><ul class="refs"><li><a href="/r/', ord, '">Ref ', origin, '</a><p>note ', year, '</p></li><li><span>none</span></li></ul>')"""
    pages = view(spark, sf, "citations_v").select(F.col("ord").alias("page_id"), F.expr(page).alias("html"))
    x = extras.answers(pages, ".box, .answer", ".refs", "li")
    return x.select("page_id", "answer", F.explode("references").alias("r")).select("page_id", "answer", "r.*")


def cell_rows(spark, sf):
    cells = spark.read.parquet(f"{sf}/nation.parquet").agg(F.to_json(F.struct(F.concat(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda r: F.array(r["n_name"], r["n_nationkey"].cast("string"))), F.array(F.array(F.lit(" "), F.lit("x")))).alias("values"))).alias("payload"))
    return extras.cell_range(cells, ("name", "key", "more"))


def slide_shapes(spark, sf):
    deck = "to_json(named_struct('slides', array(named_struct('slide', CAST(ord AS INT), 'shapes', array(named_struct('name', 't', 'text', journal, 'table', CAST(NULL AS ARRAY<ARRAY<STRING>>)), named_struct('name', 'u', 'text', '', 'table', array(array(origin, 'x'), array(CAST(year AS STRING), 'y'))))))))"
    return extras.shapes(_payloads(spark, sf, deck))


def adverse_events(spark, sf):
    trial = "to_json(named_struct('events', array(named_struct('term', p_brand, 'stats', array(named_struct('groupId', '1', 'numAffected', p_size), named_struct('groupId', '2', 'numAffected', p_partkey))), named_struct('term', 'one arm', 'stats', array(named_struct('groupId', '1', 'numAffected', 1))))))"
    return files.adverse_events(spark.read.parquet(f"{sf}/part.parquet").select(F.expr(trial).alias("payload")))


def correction_examples(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return extras.training_examples(e.select(F.col("event_id").alias("id"), "user_id", "event_type", (F.col("event_id") % 3 == 0).cast("int").alias("applied")))


def registry_numbers(spark, sf):
    doi = F.element_at(F.array(*[F.lit(d) for d in (*extras.REGISTRY, "10.1000/none")]), (F.col("k") % 4 + 1).cast("int"))
    return view(spark, sf, "refs_v").select("k", extras.registry_of(doi).alias("registry"))


def cell_links(spark, sf):
    cell = F.expr("concat('[a](file:///d/', k % 9, '.pdf) [b](https://x.org/', k, ') [c](https://x.org/', k, ') (http://y.org)')")
    return view(spark, sf, "refs_v").select("k", F.array_join(ids.markdown_links(cell), " ").alias("links"))


def paper_links(spark, sf):
    r = view(spark, sf, "refs_v").withColumn("doi", ids.canonical_id(F.col("raw")))
    links = extras.paper_links(F.col("doi"), F.when(F.col("k") % 2 == 0, F.col("url")), F.col("journal"))
    return r.select("k", F.array_join(F.transform(links, lambda x: F.concat_ws("=", x["label"], x["url"])), ";").alias("links"))


_PDF = r"concat('%PDF-1.4\n1 0 obj\n<< /Type /Page >>\nendobj\nxref\ntrailer\nstartxref', repeat(' ', 80))"


def pdf_validity(spark, sf):
    content = F.expr(f"CASE k % 5 WHEN 0 THEN {_PDF} WHEN 1 THEN 'short' WHEN 2 THEN concat('<html>', repeat(' ', 200)) WHEN 3 THEN repeat('plain', 40) ELSE concat({_PDF}, '2 0 obj 3 0 obj 4 0 obj') END")
    return view(spark, sf, "refs_v").select("k", ids.pdf_validity(content.cast("binary")).alias("v")).select("k", "v.valid", "v.reason", F.col("v.pages").cast("long").alias("pages"))


def fallback_needed(spark, sf):
    r = view(spark, sf, "refs_v")
    return r.select("k", E.needs_fallback(F.col("k") % 3 == 0, ids.canonical_id(F.col("raw")), F.col("k") % 5 == 0).alias("needed"))


def csv_rows(spark, sf):
    """Written with the header and a byte order mark, and read again."""
    rows = view(spark, sf, "refs_v").select(F.col("k").cast("string").alias("page"), (F.col("k") % 9).cast("string").alias("number"), F.concat(F.lit('say "'), "journal", F.lit('", twice')).alias("context"), "raw", F.lit("").alias("doi"), "producer", "creator", "url")
    path = scratch(spark, "csv")
    files.write_table(rows.toDF(*files.NAMES), path)
    return files.read_table(spark, path)


def _log(spark, sf):
    o = view(spark, sf, "outcomes_v")
    path = scratch(spark, "log")
    for part in (0, 1):
        files.append_log(o.where(F.col("event_id") % 2 == part).select(F.when(F.col("job") % 10 == 0, "").otherwise(F.concat(F.lit("d"), "job")).alias("doi"), F.when(F.col("ok"), "ok").otherwise("failed").alias("status")), path)
    return spark.read.schema("doi string, status string").json(path)


def log_progress(spark, sf):
    return files.progress(_log(spark, sf))


def log_done(spark, sf):
    return files.done(_log(spark, sf))


def packages(spark, sf):
    """Conversations saved in two goes, some of them deleted and one of these saved again, compacted, listed newest first."""
    rows = view(spark, sf, "sections_v").select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("saved_at"), "id", "audience")
    store = stores.packages(spark, scratch(spark, "packages"), "conv_id string, saved_at long, id string, audience string")
    gone = F.col("conv_id").cast("long") % 7 == 3
    store.save(rows.where("saved_at % 2 = 0"))
    store.save(rows.where("saved_at % 2 = 1"))
    store.delete(rows.where(gone).select("conv_id").distinct())
    store.save(rows.where(gone & (F.col("conv_id").cast("long") % 2 == 0) & (F.col("saved_at") == 1)))
    store.compact()
    x = store.load().select(F.col("conv_id").cast("long").alias("conv_id"), "saved_at", "id", "audience")
    return positions(x.withColumn("_newest", -F.col("saved_at")), "_newest", "conv_id").drop("_newest")


def stored_projects(spark, sf):
    """Projects that have a brief, by name, with the last version of it."""
    c = view(spark, sf, "sections_v")
    store = stores.projects(spark, scratch(spark, "projects"))
    kind = F.when(F.col("turn") % 4 == 1, stores.artifact("brief")).when(F.col("turn") % 4 == 2, stores.artifact("insights")).otherwise(F.concat(F.lit("outline_"), F.col("audience")))
    saved = c.select(F.concat(F.lit("p"), "conv_id").alias("project"), kind.alias("artifact"), F.timestamp_seconds(F.col("turn")).alias("saved_at"), F.to_json(F.struct("id", "title")).alias("body"))
    store.save(saved)
    store.delete(saved.where("artifact = 'brief' AND substring(project, -1) = '4'").select("project", "artifact").distinct())
    names = stores.project_names(store)
    return names.join(store.load().where("artifact = 'brief'"), "project").select("project", F.unix_timestamp("saved_at").alias("saved_at"), F.get_json_object("body", "$.id").alias("id"))


def sheet_pull(spark, sf):
    """A sheet of orders pulled over an earlier table: rows to the last whose first cell isn't blank, short ones filled."""
    names = ["page", "number", "context", "raw", "producer"]
    r, k = view(spark, sf, "refs_v"), F.col("k")
    last = F.lit(r.agg(F.max("k")).first()[0])
    values = F.array(F.when(k > last - 20, " ").otherwise(k.cast("string")), (k % 9).cast("string"), "journal", "raw", "producer", "url")
    cells = r.select((k + 2).cast("int").alias("row"), F.slice(values, 1, (F.lit(3) + k % 4).cast("int")).alias("values"))
    head = spark.createDataFrame([(1, ["\ufeffpage", *[f" {n} " for n in names[1:]]])], "row int, values array<string>")
    store = stores.Store(spark, scratch(spark, "sheet"), "row int, page string, number string, context string, raw string, producer string", ("row",), "row")
    store.save(r.select((k % 5).cast("int").alias("row"), *[F.lit("old").alias(n) for n in names]).distinct())
    stores.pull(store, head.union(cells), names)
    return store.load()


def harvest_rows(spark, sf):
    """Citations of two sources and some years with a word in the title, read through the contract of sources."""
    c = view(spark, sf, "citations_v").select(F.col("origin").alias("source"), "year", "id", "title", "journal", "doi", "pmid", "cited_by")
    path = scratch(spark, "harvest")
    contract.save_harvest(c, path)
    x = contract.search(spark, path, enabled=("pubmed", "s2", "none"), years=(2012, 2019), words=("the",))
    return x.select("source", "year", "id", "title", "journal", "doi", "pmid", "cited_by")


QUERIES = {f.__name__: f for f in (
    _reader("rows_of_openalex", records.openalex, OPENALEX), _reader("s2_rows", records.semantic_scholar, S2), _reader("crossref_rows", records.crossref, CROSSREF), _reader("registry_rows", records.clinical_trials, REGISTRY), _reader("pubmed_rows", records.pubmed, PUBMED),
    _reader("listing_rows", records.listing, LISTING), _reader("scholar_rows", records.scholar, SCHOLAR), citations_of_sources, answer_pages, cell_rows, slide_shapes, adverse_events, correction_examples, registry_numbers, cell_links, paper_links, pdf_validity, fallback_needed, csv_rows, log_progress, log_done, packages, stored_projects, sheet_pull, harvest_rows,
)}


def _row(origin, id, title="trim(coalesce(title, ''))", authors="origin", journal="journal", year="year", pmid="''", doi="''", abstract="''", cited_by="0", fwci="CAST(0.0 AS DOUBLE)", table="citations_v"):
    return f"SELECT '{origin}:' || {id} AS id, {title} AS title, {authors} AS authors, {journal} AS journal, CAST({year} AS INT) AS year, {pmid} AS pmid, {doi} AS doi, {abstract} AS abstract, CAST({cited_by} AS BIGINT) AS cited_by, {fwci} AS fwci, '{origin}' AS source_origin FROM {table}"


_S2_ROW = _row("s2", "'p' || ord", pmid="pmid", doi="trim(doi)", abstract="CASE WHEN ord % 2 = 0 THEN 'short ' || ord ELSE 'about ' || origin END", cited_by="cited_by")
_CROSSREF_ROW = _row("crossref", "trim(doi)", doi="trim(doi)", cited_by="cited_by")
_PDF_REASON = "CASE k % 5 WHEN 0 THEN 'valid PDF, ~1 page(s), 0 streams' WHEN 1 THEN 'too small (5 bytes)' WHEN 2 THEN 'HTML page (likely paywall/error), not PDF' WHEN 3 THEN 'missing %PDF- header' ELSE 'object mismatch: 4 obj vs 1 endobj' END"
_DOI = f"({_CANON})"

ORACLES = {
    "rows_of_openalex": _row("openalex", "'W' || ord", pmid="pmid", doi="trim(doi)", abstract="concat('w', ord % 7, ' x w', ord % 7)", cited_by="cited_by", fwci="fwci"),
    "s2_rows": _S2_ROW,
    "crossref_rows": _CROSSREF_ROW,
    "registry_rows": _row("registry", "'NCT' || lpad(CAST(ord AS VARCHAR), 8, '0')", authors="''", journal="''", abstract="origin"),
    "pubmed_rows": _row("pubmed", "ord", title="concat('Study ', ord, ' & more')", authors="''", journal="CASE WHEN ord % 2 = 0 THEN journal ELSE origin END", pmid="CAST(ord AS VARCHAR)", doi="concat('10.1/', ord)"),
    "listing_rows": _row("listing", "'10.1000/' || ord", title="concat('Title ', ord)", authors="concat('A ', origin, '|B Lee')", doi="concat('10.1000/', ord)")
    + " UNION ALL "
    + _row("listing", "(100000 + ord)", title="concat('Second ', ord)", authors="''", journal="''", year="0", pmid="CAST(100000 + ord AS VARCHAR)"),
    "scholar_rows": _row("scholar", "'https://doi.org/10.4/' || ord || '?x'", title="concat('Paper ', ord)", authors="'F ' || origin", doi="concat('10.4/', ord)", abstract="concat('snip ', ord % 9)", cited_by="cited_by"),
    "citations_of_sources": f"{_S2_ROW} UNION ALL {_CROSSREF_ROW}",
    "answer_pages": "SELECT ord AS page_id, concat('Yes ', ord) AS answer, 'Ref ' || origin AS title, concat('/r/', ord) AS url, concat('note ', year) AS snippet, CAST(year AS INT) AS year FROM citations_v",
    "cell_rows": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS INT) AS row_n, n_name AS name, CAST(n_nationkey AS VARCHAR) AS key, '' AS more FROM nation",
    "slide_shapes": "SELECT CAST(ord AS INT) AS slide, 0 AS shape, 0 AS row, journal AS text FROM citations_v UNION ALL SELECT ord, 1, 0, origin || ' | x' FROM citations_v UNION ALL SELECT ord, 1, 1, year || ' | y' FROM citations_v",
    "adverse_events": "SELECT p_brand AS term, CAST(p_size AS BIGINT) AS arm1, p_partkey AS arm2 FROM part",
    "correction_examples": "SELECT event_id AS id, user_id, event_type, CAST(1 AS INT) AS applied FROM events WHERE event_id % 3 = 0 ORDER BY event_id DESC LIMIT 50",
    "registry_numbers": "SELECT k, CASE k % 4 WHEN 0 THEN 'NCT02329860' WHEN 1 THEN 'NCT03713593' WHEN 2 THEN 'NCT03298451' ELSE '' END AS registry FROM refs_v",
    "cell_links": "SELECT k, concat('https://x.org/', k, ' file:///d/', k % 9, '.pdf') AS links FROM refs_v",
    "paper_links": f"SELECT k, CASE WHEN d = '' THEN '' ELSE concat(CASE WHEN k % 2 = 0 AND url <> '' THEN concat(journal, ' 全文=', url, ';') ELSE '' END, 'DOI 主链接=https://doi.org/', d, ';PubMed 搜索=https://pubmed.ncbi.nlm.nih.gov/?term=', d, ';Europe PMC 搜索=https://europepmc.org/search?query=', d) END AS links FROM (SELECT *, {_DOI} AS d FROM refs_v)",
    "pdf_validity": f"SELECT k, k % 5 = 0 AS valid, {_PDF_REASON} AS reason, CAST(CASE WHEN k % 5 IN (0, 4) THEN 1 ELSE 0 END AS BIGINT) AS pages FROM refs_v",
    "fallback_needed": f"SELECT k, k % 5 = 0 OR (k % 3 <> 0 AND {_PAY}) AS needed FROM refs_v",
    "csv_rows": "SELECT CAST(k AS VARCHAR) AS page, CAST(k % 9 AS VARCHAR) AS number, concat('say \"', journal, '\", twice') AS context, raw AS reference, '' AS doi, producer AS kind, creator AS pdf, url AS link FROM refs_v",
    "log_progress": "SELECT CASE WHEN ok THEN 'ok' ELSE 'failed' END AS status, count(*) AS n FROM outcomes_v GROUP BY 1",
    "log_done": "SELECT DISTINCT concat('d', job) AS doi FROM outcomes_v WHERE ok AND job % 10 <> 0",
    "packages": """WITH s AS (SELECT conv_id, max(turn) AS saved_at, arg_max(id, turn) AS id, arg_max(audience, turn) AS audience FROM (SELECT * FROM sections_v WHERE CASE WHEN conv_id % 7 = 3 THEN conv_id % 2 = 0 AND turn = 1 ELSE turn % 2 = 1 OR conv_id NOT IN (SELECT conv_id FROM sections_v WHERE turn % 2 = 1) END) GROUP BY conv_id)
      SELECT *, row_number() OVER (ORDER BY saved_at DESC, conv_id) - 1 AS position FROM s""",
    "stored_projects": "SELECT 'p' || conv_id AS project, max(turn) AS saved_at, arg_max(id, turn) AS id FROM sections_v WHERE turn % 4 = 1 AND conv_id % 10 <> 4 GROUP BY conv_id",
    "sheet_pull": """SELECT CAST(k + 2 AS INT) AS row, CASE WHEN k > (SELECT max(k) FROM refs_v) - 20 THEN ' ' ELSE CAST(k AS VARCHAR) END AS page, CAST(k % 9 AS VARCHAR) AS number, journal AS context, CASE WHEN k % 4 >= 1 THEN raw ELSE '' END AS raw, CASE WHEN k % 4 >= 2 THEN producer ELSE '' END AS producer
      FROM refs_v WHERE k <= (SELECT max(k) FROM refs_v WHERE k <= (SELECT max(k) FROM refs_v) - 20)""",
    "harvest_rows": "SELECT origin AS source, year, id, title, journal, doi, pmid, cited_by FROM citations_v WHERE origin IN ('pubmed', 's2') AND year BETWEEN 2012 AND 2019 AND contains(title, 'the')",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
