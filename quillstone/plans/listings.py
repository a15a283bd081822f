"""Queries over orders, positions, lookups and workflows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cells as K
from ..functions import text as T
from ..functions.reference import parse_reference
from ..operators import consensus as C
from ..operators import listing as L
from ..sources.views import view, with_views
from . import operators

DIMENSIONS = ("purchase", "click", "view", "error", "signup")


def authority_top(spark, sf):
    return L.top(operators.QUERIES["pagerank"](spark, sf), 10)


def mirrors_by_health(spark, sf):
    names = view(spark, sf, "outcomes_v").select("job").union(view(spark, sf, "refs_v").select(F.col("k").alias("job")))
    return L.positions(L.by_health(names, operators.QUERIES["health"](spark, sf), "job").withColumn("_worst", -F.col("score")), "_worst", "job").drop("_worst")


def findings_in_order(spark, sf):
    order = ("rank", "rule", "conv_id", "turn", "matched")
    return L.positions(L.by_severity(operators.QUERIES["rule_scan"](spark, sf), where=order[2:]).select(*order, "severity", "n"), *order)


def boxes_in_order(spark, sf):
    return L.from_the_top(view(spark, sf, "table_rows_v").select("grp", "k", "y"), "grp")


def _items(spark, sf):
    return view(spark, sf, "votes_v").select(F.col("question").alias("id"), F.col("answer").alias("dimension"), "confidence")


def items_by_dimension(spark, sf):
    return L.by_dimension(_items(spark, sf), DIMENSIONS)


def item_dimensions(spark, sf):
    return L.dimensions(_items(spark, sf), DIMENSIONS)


def position_diff(spark, sf):
    x = L.position_diff(view(spark, sf, "left_tab"), view(spark, sf, "right_tab"), ("context", "kind", "size"), "row_n")
    return x.select("row", "missing", F.array_join("differs", ",").alias("differs"))


def mark_rows(spark, sf):
    marks = view(spark, sf, "marks_v").select(F.col("k"), (F.col("k") % 50).alias("slide"), F.col("n").alias("mark"))
    table = view(spark, sf, "cite_lines_v").select(F.col("page").alias("slide"), (F.col("k") % 5).alias("mark"))
    return L.mark_rows(marks, table).select("k", "slide", "mark", "matched")


def _log(spark, sf):
    status = F.element_at(F.array(F.lit("pending"), F.lit("fixed"), F.lit("verified")), (F.col("event_id") % 3 + 1).cast("int"))
    return view(spark, sf, "outcomes_v").select(F.col("job").alias("id"), F.col("event_id").alias("seq"), status.alias("status"))


def pending_corrections(spark, sf):
    return L.pending(_log(spark, sf), at="seq")


def correction_steps(spark, sf):
    return L.status_steps(_log(spark, sf), at="seq")


def year_modes(spark, sf):
    r = view(spark, sf, "refs_v").select("k", F.concat_ws(" ", F.lit("In"), "year", F.concat(F.lit("("), 1990 + F.col("k") % 20, F.lit(")")), 1990 + F.col("k") % 3, F.when(F.col("k") % 4 == 0, F.col("year")), F.lit("x2021 123456")).alias("t"))
    return r.select("k", L.year_mode(F.col("t")).alias("year"), L.year_mode(F.lit("none")).alias("none"))


def trial_queries(spark, sf):
    names = F.element_at(F.array(*[F.lit(n) for n in ("himalaya", " IMbrave150 ", "reach-2", "CARES-310", "unknown", "checkmate 9dw", "")]), (F.col("k") % 7 + 1).cast("int"))
    return L.trial_lookup(view(spark, sf, "refs_v").select("k", names.alias("name")), "name").select("k", "name", "trial_pmid", "trial_journal", "trial_query")


def author_parts(spark, sf):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("一线治疗 ", "肝癌，", "", "注：")]), (F.col("k") % 4 + 1).cast("int"))
    return view(spark, sf, "refs_v").select("k", T.from_latin(F.concat(lead, "journal", F.lit(" "))).alias("part"), T.from_latin(lead).alias("none"))


def _slides(spark, sf):
    return view(spark, sf, "cite_lines_v").select("k", F.concat("line", F.lit(" rate 14."), F.col("k") % 10, F.lit("% of 9 TACE")).alias("t"))


def slide_points(spark, sf):
    return _slides(spark, sf).select("k", F.array_join(L.slide_points(F.col("t")), "|").alias("points"))


_LINES = """CASE k % 6 WHEN 0 THEN concat('Finn R, et al. ', j, '. ', year, ';', k % 90 + 1, '(', k % 12 + 1, '):', k % 800 + 1, '-', k % 800 + 9) WHEN 1 THEN concat('Qin S. ', j, ', ', year, ', ', k % 90 + 1, ': e', k % 800 + 1)
  WHEN 2 THEN concat('Li X. Nature ', k % 90 + 1, ', ', k % 800 + 1, '-', k % 800 + 9, ' (', year, ')') WHEN 3 THEN concat('Sun D, et al. ', year, ' ESMO. Abstract ', k % 800 + 1, 'P')
  WHEN 4 THEN concat('Wu A. A title[J]. ', j, ', ', year, ', ', k % 90 + 1, '(', k % 12 + 1, '):', k % 800 + 1) ELSE concat('nothing ', year, ' here') END"""


def reference_fields(spark, sf):
    r = view(spark, sf, "refs_v").select("k", "year", F.replace("journal", F.lit(" 2022"), F.lit("")).alias("j"))
    return r.select("k", parse_reference(F.expr(_LINES)).alias("r")).select("k", "r.*")


def voter_decisions(spark, sf):
    """What four voters, one of them asked twice, take each reference for."""
    has = lambda c, w: F.contains(F.lower(c), F.lit(w))
    C.register("link", C.expression(F.when(has("url", "doi"), "article").when(has("url", ".pdf"), "file").when(F.col("url") != "", "page"), F.lit(0.9)))
    C.register("journal", C.expression(F.when(has("journal", "globocan"), "page").otherwise("article"), (F.col("k") % 10).cast("double") / 10))
    C.register("name", C.expression(F.when(has("raw", "doi"), "article").otherwise("file"), F.lit(0.4)))
    C.register("size", C.expression(F.when(F.col("n_bytes") > 10000000, "file").otherwise("page"), F.lit(0.5)))
    q = view(spark, sf, "refs_v").withColumn("question", F.col("k"))
    d = C.decide(C.ask(q, ("link", "journal", "name", "size", "size")))
    shown = F.transform("answers", lambda a: F.concat_ws(":", F.coalesce(a["answer"], F.lit("")), a["n"].cast("string")))
    return d.select("question", F.coalesce("answer", F.lit("")).alias("answer"), F.round("agreement", 6).alias("agreement"), "agreed", F.array_join(shown, ",").alias("answers"))


def _briefs(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    k = F.col("p_partkey")
    apart = F.when(k % 3 == 0, F.array("p_brand", F.lit(" "), "p_type")).when(k % 3 == 1, F.array("p_type")).otherwise(F.lit(None).cast("array<string>"))
    return p.select(k.alias("project"), apart.alias("differentiators"), F.when(k % 4 == 0, F.array(F.lit("rival"), F.lit(""), "p_brand")).otherwise(F.array().cast("array<string>")).alias("competitors"))


def _literature(spark, sf):
    return view(spark, sf, "citations_v").select(F.col("conv_id").alias("project"), "id", "title", "cited_by", "ord")


def brief_insights(spark, sf):
    return C.brief_insights(_briefs(spark, sf), _literature(spark, sf))


def swot(spark, sf):
    return C.swot(_briefs(spark, sf), _literature(spark, sf))


def nested_cells(spark, sf):
    """Cells as a service sends them, in every form, as text and links, and whether they read like the plain text."""
    r, k = view(spark, sf, "refs_v"), F.col("k")
    node = F.struct(F.lit("see ").alias("text"))
    link = F.struct(F.col("journal").alias("value"), F.lit("url").alias("type"), F.col("url").alias("link"))
    forms = [
        F.to_json(F.struct(F.array(node, F.struct(F.col("journal").alias("text"))).alias("rich_text"))), F.concat(F.lit("["), F.to_json(node), F.lit(", [["), F.to_json(link), F.lit("], \"\", 5, {\"text\": 7}]]")), F.to_json(F.struct(F.concat(F.lit("see "), "journal", F.lit("\n")).alias("text"))),
        F.concat(F.lit("see "), "journal"), k.cast("string"), F.lit("null"), F.to_json(F.struct(F.lit(1).alias("text"), F.concat(F.lit("see "), "journal").alias("value"))),
    ]
    cell = F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int"))
    x = r.select("k", K.cell_nodes(cell).alias("n"), K.cell_nodes(F.to_json(F.array(F.concat(F.lit("see "), "journal")))).alias("m"))
    join = lambda f: F.array_join(F.transform("n", lambda v: v[f]), "|")
    return x.select("k", join("text").alias("texts"), join("type").alias("types"), join("link").alias("links"), K.same_cells(F.col("n"), F.col("m")).alias("same"))


QUERIES = {f.__name__: f for f in (authority_top, mirrors_by_health, findings_in_order, boxes_in_order, items_by_dimension, item_dimensions, position_diff, mark_rows, pending_corrections, correction_steps, year_modes, trial_queries, author_parts, slide_points, reference_fields, voter_decisions, brief_insights, swot, nested_cells)}

_RANK = "CASE {0} " + " ".join(f"WHEN '{d}' THEN {i}" for i, d in enumerate(DIMENSIONS)) + f" ELSE {len(DIMENSIONS)} END"
_LOG = "SELECT job AS id, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'fixed' ELSE 'verified' END AS status FROM outcomes_v"
_TRIALS = ", ".join("('" + "', '".join((n.upper(), p, j, " AND ".join(f'"{t}"[tiab]' for t in (*drugs, disease)))) + "')" for n, drugs, disease, j, _, p in L.TRIALS)
_TERMS = "[" + ", ".join(f"'{w}'" for w in L.POINT_TERMS) + "]"
_ONCE = "list_filter(l, lambda v, i: list_position(l, v) = i)"

ORACLES = {
    "boxes_in_order": "SELECT grp, k, y, CAST(row_number() OVER (PARTITION BY grp ORDER BY y, k) AS INT) AS place FROM table_rows_v",
    "voter_decisions": """WITH v AS (SELECT k AS question, unnest([{'a': CASE WHEN contains(lower(url), 'doi') THEN 'article' WHEN contains(lower(url), '.pdf') THEN 'file' WHEN url <> '' THEN 'page' END, 'c': 0.9::DOUBLE}, {'a': CASE WHEN contains(lower(journal), 'globocan') THEN 'page' ELSE 'article' END, 'c': (k % 10)::DOUBLE / 10},
        {'a': CASE WHEN contains(lower(raw), 'doi') THEN 'article' ELSE 'file' END, 'c': 0.4::DOUBLE}, {'a': CASE WHEN n_bytes > 10000000 THEN 'file' ELSE 'page' END, 'c': 0.5::DOUBLE}, {'a': CASE WHEN n_bytes > 10000000 THEN 'file' ELSE 'page' END, 'c': 0.5::DOUBLE}]) AS x FROM refs_v),
      c AS (SELECT question, x.a AS answer, count(*) AS n, round(avg(x.c), 9) AS c FROM v GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY n DESC, c DESC, answer NULLS FIRST) AS r FROM c)
      SELECT question, coalesce(max(answer) FILTER (r = 1), '') AS answer, round(max(n) / 5, 6)::DOUBLE AS agreement, max(n) / 5 >= 0.6::DOUBLE AS agreed, string_agg(coalesce(answer, '') || ':' || n, ',' ORDER BY r) AS answers FROM r GROUP BY 1""",
    "brief_insights": f"""WITH b AS (SELECT p_partkey AS project, CASE p_partkey % 3 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_type] ELSE [] END AS apart FROM part),
      t AS (SELECT conv_id AS project, id, title, row_number() OVER (PARTITION BY conv_id ORDER BY cited_by DESC, ord) AS n FROM citations_v WHERE conv_id IN (SELECT project FROM b)),
      l AS (SELECT project, max(n) AS last FROM t WHERE n <= {C.ANCHORS} GROUP BY 1), d AS (SELECT project, unnest(apart) AS v, unnest(range(1, len(apart) + 1)) AS i FROM b)
      SELECT project, CAST(n AS INT) AS n, '{C.EVIDENCE}' || left(title, {C.CLAIM}) AS claim, 'literature' AS dimension, id AS item, false AS advantage FROM t WHERE n <= {C.ANCHORS}
      UNION ALL SELECT project, CAST(coalesce(last, 0) + i AS INT), '{C.ADVANTAGE}' || v, 'competitor', NULL, true FROM d LEFT JOIN l USING (project)""",
    "swot": f"""WITH b AS (SELECT p_partkey AS project, CASE p_partkey % 3 WHEN 0 THEN [p_brand, p_type] WHEN 1 THEN [p_type] ELSE [] END AS apart, CASE WHEN p_partkey % 4 = 0 THEN ['rival', p_brand] ELSE [] END AS rivals FROM part)
      SELECT project, 'strength' AS part, CAST(unnest(range(len(apart))) AS INT) AS i, unnest(apart) AS text FROM b UNION ALL SELECT project, 'threat', CAST(unnest(range(len(rivals))) AS INT), '{C.THREAT[0]}' || unnest(rivals) || '{C.THREAT[1]}' FROM b
      UNION ALL SELECT project, 'weakness', 0, '{C.WEAK}' FROM b WHERE project NOT IN (SELECT conv_id FROM citations_v) UNION ALL SELECT project, 'opportunity', 0, '{C.CHANCE}' FROM b""",
    "nested_cells": """SELECT k, CASE WHEN k % 7 IN (0, 1) THEN 'see |' || journal WHEN k % 7 = 2 THEN 'see ' || journal || chr(10) WHEN k % 7 IN (3, 6) THEN 'see ' || journal WHEN k % 7 = 4 THEN CAST(k AS VARCHAR) ELSE '' END AS texts,
      CASE k % 7 WHEN 0 THEN 'text|text' WHEN 1 THEN 'text|url' WHEN 5 THEN '' ELSE 'text' END AS types, CASE k % 7 WHEN 0 THEN '|' WHEN 1 THEN '|' || url ELSE '' END AS links, k % 7 NOT IN (4, 5) AS same FROM refs_v""",
    "items_by_dimension": f"SELECT question AS id, answer AS dimension, confidence, CAST({_RANK.format('answer')} AS INT) AS rank FROM votes_v",
    "item_dimensions": f"SELECT answer AS dimension, count(*) AS n FROM votes_v WHERE answer IN {DIMENSIONS} GROUP BY 1",
    "position_diff": """SELECT row, missing, CASE WHEN missing THEN '' ELSE differs END AS differs FROM (SELECT a.p + 1 AS row, b.p IS NULL AS missing, concat_ws(',', CASE WHEN a.context IS DISTINCT FROM b.context THEN 'context' END, CASE WHEN a.kind IS DISTINCT FROM b.kind THEN 'kind' END, CASE WHEN a.size IS DISTINCT FROM b.size THEN 'size' END) AS differs
      FROM (SELECT *, row_number() OVER (ORDER BY row_n) AS p FROM left_tab) a LEFT JOIN (SELECT *, row_number() OVER (ORDER BY row_n) AS p FROM right_tab) b ON a.p = b.p) WHERE missing OR differs <> ''""",
    "mark_rows": "SELECT k, k % 50 AS slide, n AS mark, EXISTS (SELECT 1 FROM cite_lines_v c WHERE c.page = m.k % 50 AND c.k % 5 = m.n) AS matched FROM marks_v m",
    "pending_corrections": f"SELECT id, max(seq) AS seq FROM ({_LOG}) GROUP BY id HAVING arg_max(status, seq) = 'pending'",
    "correction_steps": f"""SELECT id, seq, status, CASE WHEN prev IS NULL THEN status = 'pending' WHEN prev = 'pending' THEN status = 'fixed' WHEN prev = 'fixed' THEN status = 'verified' ELSE false END AS allowed
      FROM (SELECT *, lag(status) OVER (PARTITION BY id ORDER BY seq) AS prev FROM ({_LOG}))""",
    "year_modes": """SELECT k, CAST(arg_max(y, n * 100 - place) AS VARCHAR) AS year, '' AS none FROM (SELECT k, y, count(*) AS n, min(i) AS place FROM (SELECT k, unnest([year, 1990 + k % 20, 1990 + k % 3, CASE WHEN k % 4 = 0 THEN year END]) AS y, unnest([1, 2, 3, 4]) AS i FROM refs_v) WHERE y IS NOT NULL GROUP BY ALL) GROUP BY k""",
    "trial_queries": f"""SELECT k, name, t.pmid AS trial_pmid, t.journal AS trial_journal, t.q AS trial_query FROM (SELECT k, CASE k % 7 WHEN 0 THEN 'himalaya' WHEN 1 THEN ' IMbrave150 ' WHEN 2 THEN 'reach-2' WHEN 3 THEN 'CARES-310' WHEN 4 THEN 'unknown' WHEN 5 THEN 'checkmate 9dw' ELSE '' END AS name FROM refs_v) r
      LEFT JOIN (VALUES {_TRIALS}) t(name_, pmid, journal, q) ON upper(trim(name)) = name_""",
    "author_parts": "SELECT k, trim(journal) AS part, '' AS none FROM refs_v",
    "reference_fields": """SELECT k, CASE k % 6 WHEN 0 THEN 'Finn R, et al' WHEN 1 THEN 'Qin S' WHEN 2 THEN 'Li X' WHEN 3 THEN 'Sun D, et al' WHEN 4 THEN 'Wu A' ELSE '' END AS authors, CASE WHEN k % 6 = 4 THEN 'A title' ELSE '' END AS title,
      CASE WHEN k % 6 IN (0, 1, 4) THEN replace(journal, ' 2022', '') WHEN k % 6 = 2 THEN 'Nature' ELSE '' END AS journal, CAST(year AS VARCHAR) AS year, CASE WHEN k % 6 IN (0, 1, 2, 4) THEN CAST(k % 90 + 1 AS VARCHAR) ELSE '' END AS volume,
      CASE WHEN k % 6 IN (0, 4) THEN CAST(k % 12 + 1 AS VARCHAR) ELSE '' END AS issue, CASE k % 6 WHEN 0 THEN concat(k % 800 + 1, '-', k % 800 + 9) WHEN 1 THEN concat('e', k % 800 + 1) WHEN 2 THEN concat(k % 800 + 1, '-', k % 800 + 9) WHEN 4 THEN CAST(k % 800 + 1 AS VARCHAR) ELSE '' END AS pages,
      CASE WHEN k % 6 = 3 THEN 'conference_abstract' ELSE 'literature' END AS kind, CASE WHEN k % 6 = 3 THEN 'ESMO' ELSE '' END AS meeting, CASE WHEN k % 6 = 3 THEN CAST(year AS VARCHAR) ELSE '' END AS meeting_year, CASE WHEN k % 6 = 3 THEN concat(k % 800 + 1, 'P') ELSE '' END AS abstract FROM refs_v""",
    "slide_points": rf"""SELECT k, array_to_string({_ONCE}[1:{L.MOST_POINTS}], '|') AS points FROM (SELECT k, list_concat(list_filter(regexp_extract_all(t, '\b(\d+(?:\.\d+)?)\s*%?', 1), lambda v: length(v) >= 2), list_filter({_TERMS}, lambda w: contains(t, w)),
      list_filter(regexp_extract_all(t, '\b([A-Z][A-Z\-]+(?:\d+)?)\b', 1), lambda v: length(v) >= 3)) AS l FROM (SELECT k, concat(line, ' rate 14.', k % 10, '% of 9 TACE') AS t FROM cite_lines_v))""",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
_HEALTH = with_views(operators.ORACLES["health"]) if not operators.ORACLES["health"].lstrip().startswith("WITH") else operators.ORACLES["health"]
ORACLES |= {
    "authority_top": f"SELECT * FROM ({operators.ORACLES['pagerank']}) ORDER BY score DESC, id LIMIT 10",
    "mirrors_by_health": f"SELECT n.job, coalesce(h.score, 0.5) AS score, row_number() OVER (ORDER BY coalesce(h.score, 0.5) DESC, n.job) - 1 AS position FROM (SELECT DISTINCT job FROM (SELECT user_id AS job FROM events UNION ALL SELECT o_orderkey FROM orders)) n LEFT JOIN ({_HEALTH}) h ON n.job = h.job",
    "findings_in_order": f"SELECT CAST(CASE severity WHEN 'fatal' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS INT) AS rank, severity, rule, conv_id, turn, matched, n, row_number() OVER (ORDER BY CASE severity WHEN 'fatal' THEN 0 WHEN 'warn' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, rule, conv_id, turn, matched) - 1 AS position FROM ({operators.ORACLES['rule_scan']})",
}
