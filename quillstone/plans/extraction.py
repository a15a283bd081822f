"""Queries over windows, notes, keywords, claims, plans and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import text as T
from ..operators import planning as P
from ..sources.views import view, with_views

KNOWN, JOURNALS = ("Sorafenib", "Durvalumab", "HIMALAYA", "KEYNOTE-240"), ("Gut", "Lancet Oncol", "J Hepatol")
STEPS = ["purchase", "click", "view", "error"]


def citation_windows(spark, sf):
    """Slides of several lines run together, and the citations found in them."""
    r = view(spark, sf, "cite_lines_v")
    slides = r.groupBy((F.col("k") / 40).cast("long").alias("slide")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "  ").alias("t"))
    return slides.withColumn("w", X.windows(F.col("t"))).select("slide", F.size("w").alias("n"), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)).alias("chars"))


def line_scores(spark, sf):
    r = view(spark, sf, "cite_lines_v")
    return r.groupBy(X.line_score(F.col("line")).alias("score")).agg(F.count("*").alias("n"))


def note_routes(spark, sf):
    m = view(spark, sf, "marks_v")
    cell = F.concat(F.lit("位置1: 「"), "marks", F.lit("」 ("), F.col("n").cast("string"), F.lit(")\n- 疗效: "), "value", F.lit("\n注: "), "context", F.lit("\nother"))
    x = m.withColumn("c", X.notes(cell))
    return x.select("k", "n", F.array_join("c.visual", ";").alias("visual"), F.array_join("c.data", ";").alias("data"), F.array_join("c.reasons", ";").alias("reasons"))


def keyword_terms(spark, sf):
    r = view(spark, sf, "cite_lines_v")
    # An outer explosion, as before an inner one Spark works the terms out once more, to see whether there are any.
    terms = r.select(F.explode_outer(X.keywords(F.col("line"), F.lit("肝癌 生存 肝癌 发表"), KNOWN, JOURNALS)).alias("t")).where("t IS NOT NULL")
    return terms.groupBy("t.kind", "t.confidence").agg(F.count("*").alias("n"), F.countDistinct("t.term").alias("terms")).select("kind", "confidence", "n", "terms")


def term_variants(spark, sf):
    m = view(spark, sf, "marks_v").select(F.when(F.col("n") % 3 == 0, F.concat(F.lit("HR "), "value")).when(F.col("n") % 3 == 1, F.col("value")).otherwise(F.concat(F.lit("n="), F.col("k").cast("string"))).alias("term")).distinct()
    return m.select("term", F.array_join(X.term_variants(F.col("term")), "|").alias("variants"))


def claims(spark, sf):
    t = view(spark, sf, "table_rows_v")
    text = F.concat(F.when(F.col("k") % 2 == 0, "China HCC 5-year survival rate only ").otherwise("worldwide Lung incidence "), F.col("y").cast("string"), F.when(F.col("k") % 3 == 0, "%, far below other cancers").otherwise(" above all"))
    return t.withColumn("c", X.claim(text)).select("k", *[F.col(f"c.{c}").alias(c) for c in ("geography", "disease", "indicator", "value", "number", "unit", "target", "conclusion")])


def search_clauses(spark, sf):
    c = view(spark, sf, "citations_v")
    authors = F.when(F.col("ord") % 3 == 0, "Abou-Alfa GK, et al").when(F.col("ord") % 3 == 1, "X").otherwise("李明, 王")
    journal = F.when(F.col("ord") % 4 == 0, "ASCO Annual Meeting").when(F.col("ord") % 4 == 1, "").otherwise(F.col("journal"))
    return c.select("ord", X.search_clause(authors, journal, F.col("year"), F.col("title")).alias("clause"))


def markdown_cells(spark, sf):
    r = view(spark, sf, "refs_v")
    t = F.concat(F.lit("a [x"), F.col("k").cast("string"), F.lit("]("), F.when(F.col("url") == "", "https://e.org/").otherwise(F.col("url")), F.lit(") b"))
    n = r.withColumn("t", t).withColumn("n", X.markdown_nodes(F.col("t")))
    return n.select("k", F.size("n").alias("n"), (X.markdown_of(F.col("n")) == F.col("t")).alias("same"))


def wider_searches(spark, sf):
    c = view(spark, sf, "citations_v")
    authors = F.when(F.col("ord") % 3 == 0, "Abou-Alfa GK, et al").when(F.col("ord") % 3 == 1, "X").otherwise("李明, 王")
    journal = F.when(F.col("ord") % 4 == 0, "ASCO Annual Meeting").when(F.col("ord") % 4 == 1, "").otherwise(F.col("journal"))
    year = F.when(F.col("ord") % 5 > 0, F.col("year"))
    return c.select("ord", F.explode(X.wider_searches(authors, journal, year)).alias("t")).select("ord", "t.name", "t.query")


def main_scores(spark, sf):
    k = F.col("k")
    measured = F.when(k % 7 == 0, (k % 90).cast("double") / 100)
    return view(spark, sf, "refs_v").select("k", X.main_score(k % 5 > 0, measured, k % 9, k % 4, k % 2 == 0).alias("score"))


def fallback_scores(spark, sf):
    r = view(spark, sf, "refs_v")
    name = F.concat("journal", F.when(F.col("k") % 5 == 0, "_Appendix").when(F.col("k") % 5 == 1, "_review").when(F.col("k") % 5 == 2, "_2024_China").otherwise(""), F.lit(".pdf"))
    return r.groupBy(X.fallback_score(name, F.col("k") % 2 == 0).alias("score")).agg(F.count("*").alias("n"))


def page_verdicts(spark, sf):
    r = view(spark, sf, "cite_lines_v")
    page = F.when(F.col("k") % 5 == 0, "").when(F.col("k") % 5 == 1, F.col("line")).when(F.col("k") % 5 == 2, F.lit("Gut 2010")).otherwise("Smith and Finn")
    return r.withColumn("v", X.page_verdict(F.col("line"), page)).groupBy(F.col("v.verdict").alias("verdict"), F.col("v.score").alias("score")).agg(F.count("*").alias("n"))


def located(spark, sf):
    """Half of each title found again in full-width writing."""
    c = view(spark, sf, "citations_v").where("length(title) >= 8")
    wide = F.translate("title", "abc", "ａｂｃ")
    return c.select("ord", F.size(X.locate(wide, F.substring("title", 1, 8))).alias("n"), F.get(X.locate(wide, F.substring("title", 1, 8)), F.lit(0))["start"].alias("start"))


def query_matrix(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet")
    b = p.select(
        F.col("p_partkey").alias("project"), F.when(F.col("p_partkey") % 5 > 0, F.col("p_name")).otherwise("").alias("name"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise("").alias("company"), F.when(F.col("p_partkey") % 2 == 0, "PD-1").otherwise("").alias("moa"),
        F.when(F.col("p_partkey") % 4 > 0, F.array("p_type")).otherwise(F.array().cast("array<string>")).alias("indications"), F.when(F.col("p_partkey") % 7 == 0, F.array(F.lit("rival"), F.lit(" "))).otherwise(F.array().cast("array<string>")).alias("competitors"), F.array(F.lit("cost")).alias("terms"),
    )
    return P.query_matrix(b)


def _items(spark, sf):
    c = view(spark, sf, "citations_v")
    dim = F.element_at(F.array(*[F.lit(d) for d in P.DIMENSIONS]), (F.col("ord") % 5 + 1).cast("int"))
    return P.numbered(c.select(F.col("conv_id").alias("project"), dim.alias("dimension"), F.lower("title").alias("key"), "ord"))


def numbered_items(spark, sf):
    return _items(spark, sf).select("project", "dimension", "key", "ord", "item")


def section_evidence(spark, sf):
    return P.evidence_of(_items(spark, sf))


def outline_changes(spark, sf):
    x = view(spark, sf, "sections_v").select("conv_id", "title", F.length("body").alias("points"), "turn")
    return P.outline_changes(x.where("turn % 3 <> 1"), x.where("turn % 4 <> 2").withColumn("points", F.col("points") + F.col("turn") % 2), "conv_id")


def coverage(spark, sf):
    m = view(spark, sf, "marks_v")
    key = F.concat_ws("-", F.col("k").cast("string"), F.col("n").cast("string"), "value").alias("key")
    truth = m.select(key, F.concat("context", F.when(F.col("k") % 3 == 0, " 12月").otherwise(" 3.5万")).alias("text"))
    seen = m.where("k % 2 = 0").select(key, F.array("value", F.lit("12月")).alias("points")).dropDuplicates(["key"])
    return P.coverage(truth, seen, "key")


def step_matrix(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return P.step_matrix(e.select(F.col("user_id").alias("project"), F.col("event_type").alias("step"), (F.col("event_id") % 50 != 0).alias("ok")), STEPS)


def source_priority(spark, sf):
    c = view(spark, sf, "citations_v")
    return P.by_priority(c.select("conv_id", "ord", "origin"), "origin", ("s2", "pubmed", "openalex"), "conv_id", "ord")


def first_rows(spark, sf):
    return P.first_rows(view(spark, sf, "citations_v").select("origin", "ord"), "origin", ["ord"], 20)


def generated_tests(spark, sf):
    r = view(spark, sf, "refs_v")
    c = r.select(F.concat(F.lit("c-"), F.col("k").cast("string")).alias("id"), F.when(F.col("k") % 3 == 0, "missing").when(F.col("k") % 3 == 1, "wrong_value").otherwise("other").alias("kind"), F.col("raw").alias("input"), F.col("journal").alias("expected"))
    return P.test_cases(c)


def prompt_cache(spark, sf):
    r = view(spark, sf, "refs_v")
    cache = r.where("k % 4 = 0").select(F.substring("url", 1, 32).alias("sig"), F.col("journal").alias("value"))
    return P.cached(r.select("k", F.substring("url", 1, 32).alias("sig")), cache, "sig")


QUERIES = {
    f.__name__: f
    for f in (
        citation_windows, line_scores, note_routes, keyword_terms, term_variants, claims, search_clauses, wider_searches, main_scores, markdown_cells, fallback_scores, page_verdicts, located,
        query_matrix, numbered_items, section_evidence, outline_changes, coverage, step_matrix, source_priority, first_rows, generated_tests, prompt_cache,
    )
}

_DIM = "CASE ord % 5 WHEN 0 THEN 'literature' WHEN 1 THEN 'news' WHEN 2 THEN 'report' WHEN 3 THEN 'policy' ELSE 'competitor' END"
_ITEMS = f"i AS (SELECT conv_id AS project, {_DIM} AS dimension, lower(title) AS key, min(ord) AS ord FROM citations_v GROUP BY ALL), c AS (SELECT *, CAST(row_number() OVER (PARTITION BY project, dimension ORDER BY ord, key) AS VARCHAR) AS n FROM i), j AS (SELECT * EXCLUDE (n), upper(left(dimension, 1)) || lpad(n, greatest(3, length(n))::INT, '0') AS item FROM c)"
_FB = "CASE WHEN contains(n, 'review') THEN 0.65 WHEN contains(n, 'appendix') THEN 0.5 WHEN contains(n, 'globocan') OR (contains(n, '2024') AND contains(n, 'china')) THEN 0.65 WHEN contains(n, 'lancet') THEN 0.7 WHEN k % 2 = 0 THEN 0.6 ELSE 0.5 END"

_B = lambda p: p.replace(T.NO_BEFORE, r"\b").replace(T.NO_AFTER, r"\b")
_NUM = r"regexp_extract(trim(line), '^\[?([0-9]{1,3})\s*[.)\]]', 1)"

ORACLES = {
    "line_scores": f"""SELECT CAST(CASE WHEN contains(lower(line), 'reference') THEN greatest(s, 2) ELSE s END AS INT) AS score, count(*) AS n FROM (SELECT line, regexp_matches(line, '{_B(T.YEAR)}')::INT + regexp_matches(line, '{_B(T.JOURNAL)}')::INT + regexp_matches(line, '{X.VOLUME}')::INT
      + 2 * (contains(lower(line), 'doi:') OR regexp_matches(line, '{X.DOI}'))::INT + 2 * contains(lower(line), 'pmid:')::INT + regexp_matches(line, '{X.NAMED}')::INT + ({_NUM} <> '')::INT AS s FROM cite_lines_v) GROUP BY 1""",
    "term_variants": """WITH t AS (SELECT DISTINCT CASE WHEN n % 3 = 0 THEN 'HR ' || value WHEN n % 3 = 1 THEN value ELSE 'n=' || k END AS term FROM marks_v), v AS (SELECT term, unnest([term, CASE WHEN p <> '' THEN p || '%' END, CASE WHEN p <> '' THEN p || ' %' END, CASE WHEN p <> '' THEN p || '％' END,
      CASE WHEN h <> '' THEN 'HR' || h END, CASE WHEN h <> '' THEN 'HR ' || h END, CASE WHEN h <> '' THEN 'HR = ' || h END, CASE WHEN h <> '' THEN 'HR=' || h END, CASE WHEN h <> '' THEN h END, CASE WHEN c <> '' THEN 'n = ' || c END, CASE WHEN c <> '' THEN 'n= ' || c END, CASE WHEN c <> '' THEN ' n ' || c || ' ' END,
      CASE WHEN contains(term, ' ') THEN replace(term, ' ', '') END]) AS x FROM (SELECT term, regexp_extract(term, '^(\\d+\\.?\\d*)\\s*%$', 1) AS p, regexp_extract(term, '^HR\\s*(\\d+\\.?\\d*)$', 1) AS h, regexp_extract(term, '^n=(\\d+)$', 1) AS c FROM t))
      SELECT term, string_agg(DISTINCT x, '|' ORDER BY x) AS variants FROM v WHERE x IS NOT NULL GROUP BY 1""",
    "coverage": """WITH x AS (SELECT m.k, m.n, context || CASE WHEN m.k % 3 = 0 THEN ' 12月' ELSE ' 3.5万' END AS t, CASE WHEN m.k % 2 = 0 THEN [value, '12月'] ELSE [] END AS p FROM marks_v m),
      u AS (SELECT list_distinct(regexp_extract_all(t, '\\d+\\.?\\d*%')) AS a, list_distinct(regexp_extract_all(t, '\\d+\\.?\\d*月')) AS b, list_distinct(regexp_extract_all(t, '\\d+\\.?\\d*万')) AS c, p FROM x),
      v AS (SELECT len(a) AS wa, len(b) AS wb, len(c) AS wc, len(list_intersect(a, p)) AS ha, len(list_intersect(b, p)) AS hb, len(list_intersect(c, p)) AS hc FROM u)
      SELECT '%' AS unit, sum(wa)::BIGINT AS wanted, sum(ha)::BIGINT AS found FROM v UNION ALL SELECT '月', sum(wb)::BIGINT, sum(hb)::BIGINT FROM v UNION ALL SELECT '万', sum(wc)::BIGINT, sum(hc)::BIGINT FROM v
      UNION ALL SELECT 'row', count(*), count(*) FILTER (wa + wb + wc = 0 OR (ha + hb + hc) / CAST(wa + wb + wc AS DOUBLE) >= 0.5) FROM v""",
    "note_routes": "SELECT k, n, marks || ' (' || n || ')' AS visual, concat_ws(';', '疗效: ' || value, CASE WHEN contains(context, '%') OR contains(context, '5-y') THEN '注: ' || context END) AS data, '注: ' || context AS reasons FROM (SELECT *, false AS z FROM marks_v) WHERE NOT z",
    "claims": """SELECT k, CASE WHEN k % 2 = 0 THEN 'China' ELSE 'worldwide' END AS geography, CASE WHEN k % 2 = 0 THEN 'HCC' ELSE 'Lung' END AS disease, CASE WHEN k % 2 = 0 THEN '5-year survival' ELSE 'incidence' END AS indicator,
      CASE WHEN k % 3 = 0 THEN v || '%' WHEN k % 2 = 0 THEN '5' ELSE v END AS value, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN 5.0 ELSE y END AS number, CASE WHEN k % 3 = 0 THEN '%' ELSE '' END AS unit, CASE WHEN k % 3 = 0 THEN '其他癌种' WHEN k % 2 = 0 THEN 'HCC' ELSE 'Lung' END AS target,
      CASE WHEN k % 3 = 0 THEN 'below_all' ELSE 'above_all' END AS conclusion FROM (SELECT *, CAST(y AS VARCHAR) AS v FROM table_rows_v)""",
    "search_clauses": """SELECT ord, array_to_string(list_concat(p, CASE WHEN len(p) <= 1 AND len(w) >= 3 THEN ['"' || array_to_string(w[1:3], ' ') || '"[Title/Abstract]'] ELSE [] END), ' AND ') AS clause FROM (SELECT ord, list_filter([CASE WHEN ord % 3 = 0 THEN '"Abou-Alfa"[Author]' END,
      CASE WHEN ord % 4 >= 2 THEN '"' || journal || '"[Journal]' END, year || '[Date - Publication - Year]'], lambda x: x IS NOT NULL) AS p, list_filter(regexp_split_to_array(title, '\\s+'), lambda x: x <> '') AS w FROM citations_v)""",
    "wider_searches": """WITH c AS (SELECT ord, CASE WHEN ord % 4 >= 2 THEN '"' || journal || '"[Journal]' END AS j, CASE WHEN ord % 5 > 0 AND year BETWEEN 1990 AND 2030 THEN year || '[Date - Publication - Year]' END AS y FROM citations_v)
      SELECT ord, 'relaxed' AS name, j || ' AND ' || y AS query FROM c WHERE j IS NOT NULL AND y IS NOT NULL UNION ALL SELECT ord, 'author', '"Abou-Alfa"[Author]' FROM c WHERE ord % 3 = 0 UNION ALL SELECT ord, 'journal', concat_ws(' AND ', j, y) FROM c WHERE j IS NOT NULL""",
    "main_scores": "SELECT k, CASE WHEN k % 5 = 0 THEN 0.0::DOUBLE WHEN k % 7 = 0 THEN (k % 90)::DOUBLE / 100 WHEN k % 4 > 0 THEN round(least((k % 9)::DOUBLE / (k % 4), 1.0::DOUBLE), 2) WHEN k % 2 = 0 THEN 0.4::DOUBLE END AS score FROM refs_v",
    "markdown_cells": "SELECT k, CAST(CASE WHEN url LIKE 'http%' OR url = '' THEN 3 ELSE 1 END AS INT) AS n, true AS same FROM refs_v",
    "fallback_scores": f"SELECT CAST({_FB} AS DOUBLE) AS score, count(*) AS n FROM (SELECT k, lower(journal || CASE k % 5 WHEN 0 THEN '_Appendix' WHEN 1 THEN '_review' WHEN 2 THEN '_2024_China' ELSE '' END || '.pdf') AS n FROM refs_v) GROUP BY 1",
    "query_matrix": """WITH b AS (SELECT p_partkey AS project, CASE WHEN p_partkey % 5 > 0 THEN trim(p_name) ELSE '' END AS n, CASE WHEN p_partkey % 4 > 0 THEN trim(p_type) ELSE '' END AS i, p_partkey AS k, p_brand FROM part),
      q AS (SELECT project, unnest([{'d': 'literature', 'q': CASE WHEN n <> '' THEN concat_ws(' ', n, nullif(i, ''), 'clinical trial') END}, {'d': 'literature', 'q': CASE WHEN n <> '' THEN n || ' safety efficacy' END}, {'d': 'literature', 'q': CASE WHEN n <> '' AND k % 2 = 0 THEN n || ' PD-1' END},
       {'d': 'literature', 'q': CASE WHEN i <> '' THEN i || ' treatment guideline' END}, {'d': 'literature', 'q': CASE WHEN i <> '' THEN i || ' cost' END}, {'d': 'news', 'q': CASE WHEN n <> '' THEN n || ' 获批 上市 进展' END}, {'d': 'news', 'q': CASE WHEN k % 3 = 0 THEN concat_ws(' ', p_brand, nullif(CASE WHEN n <> '' THEN n ELSE i END, ''), '动态') END},
       {'d': 'report', 'q': CASE WHEN i <> '' THEN i || ' 市场规模 流行病学 研报' WHEN n <> '' THEN n || ' 市场 竞争格局' END}, {'d': 'policy', 'q': CASE WHEN i <> '' THEN i || ' 医保 支付 政策' END}, {'d': 'policy', 'q': '药品审评审批 医保谈判 最新政策'},
       {'d': 'competitor', 'q': CASE WHEN k % 7 = 0 THEN concat_ws(' ', 'rival', nullif(i, ''), '临床 进展') WHEN n <> '' THEN n || ' 同类 竞品 对比' END}]) AS x FROM b)
      SELECT DISTINCT project, x.d AS dimension, x.q AS query FROM q WHERE x.q IS NOT NULL""",
    "numbered_items": f"WITH {_ITEMS} SELECT * FROM j",
    "section_evidence": f"""WITH {_ITEMS}, s AS (SELECT *, unnest(CASE dimension WHEN 'literature' THEN ['4', '6'] WHEN 'competitor' THEN ['2'] WHEN 'policy' THEN ['1', '5'] ELSE ['1'] END) AS section, CASE dimension WHEN 'literature' THEN 0 WHEN 'news' THEN 1 WHEN 'report' THEN 2 WHEN 'policy' THEN 3 ELSE 4 END AS rk FROM j),
      r AS (SELECT *, row_number() OVER (PARTITION BY project, section ORDER BY rk, length(item), item) AS r FROM s) SELECT project, section, count(*) AS n, string_agg(item, ',' ORDER BY r) AS items FROM r WHERE r <= 6 GROUP BY 1, 2""",
    "outline_changes": """WITH b AS (SELECT conv_id, lower(trim(title)) AS t, max(length(body)) AS p FROM sections_v WHERE turn % 3 <> 1 GROUP BY 1, 2), a AS (SELECT conv_id, lower(trim(title)) AS t, max(length(body) + turn % 2) AS p FROM sections_v WHERE turn % 4 <> 2 GROUP BY 1, 2)
      SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, count(b.p) AS n_before, count(a.p) AS n_after, count(*) FILTER (b.p IS NULL) AS added, count(*) FILTER (a.p IS NULL) AS removed, count(*) FILTER (a.p > b.p) AS expanded FROM b FULL JOIN a ON a.conv_id = b.conv_id AND a.t = b.t GROUP BY 1""",
    "step_matrix": "SELECT project, " + ", ".join(f'"{x}"' for x in STEPS) + ", concat_ws(',', " + ", ".join(f"CASE WHEN NOT \"{x}\" THEN '{x}' END" for x in STEPS) + ") AS failed FROM (SELECT user_id AS project, " + ", ".join(f"bool_and(event_id % 50 <> 0) FILTER (event_type = '{x}') AS \"{x}\"" for x in STEPS) + " FROM events GROUP BY 1)",
    "source_priority": "SELECT conv_id, ord, origin, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY CASE origin WHEN 's2' THEN 0 WHEN 'pubmed' THEN 1 WHEN 'openalex' THEN 2 ELSE 3 END, ord) AS INT) AS rank FROM citations_v",
    "first_rows": "SELECT origin, ord FROM (SELECT origin, ord, row_number() OVER (PARTITION BY origin ORDER BY ord) AS r FROM citations_v) WHERE r <= 20",
    "generated_tests": "SELECT 'c-' || k AS id, 'test_c_' || k AS name, CASE k % 3 WHEN 0 THEN 'assert ' || journal || ' in result' WHEN 1 THEN 'assert parse(' || raw || ') == ' || journal ELSE '# other: ' || raw END AS body FROM refs_v",
    "prompt_cache": "WITH c AS (SELECT left(url, 32) AS sig, min(journal) AS value FROM refs_v WHERE k % 4 = 0 GROUP BY 1) SELECT k, left(r.url, 32) AS sig, value, value IS NOT NULL AS hit FROM refs_v r LEFT JOIN c ON c.sig = left(r.url, 32)",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
