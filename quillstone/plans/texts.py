"""Queries over citation lines, marks, numbers and questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.views import view, with_views

J = "|"


def key_fields(spark, sf):
    r = view(spark, sf, "cite_lines_v").withColumn("f", T.key_fields(F.col("line")))
    return r.select("k", F.array_join("f.authors", J).alias("authors"), *[F.col(f"f.{c}").alias(c) for c in ("journal", "year", "trial", "drug", "doi_tail")])


def key_match(spark, sf):
    """Each line's fields against the line of the row three keys on."""
    r = view(spark, sf, "cite_lines_v")
    other = r.select((F.col("k") - 3).alias("k"), F.col("line").alias("other"))
    m = r.join(other, "k").withColumn("m", T.match_fields(T.key_fields(F.col("line")), F.col("other")))
    return m.groupBy(F.array_join("m.matched", J).alias("matched"), F.array_join("m.missing", J).alias("missing"), F.col("m.reason").alias("reason")).agg(F.count("*").alias("n"), F.round(F.avg("m.score"), 6).alias("score"))


def citation_lines(spark, sf):
    """Lines that look like citations, each once for its normalized form, the first in page order."""
    r = view(spark, sf, "cite_lines_v").where((F.octet_length("line") >= 20) & T.is_citation(F.col("line")))
    return r.groupBy(T.normalized(F.col("line")).alias("norm")).agg(F.min(F.struct("page", "k")).alias("at"), F.count("*").alias("n")).select("norm", F.col("at.page").alias("page"), F.col("at.k").alias("k"), "n")


def parse_citations(spark, sf):
    r = view(spark, sf, "cite_lines_v").withColumn("c", T.parse_citation(F.col("line")))
    return r.select("k", F.coalesce(F.col("c.number"), F.lit(0)).alias("number"), *[F.col(f"c.{c}").alias(c) for c in ("authors", "journal", "year", "volume", "issue", "pages", "pmid", "doi", "trial")])


def numbered_segments(spark, sf):
    """Lines of a page run together and taken apart again at their numbers."""
    r = view(spark, sf, "cite_lines_v").where("k % 3 = 0")
    pages = r.groupBy("page", F.floor(F.col("k") / 4000).alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), " ").alias("t"))
    return pages.select("page", "part", F.posexplode(T.split_numbered(F.col("t")))).groupBy("page", "part").agg(F.count("*").alias("n"), F.sum(F.length("col")).alias("chars"))


def expand_marks(spark, sf):
    m = view(spark, sf, "marks_v")
    return m.groupBy("marks", F.array_join(T.expand_marks(F.col("marks")), ",").alias("numbers")).agg(F.count("*").alias("n"))


def number_variants(spark, sf):
    m = view(spark, sf, "marks_v").select("value").distinct()
    return m.select("value", F.array_join(T.number_variants(F.col("value")), J).alias("variants"))


def data_points(spark, sf):
    m = view(spark, sf, "marks_v")
    return m.select("k", "n", F.array_join(T.data_points(F.col("context")), J).alias("points"), T.unit_of(F.col("context")).alias("unit"))


def trial_flags(spark, sf):
    c = view(spark, sf, "citations_v", whole=True)
    return c.groupBy("conv_id").agg(F.count_if(T.is_trial(F.col("title"), F.col("abstract"), F.col("journal"))).alias("n_trials"), F.count("*").alias("n"))


def pico(spark, sf):
    q = view(spark, sf, "questions_v").withColumn("p", T.pico(F.col("question")))
    return q.groupBy("question", *[F.col(f"p.{c}").alias(c) for c in ("population", "intervention", "comparator", "outcome")]).agg(F.count("*").alias("n"))


def title_jaccard(spark, sf):
    """Titles of neighbouring documents compared, as sets and with repeats."""
    c = view(spark, sf, "citations_v").select("ord", "title")
    other = c.select((F.col("ord") - 1).alias("ord"), F.col("title").alias("other"))
    sim = lambda m: F.round(T.title_similarity(F.col("title"), F.col("other"), m), 6)
    return c.join(other, "ord").select("ord", sim(False).alias("similarity"), sim(True).alias("with_repeats"))


def abstracts(spark, sf):
    """Titles taken to an inverted index and back."""
    c = view(spark, sf, "citations_v").select("ord", F.posexplode(F.split("title", " ")).alias("p", "w"))
    index = c.groupBy("ord", "w").agg(F.sort_array(F.collect_list("p")).alias("ps")).groupBy("ord").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("ix"))
    return index.select("ord", T.abstract_of(F.col("ix")).alias("title"))


def venues(spark, sf):
    r = view(spark, sf, "cite_lines_v")
    line = F.concat(F.lit("A Smith, B Lee - "), F.regexp_replace("line", r"\d+-\d+.*$", ""), F.lit(", "), (F.lit(1990) + F.col("k") % 40).cast("string"))
    v = T.authors_venue(F.when(F.col("k") % 4 == 0, F.col("line")).otherwise(line))
    return r.withColumn("v", v).select("k", F.array_join("v.authors", J).alias("authors"), F.col("v.journal").alias("journal"), F.col("v.year").alias("year"))


def rich_cells(spark, sf):
    r = view(spark, sf, "refs_v").select("k", F.concat(F.lit("see "), "url", F.lit(" ("), "url", F.lit(") end")).alias("t"))
    n = r.withColumn("nodes", T.rich_cell(F.col("t")))
    return n.select("k", F.size("nodes").alias("n"), F.array_join(F.transform("nodes", lambda x: x["type"]), J).alias("types"), (T.cell_text(F.col("nodes")) == F.col("t")).alias("same"))


def folded(spark, sf):
    c = view(spark, sf, "citations_v")
    wide = F.translate("title", "abc .", "ａｂｃ　．")
    return c.select("ord", T.fold_width(wide).alias("title"), T.mostly_chinese(wide).alias("chinese"), (T.json_inside(F.concat(F.lit("x {"), "ord", F.lit("} y"))) == F.concat(F.lit("{"), "ord", F.lit("}"))).alias("json"))


QUERIES = {f.__name__: f for f in (key_fields, key_match, citation_lines, parse_citations, numbered_segments, expand_marks, number_variants, data_points, trial_flags, pico, title_jaccard, abstracts, venues, rich_cells, folded)}

_B = lambda p: p.replace(T.NO_BEFORE, r"\b").replace(T.NO_AFTER, r"\b")  # noqa: E731  the other engine's word border is ASCII
_STOPS = ", ".join(f"'{w}'" for w in T.AUTHOR_STOPS)
_JRN, _TRIAL, _DRUG, _YEAR = (f"regexp_extract(line, '{_B(p)}')" for p in (T.JOURNAL, T.TRIAL, T.DRUG, T.YEAR))
_NUM = r"regexp_extract(trim(line), '^\[?([0-9]{1,3})\s*[.)\]]', 1)"
_KF = f"""SELECT k, line, coalesce(list_position(list_transform(names, lambda w: w IN ({_STOPS})), true), len(names) + 1) AS stop, names, {_JRN} AS journal, {_YEAR} AS year, {_TRIAL} AS trial, {_DRUG} AS drug,
  rtrim(regexp_extract(line, '10\\.\\d+/([A-Za-z0-9._\\-/]+)', 1), ',;. ') AS doi_tail
  FROM (SELECT *, list_filter(regexp_extract_all(left(line, 200), '{_B(T.AUTHOR)}'), lambda w: length(w) >= 3) AS names FROM cite_lines_v)"""
_TOK = "list_filter(regexp_extract_all(lower({0}), '[a-z0-9一-鿿]+'), lambda w: w NOT IN ('a','an','the','of','in','on','and','or','is','are','was','were','with','from','for','to','by','at') AND strlen(w) > 1)"
_RISK = " ".join(f"WHEN contains(q, '{w}') THEN '{w}'" for w in T.OUTCOME)
_POP = " ".join(f"WHEN contains(q, '{w}') THEN '{w}'" for w in T.POPULATION)
_INT = " ".join(f"WHEN contains(q, '{w}') THEN '{w}'" for w in T.INTERVENTION)


def _around(key: str) -> str:
    pos = f"list_position(list_transform(ws, lambda w: contains(w, {key}) OR contains({key}, w)), true)"
    return f"CASE WHEN {key} IS NULL THEN '' WHEN {pos} IS NULL THEN {key} ELSE array_to_string(ws[greatest({pos} - 1, 1) : {pos} + 1], ' ') END"


_VS = r"(?:^|\s|[,.;:?!])(?:vs\.?|versus|compared\s+to|compared\s+with|与|和|对比)(?:\s|[,.;:?!]|$)"

ORACLES = {
    "key_fields": f"SELECT k, array_to_string(names[1 : least(stop - 1, 5)], '|') AS authors, journal, year, trial, drug, doi_tail FROM ({_KF})",
    "key_match": f"""WITH kf AS ({_KF}), p AS (SELECT a.*, a.names[1 : least(a.stop - 1, 5)] AS au, lower(trim(regexp_replace(b.line, '[ \\t\\n]+', ' ', 'g'))) AS t FROM kf a JOIN cite_lines_v b ON b.k = a.k + 3),
      f AS (SELECT k, [CASE WHEN len(au) > 0 THEN CASE WHEN len(list_filter(au, lambda x: contains(t, lower(x)))) > 0 THEN '+authors' ELSE '-authors' END END,
        CASE WHEN year <> '' THEN CASE WHEN contains(t, year) THEN '+year' ELSE '-year' END END,
        CASE WHEN journal <> '' THEN CASE WHEN contains(t, lower(journal)) OR contains(t, replace(lower(journal), ' ', '')) OR contains(t, left(lower(journal), 8)) THEN '+journal' ELSE '-journal' END END,
        CASE WHEN trial <> '' THEN CASE WHEN contains(t, lower(trial)) THEN '+trial' ELSE '-trial' END END, CASE WHEN drug <> '' THEN CASE WHEN contains(t, lower(drug)) THEN '+drug' ELSE '-drug' END END,
        CASE WHEN doi_tail <> '' THEN CASE WHEN contains(t, lower(doi_tail)) THEN '+doi_tail' ELSE '-doi_tail' END END] AS fs FROM p),
      g AS (SELECT array_to_string(list_transform(list_filter(fs, lambda x: x LIKE '+%'), lambda x: substr(x, 2)), '|') AS matched, array_to_string(list_transform(list_filter(fs, lambda x: x LIKE '-%'), lambda x: substr(x, 2)), '|') AS missing,
        len(list_filter(fs, lambda x: x LIKE '+%')) / CAST(len(list_filter(fs, lambda x: x IS NOT NULL)) AS DOUBLE) AS score FROM f)
      SELECT matched, missing, CASE WHEN score = 1 THEN 'perfect match' WHEN score >= 0.5 THEN 'good match' WHEN score > 0 THEN 'partial match' ELSE 'no match' END AS reason, count(*) AS n, round(avg(score), 6) AS score FROM g GROUP BY 1, 2, 3""",
    "citation_lines": f"""SELECT lower(trim(regexp_replace(line, '[ \\t\\n]+', ' ', 'g'))) AS norm, min(page) AS page, arg_min(k, CAST(page AS BIGINT) * 1000000000 + k) AS k, count(*) AS n FROM (SELECT *, {_NUM} <> '' AS num, regexp_matches(line, '^[A-Z][a-z]+') OR contains(lower(line), 'et al') AS au,
      {_JRN} <> '' AS jr, {_YEAR} <> '' AS yr, regexp_matches(line, '{T.PAGES}') OR regexp_matches(line, 'PMID:\\s*\\d+') AS pg FROM cite_lines_v)
      WHERE strlen(line) >= 30 AND (num OR (au AND yr) OR (jr AND pg) OR (length(line) - length(replace(line, ';', '')) >= 2 AND yr)) GROUP BY 1""",
    "parse_citations": f"""SELECT k, CAST(CASE WHEN {_NUM} = '' THEN 0 ELSE CAST({_NUM} AS INT) END AS INT) AS number, trim(regexp_extract(line, '^(?:\\[?[0-9]{{1,3}}\\s*[.)\\]]\\s*)?(.*?)(?:\\.\\s|$)', 1)) AS authors, {_JRN} AS journal,
      coalesce(regexp_extract_all(line, '{_B(T.YEAR)}')[-1], '') AS year, regexp_extract(line, ';\\s*(\\d+)\\s*\\(\\d+\\)\\s*:', 1) AS volume, regexp_extract(line, ';\\s*\\d+\\s*\\((\\d+)\\)', 1) AS issue, regexp_extract(line, '\\):\\s*(\\d+-\\d+)', 1) AS pages,
      regexp_extract(line, 'PMID:\\s*(\\d+)', 1) AS pmid, rtrim(regexp_extract(line, 'doi:\\s*(10\\.\\d{{4,9}}/\\S+)', 1), '.,;') AS doi, {_TRIAL} AS trial FROM cite_lines_v""",
    "expand_marks": """SELECT marks, coalesce(array_to_string(nums, ',')) AS numbers, sum(n)::BIGINT AS n FROM (SELECT marks, n, list_filter(xs, lambda x, i: list_position(xs, x) = i) AS nums FROM (SELECT marks, n,
      flatten(list_transform(list_transform(string_split(marks, ','), lambda p: trim(p)), lambda p: CASE WHEN regexp_matches(p, '^\\d+\\s*[-~]\\s*\\d+$') THEN range(least(CAST(regexp_extract(p, '^\\d+') AS BIGINT), CAST(regexp_extract(p, '\\d+$') AS BIGINT)), greatest(CAST(regexp_extract(p, '^\\d+') AS BIGINT), CAST(regexp_extract(p, '\\d+$') AS BIGINT)) + 1)
        WHEN regexp_matches(p, '^\\d+$') THEN [CAST(p AS BIGINT)] ELSE CAST([] AS BIGINT[]) END)) AS xs FROM (SELECT marks, count(*) AS n FROM marks_v GROUP BY 1))) GROUP BY 1, 2""",
    "data_points": """SELECT k, n, array_to_string(list_filter(xs, lambda x, i: list_position(xs, x) = i), '|') AS points, CASE WHEN contains(context, '%') THEN 'percentage' WHEN contains(context, 'month') THEN 'month' WHEN contains(context, 'year') THEN 'year' ELSE '' END AS unit
      FROM (SELECT *, list_filter(regexp_extract_all(context, '\\d+(?:\\.\\d+)?%?'), lambda x: x LIKE '%\\%' ESCAPE '\\' OR contains(x, '.') OR length(x) >= 2) AS xs FROM marks_v)""",
    "trial_flags": "SELECT conv_id, count(*) FILTER (regexp_matches(lower(concat_ws(' ', title, abstract, journal)), '" + "|".join(T.TRIAL_WORDS) + "')) AS n_trials, count(*) AS n FROM citations_v GROUP BY 1",
    "pico": f"""SELECT question, {_around("pk")} AS population, CASE WHEN versus THEN trim(regexp_replace(q, '{_VS}.*$', '')) ELSE {_around("ik")} END AS intervention,
      CASE WHEN versus THEN trim(regexp_extract(regexp_extract(q, '{_VS}(.*)$', 1), '^([^,?;]*)', 1)) ELSE '' END AS comparator, {_around("ok")} AS outcome, count(*) AS n
      FROM (SELECT question, q, regexp_matches(q, '{_VS}') AS versus, CASE {_POP} END AS pk, CASE {_INT} END AS ik, CASE {_RISK} END AS ok, list_transform(list_filter(regexp_split_to_array(q, '\\s+'), lambda w: w <> ''), lambda w: trim(w, ',.?:;')) AS ws
        FROM (SELECT question, lower(question) AS q FROM questions_v)) GROUP BY ALL""",
    "title_jaccard": f"""SELECT ord, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE i1 / CAST(len(x) + len(list_distinct(y)) - i1 AS DOUBLE) END, 6) AS similarity, round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE i2 / CAST(len(x) + len(y) - i2 AS DOUBLE) END, 6) AS with_repeats
      FROM (SELECT ord, x, y, len(list_filter(list_distinct(y), lambda t: list_contains(x, t))) AS i1, len(list_filter(y, lambda t: list_contains(x, t))) AS i2 FROM (SELECT a.ord, list_distinct({_TOK.format("a.title")}) AS x, {_TOK.format("b.title")} AS y FROM citations_v a JOIN citations_v b ON b.ord = a.ord + 1))""",
    "abstracts": "SELECT ord, title FROM citations_v",
    "venues": """SELECT k, CASE WHEN contains(t, ' - ') THEN 'A Smith|B Lee' ELSE '' END AS authors, trim(regexp_replace(regexp_replace(v, '\\d{4}\\s*$', ''), '[, ]+$', '')) AS journal, CASE WHEN y BETWEEN '1900' AND '2100' THEN y ELSE '' END AS year
      FROM (SELECT k, t, v, regexp_extract(v, '(\\d{4})\\s*$', 1) AS y FROM (SELECT k, t, CASE WHEN contains(t, ' - ') THEN substr(t, strpos(t, ' - ') + 3) ELSE t END AS v FROM (SELECT k, CASE WHEN k % 4 = 0 THEN line ELSE 'A Smith, B Lee - ' || regexp_replace(line, '\\d+-\\d+.*$', '') || ', ' || (1990 + k % 40) END AS t FROM cite_lines_v)))""",
    "rich_cells": """SELECT k, CAST(CASE WHEN url LIKE 'http%' THEN 5 ELSE 1 END AS INT) AS n, CASE WHEN url LIKE 'http%' THEN 'text|url|text|url|text' ELSE 'text' END AS types, true AS same FROM refs_v""",
    "folded": "SELECT ord, title, length(regexp_replace(translate(title, 'abc .', 'ａｂｃ　．'), '[^一-鿿]', '', 'g')) > length(title) // 2 AS chinese, true AS json FROM citations_v",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
