"""SQL of queries that fold rows in order or look numbers up in all their writings: recursive statements and lists."""

from __future__ import annotations

from ..functions import extract as X
from ..functions import text as T
from ..operators.evidence import PLACEHOLDERS
from ..sources.views import with_views
from .extraction import JOURNALS, KNOWN
from .operators import _HASH
from .texts import _B, _KF, _TOK

QUERIES: dict = {}

_ONCE = "list_filter({0}, lambda v, i: list_position({0}, v) = i)"
_VARIANTS = f"""bare AS (SELECT value, rtrim(value, '%') AS b, CAST(rtrim(value, '%') AS DOUBLE) AS x FROM (SELECT DISTINCT value FROM marks_v)),
fixed AS (SELECT *, printf('%.1f', x) AS f1, printf('%.2f', x) AS f2, printf('%.3f', x) AS f3 FROM bare),
short AS (SELECT *, regexp_replace(regexp_replace(f1, '0+$', ''), '\\.$', '') AS s1, regexp_replace(regexp_replace(f2, '0+$', ''), '\\.$', '') AS s2, regexp_replace(regexp_replace(f3, '0+$', ''), '\\.$', '') AS s3 FROM fixed),
plain AS (SELECT value, b, x, list_filter([CASE WHEN s1 <> b THEN s1 END, f1, CASE WHEN s2 <> b THEN s2 END, f2, CASE WHEN s3 <> b THEN s3 END, f3], lambda v: v IS NOT NULL) AS p FROM short),
every AS (SELECT value, CASE WHEN contains(value, '%') THEN list_concat([value], flatten(list_transform(p, lambda v: [v, v || '%'])), [b]) WHEN x <= 100 THEN list_concat([value], p, [b || '%'], list_transform(p, lambda v: v || '%')) ELSE list_concat([value], p) END AS l FROM plain),
variant AS (SELECT value, {_ONCE.format("l")} AS v FROM every)"""
_FIRSTS = f"SELECT k, line, names[1 : least(stop - 1, 5)] AS authors, journal, year, doi_tail FROM ({_KF})"
_REAL = "trim({0}) <> '' AND lower(trim({0})) NOT IN (" + ", ".join(f"'{p}'" for p in PLACEHOLDERS) + ")"
_X, _Y = _TOK.format("c.title"), _TOK.format("r.ref_title")

def _rounds(most: int = 50, every: int = 5, tolerance: str = "1e-6") -> str:
    """PageRank round by round, up to the first of every few rounds that hardly moved a score."""
    parts = ["""nodes AS MATERIALIZED (SELECT src AS id FROM edges_v UNION SELECT dst FROM edges_v), n AS (SELECT count(*) AS n FROM nodes), d AS (SELECT src, count(*) AS deg FROM edges_v GROUP BY 1),
l AS MATERIALIZED (SELECT DISTINCT e.src, e.dst, deg FROM edges_v e JOIN d USING (src)), s0 AS MATERIALIZED (SELECT id, 0.0::DOUBLE AS score FROM nodes)"""]
    ends, open_ = [], "true"
    for k in range(1, most + 1):
        parts.append(f"s{k} AS MATERIALIZED (SELECT id, (1 - 0.85::DOUBLE) / (SELECT n FROM n) + 0.85::DOUBLE * coalesce(got, 0) AS score FROM nodes LEFT JOIN (SELECT dst, sum(score / deg) AS got FROM l JOIN s{k - 1} ON src = id GROUP BY 1) ON dst = id)")
        if k % every == 0:
            parts.append(f"m{k} AS MATERIALIZED (SELECT max(abs(a.score - b.score)) < {tolerance} AS still FROM s{k} a JOIN s{k - 1} b USING (id))")
            still = f"(SELECT still FROM m{k})" if k < most else "true"
            ends.append(f"SELECT id, score FROM s{k} WHERE {open_} AND {still}")
            open_ += f" AND NOT {still}"
    return f"WITH {', '.join(parts)} SELECT id, round(score, 6) AS score FROM ({' UNION ALL '.join(ends)})"


_ORACLES = {
    "pagerank_converged": _rounds(),
    "number_variants": f"WITH {_VARIANTS} SELECT value, array_to_string(v, '|') AS variants FROM variant",
    "point_alignment": f"""WITH {_VARIANTS}, t AS (SELECT k, string_agg(context, ' ' ORDER BY context) AS text FROM marks_v GROUP BY 1),
p AS (SELECT k, len(list_filter(v, lambda w: contains(lower(text), lower(w)))) > 0 AS found FROM marks_v JOIN variant USING (value) JOIN t USING (k))
SELECT k, count(*) AS n, count(*) FILTER (found) AS found, round(count(*) FILTER (found) / count(*), 6)::DOUBLE AS ratio FROM p GROUP BY 1""",
    "paper_match": f"""WITH f AS (SELECT k, lower(coalesce(authors[1], '')) AS s, lower(journal) AS j, year AS y, lower(doi_tail) AS d FROM ({_FIRSTS})),
a AS (SELECT *, CASE WHEN k % 7 = 1 THEN 'abou' WHEN k % 11 = 0 THEN '' ELSE s END AS s2, CASE WHEN k % 13 = 0 THEN 'cell' ELSE j END AS j2, CASE WHEN k % 5 = 0 THEN '' ELSE y END AS y2 FROM f),
g AS (SELECT *, s <> '' AND s2 <> '' AS bs, j <> '' AND j2 <> '' AS bj, y <> '' AND y2 <> '' AS by_, d <> '' AS bd, CASE WHEN s = s2 THEN 0.3::DOUBLE WHEN contains(s2, s) OR contains(s, s2) THEN 0.15::DOUBLE ELSE 0 END AS gs, CASE WHEN contains(j2, j) OR contains(j, j2) THEN 0.3::DOUBLE ELSE 0 END AS gj, CASE WHEN y = y2 THEN 0.2::DOUBLE ELSE 0 END AS gy FROM a),
w AS (SELECT k, CASE WHEN bs THEN gs WHEN s <> '' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN bj THEN gj WHEN j <> '' THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN by_ THEN gy WHEN y <> '' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN bd THEN 0.2::DOUBLE ELSE 0 END AS parts,
  CASE WHEN s <> '' AND s2 = '' THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN j <> '' AND j2 = '' THEN 0 ELSE 0.3::DOUBLE END + CASE WHEN y <> '' AND y2 = '' THEN 0 ELSE 0.2::DOUBLE END + 0.2::DOUBLE AS scale, bs AND gs = 0 OR bj AND gj = 0 OR by_ AND gy = 0 AS wrong FROM g)
SELECT k, round(CASE WHEN scale > 0 THEN parts / scale ELSE 0 END, 3)::DOUBLE AS score, CASE WHEN scale > 0 THEN parts / scale ELSE 0 END >= 0.5::DOUBLE AND NOT wrong AS ok FROM w""",
    "authenticity": f"""WITH r AS (SELECT ord + ord % 2 AS ord, min(title) AS ref_title FROM citations_v GROUP BY 1),
t AS (SELECT c.ord, c.year, trim(c.doi) = '' AS bare, c.ord % 3 = 0 AS smith, (({_REAL.format("c.title")})::INT + (c.ord % 3 = 0)::INT + ({_REAL.format("c.journal")})::INT) / 4::DOUBLE AS complete, list_distinct({_X}) AS x, list_distinct({_Y}) AS y FROM citations_v c JOIN r USING (ord)),
u AS (SELECT *, CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE END AS alike FROM t),
v AS (SELECT ord, bare, CASE WHEN bare THEN complete * 0.5::DOUBLE ELSE 0.45::DOUBLE * alike + 0.30::DOUBLE * smith::INT + 0.15::DOUBLE * (year >= 2018)::INT + 0.10::DOUBLE * complete END AS score FROM u)
SELECT ord, round(score, 6)::DOUBLE AS score, round(score, 9) >= CASE WHEN bare THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END AS verified FROM v""",
    "page_verdicts": f"""WITH f AS (SELECT *, CASE k % 5 WHEN 0 THEN '' WHEN 1 THEN line WHEN 2 THEN 'Gut 2010' ELSE 'Smith and Finn' END AS page FROM ({_FIRSTS})),
g AS (SELECT page, 2 * (journal <> '' AND contains(lower(page), lower(journal)))::INT + (year <> '' AND contains(page, year))::INT + (len(list_filter(authors, lambda a: contains(lower(page), lower(a)))) > 0)::INT AS score FROM f)
SELECT CASE WHEN trim(page) = '' THEN 'no_text' WHEN score >= 3 THEN 'ok' WHEN score >= 1 THEN 'suspicious' ELSE 'mismatch' END AS verdict, CAST(score AS INT) AS score, count(*) AS n FROM g GROUP BY 1, 2""",
    "token_bucket": """WITH RECURSIVE o AS (SELECT job, row_number() OVER (PARTITION BY job ORDER BY ts, event_id) AS i, epoch(ts) AS secs FROM outcomes_v),
r AS (SELECT job, i, secs, 0.0::DOUBLE AS t, 1 AS n_now, 0 AS n_waited FROM o WHERE i = 1
  UNION ALL SELECT job, i, secs, CASE WHEN t >= 1 THEN t - 1 ELSE t END, n_now + (t >= 1)::INT, n_waited + (t < 1)::INT FROM (SELECT o.job, o.i, o.secs, least(1.0::DOUBLE, r.t + greatest(0.0::DOUBLE, o.secs - r.secs) * 0.001::DOUBLE) AS t, n_now, n_waited FROM r JOIN o ON o.job = r.job AND o.i = r.i + 1))
SELECT job, CAST(arg_max(n_now, i) AS BIGINT) AS n_now, CAST(arg_max(n_waited, i) AS BIGINT) AS n_waited FROM r GROUP BY 1""",
    "nearest_pairs": """WITH RECURSIVE a AS (SELECT l_orderkey AS page, list({'y': l_quantity, 'name': 'n' || l_linenumber} ORDER BY l_quantity, 'n' || l_linenumber) AS a FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1),
v AS (SELECT l_orderkey AS page, l_quantity AS y, l_extendedprice AS value, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice) AS i FROM lineitem WHERE l_linenumber % 2 = 0),
b AS (SELECT page, list({'y': y, 'i': i, 'value': value}) AS b FROM v GROUP BY 1),
r AS (SELECT page, 0 AS n, []::BIGINT[] AS used, NULL::VARCHAR AS name, NULL::DOUBLE AS value, NULL::DOUBLE AS dist FROM a JOIN b USING (page)
  UNION ALL SELECT page, n, CASE WHEN best IS NULL THEN used ELSE list_append(used, best.i) END, CASE WHEN best IS NOT NULL THEN name END, best.value, best.d
  FROM (SELECT page, r.n + 1 AS n, r.used, a.a[r.n + 1].name AS name, list_sort(list_transform(list_filter(b.b, lambda x: abs(x.y - a.a[r.n + 1].y) < 3 AND NOT list_contains(r.used, x.i)), lambda x: {'d': abs(x.y - a.a[r.n + 1].y)::DOUBLE, 'i': x.i, 'value': x.value::DOUBLE}))[1] AS best FROM r JOIN a USING (page) JOIN b USING (page) WHERE r.n < len(a.a)))
SELECT page, name, value, dist FROM r WHERE name IS NOT NULL""",
    "located": r"""WITH c AS (SELECT ord, title, list_filter(range(1, length(title) + 1), lambda i: substring(title, i, 1) <> ' ') AS pos, replace(title, ' ', '') AS folded, replace(left(title, 8), ' ', '') AS q FROM citations_v WHERE length(title) >= 8),
f AS (SELECT ord, pos, CASE WHEN q = '' THEN [] ELSE list_filter(range(1, length(folded) - length(q) + 2), lambda i: substring(folded, i, length(q)) = q) END AS found FROM c)
SELECT ord, CAST(len(found) AS INT) AS n, CAST(pos[found[1]] - 1 AS INT) AS start FROM f""",
    "numbered_segments": r"""WITH p AS (SELECT page, CAST(floor(k / 4000) AS BIGINT) AS part, replace(string_agg(line, ' ' ORDER BY k, line), '  ', ' ') AS t FROM cite_lines_v WHERE k % 3 = 0 GROUP BY 1, 2),
q AS (SELECT page, part, t, list_filter(list_transform(string_split(regexp_replace(t, '(^|[^0-9])([1-9][0-9]?\s*[.)]\s*[A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: regexp_matches(x, '^[1-9][0-9]?\s*[.)]\s*[A-Z]') AND strlen(x) >= 20) AS parts FROM p),
s AS (SELECT page, part, unnest(CASE WHEN len(parts) >= 2 THEN parts ELSE [t] END) AS x FROM q) SELECT page, part, count(*) AS n, CAST(sum(length(x)) AS BIGINT) AS chars FROM s GROUP BY 1, 2""",
    "citation_windows": f"""WITH t AS (SELECT slide, trim(regexp_replace(string_agg(line, '  ' ORDER BY k, line), '\\s+', ' ', 'g')) AS t FROM (SELECT CAST(floor(k / 40) AS BIGINT) AS slide, k, line FROM cite_lines_v) GROUP BY 1),
f AS (SELECT slide, t, regexp_extract_all(t, '{_B(T.JOURNAL)}') AS found, regexp_split_to_array(t, '{_B(T.JOURNAL)}') AS gaps FROM t),
b AS (SELECT slide, t, found, list_transform(range(1, len(found) + 1), lambda i: {{'m': found[i], 'at': coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0)::BIGINT + CASE WHEN i = 1 THEN 0 ELSE coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0)::BIGINT END}}) AS spots FROM f),
w AS (SELECT slide, list_transform(spots, lambda x: substring(t, greatest(x.at - {X.REACH}, 0) + 1, x.at - greatest(x.at - {X.REACH}, 0) + length(x.m) + {X.REACH})) AS w FROM b),
g AS (SELECT slide, list_filter(w, lambda x: regexp_matches(x, '{_B(T.YEAR)}')::INT + regexp_matches(x, '{X.NAMED}')::INT + regexp_matches(x, '{X.VOLUME}')::INT + regexp_matches(x, '{X.DOI}')::INT >= 2 AND strlen(x) >= 10) AS w FROM w),
k AS (SELECT slide, w, list_transform(w, lambda x: lower(regexp_replace(x, '\\s+', '', 'g'))) AS keys FROM g),
u AS (SELECT slide, list_filter(w, lambda x, i: list_position(keys, keys[i]) = i) AS w FROM k)
SELECT slide, CAST(len(w) AS INT) AS n, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS INT) AS chars FROM u""",
    "keyword_terms": f"""WITH f AS (SELECT k, line, line || ' 肝癌 生存 肝癌 发表' AS t FROM cite_lines_v),
i AS (SELECT k, unnest(list_concat([{{'t': '肝癌', 'c': 0.6::DOUBLE, 'k': 'cn_term'}}, {{'t': '生存', 'c': 0.4::DOUBLE, 'k': 'cn_term'}}, {{'t': '发表', 'c': 0.4::DOUBLE, 'k': 'cn_term'}}],
  list_filter([{", ".join(f"CASE WHEN contains(t, '{w}') THEN {{'t': '{w}', 'c': {c}::DOUBLE, 'k': '{kind}'}} END" for words, c, kind in ((KNOWN, 0.85, "drug_or_trial"), (JOURNALS, 0.5, "journal")) for w in words)}], lambda x: x IS NOT NULL),
  list_transform(list_distinct(regexp_extract_all(t, '{_B(T.YEAR)}')), lambda y: {{'t': y, 'c': 0.4::DOUBLE, 'k': 'year'}}),
  list_transform(list_distinct(regexp_extract_all(t, '(\\d+\\.?\\d*)\\s*%', 1)), lambda y: {{'t': y || '%', 'c': 0.9::DOUBLE, 'k': 'percentage'}}),
  CASE WHEN regexp_extract(line, '^\\s*([A-Z][a-zA-Z\\-]+)', 1) <> '' THEN [{{'t': regexp_extract(line, '^\\s*([A-Z][a-zA-Z\\-]+)', 1), 'c': 0.3::DOUBLE, 'k': 'author_surname'}}] ELSE [] END)) AS x FROM f)
SELECT x.k AS kind, x.c AS confidence, count(*) AS n, count(DISTINCT x.t) AS terms FROM i GROUP BY 1, 2""",
    "dedupe_full": f"""WITH RECURSIVE {_HASH},
k AS (SELECT *, CASE WHEN pmid <> '' THEN 'pmid:' || pmid WHEN doi <> '' THEN 'doi:' || lower(trim(doi)) ELSE '' END AS key, h FROM citations_v LEFT JOIN fp USING (ord)),
firsts AS (SELECT key, arg_min_null(h, ord) AS h FROM k WHERE key <> '' GROUP BY 1),
cls AS (SELECT h, min(ord) AS first FROM k WHERE key = '' GROUP BY 1),
joined AS (SELECT c.h, min(f.key) AS goes FROM cls c JOIN firsts f ON bit_count(xor(c.h, f.h)) <= 2 GROUP BY 1),
rest AS (SELECT h, row_number() OVER (ORDER BY first) AS i FROM cls WHERE h IS NOT NULL AND h NOT IN (SELECT h FROM joined)),
led AS (SELECT 0::BIGINT AS i, []::UBIGINT[] AS leaders, NULL::UBIGINT AS h, NULL::UBIGINT AS leader
  UNION ALL SELECT i, CASE WHEN leader IS NULL THEN list_append(leaders, h) ELSE leaders END, h, coalesce(leader, h) FROM (SELECT r.i, l.leaders, r.h, list_filter(l.leaders, lambda x: bit_count(xor(x, r.h)) <= 2)[1] AS leader FROM led l JOIN rest r ON r.i = l.i + 1)),
placed AS (SELECT k.*, coalesce(nullif(key, ''), j.goes, 'hash:' || coalesce(CAST(led.leader AS VARCHAR), '')) AS grp FROM k LEFT JOIN joined j ON j.h = k.h LEFT JOIN led ON led.h = k.h),
n AS (SELECT grp, count(*) AS n_merged, string_agg(DISTINCT origin, ',' ORDER BY origin) AS origins, count(DISTINCT origin) AS n_origins FROM placed GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY cited_by + 10 * fwci + 5 DESC, ord) AS r FROM placed)
SELECT id, origins, n_merged, round(cited_by + 10 * fwci + 5 * n_origins, 6) AS richness FROM b JOIN n USING (grp) WHERE r = 1""",
}
ORACLES = {k: with_views(v) for k, v in _ORACLES.items()}
