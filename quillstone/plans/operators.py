"""Queries over fusion, similarity, evidence, rules, reconciliation, graphs and state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as T
from ..operators import evidence as E
from ..operators import fusion as U
from ..operators import graph as G
from ..operators import reconcile as R
from ..operators import rules as L
from ..operators import similarity as M
from ..operators import state as S
from ..operators import vector_index as VI
from ..sources.views import view, with_views

YEAR = 2026  #: the year as of which recency is judged
SOURCES = ["pubmed", "openalex", "s2", "scholar", "registry"]


def _citations(spark, sf):
    return view(spark, sf, "citations_v", whole=True).withColumn("source_origin", F.array("origin"))


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Fusion.


def fuse_citations(spark, sf):
    """Copies fused by identifier, then graded for each conversation."""
    g = U.grade(U.fuse_citations(_citations(spark, sf)), YEAR)
    return g.select("conv_id", "n_citations", "n_sources", F.round("rct_ratio", 9).alias("rct_ratio"), "recent", "score", "grade")


def dedupe_ids(spark, sf):
    x = U.fuse_citations(_citations(spark, sf))
    return x.select("group_key", "id", F.array_join("source_origin", ",").alias("origins"), "n_merged", F.round("richness", 6).alias("richness"))


def dedupe_full(spark, sf):
    x = U.fuse_citations_by_title(_citations(spark, sf))
    return x.select("id", F.array_join("source_origin", ",").alias("origins"), "n_merged", F.round("richness", 6).alias("richness"))


def fusion_score(spark, sf):
    x = U.fusion_score(_citations(spark, sf), YEAR)
    return x.select("id", F.round("fusion_score", 6).alias("score"))


def source_counts(spark, sf):
    return U.source_counts(_citations(spark, sf), SOURCES)


def votes(spark, sf):
    return U.consensus(view(spark, sf, "votes_v")).select("question", "answer", F.round("agreement", 6).alias("agreement"))


def vote_candidates(spark, sf):
    return U.vote_candidates(view(spark, sf, "votes_v")).select("question", "answer", "n", F.round("confidence", 6).alias("confidence"), "rank")


def hash_dups(spark, sf):
    return U.duplicate_groups(view(spark, sf, "right_tab"))


def merge_groups(spark, sf):
    return U.merge_groups(view(spark, sf, "right_tab"), "digest").select("digest", "n", "merged")


def insights(spark, sf):
    return U.insights(_citations(spark, sf))


# Similarity.


def simhash64(spark, sf):
    c = view(spark, sf, "citations_v")
    return c.select("ord", F.lpad(F.hex(M.simhash(F.col("title"))), 16, "0").alias("hash"))


def hamming_near(spark, sf):
    """For each fingerprint of a title, how many others differ in fewer than three bits."""
    h = view(spark, sf, "citations_v").select(M.simhash(F.col("title")).alias("h")).where("h IS NOT NULL").groupBy("h").agg(F.count("*").alias("n"))
    near = M.near_hashes(h.select(F.col("h").alias("a")), h.select(F.col("h").alias("b"))).where("a <> b").groupBy(F.col("a").alias("h")).agg(F.count("*").alias("near"))
    return h.join(near, "h", "left").select(F.lpad(F.hex("h"), 16, "0").alias("hash"), "n", F.coalesce("near", F.lit(0)).cast("long").alias("near"))


def knn_cosine(spark, sf):
    v = view(spark, sf, "vectors_v")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    return M.nearest(v, q, 5).select("query", "id", F.round("score", 6).alias("score"), "rank")


def knn_indexed(spark, sf):
    """Neighbours through the index: a few lists first, then those that may hold a better vector."""
    v = view(spark, sf, "vectors_v")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    return VI.search(VI.build(v), q, 5, exact=True).select("query", "id", F.round("score", 6).alias("score"), "rank")


def knn_euclid(spark, sf):
    v = view(spark, sf, "vectors_v")
    q = v.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    return M.nearest(v, q, 5, "euclid").select("query", "id", F.round(-F.col("score"), 4).alias("dist"), "rank")


def unit_vectors(spark, sf):
    v = view(spark, sf, "vectors_v")
    return v.select("id", F.round(M.norm(F.col("vec")), 6).alias("norm"), F.round(M.norm(M.unit(F.col("vec"))), 6).alias("unit"), F.round(M.unit(F.col("vec"))[0], 6).alias("first"), F.round(M.cosine(F.col("vec"), F.reverse("vec")), 6).alias("mirror"))


def vector_upsert(spark, sf):
    """The vector store after every label's vectors were written under one key: the last stays."""
    v = view(spark, sf, "vectors_v").select(F.col("label").alias("key"), F.col("id").alias("at"), F.round(F.col("vec")[0].cast("double"), 6).alias("first"))
    return M.last_wins(v, "key", "at")


# Evidence.


def set_conclusion(spark, sf):
    t = view(spark, sf, "table_rows_v")
    subject = t.groupBy("grp").agg((F.min("value") * 1.02).alias("subject"))
    return E.set_conclusion(t.join(subject, "grp"), "grp").select("grp", "n_high", "n_low", F.round("score", 6).alias("score"))


def claim_scores(spark, sf):
    t = view(spark, sf, "table_rows_v")
    ev = t.select("grp", E.words_score(F.col("disease"), F.lit("TIN"), ()).alias("geography"), E.words_score(F.col("disease"), F.lit("steel"), ()).alias("disease"), E.words_score(F.col("grp"), F.lit("Brand#1"), ()).alias("indicator"), E.value_score(F.col("value"), F.lit(1000.0)).alias("value"))
    return E.claim_scores(ev, "grp").select("grp", "geography", "disease", "indicator", "value", F.round("score", 6).alias("score"), "highlight")


def authenticity(spark, sf):
    c = view(spark, sf, "citations_v")
    ref = c.select((F.col("ord") + F.col("ord") % 2).alias("ord"), F.col("title").alias("ref_title"))
    x = c.join(ref.groupBy("ord").agg(F.min("ref_title").alias("ref_title")), "ord")
    a = E.authenticity(F.col("title"), F.when(F.col("ord") % 3 == 0, F.lit("John Smith")).otherwise(F.lit("unknown")), F.lit("n/a"), F.col("journal"), F.make_date(F.col("year"), F.lit(6), F.lit(1)), ids.canonical_id(F.col("doi")), F.col("ref_title"), F.array(F.lit("Smith"), F.lit("Lee")), F.make_date(F.lit(2018), F.lit(1), F.lit(1)))
    return x.withColumn("a", a).select("ord", F.round("a.score", 6).alias("score"), F.col("a.verified").alias("verified"))


def paper_match(spark, sf):
    r = view(spark, sf, "cite_lines_v").withColumn("f", T.key_fields(F.col("line")))
    surname = F.coalesce(F.get("f.authors", F.lit(0)), F.lit(""))
    e = F.struct(surname.alias("surname"), F.col("f.journal").alias("journal"), F.col("f.year").alias("year"), F.col("f.doi_tail").alias("doi"))
    k = F.col("k")
    a = F.struct(F.when(k % 7 == 1, F.lit("Abou")).when(k % 11 == 0, F.lit("")).otherwise(surname).alias("surname"), F.when(k % 13 == 0, F.lit("Cell")).otherwise(F.col("f.journal")).alias("journal"), F.when(k % 5 == 0, F.lit("")).otherwise(F.col("f.year")).alias("year"), F.col("f.doi_tail").alias("doi"))
    return r.withColumn("m", E.paper_match(e, a)).select("k", F.col("m.score").alias("score"), F.col("m.ok").alias("ok"))


def coalesce_sources(spark, sf):
    a = view(spark, sf, "left_tab").select("pnx", F.col("context").alias("value"))
    b = view(spark, sf, "right_tab").select("pnx", F.col("context").alias("value"))
    return E.combine(a, b, "pnx")


def enrich_citations(spark, sf):
    c = _citations(spark, sf).withColumn("cited_by", F.when(F.col("ord") % 4 == 0, 0).otherwise(F.col("cited_by")))
    ref = view(spark, sf, "citations_v").where("ord % 2 = 0").select("pmid", "doi", (F.col("cited_by") + 1).alias("cited_by"), "fwci")
    x = E.enrich(c, ref, ("cited_by", "fwci"))
    return x.select("ord", "cited_by", F.round("fwci", 6).alias("fwci"), F.array_join("log", ",").alias("log"))


def verify_cascade(spark, sf):
    c = view(spark, sf, "citations_v").select("ord", "pmid", "doi", F.substring("title", 1, 12).alias("head"))
    ref = view(spark, sf, "citations_v")
    refs = [("pmid", ref.where("ord % 4 = 0").select("pmid", "title"), "pmid"), ("doi", ref.where("ord % 8 < 3").select("doi", "title"), "doi"), ("search", ref.where("ord % 5 = 0").select(F.substring("title", 1, 12).alias("head"), "title"), "head")]
    return E.verify_cascade(c, refs).select("ord", "method", "found_title")


def point_alignment(spark, sf):
    m = view(spark, sf, "marks_v")
    points = m.select("k", F.col("value").alias("point"))
    texts = m.groupBy("k").agg(F.array_join(F.array_sort(F.collect_list("context")), " ").alias("text"))
    return E.alignment(points, texts, "k").select("k", "n", "found", F.round("ratio", 6).alias("ratio"))


# Rules.


def _findings(spark, sf):
    x = view(spark, sf, "sections_v", whole=True)
    return L.scan(x, ("conv_id", "turn"), F.concat("title", F.lit("\n"), "body"), F.col("audience"), F.col("rx_status"))


def rule_scan(spark, sf):
    return _findings(spark, sf).groupBy("conv_id", "turn", "rule", "severity", "matched").agg(F.count("*").alias("n"))


def presence_rules(spark, sf):
    return L.missing(view(spark, sf, "sections_v", whole=True), "conv_id", F.col("body"), F.col("audience"))


def rule_verdicts(spark, sf):
    x = view(spark, sf, "sections_v", whole=True)
    every = _findings(spark, sf).select("conv_id", "severity").unionByName(L.missing(x, "conv_id", F.col("body"), F.col("audience")).select("conv_id", "severity"))
    return L.verdicts(every, x, "conv_id")


def rule_notes(spark, sf):
    return L.annotations(_findings(spark, sf), ("conv_id", "turn"))


def intents(spark, sf):
    c = view(spark, sf, "commands_v").withColumn("i", L.intent(F.col("text")))
    return c.groupBy(F.col("i.intent").alias("intent"), F.round("i.score", 6).alias("score"), F.col("i.unsure").alias("unsure")).agg(F.count("*").alias("n"))


# Reconciliation.


def row_diff(spark, sf):
    return R.row_diff(view(spark, sf, "left_tab"), view(spark, sf, "right_tab"), "pnx", ("context", "kind", "size"))


def three_way(spark, sf):
    a, b = view(spark, sf, "left_tab"), view(spark, sf, "right_tab")
    return R.alignment(a, b, b.where("row_n % 4 <> 0"), "pnx")


def resume(spark, sf):
    c = view(spark, sf, "citations_v").select("ord", "doi")
    return R.pending(c, c.where("ord % 3 = 1 AND ord % 4 = 0"), "doi")


def set_relations(spark, sf):
    return R.set_relations(view(spark, sf, "left_tab"), view(spark, sf, "right_tab"), "pnx")


def neighbours(spark, sf):
    return R.neighbours(view(spark, sf, "left_tab").select("context", "row_n"), "context", "row_n", 40)


def reconcile(spark, sf):
    x = R.reconcile(view(spark, sf, "left_tab").select("pnx", F.substring("body", 1, 80).alias("body")), view(spark, sf, "right_tab").select("pnx", "body"), "pnx", "body")
    return x.select("pnx", "action", F.length("body").alias("chars"))


def context_lines(spark, sf):
    x = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", (F.col("l_quantity") * 10).alias("y"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("line"))
    return R.context_lines(x.where("l_linenumber = 1").select("page", F.lit(1).alias("table"), "y"), x.where("l_linenumber > 1"))


def nearest_pairs(spark, sf):
    x = _table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("page"), "l_linenumber", F.col("l_quantity").alias("y"), "l_extendedprice")
    names = x.where("l_linenumber % 2 = 1").select("page", F.concat(F.lit("n"), F.col("l_linenumber").cast("string")).alias("name"), "y")
    return R.nearest_pairs(names, x.where("l_linenumber % 2 = 0").select("page", F.col("l_extendedprice").alias("value"), "y"))


def inventory(spark, sf):
    b = view(spark, sf, "right_tab")
    return R.inventory(b.select("pnx", "digest"), view(spark, sf, "left_tab").select("pnx", "context"), b.where("row_n % 4 <> 0"))


# Graphs.


def pagerank(spark, sf):
    return G.pagerank(view(spark, sf, "edges_v"), iterations=4, tolerance=0).select("id", F.round("score", 9).alias("score"))


def pagerank_converged(spark, sf):
    return G.pagerank(view(spark, sf, "edges_v")).select("id", F.round("score", 6).alias("score"))


def graph_stats(spark, sf):
    return G.graph_stats(view(spark, sf, "edges_v"))


def chain_ends(spark, sf):
    o = _table(spark, sf, "orders").where("o_orderkey % 16 <> 0").select(F.col("o_orderkey").alias("old"), (F.col("o_orderkey") + 1).alias("new"))
    return G.chain_ends(o)


def outline(spark, sf):
    return G.outline(view(spark, sf, "sections_v").select("conv_id", "id", "parent", "turn"), "conv_id")


def last_sections(spark, sf):
    return G.last_sections(outline(spark, sf), "conv_id", "depth")


def outline_text(spark, sf):
    x = view(spark, sf, "sections_v")
    return G.full_text(x, G.outline(x.select("conv_id", "id", "parent", "turn"), "conv_id"), "conv_id")


# State.


def success_rates(spark, sf):
    return S.success_rates(view(spark, sf, "outcomes_v")).select("job", "alpha", "beta", F.round("expected", 6).alias("expected"), "run")


def health(spark, sf):
    return S.health(view(spark, sf, "outcomes_v")).withColumn("score", F.round("score", 6))


def request_rate(spark, sf):
    return S.request_rate(view(spark, sf, "outcomes_v"))


def token_bucket(spark, sf):
    return S.token_bucket(view(spark, sf, "outcomes_v"))


def lru_survivors(spark, sf):
    return S.survivors(view(spark, sf, "outcomes_v"), "job", ["ts", "event_id"], 50).select("job", "last_event_id")


def run_intervals(spark, sf):
    return S.intervals(_table(spark, sf, "events"), "event_type")


def last_status(spark, sf):
    return S.last_state(view(spark, sf, "outcomes_v"), "job", ["ts", "event_id"], ["ok", "status", "event_id"])


def window_counts(spark, sf):
    return S.windows(_table(spark, sf, "events"), "1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


def session_counts(spark, sf):
    return S.sessions(_table(spark, sf, "events"), 720).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")).select("user_id", "start", "n")


QUERIES = {
    f.__name__: f
    for f in (
        fuse_citations, dedupe_ids, dedupe_full, fusion_score, source_counts, votes, vote_candidates, hash_dups, merge_groups, insights,
        simhash64, hamming_near, knn_cosine, knn_indexed, knn_euclid, unit_vectors, vector_upsert,
        set_conclusion, claim_scores, authenticity, paper_match, coalesce_sources, enrich_citations, verify_cascade, point_alignment,
        rule_scan, presence_rules, rule_verdicts, rule_notes, intents,
        row_diff, three_way, resume, set_relations, neighbours, reconcile, context_lines, nearest_pairs, inventory,
        pagerank, pagerank_converged, graph_stats, chain_ends, outline, last_sections, outline_text,
        success_rates, health, request_rate, token_bucket, lru_survivors, run_intervals, last_status, window_counts, session_counts,
    )
}

_FUSED = """k AS (SELECT *, CASE WHEN pmid <> '' THEN 'pmid:' || pmid WHEN doi <> '' THEN 'doi:' || lower(trim(doi)) ELSE 'ord:' || ord END AS group_key, cited_by + 10 * fwci + 5 AS rich FROM citations_v),
 f AS (SELECT *, count(*) OVER (PARTITION BY group_key) AS n_merged, row_number() OVER (PARTITION BY group_key ORDER BY rich DESC, ord) AS rn FROM k),
 o AS (SELECT group_key, string_agg(origin, ',' ORDER BY origin) AS origins, count(*) AS n_origins FROM (SELECT DISTINCT group_key, origin FROM k) GROUP BY 1)"""
_HASH = """toks AS (SELECT ord, unnest(list_filter(regexp_split_to_array(lower(trim(title)), '[ \\t\\n\\r.,;:!?]+'), lambda w: w <> '')) AS w FROM citations_v),
 hs AS (SELECT ord, CAST('0x' || left(sha1(w), 16) AS UBIGINT) AS h FROM toks),
 bits AS (SELECT ord, i, sum(CASE WHEN (h >> CAST(i AS UBIGINT)) & 1 = 1 THEN 1 ELSE -1 END) AS c FROM hs, range(64) r(i) GROUP BY 1, 2),
 fp AS (SELECT ord, CAST(sum(CASE WHEN c > 0 THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE 0 END) AS UBIGINT) AS h FROM bits GROUP BY 1)"""
_VEC = "q AS (SELECT id AS query, CAST(vec AS DOUBLE[]) AS qv FROM vectors_v WHERE id % 50 = 0), v AS (SELECT id, CAST(vec AS DOUBLE[]) AS vec FROM vectors_v)"
_RULES = " UNION ALL ".join(f"SELECT '{r.name}' AS rule, '{r.severity}' AS severity, '{p}' AS p, {str(r.rx_only).lower()} AS rx, {str(r.patient_only).lower()} AS pat" for r in L.RULES if not r.presence for p in r.patterns)
_FIND = f"""rules AS ({_RULES}), hits AS (SELECT conv_id, turn, rule, severity, unnest(regexp_extract_all(t, p)) AS matched, t FROM (SELECT *, title || chr(10) || body AS t FROM sections_v), rules WHERE (NOT rx OR rx_status = 'rx') AND (NOT pat OR audience = 'patient')),
 fnd AS (SELECT * FROM hits WHERE NOT regexp_matches(matched, '{L.NEGATION}') AND NOT regexp_matches(t, '({L.NEGATION})(?s:.){{0,14}}' || matched))"""
_MISS = f"mis AS (SELECT conv_id FROM sections_v WHERE audience = 'patient' GROUP BY 1 HAVING NOT bool_or(regexp_matches(body, '{L.RULES[10].patterns[0]}')))"
_INTENTS = ", ".join(f"CASE WHEN regexp_matches(t, '{p}') THEN {{'score': round(least({pr} / 100.0 * {w} + CASE WHEN strlen(t) <= 10 AND regexp_extract(t, '{p}') = t THEN 0.2 ELSE 0 END, 1.0), 9)::DOUBLE, 'place': {-i}, 'intent': '{n}'}} END" for i, (p, n, pr, w) in enumerate((p.replace("'", "''"), n, pr, w) for p, n, pr, w in L.INTENTS))
_PR = "nodes AS (SELECT src AS id FROM edges_v UNION SELECT dst FROM edges_v), n AS (SELECT count(*) AS n FROM nodes), d AS (SELECT src, count(*) AS deg FROM edges_v GROUP BY 1), l AS (SELECT DISTINCT e.src, dst, deg FROM edges_v e JOIN d USING (src)), s0 AS (SELECT id, 0.0::DOUBLE AS score FROM nodes)" + "".join(
    f", s{i} AS (SELECT nodes.id, 0.15::DOUBLE / n.n + 0.85::DOUBLE * coalesce(g, 0) AS score FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(score / deg) AS g FROM l JOIN s{i - 1} ON src = id GROUP BY 1) ON dst = nodes.id)" for i in range(1, 5)
)
_DIS = "CASE WHEN contains(lower({0}), lower('{1}')) THEN 1.0 ELSE 0.0 END"
_OUT = "s AS (SELECT conv_id, id, parent, turn, row_number() OVER (PARTITION BY conv_id, parent ORDER BY turn, id) AS n FROM sections_v), w AS (SELECT conv_id, id, 1 AS depth, CAST(n AS VARCHAR) AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.conv_id, s.id, depth + 1, path || '.' || s.n FROM s JOIN w ON s.conv_id = w.conv_id AND s.parent = w.id)"
_EVENTS = "(SELECT job, list(struct_pack(ok := ok, lat := latency, st := status, q := quota) ORDER BY ts, event_id) AS es FROM outcomes_v GROUP BY 1)"

ORACLES = {
    "fuse_citations": f"""WITH {_FUSED}, g AS (SELECT conv_id, count(*) AS n_citations, avg(CASE WHEN regexp_matches(lower(concat_ws(' ', title, abstract, journal)), '{"|".join(T.TRIAL_WORDS)}') THEN 1.0 ELSE 0 END) AS r, bool_or(year > 0 AND {YEAR} - year <= 3) AS recent FROM f WHERE rn = 1 GROUP BY 1),
      ns AS (SELECT conv_id, count(DISTINCT x) AS n_sources FROM (SELECT conv_id, unnest(string_split(origins, ',')) AS x FROM f JOIN o USING (group_key) WHERE rn = 1) GROUP BY 1),
      z AS (SELECT *, CASE WHEN n_citations >= 5 THEN 2 ELSE 1 END + CASE WHEN n_sources >= 3 THEN 2 WHEN n_sources = 2 THEN 1 ELSE 0 END + CASE WHEN r >= 0.5 THEN 2 WHEN r >= 0.25 THEN 1 ELSE 0 END + CAST(recent AS INT) AS score FROM g JOIN ns USING (conv_id))
      SELECT conv_id, n_citations, n_sources, round(r, 9) AS rct_ratio, recent, CAST(score AS INT) AS score, CASE WHEN score >= 6 THEN 'A' WHEN score >= 4 THEN 'B' WHEN score >= 2 THEN 'C' ELSE 'D' END AS grade FROM z""",
    "dedupe_ids": f"WITH {_FUSED} SELECT group_key, id, origins, n_merged, round(cited_by + 10 * fwci + 5 * n_origins, 6) AS richness FROM f JOIN o USING (group_key) WHERE rn = 1",
    "fusion_score": f"SELECT id, round(0.3 * cited_by / (SELECT max(cited_by) FROM citations_v) + 0.2 * greatest(0, 1 - ({YEAR} - year) / 20.0) + 0.3 * fwci / (SELECT max(fwci) FROM citations_v) + 0.2, 6)::DOUBLE AS score FROM citations_v",
    "source_counts": "SELECT s.origin, count(c.id) AS n FROM (SELECT unnest(['pubmed', 'openalex', 's2', 'scholar', 'registry']) AS origin) s LEFT JOIN citations_v c USING (origin) GROUP BY 1",
    "votes": "SELECT question, answer, round(n / t, 6)::DOUBLE AS agreement FROM (SELECT question, answer, count(*) AS n, sum(count(*)) OVER (PARTITION BY question) AS t, row_number() OVER (PARTITION BY question ORDER BY count(*) DESC, round(avg(confidence), 9) DESC, answer) AS r FROM votes_v GROUP BY 1, 2) WHERE r = 1",
    "vote_candidates": "SELECT question, answer, count(*) AS n, round(avg(confidence), 6) AS confidence, CAST(row_number() OVER (PARTITION BY question ORDER BY count(*) DESC, round(avg(confidence), 9) DESC, answer) AS INT) AS rank FROM votes_v GROUP BY 1, 2",
    "hash_dups": "SELECT digest, count(DISTINCT pnx) AS n, arg_min(pnx, [lpad(regexp_extract(pnx, '^P(\\d+)-', 1), 9, '0'), pnx]) AS keep, min(pnx) AS first, max(pnx) AS last FROM right_tab GROUP BY 1 HAVING count(DISTINCT pnx) > 1",
    "merge_groups": "SELECT digest, count(DISTINCT pnx) AS n, string_agg(DISTINCT pnx, '-' ORDER BY pnx) AS merged FROM right_tab GROUP BY 1 HAVING count(DISTINCT pnx) > 1",
    "insights": "SELECT conv_id, 'I' || r AS insight, '关键证据: ' || left(title, 80) AS claim, id AS item FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY cited_by DESC, ord) AS r FROM citations_v) WHERE r <= 4",
    "simhash64": f"WITH {_HASH} SELECT c.ord, lpad(upper(printf('%x', h)), 16, '0') AS hash FROM citations_v c LEFT JOIN fp USING (ord)",
    "hamming_near": f"WITH {_HASH}, d AS (SELECT h, count(*) AS n FROM fp GROUP BY 1) SELECT lpad(upper(printf('%x', a.h)), 16, '0') AS hash, a.n, count(b.h) AS near FROM d a LEFT JOIN d b ON a.h <> b.h AND bit_count(xor(a.h, b.h)) <= 2 GROUP BY a.h, a.n",
    "knn_cosine": f"WITH {_VEC}, s AS (SELECT query, id, list_cosine_similarity(qv, vec) AS score, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(qv, vec) DESC, id) AS r FROM q, v) SELECT query, id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM s WHERE r <= 5",
    "knn_indexed": f"WITH {_VEC}, s AS (SELECT query, id, list_cosine_similarity(qv, vec) AS score, row_number() OVER (PARTITION BY query ORDER BY round(list_cosine_similarity(qv, vec), 12) DESC, id) AS r FROM q, v) SELECT query, id, round(score, 6) AS score, CAST(r AS INT) AS rank FROM s WHERE r <= 5",
    "knn_euclid": f"WITH {_VEC}, s AS (SELECT query, id, list_distance(qv, vec) AS d, row_number() OVER (PARTITION BY query ORDER BY list_distance(qv, vec), id) AS r FROM q, v) SELECT query, id, round(d, 4) AS dist, CAST(r AS INT) AS rank FROM s WHERE r <= 5",
    "unit_vectors": "SELECT id, round(n, 6) AS norm, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS unit, round(x[1] / n, 6) AS first, round(list_cosine_similarity(x, list_reverse(x)), 6) AS mirror FROM (SELECT id, CAST(vec AS DOUBLE[]) AS x, sqrt(list_dot_product(CAST(vec AS DOUBLE[]), CAST(vec AS DOUBLE[]))) AS n FROM vectors_v)",
    "vector_upsert": "SELECT label AS key, max(id) AS at, round(CAST(arg_max(vec[1], id) AS DOUBLE), 6) AS first FROM vectors_v GROUP BY 1",
    "set_conclusion": """SELECT grp, h AS n_high, l AS n_low, round(CASE WHEN h + l = 0 THEN 0 WHEN l = 0 THEN 1 WHEN l = 1 AND h >= 20 THEN 0.95 WHEN l <= 3 AND h / CAST(h + l AS DOUBLE) >= 0.85 THEN 0.8 ELSE h / CAST(h + l AS DOUBLE) * 0.7 END, 6)::DOUBLE AS score
      FROM (SELECT grp, count(*) FILTER (value > m) AS h, count(*) FILTER (value < m) AS l FROM table_rows_v JOIN (SELECT grp, min(value) * 1.02::DOUBLE AS m FROM table_rows_v GROUP BY 1) USING (grp) GROUP BY 1)""",
    "claim_scores": f"""SELECT grp, geography, disease, indicator, value, round(0.2 * geography + 0.3 * disease + 0.2 * indicator + 0.2 * value, 6) AS score, round(0.2 * geography + 0.3 * disease + 0.2 * indicator + 0.2 * value, 9) >= 0.7 AS highlight FROM (SELECT grp, max({_DIS.format("disease", "TIN")})::DOUBLE AS geography,
      max({_DIS.format("disease", "steel")})::DOUBLE AS disease, max({_DIS.format("grp", "Brand#1")})::DOUBLE AS indicator, max(CASE WHEN value = 0 THEN 0 WHEN e < 0.05 THEN 1 WHEN e < 0.2 THEN 0.7 WHEN e < 0.5 THEN 0.3 ELSE 0 END)::DOUBLE AS value FROM (SELECT *, abs(value - 1000) / ((value + 1000) / 2) AS e FROM table_rows_v) GROUP BY 1)""",
    "coalesce_sources": "SELECT coalesce(l.pnx, r.pnx) AS pnx, coalesce(l.context, r.context) AS value FROM left_tab l FULL JOIN right_tab r ON l.pnx = r.pnx",
    "verify_cascade": """WITH p AS (SELECT pmid, min(title) AS t FROM citations_v WHERE ord % 4 = 0 AND pmid <> '' GROUP BY 1), d AS (SELECT doi, min(title) AS t FROM citations_v WHERE ord % 8 < 3 AND doi <> '' GROUP BY 1), h AS (SELECT left(title, 12) AS head, min(title) AS t FROM citations_v WHERE ord % 5 = 0 AND title <> '' GROUP BY 1)
      SELECT ord, CASE WHEN p.t IS NOT NULL THEN 'pmid' WHEN d.t IS NOT NULL THEN 'doi' WHEN h.t IS NOT NULL THEN 'search' ELSE 'not_found' END AS method, coalesce(p.t, d.t, h.t, '') AS found_title FROM citations_v c LEFT JOIN p ON p.pmid = c.pmid LEFT JOIN d ON d.doi = c.doi LEFT JOIN h ON h.head = left(title, 12)""",
    "enrich_citations": """WITH r AS (SELECT pmid, doi, cited_by + 1 AS cb, fwci AS fw FROM citations_v WHERE ord % 2 = 0), d AS (SELECT doi, max(struct_pack(cb := cb, fw := fw)) AS x FROM r WHERE doi <> '' GROUP BY 1), p AS (SELECT pmid, max(struct_pack(cb := cb, fw := fw)) AS x FROM r WHERE pmid <> '' GROUP BY 1),
      c AS (SELECT ord, CASE WHEN ord % 4 = 0 THEN 0 ELSE cited_by END AS cited_by, fwci, coalesce(d.x, p.x) AS x FROM citations_v c LEFT JOIN d ON d.doi = c.doi LEFT JOIN p ON p.pmid = c.pmid)
      SELECT ord, CASE WHEN x IS NOT NULL AND cited_by = 0 THEN x.cb ELSE cited_by END AS cited_by, round(CASE WHEN x IS NOT NULL AND fwci = 0 THEN x.fw ELSE fwci END, 6) AS fwci, concat_ws(',', CASE WHEN x IS NOT NULL AND cited_by = 0 THEN 'cited_by' END, CASE WHEN x IS NOT NULL AND fwci = 0 THEN 'fwci' END) AS log FROM c""",
    "rule_scan": f"WITH {_FIND} SELECT conv_id, turn, rule, severity, matched, count(*) AS n FROM fnd GROUP BY ALL",
    "presence_rules": f"WITH {_MISS} SELECT conv_id, 'PAT-DISCLAIMER' AS rule, 'info' AS severity, '' AS matched FROM mis",
    "rule_verdicts": f"WITH {_FIND}, {_MISS}, a AS (SELECT conv_id, severity FROM fnd UNION ALL SELECT conv_id, 'info' FROM mis), c AS (SELECT s.conv_id, count(*) FILTER (severity = 'fatal') AS fatal, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM (SELECT DISTINCT conv_id FROM sections_v) s LEFT JOIN a USING (conv_id) GROUP BY 1) SELECT *, CASE WHEN fatal > 0 THEN 'fail' WHEN warn > 0 THEN 'warn' ELSE 'pass' END AS verdict FROM c",
    "rule_notes": f"WITH {_FIND} SELECT conv_id, turn, string_agg(rule || '[' || severity || ']', ' ' ORDER BY CASE severity WHEN 'fatal' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, rule) AS note FROM fnd GROUP BY 1, 2",
    "intents": f"SELECT CASE WHEN t = '' THEN 'free_query' ELSE b.intent END AS intent, round(CASE WHEN t = '' THEN 0 ELSE b.score END, 6) AS score, CASE WHEN t = '' THEN true ELSE b.score < 0.65 END AS unsure, count(*) AS n FROM (SELECT t, list_max(list_filter([{_INTENTS}], lambda x: x IS NOT NULL)) AS b FROM (SELECT trim(text) AS t FROM commands_v)) GROUP BY ALL",
    "row_diff": """SELECT coalesce(l.pnx, r.pnx) AS pnx, CASE WHEN r.pnx IS NULL THEN 'left_only' WHEN l.pnx IS NULL THEN 'right_only' WHEN a <> '' THEN 'differs' ELSE 'same' END AS status, CASE WHEN l.pnx IS NULL OR r.pnx IS NULL THEN '' ELSE split_part(a, ',', 1) END AS first, CASE WHEN l.pnx IS NULL OR r.pnx IS NULL THEN '' ELSE a END AS all
      FROM left_tab l FULL JOIN right_tab r ON l.pnx = r.pnx, LATERAL (SELECT concat_ws(',', CASE WHEN trim(l.context) <> trim(r.context) THEN 'context' END, CASE WHEN trim(l.kind) <> trim(r.kind) THEN 'kind' END, CASE WHEN trim(l.size) <> trim(r.size) THEN 'size' END) AS a)""",
    "three_way": "WITH k AS (SELECT pnx, true AS a, false AS b, false AS c FROM left_tab UNION ALL SELECT pnx, false, true, row_n % 4 <> 0 FROM right_tab) SELECT pnx, bool_or(a) AS in_table, bool_or(b) AS in_downloads, bool_or(c) AS in_highlights, CASE WHEN NOT bool_or(a) THEN 'not_in_table' WHEN NOT bool_or(b) THEN 'not_downloaded' WHEN NOT bool_or(c) THEN 'not_highlighted' ELSE 'aligned' END AS issue FROM k GROUP BY 1",
    "resume": "SELECT ord, doi FROM citations_v WHERE doi NOT IN (SELECT doi FROM citations_v WHERE ord % 3 = 1 AND ord % 4 = 0 AND doi <> '')",
    "set_relations": "SELECT CASE WHEN l.pnx IS NULL THEN 'right_only' WHEN r.pnx IS NULL THEN 'left_only' ELSE 'both' END AS relation, count(*) AS n FROM (SELECT DISTINCT pnx FROM left_tab) l FULL JOIN (SELECT DISTINCT pnx FROM right_tab) r ON l.pnx = r.pnx GROUP BY 1",
    "neighbours": "SELECT context, row_n, count(*) OVER (PARTITION BY context ORDER BY row_n RANGE BETWEEN 40 PRECEDING AND 40 FOLLOWING) - 1 AS near FROM left_tab",
    "reconcile": """SELECT pnx, action, CAST(length(CASE WHEN action = 'overwrite' THEN b ELSE a END) AS INT) AS chars FROM (SELECT *, CASE WHEN b IS NULL THEN 'delete' WHEN x = y THEN 'keep' WHEN length(y) > length(x) THEN 'overwrite' ELSE 'keep_online' END AS action
      FROM (SELECT l.pnx, left(l.body, 80) AS a, r.body AS b, lower(trim(regexp_replace(left(l.body, 80), '[ \\t\\n]+', ' ', 'g'))) AS x, lower(trim(regexp_replace(r.body, '[ \\t\\n]+', ' ', 'g'))) AS y FROM left_tab l LEFT JOIN right_tab r ON l.pnx = r.pnx))""",
    "context_lines": "SELECT page, 1 AS \"table\", string_agg(line, ' / ' ORDER BY r) AS lines FROM (SELECT t.l_orderkey AS page, 'p' || x.l_partkey AS line, row_number() OVER (PARTITION BY t.l_orderkey ORDER BY x.l_quantity, 'p' || x.l_partkey) AS r FROM lineitem t JOIN lineitem x ON x.l_orderkey = t.l_orderkey AND t.l_linenumber = 1 AND x.l_linenumber > 1 AND x.l_quantity * 10 BETWEEN t.l_quantity * 10 - 200 AND t.l_quantity * 10 + 100) WHERE r <= 3 GROUP BY 1",
    "inventory": "SELECT CAST(regexp_extract(r.pnx, '^P(\\d+)-(\\d+)', 1) AS INT) AS slide, CAST(regexp_extract(r.pnx, '^P(\\d+)-(\\d+)', 2) AS INT) AS number, r.pnx, digest, row_n % 4 <> 0 AS highlighted, coalesce(c, '') AS citation FROM right_tab r LEFT JOIN (SELECT pnx, context AS c FROM left_tab) l ON l.pnx = r.pnx",
    "pagerank": f"WITH {_PR} SELECT id, round(score, 9) AS score FROM s4",
    "graph_stats": "SELECT coalesce(a.id, b.id) AS id, coalesce(o, 0) AS out_edges, coalesce(i, 0) AS in_edges, coalesce(d, 0) AS in_sources FROM (SELECT src AS id, count(*) AS o FROM edges_v GROUP BY 1) a FULL JOIN (SELECT dst AS id, count(*) AS i, count(DISTINCT src) AS d FROM edges_v GROUP BY 1) b ON a.id = b.id",
    "chain_ends": "WITH RECURSIVE r AS (SELECT o_orderkey AS old, o_orderkey + 1 AS new FROM orders WHERE o_orderkey % 16 <> 0), w AS (SELECT old, new FROM r UNION ALL SELECT w.old, r.new FROM w JOIN r ON w.new = r.old) SELECT old, max(new) AS final FROM w GROUP BY 1",
    "outline": f"WITH RECURSIVE {_OUT} SELECT conv_id, id, CAST(depth AS INT) AS depth, path FROM w",
    "last_sections": f"WITH RECURSIVE {_OUT} SELECT conv_id, CAST(depth AS INT) AS depth, id, path FROM w QUALIFY row_number() OVER (PARTITION BY conv_id, depth ORDER BY list_transform(string_split(path, '.'), lambda x: CAST(x AS INT)) DESC) = 1",
    "outline_text": f"WITH RECURSIVE {_OUT} SELECT conv_id, count(*) AS n, CAST(sum(length(title) + length(body) + 1) AS BIGINT) AS chars, CAST(max(depth) AS INT) AS depth FROM w JOIN sections_v USING (conv_id, id) GROUP BY 1",
    "success_rates": "SELECT job, a AS alpha, b AS beta, round(a / CAST(a + b AS DOUBLE), 6) AS expected, a / CAST(a + b AS DOUBLE) >= 0.5 AS run FROM (SELECT job, count(*) FILTER (ok) + 1 AS a, count(*) FILTER (NOT ok) + 1 AS b FROM outcomes_v GROUP BY 1)",
    "health": f"""SELECT job, n_ok, n_fail, latency, round(n_ok / CAST(n AS DOUBLE) / (1 + latency / 1000.0::DOUBLE), 6) AS score, CASE WHEN n < 5 THEN 1000 ELSE least(greatest(CAST(trunc(latency * 2.5::DOUBLE) AS BIGINT) * 2, 1000), 5000) END AS timeout_ms FROM (SELECT job, len(es) AS n, len(list_filter(es, lambda e: e.ok)) AS n_ok, len(list_filter(es, lambda e: NOT e.ok)) AS n_fail,
      list_reduce(list_transform(es, lambda e: e.lat), lambda a, b: CAST(trunc(0.7::DOUBLE * a + 0.3::DOUBLE * b) AS BIGINT)) AS latency FROM {_EVENTS})""",
    "request_rate": f"SELECT job, CAST(list_reduce(list_prepend(3.0::DOUBLE, list_transform(es, lambda e: CASE WHEN e.st = 429 THEN 100 WHEN e.st >= 500 THEN -1 WHEN e.q > 0.5 THEN 1 WHEN e.q > 0 AND e.q < 0.1 THEN -1 ELSE 0 END::DOUBLE)), lambda a, b: least(greatest(CASE WHEN b = 100 THEN floor(a / 2) ELSE a + b END, 1), 10)) AS BIGINT) AS rate FROM {_EVENTS}",
    "lru_survivors": "SELECT job, arg_max(event_id, struct_pack(t := ts, e := event_id)) AS last_event_id FROM outcomes_v GROUP BY 1 ORDER BY max(struct_pack(t := ts, e := event_id)) DESC, job LIMIT 50",
    "run_intervals": "SELECT event_type, day, week, CASE WHEN day >= 50 THEN 'every 10m' WHEN week / 7.0 >= 10 THEN 'every 30m' WHEN week / 7.0 >= 1 THEN 'every 2h' ELSE 'skip' END AS \"interval\" FROM (SELECT event_type, count(*) FILTER (ts > m - INTERVAL 1 DAY) AS day, count(*) FILTER (ts > m - INTERVAL 7 DAY) AS week FROM events, (SELECT max(ts) AS m FROM events) GROUP BY 1)",
    "last_status": "SELECT job, x.ok, x.status, x.event_id FROM (SELECT job, arg_max(struct_pack(ok := ok, status := status, event_id := event_id), struct_pack(t := ts, e := event_id)) AS x FROM outcomes_v GROUP BY 1)",
    "window_counts": "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, count(*) AS n, sum(floor(value))::DOUBLE AS total FROM events GROUP BY 1, 2",
    "session_counts": "SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 720 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY user_id, g",
}
ORACLES = {k: with_views(v) for k, v in ORACLES.items()}
