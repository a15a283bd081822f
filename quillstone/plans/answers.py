"""Queries over answers of models, features of slides and citations, addresses, vectors of texts, parts of outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..operators import embedding as E
from ..operators import graph as G
from ..sources.views import view, with_views


def _answers(spark, sf):
    """(k, answer): a reference as an object, put the way that models put it."""
    r, k = view(spark, sf, "refs_v"), F.col("k")
    inner = F.struct(F.array("journal", F.concat(F.lit('a "quoted" {'), "producer", F.lit("}"))).alias("symptoms"), F.when(k % 3 == 0, F.array("raw")).alias("diagnoses"), F.col("journal").alias("subjective"), F.concat(F.lit("see "), "url").alias("plan"), F.when(k % 4 == 0, 0.5).alias("confidence"), F.array("creator").alias("alerts"))
    body = F.to_json(inner)
    forms = [body, F.concat(F.lit("```json\n"), body, F.lit("\n```")), F.concat(F.lit("Here you are: "), body, F.lit(" and {more}")), F.concat(body, F.lit(" done")), F.lit("nothing"), F.concat(F.lit("{"), body)]
    return r.select("k", F.element_at(F.array(*forms), (k % len(forms) + 1).cast("int")).alias("answer"))


def json_objects(spark, sf):
    """The object within each answer: without its fence, to its closing brace, to the last brace."""
    x = _answers(spark, sf)
    first = A.first_object(F.col("answer"))
    return x.select("k", F.md5(A.unfenced(F.col("answer"))).alias("bare"), F.md5(first).alias("first"), F.md5(A.recovered(F.col("answer"))).alias("recovered"))


def clinical_entities(spark, sf):
    x = _answers(spark, sf).withColumn("e", A.entities(F.col("answer")))
    return x.where("e IS NOT NULL").select("k", F.array_join("e.symptoms", "|").alias("symptoms"), F.array_join("e.diagnoses", "|").alias("diagnoses"), F.size("e.medications").alias("medications"))


def soap_summaries(spark, sf):
    x = _answers(spark, sf).withColumn("s", A.soap(F.col("answer")))
    return x.where("s IS NOT NULL").select("k", "s.subjective", "s.objective", "s.plan", F.array_join("s.alerts", "|").alias("alerts"), "s.confidence")


def slide_numbers(spark, sf):
    """Data points of marks' contexts with a unit or a term behind them."""
    m = view(spark, sf, "marks_v")
    text = F.concat("context", F.when(F.col("k") % 4 == 0, "月 HBV").when(F.col("k") % 4 == 1, " bclc c").otherwise("%"), F.lit(" 7 "), F.col("k").cast("string"), F.lit("人"))
    return m.select("k", "n", "value", F.array_join(A.slide_data_points(text), "|").alias("points"))


def citation_features(spark, sf):
    r = view(spark, sf, "cite_lines_v")
    text = F.when(F.col("k") % 4 == 0, F.concat(F.lit("任宏, 等. 《肝脏》 "), "line")).otherwise(F.regexp_replace("line", "^[0-9]+[.] ", ""))
    x = r.withColumn("f", A.citation_features(text))
    return x.select("k", *[F.col(f"f.{c}").alias(c) for c in ("surname", "journal", "year", "volume", "issue", "pages", "doi")])


def paper_addresses(spark, sf):
    r, k = view(spark, sf, "refs_v"), F.col("k")
    doi = F.when(k % 7 == 0, "").when(k % 7 == 1, "备注 x").otherwise(F.concat(F.lit("10.1/"), k.cast("string")))
    a = A.paper_addresses(doi, F.when(k % 2 == 0, F.col("url")))
    link = A.absolute_link(F.when(k % 3 == 0, F.concat(F.lit("/p?"), k.cast("string"))).when(k % 3 == 1, F.col("url")).otherwise(F.concat(F.lit("c/"), k.cast("string"))))
    return r.select("k", F.array_join(F.transform(a, lambda x: F.concat_ws(" ", x["label"], x["url"])), ",").alias("addresses"), link.alias("link"))


def letter_vectors(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    v = E.embed(d, "doc_id", "text")
    return v.select(F.col("id").alias("doc_id"), F.round(F.get("vec", F.lit(4)), 6).alias("e"), F.round(F.get("vec", F.lit(19)), 6).alias("t"), F.size(F.filter("vec", lambda x: x > 0)).alias("letters"))


def found_sections(spark, sf):
    """The last section of an outline that has one of the wanted ids, on a walk that stops below matches; and how many sections such a walk sees."""
    s = view(spark, sf, "sections_v").select("conv_id", "id", "parent", "turn")
    walked = G.outline(s, "conv_id")
    wanted = s.where("turn % 3 = 2").select("conv_id", "id")
    seen = G.pruned(walked, wanted, "conv_id").groupBy("conv_id").agg(F.count("*").alias("seen"))
    return seen.join(G.find_section(walked, wanted, "conv_id"), "conv_id", "left").select("conv_id", "seen", "id", "path")


QUERIES = {f.__name__: f for f in (json_objects, clinical_entities, soap_summaries, slide_numbers, citation_features, paper_addresses, letter_vectors, found_sections)}


def _q(text):
    return "'" + text.replace("'", "''") + "'"


_BODY = """to_json(struct_pack(symptoms := [journal, 'a "quoted" {' || producer || '}'], diagnoses := CASE WHEN k % 3 = 0 THEN [raw] END, subjective := journal, plan := 'see ' || url, confidence := CASE WHEN k % 4 = 0 THEN 0.5 END, alerts := [creator]))"""
_ANSWER = """a AS (SELECT *, CAST(concat('{"symptoms":[', to_json(journal), ',', to_json('a "quoted" {' || producer || '}'), ']', CASE WHEN k % 3 = 0 THEN concat(',"diagnoses":[', to_json(raw), ']') ELSE '' END, ',"subjective":', to_json(journal), ',"plan":', to_json('see ' || url), CASE WHEN k % 4 = 0 THEN ',"confidence":0.5' ELSE '' END, ',"alerts":[', to_json(creator), ']}') AS VARCHAR) AS body FROM refs_v),
b AS (SELECT *, CASE k % 6 WHEN 0 THEN body WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' WHEN 2 THEN 'Here you are: ' || body || ' and {more}' WHEN 3 THEN body || ' done' WHEN 4 THEN 'nothing' ELSE '{' || body END AS answer FROM a)"""
_LABEL = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(url), {_q(p)})' for p in parts)} THEN {_q(label)}" for parts, label in A.PUBLISHERS) + f" ELSE {_q(A.OTHER)} END"
_VIP = r"20[0-9]{2}\s*;\s*([0-9]+)\s*\(([0-9]+)\)\s*:\s*([0-9\-]+)"
_TERMS = ", ".join(f"CASE WHEN contains(lower(text), {_q(t.lower())}) THEN {_q(t)} END" for t in A.SLIDE_TERMS)

_ORACLES = {
    "json_objects": f"WITH {_ANSWER} SELECT k, md5(CASE WHEN k % 6 = 1 THEN body ELSE answer END) AS bare, md5(CASE WHEN k % 6 IN (4, 5) THEN answer ELSE body END) AS first, md5(CASE WHEN k % 6 = 3 THEN body ELSE answer END) AS recovered FROM b",
    "clinical_entities": f"""WITH {_ANSWER} SELECT k, journal || '|' || 'a "quoted" {{' || producer || '}}' AS symptoms, CASE WHEN k % 3 = 0 THEN raw ELSE '' END AS diagnoses, 0 AS medications FROM b WHERE k % 6 IN (0, 1, 3)""",
    "soap_summaries": f"WITH {_ANSWER} SELECT k, journal AS subjective, '' AS objective, 'see ' || url AS plan, creator AS alerts, CASE WHEN k % 4 = 0 THEN 0.5::DOUBLE ELSE {A.SURE}::DOUBLE END AS confidence FROM b WHERE k % 6 IN (0, 1, 3)",
    "slide_numbers": f"""WITH t AS (SELECT k, n, value, concat(context, CASE k % 4 WHEN 0 THEN '月 HBV' WHEN 1 THEN ' bclc c' ELSE '%' END, ' 7 ', k, '人') AS text FROM marks_v),
f AS (SELECT *, list_zip(regexp_extract_all(text, '{A.NUMBER}', 1), regexp_extract_all(text, '{A.NUMBER}', 2), regexp_extract_all(text, '{A.NUMBER}', 3)) AS found FROM t),
g AS (SELECT *, list_filter(found, lambda x: NOT (CAST(x[1] AS DOUBLE) < 10 AND x[2] = '' AND NOT contains(x[1], '.'))) AS told FROM f),
h AS (SELECT k, n, value, list_concat(flatten(list_transform(told, lambda x: CASE WHEN x[2] = '%' OR CAST(x[1] AS DOUBLE) <= 100 AND x[3] = '' THEN [x[1], x[1] || '%'] ELSE [x[1]] END)), list_filter([{_TERMS}], lambda x: x IS NOT NULL)) AS l FROM g)
SELECT k, n, value, array_to_string(list_filter(l, lambda v, i: list_position(l, v) = i), '|') AS points FROM h""",
    "citation_features": rf"""WITH t AS (SELECT k, CASE WHEN k % 4 = 0 THEN '任宏, 等. 《肝脏》 ' || line ELSE regexp_replace(line, '^[0-9]+[.] ', '') END AS t FROM cite_lines_v)
SELECT k, coalesce(nullif(regexp_extract(t, '^\s*([A-Z][a-zA-Z\-]+)\s+[A-Z]', 1), ''), regexp_extract(t, '^([\x{{4e00}}-\x{{9fff}}]{{2,4}})', 1)) AS surname, coalesce(nullif(rtrim(trim(regexp_extract(t, '([A-Z][a-zA-Z.\s]+?)\.?\s*20[0-9]{{2}}', 1)), '.'), ''), regexp_extract(t, '《([^》]+)》', 1)) AS journal,
  regexp_extract(t, '\b((?:19|20)[0-9]{{2}})\b', 1) AS year, regexp_extract(t, '{_VIP}', 1) AS volume, regexp_extract(t, '{_VIP}', 2) AS issue, regexp_extract(t, '{_VIP}', 3) AS pages, regexp_extract(t, '10\.[0-9]{{4,9}}/[A-Za-z0-9._\-()/]+') AS doi FROM t""",
    "paper_addresses": f"""SELECT k, CASE WHEN k % 7 IN (0, 1) THEN '' ELSE concat(CASE WHEN k % 2 = 0 AND url <> '' THEN concat({_LABEL}, '{A.FULL_TEXT} ', url, ',') ELSE '' END, {", ',', ".join(f"'{label} {url}10.1/', k" for label, url in A.SEARCHES)}) END AS addresses,
  CASE k % 3 WHEN 0 THEN '{A.SCHOLAR}/p?' || k WHEN 1 THEN CASE WHEN url = '' OR starts_with(url, 'http') THEN url ELSE '{A.SCHOLAR}/' || url END ELSE '{A.SCHOLAR}/c/' || k END AS link FROM refs_v""",
    "letter_vectors": f"""WITH c AS (SELECT doc_id, [{", ".join(f"length(t) - length(replace(t, '{x}', ''))" for x in E.LETTERS)}] AS v FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE trim(text) <> '')),
n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM c) SELECT d.doc_id, round(CASE WHEN n.n > 0 THEN v[5] / n.n ELSE 0 END, 6)::DOUBLE AS e, round(CASE WHEN n.n > 0 THEN v[20] / n.n ELSE 0 END, 6)::DOUBLE AS t, CAST(len(list_filter(v, lambda x: x > 0)) AS INT) AS letters FROM documents d LEFT JOIN n USING (doc_id)""",
    "found_sections": """WITH RECURSIVE s AS (SELECT conv_id, id, parent, turn, row_number() OVER (PARTITION BY conv_id, parent ORDER BY turn, id) AS n FROM sections_v),
w AS (SELECT conv_id, id, turn % 3 = 2 AS match, CAST(n AS VARCHAR) AS path, [n] AS place FROM s WHERE parent IS NULL
  UNION ALL SELECT s.conv_id, s.id, s.turn % 3 = 2, w.path || '.' || s.n, list_append(w.place, s.n) FROM w JOIN s ON s.conv_id = w.conv_id AND s.parent = w.id WHERE NOT w.match)
SELECT conv_id, count(*) AS seen, arg_max(id, place) FILTER (match) AS id, arg_max(path, place) FILTER (match) AS path FROM w GROUP BY 1""",
}
ORACLES = {k: with_views(v) for k, v in _ORACLES.items()}
