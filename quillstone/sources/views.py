"""Deterministic views over the TESTDATA tables.

The tables hold no citations, so each view derives rows of the wanted shape by
formulas that read the same in Spark SQL and in ANSI SQL; ``with_views`` puts
them in front of a statement for another engine.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _pick(key: str, values: list[str]) -> str:
    """A CASE that takes the values in turn by ``key`` modulo their number."""
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {key} % {len(values)} {cases} END"


JOURNALS = ["Lancet Oncol", "N Engl J Med", "J Hepatol", "JAMA Oncol", "Gut", "Front Oncol", "Nature Rev", "Quarterly Notes"]
SURNAMES = ["Smith", "Abou-Alfa", "Finn", "Galle", "Qin", "Lee", "Zhang"]

VIEWS = {
    "citations_v": f"""
SELECT doc_id AS ord, concat('d', doc_id) AS id, split_part(text, chr(10), 1) AS title,
       CASE WHEN doc_id % 3 = 0 THEN CAST(CAST(floor(doc_id / 6) AS BIGINT) AS STRING) ELSE '' END AS pmid,
       CASE WHEN doc_id % 3 <> 1 THEN '' WHEN doc_id % 2 = 1 THEN upper(concat('10.1000/', source, '.', CAST(floor(doc_id / 6) AS BIGINT)))
            ELSE concat(' 10.1000/', source, '.', CAST(floor(doc_id / 6) AS BIGINT)) END AS doi,
       {_pick("doc_id", JOURNALS)} AS journal, CAST(2010 + doc_id % 16 AS INT) AS year, CAST(n_chars % 997 AS BIGINT) AS cited_by,
       CAST(doc_id % 40 AS DOUBLE) / 10 AS fwci, {_pick("doc_id", ["pubmed", "openalex", "s2", "scholar"])} AS origin,
       CAST(doc_id % 20 AS BIGINT) AS conv_id,
       concat(substring(text, 1, 200), CASE WHEN doc_id % 5 = 0 THEN ' Randomized Controlled Trial' WHEN doc_id % 7 = 0 THEN ' placebo-controlled' ELSE '' END) AS abstract
FROM {{documents}}""",
    "refs_v": f"""
SELECT o_orderkey AS k,
       CASE o_orderkey % 8 WHEN 0 THEN CAST(o_orderkey AS STRING) WHEN 1 THEN concat('https://doi.org/10.', 1000 + o_orderkey % 9000, '/ab-', o_orderkey)
            WHEN 2 THEN concat('http://doi.org/10.1056/NEJM', o_orderkey) WHEN 3 THEN concat('  doi.org/10.1016/j.x.', o_orderkey) WHEN 4 THEN concat('10.12/', o_orderkey)
            WHEN 5 THEN concat('10.7717/peerj.', o_orderkey % 900, '/fig-', o_orderkey % 9) WHEN 6 THEN concat('10.7554/elife.', o_orderkey, '.026') ELSE concat('10.1136/bmj.', o_orderkey, '/v1/response', o_orderkey % 4) END AS raw,
       CASE o_orderkey % 11 WHEN 0 THEN concat('https://doi.org/10.1002/x.', o_orderkey) WHEN 1 THEN concat('https://onlinelibrary.wiley.com/doi/pdf/10.1002/', o_orderkey)
            WHEN 2 THEN concat('https://www.frontiersin.org/articles/', o_orderkey, '/pdf') WHEN 3 THEN concat('https://www.mdpi.com/', o_orderkey, '/pdf') WHEN 4 THEN 'https://gco.iarc.fr/2022/fact-sheet.pdf'
            WHEN 5 THEN concat('https://pmc.ncbi.nlm.nih.gov/articles/PMC', o_orderkey) WHEN 6 THEN concat('file:///data/P', o_orderkey % 50, '-', o_orderkey % 7, '.pdf')
            WHEN 7 THEN concat('https://web.archive.org/web/2023/', o_orderkey) WHEN 8 THEN concat('https://www.ncbi.nlm.nih.gov/pubmed/', o_orderkey, '?src=1') WHEN 9 THEN '' ELSE concat('http://example.org/a/', o_orderkey, '.pdf') END AS url,
       {_pick("o_orderkey", [*JOURNALS, "Ann Oncol", "Int J Mol Sci", "GLOBOCAN 2022", "Cancer Cell"])} AS journal,
       {_pick("o_orderkey", ["Adobe InDesign 16", "ReportLab PDF Library", "Skia/PDF m101", "WeasyPrint 52", "pdfmake", "", "Acrobat Distiller 9", "Other Tool"])} AS producer,
       {_pick("CAST(floor(o_orderkey / 8) AS BIGINT)", ["Mozilla/5.0", "Chrome", ""])} AS creator,
       {_pick("CAST(floor(o_orderkey / 24) AS BIGINT)", ["An official website", "Image: fig2.png", "Page 1 of 3 ASCO", "plain"])} AS page_text,
       CAST(2015 + o_orderkey % 12 AS INT) AS year, CAST(o_totalprice * 100 AS BIGINT) AS n_bytes, o_orderpriority AS title
FROM {{orders}}""",
    "cite_lines_v": f"""
SELECT o_orderkey AS k, CAST(o_orderkey % 40 AS INT) AS page,
       concat(CASE WHEN o_orderkey % 3 = 0 THEN concat(1 + o_orderkey % 30, '. ') ELSE '' END, {_pick("o_orderkey", SURNAMES)}, ' A',
              CASE WHEN o_orderkey % 4 = 0 THEN ', et al' ELSE '' END, '. ', {_pick("o_orderkey", JOURNALS)}, '. ',
              CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE concat(2005 + o_orderkey % 20, ';', 10 + o_orderkey % 50, '(', 1 + o_orderkey % 12, '):', 100 + o_orderkey % 800, '-', 110 + o_orderkey % 800) END,
              {_pick("o_orderkey", [" HIMALAYA", "", "", " KEYNOTE-240", "", " REFLECT", "", "", ""])}, {_pick("o_orderkey", [" Sorafenib", "", "", " Durvalumab", ""])},
              CASE WHEN o_orderkey % 6 = 0 THEN concat(' doi:10.', 1000 + o_orderkey % 50, '/x.', o_orderkey, '.') WHEN o_orderkey % 6 = 1 THEN concat(' PMID: ', 10000000 + o_orderkey) ELSE '' END) AS line
FROM {{orders}}""",
    "marks_v": """
SELECT l_orderkey AS k, CAST(l_linenumber AS INT) AS n,
       CASE l_linenumber WHEN 1 THEN CAST(l_orderkey % 24 AS STRING) WHEN 2 THEN concat(l_orderkey % 9 + 1, ', ', l_orderkey % 5 + 1) WHEN 3 THEN concat(l_orderkey % 9 + 1, '-', l_orderkey % 9 + 3)
            WHEN 4 THEN concat(l_orderkey % 9 + 3, '~', l_orderkey % 9 + 1, ',', l_orderkey % 7) WHEN 5 THEN concat(' ', l_orderkey % 4, ' ,x, ', l_orderkey % 4, ',') ELSE 'note 1a' END AS marks,
       CASE WHEN l_linenumber % 2 = 0 THEN concat(CAST(l_quantity AS INT), '.', l_orderkey % 10, '%') ELSE concat(CAST(l_quantity AS INT), '.', l_orderkey % 10) END AS value,
       concat('rate ', CAST(l_quantity AS INT), '.', l_orderkey % 10, CASE l_linenumber % 4 WHEN 0 THEN '%' WHEN 1 THEN ' month' WHEN 2 THEN ' 5-year' ELSE '' END, ' of ', l_orderkey % 300, ' and ', l_linenumber) AS context
FROM {lineitem}""",
    "votes_v": "SELECT user_id AS question, event_type AS answer, CAST(floor(value) AS DOUBLE) / 1000 AS confidence FROM {events}",
    "outcomes_v": "SELECT event_id, user_id AS job, ts, event_type <> 'error' AND event_id % 7 <> 0 AS ok, CAST(floor(value * 10) AS BIGINT) + 1 AS latency, CAST(CASE event_id % 13 WHEN 0 THEN 429 WHEN 1 THEN 503 ELSE 200 END AS INT) AS status, CAST((event_id * 37) % 100 AS DOUBLE) / 100 AS quota FROM {events}",
    "edges_v": "SELECT l_suppkey AS src, l_partkey % 97 AS dst FROM {lineitem}",
    "table_rows_v": "SELECT p_brand AS grp, p_partkey AS k, p_type AS disease, CAST(floor(p_retailprice) AS DOUBLE) AS value, CAST(p_size AS DOUBLE) AS y FROM {part}",
    "sections_v": """
SELECT conv_id, CAST(turn AS BIGINT) AS turn, concat('s', conv_id, '.', turn) AS id, CASE WHEN turn <= 1 THEN NULL ELSE concat('s', conv_id, '.', CAST(floor(turn / 2) AS BIGINT)) END AS parent,
       substring(split_part(text, chr(10), 1), 1, 40) AS title,
       concat(substring(text, 1, 120), CASE (conv_id + turn) % 9 WHEN 0 THEN ' 彻底根治, 有效率高达95' WHEN 1 THEN ' 安全无副作用' WHEN 2 THEN ' 不得宣传最佳疗效' WHEN 3 THEN ' NO.1 热销' WHEN 4 THEN ' 电视广告' WHEN 5 THEN ' 请遵医嘱' ELSE '' END) AS body,
       CASE conv_id % 3 WHEN 0 THEN 'patient' WHEN 1 THEN 'hcp' ELSE 'payer' END AS audience, CASE WHEN conv_id % 2 = 0 THEN 'rx' ELSE 'otc' END AS rx_status
FROM {conversations}""",
    "commands_v": """
SELECT event_id AS k, CASE event_id % 14 WHEN 0 THEN 'test' WHEN 1 THEN 'help' WHEN 2 THEN concat('process P', event_id % 30, '-', event_id % 9) WHEN 3 THEN concat('search liver cancer ', event_id % 30) WHEN 4 THEN 'audit'
       WHEN 5 THEN 'dedup all' WHEN 6 THEN 'recent 5' WHEN 7 THEN concat('Finn R ', 2000 + event_id % 25) WHEN 8 THEN 'cron' WHEN 9 THEN concat('sci-hub 10.1000/', event_id) WHEN 10 THEN 'refresh' WHEN 11 THEN '' WHEN 12 THEN concat('what about ', event_type) ELSE 'normalize ' END AS text
FROM {events}""",
    "left_tab": "SELECT concat('P', CAST(floor(doc_id / 10) AS BIGINT), '-', doc_id % 10) AS pnx, source AS context, concat(lang, ' ') AS kind, CAST(n_chars AS STRING) AS size, doc_id AS row_n, text AS body FROM {documents} WHERE doc_id % 7 <> 0",
    "right_tab": "SELECT concat('P', CAST(floor(doc_id / 10) AS BIGINT), '-', doc_id % 10) AS pnx, CASE WHEN doc_id % 11 = 0 THEN upper(source) ELSE source END AS context, lang AS kind, CAST(n_chars + CASE WHEN doc_id % 13 = 0 THEN 1 ELSE 0 END AS STRING) AS size, doc_id AS row_n, md5(text) AS digest, substring(text, 1, 50 + CAST(doc_id % 100 AS INT)) AS body FROM {documents} WHERE doc_id % 5 <> 0",
    "questions_v": f"""
SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN concat('Aspirin vs placebo in patients with ', lower(c_mktsegment)) WHEN 1 THEN 'Does statin therapy reduce mortality in adults?' WHEN 2 THEN concat('Metformin compared to insulin, in ', lower(c_mktsegment), ' children')
       WHEN 3 THEN concat('Vaccine safety for ', lower(c_mktsegment)) WHEN 4 THEN '阿司匹林 与 安慰剂 治疗 糖尿病 的 心血管死亡' ELSE concat(c_mktsegment, ' only') END AS question
FROM {{customer}}""",
    # slides: text shapes with lines of many kinds, and tables of items whose cells carry marks
    "slide_texts_v": f"""
SELECT CAST(floor(o_orderkey / 40) AS BIGINT) AS slide, CAST(o_orderkey % 40 AS INT) AS shape, concat('Text ', o_orderkey) AS name,
       concat({_pick("o_orderkey", ["中国肝癌新发和死亡病例占全球近半数", "其他癌种", "Ann Oncol. 17(1): ", "PD-L1: 程序性死亡配体 ", "ORIENT-", "N=", "JCO 20", "  总体生存率 "])}, 1 + o_orderkey % 27, CASE WHEN o_orderkey % 3 = 0 THEN concat(',', 1 + o_orderkey % 31) ELSE '' END, chr(10),
              {_pick("CAST(floor(o_orderkey / 8) AS BIGINT)", ["肿瘤负荷大", "Lancet. 20", "Zhang, Huajun et al 20", "", "anti CTLA-", "see ", "HR ", "《行动》"])}, 1 + o_orderkey % 12, CASE WHEN o_orderkey % 2 = 0 THEN concat('-', 1 + o_orderkey % 14) ELSE '' END, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE '' END, chr(10),
              CASE o_orderkey % 6 WHEN 0 THEN 'end of text' WHEN 1 THEN '' WHEN 2 THEN concat(o_orderkey % 90, '.5') ELSE concat(o_orderpriority, ' ', o_orderkey % 30) END) AS text
FROM {{orders}}""",
    "slide_rows_v": """
SELECT CAST(floor(l_orderkey / 40) AS BIGINT) AS slide, CAST(40 + l_orderkey % 40 AS INT) AS shape, concat('Table ', l_orderkey) AS name, CAST(l_linenumber - 1 AS INT) AS row, concat('line ', l_linenumber) AS c0,
       concat(CASE l_partkey % 5 WHEN 0 THEN '仑伐替尼' WHEN 1 THEN 'T+A方案' WHEN 2 THEN 'O+Y' WHEN 3 THEN 'plan ' ELSE '' END, l_suppkey % 40, CASE WHEN l_partkey % 3 = 0 THEN concat(',', l_partkey % 45) ELSE '' END) AS c1,
       CASE WHEN l_partkey % 4 = 0 THEN concat(' 亚叶酸钙', l_partkey % 50, ' ') WHEN l_partkey % 4 = 1 THEN l_returnflag ELSE '' END AS c2
FROM {lineitem}""",
    "vectors_v": "SELECT vec_id AS id, embedding AS vec, label FROM {embeddings}",
}


#: Cuts of the statements for another engine, which queries that search whole texts do without.
CUTS = {"citations_v": ("substring(text, 1, 200)", "text"), "sections_v": ("substring(text, 1, 120)", "text")}


def view(spark: SparkSession, sf_dir: str, name: str, whole: bool = False) -> DataFrame:
    """The view; ``whole`` leaves its text uncut, with what the view puts after it."""
    sql = VIEWS[name].replace(*CUTS[name]) if whole else VIEWS[name]
    used = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def with_views(sql: str) -> str:
    """``sql`` behind a WITH clause that defines the views it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({re.sub(r'{(\w+)}', r'\1', VIEWS[v])})" for v in used]
    body = sql.strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\b", body, re.I))
    body = re.sub(r"^WITH(\s+RECURSIVE)?\b", ",", body, flags=re.I) if re.match(r"WITH\b", body, re.I) else " " + body
    return f"WITH{' RECURSIVE' if recursive else ''} " + ",\n".join(parts) + body if parts else sql
