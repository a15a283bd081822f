"""Operators on literal rows with known results."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import ids
from quillstone.functions import text as T
from quillstone.operators import evidence as E
from quillstone.operators import fusion as U
from quillstone.operators import graph as G
from quillstone.operators import reconcile as R
from quillstone.operators import rules as L
from quillstone.operators import similarity as M
from quillstone.operators import state as S


def one(spark, expr, **given):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]).select(expr.alias("x")).first()["x"] if given else spark.range(1).select(expr.alias("x")).first()["x"]


CITE = "ord int, id string, title string, pmid string, doi string, cited_by long, fwci double, source_origin array<string>, abstract string, journal string, year int, conv_id int"


def cites(spark, rows):
    full = [(i, *r, "", "", 2025, 1) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CITE)


def test_same_pmid_fuses(spark):
    d = cites(spark, [("pubmed:1", "t", "31535829", "", 100, 0.0, ["pubmed"]), ("openalex:W1", "t", "31535829", "", 200, 0.0, ["openalex"])])
    r = U.fuse_citations(d).collect()
    assert len(r) == 1 and r[0]["id"] == "openalex:W1" and r[0]["source_origin"] == ["openalex", "pubmed"]


def test_doi_case_fuses(spark):
    d = cites(spark, [("a", "t", "", "10.1056/NEJMoa1911303", 1, 0.0, ["x"]), ("b", "u", "", " 10.1056/nejmoa1911303", 1, 0.0, ["y"])])
    assert [r["id"] for r in U.fuse_citations(d).collect()] == ["a"]  # of equals the first


def test_titles_fuse(spark):
    d = cites(spark, [("a", "Dapagliflozin in Heart Failure", "", "", 5, 0.0, ["x"]), ("b", "dapagliflozin in heart failure", "", "", 1, 0.0, ["y"]), ("c", "Something else entirely here", "", "", 1, 0.0, ["z"]), ("d", "", "", "", 1, 0.0, ["z"]), ("e", "", "", "", 2, 0.0, ["q"])])
    r = {x["id"]: x["source_origin"] for x in U.fuse_citations_by_title(d).collect()}
    assert r == {"a": ["x", "y"], "c": ["z"], "e": ["q", "z"]}


def test_title_joins_identified_group(spark):
    d = cites(spark, [("a", "One title of a paper", "7", "", 1, 0.0, ["x"]), ("b", "one title of a paper", "", "", 99, 0.0, ["y"])])
    assert [(x["id"], x["source_origin"]) for x in U.fuse_citations_by_title(d).collect()] == [("b", ["x", "y"])]
    assert [(x["id"], x["source_origin"]) for x in U.fuse_citations_by_title(d, strict=True).collect()] == [("a", ["x"])]


def test_fusing_is_idempotent(spark):
    rng = random.Random(1)
    rows = [(f"c{i}", f"title {i % 7}", str(i % 5) if i % 3 else "", f"10.1/{i % 4}" if i % 2 else "", rng.randrange(9), 0.5, [rng.choice("abc")]) for i in range(60)]
    once = U.fuse_citations(cites(spark, rows))
    again = U.fuse_citations(once.drop("group_key", "n_merged", "richness"))
    key = lambda d: sorted((r["id"], tuple(r["source_origin"])) for r in d.collect())
    assert key(once) == key(again)
    turned = U.fuse_citations(cites(spark, rows).orderBy(F.rand(3)))
    assert key(once) == key(turned)


def test_grades(spark):
    rct = [(f"c{i}", "A randomized trial", str(i), "", 1, 0.0, [s]) for i, s in enumerate(["a", "b", "c", "a", "b", "c"])]
    r = U.grade(cites(spark, rct), 2026).first()
    assert (r["grade"], r["score"]) == ("A", 7)
    mixed = [(f"c{i}", "RCT" if i < 2 else "Review", str(i), "", 1, 0.0, [s]) for i, s in enumerate(["a", "b", "c", "a"])]
    assert U.grade(cites(spark, mixed), 2026).first()["score"] == 6
    assert U.grade(cites(spark, mixed[3:]), 2040).first()["grade"] == "D"


@pytest.mark.parametrize(
    "votes, answer, agreement",
    [
        ([("row", 0.8)] * 3 + [("audit", 0.9)] * 2, "row", 0.6),
        ([("A", 0.7), ("A", 0.7), ("B", 0.9), ("B", 0.9)], "B", 0.5),
        ([(c, 0.5) for c in "vwxyz"], "v", 0.2),
    ],
)
def test_consensus(spark, votes, answer, agreement):
    d = spark.createDataFrame([("q", *v) for v in votes], "question string, answer string, confidence double")
    r = U.consensus(d).first()
    assert (r["answer"], r["agreement"]) == (answer, pytest.approx(agreement))


def brute_simhash(title):
    words = [w for w in __import__("re").split("[ \t\n\r.,;:!?]+", title.strip().lower()) if w]
    if not words:
        return None
    n = [0] * 64
    for w in words:
        h = int.from_bytes(hashlib.sha1(w.encode()).digest()[:8], "big")
        for i in range(64):
            n[i] += 1 if h >> i & 1 else -1
    v = sum(1 << i for i in range(64) if n[i] > 0)
    return v - (1 << 64) if v >> 63 else v


def test_simhash(spark):
    titles = ["Dapagliflozin in heart failure", "a", "", " . ", "Über β-blockers: a review!", "x y z " * 30]
    d = spark.createDataFrame([(t,) for t in titles], "t string")
    assert [r["h"] for r in d.select(M.simhash(F.col("t")).alias("h")).collect()] == [brute_simhash(t) for t in titles]


def test_near_hashes(spark):
    rng = random.Random(4)
    hs = [rng.getrandbits(63) for _ in range(40)]
    hs += [h ^ (1 << rng.randrange(63)) for h in hs[:10]] + [h ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for h in hs[:10]] + [h ^ 7 for h in hs[:5]] + [-1, -2, 0]
    hs = sorted(set(hs))
    d = spark.createDataFrame([(h,) for h in hs], "h long")
    got = {(r["a"], r["b"]) for r in M.near_hashes(d.select(F.col("h").alias("a")), d.select(F.col("h").alias("b"))).collect()}
    assert got == {(a, b) for a in hs for b in hs if bin((a ^ b) & (2**64 - 1)).count("1") <= 2}


def test_nearest_blocks(spark):
    rows = [(i, [float((i + j) % 100) / 100 for j in range(16)]) for i in range(300)]
    items = spark.createDataFrame(rows, "id long, vec array<float>")
    queries = items.where("id % 50 = 0").select(F.col("id").alias("query"), "vec")
    whole = M.nearest(items, queries, 4).orderBy("query", "rank").collect()
    parts = M.nearest(items.repartition(5), queries, 4, query_bytes=2 * 16 * 8).orderBy("query", "rank").collect()
    assert [tuple(r)[:2] for r in whole] == [tuple(r)[:2] for r in parts]
    assert all(r["id"] == r["query"] for r in whole if r["rank"] == 1 and r["query"] < 100)
    assert M.nearest(items, queries.limit(0)).count() == 0


def test_vectors(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert one(spark, M.cosine(v(1, 0), v(0, 0))) == 0 and one(spark, M.cosine(v(1), v(1, 2))) == 0
    assert one(spark, M.cosine(v(3, 4), v(3, 4))) == pytest.approx(1) and one(spark, M.euclid(v(0, 0), v(3, 4))) == 5
    assert one(spark, M.unit(v(0, 0))) == [0, 0]


SUBJECT = 14.4


def test_set_conclusion(spark):
    rows = [("t", f"cancer {i}", 20.0 + i, SUBJECT) for i in range(25)] + [("t", "pancreatic", 10.0, SUBJECT), ("t", "HCC", SUBJECT, SUBJECT), ("u", "a", 20.0, SUBJECT), ("u", "b", 1.0, SUBJECT), ("u", "c", 2.0, SUBJECT)]
    d = spark.createDataFrame(rows, "grp string, disease string, value double, subject double")
    r = {x["grp"]: x for x in E.set_conclusion(d, "grp").collect()}
    assert (r["t"]["n_high"], r["t"]["n_low"], r["t"]["score"]) == (25, 1, 0.95)
    assert r["u"]["score"] < 0.70


def test_values(spark):
    for a, b, want in ((14.4, 14.5, 1.0), (14.4, 16.0, 0.7), (10.0, 15.0, 0.3), (1.0, 9.0, 0.0), (0.0, 0.0, 0.5), (0.0, 1.0, 0.0)):
        assert one(spark, E.value_score(F.lit(a), F.lit(b))) == want


def test_combine(spark):
    kv = lambda *x: spark.createDataFrame(list(x), "k string, value string")
    got = {r["k"]: r["value"] for r in E.combine(kv(("a", "1")), kv(("a", "2"), ("b", "3")), "k").collect()}
    assert got == {"a": "1", "b": "3"}


@pytest.mark.parametrize("marks, want", [("1, 3-5, 7", [1, 3, 4, 5, 7]), ("1,1,2", [1, 2]), ("1~3", [1, 2, 3]), ("5-3", [3, 4, 5]), ("1a, x", []), ("", []), ("0", [0])])
def test_marks(spark, marks, want):
    assert one(spark, T.expand_marks(F.lit(marks))) == want


def brute_variants(v):
    out = [v]
    bare = v.rstrip("%")
    try:
        x = float(bare)
    except ValueError:
        return out
    steps = []
    for p in (1, 2, 3):
        f = f"{x:.{p}f}"
        g = f.rstrip("0").rstrip(".")
        steps += ([g] if g != bare else []) + [f]
    percent = "%" in v
    for s in steps:
        if s and s not in out:
            out.append(s)
            if percent:
                out.append(s + "%")
    if not percent and x <= 100:
        out += [w for w in dict.fromkeys([bare + "%", *[s + "%" for s in steps]]) if w not in out]
    if percent:
        out += [w for w in dict.fromkeys([bare, *steps]) if w not in out]
    return out


@pytest.mark.parametrize("v", ["14.4", "14.4%", "27.90", "300", "100", "0.5%", "abc", "12.3456"])
def test_number_variants(spark, v):
    assert set(one(spark, T.number_variants(F.lit(v)))) == set(brute_variants(v))


@pytest.mark.parametrize(
    "text, tail",
    [("doi 10.1056/EVIDoa2100070", "EVIDoa2100070"), ("10.1159/000518619.", "000518619"), ("10.1158/1078-0432.CCR-24-0006;", "1078-0432.CCR-24-0006"), ("10.3322/caac.21834", "caac.21834"), ("none", "")],
)
def test_doi_tails(spark, text, tail):
    assert one(spark, T.doi_tail(F.lit(text))) == tail


def test_key_fields(spark):
    r = one(spark, T.key_fields(F.lit("Abou-Alfa GK, Lau G, Kudo M. Lancet Oncol. 2022;1:8 HIMALAYA Tremelimumab doi:10.1056/EVIDoa2100070")))
    assert (r["authors"], r["journal"], r["year"], r["trial"], r["drug"], r["doi_tail"]) == (["Abou-Alfa", "Lau", "Kudo"], "Lancet Oncol", "2022", "HIMALAYA", "Tremelimumab", "EVIDoa2100070")
    m = one(spark, T.match_fields(T.key_fields(F.lit("Finn R. Lancet 2020")), F.lit("by FINN in the lancet, 2021")))
    assert (m["matched"], m["missing"], m["reason"]) == (["authors", "journal"], ["year"], "good match")


def test_year_borders(spark):
    assert one(spark, T.first(F.lit("于2024年"), T.YEAR)) == "2024" and one(spark, T.first(F.lit("x2024"), T.YEAR)) == ""


def test_pico(spark):
    r = one(spark, T.pico(F.lit("Aspirin vs placebo in patients with hypertension")))
    assert (r["intervention"], r["comparator"], r["population"]) == ("aspirin", "placebo in patients with hypertension", "in patients with")
    assert one(spark, T.pico(F.lit("Does statin therapy reduce mortality?")))["outcome"] == "reduce mortality"


def test_venue_and_abstract(spark):
    r = one(spark, T.authors_venue(F.lit("A Smith, B Lee - J Test, 2020")))
    assert (r["authors"], r["journal"], r["year"]) == (["A Smith", "B Lee"], "J Test", "2020")
    m = F.create_map(F.lit("heart"), F.array(F.lit(0), F.lit(2)), F.lit("failure"), F.array(F.lit(1)))
    assert one(spark, T.abstract_of(m)) == "heart failure heart"


@pytest.mark.parametrize(
    "raw, want",
    [("31535829", "31535829"), ("123", ""), ("https://doi.org/10.1056/NEJMoa1", "10.1056/NEJMoa1"), (" doi.org/10.1000/x ", "10.1000/x"), ("10.12/x", ""), ("10.1000/a b", ""), ("", ""), (None, "")],
)
def test_canonical_ids(spark, raw, want):
    assert one(spark, ids.canonical_id(F.lit(raw).cast("string"))) == want


@pytest.mark.parametrize(
    "doi, want", [("10.7717/peerj.1/fig-2", "chart-figure"), ("10.1136/bmj.1/v1/response2", "author-reply"), ("10.7554/elife.1.026", "supplementary"), ("10.1056/NEJMoa1911303", "research-paper"), ("", "unknown"), ("10.1/x/suppl", "supplementary")]
)
def test_doi_classes(spark, doi, want):
    assert one(spark, ids.doi_class(F.lit(doi))) == want


def test_column_letters(spark):
    def letters(i):
        s = ""
        while i >= 0:
            s, i = chr(65 + i % 26) + s, i // 26 - 1
        return s

    d = spark.range(0, 18278, 1).select("id", ids.column_letter(F.col("id")).alias("c"))
    assert all(r["c"] == letters(r["id"]) for r in d.collect())


def pdf(body=b"", pages=1):
    return b"%PDF-1.4\n1 0 obj\n<< /Type /Page >>\nendobj\n" + body + b"\nxref\ntrailer\nstartxref\n%%EOF" + b" " * 80


@pytest.mark.parametrize(
    "content, valid, reason",
    [(pdf(), True, "valid PDF, ~1 page(s), 0 streams"), (b"x" * 10, False, "too small (10 bytes)"), (b"<!DOCTYPE html>" + b" " * 200, False, "HTML page (likely paywall/error), not PDF"), (b"404 " + b" " * 200, False, "error page (404), not PDF"), (b"y" * 200, False, "missing %PDF- header")],
)
def test_pdf_validity(spark, content, valid, reason):
    d = spark.createDataFrame([(bytearray(content),)], "c binary")
    r = d.select(ids.pdf_validity(F.col("c")).alias("v")).first()["v"]
    assert (r["valid"], r["reason"]) == (valid, reason)


def test_rules(spark):
    rows = [(1, 1, "彻底根治糖尿病, 治愈率高达95%", "hcp", "rx"), (1, 2, "安全无副作用", "hcp", "otc"), (1, 3, "处方药不得宣传最佳疗效", "patient", "rx"), (1, 4, "电视广告", "hcp", "otc"), (2, 1, "电视广告", "hcp", "rx"), (3, 1, "请遵医嘱", "patient", "rx"), (4, 1, None, "patient", "rx")]
    d = spark.createDataFrame(rows, "conv_id int, turn int, body string, audience string, rx_status string")
    f = L.scan(d, ("conv_id", "turn"), F.col("body"), F.col("audience"), F.col("rx_status"))
    got = {(r["conv_id"], r["turn"], r["rule"]) for r in f.collect()}
    assert got == {(1, 1, "ADV-16-CURE"), (1, 2, "ADV-16-SAFE"), (2, 1, "DRG-RX-PUBLIC")}
    v = {r["conv_id"]: r["verdict"] for r in L.verdicts(f, d, "conv_id").collect()}
    assert v == {1: "fail", 2: "fail", 3: "pass", 4: "pass"}
    assert {r["conv_id"] for r in L.missing(d, "conv_id", F.col("body"), F.col("audience")).collect()} == {1, 4}


@pytest.mark.parametrize("text, intent", [("test", "test"), ("处理 P5-7", "process_row"), ("帮助", "help"), ("", "free_query"), ("what else", "free_query"), ("normalize ", "normalize")])
def test_intents(spark, text, intent):
    r = one(spark, L.intent(F.lit(text)))
    assert r["intent"] == intent and (intent == "free_query") == r["unsure"]


def test_pagerank(spark):
    star = spark.createDataFrame([(f"T{i}", "T1") for i in range(2, 6)], "src string, dst string")
    s = {r["id"]: r["score"] for r in G.pagerank(star).collect()}
    assert s["T1"] > s["T2"] and s["T2"] == pytest.approx(0.15 / 5)
    chain = spark.createDataFrame([("A", "B"), ("B", "C"), ("A", "B")], "src string, dst string")
    s = {r["id"]: r["score"] for r in G.pagerank(chain).collect()}
    assert 0 < s["A"] < s["C"] and s["B"] == pytest.approx(0.05 + 0.85 * 0.05 / 2)


def test_chains(spark):
    d = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("p", "q"), ("q", "p")], "old string, new string")
    r = {x["old"]: x["final"] for x in G.chain_ends(d).collect()}
    assert r["a"] == r["b"] == r["c"] == "d" and r["x"] == "y" and set(r) == {"a", "b", "c", "x", "p", "q"}


def test_outline(spark):
    rows = [(1, "r", None, 1), (1, "a", "r", 2), (1, "b", "r", 3), (1, "c", "a", 4), (2, "s", None, 1), (2, "lost", "zz", 2)]
    d = spark.createDataFrame(rows, "conv_id int, id string, parent string, turn int")
    assert {(r["id"], r["path"]) for r in G.outline(d, "conv_id").collect()} == {("r", "1"), ("a", "1.1"), ("b", "1.2"), ("c", "1.1.1"), ("s", "1")}


def test_folds(spark):
    rng = random.Random(2)
    rows = [(i % 5, i, i, rng.random() < 0.7, rng.randrange(1, 3000), rng.choice([200, 429, 500]), rng.random()) for i in range(400)]
    d = spark.createDataFrame(rows, "job int, event_id int, t int, ok boolean, latency int, status int, quota double").withColumn("ts", F.timestamp_seconds("t"))
    got = {r["job"]: r for r in S.health(d).collect()}
    rate = {r["job"]: r["rate"] for r in S.request_rate(d).collect()}
    for j in range(5):
        lat, r = 0, 3
        for row in rows:
            if row[0] == j:
                lat = row[4] if lat == 0 else int(0.7 * lat + 0.3 * row[4])
                r = r // 2 if row[5] == 429 else r - 1 if row[5] >= 500 else r + 1 if row[6] > 0.5 else r - 1 if 0 < row[6] < 0.1 else r
                r = min(max(r, 1), 10)
        assert got[j]["latency"] == lat and rate[j] == r
    bucket = S.token_bucket(d, per_second=0.5).collect()
    assert all(b["n_now"] + b["n_waited"] == 80 for b in bucket) and len(bucket) == 5


def test_survivors_and_intervals(spark):
    d = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), ("c", 4)], "k string, t int")
    assert {r["k"] for r in S.survivors(d, "k", ["t"], 2).collect()} == {"a", "c"}
    e = spark.createDataFrame([("x", 0)] * 60 + [("y", 86400 * 3)] * 8 + [("z", 86400 * 30)], "j string, ago int").select("j", F.timestamp_seconds(F.lit(2_000_000_000) - F.col("ago")).alias("ts"))
    assert {r["j"]: r["interval"] for r in S.intervals(e, "j").collect()} == {"x": "every 10m", "y": "every 2h", "z": "skip"}


def test_row_diff(spark):
    t = lambda *x: spark.createDataFrame(list(x), "k int, a string, b string")
    got = {r["k"]: (r["status"], r["first"], r["all"]) for r in R.row_diff(t((1, "x", "y"), (2, " x", None), (3, "q", "q")), t((1, "z", "w"), (2, "x ", ""), (4, "", "")), "k", ("a", "b")).collect()}
    assert got == {1: ("differs", "a", "a,b"), 2: ("same", "", ""), 3: ("left_only", "", ""), 4: ("right_only", "", "")}


def test_neighbours(spark):
    rng = random.Random(6)
    rows = [("g", p) for p in sorted(rng.sample(range(2000), 300))] + [("h", 5)]
    got = {(r["g"], r["p"]): r["near"] for r in R.neighbours(spark.createDataFrame(rows, "g string, p int"), "g", "p", 5).collect()}
    assert got == {(g, p): sum(h == g and abs(q - p) <= 5 for h, q in rows) - 1 for g, p in rows}


def test_nearest_pairs(spark):
    names = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 9.0), (2, "d", 1.0)], "page int, name string, y double")
    values = spark.createDataFrame([(1, 10.0, 1.9), (1, 20.0, 3.0), (2, 30.0, 8.0)], "page int, value double, y double")
    assert {(r["name"], r["value"]) for r in R.nearest_pairs(names, values).collect()} == {("a", 10.0), ("b", 20.0)}


def test_pending(spark):
    d = spark.createDataFrame([("a",), ("",), ("b",)], "doi string")
    assert sorted(r["doi"] for r in R.pending(d, spark.createDataFrame([("",), ("b",)], "doi string"), "doi").collect()) == ["", "a"]


def test_nearest_memory(spark):
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    class Items:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    rng = np.random.default_rng(3)
    n, m, width = 3000, 6000, 8
    q, x = rng.integers(0, 3, (n, width)).astype(float), rng.integers(0, 3, (m, width)).astype(float)
    table = pa.table({"query": pa.array(np.arange(n)), "vec": pa.array(list(q), pa.list_(pa.float64()))})
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(list(x), pa.list_(pa.float64()))], names=["id", "vec"])
    run = M._block(Items(), table, 5, "euclid")
    tracemalloc.start()
    out = list(run(iter([batch.slice(0, 2500), batch.slice(2500)])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20
    got = np.array(out[0].column(1)).reshape(n, 5)
    for i in range(0, n, 100):  # squares are whole numbers: many ties, which go to the lower id
        assert got[i].tolist() == np.lexsort((np.arange(m), ((x - q[i]) ** 2).sum(1)))[:5].tolist()
