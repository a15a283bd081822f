"""Readers, writers and streams on small files."""

from __future__ import annotations

import datetime
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstone.sources import files, records, views
from quillstone.streaming import stateful


def payloads(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "payload string")


def test_services(spark):
    oa = {"id": "https://openalex.org/W1", "title": " T ", "publication_year": 2020, "doi": "https://doi.org/10.1/x", "ids": {"pmid": "https://pubmed.ncbi.nlm.nih.gov/31535829"}, "cited_by_count": 4, "fwci": 1.5, "authorships": [{"author": {"display_name": "A B"}}], "primary_location": {"source": {"display_name": "J"}}, "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    nested = {**oa, "id": "https://openalex.org/W2", "abstract_inverted_index": {"inverted_index": {"x": [0]}}}
    s2 = {"paperId": "p", "title": "T", "abstract": "long", "tldr": {"text": "short"}, "externalIds": {"DOI": "10.1/x", "PubMed": "5"}, "citationCount": 3, "year": 2019, "venue": "V", "authors": [{"name": "C"}]}
    cr = {"DOI": "10.2/y", "title": ["U"], "author": [{"family": "D", "given": "E"}], "container-title": ["K"], "published": {"date-parts": [[2018, 3, 1]]}}
    xml = "<DocSum><Id>77</Id><Item Name='Title'>P</Item><Item Name='PubDate'>2017 Jan</Item><Item Name='Source'>Q</Item><Item Name='DOI'>10.3/z</Item></DocSum>"
    ct = {"protocolSection": {"identificationModule": {"nctId": "NCT01", "briefTitle": "S"}, "statusModule": {"startDateStruct": {"date": "2016-05"}}, "descriptionModule": {"briefSummary": "sum"}}}
    page = '<div class="gs_ri"><h3 class="gs_rt"><a href="https://doi.org/10.4/w?x">G</a></h3><div class="gs_a">F G - Journal, 2015</div><div class="gs_rs">snip</div><a>Cited by 12</a></div>'
    text = "1. First title\nA Smith, B Lee - J Test, 2020\nDOI: 10.1000/abc\n2. Second\nPMID: 123456\n"
    x = records.union({"openalex": payloads(spark, json.dumps(oa), json.dumps(nested)), "s2": payloads(spark, json.dumps(s2)), "crossref": payloads(spark, json.dumps(cr)), "pubmed": payloads(spark, xml), "registry": payloads(spark, json.dumps(ct)), "scholar": payloads(spark, page), "listing": payloads(spark, text)})
    got = {r["id"]: r for r in x.collect()}
    assert tuple(x.columns) == records.COLUMNS
    r = got["openalex:W1"]
    assert (r["title"], r["doi"], r["pmid"], r["abstract"], r["authors"], r["fwci"]) == ("T", "10.1/x", "31535829", "a b a", ["A B"], 1.5)
    assert got["openalex:W2"]["abstract"] == "x" and got["s2:p"]["abstract"] == "short" and got["s2:p"]["pmid"] == "5"
    assert (got["crossref:10.2/y"]["year"], got["pubmed:77"]["year"], got["pubmed:77"]["journal"], got["registry:NCT01"]["year"]) == (2018, 2017, "Q", 2016)
    g = next(v for k, v in got.items() if k.startswith("scholar"))
    assert (g["title"], g["journal"], g["year"], g["cited_by"], g["doi"]) == ("G", "Journal", 2015, 12, "10.4/w")
    assert got["listing:10.1000/abc"]["authors"] == ["A Smith", "B Lee"] and got["listing:123456"]["title"] == "Second"
    assert {o for r in records.union({"s2": payloads(spark, json.dumps(s2)), "pubmed": payloads(spark, xml)}, enabled={"s2"}).collect() for o in r["source_origin"]} == {"s2"}


def test_strict_table(spark, tmp_path):
    good = tmp_path / "t.csv"
    good.write_text("﻿" + ",".join(files.HEADER) + '\n1,2,"say ""hi"", x",r,10.1/x,k,p.pdf,l\n\n3,4,,,,,,\n', encoding="utf-8")
    rows = files.read_table(spark, str(good)).collect()
    assert [(r["page"], r["context"]) for r in rows] == [("1", 'say "hi", x'), ("3", "")]
    out = str(tmp_path / "out")
    files.write_table(files.read_table(spark, str(good)), out)
    assert sorted(r["page"] for r in files.read_table(spark, out).collect()) == ["1", "3"]
    for bad in ("a,b\n", ",".join(["x", *files.HEADER[1:]]) + "\n"):
        (tmp_path / "b.csv").write_text(bad, encoding="utf-8")
        with pytest.raises(ValueError, match="mismatch"):
            files.read_table(spark, str(tmp_path / "b.csv"))


def test_documents(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", "<w:p><w:r><w:t>One</w:t></w:r><w:r><w:t xml:space='x'> two </w:t></w:r></w:p>")
    with zipfile.ZipFile(tmp_path / "b.pptx", "w") as z:
        z.writestr("ppt/slides/slide2.xml", "<a:t>S2</a:t>")
        z.writestr("ppt/slides/slide1.xml", "<a:r><a:t>S1</a:t></a:r><a:t>more</a:t>")
        z.writestr("ppt/notesSlides/notesSlide1.xml", "<a:t>note</a:t>")
    (tmp_path / "c.html").write_text("<nav><p>menu</p></nav><h1>T</h1><p>a <b>b</b></p>")
    (tmp_path / "d.txt").write_text("p1\f \fp3")
    (tmp_path / "e.docx").write_text("no zip")
    got = {(r["path"].rpartition("/")[2], r["page"]): r["text"] for r in files.documents(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", 1): "One two", ("b.pptx", 1): "S1 more\n[NOTES: note]", ("b.pptx", 2): "S2", ("c.html", 1): "T\n\na b", ("d.txt", 1): "p1", ("d.txt", 3): "p3"}
    t = spark.createDataFrame([("x", "p1\f \fp3")], "path string, text string")
    assert [(r["page"], r["text"]) for r in files.pages(t).collect()] == [(1, "p1"), (3, "p3")]


def test_inventory(spark, tmp_path):
    good = b"%PDF-1.4\n1 0 obj\n<< /Type /Page >>\nendobj\nxref\ntrailer\nstartxref" + b" " * 80
    (tmp_path / "P5-7").mkdir()
    (tmp_path / "P5-7" / "x.pdf").write_bytes(good)
    (tmp_path / "P1-2_main.pdf").write_bytes(b"bad")
    (tmp_path / "other.pdf").write_bytes(good)
    assert {(r["pnx"], r["valid"]) for r in files.inventory(spark, str(tmp_path)).collect()} == {("P5-7", True), ("P1-2", False)}


def test_logs(spark, tmp_path):
    log = str(tmp_path / "log")
    files.append_log(spark.createDataFrame([("a", "ok"), ("", "ok")], "doi string, status string"), log)
    files.append_log(spark.createDataFrame([("b", "failed")], "doi string, status string"), log)
    x = spark.read.json(log)
    assert {r["doi"] for r in files.done(x).collect()} == {"a"} and {r["status"]: r["n"] for r in files.progress(x).collect()} == {"ok": 2, "failed": 1}


def test_sources_that_fail_while_read(spark):
    """One that cannot be opened and one that breaks while it is read are noted; the others go on."""
    good = payloads(spark, json.dumps({"paperId": "p", "title": "t", "year": 2020}))
    broken = spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit("{}")).alias("payload"))
    failed = []
    got = records.union({"s2": good, "pubmed": broken, "openalex": lambda: 1 / 0}, failed=failed)
    assert failed == ["openalex", "pubmed"] and [r["title"] for r in got.collect()] == ["t"]
    with pytest.raises(Exception, match="broken"):
        records.union({"pubmed": broken}, failed=[])


def test_adverse_events(spark):
    p = json.dumps({"events": [{"term": "n", "stats": [{"groupId": "1", "numAffected": 3}, {"groupId": "2", "numAffected": 4}]}, {"term": "m", "stats": [{"groupId": "1", "numAffected": 1}]}]})
    assert [tuple(r) for r in files.adverse_events(payloads(spark, p)).collect()] == [("n", 3, 4)]


def test_views_read_alike(spark):
    """Every view has rows."""
    for name in views.VIEWS:
        assert views.view(spark, "/root/testdata/sf0.001", name).limit(1).count() == 1, name


def test_streams(spark, tmp_path):
    day = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(i, day + datetime.timedelta(minutes=i), f"j{i % 2}", "e", i % 3 > 0, 100 + i) for i in range(60)]
    schema = "event_id int, ts timestamp, job string, event_type string, ok boolean, latency int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    counts = {r["job"]: (r["alpha"], r["beta"]) for r in stateful.settle(stateful.success_counts(stream())).collect()}
    assert counts == {"j0": (21, 11), "j1": (21, 11)}
    got = {r["job"]: r["latency"] for r in stateful.settle(stateful.health(stream())).collect()}
    lat = {}
    for r in rows:
        lat[r[2]] = r[5] if not lat.get(r[2]) else int(0.7 * lat[r[2]] + 0.3 * r[5])
    assert got == lat
    w = stateful.settle(stateful.window_counts(stream(), "10 minutes", "1 hour"))
    assert w.agg(F.sum("n")).first()[0] == 60
    assert stateful.settle(stateful.first_seen(stream(), ["job"], "1 hour"), "append").count() == 2
