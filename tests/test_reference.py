"""References written in each of the known ways."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillstone.functions.reference import parse_reference


@pytest.mark.parametrize(
    "text, want",
    [
        ("秦叔逵, 等. 标题[J]. 中国杂志, 2020, 31(28):3501-3508", {"authors": "秦叔逵, 等", "title": "标题", "journal": "中国杂志", "year": "2020", "volume": "31", "issue": "28", "pages": "3501-3508"}),
        ("Bray F, et al. CA Cancer J Clin. 2024;74(3):229-263", {"journal": "CA Cancer J Clin", "year": "2024", "volume": "74", "issue": "3", "pages": "229-263"}),
        ("Qin S, et al. J Clin Oncol, 2013, 31(28): 3501-3508", {"journal": "J Clin Oncol", "volume": "31", "issue": "28"}),
        ("Finn R. Lancet, 2020; 391, 1163-1173", {"journal": "Lancet", "volume": "391", "pages": "1163-1173"}),
        ("Li X. Nature 52, 100-110 (2019)", {"journal": "Nature", "volume": "52", "pages": "100-110", "year": "2019"}),
        ("Wu A, et al. Envel vol. 3,4 (2018): 55", {"journal": "Envel", "volume": "3", "issue": "4", "year": "2018", "pages": "55"}),
        ("Xu B. Front Oncol, 2021, 11: e1234", {"journal": "Front Oncol", "pages": "e1234"}),
        ("Zhou C. Gut. 2017", {"journal": "Gut", "year": "2017", "kind": "literature"}),
        ("Sun D, et al. 2023 ESMO. Abstract 1494P", {"kind": "conference_abstract", "meeting": "ESMO", "abstract": "1494P", "authors": "Sun D, et al"}),
        ("Ma E. presented at 2022 CSCO", {"meeting": "CSCO", "meeting_year": "2022"}),
        ("Hu F. 2021 ASCO-GI Abstract 267", {"meeting": "ASCO-GI", "abstract": "267"}),
        ("nothing 1999 here", {"year": "1999", "authors": "", "kind": "literature"}),
        (None, {"year": "", "kind": "literature"}),
    ],
)
def test_references(spark, text, want):
    r = spark.range(1).select(parse_reference(F.lit(text).cast("string")).alias("x")).first()["x"]
    assert {k: r[k] for k in want} == want


def test_bytes_halves_to_even(spark):
    from quillstone.functions import ids

    df = spark.createDataFrame([(1536,), (2560,), (184832,), (1310720,), (1835008,), (1023,), (0,)], "n long").select(ids.format_bytes(F.col("n")).alias("x"))
    assert [r["x"] for r in df.collect()] == ["2 KB", "2 KB", "180 KB", "1.2 MB", "1.8 MB", "1023 B", "0 B"]
