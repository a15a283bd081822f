"""Steps of long expressions stand once in the plan, so that each is worked out once a row."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    ("name", "piece", "most"),
    [("reference_fields", r"(?i)^(\D*?)(?:\bvol", 1), ("slide_numbers", "rate ", 1), ("point_alignment", "%+$", 1), ("highlight_audit", "ORCID", 3), ("highlight_audit", "Join", 0), ("forbidden_overlaps", "Medical\\s+Center", 1)],
)
def test_steps_stand_once(spark, name, piece, most):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(piece) <= most
