"""The contract is complete, and a few of its queries agree with their SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


@pytest.mark.parametrize("name", ["P1_device_risk", "A6_decode_record", "F3_time_folds", "H9_approval", "G3_drift_report"])
def test_query_equals_sql(spark, sf, name):
    ok, note = compare(spark, connect(sf), name, sf)
    assert ok, note


def test_flagship(spark):
    assert not entry.entry(spark).isEmpty()
