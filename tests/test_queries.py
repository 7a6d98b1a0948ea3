"""Every registered query with an oracle text must give the same rows at the smallest scale."""

import pytest

import __spark_entry__ as entry
from vigil import catalog
from compare import compare, oracle
from conftest import SF

NAMES = sorted(catalog.oracles())


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    ok, message, rows, _ = compare(name, spark, con, SF)
    assert ok, message


def test_stream_equals_batch(spark):
    queries = entry.queries()
    batch = queries["j1_packet_verdicts"](spark, SF).select("packet_id", "rule_name").collect()
    stream = queries["j1_stream_verdicts"](spark, SF).select("row_id", "rule_name").collect()
    assert sorted(map(tuple, batch)) == sorted(map(tuple, stream))
    fires = queries["f1_all_fires"](spark, SF).select("src_ip", "event_id").collect()
    live = queries["g4_stream_thresholds"](spark, SF).select("key", "row_id").collect()
    assert sorted(map(tuple, fires)) == sorted(map(tuple, live))


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and rows[0]["mitre_technique"] == "T1110"
