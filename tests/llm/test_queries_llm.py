"""Registered queries against their SQL, and the parts that have no SQL against plain replays."""

import pytest

import __spark_entry__ as entry
from compare import compare, oracle
from vigil.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, message, rows, _ = compare(name, spark, oracle(SF), SF)
    assert ok, message


def test_all_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)}
