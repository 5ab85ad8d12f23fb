"""Queries against their SQL, and that all are there."""

import pytest

import __spark_entry__ as entry_points
from ablatrix.llm.catalog import CATALOG, ORACLES
from compare import connect, differences


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(name, spark, sf_dir):
    assert differences(CATALOG[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def test_all_registered():
    names = entry_points.queries()
    assert "pipeline" in names
    assert {n.split("_")[0] for n in CATALOG} == {f"op{i}" for i in range(1, 14)}
