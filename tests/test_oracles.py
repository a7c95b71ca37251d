"""Registered queries against their SQL twins; RASTERTAB_ORACLES=all runs every one of them."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import compare, connect

SF_DIR = os.environ.get("RASTERTAB_SF_DIR", "/root/testdata/sf0.001")
DEFAULT = (
    "flagship", "mt03", "mt13", "mt21", "au06", "au11_audit_splits", "ds02", "ds08", "st02", "st16_prepare_terrain", "tl05_mosaic",
    "tl09", "rg05", "rg12_outline_rings_across", "ca07", "rt05_shortest_distance_across", "ss2",
)
NAMES = [n for n in entry.queries() if os.environ.get("RASTERTAB_ORACLES") == "all" or n.startswith(DEFAULT)]


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    ok, note = compare(spark, duck, SF_DIR, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert ok, note


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
