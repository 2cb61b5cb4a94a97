"""Every registered query against its DuckDB oracle (the driver's gate)."""

import pytest

from paths import SF001, SF0001
from oracle_compare import check_key, duck
from switchyard.plans.catalog import ORACLES, QUERIES

_CON = {}


def _con(sf):
    if sf not in _CON:
        _CON[sf] = duck(sf)
    return _CON[sf]


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle_sf001(spark, key):
    ok, msg, _ = check_key(spark, key, SF001, _con(SF001))
    assert ok, msg


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_matches_oracle_sf0001(spark, key):
    ok, msg, _ = check_key(spark, key, SF0001, _con(SF0001))
    assert ok, msg


def test_every_key_has_oracle_or_is_listed():
    rows_only = set(QUERIES) - set(ORACLES)
    assert rows_only == {"src_file_inventory"}


def test_entry_smoke(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["check", "side", "entity", "measure", "message"]
