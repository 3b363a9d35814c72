"""Every query key against its DuckDB oracle at sf0.001 (the driver's gate
runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_check import compare

KEYS = sorted(E._QUERIES)


def test_every_key_has_an_oracle():
    missing = set(E._QUERIES) - set(E.oracle_sql())
    assert missing == set()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert sorted(df.columns) == sorted(["topic", "municipio", "prefeitura", "empresa", "ano", "mes", "url"])
    assert df.count() == 8617


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck, key):
    ok, n, _, detail = compare(spark, duck, key, E.queries()[key], E.oracle_sql()[key], SF_SMALL)
    assert ok, detail
