"""Every registered query with an oracle equals DuckDB on the same parquet."""
import pytest

import __spark_entry__ as E
from gearlens.plans.oracle_check import compare, duck
from conftest import SF_CHECK

ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, con, name):
    r = compare(spark, con, name, E.queries()[name], ORACLE[name], SF_CHECK)
    assert r["names_match"], r
    assert not r["type_mismatches"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["values_match"], r


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["inspection_date", "n_inspections", "rolling_mean", "rolling_std"]
    assert df.count() > 0
