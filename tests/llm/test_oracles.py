"""Queries with a DuckDB statement, row by row."""

import pytest

registry = pytest.importorskip("gearlens.llm.registry")

from gearlens.plans import oracle_check  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, name):
    con = oracle_check.duck(SF_SMALL)
    res = oracle_check.compare(spark, con, name, registry.QUERIES[name], registry.ORACLE[name], SF_SMALL)
    assert res["names_match"] and not res["type_mismatches"] and res["values_match"], res
