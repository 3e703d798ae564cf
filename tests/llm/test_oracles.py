from __future__ import annotations

import __spark_entry__ as entry
import pytest
from oracle import compare, connect

from holdscope.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    ok, message, _ = compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name])
    assert ok, message


def test_one_query_per_operator():
    names = entry.queries()
    assert all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
