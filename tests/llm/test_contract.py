"""Queries of the subpackage against their SQL, on the driver's smallest tables."""

from __future__ import annotations

import pytest

llm = pytest.importorskip("cuelake.llm.queries")

from tests.oracle import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.SQL))
def test_query_agrees_with_sql(spark, name):
    assert compare(spark, SF, name, duck(SF)) == ""


def test_every_operator_has_one_query():
    assert sorted(int(q[2:].split("_")[0]) for q in llm.QUERIES) == list(range(1, 14))
