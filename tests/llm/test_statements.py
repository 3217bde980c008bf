"""Queries of the subpackage against their statements."""

import pytest

from corpusmill.llm.queries import REGISTRY

from ..compare import duck, rows


@pytest.mark.parametrize("name", sorted(REGISTRY.sql))
def test_query(name, spark, small):
    got = REGISTRY.queries[name](spark, small)
    want = duck(small).execute(REGISTRY.sql[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


def test_every_query_gives_rows(spark, small):
    assert all(not f(spark, small).isEmpty() for k, f in REGISTRY.queries.items() if k not in REGISTRY.sql and k not in ("p3_templates", "p6_found"))
