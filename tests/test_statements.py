"""Every query of the core registry runs, and agrees with its statement where it has one."""

import pytest

from corpusmill.plans import all_queries

from .compare import duck, rows

REGISTRY = all_queries()


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(name, spark, small, con):
    got = REGISTRY.queries[name](spark, small)
    data = got.collect()
    if name in REGISTRY.sql:
        want = con.execute(REGISTRY.sql[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows(got.columns, data) == rows(names, want.fetchall())
    else:
        assert data, "a query without a statement must give rows here"
