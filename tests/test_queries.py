"""Every registered query outside llm against its SQL, over whole tables of the smallest scale."""

import pytest

from corpusloom.plans import engine, problems
from tools_compare import connect, rows_of

DATA = "/root/testdata/sf0.001"
ALL = {n: (f, m.ORACLE.get(n)) for m in (problems, engine) for n, f in m.QUERIES.items()}


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", list(ALL))
def test_query(spark, duck, name):
    f, sql = ALL[name]
    df = f(spark, DATA)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        assert got
        return
    cur = duck.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert got == rows_of(columns, cur.fetchall())
