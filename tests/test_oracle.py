"""Every registered engine query that SQL can express, against DuckDB on the same tables."""

import pytest

from quillon.plans.queries import QUERIES


def rows(frame, columns):
    return sorted(tuple(str(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_sql(spark, sf, duck, name):
    query, sql = QUERIES[name]
    got, want = query(spark, sf).toPandas(), duck.execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got, sorted(got.columns)) == rows(want, sorted(got.columns))


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name][0](spark, sf).count() > 0
