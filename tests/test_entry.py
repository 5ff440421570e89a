import duckdb
import pytest

import __spark_entry__ as entry
from strandframe import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_flagship(spark):
    assert entry.entry(spark).columns == ["count", "total", "frac"] and entry.entry(spark).count() == 1


def test_names():
    assert set(core.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query_equals_its_sql(spark, name):
    got = core.QUERIES[name](spark, DATA)
    if name not in core.SQL:
        assert got.count() > 0
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    made = con.sql(core.SQL[name])
    assert sorted(got.columns) == sorted(made.columns)
    order = sorted(got.columns)
    want = sorted(str(r) for r in made.project(", ".join(f'"{c}"' for c in order)).fetchall())
    assert sorted(str(tuple(r)) for r in got.select(*order).collect()) == want


def test_plans_push_down(spark):
    """Spans and columns reach the scan; a count doesn't read headers or qualities."""
    plan = core.QUERIES["grep_span"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(idx,100)" in plan and "LessThan(idx,5000)" in plan
    plan = core.QUERIES["grep_frac"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<s_seq:string,x_seq:string>" in plan
