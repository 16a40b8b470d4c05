"""Every registered query runs, equals its SQL twin, and avoids all-pairs and one-task plans."""
import re

import pytest

import __spark_entry__ as entry
from tools.check import connect, rows_of

QUERIES = entry.queries()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    df = QUERIES[name](spark, folder)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # A window over everything in one task is allowed only above a limit.
    assert not re.search(r"Window .*\n.*Exchange SinglePartition", plan) or "TakeOrderedAndProject" in plan
    got = df.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    result = duck.execute(sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, got) == rows_of(columns, result.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_type", "language", "n", "confidence"]


def test_names():
    assert set(entry.oracle_sql()) <= set(QUERIES)
    assert len(QUERIES) > 130
