"""Every registered query against its DuckDB twin at sf0.001 (order-insensitive)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import rows_of  # noqa: E402
from plan_report import BAD, plan_text  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

QUERIES = E.queries()
SQL = E.oracle_sql()


def _assert_scalable_plan(df):
    text = plan_text(df)
    assert not [b for b in BAD if b in text], "plan has a cartesian/nested-loop join or a row-at-a-time UDF"


def test_every_query_has_callable():
    assert QUERIES, "no registered queries"
    for name in SQL:
        assert name in QUERIES


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 0
    assert df.columns == ["region", "unused_usd", "util_pct"]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF_SMALL)
    _assert_scalable_plan(df)
    cols = df.columns
    srows = df.collect()
    res = duck.execute(SQL[name])
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    assert sorted(cols) == sorted(dcols)
    assert rows_of(cols, srows) == rows_of(dcols, drows)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_oracle(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    _assert_scalable_plan(df)
    assert df.count() >= 0
