"""Answers that both engines once got wrong alike: keys beyond their padding, fiscal order, snapshots."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fundlake.functions import fiscal
from fundlake.operators import sinks, windows
from fundlake.session import checkpoint_root, path_exists
from fundlake.sources.domain import dealer_key, padded
from fundlake.streaming.catalog_streams import replay_order


@pytest.mark.parametrize(("n", "width", "want"), [(7, 6, "000007"), (999_999, 6, "999999"), (1_000_000, 6, "1000000"), (10_000_001, 6, "10000001"),
                                                  (99_999_999, 8, "99999999"), (100_000_000, 8, "100000000"), (None, 6, None)])
def test_padding_never_cuts(spark, duck, n, width, want):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(padded(F.col("n"), width)).first()[0] == want
    assert df.select(dealer_key(F.col("n"))).first()[0] == (None if n is None else f"D-{n:06d}")
    if n is not None:
        assert duck.execute(f"SELECT printf('%0{width}d', CAST({n} AS BIGINT))").fetchone()[0] == want


def test_prior_year_across_the_century(spark):
    df = spark.createDataFrame([("FY98", 1), ("FY99", 2), ("FY00", 3), ("FY01", 4)], "fiscal_year string, x int")
    r = windows.with_prior(df.withColumn("fy", fiscal.fy_number("fiscal_year")), [], "fy", "x").collect()
    assert {x.fiscal_year: x.prior_x for x in r} == {"FY98": None, "FY99": 1, "FY00": 2, "FY01": 3}


def test_snapshots_stand_side_by_side(spark):
    path = checkpoint_root(spark, "snapshots")
    assert not path_exists(spark, path)
    for day, x in (("2001-01-01", 1), ("2001-01-02", 2), ("2001-01-01", 3)):
        sinks.write_partitioned(spark.createDataFrame([(x, day)], "x int, date_key string"), path, ["date_key"])
    assert sorted(r.x for r in spark.read.parquet(path).collect()) == [2, 3]


def test_replay_keeps_every_year():
    assert sorted(replay_order([1995, 1996, 1998, 2000, 2004])) == [1995, 1996, 1998, 2000, 2004]
