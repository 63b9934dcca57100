"""Invariants of the gold facts and operators on the driver data (sf0.001)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from fundlake.operators import quality
from fundlake.plans.model import Model
from tools.oracle_check import rows_of


def test_utilization_identities(spark):
    u = Model(spark, SF_SMALL).utilization
    bad = u.filter(
        (F.col("allocated_usd") != F.col("unused_usd") + F.least("committed_usd", "allocated_usd"))
        | (F.col("forfeited_usd") > F.col("unused_usd"))
        | (F.col("expected_forfeit_usd") > F.col("unused_usd"))
        | (F.col("expected_forfeit_usd") < 0)
        | (F.col("paid_usd") > F.col("approved_usd"))
        | (F.col("approved_usd") > F.col("committed_usd")))
    assert bad.count() == 0


def test_rule_pass_plus_fail_is_input(spark):
    m = Model(spark, SF_SMALL)
    raw = m.dom.dirty_claims
    n = raw.count()
    for r in quality.rule_metrics(raw, quality.CLAIM_STREAM_RULES).collect():
        assert r.passed + r.failed == n
    clean, bad = quality.split_quarantine(raw, quality.CLAIM_STREAM_RULES)
    assert clean.count() + bad.count() == n


def test_scd2_intervals_do_not_overlap(spark):
    h = E.queries()["scd2_dealer_history"](spark, SF_SMALL)
    w = Window.partitionBy("account_id").orderBy("effective_from")
    x = h.withColumn("next_from", F.lead("effective_from").over(w))
    assert x.filter(F.col("effective_to").isNull() & F.col("next_from").isNotNull()).count() == 0
    assert x.filter(F.col("next_from") < F.col("effective_to")).count() == 0
    assert x.filter(F.col("effective_from") >= F.coalesce("effective_to", F.lit("9999-12-31").cast("date"))).count() == 0
    assert h.groupBy("account_id").agg(F.count_if("is_current").alias("c")).filter("c > 1").count() == 0


def test_results_independent_of_partitioning(spark):
    """Order independence: the same question with 3 and 11 shuffle partitions."""
    q = E.queries()["q_at_risk_dealers"]
    prev = spark.conf.get("spark.sql.shuffle.partitions")
    out = []
    try:
        for n in ("3", "11"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            df = q(spark, SF_SMALL)
            out.append(rows_of(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", prev)
    assert out[0] == out[1]


def test_lift_controls_are_untreated_same_cell(spark):
    from fundlake.operators import lift
    m = Model(spark, SF_SMALL)
    dm = lift.dealer_months(m.dealer_performance, m.dealer_flat, m.silver.coop_claim)
    pairs = lift.matched_pairs(dm, 5)
    c = dm.select(F.col("dealer_id").alias("c_dealer"), "month", "region", "tier", "treated")
    j = pairs.join(c, ["c_dealer", "month", "region", "tier"], "left")
    assert j.filter(F.col("treated").isNull() | F.col("treated")).count() == 0
    assert pairs.groupBy("region", "tier", "month", "t_dealer").count().filter("count > 5").count() == 0
