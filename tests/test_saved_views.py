"""Saved views: payloads judged one by one, upserts by user and name, runs from the stored row."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fundlake.plans import metrics, saved_views
from fundlake.plans.model import Model

PAYLOADS = [
    ('{"metric_view": "forfeiture_risk", "group_by": ["region"], "measures": ["unused_balance_usd"]}', None),
    (' {"metric_view": "forfeiture_risk", "measures": ["unused_balance_usd"], "extra": 1}', None),
    (None, "malformed"), ("", "malformed"), ("no json", "malformed"), ('["forfeiture_risk"]', "malformed"),
    ('{"metric_view": "forfeiture_risk", "group_by": "region", "measures": ["unused_balance_usd"]}', "malformed"),
    ('{"metric_view": "forfeiture_risk", "group_by": ["region"]', "malformed"),
    ("{}", "unknown_view"), ('{"metric_view": null, "group_by": ["region"]}', "unknown_view"), ('{"metric_view": "sales"}', "unknown_view"),
    ('{"metric_view": "forfeiture_risk"}', "nothing_asked"), ('{"metric_view": "forfeiture_risk", "group_by": [], "measures": []}', "nothing_asked"),
    ('{"metric_view": "forfeiture_risk", "group_by": ["region", "colour"]}', "unknown_dimension"),
    ('{"metric_view": "forfeiture_risk", "group_by": [null]}', "unknown_dimension"),
    ('{"metric_view": "forfeiture_risk", "group_by": ["region"], "filters": [{"dim": "colour", "value": "red"}]}', "unknown_dimension"),
    ('{"metric_view": "forfeiture_risk", "measures": ["net_revenue_usd"]}', "unknown_measure"),
    ('{"metric_view": "forfeiture_risk", "group_by": ["tier"], "filters": [{"dim": "tier"}]}', "filter_without_value")]


def test_every_payload_is_judged(spark):
    df = spark.createDataFrame([(i, p, "x") for i, (p, _) in enumerate(PAYLOADS)], "i int, payload string, more string")
    got = {r.i: r.refused for r in saved_views.checked(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(PAYLOADS)}
    assert saved_views.checked(df.limit(0)).collect() == []


def test_the_last_accepted_save_counts(spark):
    a, b, bad = PAYLOADS[0][0], PAYLOADS[1][0], "{}"
    rows = [("u", "v", 1, a), ("u", "v", 3, b), ("u", "v", 3, b), ("u", "v", 9, bad), ("u", "w", 2, a), ("u", "x", 1, bad), (None, "v", 1, a)]
    s = saved_views.stored(spark.createDataFrame(rows, "user_id string, name string, at int, payload string"), ["at"])
    got = {(r.user_id, r.name): (r.at, r.payload, r.n_saves) for r in s.collect()}
    assert got == {("u", "v"): (3, b, 3), ("u", "w"): (2, a, 1), (None, "v"): (1, a, 1)}
    assert s.select("view_id").distinct().count() == 3


def test_a_stored_view_runs_from_its_row(spark):
    m = Model(spark, SF_SMALL)
    payload = '{"metric_view": "forfeiture_risk", "group_by": ["region", "region"], "measures": ["unused_balance_usd"], "filters": [{"dim": "tier", "value": "Gold"}]}'
    views = spark.createDataFrame([("u", "v", payload), ("u", "old", '{"metric_view": "gone", "measures": ["x"]}')], "user_id string, name string, payload string")
    got = saved_views.run_stored(m, views, "u", "v")
    want = metrics.query(m, "forfeiture_risk", ["region"], [], where=[("tier", "Gold")])
    assert got.columns == ["region", "unused_balance_usd"] and got.count() == want.count() > 0
    for name in ("none", "old"):
        with pytest.raises(LookupError):
            saved_views.run_stored(m, views, "u", name)


def test_checks_stay_in_one_stage(spark):
    df = spark.createDataFrame([("{}",)], "payload string").repartition(2)
    text = saved_views.checked(df).select(F.col("refused"))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1 and "Python" not in text
