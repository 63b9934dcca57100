"""Planted-answer tests: workflow updates, saved views, governance masks."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from fundlake.operators import governance, workflow
from fundlake.plans import metrics
from fundlake.plans.model import Model
from tools.oracle_check import rows_of


def _reviews(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame(
        [("C1", "D1", "Pending", Decimal("10.00"), t, None, t), ("C2", "D1", "Approved", Decimal("5.00"), t, t, t),
         ("C3", "D2", "Pending", Decimal("7.00"), t, None, t)],
        "claim_id string, dealer_id string, status string, requested_amount_usd decimal(12,2), created_at timestamp, "
        "decision_at timestamp, updated_at timestamp")


def test_guarded_update_and_idempotency(spark):
    rv = _reviews(spark)
    t2, t3 = dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 3)
    dec = spark.createDataFrame(
        [("C1", "Approve", t2, "U1"), ("C1", "Reject", t3, "U2"), ("C2", "Reject", t2, "U1"), ("C9", "Approve", t2, "U1")],
        "claim_id string, decision string, decided_at timestamp, user_id string")
    out = {r.claim_id: (r.old_status, r.new_status, r.was_idempotent, r.applied)
           for r in workflow.apply_decisions(rv, dec).collect()}
    assert out == {"C1": ("Pending", "Approved", False, True),     # earliest decision wins
                   "C2": ("Approved", "Approved", True, False),    # terminal: no-op
                   "C9": (None, None, False, False)}               # unknown claim: nothing to update
    nxt = {r.claim_id: r.status for r in workflow.next_reviews(rv, workflow.apply_decisions(rv, dec)).collect()}
    assert nxt == {"C1": "Approved", "C2": "Approved", "C3": "Pending"}


def test_insert_if_absent_and_upsert(spark):
    target = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    rows = spark.createDataFrame([("b", 20), ("c", 3)], "k string, v int")
    assert sorted(tuple(r) for r in workflow.insert_if_absent(target, rows, ["k"]).collect()) == [
        ("a", 1), ("b", 2), ("c", 3)]
    t = spark.createDataFrame([("a", 1, 1), ("b", 2, 5)], "k string, v int, ts int")
    u = spark.createDataFrame([("a", 10, 2), ("b", 20, 4)], "k string, v int, ts int")
    assert sorted(tuple(r) for r in workflow.upsert(t, u, ["k"], "ts").collect()) == [("a", 10, 2), ("b", 2, 5)]


def test_call_hash_and_campaign_code(spark):
    df = spark.createDataFrame([("U1", ["D2", "D1"], "T", dt.date(2027, 1, 31)),
                                ("U1", ["D1", "D2"], "T", dt.date(2027, 1, 31))],
                               "u string, ids array<string>, t string, d date")
    h = [r.h for r in df.select(workflow.call_hash(F.col("u"), F.col("ids"), F.col("t"), F.col("d")).alias("h")).collect()]
    assert h[0] == h[1] and len(h[0]) == 64
    code = df.select(workflow.campaign_code(F.lit("2026-11-05").cast("date"), F.lit(h[0])).alias("c")).first().c
    assert code == f"nudge-202611-{h[0][:6]}"


def test_saved_view_runs_like_a_metric_query(spark):
    m = Model(spark, SF_SMALL)
    payload = {"view": "coop_program_metrics", "dims": ["region"], "measures": ["unused_usd", "paid_usd"],
               "filters": [["fiscal_year", "=", "FY01"]]}
    a = metrics.run_saved_view(m, payload)
    b = metrics.query(m, "coop_program_metrics", ["region"], ["unused_usd", "paid_usd"], where={"fiscal_year": "FY01"})
    assert rows_of(a.columns, a.collect()) == rows_of(b.columns, b.collect())
    with pytest.raises(metrics.MetricError):
        metrics.run_saved_view(m, {"view": "coop_program_metrics", "dims": ["nope"]})


def test_mask_and_row_filter(spark):
    df = spark.createDataFrame([("dealer", "D1", "R1", "REP-1"), ("rmd", "D2", "R2", "REP-2")],
                               "role string, dealer_id string, region_id string, sales_rep_id string")
    masked = {r.dealer_id: r.sales_rep_id for r in governance.mask_columns(df, "role", {"sales_rep_id": ["dealer"]}).collect()}
    assert masked == {"D1": None, "D2": "REP-2"}
    facts = df.select("dealer_id", "region_id")
    assert governance.row_filter(facts, "director").count() == 2
    assert [r.dealer_id for r in governance.row_filter(facts, "rmd", region_id="R2").collect()] == ["D2"]
    assert [r.dealer_id for r in governance.row_filter(facts, "dealer", dealer_id="D1").collect()] == ["D1"]
    assert governance.row_filter(facts, "guest").count() == 0
