"""Serving mode: questions over the refreshed (written, partitioned) silver/gold tables
return exactly what the from-raw plans return."""

import tempfile

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from fundlake.plans.model import TABLES_CONF
from fundlake.plans.refresh import refresh
from tools.oracle_check import rows_of

NAMES = ["q_forfeiture_risk_region", "q_at_risk_dealers", "q_allocated_paid_by_region", "q_cycle_time_by_tier",
         "q_top_activities_roi", "q_monthly_revenue_by_tier", "q_region_home", "q_finance_home",
         "lift_matched_control_summary", "workflow_effective_status", "rule_sla_breaches", "forfeiture_rollup"]


@pytest.fixture(scope="module")
def refreshed(spark):
    out = tempfile.mkdtemp(prefix="fundlake-served-")
    refresh(spark, SF_SMALL, out)
    return out


@pytest.mark.parametrize("name", NAMES)
def test_served_equals_computed(spark, refreshed, name):
    q = E.queries()[name]
    computed = q(spark, SF_SMALL)
    a = rows_of(computed.columns, computed.collect())
    spark.conf.set(TABLES_CONF, refreshed)
    try:
        served = q(spark, SF_SMALL)
        b = rows_of(served.columns, served.collect())
    finally:
        spark.conf.unset(TABLES_CONF)
    assert a == b


@pytest.fixture(scope="module")
def refreshed_twice(spark):
    out = tempfile.mkdtemp(prefix="fundlake-served-")
    refresh(spark, SF_SMALL, out, as_of="2001-04-01")
    refresh(spark, SF_SMALL, out)
    return out


@pytest.mark.parametrize("name", ["q_finance_home", "q_dealer_home", "forfeiture_yoy", "rule_extension_candidates", "top_dealers_by_region",
                                  "q_region_home", "snapshot_change_feed"])
def test_served_reads_the_latest_of_two_snapshots(spark, refreshed_twice, name):
    assert spark.read.parquet(f"{refreshed_twice}/gold/fact_coop_utilization_daily").select("date_key").distinct().count() == 2
    test_served_equals_computed(spark, refreshed_twice, name)
