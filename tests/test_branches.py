"""Every branch of the rules occurs in the registered queries, and the operators on planted rows."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_MID
from fundlake.functions import keys
from fundlake.operators import corpus, quality, rules
from fundlake.streaming import catalog_streams

Q = E.queries()


def _values(df, *cols):
    return {tuple(r) for r in df.select(*cols).distinct().collect()}


def test_every_audit_flag_occurs(spark):
    flags = {f for (f,) in _values(Q["rule_audit_findings"](spark, SF_MID), "flag_type")}
    assert flags == {"late_cycle_dumping", "preapproval_expired_reuse", "claim_density", "out_of_region"}


def test_audit_findings_on_planted_claims(spark):
    d = dt.date(2024, 6, 1)

    def claim(i, dealer, day, pa=None, region="A", venue="A", fy="FY24"):
        return (f"c{i}", dealer, fy, day, pa, region, venue)
    rows = [claim(i, "busy", d + dt.timedelta(days=i % 7)) for i in range(21)]
    rows += [claim(100 + i, "calm", d + dt.timedelta(days=i % 7)) for i in range(20)]
    rows += [claim(200, "p", d, "PA"), claim(201, "q", d + dt.timedelta(days=90), "PA"), claim(202, "q", d + dt.timedelta(days=91), "PA"), claim(203, "q", d + dt.timedelta(days=300), "PB")]
    rows += [claim(300, "v", d, venue="B"), claim(301, "v", d, region=None), claim(302, "v", d, venue=None)]
    rows += [claim(400 + i, "late", dt.date(2025, 1, 25) if i < 3 else d + dt.timedelta(days=20 * i)) for i in range(9)]
    rows += [claim(500 + i, "even", dt.date(2025, 1, 31) if i < 3 else d + dt.timedelta(days=20 * i)) for i in range(10)]  # 30 %: not above
    df = spark.createDataFrame(rows, "claim_id string, dealer_id string, fiscal_year string, submission_date date, preapproval_id string, region string, venue_region string")
    assert {tuple(r) for r in rules.audit_findings(df).collect()} == {
        ("claim_density", "busy", 21), ("preapproval_expired_reuse", "c202", 91), ("out_of_region", "c300", 1), ("late_cycle_dumping", "late FY24", 3)}
    assert rules.audit_findings(df.limit(0)).count() == 0


def test_every_event_limit_occurs(spark):
    r = Q["rule_event_limits"](spark, SF_MID)
    assert _values(r, "too_few") == {(True,), (False,)} and _values(r, "over_cap") == {(True,), (False,)}
    assert r.where("attendees = 0 AND per_head_usd IS NOT NULL").count() == 0


def test_event_checks_on_planted_events(spark):
    rows = [("ACT-10", 10, "1850", "AMERICA"), ("ACT-10", 10, "1850.01", "AMERICA"), ("ACT-10", 9, "1", "AMERICA"), ("ACT-10", 10, "9999", "ASIA"),
            ("ACT-07", None, None, None), ("ACT-09", 0, "5", "AMERICA"), ("ACT-10", 0, "5", "AMERICA"), (None, 1, "5", "AMERICA")]
    df = spark.createDataFrame([(i, a, n, Decimal(c) if c else None, r) for i, (a, n, c, r) in enumerate(rows)],
                               "i int, activity_type_id string, attendees int, event_cost_usd decimal(12,2), region string")
    got = [(r.too_few, r.over_cap) for r in rules.event_checks(df).orderBy("i").collect()]
    assert got == [(False, False), (False, True), (True, False), (False, False), (True, False), (False, False), (True, True), (False, False)]


def test_every_multiplier_and_the_cap_occur(spark):
    r = Q["rule_allocation_four_multipliers"](spark, SF_MID)
    for flag in ("reached_target", "on_brand", "first_pass", "initiative"):
        assert _values(r, flag) == {(True,), (False,)}, flag
    seen = {m for (m,) in _values(r, "multiplier")}
    assert max(seen) == Decimal("1.25") and min(seen) == 1


def test_multiplier_is_capped(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, True), (False, None)], "a boolean, b boolean")
    m = rules.performance_multiplier([(F.col("a"), "1.10"), (F.col("b"), "1.20")])
    assert [r[0] for r in df.select(m).collect()] == [Decimal("1.25"), Decimal("1.1"), Decimal("1.2"), Decimal(1)]


def test_every_brand_band_occurs(spark):
    r = Q["rule_brand_bands_by_points"](spark, SF_MID)
    assert {b for (b,) in _values(r, "brand_band")} == {label for _, label in rules.BRAND_BANDS}
    assert ("Auto-rejected", True) in _values(r, "brand_band", "capped")


def test_double_filings_and_program_years_occur(spark):
    assert _values(Q["double_dips_filed"](spark, SF_MID), "is_duplicate") == {(True,), (False,)}
    assert Q["quality_program_years_filed"](spark, SF_MID).count() > 0


def test_every_route_occurs(spark):
    routes = {"refuse", "metrics_marketing", "metrics_utilization", "ka"}
    r = Q["question_routes_in_words"](spark, SF_MID)
    assert {x for (x,) in _values(r, "route")} == routes
    assert _values(r.where("route = 'refuse'"), "user_role") == {("channel_mgr",)}
    assert {x for (x,) in _values(Q["chat_latency_by_route"](spark, SF_MID), "route")} == routes


def test_figures_in_and_out_of_range_occur(spark):
    assert _values(Q["eval_figures_in_range"](spark, SF_MID), "has_number_in_range") == {(True,), (False,)}


def test_dealers_expire_within_60_days(spark):
    assert Q["q_expiring_dealers_60_days"](spark, SF_MID).count() > 0


def test_key_parts(spark):
    df = spark.createDataFrame([("RGN-AMER-WEST-2", "PRG-FY26-NETZERO", "ACT-DIG-SEM"), ("RGN-EMEA-1", "PRG-1998-MAIN", "ACT-ABM-ENTERPRISE"),
                                ("RGN-X", "PRG-MAIN", "ACT-05"), ("", "PRG-26", "ACT-NEW-1"), (None, None, None)], "r string, p string, a string")
    got = [tuple(x) for x in df.select(keys.region_of(F.col("r")), keys.sub_region_of(F.col("r")), keys.program_fiscal_year(F.col("p")),
                                       keys.activity_category(F.col("a"))).collect()]
    assert got == [("AMER", "WEST-2", "FY26", "Digital"), ("EMEA", "1", "FY98", "Digital"), (None, None, None, None), (None, None, "FY26", None),
                   (None, None, None, None)]


def test_markdown_columns(spark):
    fields = {"title": "string", "version": "string", "expires": "date"}
    texts = ["---\ntitle: A: b\nversion: FY26.1\nexpires: 2027-02-28\n---\nbody\n---\nversion: 2\n", "---\r\ntitle:  t \r\nexpires: soon\r\n---\r\nversion: body\r\n",
             "no block\n---\ntitle: x\n---\n", "---\ntitle: open\n", "", None, "---\ntitle:\n---"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, md string")
    got = [tuple(r)[2:] for r in corpus.markdown_columns(df, fields).orderBy("i").collect()]
    assert got == [("A: b", "FY26.1", dt.date(2027, 2, 28), "body\n---\nversion: 2\n"), ("t", None, None, "version: body\r\n"),
                   (None, None, None, texts[2]), (None, None, None, texts[3]), (None, None, None, ""), (None, None, None, None), (None, None, None, "")]


def test_version_occurs_and_misses(spark):
    r = Q["corpus_markdown_files"](spark, SF_MID)
    assert r.where("version IS NULL").count() > 0 and r.where("version = 'none'").count() == 0 and r.where("version LIKE 'FY0%'").count() > 0


def test_fact_stream_over_several_batches(spark):
    bronze = spark.range(1000).select("id", (F.col("id") % 10 - 1).alias("amount")).repartition(9)
    r = catalog_streams.silver_stream(spark, bronze, lambda d: d.withColumn("twice", F.col("amount") * 2), {"positive": "amount > 0", "small": "id < 900"}, "planted")
    tagged = quality.tag_failures(bronze.withColumn("twice", F.col("amount") * 2), {"positive": "amount > 0", "small": "id < 900"})
    want = tagged.select("id", "amount", "twice", F.array_join("failed_rules", ",").alias("reason"))
    assert r.exceptAll(want).isEmpty() and want.exceptAll(r).isEmpty()
    # nine files and more batches than one
    assert r.count() == 1000 and len({f.split("_batch_id=")[1].split("/")[0] for f in r.inputFiles()}) >= 2


def test_every_fact_has_silver_and_quarantined_rows(spark):
    for name in ("stream_silver_claims", "stream_silver_allocations", "stream_silver_orders"):
        assert _values(Q[name](spark, SF_MID).select((F.col("reason") == "").alias("silver")), "silver") == {(True,), (False,)}, name


def test_density_alerts_occur(spark):
    r = Q["stream_density_alerts"](spark, SF_MID)
    assert r.count() > 0 and r.where(f"max_events <= {catalog_streams.DENSITY_LIMIT}").count() == 0


def test_calendar_follows_the_claims(spark):
    """K2: the quarter of a snapshot far outside the driver's years is known."""
    from fundlake.plans.model import Model
    m = Model(spark, SF_MID)
    m.silver.dom.__dict__["fiscal_years"] = spark.createDataFrame([(2031,), (2033,)], "fy int")
    r = m.dim_fiscal_calendar.agg(F.min("date_key"), F.max("date_key"), F.count_if(F.col("fiscal_quarter").isNull())).first()
    assert tuple(r) == (dt.date(2031, 3, 1), dt.date(2034, 2, 28), 0)
