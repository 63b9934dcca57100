"""Program rules as set-based checks.

Rule tables (eligibility, co-fund shares, brand bands) are small fixed code lists
joined by broadcast; everything else is a projection or an aggregate over the
facts.  Business-day arithmetic uses the calendar spine's prefix index (an equi
join on the date), never a per-row loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Per activity number 0..21 -- co-fund share (%) and the tiers allowed
# where the activity is restricted (all tiers otherwise).
COFUND_PCT = [50, 50, 50, 50, 50, 50, 50, 60, 60, 50, 50, 50, 50, 60, 60, 50, 50, 50, 50, 50, 50, 40]
RESTRICTED_TIERS = {4: ["Gold", "Platinum"], 6: ["Platinum", "Gold"], 10: ["Gold", "Platinum"],
                    12: ["Gold", "Platinum"]}
# regional override: in AMERICA, activity 4 is open to Silver/Authorized below this amount
REGIONAL_OVERRIDE = {"region": "AMERICA", "activity": 4, "tiers": ["Silver", "Authorized"], "below_usd": 2500}
# brand score bands: (lower bound, label), highest first; five dimensions and their points
BRAND_BANDS = [(85, "Approved"), (70, "Approved with notes"), (50, "Remediation required"), (0, "Auto-rejected")]
BRAND_DIMENSIONS = [("logo", 20), ("color", 20), ("typography", 15), ("imagery", 20), ("voice", 25)]
# allocation formula: tier base, percent of prior-year sell-in, multipliers and cap
TIER_BASE = {"Platinum": 200000, "Gold": 80000, "Silver": 25000, "Authorized": 8000}
TIER_SELL_IN_PCT = {"Platinum": "0.015", "Gold": "0.010", "Silver": "0.005", "Authorized": "0"}
MULT_TARGET, MULT_BRAND, MULT_FIRST_PASS, MULT_NETZERO, MULT_CAP = "1.10", "1.05", "1.05", "1.10", "1.25"
# FY-end outcome by status
FY_END_OUTCOME = {"Draft": "forfeit", "Submitted": "protected", "Under_Review": "protected",
                  "Approved": "protected", "Paid": "disbursed", "Rejected": "released", "Expired": "forfeit"}
# deadlines as (month, day) before the fiscal-year end; stage SLAs in business days
DEADLINE_SUBMIT = (1, 31)
DEADLINE_PROOF = (2, 14)
DEADLINE_DECISION = (2, 21)
SLA_BRAND_BD, SLA_CMM_BD = 3, 5
SLA_REVIEW_BD = 8        # brand review (3) + CMM review (5)
SLA_FINANCE_BD = 10
# events: attendees that a local, design or hospitality event needs; spend per attendee of hospitality in AMERICA
EVENT_MINIMUM_ACTIVITIES, EVENT_MINIMUM = [7, 8, 10], 10
HOSPITALITY = {"region": "AMERICA", "activity": 10, "per_head_usd": 185}
# audit: share of a year's claims in the last week of January (%), days a pre-approval holds, claims in seven days
AUDIT_WINDOW_PCT, AUDIT_PREAPPROVAL_DAYS, AUDIT_DENSITY = 30, 90, 20
FORCE_MAJEURE_CAP = "0.30"
EXTENSION_EXPIRY = (4, 30)


def activity_rules(spark: SparkSession) -> DataFrame:
    """Fixed rule table keyed by activity id (22 rows, broadcast)."""
    rows = [(f"ACT-{i:02d}", COFUND_PCT[i], RESTRICTED_TIERS.get(i)) for i in range(len(COFUND_PCT))]
    return spark.createDataFrame(rows, "activity_type_id string, cofund_pct int, allowed_tiers array<string>")


def eligibility(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """O1 + O2: eligible unless the tier is outside a restricted activity's list; the
    regional override row wins where it applies."""
    j = claims.join(F.broadcast(rules), "activity_type_id", "left")
    o = REGIONAL_OVERRIDE
    override = ((F.col("region") == o["region"]) & (F.col("activity_type_id") == f"ACT-{o['activity']:02d}")
                & F.col("tier").isin(o["tiers"]) & (F.col("requested_amount_usd") < o["below_usd"]))
    restricted_ok = F.col("allowed_tiers").isNull() | F.array_contains("allowed_tiers", F.col("tier"))
    eligible = restricted_ok | override
    return j.withColumn("eligible", eligible).withColumn(
        "eligibility_reason", F.when(eligible, F.lit(None)).otherwise(F.lit("TIER_INELIGIBLE")))


def cofund_split(claims: DataFrame, rules: DataFrame) -> DataFrame:
    """O3: program share = pct of the requested amount; dealer share = the rest."""
    j = claims.join(F.broadcast(rules.select("activity_type_id", "cofund_pct")), "activity_type_id", "left")
    prog = (F.col("requested_amount_usd") * F.col("cofund_pct").cast("decimal(5,0)") * F.lit("0.01").cast("decimal(3,2)"))
    prog = prog.cast("decimal(14,2)")
    return j.withColumn("program_share_usd", prog).withColumn(
        "dealer_share_usd", (F.col("requested_amount_usd") - F.col("program_share_usd")).cast("decimal(14,2)"))


def rejection_code(missing_preapproval: Column, ineligible: Column, score: Column, out_of_region: Column,
                   doc_incomplete: Column, double_dip: Column) -> Column:
    """First matching reason in precedence order."""
    return (F.when(missing_preapproval, F.lit("MISSING_PREAPPROVAL")).when(ineligible, F.lit("TIER_INELIGIBLE"))
            .when(score < 50, F.lit("OFF_BRAND")).when(out_of_region, F.lit("OUT_OF_REGION"))
            .when(doc_incomplete, F.lit("DOC_INCOMPLETE")).when(double_dip, F.lit("DOUBLE_DIP"))
            .otherwise(F.lit("OTHER")))


def brand_breakdown(score: Column) -> Column:
    """Five dimension points from an overall score (proportional, integer, sums to score)."""
    parts = []
    used = None
    for i, (name, pts) in enumerate(BRAND_DIMENSIONS):
        if i < len(BRAND_DIMENSIONS) - 1:
            p = F.floor(score * pts / 100).cast("int")
        else:
            p = (score - used).cast("int")
        used = p if used is None else used + p
        parts.append(p.alias(name))
    return F.struct(*parts)


def brand_band(breakdown_json: Column) -> Column:
    """overall = sum of dimensions, capped at 49 when a dimension is under half its points."""
    dims = [F.get_json_object(breakdown_json, f"$.{n}").cast("int") for n, _ in BRAND_DIMENSIONS]
    total = sum(dims[1:], dims[0])
    weak = None
    for d, (_, pts) in zip(dims, BRAND_DIMENSIONS):
        c = d * 2 < pts
        weak = c if weak is None else (weak | c)
    score = F.when(weak, F.least(total, F.lit(49))).otherwise(total)
    band = None
    for lo, label in BRAND_BANDS:
        band = F.when(score >= lo, F.lit(label)) if band is None else band.when(score >= lo, F.lit(label))
    return F.struct(score.alias("brand_score"), band.alias("brand_band"))


def business_days_between(df: DataFrame, bd_index: DataFrame, start: str, end: str, out: str) -> DataFrame:
    """Business days in (start, end] via two equi-joins to the calendar prefix index."""
    s = bd_index.select(F.col("date_key").alias("__ds"), F.col("bd_index").alias("__bs"))
    e = bd_index.select(F.col("date_key").alias("__de"), F.col("bd_index").alias("__be"))
    j = (df.join(F.broadcast(s), F.col(start) == F.col("__ds"), "left")
         .join(F.broadcast(e), F.col(end) == F.col("__de"), "left"))
    return j.withColumn(out, (F.col("__be") - F.col("__bs")).cast("int")).drop("__ds", "__bs", "__de", "__be")


def fy_end(fy_start_year: Column) -> Column:
    return F.date_sub(F.make_date(fy_start_year + 1, F.lit(3), F.lit(1)), 1)


def reallocation_pairs(util: DataFrame, group: list[str], donor: Column, receiver: Column,
                       surplus: Column, deficit: Column) -> DataFrame:
    """Rank donors by surplus and receivers by deficit within the group; pair equal ranks
    (an equi-join on group + rank, so at most one pairing per rank).  Ranks come from
    ``positions`` (range partitions), so a region x tier cell holding a third of the
    dealers is numbered by many tasks, not one window."""
    from fundlake.operators.asof import positions
    order = [F.desc("amount"), F.asc("dealer_id")]
    d = positions(util.filter(donor).select(*group, "dealer_id", surplus.alias("amount")), group, order, "pair_rank")
    r = positions(util.filter(receiver).select(*group, "dealer_id", deficit.alias("amount")), group, order,
                  "pair_rank")
    j = d.alias("d").join(r.alias("r"), group + ["pair_rank"])
    return j.select(*group, "pair_rank", F.col("d.dealer_id").alias("donor_dealer_id"),
                    F.col("r.dealer_id").alias("receiver_dealer_id"),
                    F.least(F.col("d.amount"), F.col("r.amount")).alias("transfer_usd"))


def business_days(cal_index: DataFrame) -> DataFrame:
    """(ordinal, date): the inverse of the calendar's prefix index, one row a business day."""
    return cal_index.groupBy(F.col("bd_index").alias("ordinal")).agg(F.min("date_key").alias("date")).where("ordinal > 0")


def after_business_days(df: DataFrame, bd_index: DataFrame, start: str, n: int, out: str) -> DataFrame:
    """``out`` = the n-th business day after ``start``, by two equi-joins to the calendar spine;
    null where ``start`` is null or the calendar ends before."""
    s = bd_index.select(F.col("date_key").alias("__d"), (F.col("bd_index") + n).alias("__n"))
    e = business_days(bd_index).select(F.col("ordinal").alias("__o"), F.col("date").alias(out))
    j = df.join(F.broadcast(s), F.col(start) == F.col("__d"), "left").join(F.broadcast(e), F.col("__n") == F.col("__o"), "left")
    return j.drop("__d", "__n", "__o")


def performance_multiplier(earned: list[tuple[Column, str]], cap: str = MULT_CAP) -> Column:
    """The product of the multipliers whose condition holds (null: not earned), at most ``cap``;
    decimal(9,8), no digit of a product of four is lost."""
    out = F.lit(1).cast("decimal(3,2)")
    for cond, factor in earned:
        out = out * F.when(cond, F.lit(factor)).otherwise(F.lit("1")).cast("decimal(3,2)")
    return F.least(F.lit(cap).cast("decimal(9,8)"), out.cast("decimal(9,8)"))


def event_checks(events: DataFrame) -> DataFrame:
    """``events`` (activity_type_id, attendees, event_cost_usd, region, ...) with ``too_few`` (fewer attendees than
    such an event needs; unknown numbers are too few) and ``over_cap`` (hospitality in the region with a cap
    that cost more than the cap for each attendee; without attendees every cost is over it)."""
    acts = [f"ACT-{a:02d}" for a in EVENT_MINIMUM_ACTIVITIES]
    heads = F.greatest(F.coalesce("attendees", F.lit(0)), F.lit(0))
    capped = (F.col("activity_type_id") == f"ACT-{HOSPITALITY['activity']:02d}") & (F.col("region") == HOSPITALITY["region"])
    over = capped & (F.col("event_cost_usd") > heads * HOSPITALITY["per_head_usd"])
    return events.withColumn("too_few", F.coalesce(F.col("activity_type_id").isin(acts) & (heads < EVENT_MINIMUM), F.lit(False))) \
        .withColumn("over_cap", F.coalesce(over, F.lit(False)))


def audit_findings(claims: DataFrame) -> DataFrame:
    """(flag_type, subject, n) of all four triggers over ``claims`` (claim_id, dealer_id, fiscal_year, submission_date,
    preapproval_id, region, venue_region):

    * ``late_cycle_dumping``: dealer and year with too many claims in the last week of January, n of them
    * ``preapproval_expired_reuse``: claim on a pre-approval first used over 90 days before, n those days
    * ``claim_density``: dealer with too many claims in seven days, n the most in any seven
    * ``out_of_region``: claim executed outside the dealer's region, n = 1; an unknown region is no finding

    The density window sees one row a dealer and day, the rest are aggregates and filters."""
    from fundlake.operators import windows
    last_week = (F.month("submission_date") == 1) & (F.dayofmonth("submission_date") >= 25)
    dumping = (windows.share_in_window(claims, ["dealer_id", "fiscal_year"], last_week)
               .where(F.col("n_window") * 100 > F.col("n_all") * AUDIT_WINDOW_PCT)
               .select(F.lit("late_cycle_dumping").alias("flag_type"), F.concat_ws(" ", "dealer_id", "fiscal_year").alias("subject"), F.col("n_window").alias("n")))
    reuse = (windows.key_reuse(claims.select("claim_id", "preapproval_id", "submission_date"), "preapproval_id", "submission_date", AUDIT_PREAPPROVAL_DAYS)
             .where("is_reused AND is_expired_use")
             .select(F.lit("preapproval_expired_reuse").alias("flag_type"), F.col("claim_id").alias("subject"), F.col("days_since_first_use").cast("bigint").alias("n")))
    density = (windows.rolling_density(claims, "dealer_id", "submission_date", 7).groupBy("dealer_id").agg(F.max("n_7d").alias("n"))
               .where(F.col("n") > AUDIT_DENSITY).select(F.lit("claim_density").alias("flag_type"), F.col("dealer_id").alias("subject"), "n"))
    outside = claims.where(F.col("venue_region") != F.col("region")).select(
        F.lit("out_of_region").alias("flag_type"), F.col("claim_id").alias("subject"), F.lit(1).cast("bigint").alias("n"))
    return dumping.unionByName(reuse).unionByName(density).unionByName(outside)
