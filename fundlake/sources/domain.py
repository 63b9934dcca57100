"""Domain (bronze-equivalent) tables derived from the driver tables.

The driver supplies TPC-H-shaped tables; the program's feeds (dealers, claims,
allocations, order lines, events) are derived from them by fixed integer and
decimal rules, so every downstream query grows with the driver data.

Scale notes
* ``nation``/``region`` (25 / 5 rows by TPC-H construction) and the activity and
  program code lists are the only explicit broadcast sides.
* ``dealer`` grows with ``customer`` and is joined by shuffle; AQE may still
  convert to a broadcast when the runtime size is under the threshold.
* The order-line feed is ``lineitem`` x ``orders`` on the order key: one
  sort-merge join, both sides pruned to the needed columns.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fundlake.functions import fiscal
from fundlake.sources.driver import Tables

# Fixed values (program definitions of the derived feeds).
STATUSES = ["Draft", "Submitted", "Under_Review", "Approved", "Rejected", "Paid", "Expired"]
# cumulative upper bounds of o_orderkey % 100 for each status above
STATUS_BOUNDS = [5, 13, 25, 50, 58, 96, 100]
TIERS = ["Platinum", "Gold", "Silver", "Authorized"]
# cumulative upper bounds of c_custkey % 20 for each tier above
TIER_BOUNDS = [1, 5, 13, 20]
TIER_BASE_USD = {"Platinum": 200000, "Gold": 80000, "Silver": 25000, "Authorized": 8000}
ACTIVITY_CATEGORIES = ["Digital", "Event", "Showroom", "Content", "Sponsorship"]
PREAPPROVAL_THRESHOLDS = {0: 0, 1: 5000, 2: 2500}  # by activity % 4; 3 -> none
LIFT_FACTORS = {0: "7.4", 1: "5.1", 2: "4.2", 3: "3.8", 4: "2.9"}  # by activity number
DEFAULT_LIFT_FACTOR = "1.8"
PRODUCT_FAMILIES = ["Seating", "Desks", "Storage", "Architecture", "Accessories"]
N_ACTIVITIES = 22
NON_TERMINAL_STATUSES = ["Submitted", "Under_Review", "Approved", "Paid"]
APPROVED_STATUSES = ["Approved", "Paid"]

DEC = "decimal"


def dec(x, p: int = 14, s: int = 2) -> Column:
    c = F.lit(x) if not isinstance(x, Column) else x
    return c.cast(f"decimal({p},{s})")


def D(v: str, p: int, s: int) -> Column:
    """Exact decimal literal."""
    return F.lit(v).cast(f"decimal({p},{s})")


def _case_bounds(value: Column, labels, bounds) -> Column:
    expr = None
    for label, bound in zip(labels, bounds):
        cond = value < F.lit(bound)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(labels[-1]))


def padded(number: Column, width: int) -> Column:
    """Digits of ``number``, zeros in front up to ``width``; longer numbers keep all their digits
    (``lpad`` alone would cut them)."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def dealer_key(custkey: Column) -> Column:
    return F.concat(F.lit("D-"), padded(custkey, 6))


class Domain:
    """All derived feeds for one driver directory.  Every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.t = Tables(spark, sf_dir)

    # ------------------------------------------------------------------ dims
    @cached_property
    def dim_region(self) -> DataFrame:
        n, r = self.t.nation, self.t.region
        return (n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
                .select(F.concat(F.lit("RGN-"), F.col("r_name"), F.lit("-"), F.col("n_nationkey").cast("string"))
                        .alias("region_id"),
                        F.col("r_name").alias("region"), F.col("n_name").alias("sub_region"),
                        F.concat_ws(" ", "r_name", "n_name").alias("region_full"),
                        F.lit(None).cast("string").alias("default_currency"),
                        "n_nationkey"))

    @cached_property
    def dealer(self) -> DataFrame:
        c = self.t.customer.select("c_custkey", "c_name", "c_nationkey")
        k = F.col("c_custkey")
        return (c.join(F.broadcast(self.dim_region), c.c_nationkey == F.col("n_nationkey"))
                .select(dealer_key(k).alias("dealer_id"),
                        F.col("c_name").alias("dealer_name"),
                        F.concat(F.lit("ACC-"), k.cast("string")).alias("account_id"),
                        "region_id", "region", "sub_region", "region_full",
                        F.col("sub_region").alias("country"),
                        _case_bounds(k % 20, TIERS, TIER_BOUNDS).alias("tier"),
                        F.concat(F.lit("REP-"), (F.lit(100) + k % 900).cast("string")).alias("sales_rep_id"),
                        "c_custkey"))

    # ---------------------------------------------------------------- claims
    @cached_property
    def claim_base(self) -> DataFrame:
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        k = F.col("o_orderkey")
        sub = F.col("o_orderdate").cast("date")
        return o.select(
            k.alias("k"), "o_custkey",
            sub.alias("submission_date"),
            fiscal.fiscal_year_num(sub).alias("fy"),
            (dec(F.col("o_totalprice"), 14, 2) * D("0.05", 4, 2)).cast("decimal(12,2)").alias("requested_amount_usd"),
            _case_bounds(k % 100, STATUSES, STATUS_BOUNDS).alias("status"))

    @cached_property
    def coop_claim(self) -> DataFrame:
        """Claim feed (bronze-equivalent, clean)."""
        k = F.col("k")
        st = F.col("status")
        req = F.col("requested_amount_usd")
        sub = F.col("submission_date")
        prog_suffix = F.when(((F.col("o_custkey") % 5) == 0) & ((k % 3) == 0), F.lit("-LAB")).otherwise(F.lit("-MAIN"))
        return self.claim_base.select(
            F.concat(F.lit("CL-"), padded(k, 8)).alias("claim_id"),
            dealer_key(F.col("o_custkey")).alias("dealer_id"),
            F.concat(F.lit("PRG-"), F.col("fy").cast("string"), prog_suffix).alias("program_id"),
            F.concat(F.lit("ACT-"), F.lpad((k % N_ACTIVITIES).cast("string"), 2, "0")).alias("activity_type_id"),
            F.when((k % 20) != 0, F.concat(F.lit("PA-"), (k % 5000).cast("string"))).alias("preapproval_id"),
            "fy", "submission_date", "status", "requested_amount_usd",
            F.when(st.isin(APPROVED_STATUSES),
                   (req * (F.lit(85) + k % 16).cast("decimal(5,0)") * D("0.01", 3, 2)).cast("decimal(12,2)"))
            .alias("approved_amount_usd"),
            F.when(st == "Paid",
                   (req * (F.lit(80) + k % 6).cast("decimal(5,0)") * D("0.01", 3, 2)).cast("decimal(12,2)"))
            .alias("paid_amount_usd"),
            F.when(st.isin(APPROVED_STATUSES), F.date_add(sub, (F.lit(3) + k % 19).cast("int")))
            .when(st == "Rejected", F.date_add(sub, (F.lit(3) + k % 12).cast("int"))).alias("decision_date"),
            F.when(st == "Paid", F.date_add(sub, (F.lit(10) + k % 19 + k % 24).cast("int"))).alias("payment_date"),
            F.when(st != "Draft", (F.lit(55) + k % 46).cast("int")).alias("brand_compliance_score"),
            F.col("k"))

    @cached_property
    def fiscal_years(self) -> DataFrame:
        """Distinct fiscal years present in the claim feed (bounded by the calendar span)."""
        return self.claim_base.select("fy").distinct()

    # ---------------------------------------------------------- activity/program
    @cached_property
    def activity_type(self) -> DataFrame:
        a = F.col("a")
        cat = None
        for i, name in enumerate(ACTIVITY_CATEGORIES):
            cat = F.when(a % 5 == i, F.lit(name)) if cat is None else cat.when(a % 5 == i, F.lit(name))
        thr = None
        for i, v in PREAPPROVAL_THRESHOLDS.items():
            thr = F.when(a % 4 == i, F.lit(v)) if thr is None else thr.when(a % 4 == i, F.lit(v))
        lift = None
        for i, v in LIFT_FACTORS.items():
            lift = F.when(a == i, D(v, 4, 1)) if lift is None else lift.when(a == i, D(v, 4, 1))
        base = self.spark.range(N_ACTIVITIES).select(F.col("id").alias("a"))
        return base.select(
            F.concat(F.lit("ACT-"), F.lpad(a.cast("string"), 2, "0")).alias("activity_type_id"),
            F.concat(F.lit("Activity "), a.cast("string")).alias("activity_name"),
            cat.alias("category"),
            (a % 4 != 3).alias("requires_preapproval"),
            thr.cast("decimal(12,2)").alias("preapproval_threshold_usd"),
            lift.otherwise(D(DEFAULT_LIFT_FACTOR, 4, 1)).alias("lift_factor"),
            a.alias("activity_no"))

    @cached_property
    def program(self) -> DataFrame:
        fy = F.col("fy")
        suffix = F.explode(F.array(F.lit("-MAIN"), F.lit("-LAB"))).alias("p")
        return (self.fiscal_years.select("fy", suffix)
                .select(F.concat(F.lit("PRG-"), fy.cast("string"), F.col("p")).alias("program_id"),
                        F.concat(F.lit("Co-op "), fy.cast("string"),
                                 F.when(F.col("p") == "-LAB", F.lit(" Lab fund")).otherwise(F.lit(" Main fund")))
                        .alias("program_name"),
                        fiscal.fy_label(fy).alias("fiscal_year"),
                        F.when(F.col("p") == "-LAB", F.lit("discretionary")).otherwise(F.lit("tier_formula"))
                        .alias("allocation_method"),
                        F.lit(None).cast("decimal(5,2)").alias("default_cofund_pct"),
                        F.make_date(fy, F.lit(3), F.lit(1)).alias("program_start"),
                        F.date_sub(F.make_date(fy + 1, F.lit(3), F.lit(1)), 1).alias("program_end"),
                        "fy"))

    # ------------------------------------------------------------ allocations
    @cached_property
    def coop_allocation(self) -> DataFrame:
        """One allocation per dealer x fiscal year x program (LAB only for every 5th dealer).

        The dealer x year grid is built with ``explode(sequence(min, max))`` bounded by
        scalar subqueries, then semi-joined to the years actually present, so no
        cross join is planned.  The customer file is small for what it grows to, one task may read
        it whole, so the dealers are dealt first: a task makes the rows of its share, and sums by
        dealer need no further exchange.
        """
        fys = self.fiscal_years
        bounds = fys.agg(F.struct(F.min("fy").alias("lo"), F.max("fy").alias("hi"))).scalar()
        lo, hi = bounds.getField("lo"), bounds.getField("hi")
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        d = self.dealer.select("dealer_id", "tier", "c_custkey").repartition(n, "dealer_id")
        k = F.col("c_custkey")
        grid = (d.withColumn("fy", F.explode(F.sequence(lo, hi)))
                .join(F.broadcast(fys), "fy", "left_semi")
                .withColumn("p", F.explode(F.when(k % 5 == 0, F.array(F.lit("-MAIN"), F.lit("-LAB")))
                                           .otherwise(F.array(F.lit("-MAIN"))))))
        fy = F.col("fy")
        base = None
        for t, v in TIER_BASE_USD.items():
            base = F.when(F.col("tier") == t, F.lit(v)) if base is None else base.when(F.col("tier") == t, F.lit(v))
        pct = F.lit(60) + F.lit(10) * ((k * 7 + fy) % 9)
        return grid.select(
            F.concat(F.lit("AL-"), k.cast("string"), F.lit("-"), fy.cast("string"), F.col("p")).alias("allocation_id"),
            "dealer_id",
            F.concat(F.lit("PRG-"), fy.cast("string"), F.col("p")).alias("program_id"),
            "fy",
            ((base * pct).cast("decimal(20,0)") * D("0.01", 3, 2)).cast("decimal(14,2)").alias("allocated_usd"),
            F.date_add(F.make_date(fy, F.lit(3), F.lit(1)), (k % 30).cast("int")).alias("allocation_date"),
            F.date_sub(F.make_date(fy + 1, F.lit(3), F.lit(1)), 1).alias("expiration_date"),
            F.when(F.col("p") == "-LAB", F.lit("top_up")).otherwise(F.lit("initial")).alias("allocation_source"))

    # ----------------------------------------------------------------- orders
    @cached_property
    def sell_through_order(self) -> DataFrame:
        """Order lines.  Line numbers repeat within an order of the feed, so ``line_key`` (part, supplier and ship
        day) tells such lines apart; a line that is sent twice has the same key twice."""
        li = self.t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                    "l_extendedprice", "l_discount")
        o = self.t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
        fam = None
        for i, name in enumerate(PRODUCT_FAMILIES):
            c = (F.col("l_partkey") % 5) == i
            fam = F.when(c, F.lit(name)) if fam is None else fam.when(c, F.lit(name))
        return (li.join(o, li.l_orderkey == o.o_orderkey)
                .select(F.concat(F.lit("O-"), F.col("o_orderkey").cast("string")).alias("order_id"),
                        F.col("l_linenumber").alias("line_no"),
                        dealer_key(F.col("o_custkey")).alias("dealer_id"),
                        fam.alias("product_family"),
                        F.col("o_orderdate").cast("date").alias("order_date"),
                        F.col("l_shipdate").cast("date").alias("ship_date"),
                        (dec(F.col("l_extendedprice"), 14, 2) * (D("1", 4, 2) - dec(F.col("l_discount"), 4, 2)))
                        .cast("decimal(14,2)").alias("net_revenue_usd"),
                        F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
                                    F.date_format("l_shipdate", "yyyyMMdd")).alias("line_key")))

    # ------------------------------------------------------------ event feeds
    @cached_property
    def marketing_event(self) -> DataFrame:
        """Marketing events from the driver event stream (one event per driver row)."""
        e = self.t.events.select("event_id", "ts", "user_id", "event_type", "value")
        return e.select(
            F.concat(F.lit("EV-"), F.col("event_id").cast("string")).alias("event_id"),
            dealer_key(F.col("user_id")).alias("dealer_id"),
            F.concat(F.lit("ACT-"), F.lpad((F.col("event_id") % N_ACTIVITIES).cast("string"), 2, "0"))
            .alias("activity_type_id"),
            F.col("ts").cast("date").alias("start_date"),
            F.col("ts").cast("date").alias("end_date"),
            F.col("value").cast("int").alias("attendees"),
            F.col("event_type"))

    @cached_property
    def claim_transitions(self) -> DataFrame:
        """Claim state-transition rows from events: claim = user x (event_id % 7)."""
        e = self.t.events.select("event_id", "ts", "user_id", "event_type")
        state = (F.when(F.col("event_type") == "view", F.lit("Submitted"))
                 .when(F.col("event_type") == "click", F.lit("Under_Review"))
                 .when(F.col("event_type") == "signup", F.lit("Approved"))
                 .when(F.col("event_type") == "purchase", F.lit("Paid"))
                 .when(F.col("event_type") == "error", F.lit("Rejected")))
        return e.select(
            F.concat(F.lit("TC-"), F.col("user_id").cast("string"), F.lit("-"),
                     (F.col("event_id") % 7).cast("string")).alias("claim_id"),
            dealer_key(F.col("user_id")).alias("dealer_id"),
            F.col("ts").cast("timestamp").alias("ts"),
            F.col("event_id"),
            state.alias("status"))

    @cached_property
    def account_changes(self) -> DataFrame:
        """Account change feed (A7): base row, tier change for every 7th, no-op copy for every
        11th, delete for every 97th customer."""
        d = self.dealer.select("dealer_id", "dealer_name", "account_id", "region_id", "country", "tier",
                               "sales_rep_id", "c_custkey")
        k = F.col("c_custkey")
        nxt = (F.when(F.col("tier") == "Authorized", F.lit("Silver")).when(F.col("tier") == "Silver", F.lit("Gold"))
               .when(F.col("tier") == "Gold", F.lit("Platinum")).otherwise(F.lit("Platinum")))
        kinds = F.explode(F.array(
            F.struct(F.lit("base").alias("kind"), F.lit("1995-01-01 00:00:00").alias("ts")),
            F.struct(F.lit("tier").alias("kind"), F.lit("1998-03-01 00:00:00").alias("ts")),
            F.struct(F.lit("noop").alias("kind"), F.lit("1996-06-01 00:00:00").alias("ts")),
            F.struct(F.lit("delete").alias("kind"), F.lit("2000-01-01 00:00:00").alias("ts")))).alias("c")
        x = d.select("*", kinds).select("*", "c.kind", "c.ts").drop("c")
        keep = ((F.col("kind") == "base") | ((F.col("kind") == "tier") & (k % 7 == 0))
                | ((F.col("kind") == "noop") & (k % 11 == 0)) | ((F.col("kind") == "delete") & (k % 97 == 0)))
        return (x.filter(keep)
                .select(F.col("account_id").alias("Id"), F.col("dealer_name").alias("Name"),
                        F.col("country").alias("BillingCountry"),
                        F.when(F.col("kind") == "tier", nxt).otherwise(F.col("tier")).alias("Tier__c"),
                        F.col("region_id").alias("Region__c"), F.col("sales_rep_id").alias("Sales_Rep__c"),
                        F.col("dealer_id").alias("Dealer_External_Id__c"),
                        (F.col("kind") == "delete").alias("IsDeleted"),
                        F.to_timestamp("ts").alias("LastModifiedDate")))

    @cached_property
    def dirty_claims(self) -> DataFrame:
        """Bronze claim feed with planted defects for the drop rules."""
        c = self.coop_claim
        k = F.col("k")
        return c.select(
            "claim_id",
            F.when(k % 977 == 0, F.lit(None).cast("string")).otherwise(F.col("dealer_id")).alias("dealer_id"),
            "program_id", "activity_type_id", "preapproval_id", "submission_date",
            F.when(k % 997 == 0, D("0", 12, 2)).otherwise(F.col("requested_amount_usd")).alias("requested_amount_usd"),
            F.when((k % 983 == 0) & F.col("paid_amount_usd").isNotNull(),
                   (F.col("approved_amount_usd") + D("1", 12, 2)).cast("decimal(12,2)"))
            .otherwise(F.col("paid_amount_usd")).alias("paid_amount_usd"),
            "approved_amount_usd",
            F.when(k % 991 == 0, F.lit("Bogus")).otherwise(F.col("status")).alias("status"),
            "brand_compliance_score", "decision_date", "payment_date", "fy", "k")
