"""Full silver + gold refresh (9 silver tables, 4 gold facts) as written tables.

Silver tables are written first; gold facts are then planned over the written
silver parquet, which cuts lineage at the layer boundary (a lost executor
recomputes from the written silver files, not from the driver tables).  Facts are
partitioned by fiscal year (B2).  Output goes under ``out_dir`` -- on a cluster a
shared folder (by default a fresh folder below ``spark.checkpoint.dir``).  Every
table is coerced to its declared schema as it is written (B1), and ``report`` holds
what that lost.  ``publish_catalog`` stores the tables that have a bounded number of
rows a dealer as catalog tables in buckets of the dealer.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

from fundlake.operators import sinks
from fundlake.plans import gold, schemas
from fundlake.plans.silver import Silver
from fundlake.session import checkpoint_root

SILVER_TABLES = ["dealer", "program", "activity_type", "region", "fiscal_calendar",
                 "coop_allocation", "coop_claim", "sell_through_order", "marketing_event"]
FACT_PARTITION = {"coop_allocation": ["fiscal_year"], "coop_claim": ["fiscal_year"],
                  "sell_through_order": ["fiscal_year"], "marketing_event": ["fiscal_year"]}


def _write_all(jobs: dict, parallel: int) -> dict[str, float]:
    """Submit independent table writes concurrently: each is its own Spark job, and
    small jobs would otherwise leave most executor slots idle."""
    def run(item):
        name, fn = item
        t0 = time.time()
        fn()
        return name, time.time() - t0
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        return dict(pool.map(run, jobs.items()))


def refresh(spark: SparkSession, sf_dir: str, out_dir: str | None = None, as_of: str = "2001-10-13",
            horizon_days: int = gold.DEFAULT_HORIZON_DAYS, parallel: int = 4) -> dict[str, float]:
    out_dir = out_dir or checkpoint_root(spark, "refresh")
    s = Silver(spark, sf_dir)
    timings: dict[str, float] = {}
    report: list[tuple] = []

    def coerced(layer, name, df, write):
        out, seen = sinks.coerce_observed(df, schemas.target(name))
        write(out, f"{out_dir}/{layer}/{name}")
        report.extend(sinks.coercion_rows(name, seen))

    frames = {"dealer": s.dealer, "program": s.program, "activity_type": s.activity_type, "region": s.region,
              "fiscal_calendar": s.fiscal_calendar_from_data(), "coop_allocation": s.coop_allocation,
              "coop_claim": s.coop_claim, "sell_through_order": s.sell_through_order,
              "marketing_event": s.marketing_event}
    jobs = {f"silver.{n}": (lambda n=n: coerced("silver", n, frames[n], lambda df, path: sinks.overwrite(
        df, path, partition_by=FACT_PARTITION.get(n)))) for n in SILVER_TABLES}
    timings.update(_write_all(jobs, parallel))

    def rd(name):
        return spark.read.parquet(f"{out_dir}/silver/{name}")

    golds = {
        "fact_coop_utilization_daily": (gold.utilization(rd("coop_allocation"), rd("coop_claim"), as_of, horizon_days),
                                        ["date_key", "fiscal_year"]),
        "fact_claim_sla": (gold.claim_sla(rd("coop_claim"), rd("dealer")), ["fiscal_year"]),
        "fact_dealer_performance_monthly": (gold.dealer_performance_monthly(rd("sell_through_order"),
                                                                            rd("coop_claim"), rd("dealer")),
                                            ["fiscal_year"]),
        "fact_activity_lift": (gold.activity_lift(rd("coop_claim"), rd("dealer"), rd("activity_type")), None),
    }
    # a daily snapshot replaces its own day only; the other facts are rebuilt whole
    def write_gold(parts):
        return lambda df, path: (sinks.write_partitioned(df, path, parts) if parts and "date_key" in parts
                                 else sinks.overwrite(df, path, partition_by=parts))
    jobs = {f"gold.{n}": (lambda n=n, df=df, parts=parts: coerced("gold", n, df, write_gold(parts)))
            for n, (df, parts) in golds.items()}
    timings.update(_write_all(jobs, parallel))
    sinks.write_report(spark, sorted(report, key=lambda r: (r[0], r[1], r[2] or "")), f"{out_dir}/report")
    return timings


# The catalog tables: a dealer has one row, a row a program and year, a row a month.
BUCKETED = {"dealer": "dealer", "coop_utilization": "utilization", "dealer_performance": "dealer_performance"}


def publish_catalog(spark: SparkSession, model, database: str = "fundlake", buckets: int = 16) -> list[str]:
    """A2: the tables of ``BUCKETED`` as ``database.name``, in equal buckets of ``dealer_id``; their names."""
    root = checkpoint_root(spark, "catalog")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{root}'")
    names = []
    for name, attr in BUCKETED.items():
        df = model.silver.dealer if attr == "dealer" else getattr(model, attr)
        sinks.save_bucketed(df, f"{database}.{name}", "dealer_id", f"{root}/{name}", buckets)
        names.append(f"{database}.{name}")
    return names
