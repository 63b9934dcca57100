"""M1-M4: row filters, column masks and role scoping as joins and projections.

Scopes are rows, not driver-side branches: every user maps to one scope
(``global``, a region or a dealer); facts are pre-aggregated to the scope grain
and joined on it.  Global scopes read the one-row total as a scalar subquery, so no
cross product is planned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Role -> scope kind.
ROLE_SCOPE = {"director": "global", "finance": "global", "admin": "global",
              "channel_mgr": "region", "rmd": "region", "dealer": "dealer"}
USER_RULES = {
    "dealer_role_has_dealer": "(role = 'dealer') = (dealer_id IS NOT NULL)",
    "region_role_has_region": "role NOT IN ('channel_mgr','rmd') OR region_id IS NOT NULL",
}

# The groups that see revenue; role -> group (dealers and unknown roles are in none).
REVENUE_GROUPS = ["channel_marketing", "finance"]
ROLE_GROUP = {"director": "channel_marketing", "channel_mgr": "channel_marketing", "rmd": "channel_marketing",
              "finance": "finance", "admin": "admin"}


def scope_kind(role_col: str = "role"):
    e = None
    for r, k in ROLE_SCOPE.items():
        e = F.when(F.col(role_col) == r, F.lit(k)) if e is None else e.when(F.col(role_col) == r, F.lit(k))
    return e.otherwise(F.lit("none"))


def row_filter(facts: DataFrame, role: str, region_id: str | None = None, dealer_id: str | None = None) -> DataFrame:
    """M1 for one request: global roles see all, region roles their region, dealers their rows."""
    kind = ROLE_SCOPE.get(role, "none")
    if kind == "global":
        return facts
    if kind == "region":
        return facts.filter(F.col("region_id") == F.lit(region_id))
    if kind == "dealer":
        return facts.filter(F.col("dealer_id") == F.lit(dealer_id))
    return facts.limit(0)


def mask_columns(df: DataFrame, role_col: str, masks: dict[str, list[str]]) -> DataFrame:
    """M2: NULL the listed columns for the listed roles (``{column: [roles]}``)."""
    out = df
    for c, roles in masks.items():
        out = out.withColumn(c, F.when(F.col(role_col).isin(roles), F.lit(None).cast(df.schema[c].dataType))
                             .otherwise(F.col(c)))
    return out


def limit_columns(df: DataFrame, role_col: str, columns: list[str], groups: list[str]) -> DataFrame:
    """M2: NULL the listed columns unless the role's group is one of ``groups``; a role without a group, unknown
    or null, sees none of them."""
    allowed = F.coalesce(F.col(role_col).isin([r for r, g in ROLE_GROUP.items() if g in groups]), F.lit(False))
    return df.withColumns({c: F.when(allowed, F.col(c)) for c in columns})


def scoped_totals(users: DataFrame, facts: DataFrame, measures: list[str]) -> DataFrame:
    """M3: per user, the measure totals of their scope (three equi-joins, one union)."""
    u = users.withColumn("scope", scope_kind())
    by_region = facts.groupBy("region_id").agg(*[F.sum(m).alias(m) for m in measures])
    by_dealer = facts.groupBy("dealer_id").agg(*[F.sum(m).alias(m) for m in measures])
    total = facts.agg(F.struct(*[F.sum(m).alias(m) for m in measures])).scalar()  # one row, as a subquery
    g = u.filter(F.col("scope") == "global").select("*", *[total.getField(m).alias(m) for m in measures])
    r = u.filter(F.col("scope") == "region").join(by_region, "region_id", "left")
    d = u.filter(F.col("scope") == "dealer").join(by_dealer, "dealer_id", "left")
    cols = ["user_id", "role", "scope"] + measures
    return g.select(*cols).unionByName(r.select(*cols)).unionByName(d.select(*cols))
