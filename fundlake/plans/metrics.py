"""Governed metric views compiled to DataFrame plans.

A view = source fact + named joins + dimensions + measures (+ view filters,
synonyms, display formats).  ``query`` compiles a request into one plan:

    source -> only the joins the requested/filtered dimensions need
           -> dimension columns -> filters -> groupBy(dims).agg(measures)

Measures are SQL aggregate expressions (the metric expression language) over the
source columns; Catalyst pushes view and user filters into the scans and prunes
every unused column.  Dimension tables are joined left, as in the view
definitions; region/program/activity/calendar dims are bounded code lists and are
broadcast explicitly, the dealer dim is left to the planner (AQE broadcasts it
only when its runtime size is under the threshold).
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.plans.model import Model


@dataclass(frozen=True)
class Join:
    table: str                # Model attribute holding the dimension DataFrame
    left: str                 # key column on the left side
    right: str                # key column in the dimension
    via: str | None = None    # parent join providing the left key (snowflake)
    bounded: bool = False     # code-list dimension: safe to broadcast


@dataclass
class View:
    name: str
    source: str
    joins: dict[str, Join]
    dims: dict[str, str | Callable[[], Column]]
    measures: dict[str, str]
    filters: list[Callable[[Model, DataFrame], Column]] = field(default_factory=list)
    synonyms: dict[str, list[str]] = field(default_factory=dict)
    formats: dict[str, tuple[str, int]] = field(default_factory=dict)
    description: str = ""


def _latest_snapshot(model: Model, src: DataFrame) -> Column:
    """date_key = (SELECT max(date_key) FROM source) as a scalar subquery."""
    return F.col("date_key") == model.latest_snapshot()


_DEALER = Join("dim_dealer", "dealer_id", "dealer_id")
_REGION_VIA_DEALER = Join("dim_region", "region_id", "region_id", via="dealer", bounded=True)
_REGION_DIRECT = Join("dim_region", "region_id", "region_id", bounded=True)
_PROGRAM = Join("dim_program", "program_id", "program_id", bounded=True)
_ACTIVITY = Join("dim_activity_type", "activity_type_id", "activity_type_id", bounded=True)
_FISCAL = Join("dim_fiscal_calendar", "date_key", "date_key", bounded=True)

_CURRENCY0 = ("currency", 0)
_PERCENT1 = ("percent", 1)

VIEWS: dict[str, View] = {}


def register(view: View) -> View:
    VIEWS[view.name] = view
    return view


# K2 -------------------------------------------------------------------------------
register(View(
    name="coop_program_metrics", source="utilization",
    joins={"dealer": _DEALER, "program": _PROGRAM, "region": _REGION_VIA_DEALER, "fiscal": _FISCAL},
    dims={"dealer_id": "dealer_id", "dealer_name": "dealer.dealer_name", "tier": "dealer.tier",
          "region": "region.region", "sub_region": "region.sub_region", "region_full": "region.region_full",
          "country": "dealer.country", "program_id": "program_id", "program_name": "program.program_name",
          "fiscal_year": "fiscal_year", "fiscal_period": "fiscal_period",
          "fiscal_quarter": "fiscal.fiscal_quarter", "date_key": "date_key"},
    measures={
        "allocated_usd": "SUM(allocated_usd)", "committed_usd": "SUM(committed_usd)",
        "approved_usd": "SUM(approved_usd)", "paid_usd": "SUM(paid_usd)", "unused_usd": "SUM(unused_usd)",
        "forfeited_usd": "SUM(forfeited_usd)", "overcommitted_usd": "SUM(overcommitted_usd)",
        "utilization_rate": "try_divide(SUM(paid_usd), NULLIF(SUM(allocated_usd), 0))",
        "commitment_rate": "try_divide(SUM(committed_usd), NULLIF(SUM(allocated_usd), 0))",
        "forfeiture_rate": "try_divide(SUM(forfeited_usd), NULLIF(SUM(allocated_usd), 0))",
        # certified-question names
        "allocated_usd_total": "SUM(allocated_usd)", "paid_usd_total": "SUM(paid_usd)",
        "unused_usd_total": "SUM(unused_usd)",
    },
    synonyms={"utilization_rate": ["utilization", "burn rate", "drawn-down rate", "spend rate"],
              "forfeited_usd": ["forfeiture", "leakage", "unused at year-end", "expired funds"],
              "paid_usd": ["payout", "payments", "disbursed", "reimbursed"],
              "unused_usd": ["balance", "available funds", "remaining funds"],
              "dealer_name": ["dealer", "partner", "dealership", "channel partner"],
              "program_name": ["program", "fund", "initiative", "co-op"]},
    formats={"allocated_usd": _CURRENCY0, "committed_usd": _CURRENCY0, "approved_usd": _CURRENCY0,
             "paid_usd": _CURRENCY0, "unused_usd": _CURRENCY0, "forfeited_usd": _CURRENCY0,
             "utilization_rate": _PERCENT1, "commitment_rate": _PERCENT1, "forfeiture_rate": _PERCENT1},
))

# K3 -------------------------------------------------------------------------------
register(View(
    name="forfeiture_risk", source="utilization",
    joins={"dealer": _DEALER, "program": _PROGRAM, "region": _REGION_VIA_DEALER},
    dims={"dealer_id": "dealer_id", "dealer_name": "dealer.dealer_name", "tier": "dealer.tier",
          "region": "region.region", "sub_region": "region.sub_region", "region_full": "region.region_full",
          "program_id": "program_id", "program_name": "program.program_name", "fiscal_year": "fiscal_year",
          "expiration_date": lambda: F.date_add(F.col("date_key"), F.col("days_to_expiration")),
          "days_to_expiration_dim": "days_to_expiration"},
    measures={
        "unused_balance_usd": "SUM(unused_usd)",
        "days_to_expiration": "MIN(days_to_expiration)",
        "expected_forfeit_usd": "SUM(expected_forfeit_usd)",
        "dealers_at_risk_count": "COUNT(DISTINCT CASE WHEN unused_usd > 0 AND days_to_expiration < 90 "
                                 "THEN dealer_id END)",
        # certified-question names
        "expected_forfeit_usd_total": "SUM(expected_forfeit_usd)", "unused_usd_total": "SUM(unused_usd)",
        "paid_usd_total": "SUM(paid_usd)", "allocated_usd_total": "SUM(allocated_usd)",
        "utilization_rate_ytd": "try_divide(SUM(paid_usd), NULLIF(SUM(allocated_usd), 0))",
        "expiration_date_min": "MIN(date_add(date_key, days_to_expiration))",
    },
    filters=[_latest_snapshot],
    synonyms={"unused_balance_usd": ["balance", "available funds", "remaining funds"],
              "expected_forfeit_usd": ["forfeiture risk", "leakage", "expected unused at year-end"],
              "dealers_at_risk_count": ["at-risk dealers", "dealers about to forfeit", "underperforming dealers"],
              "days_to_expiration": ["time left", "deadline", "window"]},
    formats={"unused_balance_usd": _CURRENCY0, "expected_forfeit_usd": _CURRENCY0,
             "days_to_expiration": ("decimal", 0)},
))

# K4 -------------------------------------------------------------------------------
register(View(
    name="claim_lifecycle", source="claim_sla",
    joins={"dealer": _DEALER, "program": _PROGRAM, "activity": _ACTIVITY, "region": _REGION_DIRECT},
    dims={"claim_id": "claim_id", "dealer_id": "dealer_id", "dealer_name": "dealer.dealer_name", "tier": "tier",
          "region": "region.region", "region_full": "region.region_full", "program_name": "program.program_name",
          "activity_category": "activity.category", "activity_name": "activity.activity_name",
          "final_status": "final_status", "fiscal_year": "fiscal_year", "submission_date": "submission_date"},
    measures={
        "claims_submitted": "COUNT(*)",
        "claims_approved": "COUNT_IF(final_status IN ('Approved', 'Paid'))",
        "claims_rejected": "COUNT_IF(final_status = 'Rejected')",
        "claims_paid": "COUNT_IF(final_status = 'Paid')",
        "claims_under_review_count": "COUNT_IF(final_status = 'Under_Review')",
        "first_pass_approval_rate": "try_divide(COUNT_IF(first_pass_approval = TRUE), NULLIF(COUNT(*), 0))",
        "cycle_time_days_p50": "PERCENTILE(total_cycle_days, 0.5)",
        "cycle_time_days_p90": "PERCENTILE(total_cycle_days, 0.9)",
        "time_in_review_p50": "PERCENTILE(days_review_to_decision, 0.5)",
        "time_to_pay_p50": "PERCENTILE(days_decision_to_payment, 0.5)",
        "avg_total_cycle_days": "AVG(total_cycle_days)",
        "avg_days_submission_to_decision": "AVG(days_submission_to_decision)",
        "avg_days_decision_to_payment": "AVG(days_decision_to_payment)",
        "claims_first_pass": "COUNT_IF(first_pass_approval = TRUE)",
        # exact-average building blocks (sum and count of non-null durations)
        "sum_total_cycle_days": "SUM(total_cycle_days)", "n_total_cycle_days": "COUNT(total_cycle_days)",
        "sum_days_submission_to_decision": "SUM(days_submission_to_decision)",
        "n_days_submission_to_decision": "COUNT(days_submission_to_decision)",
        "sum_days_decision_to_payment": "SUM(days_decision_to_payment)",
        "n_days_decision_to_payment": "COUNT(days_decision_to_payment)",
    },
    synonyms={"cycle_time_days_p50": ["median cycle time", "typical turnaround"],
              "cycle_time_days_p90": ["worst-case cycle time", "p90 turnaround"],
              "first_pass_approval_rate": ["first-pass rate", "approval rate", "FPR"],
              "time_in_review_p50": ["reviewer time", "time in review queue"],
              "time_to_pay_p50": ["finance time", "time to disbursement"]},
    formats={"first_pass_approval_rate": _PERCENT1, "cycle_time_days_p50": ("decimal", 1),
             "cycle_time_days_p90": ("decimal", 1)},
))

# K5 -------------------------------------------------------------------------------
register(View(
    name="dealer_performance", source="dealer_performance",
    joins={"dealer": _DEALER, "region": _REGION_VIA_DEALER},
    dims={"dealer_id": "dealer_id", "dealer_name": "dealer.dealer_name", "tier": "dealer.tier",
          "region": "region.region", "sub_region": "region.sub_region", "region_full": "region.region_full",
          "country": "dealer.country", "month": "month", "fiscal_year": "fiscal_year"},
    measures={
        "net_revenue_usd": "SUM(net_revenue_usd)", "coop_paid_usd": "SUM(coop_paid_usd)",
        "attributed_coop_usd_lift": "SUM(attributed_coop_usd_lift)",
        "revenue_per_coop_dollar": "try_divide(SUM(attributed_coop_usd_lift), NULLIF(SUM(coop_paid_usd), 0))",
        "lift_vs_control_pct": "AVG(lift_vs_control_pct)",
        "net_revenue_usd_total": "SUM(net_revenue_usd)", "coop_paid_usd_total": "SUM(coop_paid_usd)",
        "attributed_coop_usd_lift_total": "SUM(attributed_coop_usd_lift)",
    },
    synonyms={"net_revenue_usd": ["revenue", "sell-through", "sales"],
              "revenue_per_coop_dollar": ["ROI", "return", "revenue per dollar"]},
))

# K6 -------------------------------------------------------------------------------
register(View(
    name="activity_lift", source="activity_lift",
    joins={"activity": _ACTIVITY, "region": _REGION_DIRECT},
    dims={"activity_type_id": "activity_type_id", "activity_name": "activity.activity_name",
          "activity_category": "activity.category", "region": "region.region", "sub_region": "region.sub_region",
          "region_full": "region.region_full", "fiscal_year": "fiscal_year",
          "lift_methodology_version": "lift_methodology_version"},
    measures={
        "coop_paid_usd": "SUM(coop_paid_usd)", "attributed_revenue_usd": "SUM(attributed_revenue_usd)",
        "revenue_per_coop_dollar": "try_divide(SUM(attributed_revenue_usd), NULLIF(SUM(coop_paid_usd), 0))",
        "matched_pairs": "SUM(matched_pairs)",
        "coop_paid_usd_total": "SUM(coop_paid_usd)", "attributed_revenue_usd_total": "SUM(attributed_revenue_usd)",
        "revenue_per_coop_dollar_avg": "try_divide(SUM(attributed_revenue_usd), NULLIF(SUM(coop_paid_usd), 0))",
        "distinct_activities": "COUNT(DISTINCT activity_type_id)",
    },
    synonyms={"activity_name": ["activity", "tactic", "channel", "marketing channel"],
              "revenue_per_coop_dollar": ["ROI", "return on co-op", "revenue per dollar"]},
))


# ----------------------------------------------------------------------------- compiler
class MetricError(ValueError):
    pass


def _dim_parts(view: View, dim: str) -> tuple[str | None, str | Callable]:
    if dim not in view.dims:
        raise MetricError(f"unknown dimension {dim!r} in view {view.name}")
    e = view.dims[dim]
    if callable(e):
        return None, e
    if "." in e:
        j, c = e.split(".", 1)
        return j, c
    return None, e


def _join_closure(view: View, names: set[str]) -> list[str]:
    out: list[str] = []

    def visit(n: str):
        if n in out:
            return
        j = view.joins[n]
        if j.via:
            visit(j.via)
        out.append(n)

    for n in sorted(names):
        visit(n)
    return out


def _filter_column(spec) -> tuple[set[str], Callable[[], Column]]:
    """Filters: (dim, value) equality, (dim, op, value), or a Column over dimension names."""
    if isinstance(spec, Column):
        return set(), lambda: spec
    if len(spec) == 2:
        d, v = spec
        op = "in" if isinstance(v, (list, tuple, set)) else "="
    else:
        d, op, v = spec
    op = op.lower()

    def build() -> Column:
        c = F.col(d)
        if op == "=":
            return c == F.lit(v)
        if op == "in":
            return c.isin(list(v))
        if op == "between":
            return c.between(v[0], v[1])
        if op == "like":
            return c.like(v)
        if op == "<":
            return c < F.lit(v)
        if op == "<=":
            return c <= F.lit(v)
        if op == ">":
            return c > F.lit(v)
        if op == ">=":
            return c >= F.lit(v)
        raise MetricError(f"unsupported operator {op}")
    return {d}, build


def query(model: Model, view_name: str, dims: list[str] | None = None, measures: list[str] | None = None,
          where: list | dict | None = None, having: Column | None = None,
          order_by: list | None = None, limit: int | None = None,
          extra_dims: list[str] | None = None) -> DataFrame:
    """K1: evaluate any dimension subset x measure subset of a view as one plan.

    ``extra_dims`` are dimensions needed by filters/order but not grouped on.
    """
    if view_name not in VIEWS:
        raise MetricError(f"unknown view {view_name!r}")
    view = VIEWS[view_name]
    dims = list(dims or [])
    measures = list(measures or [])
    for m in measures:
        if m not in view.measures:
            raise MetricError(f"unknown measure {m!r} in view {view.name}")
    if isinstance(where, dict):
        where = list(where.items())
    filters = [_filter_column(f) for f in (where or [])]
    filter_dims = set().union(*[f[0] for f in filters]) if filters else set()
    used_dims = list(dict.fromkeys(dims + sorted(filter_dims) + list(extra_dims or [])))

    src = getattr(model, view.source)
    # joins needed by the used dims
    need: set[str] = set()
    cols_from: dict[str, set[str]] = {}
    for d in used_dims:
        j, c = _dim_parts(view, d)
        if j:
            need.add(j)
            cols_from.setdefault(j, set()).add(c)
    order = _join_closure(view, need)
    for n in order:
        j = view.joins[n]
        if j.via:
            cols_from.setdefault(j.via, set()).add(j.left)
    df = src
    for n in order:
        j = view.joins[n]
        right = getattr(model, j.table)
        wanted = sorted(cols_from.get(n, set()))
        rsel = [F.col(j.right).alias(f"{n}__key")] + [F.col(c).alias(f"{n}__{c}") for c in wanted]
        right = right.select(*rsel)
        if j.bounded:
            right = F.broadcast(right)
        left_key = f"{j.via}__{j.left}" if j.via else j.left
        df = df.join(right, df[left_key] == right[f"{n}__key"], "left").drop(f"{n}__key")
    # dimension columns
    for d in used_dims:
        j, c = _dim_parts(view, d)
        if callable(c):
            df = df.withColumn(d, c())
        elif j:
            df = df.withColumn(d, F.col(f"{j}__{c}"))
        elif c != d:
            df = df.withColumn(d, F.col(c))
    for f in view.filters:
        df = df.filter(f(model, df))
    for _, build in filters:
        df = df.filter(build())
    aggs = [F.expr(view.measures[m]).alias(m) for m in measures]
    out = df.groupBy(*dims).agg(*aggs) if aggs else df.select(*dims).distinct()
    if having is not None:
        out = out.filter(having)
    if order_by:
        out = out.orderBy(*order_by)
    if limit is not None:
        out = out.limit(limit)
    return out


def resolve_synonym(view_name: str, term: str) -> list[str]:
    """K7: business term -> measure/dimension names (several = ambiguous)."""
    view = VIEWS[view_name]
    t = term.strip().lower()
    hits = [name for name, words in view.synonyms.items() if t in [w.lower() for w in words]]
    if t in view.measures or t in view.dims:
        hits.insert(0, t)
    return list(dict.fromkeys(hits))


def synonym_table(spark) -> DataFrame:
    """K7 as a table (view, term, target) for a join against a question/term table."""
    rows = [(v.name, w.lower(), target) for v in VIEWS.values() for target, ws in v.synonyms.items() for w in ws]
    return spark.createDataFrame(rows, "view_name string, term string, target string")


def formatted(df: DataFrame, view_name: str) -> DataFrame:
    """Apply display formats (currency -> rounded decimals, percent -> x100 rounded)."""
    view = VIEWS[view_name]
    out = df
    for m, (kind, decimals) in view.formats.items():
        if m in df.columns:
            if kind == "percent":
                out = out.withColumn(m, F.round(F.col(m) * 100, decimals))
            else:
                out = out.withColumn(m, F.round(F.col(m), decimals))
    return out


# The names a saved view may reference (K9).
SAVED_VIEW_NAMES = ["coop_program_metrics", "forfeiture_risk", "claim_lifecycle", "dealer_performance",
                    "activity_lift"]


def validate_payload(payload: dict) -> dict:
    """K9: validate a saved-view payload (view name, dims, measures)."""
    v = payload.get("view")
    if v not in SAVED_VIEW_NAMES:
        raise MetricError(f"view must be one of {SAVED_VIEW_NAMES}")
    view = VIEWS[v]
    for d in payload.get("dims", []):
        _dim_parts(view, d)
    for m in payload.get("measures", []):
        if m not in view.measures:
            raise MetricError(f"unknown measure {m!r}")
    return payload


def run_saved_view(model: Model, payload: dict) -> DataFrame:
    """K8: execute a stored {view, dims, measures, filters} payload."""
    p = validate_payload(payload)
    where = [tuple(f) for f in p.get("filters", [])]
    return query(model, p["view"], p.get("dims", []), p.get("measures", []), where=where)
