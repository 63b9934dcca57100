"""K8, K9: saved views as stored rows: requests checked, kept by (user, name), run from their row.

A request carries its payload as JSON text, ``{"metric_view", "group_by", "measures", "filters"}``.  ``checked`` parses
and judges all requests in one pass of native functions; what the views know is a literal of a few names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fundlake.plans import metrics
from fundlake.plans.model import Model

PAYLOAD = "metric_view string, group_by array<string>, measures array<string>, filters array<struct<dim: string, value: string>>, bad string"


def _known(names: dict[str, list[str]], view: Column) -> Column:
    """The names that ``view`` knows; none for an unknown view."""
    known = F.create_map(*[x for v, ns in names.items() for x in (F.lit(v), F.array(*map(F.lit, ns)))])
    return F.coalesce(F.try_element_at(known, view), F.array().cast("array<string>"))


def _all_in(names: Column, known: Column) -> Column:
    return F.size(F.array_except(F.coalesce(names, F.array().cast("array<string>")), known)) == 0


def checked(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """K9: ``requests`` with ``parsed`` (the payload's fields) and ``refused``: null, or the first of ``malformed`` (null
    and empty payloads, fields of a wrong type, no object), ``unknown_view``, ``nothing_asked`` (neither groups nor
    measures), ``unknown_dimension`` (in groups or filters, nulls too), ``unknown_measure`` and
    ``filter_without_value``."""
    views = {n: metrics.VIEWS[n] for n in metrics.SAVED_VIEW_NAMES}
    x = requests.withColumn("parsed", F.from_json(payload, PAYLOAD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}))
    view, group, asked, filters = (F.col(f"parsed.{c}") for c in ("metric_view", "group_by", "measures", "filters"))
    known = F.coalesce(view, F.lit(""))
    dims, measures = _known({n: list(v.dims) for n, v in views.items()}, known), _known({n: list(v.measures) for n, v in views.items()}, known)
    good = F.coalesce(F.ltrim(payload).startswith("{") & F.col("parsed.bad").isNull(), F.lit(False))
    empty = F.coalesce(F.size(group), F.lit(0)) + F.coalesce(F.size(asked), F.lit(0)) <= 0
    return x.withColumn("refused", F.when(~good, "malformed").when(~F.coalesce(view.isin(list(views)), F.lit(False)), "unknown_view")
                        .when(empty, "nothing_asked")
                        .when(~_all_in(group, dims) | ~_all_in(F.transform(filters, lambda f: f["dim"]), dims), "unknown_dimension")
                        .when(~_all_in(asked, measures), "unknown_measure")
                        .when(F.coalesce(F.exists(filters, lambda f: f["value"].isNull()), F.lit(False)), "filter_without_value"))


def stored(requests: DataFrame, order: list[str], keys: tuple = ("user_id", "name")) -> DataFrame:
    """K8: the saved views that ``requests`` leave: of the accepted ones of a (user, name) the last by ``order``, with
    ``n_saves``.  An aggregate, so a user with very many requests stays small.  ``view_id`` follows from the keys."""
    ok = checked(requests).where("refused is null").drop("parsed", "refused")
    rest = [c for c in ok.columns if c not in keys and c not in order]
    last = ok.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("__r"), F.count(F.lit(1)).alias("n_saves"))
    view_id = F.sha2(F.to_json(F.array(*[F.col(k).cast("string") for k in keys])), 256)
    return last.select(view_id.alias("view_id"), *keys, *[F.col(f"__r.{c}").alias(c) for c in [*order, *rest]], "n_saves")


def run_stored(model: Model, views: DataFrame, user_id: str, name: str) -> DataFrame:
    """Run the view that ``user_id`` saved as ``name``; LookupError where there is none.  One row is read."""
    row = checked(views.where((F.col("user_id") == user_id) & (F.col("name") == name))).select("parsed", "refused").first()
    if row is None or row.refused:
        raise LookupError(f"no saved view {name!r} of {user_id!r}" if row is None else f"saved view {name!r}: {row.refused}")
    p = row.parsed
    payload = {"view": p.metric_view, "dims": list(dict.fromkeys(p.group_by or [])), "measures": list(dict.fromkeys(p.measures or [])),
               "filters": [(f.dim, f.value) for f in p.filters or []]}
    return metrics.formatted(metrics.run_saved_view(model, payload), p.metric_view)
