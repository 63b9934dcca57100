"""Collects every registered query module into one name -> builder map."""

from __future__ import annotations

import importlib

# Modules that register queries on import (each has a module-level REGISTRY).
_MODULES = [
    "fundlake.plans.catalog",
    "fundlake.plans.catalog_ops",
    "fundlake.plans.catalog_text",
    "fundlake.plans.catalog_rules",
    "fundlake.plans.catalog_more",
    "fundlake.plans.catalog_proof",
    "fundlake.plans.catalog_tables",
    "fundlake.plans.catalog_branches",
    "fundlake.streaming.catalog_streams",
    "fundlake.sources.catalog_sources",
]


def _registries():
    out = {}
    for name in _MODULES:
        try:
            mod = importlib.import_module(name)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name == name:
                continue
            raise
        out.update(mod.REGISTRY)
    return out


def _ntz(df):
    """Present instants as UTC wall-clock (TIMESTAMP_NTZ) so results do not depend on the
    client's local time zone."""
    from pyspark.sql import functions as F
    from pyspark.sql import types as T
    if not any(isinstance(f.dataType, T.TimestampType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
                       if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


def _wrap(fn):
    def run(spark, sf_dir):
        return _ntz(fn(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


def all_queries():
    return {k: _wrap(v[0]) for k, v in _registries().items()}


def all_oracle_sql():
    return {k: v[1] for k, v in _registries().items() if v[1]}
