"""Exact rounded ratios, written once for both SQL dialects.

``round_half_up(mult * num / den, scale)`` computed in integer hundredths so the
Spark plan and the DuckDB oracle agree digit for digit (DuckDB divides decimals
in double; Spark rounds decimal quotients at a derived scale).  Inputs are
decimals with at most two fractional digits, or integers.  NULL when the
denominator is NULL or 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio_sql(num: str, den: str, scale: int = 2, mult: int = 1, dialect: str = "spark",
              out_precision: int = 18) -> str:
    int_t = "DECIMAL(38,0)" if dialect == "spark" else "HUGEINT"
    div = "div" if dialect == "spark" else "//"
    n = f"CAST(({num}) * 100 AS {int_t})"
    d = f"CAST(({den}) * 100 AS {int_t})"
    k = mult * (10 ** scale)
    q = f"((2 * abs({n}) * {k} + {d}) {div} (2 * {d}))"
    signed = f"(CASE WHEN {n} < 0 THEN -1 ELSE 1 END) * {q}"
    unit = f"CAST({10.0 ** -scale:.{scale}f} AS DECIMAL({scale + 1},{scale}))" if scale > 0 else "1"
    return (f"CASE WHEN ({den}) IS NULL OR ({den}) = 0 THEN NULL "
            f"ELSE CAST(CAST({signed} AS DECIMAL(38,0)) * {unit} AS DECIMAL({out_precision},{scale})) END")


def ratio(num: str, den: str, scale: int = 2, mult: int = 1) -> Column:
    """Spark column for ``ratio_sql`` over column names / SQL expressions."""
    return F.expr(ratio_sql(num, den, scale, mult, "spark"))


def money(c, scale: int = 2) -> Column:
    """Output money type shared with the oracle."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(f"decimal(18,{scale})")
