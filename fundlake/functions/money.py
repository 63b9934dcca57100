"""Money and rate expressions, exact decimal throughout.

Money stays ``decimal`` from the first scan; ratios that feed a comparison are
rewritten as cross-multiplications so no rounding enters a branch decision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the two-band expected-forfeit heuristic.
HIGH_RISK_UTILIZATION = ("0.6", 1, 1)      # decimal literal (value, precision, scale)
LOW_BAND_FACTOR_DENOMINATOR = 10           # unused * (1 - util)^2 * 0.1


def _d(v: str, p: int, s: int) -> Column:
    return F.lit(v).cast(f"decimal({p},{s})")


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def floor_zero(x) -> Column:
    """max(x, 0) keeping the decimal type."""
    x = col_(x)
    return F.greatest(x, (x * 0))


def unused(allocated, committed) -> Column:
    """C11: max(allocated - committed, 0)."""
    return floor_zero(col_(allocated) - col_(committed))


def overcommitted(allocated, committed) -> Column:
    return floor_zero(col_(committed) - col_(allocated))


def utilization(paid, allocated) -> Column:
    """Paid / max(allocated, 1) (decimal division, NULL-safe)."""
    a = col_(allocated)
    return F.try_divide(col_(paid), F.greatest(a, (a * 0 + 1)))


def under_utilization(paid, allocated, threshold: tuple = HIGH_RISK_UTILIZATION) -> Column:
    """util < threshold, evaluated exactly as paid < threshold * max(allocated, 1)."""
    a = col_(allocated)
    return col_(paid) < _d(*threshold) * F.greatest(a, (a * 0 + 1))


def low_band_expected(unused_: str, allocated: str, paid: str) -> Column:
    """unused * clip(1 - paid/allocated, 0, 1)^2 * 0.1, rounded half-up to cents.

    Evaluated in integer cents so both engines agree to the cent:
    u, a, p = cents of unused, allocated, clip(paid, 0, allocated);
    num = u*(a-p)^2, den = 10*a^2, result = (2*num + den) div (2*den) cents.
    Arguments are column names (SQL ``div`` has no DataFrame-API operator).
    """
    u = f"CAST(`{unused_}` * 100 AS DECIMAL(12,0))"
    a = f"CAST(`{allocated}` * 100 AS DECIMAL(12,0))"
    p = f"CAST(least(greatest(`{paid}`, 0), `{allocated}`) * 100 AS DECIMAL(12,0))"
    g = f"({a} - {p})"
    num = f"({u} * {g} * {g})"
    den = f"({LOW_BAND_FACTOR_DENOMINATOR} * {a} * {a})"
    cents = f"CASE WHEN {a} > 0 THEN (2 * {num} + {den}) DIV (2 * {den}) END"
    return F.expr(f"CAST(CAST({cents} AS DECIMAL(14,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(14,2))")


def expected_forfeit(days_to_exp: str, unused_: str, allocated: str, paid: str, horizon_days: int) -> Column:
    """C14: expired -> unused; under horizon and under-utilized -> unused; else low band."""
    days = F.col(days_to_exp)
    u = F.col(unused_).cast("decimal(14,2)")
    return (F.when(days < 0, u)
            .when((days < F.lit(horizon_days)) & under_utilization(paid, allocated), u)
            .otherwise(low_band_expected(unused_, allocated, paid)))


def ratio(num, den) -> Column:
    """Ratio of sums with a zero guard."""
    return F.try_divide(col_(num), F.nullif(col_(den), F.lit(0)))


def pct1(num, den) -> Column:
    """Percent to one decimal, NULL when the denominator is 0."""
    return F.round(F.try_divide(col_(num) * 100, F.nullif(col_(den), F.lit(0))), 1)


def revenue_per_dollar(attributed, paid) -> Column:
    """Attributed / max(paid, 1), two decimals."""
    p = col_(paid)
    return F.try_divide(col_(attributed), F.greatest(p, p * 0 + 1)).cast("decimal(8,2)")


def accrual(approved, paid) -> Column:
    """max(0, approved - paid)."""
    return floor_zero(col_(approved) - col_(paid))
