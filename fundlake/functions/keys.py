"""Parts of composite keys (``RGN-<region>-<sub>``, ``PRG-<year>-<name>``, ``ACT-<category>-<name>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Category codes of activity keys.
CATEGORY_CODES = {"DIG": "Digital", "EVT": "Event", "SHO": "Showroom", "CON": "Content", "SPO": "Sponsorship", "ABM": "Digital"}

_REGION = "^RGN-([^-]+)-(.+)$"


def _part(key: Column, pattern: str, group: int = 1) -> Column:
    """A group of the match; null where the key does not match."""
    return F.nullif(F.regexp_extract(key, pattern, group), F.lit(""))


def region_of(key: Column) -> Column:
    return _part(key, _REGION)


def sub_region_of(key: Column) -> Column:
    return _part(key, _REGION, 2)


def program_fiscal_year(key: Column) -> Column:
    """The FY label of a program key; the year may stand as ``FY26``, ``26`` or ``2026``."""
    year = _part(key, "^PRG-(?:FY)?([0-9]{2}|[0-9]{4})(?:-|$)")
    return F.concat(F.lit("FY"), F.right(year, F.lit(2)))


def activity_category(key: Column) -> Column:
    """The category of an activity key; null for an unknown code."""
    code = _part(key, "^ACT-([A-Z]+)(?:-|$)")
    e = None
    for c, name in CATEGORY_CODES.items():
        e = F.when(code == c, F.lit(name)) if e is None else e.when(code == c, F.lit(name))
    return e
