"""Derived measures used by the marts and the UI (PRJ11, SC3, SC12-SC18)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casts import _col

# Fixed values of the display rules.
PERCENT_SCALE_MAX = 15  # a bar is full at 15 goals / assists / xG / xA
TOP_ZONE_LAST_RANK = 4  # ranks 1-4: top zone
BOTTOM_ZONE_FIRST_RANK = 18  # ranks 18 and below: bottom zone (a 20-team league)
BOTTOM_ZONE_SIZE = 3  # the same zone for a league of any size: the last three ranks


def per90(value, minutes, digits: int = 2) -> Column:
    """`value / max(minutes, 1) * 90`, rounded (SC12)."""
    return F.round(_col(value) / F.greatest(_col(minutes), F.lit(1)) * 90, digits)


def capped_percent(value, scale_max: float = PERCENT_SCALE_MAX) -> Column:
    """`min(value / scale_max * 100, 100)` (SC13)."""
    return F.least(_col(value) / F.lit(float(scale_max)) * 100, F.lit(100.0))


def zone(rank, n_teams=None) -> Column:
    """`top` for rank <= 4, `bottom` for rank >= 18, else `mid` (SC14).

    With `n_teams` the bottom zone is the last three ranks of a league of that size.
    """
    r = _col(rank)
    bottom = r >= BOTTOM_ZONE_FIRST_RANK if n_teams is None else r > _col(n_teams) - BOTTOM_ZONE_SIZE
    return F.when(r <= TOP_ZONE_LAST_RANK, "top").when(bottom, "bottom").otherwise("mid")


def outcome(goals_for, goals_against) -> Column:
    """`W` / `L` / `D` from a score (SC15)."""
    gf, ga = _col(goals_for), _col(goals_against)
    return F.when(gf > ga, "W").when(gf < ga, "L").otherwise("D")


def sign_flag(diff) -> Column:
    """`over` when the performance difference is above zero, else `under`
    (zero and missing count as not over-performing) (SC16)."""
    d = _col(diff)
    return F.when(d > 0, "over").otherwise("under")


def side_label(side) -> Column:
    """`h` -> `HOME`, anything else -> `AWAY` (SC18)."""
    return F.when(_col(side) == "h", "HOME").otherwise("AWAY")


def first_present(*cols, default=None) -> Column:
    """First non-null, non-empty value (JS `a || b || "x"`) (SC17)."""
    parts = [F.nullif(_col(c), F.lit("")) for c in cols]
    if default is not None:
        parts.append(F.lit(default))
    return F.coalesce(*parts)


def difference(a, b, digits: int | None = 2) -> Column:
    """`a - b`, optionally rounded: goal difference, over-performance (PRJ11, AGG5)."""
    d = _col(a) - _col(b)
    return F.round(d, digits) if digits is not None else d
