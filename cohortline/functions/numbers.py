"""Rounding, division and parsing with one meaning everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def rnd(x, digits: int = 2) -> Column:
    """Round a double half away from zero, as scale-round-unscale.

    ``F.round(x, 2)`` goes through a decimal rendering of ``x`` and so differs in
    the last place from engines that scale the binary value.
    """
    scale = float(10**digits)
    return F.round(col(x).cast("double") * F.lit(scale)) / F.lit(scale)


def safe_div(a, b) -> Column:
    """``a / b`` as a double; null when either side is null or the denominator is zero."""
    den = col(b).cast("double")
    return col(a).cast("double") / F.when(den != 0.0, den)


def pct(a, b, digits: int = 2) -> Column:
    """``100 * a / b`` rounded; null on a zero denominator."""
    den = col(b).cast("double")
    return rnd(col(a).cast("double") * F.lit(100.0) / F.when(den != 0.0, den), digits)


def per(a, b, factor: float, digits: int) -> Column:
    """``factor * a / b`` rounded; null on a zero denominator."""
    den = col(b).cast("double")
    return rnd(col(a).cast("double") * F.lit(float(factor)) / F.when(den != 0.0, den), digits)


def parse_number(text) -> Column:
    """Number held in a formatted string such as ``₹1,234.50``; null when there is none."""
    return F.trim(F.regexp_replace(col(text).cast("string"), "[,₹]", "")).try_cast("double")
