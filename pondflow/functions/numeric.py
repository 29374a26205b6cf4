"""Rounding and scaling column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def round_even(x, digits: int) -> Column:
    """half-to-even rounding, as Python's ``round`` (Spark's ``round`` is half-up).

    Ties are judged on the shortest decimal form of the double; Python judges
    the exact binary value, so the two differ only when that form ends in a 5
    exactly at the cut digit.
    """
    return F.bround(_c(x), digits)


def round_half_away(x, digits: int) -> Column:
    """Half-away-from-zero rounding of the binary value scaled by ``10^digits``.

    Equal to C's ``round(x * 10^n) / 10^n`` (what most SQL engines do for
    DOUBLE), unlike Spark's ``round`` which rounds the shortest decimal string.
    """
    scale = float(10 ** digits)
    return F.round(_c(x) * F.lit(scale), 0) / F.lit(scale)


def safe_range(lo, hi) -> Column:
    """Scaler range with sklearn's constant-column rule: ``max == min`` -> 1."""
    lo, hi = _c(lo), _c(hi)
    return F.when(hi == lo, F.lit(1.0)).otherwise(hi - lo)


def minmax_transform(x, lo, hi) -> Column:
    """``(x - min) / range``; no clipping, so outliers leave [0, 1]."""
    return (_c(x) - _c(lo)) / safe_range(lo, hi)


def minmax_inverse(x, lo, hi) -> Column:
    """F24 inverse: ``x * range + min``."""
    return _c(x) * safe_range(lo, hi) + _c(lo)


def safe_div(num, den) -> Column:
    """Division that follows numpy (``x/0 -> ±inf``, ``0/0 -> NaN``) under ANSI mode."""
    num, den = _c(num), _c(den)
    return (F.when(den != 0, num / den)
            .when(num == 0, F.lit(float("nan")))
            .otherwise(F.signum(num) * F.lit(float("inf"))))
