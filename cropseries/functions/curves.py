"""Array expressions over one curve: resampling and distances, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def euclidean(a: str | Column, b: str | Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)),
                              F.lit(0.0), lambda acc, v: acc + v))


def interpolate(curve: Column, position: Column) -> Column:
    """Linear interpolation at a fractional 0-based index, clamped at both ends."""
    last = F.size(curve) - 1
    p = F.greatest(F.lit(0.0), F.least(position, last.cast("double")))
    left = F.floor(p).cast("int")
    a, b = F.get(curve, left), F.get(curve, F.least(left + 1, last))
    return a + (b - a) * (p - left)


def curve_shift(curve: str | Column, p0: Column, tshift: Column, xscale: Column, first_day: int = 1,
                step: int = 14, last_day: float = 179.0) -> Column:
    """Reference curve resampled at shifted and scaled days: t' = clamp(t*k + (1-k)*p0 + s*k), 0.01-day lookup."""
    curve = _col(curve)

    def at(_: Column, i: Column) -> Column:
        day = (i * step + first_day).cast("double")
        moved = day * xscale + (F.lit(1.0) - xscale) * p0 + tshift * xscale
        moved = F.greatest(F.lit(0.0), F.least(F.lit(last_day), moved))
        snapped = F.floor(moved * 100.0) / 100.0
        return interpolate(curve, (snapped - first_day) / step)

    return F.transform(curve, at)
