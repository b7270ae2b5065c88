"""Date arithmetic: two day-of-year conventions, month ends and backward slots."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def doy(date: str | Column) -> Column:
    """1-based day of year (composite channel)."""
    return F.dayofyear(date)


def julian0(date: str | Column) -> Column:
    """0-based days since 1 January (phenology maps); 1 January itself reads as 0, i.e. "none"."""
    return F.dayofyear(date) - 1


def month_floor(date: str | Column) -> Column:
    return F.trunc(date, "month")


def month_end(date: str | Column) -> Column:
    """Last day of the month with February always ending on the 28th."""
    end = F.last_day(date)
    return F.when(F.month(end) == 2, F.make_date(F.year(end), F.lit(2), F.lit(28))).otherwise(end)


def month_ends_back(end: str | Column, n: int | Column) -> Column:
    """Array of ``n`` month ends, the month of ``end`` first."""
    end = F.col(end) if isinstance(end, str) else end
    last = F.lit(n) if isinstance(n, int) else n
    return F.transform(F.sequence(F.lit(0), last - 1), lambda i: month_end(F.add_months(month_floor(end), -i)))


def slot_count(n_months: int, days: int) -> int:
    return math.ceil(n_months * 30 / days)


def backward_slot(date: str | Column, end: str | Column, steps: int, days: int) -> Column:
    """Slot of a date counted back from ``end`` (last slot = steps - 1); NULL outside all slots."""
    age = F.datediff(end, date)
    slot = F.lit(steps - 1) - F.floor(age / days).cast("int")
    return F.when((age >= 0) & (age < steps * days), slot)


def slot_end(slot: str | Column, end: str | Column, steps: int, days: int) -> Column:
    slot = F.col(slot) if isinstance(slot, str) else slot
    return F.date_sub(end, (F.lit(steps - 1) - slot) * days)
