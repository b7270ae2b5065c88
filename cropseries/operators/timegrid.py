"""Time windows and temporal composites."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import calendar as cal
from ..relational import join_null_safe, seeded_hash, spread, with_group_stats


def _date(value: str | dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


def day_offset(df: DataFrame, keys: Sequence[str], date: str = "obs_date",
               reference_date: str | None = None) -> DataFrame:
    """Absolute days to the first date of the group (or the distances to a reference date, re-based the same way)."""
    start = with_group_stats(df, keys, F.min(date).alias("_first"))
    if reference_date is None:
        return start.withColumn("day_offset", F.datediff(date, "_first")).drop("_first")
    ref = _date(reference_date)
    return start.withColumn("day_offset", F.abs(F.datediff(ref, date) - F.datediff(ref, "_first"))).drop("_first")


def month_ends(spark: SparkSession, end: str, n: int) -> DataFrame:
    """``n`` month windows going back from the month of ``end``, most recent first."""
    return (spark.range(1).select(F.posexplode(cal.month_ends_back(_date(end), n)).alias("position", "window_end")))


def time_window(df: DataFrame, start: str | Column | None = None, end: str | Column | None = None,
                n_months: int = 6, date: str = "obs_date") -> DataFrame:
    """Dates from start to end, both included; a missing one lies n_months * 30 + 1 days from the other."""
    span = n_months * 30 + 1
    if start is None:
        if end is None:
            raise ValueError("give a start or an end")
        end = _date(end)
        start = F.date_sub(end, span)
    else:
        start = _date(start)
        end = _date(end) if end is not None else F.date_add(start, span)
    return df.filter((F.col(date) >= start) & (F.col(date) <= end))


def _key_dates(df: DataFrame, keys: Sequence[str], date: str) -> DataFrame:
    # distinct dates per key are bounded by the calendar
    return df.select(*keys, date).distinct()


def random_window(df: DataFrame, keys: Sequence[str], n_months: int, seed: int, date: str = "obs_date") -> DataFrame:
    """Per key, the observations of a window that starts at a randomly drawn date of that key.

    The start is drawn from dates at least (n_months - 2) * 30 + 1 days before the last one; the window
    ends n_months * 30 + 1 days after it. The draw orders dates by a seeded hash, so it is repeatable.
    """
    ranked = _key_dates(df, keys, date).withColumn("_h", seeded_hash(seed, *keys, date))
    drawn = ranked.groupBy(*keys).agg(F.max(date).alias("_last"),
                                      F.sort_array(F.collect_list(F.struct("_h", F.col(date).alias("d")))).alias("_c"))
    latest = F.date_sub("_last", (n_months - 2) * 30 + 1)
    start = F.get(F.filter("_c", lambda c: c["d"] <= latest), F.lit(0))["d"]
    drawn = drawn.select(*keys, start.alias("window_start")).filter(F.col("window_start").isNotNull())
    return join_null_safe(df, drawn, keys).filter(
        (F.col(date) >= F.col("window_start"))
        & (F.col(date) <= F.date_add("window_start", n_months * 30 + 1)))


def random_month_window(df: DataFrame, keys: Sequence[str], n_months: int, seed: int, date: str = "obs_date",
                        starting_month: int | None = None, ending_month: int | None = None) -> DataFrame:
    """Per key, months start .. start + n_months - 1 of every year, start drawn at random."""
    span = df.groupBy(*keys).agg(F.min(F.month(date)).alias("_lo"), F.max(F.month(date)).alias("_hi"))
    low = F.lit(starting_month) if starting_month else F.col("_lo")
    high = F.lit(ending_month - n_months) if ending_month is not None else F.col("_hi") - (n_months - 1)
    drawn = span.select(*keys, (low + F.pmod(seeded_hash(seed, *keys), F.greatest(high - low, F.lit(0)) + 1))
                        .cast("int").alias("start_month"))
    return join_null_safe(df, drawn, keys).filter(
        (F.month(date) >= F.col("start_month")) & (F.month(date) < F.col("start_month") + n_months))


def latest_windows(df: DataFrame, k: int, window: str = "window_end") -> DataFrame:
    """Rows of the ``k`` most recent windows; distinct windows are calendar-bounded, so the top-k is tiny."""
    latest = df.select(window).distinct().orderBy(F.desc(window)).limit(k)
    return df.join(latest, [window], "left_semi")


def _dense_slots(sparse: DataFrame, keys: Sequence[str], values: Sequence[str], steps: int) -> DataFrame:
    """Every key gets all slots: the key's slots fold into one map, which is unrolled against the full range.

    A NULL slot stands for observations outside all slots; it fills nothing but keeps its key.
    """
    entry = F.when(F.col("slot").isNotNull(), F.struct("slot", F.struct(*values)))  # collect_list leaves NULLs out
    by_slot = sparse.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    grid = by_slot.select(*keys, "_m", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("slot"))
    found = F.try_element_at("_m", F.col("slot"))
    return grid.select(*keys, "slot", *[found[v].alias(v) for v in values])


def steps_between(df: DataFrame, days: int = 14, date: str = "obs_date") -> int:
    """Slots of ``days`` that reach from the last date of a table back to its first; 1 where there is none."""
    first, last = df.agg(F.min(date), F.max(date)).first()
    return (last - first).days // days + 1 if first is not None else 1


def composite_nanmean(df: DataFrame, keys: Sequence[str], bands: Sequence[str], end: str | Column,
                      n_months: int = 6, days: int = 14, date: str = "obs_date", steps: int | None = None) -> DataFrame:
    """Backward composite: mean of the valid values per slot counted back from ``end``, empty slots 0.

    The slots cover ``n_months`` months, or there are ``steps`` of them (see ``steps_between``). ``end`` may be a window column that is part of ``keys``. A slot's date is the mean acquisition date,
    or the slot's own end where it is empty. Dates outside all slots count for nothing, but their pixels stay,
    with empty slots. The first grouping combines on the map side, so neither a pixel with very many observations nor
    the dates outside load a task; the second moves one row per pixel and slot.
    """
    steps = cal.slot_count(n_months, days) if steps is None else steps
    end = F.col(end) if isinstance(end, str) and end in df.columns else _date(end)
    placed = df.withColumn("slot", cal.backward_slot(date, end, steps, days))
    sparse = placed.groupBy(*keys, "slot").agg(
        F.avg(F.unix_date(date)).alias("_day"), *[F.avg(b).alias(b) for b in bands])
    dense = _dense_slots(sparse, keys, ["_day", *bands], steps)
    return dense.select(
        *keys, "slot",
        F.coalesce(F.date_from_unix_date(F.floor("_day").cast("int")),
                   cal.slot_end("slot", end, steps, days)).alias("slot_date"),
        *[F.coalesce(F.col(b), F.lit(0.0)).alias(b) for b in bands])


def composite_grid(df: DataFrame, keys: Sequence[str], bands: Sequence[str], end: str | Column, steps: int,
                   interval: int = 14, date: str = "obs_date") -> DataFrame:
    """Harmonised grid: missing values count as zeros in the slot mean; adds the slot's day of year and its /365 channel.

    Pixels whose dates all lie outside the slots stay, with empty slots."""
    end = F.col(end) if isinstance(end, str) and end in df.columns else _date(end)
    placed = df.withColumn("slot", cal.backward_slot(date, end, steps, interval))
    sparse = placed.groupBy(*keys, "slot").agg(
        *[F.avg(F.coalesce(F.col(b), F.lit(0.0))).alias(b) for b in bands])
    dense = _dense_slots(sparse, keys, bands, steps)
    slot_doy = cal.doy(cal.slot_end("slot", end, steps, interval))
    return dense.select(*keys, "slot", *[F.coalesce(F.col(b), F.lit(0.0)).alias(b) for b in bands],
                        slot_doy.alias("doy"), (slot_doy / 365.0).alias("day"))


def daily_sums(df: DataFrame, keys: Sequence[str], bands: Sequence[str], date: str = "obs_date") -> DataFrame:
    """Sum and count per key, date and band: means over any longer period combine from these exactly.

    After this step a key has at most one row per calendar day, however many observations it had.
    """
    sums = [a for b in bands for a in (F.sum(b).alias(f"{b}_sum"), F.count(b).alias(f"{b}_n"))]
    return df.groupBy(*keys, date).agg(F.count("*").alias("n_obs"), *sums)


def month_window_series(df: DataFrame, keys: Sequence[str], bands: Sequence[str], end: str | Column, n_windows: int,
                        n_months: int = 6, days: int = 14, date: str = "obs_date",
                        pixels: DataFrame | None = None) -> DataFrame:
    """Composites of many month windows at once, one row per key and window with slot-ordered arrays.

    Windows overlap, so each day belongs to several. Observations are first reduced to daily sums
    (spread over key and date), then regrouped once by key; the window explosion, slot means and
    array building all reuse that one partitioning. Columns: ``window_end``, ``first_date`` (date of slot 0),
    ``days`` (slot day offsets from it) and one array per band, empty slots 0. ``pixels`` (rows of ``keys``) keeps
    those pixels only; it is applied to the daily sums, where no pixel exceeds the calendar, so a pixel with very
    many observations cannot load one join task.
    """
    steps = cal.slot_count(n_months, days)
    end = _date(end) if not isinstance(end, Column) else end
    daily = daily_sums(df, keys, bands, date)
    if pixels is not None:
        daily = daily.join(pixels, list(keys), "left_semi")
    # there are no more daily sums than observations, which are counted first without reading their columns
    daily = spread(daily, *keys, rows=df.count()).withColumn("_end", end)
    # a day lies in the windows ending in its own month and in the following ones the span can reach
    first = cal.month_floor(date)
    reach = F.array(*[cal.month_end(F.add_months(first, i)) for i in range(steps * days // 28 + 2)])
    placed = (daily.withColumns({"_newest": cal.month_end("_end"), "_oldest": F.add_months(cal.month_floor("_end"), 1 - n_windows)})
              .withColumn("window_end", F.explode(reach))
              .filter(F.col("window_end").between(F.col("_oldest"), F.col("_newest")))
              .withColumn("slot", cal.backward_slot(date, "window_end", steps, days)).filter(F.col("slot").isNotNull()))
    slots = placed.groupBy(*keys, "window_end", "slot").agg(
        (F.sum(F.unix_date(date) * F.col("n_obs")) / F.sum("n_obs")).alias("_day"),
        *[F.coalesce(F.try_divide(F.sum(f"{b}_sum"), F.sum(f"{b}_n")), F.lit(0.0)).alias(b) for b in bands])
    rows = slots.groupBy(*keys, "window_end").agg(
        F.map_from_entries(F.collect_list(F.struct("slot", F.struct("_day", *bands)))).alias("_m"))
    order = F.sequence(F.lit(0), F.lit(steps - 1))
    slot_day = F.transform(order, lambda s: F.coalesce(
        F.floor(F.try_element_at(F.col("_m"), s)["_day"]).cast("int"),
        F.unix_date(F.date_sub("window_end", (F.lit(steps - 1) - s) * days))))

    def slot_values(band: str) -> Column:
        return F.transform(order, lambda s: F.coalesce(F.try_element_at(F.col("_m"), s)[band], F.lit(0.0)))

    return (rows.withColumn("_days", slot_day).withColumns({b: slot_values(b) for b in bands})
            .select(*keys, "window_end", F.date_from_unix_date(F.col("_days")[0]).alias("first_date"),
                    F.transform("_days", lambda d: (d - F.col("_days")[0]).cast("double")).alias("days"), *bands))


def daily_mean(df: DataFrame, keys: Sequence[str], bands: Sequence[str], date: str = "obs_date") -> DataFrame:
    return df.groupBy(*keys, date).agg(*[F.avg(b).alias(b) for b in bands])


def annual_median(df: DataFrame, keys: Sequence[str], bands: Sequence[str]) -> DataFrame:
    """Median over time of the non-zero values, missing -> 0.

    Exact; a key's distinct values are held with their counts while its median is found, at most one per observation. Reduce with
    ``daily_mean`` first where a key has very many; ``relational.exact_median`` takes groups of any size.
    """
    return df.groupBy(*keys).agg(*[F.coalesce(F.median(F.nullif(F.col(b), F.lit(0.0))), F.lit(0.0)).alias(b)
                                   for b in bands])


def stack_dates(*scenes: DataFrame) -> DataFrame:
    """Concatenate scenes along the date; order them only where the result is written."""
    stacked = scenes[0]
    for scene in scenes[1:]:
        stacked = stacked.unionByName(scene, allowMissingColumns=True)
    return stacked


def pad_dates(df: DataFrame, keys: Sequence[str], bands: Sequence[str], n: int = 100, date: str = "obs_date") -> DataFrame:
    """Number each key's dates 0, 1, ... and append all-zero steps until there are ``n``.

    Needs one row per key and date (see ``daily_mean``), which bounds a key by the calendar.
    """
    folded = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(date, *bands))).alias("_s"))
    grid = folded.select(*keys, "_s", F.explode(F.sequence(F.lit(0), F.greatest(F.size("_s"), F.lit(n)) - 1)).alias("step"))
    found = F.get("_s", F.col("step"))
    return grid.select(*keys, "step", found[date].alias(date), *[F.coalesce(found[b], F.lit(0.0)).alias(b) for b in bands])
