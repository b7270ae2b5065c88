"""From class maps and matched curves to crop-calendar maps."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions import calendar as cal, labels
from ..relational import exact_median, join_null_safe, spread

STAGE_COLUMNS = ("greenup", "maturity", "senescence", "dormancy")


def modal_class(df: DataFrame, keys: Sequence[str], cls: str = "class") -> DataFrame:
    """Most frequent class and crop flag over time, the smallest on ties."""
    return df.groupBy(*keys).agg(F.mode(cls, True).alias("class"),
                                 F.mode(labels.is_crop(cls).cast("int"), True).alias("crop_mask"))


def cluster_curve(df: DataFrame, keys: Sequence[str], method: str = "median", drop_zero_rows: bool = True,
                  vi: str = "vi") -> DataFrame:
    """Median or mean curve per cluster and step; rows with a missing value (and, by default, all-zero rows) left out.

    Clusters can hold a large share of all pixels, so the median is computed by bracketing, not by collecting; that
    reads the curves twice, so store curves that are expensive to compute first.
    """
    usable = F.forall(vi, lambda v: v.isNotNull())
    if drop_zero_rows:
        usable = usable & F.exists(vi, lambda v: v != 0)
    steps = df.filter(usable).select(*keys, F.posexplode(vi).alias("step", "_vi"))
    if method == "mean":
        return steps.groupBy(*keys, "step").agg(F.avg("_vi").alias("vi"))
    if method == "median":
        return exact_median(steps, [*keys, "step"], "_vi", "vi")
    raise ValueError(f"method must be median or mean, not {method!r}")


def curve_arrays(curve: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Long curves back to step-ordered arrays."""
    return curve.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "vi"))).alias("_s")) \
        .select(*keys, F.transform("_s", lambda s: s["vi"]).alias("vi"))


def stage_median(df: DataFrame, keys: Sequence[str], value: str = "doy") -> DataFrame:
    """Median day over months, zeros excluded. Days take at most 366 values, so the state stays small."""
    return df.groupBy(*keys).agg(F.median(F.nullif(F.col(value), F.lit(0))).alias(value))


def snap_day(day: str | Column, interval: int = 14) -> Column:
    """Bin centre of a day; days past the last whole bin stay as they are."""
    day = F.col(day) if isinstance(day, str) else day
    last = 365 // interval * interval
    snapped = F.floor(day / interval) * interval + interval // 2
    return F.when((day >= 0) & (day < last), snapped.cast("double")).otherwise(day.cast("double"))


def biweekly_snap(df: DataFrame, value: str = "doy", interval: int = 14) -> DataFrame:
    return df.withColumn(value, snap_day(value, interval))


def suppress_rare(df: DataFrame, image: Sequence[str], value: str = "doy", min_percent: float = 1.0) -> DataFrame:
    """Values held by less than ``min_percent`` of all pixels of an image become NULL; missing pixels count in the total.

    The counts per image and value are joined to the image totals and back, so an image may hold any number of values;
    pixels with a NULL image key are an image of their own.
    """
    counts = df.groupBy(*image, value).agg(F.count("*").alias("_n"))
    totals = counts.groupBy(*image).agg(F.sum("_n").alias("_total"))
    rare = (join_null_safe(counts, totals, image).filter(F.col(value).isNotNull() & (F.col("_n") * 100.0 / F.col("_total") < min_percent))
            .select(*image, value, F.lit(True).alias("_rare")))
    marked = join_null_safe(df, rare, [*image, value], "left")
    return marked.withColumn(value, F.when(F.col("_rare").isNull(), F.col(value))).drop("_rare")


def validate_stages(df: DataFrame, zero_is_missing: bool, max_rise: int = 105, max_fall: int = 105) -> DataFrame:
    """Plausibility rules on greenup, maturity, senescence and dormancy days, applied in order."""
    if zero_is_missing:
        df = df.withColumns({c: F.nullif(F.col(c), F.lit(0.0)) for c in STAGE_COLUMNS})
    g, m, s, d = (F.col(c) for c in STAGE_COLUMNS)
    none = F.lit(None).cast("double")
    # 1: without a greenup, maturity and senescence fall away (with zero_is_missing: unless both are missing already,
    #    which changes nothing; without it: unless both are present)
    orphan = g.isNull() if zero_is_missing else g.isNull() & ~(m.isNotNull() & s.isNotNull())
    df = df.withColumns({"maturity": F.when(~orphan, m), "senescence": F.when(~orphan, s)})
    # 2: maturity must follow greenup within the limit
    bad_rise = F.coalesce((m - g > max_rise) | (g >= m), F.lit(False))
    df = df.withColumns({"greenup": F.when(~bad_rise, g), "maturity": F.when(~bad_rise, m)})
    # 3: a lone senescence is dropped
    lone = g.isNull() & m.isNull() & s.isNotNull() & d.isNull()
    df = df.withColumn("senescence", F.when(lone, none).otherwise(s))
    # 4: dormancy must come within the limit after senescence
    bad_fall = F.coalesce(d - s > max_fall, F.lit(False))
    return df.withColumns({"senescence": F.when(~bad_fall, s), "dormancy": F.when(~bad_fall, d)})


def validate_phenology(df: DataFrame, max_rise: int = 105, max_fall: int = 105) -> DataFrame:
    return validate_stages(df, True, max_rise, max_fall)


def check_phenology(df: DataFrame, max_rise: int = 105, max_fall: int = 105) -> DataFrame:
    return validate_stages(df, False, max_rise, max_fall)


def stages_long(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """One row per stage with its day."""
    pairs = F.array(*[F.struct(F.lit(name).alias("stage"), F.col(c).cast("double").alias("day"))
                      for name, c in zip(labels.STAGES, STAGE_COLUMNS)])
    return df.select(*ids, F.inline(pairs))


def phenology_dates(df: DataFrame, first_date: str = "first_date", day: str = "day") -> DataFrame:
    """First slot date plus whole days; 0 or missing gives no event. Adds ``event_date`` and 0-based ``doy``."""
    offset = F.nullif(F.col(day), F.lit(0.0)).cast("int")
    return (df.withColumn("event_date", F.date_add(first_date, offset))
            .withColumn("doy", cal.julian0("event_date")))


# Search ranges and limits of the shape-model fit.
FIRST_DAY, DAY_STEP, N_POINTS = 1, 14, 13
HALF_WINDOW, MAX_PASSES, DAY_TOLERANCE, MIN_R = 45, 10, 0.1, 0.8
SHIFT_RANGE, SCALE_RANGE = (-30, 30), (0.7, 1.3)
SHIFT_STEP, SCALE_STEP, SHIFT_NEAR, SCALE_NEAR = 1, 0.05, 4, 0.2


def _fit_losses(target: np.ndarray, reference: np.ndarray, p0: np.ndarray, shift: np.ndarray,
                scale: np.ndarray) -> np.ndarray:
    """1 - Pearson r for (rows x candidates) shift/scale pairs, inside the window around the shifted stage day."""
    p, moved, fixed = p0[:, None], shift * scale, (1 - scale) * p0[:, None]
    width = HALF_WINDOW // DAY_STEP * 2 + 1
    first = np.maximum(np.trunc((p - shift - HALF_WINDOW) / DAY_STEP), 0).astype(np.int64)
    length = np.minimum(width, N_POINTS - first - 1)
    count = np.maximum(length, 1)[..., None]
    row = np.arange(len(target))[:, None] * N_POINTS
    rise = np.diff(reference, axis=1, append=0.0).ravel()
    reference, target = reference.ravel(), target.ravel()
    x, y = np.empty((2, *first.shape, width))
    inside = np.arange(width) < length[..., None]
    # only the points of the window are evaluated, one at a time, so that the numbers worked on fit the caches
    for w in range(width):
        step = np.minimum(first + w, N_POINTS - 1)
        position = (FIRST_DAY + DAY_STEP * step) * scale
        position += fixed
        position += moved
        np.clip(position, 0.0, 179.0, out=position)
        # the reference curve is read on a 0.01-day grid and is flat outside its own days
        position *= 100
        np.floor(position, out=position)
        position *= 0.01
        position -= FIRST_DAY
        position /= DAY_STEP
        np.clip(position, 0.0, N_POINTS - 1.0, out=position)
        left = np.minimum(position.astype(np.int64), N_POINTS - 2)
        position -= left
        left += row
        position *= rise.take(left)
        position += reference.take(left)
        x[..., w] = position
        step += row
        y[..., w] = target.take(step)
    for values in (x, y):
        values[~inside] = 0.0
        values -= values.sum(axis=2, keepdims=True) / count
        values[~inside] = 0.0
    dot = lambda a, b: np.einsum("ijk,ijk->ij", a, b)
    r = dot(x, y) / (np.sqrt(dot(x, x)) + 1e-6) / (np.sqrt(dot(y, y)) + 1e-6)
    return np.where(length > 0, 1.0 - r, 1.0)


def fit_stage_days(target: np.ndarray, reference: np.ndarray, p0: np.ndarray) -> np.ndarray:
    """Stage days of many (series, reference, reference day) rows at once; 0 where the fit is too weak.

    Shift and scale are searched in turn over candidate grids shared by the rows; rows that settled are left out.
    """
    n = len(p0)
    shift, scale, r = np.full(n, np.inf), np.ones(n), np.full(n, -np.inf)
    active = np.arange(n)
    for round_no in range(MAX_PASSES):
        curve, y, p = reference[active], target[active], p0[active]
        if round_no == 0:
            grid = np.tile(np.arange(*SHIFT_RANGE, SHIFT_STEP, dtype=float), (len(active), 1))
            usable = np.ones_like(grid, dtype=bool)
        else:
            low = np.maximum(shift[active] - SHIFT_NEAR, SHIFT_RANGE[0])
            high = np.minimum(shift[active] + SHIFT_NEAR + 1, SHIFT_RANGE[1])
            grid = low[:, None] + SHIFT_STEP * np.arange(2 * SHIFT_NEAR + 1)
            usable = grid < high[:, None]
        loss = _fit_losses(y, curve, p, grid, np.broadcast_to(scale[active][:, None], grid.shape))
        best = np.where(usable, loss, np.inf).argmin(axis=1)
        moved = grid[np.arange(len(active)), best]
        settled = np.abs(shift[active] - moved) < DAY_TOLERANCE
        shift[active] = moved
        keep = ~settled
        active, curve, y, p = active[keep], curve[keep], y[keep], p[keep]
        if not len(active):
            break
        if round_no == 0:
            base = np.full(len(active), SCALE_RANGE[0])
            top = np.full(len(active), SCALE_RANGE[1])
        else:
            base = np.maximum(scale[active] - SCALE_NEAR, SCALE_RANGE[0])
            top = np.minimum(scale[active] + SCALE_NEAR + 1, SCALE_RANGE[1])
        sizes = np.ceil((top - base) / SCALE_STEP).astype(int)
        grid = base[:, None] + ((base + SCALE_STEP) - base)[:, None] * np.arange(sizes.max())
        usable = np.arange(sizes.max()) < sizes[:, None]
        loss = np.where(usable, _fit_losses(y, curve, p, np.broadcast_to(shift[active][:, None], grid.shape), grid), np.inf)
        best = loss.argmin(axis=1)
        scale[active] = grid[np.arange(len(active)), best]
        r[active] = 1 - loss[np.arange(len(active)), best]
    return np.where(r < MIN_R, 0.0, p0 - shift)


def smfs_fit(df: DataFrame, vi: str = "vi", reference: str = "ref_vi", p0: str = "p0", out: str = "day",
             chunk: int = 256) -> DataFrame:
    """Shape-model fit of one stage per row, in Arrow batches."""
    passed = [f for f in df.schema.fields if f.name not in (vi, reference, p0)]
    schema = T.StructType([*passed, T.StructField(out, T.DoubleType())])
    names = [f.name for f in passed]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            days = [fit_stage_days(np.stack(part[vi].to_numpy()).astype(float),
                                   np.stack(part[reference].to_numpy()).astype(float),
                                   part[p0].to_numpy(dtype=float))
                    for part in (batch.iloc[i:i + chunk] for i in range(0, len(batch), chunk))]
            result = batch[names].copy()
            result[out] = np.concatenate(days)
            yield result

    return spread(df, *names).mapInPandas(fit, schema)


def fit_stages(matched: DataFrame, ids: Sequence[str], vi: str = "vi", ref_vi: str = "ref_vi",
               phen_days: str = "phen_days") -> DataFrame:
    """All stages of each matched row in one pass: greenup .. dormancy days (NULL where the reference has no such stage).

    Rows are first spread evenly over the tasks, since the fit dominates; its stages fold inside the task, so no
    shuffle follows.
    """
    id_fields = [df_field for df_field in matched.schema.fields if df_field.name in ids]
    schema = T.StructType([*id_fields, *[T.StructField(c, T.DoubleType()) for c in STAGE_COLUMNS]])
    names = [f.name for f in id_fields]

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            result = batch[names].copy()
            stage_days = batch[phen_days].to_numpy()
            counts = np.array([len(d) for d in stage_days])
            for position, column in enumerate(STAGE_COLUMNS):
                values = np.full(len(batch), np.nan)
                for rows in np.array_split(np.flatnonzero(counts > position), max(1, len(batch) // 256)):
                    if len(rows):
                        values[rows] = fit_stage_days(
                            np.stack(batch[vi].to_numpy()[rows]).astype(float),
                            np.stack(batch[ref_vi].to_numpy()[rows]).astype(float),
                            np.array([stage_days[i][position] for i in rows], dtype=float))
                result[column] = values
            yield result

    fitted = spread(matched.select(*names, vi, ref_vi, phen_days), *names).mapInPandas(fit, schema)
    return fitted.withColumns({c: F.nanvl(F.col(c), F.lit(None)) for c in STAGE_COLUMNS})
