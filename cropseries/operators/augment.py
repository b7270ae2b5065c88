"""Augmentations of pixel tables. Random ones draw from seeded hashes of the row keys, so results repeat."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..relational import join_null_safe, seeded_hash, unit_hash, with_group_stats


def flip(df: DataFrame, code: int | Column, height: int, width: int) -> DataFrame:
    """0 flips rows, 1 flips columns, -1 both; image and target columns move together.

    ``code`` may be a column, as a seeded draw from the image keys (``draw``); NULL flips nothing.
    """
    code = F.lit(code)
    return df.withColumns({"y": F.when(code <= 0, F.lit(height - 1) - F.col("y")).otherwise(F.col("y")),
                           "x": F.when(code != 0, F.lit(width - 1) - F.col("x")).otherwise(F.col("x"))})


def draw(seed: int, keys: Sequence[str], low: float, high: float) -> Column:
    """A number from [low, high) per image, the same in every row of it."""
    return unit_hash(seed, *keys) * (high - low) + low


def draw_one(seed: int, keys: Sequence[str], values: Sequence[int | None]) -> Column:
    """One of the values per image."""
    return F.element_at(F.array(*[F.lit(v).cast("int") for v in values]), (F.pmod(seeded_hash(seed, *keys), F.lit(len(values))) + 1).cast("int"))


def affine_remap(df: DataFrame, keys: Sequence[str], bands: Sequence[str], height: int, width: int,
                 shift: tuple[int | Column, int | Column] = (0, 0), angle: float | Column = 0.0, zoom: float | Column = 0.0) -> DataFrame:
    """Shift, rotation about (w//2, h//2) and zoom-in with nearest sampling and zero fill.

    Shift, angle and zoom may be columns made from ``keys`` (``draw``): each image then moves by its own draw, all its
    steps and targets alike if they share those keys.

    Output pixel (y, x) reads source floor(v + 0.5) of the inverse map. With the key of the source pixel
    computed per output pixel, remapping is one equi-join.
    """
    cos, sin = F.cos(F.radians(F.lit(angle))), F.sin(F.radians(F.lit(angle)))
    cx, cy = width // 2, height // 2
    grid = (df.select(*keys).distinct()
            .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
            .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1)))))
    # shift (dx, dy) in source coordinates, then rotation, then zoom about the centre
    x, y = F.col("x") + F.lit(shift[0]) - cx, F.col("y") + F.lit(shift[1]) - cy
    zx, zy = x / (F.lit(1.0) + zoom), y / (F.lit(1.0) + zoom)
    src_x, src_y = zx * cos - zy * sin + cx, zx * sin + zy * cos + cy
    wanted = grid.withColumns({"_sx": F.floor(src_x + 0.5).cast("int"), "_sy": F.floor(src_y + 0.5).cast("int")})
    source = df.select(*keys, F.col("y").alias("_sy"), F.col("x").alias("_sx"), *bands)
    joined = wanted.join(source, [*keys, "_sy", "_sx"], "left")
    return joined.select(*keys, "y", "x", *[F.coalesce(F.col(b), F.lit(0)).alias(b) for b in bands])


def step_mask(df: DataFrame, patch: Sequence[str], step: str, band: str, seed: int, max_percent: int = 40,
              max_empty: float = 0.4) -> DataFrame:
    """Steps to blank per patch: int(t * r/100) of them, r drawn from 0..max_percent, none if too many are empty."""
    steps = df.groupBy(*patch, step).agg(F.bool_or(F.coalesce(F.col(band), F.lit(0.0)) != 0).alias("_any"))
    # steps per patch are bounded by the calendar
    folded = steps.groupBy(*patch).agg(
        F.sort_array(F.collect_list(F.struct(seeded_hash(seed, *patch, step).alias("h"), F.col(step).alias("s")))).alias("_s"),
        F.avg((~F.col("_any")).cast("double")).alias("_empty"))
    percent = F.pmod(seeded_hash(seed + 1, *patch), F.lit(max_percent + 1))
    n = F.when(F.col("_empty") < max_empty, F.floor(F.size("_s") * percent / 100.0).cast("int")).otherwise(0)
    return folded.select(*patch, F.explode(F.slice("_s", F.lit(1), n)).alias("_p")).select(*patch, F.col("_p")["s"].alias(step))


def mask_times(df: DataFrame, patch: Sequence[str], step: str, bands: Sequence[str], seed: int,
               max_percent: int = 40) -> DataFrame:
    """Zero a random share of time steps."""
    masked = step_mask(df, patch, step, bands[0], seed, max_percent).withColumn("_hit", F.lit(True))
    joined = df.join(masked, [*patch, step], "left")
    return joined.withColumns({b: F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col(b)) for b in bands}).drop("_hit")


def block_rectangles(df: DataFrame, ids: Sequence[str], height: int, width: int, seed: int, max_share: float = 0.15,
                     n_blocks: int = 4) -> DataFrame:
    """Add ``n_blocks`` seeded rectangles (``_y1_i``, ``_x1_i``, ``_h_i``, ``_w_i``) of each (patch, step).

    Their areas split a share of the image drawn from 0 to ``max_share``; the aspect ratio lies between 0.3 and 1/0.3.
    A rectangle takes what is left of the share up to and with its own part, so rounding and rectangles of no size
    hand their area on to the next; none exceeds what is left. A rectangle without area is NULL.
    """
    blocks = range(n_blocks)
    df = df.withColumn("_budget", unit_hash(seed, *ids) * max_share * height * width)
    df = df.withColumns({f"_u_{i}": unit_hash(seed * 1009 + 500_009 + i, *ids) + 0.1 for i in blocks})
    total = sum((F.col(f"_u_{i}") for i in blocks[1:]), F.col("_u_0"))
    df = df.withColumns({f"_a_{i}": F.col("_budget") * F.col(f"_u_{i}") / total for i in blocks})
    spent, due = F.lit(0), F.lit(0.0)
    for i in blocks:
        due = due + F.col(f"_a_{i}")
        left = F.col(f"_l_{i}")
        df = df.withColumn(f"_l_{i}", due - spent)  # this one's part and what the earlier ones left
        aspect = F.exp((unit_hash(seed * 1009 + i * 3, *ids) * 2 - 1) * math.log(1 / 0.3))
        h = F.least(F.greatest(F.round(F.sqrt(left * aspect)), F.lit(1.0)), F.lit(float(height)), F.floor(left))
        df = df.withColumn(f"_h_{i}", F.when(left >= 1, h.cast("int")))
        df = df.withColumn(f"_w_{i}", F.least(F.floor(left / F.col(f"_h_{i}")), F.lit(width)).cast("int"))
        df = df.withColumn(f"_w_{i}", F.when(F.col(f"_h_{i}").isNotNull(), F.col(f"_w_{i}")))
        spent = spent + F.coalesce(F.col(f"_h_{i}") * F.col(f"_w_{i}"), F.lit(0))
    corner = {}
    for i in blocks:
        corner[f"_y1_{i}"] = F.floor(unit_hash(seed * 1009 + i * 3 + 1, *ids) * (F.lit(height + 1) - F.col(f"_h_{i}"))).cast("int")
        corner[f"_x1_{i}"] = F.floor(unit_hash(seed * 1009 + i * 3 + 2, *ids) * (F.lit(width + 1) - F.col(f"_w_{i}"))).cast("int")
    return df.withColumns(corner).drop("_budget", *[f"_{c}_{i}" for i in blocks for c in "ual"])


def mask_blocks(df: DataFrame, step_ids: Sequence[str], bands: Sequence[str], height: int, width: int, seed: int,
                max_share: float = 0.15, n_blocks: int = 4) -> DataFrame:
    """Zero random rectangles of each time step.

    The rectangles are drawn once for each step and joined to its pixels, steps with a NULL key included: a draw costs far more than
    a row's part of the join. ``df`` is read twice, so store it first where it is expensive to compute.
    """
    hit = F.lit(False)
    for i in range(n_blocks):
        dy, dx = F.col("y") - F.col(f"_y1_{i}"), F.col("x") - F.col(f"_x1_{i}")
        hit = hit | F.coalesce((dy >= 0) & (dy < F.col(f"_h_{i}")) & (dx >= 0) & (dx < F.col(f"_w_{i}")), F.lit(False))
    steps = block_rectangles(df.select(*step_ids).distinct(), step_ids, height, width, seed, max_share, n_blocks)
    drawn = join_null_safe(df, steps, step_ids).withColumn("_hit", hit)
    return drawn.select(*[(F.when(F.col("_hit"), F.lit(0.0)).otherwise(F.col(c)).alias(c) if c in bands else F.col(c))
                          for c in df.columns])


def _normal(seed: int, *ids: str | Column) -> Column:
    """Standard normal from two hashes of the row key (Box-Muller): independent of partitioning and retries."""
    u1 = F.greatest(unit_hash(seed, *ids), F.lit(1e-12))
    return F.sqrt(F.log(u1) * -2.0) * F.cos(unit_hash(seed + 1, *ids) * (2 * math.pi))


def add_noise(df: DataFrame, step_ids: Sequence[str], row_ids: Sequence[str], bands: Sequence[str], seed: int,
              mode: str = "gaussian", mean: float = 0.0, std: tuple[float, float] = (0.01, 0.05)) -> DataFrame:
    """``gaussian``: v + n on steps that are not all zero. ``speckle``: v + v * n, zeros kept, negatives -> 0."""
    noise = {}
    if mode == "gaussian":
        first = bands[0]
        df = with_group_stats(df, step_ids, F.bool_or(F.coalesce(F.col(first), F.lit(0.0)) != 0).alias("_any"))
        sigma = unit_hash(seed + 7, *step_ids[:-1] or step_ids) * (std[1] - std[0]) + std[0]
        for i, b in enumerate(bands):
            noisy = F.col(b) + _normal(seed + 10 * (i + 1), *row_ids) * sigma + mean
            noise[b] = F.when(F.col("_any"), noisy).otherwise(F.col(b))
        return df.withColumns(noise).drop("_any")
    if mode == "speckle":
        for i, b in enumerate(bands):
            noisy = F.col(b) + F.col(b) * (_normal(seed + 10 * (i + 1), *row_ids) * std[1] + mean)
            noise[b] = F.when(F.col(b) == 0, F.lit(0.0)).otherwise(F.greatest(noisy, F.lit(0.0)))
        return df.withColumns(noise)
    raise ValueError(f"mode must be gaussian or speckle, not {mode!r}")


def cutmix_partners(df: DataFrame, patch: str, seed: int, height: int, width: int, batch_size: int = 12) -> DataFrame:
    """Partner and rectangle per patch: patches hash into batches, inside which a seeded rotation permutes them.

    The lambda of a batch is uniform, i.e. Beta(1, 1); the rectangle covers 1 - lambda of the image before clipping.
    """
    patches = df.select(patch).distinct()
    n = patches.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / batch_size)).alias("n")).scalar()
    batched = patches.withColumn("_batch", F.pmod(seeded_hash(seed, patch), n)).withColumn("_h", seeded_hash(seed + 1, patch))
    order = Window.partitionBy("_batch").orderBy("_h", patch)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    paired = batched.withColumn("partner", F.coalesce(F.lead(patch).over(order), F.first(patch).over(whole)))
    side = F.sqrt(1.0 - unit_hash(seed + 2, "_batch"))
    half_w, half_h = F.floor(side * width / 2), F.floor(side * height / 2)
    cx, cy = unit_hash(seed + 3, "_batch") * width, unit_hash(seed + 4, "_batch") * height
    clip = lambda v, top: F.greatest(F.lit(0), F.least(F.lit(top), F.floor(v).cast("int")))
    return paired.select(patch, "partner", clip(cx - half_w, width).alias("x1"), clip(cx + half_w, width).alias("x2"),
                         clip(cy - half_h, height).alias("y1"), clip(cy + half_h, height).alias("y2"))


def cutmix(df: DataFrame, patch: str, bands: Sequence[str], seed: int, height: int, width: int,
           step: Sequence[str] = (), batch_size: int = 12) -> DataFrame:
    """Copy one rectangle (all steps, image and target) from the partner patch; pixels the partner lacks become 0.

    Each source row is sent to its own patch and, inside the rectangle, to the patch it is a partner of;
    one grouping then picks the donor's value inside the rectangle. A rotation gives every patch exactly one receiver.
    """
    pairs = cutmix_partners(df, patch, seed, height, width, batch_size)
    own = df.join(pairs.drop("partner"), patch)
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    kept = own.select(patch, *step, "y", "x", *[F.when(inside, F.lit(0)).otherwise(F.col(b)).alias(b) for b in bands],
                      F.when(inside, "cut").otherwise("own").alias("origin"))
    receiver = pairs.select(F.col("partner").alias(patch), F.col(patch).alias("_to"), "x1", "x2", "y1", "y2")
    given = df.join(receiver, patch).filter(inside).select(
        F.col("_to").alias(patch), *step, "y", "x", *bands, F.lit("given").alias("origin"))
    best = kept.unionByName(given).groupBy(patch, *step, "y", "x").agg(
        F.max_by(F.struct(*bands, "origin"), F.when(F.col("origin") == "given", 1).otherwise(0)).alias("_b"))
    return best.select(patch, *step, "y", "x", *[F.col("_b")[b].alias(b) for b in bands], F.col("_b")["origin"].alias("origin"))
