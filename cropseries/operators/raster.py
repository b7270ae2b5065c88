"""Raster geometry on pixel rows: cropping, orientation, clipping, tiling, neighbourhoods."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..relational import join_lookup, join_null_safe

BBOX_CELLS_PER_POLYGON = 4096


def _pixel_grid(images: DataFrame, keys: Sequence[str], height: int, width: int) -> DataFrame:
    """All (y, x) of every image."""
    return (images.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
            .select(*keys, "y", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x")))


def complete_grid(df: DataFrame, images: DataFrame, keys: Sequence[str], bands: Sequence[str], height: int,
                  width: int) -> DataFrame:
    """Zero-filled full images: the empty grid is stacked under the pixels and both fold in one grouping.

    Keeps one row per pixel; a union and a grouping replace the join with a generated grid. ``images`` lists the
    keys, so an image without any pixel left still comes out.
    """
    blank = _pixel_grid(images, keys, height, width)
    stacked = df.select(*keys, "y", "x", *bands).unionByName(blank, allowMissingColumns=True)
    return stacked.groupBy(*keys, "y", "x").agg(*[F.coalesce(F.max(b), F.lit(0)).alias(b) for b in bands])


def crop_pad(df: DataFrame, keys: Sequence[str], bands: Sequence[str], size: int, height: int | Column, width: int | Column) -> DataFrame:
    """Centre crop of images of the given height and width (columns where they differ) to ``size``.

    Smaller images are zero-padded at the bottom and right. The size is not guessed from the pixels present, which
    would shift images whose last rows or columns are empty.
    """
    images = df.select(*keys).distinct()
    height, width = F.lit(height), F.lit(width)
    off = lambda n: F.greatest(F.lit(0), F.floor((n - size) / 2)).cast("int")
    moved = df.withColumns({"y": F.col("y") - off(height), "x": F.col("x") - off(width)})
    inside = moved.filter(F.col("y").between(0, size - 1) & F.col("x").between(0, size - 1))
    return complete_grid(inside, images, keys, bands, size, size)


def orient_y(df: DataFrame, height: int | Column) -> DataFrame:
    """Flip rows of rasters of the given height (a column where it differs) whose y axis ascends."""
    return df.withColumn("y", (F.lit(height) - 1 - F.col("y")).cast(df.schema["y"].dataType))


def clip_bbox(df: DataFrame, x1: float, y1: float, x2: float, y2: float, padding: int = 0,
              height: int | None = None, width: int | None = None, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels with x1 <= x < x2 and y1 <= y < y2, widened by half of ``padding`` per side and clamped to the image.

    The bounds are literals on the raw columns, so they reach the Parquet scan.
    """
    pad = padding // 2
    x1, y1 = max(0, x1 - pad) if padding else x1, max(0, y1 - pad) if padding else y1
    x2 = min(width, x2 + pad) if width is not None else x2 + pad
    y2 = min(height, y2 + pad) if height is not None else y2 + pad
    return df.filter((F.col(x) >= x1) & (F.col(x) < x2) & (F.col(y) >= y1) & (F.col(y) < y2))


def _inside(px: Column, py: Column, ring: Column) -> Column:
    """Even-odd ray casting against a closed ring of (x, y) structs."""
    def crossing(inside: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, i + 1)
        straddles = (a["y"] > py) != (b["y"] > py)
        at = a["x"] + F.coalesce(F.try_divide((py - a["y"]) * (b["x"] - a["x"]), b["y"] - a["y"]), F.lit(0.0))
        return F.when(straddles & (px < at), ~inside).otherwise(inside)
    return F.aggregate(F.sequence(F.lit(0), F.size(ring) - 2), F.lit(False), crossing)


def clip_polygon(df: DataFrame, polygons: DataFrame, cell: float, x: str = "x", y: str = "y",
                 buffer: float = 0.0) -> DataFrame:
    """Pixels whose centre lies in a polygon (``polygon_id``, closed ``ring``) given in the same coordinates.

    A polygon is copied to the grid cells its bounding box touches, so pixels find candidates by an equi-join on the
    cell. Cells that no edge comes near lie wholly inside or outside, which their centre tells once per polygon: the outer
    ones go, pixels of inner ones need no further test, and only pixels of edge cells are ray-cast, against a ring that
    only edge cells carry. The cells are broadcast if their rows and bytes allow. One row per pixel and polygon it lies in.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    cell_of = lambda v: F.floor(v / F.lit(cell)).cast("bigint")
    boxed = polygons.select("polygon_id", "ring", (F.array_min(xs) - buffer).alias("_x1"), (F.array_max(xs) + buffer).alias("_x2"),
                            (F.array_min(ys) - buffer).alias("_y1"), (F.array_max(ys) + buffer).alias("_y2"))
    over = lambda low, high: F.explode(F.sequence(cell_of(low - buffer), cell_of(high + buffer)))
    edges = (polygons.select("polygon_id", "ring", F.explode(F.sequence(F.lit(0), F.size("ring") - 2)).alias("_i"))
             .select("polygon_id", F.get("ring", F.col("_i")).alias("_a"), F.get("ring", F.col("_i") + 1).alias("_b"))
             .select("polygon_id", *[f(F.col(f"_a.{c}"), F.col(f"_b.{c}")).cast("double").alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.least), ("hi", F.greatest))])
             .withColumn("_cx", over(F.col("_lox"), F.col("_hix"))).withColumn("_cy", over(F.col("_loy"), F.col("_hiy")))
             .select("polygon_id", "_cx", "_cy", F.lit(True).alias("_edge")).distinct())
    cells = (boxed.withColumn("_cx", F.explode(F.sequence(cell_of(F.col("_x1")), cell_of(F.col("_x2")))))
             .withColumn("_cy", F.explode(F.sequence(cell_of(F.col("_y1")), cell_of(F.col("_y2")))))
             .join(edges, ["polygon_id", "_cx", "_cy"], "left"))
    middle = _inside((F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell, F.col("ring"))
    cells = cells.filter(F.when(F.col("_edge"), True).otherwise(middle)).withColumn("ring", F.when(F.col("_edge"), F.col("ring")))
    keyed = df.withColumns({"_cx": cell_of(F.col(x)), "_cy": cell_of(F.col(y))})
    joined = join_lookup(keyed, cells, ["_cx", "_cy"], max_rows=BBOX_CELLS_PER_POLYGON, row_bytes=F.coalesce(F.size("ring"), F.lit(0)) * 32 + 64)
    near = F.col(x).between(F.col("_x1"), F.col("_x2")) & F.col(y).between(F.col("_y1"), F.col("_y2"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    hit = _inside(px, py, F.col("ring"))
    for dx, dy in ((buffer, 0), (-buffer, 0), (0, buffer), (0, -buffer)) if buffer else ():
        hit = hit | _inside(px + dx, py + dy, F.col("ring"))
    return joined.filter(F.when(F.col("ring").isNull(), True).otherwise(near & hit)).select(*df.columns, "polygon_id")


def border_na(df: DataFrame, bands: Sequence[str], percent: float, height: int, width: int) -> DataFrame:
    """NULL the outer ``percent`` percent of rows and columns."""
    by, bx = int(height * percent / 100), int(width * percent / 100)
    inner = F.col("y").between(by, height - by - 1) & F.col("x").between(bx, width - bx - 1)
    return df.withColumns({b: F.when(inner, F.col(b)) for b in bands})


def centre_reduction(df: DataFrame, share: float, height: int, width: int) -> DataFrame:
    """Crop towards the centre, keeping 1 - share of each side."""
    if not 0 <= share < 0.5:
        raise ValueError("share must be in [0, 0.5)")

    def bounds(n: int) -> tuple[int, int]:
        half = int(n * (1 - share) / 2)
        return max(n // 2 - half, 0), n // 2 + half if n - (n // 2 + half) > 0 else n

    (y1, y2), (x1, x2) = bounds(height), bounds(width)
    return df.filter(F.col("y").between(y1, y2 - 1) & F.col("x").between(x1, x2 - 1))


def pair_targets(inputs: DataFrame, targets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Inputs whose target exists."""
    return inputs.join(targets.select(*on).distinct(), list(on), "left_semi")


def label_join(pixels: DataFrame, labels: DataFrame, keys: Sequence[str] = ("tile_id", "y", "x")) -> DataFrame:
    """Attach label pixels to image pixels; labels outside the image are cut off, images without a label get 0."""
    return pixels.join(labels, list(keys), "left").withColumn("label", F.coalesce("label", F.lit(0)))


def align_grid(df: DataFrame, keys: Sequence[str], bands: Sequence[str], x0: float, y0: float, step: float,
               x: str = "x", y: str = "y") -> DataFrame:
    """Snap coordinates to the nearest cell of a reference grid; the nearest source wins a cell (ties: lower y, x)."""
    cell = lambda v, origin: F.floor((F.col(v) - origin) / step + 0.5).cast("int")
    keyed = df.withColumns({"row": cell(y, y0), "col": cell(x, x0)})
    dx, dy = F.col(x) - (F.col("col") * step + x0), F.col(y) - (F.col("row") * step + y0)
    order = F.struct((dx * dx + dy * dy).alias("d"), F.col(y), F.col(x), *bands)
    best = keyed.groupBy(*keys, "row", "col").agg(F.min_by(F.struct(*bands), order).alias("_b"))
    return best.select(*keys, "row", "col", *[F.col("_b")[b].alias(b) for b in bands])


def _axis_targets(df: DataFrame, keys: Sequence[str], axis: str, origin: float, step: float, n: int, low: str, high: str) -> DataFrame:
    """(keys, axis, low, high): the first and last target cells to which each coordinate of an image is the nearest.

    A coordinate's cells reach from the middle between it and the one before to the middle between it and the next, which still
    is its own. The window runs over the distinct coordinates of one axis of one image."""
    coordinates = df.select(*keys, axis).distinct()
    line = Window.partitionBy(*keys).orderBy(axis)
    place = lambda v: F.round((v - origin) / F.lit(step), 9)
    here, before, behind = F.col(axis), F.lag(axis).over(line), F.lead(axis).over(line)
    first = F.coalesce(F.floor(place((before + here) / 2)) + 1, F.ceil(place(here)))
    last = F.coalesce(F.floor(place((here + behind) / 2)), F.floor(place(here)))
    ranged = coordinates.withColumns({low: first.cast("int"), high: last.cast("int")})
    return (ranged.withColumns({low: F.greatest(F.col(low), F.lit(0)), high: F.least(F.col(high), F.lit(n - 1))}).filter(F.col(low) <= F.col(high)))


def align_nearest(df: DataFrame, keys: Sequence[str], bands: Sequence[str], x0: float, y0: float, step: float, rows: int, cols: int,
                  x: str = "x", y: str = "y") -> DataFrame:
    """Every cell of a target grid with the values of its nearest source pixel: keys, row, col, bands.

    The sources lie on a grid of their own, finer, coarser or uneven: the nearest is the one with the nearest x and the nearest y
    (of equally near ones the lower). Cells outside the range of an image's coordinates stay out, as do those whose
    nearest grid point has no pixel; all others come out, however coarse the source. A NULL key is an image of its own, pixels
    without coordinates count for nothing, and pixels that share a place come out each. Distances that differ by less than a
    billionth of a step are equal.

    The target decides, but nothing searches: each axis of an image is cut into the cells nearest to each coordinate, so a
    pixel knows its cells from two joins with short tables and is copied to just them. ``step`` must be positive.
    """
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    across = _axis_targets(df, keys, x, x0, step, cols, "_c1", "_c2")
    down = _axis_targets(df, keys, y, y0, step, rows, "_r1", "_r2")
    placed = join_null_safe(join_null_safe(df.select(*keys, x, y, *bands), across, [*keys, x]), down, [*keys, y])
    spread_rows = placed.withColumn("row", F.explode(F.sequence("_r1", "_r2")))
    return spread_rows.withColumn("col", F.explode(F.sequence("_c1", "_c2"))).select(*keys, "row", "col", *bands)


def tile_bounds(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Closed five-point bounding ring per tile as WKT."""
    box = df.groupBy(*keys).agg(F.min(x).alias("x1"), F.max(x).alias("x2"), F.min(y).alias("y1"), F.max(y).alias("y2"))
    ring = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"), ("x1", "y1")]
    text = F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *[F.concat_ws(" ", a, b) for a, b in ring]), F.lit("))"))
    return box.withColumn("wkt", text)


def hist_equalize(df: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    """256-bin histogram equalisation per image: value -> rescaled cumulative count.

    The value table has at most 256 rows per image; it joins back on the value, so only counts are windowed.
    """
    value = F.coalesce(F.col(band), F.lit(0.0)).cast("int").bitwiseAND(F.lit(255))
    binned = df.withColumn("_bin", value)
    counts = binned.groupBy(*keys, "_bin").agg(F.count("*").alias("_n"))
    image = Window.partitionBy(*keys)
    cdf = counts.withColumn("_cdf", F.sum("_n").over(image.orderBy("_bin")))
    low, high = F.min("_cdf").over(image), F.max("_cdf").over(image)
    level = F.coalesce(F.floor(F.try_divide((F.col("_cdf") - low) * 255, high - low)), F.lit(0)).cast("int")
    lut = cdf.select(*keys, "_bin", level.alias("equalized"))
    return binned.join(lut, [*keys, "_bin"]).drop("_bin")


def sobel(df: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    """Horizontal and vertical 3x3 Sobel responses with zero padding.

    The kernels are separable. Along x each pixel sends its value to its two neighbours and itself, and one grouping adds
    up difference and smooth, also where there is no pixel of its own; along y a window over the column combines three
    rows. Nothing else is shuffled.
    """
    # Sobel kernels as products of the difference (1, 0, -1) and the smooth (1, 2, 1), as cross-correlation.
    difference, smooth = {-1: 1.0, 0: 0.0, 1: -1.0}, {-1: 1.0, 0: 2.0, 1: 1.0}
    # the source at offset d of a target counts with weight d
    moves = [F.struct(F.lit(-d).alias("dx"), F.lit(difference[d]).alias("d"), F.lit(smooth[d]).alias("s"), F.lit(d == 0).alias("self")) for d in (-1, 0, 1)]
    v = F.coalesce(F.col(band), F.lit(0.0))
    sent = df.select(*keys, "y", "x", v.alias("_v"), F.explode(F.array(*moves)).alias("_m")).select(
        *keys, "y", (F.col("x") + F.col("_m.dx")).alias("x"), (F.col("_v") * F.col("_m.d")).alias("_d"),
        (F.col("_v") * F.col("_m.s")).alias("_s"), F.col("_m.self").alias("_self"))
    rows = sent.groupBy(*keys, "y", "x").agg(F.sum("_d").alias("_d"), F.sum("_s").alias("_s"), F.bool_or("_self").alias("_self"))
    column = Window.partitionBy(*keys, "x").orderBy("y")
    at = lambda c, dy: F.coalesce(F.sum(c).over(column.rangeBetween(dy, dy)), F.lit(0.0))
    both = rows.select(*keys, "y", "x", (at("_d", -1) + F.col("_d") * 2 + at("_d", 1)).alias("sobel_x"),
                       (at("_s", -1) - at("_s", 1)).alias("sobel_y"), "_self")
    return both.filter("_self").drop("_self")


def start_points(size: int, width: int, overlap: float = 0.0) -> list[int]:
    """Window starts covering ``size`` by stride; empty trailing windows are dropped."""
    stride = int(width * (1 - overlap))
    if stride < 1:
        raise ValueError("overlap leaves no stride")
    steps = max(1, math.ceil((size - width) / stride)) if size > width else 0
    return [i * stride for i in range(steps + 1) if i * stride < size]


def tile_pixels(df: DataFrame, height: int, width: int, tile_w: int | None = None, tile_h: int | None = None,
                rows: int | None = None, cols: int | None = None, overlap: float = 0.0) -> DataFrame:
    """Assign pixels to (overlapping) windows: ``col_off``, ``row_off``, column-major ``window_index``.

    The windows holding a coordinate follow from the stride by arithmetic, so nothing is joined; only an
    overlap duplicates pixels.
    """
    if rows is not None and cols is not None:
        tile_w, tile_h = math.ceil(width / cols), math.ceil(height / rows)

    def offsets(axis: str, size: int, span: int) -> tuple[Column, int]:
        n, stride = len(start_points(size, span, overlap)), int(span * (1 - overlap))
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - span + 1) / F.lit(stride)).cast("int"))
        last = F.least(F.lit(n - 1), F.floor(F.col(axis) / F.lit(stride)).cast("int"))
        # past the last window's start every coordinate belongs to that window only
        return F.sequence(F.least(first, last), last), stride

    (cx, sx), (cy, sy) = offsets("x", width, tile_w), offsets("y", height, tile_h)
    n_rows = len(start_points(height, tile_h, overlap))
    tiled = df.withColumn("_c", F.explode(cx)).withColumn("_r", F.explode(cy))
    return (tiled.withColumns({"col_off": F.col("_c") * sx, "row_off": F.col("_r") * sy,
                               "window_index": F.col("_c") * n_rows + F.col("_r")}).drop("_c", "_r"))


def cut_patches(df: DataFrame, keys: Sequence[str], bands: Sequence[str], size: int, height: int, width: int) -> DataFrame:
    """Row-major patches of ``size``, zero-padded to full size. Adds ``patch``; y and x become patch-local."""
    across, down = math.ceil(width / size), math.ceil(height / size)
    row, col = F.floor(F.col("y") / size).cast("int"), F.floor(F.col("x") / size).cast("int")
    cut = df.select(*keys, (row * across + col).alias("patch"), (F.col("y") % size).alias("y"),
                    (F.col("x") % size).alias("x"), *bands)
    blank = _pixel_grid(df.select(*keys).distinct().withColumn("patch", F.explode(F.sequence(F.lit(0), F.lit(across * down - 1)))),
                        [*keys, "patch"], size, size)
    stacked = cut.unionByName(blank, allowMissingColumns=True)
    return stacked.groupBy(*keys, "patch", "y", "x").agg(*[F.coalesce(F.max(b), F.lit(0)).alias(b) for b in bands])


def tokens_to_pixels(tokens: DataFrame, factor: int = 2, row: str = "tok_row", col: str = "tok_col") -> DataFrame:
    """Nearest upsampling: every token covers factor x factor pixels."""
    span = F.sequence(F.lit(0), F.lit(factor - 1))
    return (tokens.withColumn("_dy", F.explode(span)).withColumn("_dx", F.explode(span))
            .withColumns({"y": F.col(row) * factor + F.col("_dy"), "x": F.col(col) * factor + F.col("_dx")})
            .drop("_dy", "_dx"))
