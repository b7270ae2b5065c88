"""Polygons as quadtree covers: coarse cells inside, single pixels along the outline, joined to pixels as ranges of Morton codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..relational import join_lookup
from ..session import written_table

#: A cell is told apart by a point in its first pixel, off the places where vertices and pixel centres usually lie.
_OFF_X, _OFF_Y = 0.41421356, 0.31830989
#: The cover is copied to at most so many times its rows when it is cut at the cells that pixels look up.
COPIES = 4


def _spread(v: Column) -> Column:
    """The bits of a number under 2^31, each followed by a 0."""
    v = v.cast("bigint")
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton(x: Column, y: Column) -> Column:
    """Bits of x and y in turn: the pixels of a quadtree cell have consecutive codes."""
    return _spread(x).bitwiseOR(F.shiftleft(_spread(y), 1))


def _crossings(edges: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Edges that cross the way from (x0, y0) along x to (x1, y0) and from there along y to (x1, y1), up and right of the start."""
    def along_x(e: Column) -> Column:
        at = e["ax"] + (y0 - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return ((e["ay"] > y0) != (e["by"] > y0)) & (at > x0) & (at <= x1)

    def along_y(e: Column) -> Column:
        at = e["ay"] + (x1 - e["ax"]) * (e["by"] - e["ay"]) / F.nullif(e["bx"] - e["ax"], F.lit(0.0))
        return ((e["ax"] > x1) != (e["bx"] > x1)) & (at > y0) & (at <= y1)
    return F.size(F.filter(edges, along_x)) + F.size(F.filter(edges, along_y))


def _meeting(edges: Column, x: Column, y: Column, side: int) -> Column:
    """The edges that meet the square of that side whose lower left corner is (x, y)."""
    def meets(e: Column) -> Column:
        near = (F.greatest(e["ax"], e["bx"]) >= x) & (F.least(e["ax"], e["bx"]) < x + side) & (F.greatest(e["ay"], e["by"]) >= y) & (F.least(e["ay"], e["by"]) < y + side)
        turns = [(e["bx"] - e["ax"]) * (y + dy - e["ay"]) - (e["by"] - e["ay"]) * (x + dx - e["ax"]) for dx in (0, side) for dy in (0, side)]
        return near & (F.least(*turns) <= 0) & (F.greatest(*turns) >= 0)
    return F.filter(edges, meets)


def polygon_cover(polygons: DataFrame, depth: int, cell: float = 1.0, x0: float = -0.5, y0: float = -0.5, touched: bool = True) -> DataFrame:
    """(polygon_id, lo, hi): Morton codes lo <= code < hi of the pixels of each polygon, one row per cell of its cover.

    ``polygons`` has ``polygon_id`` and ``rings``, arrays of closed rings of (x, y): outer rings, holes and further parts in any
    order; what an odd number of rings encloses is inside. The grid has 2^depth pixels of side ``cell`` each way from (x0, y0).

    Cells that an edge meets are split, each child with the edges that meet it; the others are whole, inside or outside. A
    child's side follows from its parent's by the edges crossed on the way between, which all meet the parent. So the rows
    grow with the outline, not the area. With ``touched``, every pixel that an edge meets counts, else those whose
    centre is inside. Polygons without rings have no cover. Halfway down, the cells of large polygons are dealt out.
    """
    scaled = lambda p, c, low: ((p[c] - low) / cell).cast("double")
    def edges_of(ring: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.struct(
            *[scaled(F.get(ring, i - 1 + k), c, low).alias(f"{n}{c}") for k, n in enumerate("ab") for c, low in (("x", x0), ("y", y0))]))
    edges = F.flatten(F.transform(F.filter("rings", lambda r: F.size(r) > 1), edges_of))
    nodes = polygons.select("polygon_id", F.explode(F.array(edges)).alias("edges")).filter(F.size("edges") > 0)
    # the first cell by a way from beyond all edges: from far left along x
    far = F.array_min(F.transform("edges", lambda e: F.least(e["ax"], e["bx"]))) - 1
    start = _crossings(F.col("edges"), far, F.lit(_OFF_Y), F.lit(_OFF_X), F.lit(_OFF_Y)) % 2 == 1
    nodes = nodes.withColumn("inside", start)
    nodes = nodes.select("polygon_id", F.lit(0).cast("bigint").alias("x"), F.lit(0).cast("bigint").alias("y"), F.lit(depth).alias("k"),
                         _meeting(F.col("edges"), F.lit(0), F.lit(0), 1 << depth).alias("edges"), "inside")
    for level in range(depth - 1, -1, -1):
        side = 1 << level

        def child(corner: Column) -> Column:
            x, y = F.col("x") + corner["dx"], F.col("y") + corner["dy"]
            crossed = _crossings(F.col("edges"), F.col("x") + _OFF_X, F.col("y") + _OFF_Y, x + _OFF_X, y + _OFF_Y)
            return F.struct(x.alias("x"), y.alias("y"), F.lit(level).alias("k"), _meeting(F.col("edges"), x, y, side).alias("edges"),
                            (F.col("inside") != (crossed % 2 == 1)).alias("inside"))
        whole = F.array(F.struct("x", "y", "k", "edges", "inside"))
        split = F.transform(F.array(*[F.struct(F.lit(dx).cast("bigint").alias("dx"), F.lit(dy).cast("bigint").alias("dy")) for dx in (0, side) for dy in (0, side)]), child)
        kept = F.filter(F.when(F.size("edges") == 0, whole).otherwise(split), lambda c: (F.size(c["edges"]) > 0) | c["inside"])
        nodes = nodes.select("polygon_id", F.explode(kept).alias("c")).select("polygon_id", "c.*")
        if level == depth // 2:
            nodes = nodes.repartition("polygon_id", "x", "y")
    if not touched:
        def centre(e: Column) -> Column:
            x, y = F.col("x") + 0.5, F.col("y") + 0.5
            return _crossings(e, F.col("x") + _OFF_X, F.col("y") + _OFF_Y, x, y) % 2 == 1
        nodes = nodes.filter((F.size("edges") == 0) | (F.col("inside") != centre(F.col("edges"))))
    else:
        nodes = nodes.filter((F.size("edges") > 0) | F.col("inside"))
    low = morton(F.col("x"), F.col("y"))
    return nodes.select("polygon_id", low.alias("lo"), (low + F.expr("shiftleft(1L, 2 * k)")).alias("hi"))


def _cut(cover: DataFrame, depth: int) -> int:
    """Size (as a power of 4) of the cells that pixels look up: the smallest for which cutting the larger ones at most
    multiplies the cover by ``COPIES``. Reads one row per size."""
    sizes = {int(r["s"]): r["n"] for r in cover.groupBy(F.round(F.log2(F.col("hi") - F.col("lo")) / 2).cast("int").alias("s")).agg(F.count("*").alias("n")).collect()}
    rows = sum(sizes.values())
    return next(b for b in range(depth + 1) if sum(n * 4 ** max(s - b, 0) for s, n in sizes.items()) <= COPIES * rows or b == depth)


def clip_polygons(df: DataFrame, polygons: DataFrame, height: int, width: int, touched: bool = True, cell: float = 1.0,
                  x0: float = -0.5, y0: float = -0.5, x: str = "x", y: str = "y") -> DataFrame:
    """Pixels that a polygon touches (or whose centre lies in it), with its ``polygon_id``; one row per pixel and polygon.

    The pixel (column i, row j) of the ``height`` x ``width`` grid is the square of side ``cell`` from (x0 + i cell, y0 + j cell);
    by default pixels are named by the whole numbers at their centres. See :func:`polygon_cover` for the polygons. The cover is
    written, cut at the cells of one size, and joined to the pixels by that cell, broadcast if it is small, else salted; within
    a cell the codes decide. Pixels outside the grid or without coordinates are in no polygon.
    """
    depth = max(math.ceil(math.log2(max(height, width, 2))), 1)
    cover = written_table(polygon_cover(polygons, depth, cell, x0, y0, touched), "polygon-cover")
    b = _cut(cover, depth)
    keyed = cover.withColumn("_cell", F.explode(F.sequence(F.shiftright("lo", 2 * b), F.shiftright(F.col("hi") - 1, 2 * b))))
    place = lambda v, low: F.floor((F.col(v) - low) / cell)
    rows = df.withColumns({"_i": place(x, x0), "_j": place(y, y0)}).filter(F.col("_i").between(0, width - 1) & F.col("_j").between(0, height - 1))
    # the code comes out of a generator: the join's tests for missing values would otherwise move below the steps that make ``df`` and
    # compute the long expression of the code again for every row that they read
    rows = rows.withColumn("_morton", morton(F.col("_i"), F.col("_j"))).withColumn("_code", F.explode(F.array("_morton")))
    rows = rows.withColumn("_cell", F.shiftright("_code", 2 * b))
    keyed = keyed.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    joined = join_lookup(rows, keyed, ["_cell"]).filter((F.col("_code") >= F.col("_lo")) & (F.col("_code") < F.col("_hi")))
    return joined.select(*df.columns, "polygon_id")
