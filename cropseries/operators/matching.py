"""Matching of curves to reference curves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.window import Window

from ..functions import curves
from ..relational import join_lookup, seeded_hash
from ..session import written_table

#: References of a block, and pivots of a large library.
BLOCK, MAX_PIVOTS = 512, 64
#: References that are broadcast at once, and cells of the warping tables worked on at once.
LIBRARY, DTW_CELLS = 4096, 1 << 18


def _reference_blocks(references: DataFrame, fields: Sequence[str]) -> tuple[DataFrame, int]:
    """References packed into arrays of about ``BLOCK`` so a series meets a whole block in one row."""
    n_blocks = -(-references.count() // BLOCK) or 1
    packed = (references.withColumn("_block", F.pmod(F.xxhash64("ref_id"), F.lit(n_blocks)).cast("int"))
              .groupBy("_block").agg(F.sort_array(F.collect_list(F.struct("ref_id", *fields))).alias("_refs")))
    return packed, n_blocks


def _usable(vi: str) -> Column:
    """Series with a missing value, and all-zero series, are not matched."""
    return F.forall(vi, lambda v: v.isNotNull()) & F.exists(vi, lambda v: v != 0)


def _within(best: Column, keep) -> Column:
    """The winner as a row, or no row. A generator, unlike a filter, does not make the optimizer compute it twice."""
    return F.explode(F.filter(F.array(best), keep)).alias("_best")


def _pivot_blocks(references: DataFrame, fields: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """References in blocks of at most ``BLOCK``, near each other, and the curves that they are measured from.

    A few references, drawn by their hash, are pivots. Each reference belongs to its nearest pivot, and the references of a pivot
    are cut into rings by their distance from it. Gives the written blocks (_pivot, _ring, lo, hi, _refs) and one row with the
    array of pivot curves."""
    pivots = references.orderBy(seeded_hash(0, "ref_id"), "ref_id").limit(min(-(-n // BLOCK) + 1, MAX_PIVOTS))
    pivots = written_table(pivots.agg(F.sort_array(F.collect_list(F.struct("ref_id", "vi")))["vi"].alias("_pivots")), "pivots")
    measured = references.withColumn("_all", pivots.select("_pivots").scalar())
    nearest = F.array_min(F.transform("_all", lambda p, i: F.struct(curves.euclidean(p, "vi").alias("d"), i.alias("_pivot"))))
    measured = measured.withColumn("_near", nearest).select("ref_id", *fields, F.col("_near.d").alias("_d"), F.col("_near._pivot").alias("_pivot"))
    ring = F.floor((F.row_number().over(Window.partitionBy("_pivot").orderBy("_d", "ref_id")) - 1) / BLOCK).cast("int")
    blocks = measured.withColumn("_ring", ring).groupBy("_pivot", "_ring").agg(
        F.min("_d").alias("lo"), F.max("_d").alias("hi"), F.sort_array(F.collect_list(F.struct("ref_id", *fields))).alias("_refs"))
    return written_table(blocks, "reference-blocks"), pivots


def _pivot_probes(df: DataFrame, blocks: DataFrame, pivots: DataFrame, threshold: float, vi: str) -> DataFrame:
    """The rows with ``_bounds``: (bound, _pivot, _ring) of each block that may hold a reference within the threshold, nearest first.

    A reference at distance r from a pivot is at least as far from a series at distance s as s and r differ. The directory of all
    blocks is one array, of as many entries as the library has blocks."""
    directory = blocks.agg(F.sort_array(F.collect_list(F.struct("_pivot", "_ring", "lo", "hi"))).alias("_d"))
    rows = df.withColumns({"_pivots": pivots.select("_pivots").scalar(), "_directory": directory.select("_d").scalar()})
    rows = rows.withColumn("_away", F.explode(F.array(F.transform("_pivots", lambda p: curves.euclidean(p, vi)))))
    def bound(b: Column) -> Column:
        away = F.get("_away", b["_pivot"])
        return F.struct((F.greatest(F.lit(0.0), away - b["hi"], b["lo"] - away) * (1 - 1e-12) - 1e-12).alias("bound"), b["_pivot"].alias("_pivot"), b["_ring"].alias("_ring"))
    return rows.withColumn("_bounds", F.array_sort(F.filter(F.transform("_directory", bound), lambda b: b["bound"] <= threshold))).drop("_pivots", "_directory", "_away")


def _best_by_pivots(df: DataFrame, keys: Sequence[str], references: DataFrame, attach: Sequence[str], n: int, threshold: float, vi: str, score) -> DataFrame:
    """As ``_best`` for a library of many blocks: each series meets its nearest block first, and then only the blocks whose bound
    doesn't exceed what it found there. Rows that repeat a key are matched each."""
    blocks, pivots = _pivot_blocks(references, ["vi", *[a for a in attach if a not in ("ref_vi", "vi")]], n)
    probes = _pivot_probes(df.withColumn("_row", F.monotonically_increasing_id()), blocks, pivots, threshold, vi)
    probes = written_table(probes.filter(F.size("_bounds") > 0), "probes")
    of = lambda rows: join_lookup(rows, blocks.select("_pivot", "_ring", "_refs"), ["_pivot", "_ring"], max_rows=64)
    plain = [*df.columns, "_row"]

    def met(rows: DataFrame) -> DataFrame:
        return score(of(rows.withColumns({"_pivot": F.col("_b._pivot"), "_ring": F.col("_b._ring")}).drop("_b"))).drop("_refs", "_pivot", "_ring")
    first = written_table(met(probes.select(*plain, F.get("_bounds", F.lit(0)).alias("_b"))), "winners")
    reached = first.select("_row", F.col("_best")["distance"].alias("_reached"))
    others = probes.join(reached, "_row", "left").select(*plain, F.explode(F.filter(
        F.slice("_bounds", 2, F.greatest(F.size("_bounds"), F.lit(1))), lambda b: b["bound"] <= F.coalesce("_reached", F.lit(float(threshold))))).alias("_b"))
    winners = first.unionByName(met(others))
    rest = [c for c in winners.columns if c not in keys and c != "_row"]
    best = winners.groupBy(*keys, "_row").agg(F.min_by(F.struct(*rest), F.struct(F.col("_best")["distance"], F.col("_best")["ref_id"])).alias("_w")).select(*keys, "_w.*")
    extra = [(F.col("_best")["vi"] if a == "ref_vi" else F.col("_best")[a]).alias(a) for a in attach]
    return best.withColumns({"ref_id": F.col("_best")["ref_id"], "distance": F.col("_best")["distance"]}).select("*", *extra).drop("_best")


def _best(df: DataFrame, keys: Sequence[str], references: DataFrame, attach: Sequence[str], score) -> DataFrame:
    """Best reference per row over all blocks; ties go to the lowest reference id.

    A library of one block (the usual case, its size is counted) is read once as a scalar, so nothing is joined.
    A larger one copies each series once per block, keeps the block winner without its block, and reduces the winners
    with a combining aggregate. Rows that repeat a key are matched each, in either case.
    """
    blocks, n_blocks = _reference_blocks(references, ["vi", *[a for a in attach if a != "ref_vi"]])
    if n_blocks == 1:
        scored = score(df.withColumns({"_block": F.lit(0), "_refs": blocks.select("_refs").scalar()}))
    else:
        # rows that repeat a key stay apart by their number
        probes = df.withColumn("_row", F.monotonically_increasing_id()) \
            .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        scored = score(join_lookup(probes, blocks, ["_block"], max_rows=64)).drop("_refs", "_block")
        rest = [c for c in scored.columns if c not in keys and c != "_row"]
        scored = scored.groupBy(*keys, "_row").agg(
            F.min_by(F.struct(*rest), F.struct(F.col("_best")["distance"], F.col("_best")["ref_id"])).alias("_w")) \
            .select(*keys, "_w.*")
    extra = [(F.col("_best")["vi"] if a == "ref_vi" else F.col("_best")[a]).alias(a) for a in attach]
    return scored.withColumn("ref_id", F.col("_best")["ref_id"]).withColumn("distance", F.col("_best")["distance"]) \
        .select("*", *extra).drop("_best", "_block", "_refs")


def _closest(series: np.ndarray, refs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and Euclidean distance of each series' closest reference, the first of equals; NaN only where nothing else is left.
    Squares are added step by step, as :func:`curves.euclidean` does."""
    position, distance = np.zeros(len(series), dtype=np.int32), np.empty(len(series))
    chunk = max(1, DTW_CELLS // (4 * len(refs)))
    for start in range(0, len(series), chunk):
        part = series[start:start + chunk]
        total = np.zeros((len(part), len(refs)))
        for step in range(refs.shape[1]):
            gap = refs[:, step] - part[:, step, None]
            gap *= gap
            total += gap
        total = np.sqrt(total)
        best = np.where(np.isnan(total), np.inf, total).argmin(axis=1)
        position[start:start + chunk], distance[start:start + chunk] = best, total[np.arange(len(part)), best]
    return position, distance


def _best_as_matrix(df: DataFrame, references: DataFrame, listed: list, attach: Sequence[str], threshold: float, vi: str) -> DataFrame:
    """The nearest of a few references, whose curves ``listed`` holds in their order, by matrices of Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(np.array(listed, dtype=float))

    def nearest(series: pa.Array) -> pa.Array:
        refs, found = shared.value, np.asarray(series.value_lengths()) == shared.value.shape[1]
        position, distance = np.zeros(len(series), dtype=np.int32), np.zeros(len(series))
        if found.any():
            fitting = series.filter(pa.array(found)).flatten().to_numpy(zero_copy_only=False).astype(float)
            position[found], distance[found] = _closest(fitting.reshape(-1, refs.shape[1]), refs)
        return pa.StructArray.from_arrays([pa.array(position), pa.array(distance, mask=~found)], ["position", "distance"])

    hit = F.arrow_udf(nearest, "position int, distance double").asNondeterministic()(F.col(vi))
    numbered = references.select("ref_id", F.col("vi").alias("_ref_vi"), *[F.col(a).alias(f"_a_{a}") for a in attach if a != "ref_vi"],
                                 (F.row_number().over(Window.orderBy("ref_id", "vi")) - 1).alias("_position"))  # at most BLOCK rows
    # the distance may be NaN, which is larger than any threshold, or missing where a series has another length
    found = df.withColumn("_hit", hit).select(*df.columns, _within(F.col("_hit"), lambda h: h["distance"] <= threshold))
    joined = found.withColumn("_position", F.col("_best")["position"]).join(F.broadcast(numbered), "_position")
    extra = [(F.col("_ref_vi") if a == "ref_vi" else F.col(f"_a_{a}")).alias(a) for a in attach]
    return joined.select(*df.columns, "ref_id", F.col("_best")["distance"].alias("distance"), *extra)


def nearest_reference(df: DataFrame, keys: Sequence[str], references: DataFrame, threshold: float = 0.50,
                      attach: Sequence[str] = (), vi: str = "vi") -> DataFrame:
    """Nearest reference curve by Euclidean distance, dropped above ``threshold``.

    The library is counted. Up to ``BLOCK`` references are one matrix, which Arrow batches of series meet; of a larger library each series meets only the blocks that
    distances from a few pivots cannot rule out, with the same winners. ``attach`` names reference columns to carry along (``ref_vi`` for its curve).
    """
    carried = [a for a in attach if a != "ref_vi"]

    def score(joined: DataFrame) -> DataFrame:
        def candidate(r: Column) -> Column:
            return F.struct(curves.euclidean(r["vi"], vi).alias("distance"), r["ref_id"].alias("ref_id"),
                            r["vi"].alias("vi"), *[r[a].alias(a) for a in carried])
        return joined.select("*", _within(F.array_min(F.transform("_refs", candidate)), lambda b: b["distance"] <= threshold))

    n = references.count()
    if n > BLOCK:
        return _best_by_pivots(df.filter(_usable(vi)), keys, references, attach, n, threshold, vi, score)
    listed = [r["vi"] for r in references.select("ref_id", "vi").orderBy("ref_id", "vi").collect()]
    whole = listed and all(r is not None and None not in r and len(r) == len(listed[0]) > 0 for r in listed)
    if whole and not {"ref_id", "distance", *attach} & set(df.columns) and not {"ref_id", "vi"} & set(attach):
        return _best_as_matrix(df.filter(_usable(vi)), references, listed, attach, threshold, vi)
    # curves with gaps or of several lengths
    return _best(df.filter(_usable(vi)), keys, references, attach, score)


def _dtw(a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """DTW distance of each row of ``a`` to the same row of ``b``; infinite where it exceeds that pair's ``most``.

    Every path crosses each row of the warping table, so a pair is given up as soon as a whole row lies above its limit."""
    out, live, limit = np.full(len(a), np.inf), np.arange(len(a)), most
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)  # steps first, so that a step of all pairs lies together
    before = np.full((len(b) + 1, len(live)), np.inf)
    before[0] = 0.0
    for i in range(len(a)):
        here = np.full_like(before, np.inf)
        gap = np.abs(a[i] - b)
        cheapest = np.minimum(before[:-1], before[1:])
        for j in range(len(b)):
            here[j + 1] = gap[j] + np.minimum(cheapest[j], here[j])
        kept, before = here.min(axis=0) <= limit, here
        if not kept.all():
            live, before, a, b, limit = live[kept], here[:, kept], a[:, kept], b[:, kept], limit[kept]
    found = before[-1]
    out[live] = np.where(found <= most[live], found, np.inf)
    return out


def _dtw_bounds(series: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Lower bounds of the DTW distance of every series to every reference.

    A path matches both first and both last steps, and each step in between with some step of the other curve, so at least with its
    range. That holds for either side; the larger sum counts."""
    ends = np.abs(series[:, None, 0] - refs[None, :, 0])
    if series.shape[1] > 1 and refs.shape[1] > 1:
        ends = ends + np.abs(series[:, None, -1] - refs[None, :, -1])

    def outside(inner: np.ndarray, other: np.ndarray) -> np.ndarray:
        low, high = other.min(axis=1), other.max(axis=1)
        return sum((np.maximum(0, np.maximum(v[:, None] - high, low - v[:, None])) for v in inner.T[1:-1]), np.zeros((len(inner), len(other))))
    # sums in another order than the path's may come out larger by rounding
    return (ends + np.maximum(outside(series, refs), outside(refs, series).T)) * (1 - 1e-12) - 1e-12


def _closest_by_dtw(series: Sequence[np.ndarray], refs: np.ndarray, most: float = np.inf) -> tuple[np.ndarray, np.ndarray, int]:
    """Position and distance of each series' closest reference (the first of equals), and the number of warping tables begun.

    References are tried in the order of their lower bounds, twice as many in each round, and only while their bound doesn't exceed
    the best distance so far; at first that is ``most``, beyond which there is no winner (distance infinite). Chunks keep the
    warping rows and bounds worked on at once under ``DTW_CELLS`` numbers."""
    position, distance, begun = np.zeros(len(series), dtype=np.int32), np.full(len(series), np.inf), 0
    if not len(refs) or not len(series):
        return position, distance, begun
    chunk = max(1, DTW_CELLS // (len(refs) * (refs.shape[1] + 1)))
    for start in range(0, len(series), chunk):
        part = np.stack(series[start:start + chunk]).astype(float)
        bounds = _dtw_bounds(part, refs)
        order = np.argsort(bounds, axis=1, kind="stable")
        best, at = np.full(len(part), np.inf), np.zeros(len(part), dtype=np.int64)
        first, width = 0, 1
        while first < len(refs):
            picked = order[:, first:first + width]
            limit = np.minimum(best, most)
            rows, columns = np.nonzero(np.take_along_axis(bounds, picked, axis=1) <= limit[:, None])
            if not len(rows):
                break  # the bounds only grow from here
            which = picked[rows, columns]
            begun += len(rows)
            found = _dtw(part[rows], refs[which], limit[rows])
            sorted_ = np.lexsort((which, found, rows))
            heads = sorted_[np.concatenate(([True], np.diff(rows[sorted_]) > 0))]
            r, d, w = rows[heads], found[heads], which[heads]
            better = (d < best[r]) | ((d == best[r]) & (w < at[r]) & np.isfinite(d))
            best[r[better]], at[r[better]] = d[better], w[better]
            first, width = first + width, width * 2
        position[start:start + chunk], distance[start:start + chunk] = at, best
    return position, distance, begun


def nearest_reference_dtw(df: DataFrame, keys: Sequence[str], references: DataFrame, threshold: float = 0.50,
                          attach: Sequence[str] = (), vi: str = "vi") -> DataFrame:
    """As ``nearest_reference`` with dynamic time warping, in Arrow batches. Lower bounds and early abandoning spare most
    warping tables; the winners are those of all tables.

    The library is counted first; of up to ``LIBRARY`` references the curves are broadcast once and only the series go
    through Arrow. A larger library meets the series block by block; ties go to the lowest reference id either way.
    """
    result = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("distance", T.DoubleType())])
    carried = [a for a in attach if a != "ref_vi"]
    if references.count() <= LIBRARY:
        numbered = references.select(F.col("ref_id"), F.col("vi").alias("_ref_vi"), *[F.col(a).alias(f"_a_{a}") for a in carried if a != "ref_id"],
                                     (F.row_number().over(Window.orderBy("ref_id")) - 1).alias("_position"))  # at most LIBRARY rows
        listed = [r["_ref_vi"] for r in numbered.orderBy("_position").select("_ref_vi").collect()]
        shared = df.sparkSession.sparkContext.broadcast(np.array(listed, dtype=float).reshape(len(listed), -1))

        def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for series in batches:
                position, distance, _ = _closest_by_dtw(series.to_list(), shared.value, threshold)
                yield pd.DataFrame({"position": position, "distance": distance})

        hit = F.pandas_udf(nearest, result).asNondeterministic()(F.col(vi))
        found = df.filter(_usable(vi)).withColumn("_hit", hit).select(*df.columns, _within(F.col("_hit"), lambda h: h["distance"] <= threshold))
        joined = found.withColumn("_position", F.col("_best")["position"]).join(F.broadcast(numbered), "_position")
        extra = [(F.col("_ref_vi") if a == "ref_vi" else F.col(f"_a_{a}")).alias(a) for a in attach if a != "ref_id"]
        return joined.select(*df.columns, "ref_id", F.col("_best")["distance"].alias("distance"), *extra)

    def closest(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for series, block, ref_curves in batches:
            position, distance = np.zeros(len(series), dtype=np.int32), np.zeros(len(series))
            for b in block.unique():
                rows = np.flatnonzero((block == b).to_numpy())
                refs = np.stack([np.asarray(r, dtype=float) for r in ref_curves.iloc[rows[0]]])
                position[rows], distance[rows], _ = _closest_by_dtw(series.iloc[rows].to_list(), refs, threshold)
            yield pd.DataFrame({"position": position, "distance": distance})

    closest = F.pandas_udf(closest, result).asNondeterministic()

    def score(joined: DataFrame) -> DataFrame:
        curves_only = F.transform("_refs", lambda r: r["vi"])
        hit = joined.withColumn("_hit", closest(F.col(vi), F.col("_block"), curves_only))
        ref = F.get("_refs", F.col("_hit")["position"])
        best = F.struct(F.col("_hit")["distance"].alias("distance"), ref["ref_id"].alias("ref_id"), ref["vi"].alias("vi"),
                        *[ref[a].alias(a) for a in carried])
        return hit.select(*joined.columns, _within(best, lambda b: b["distance"] <= threshold))

    return _best(df.filter(_usable(vi)), keys, references, attach, score)


def pixel_cluster_match(pixels: DataFrame, clusters: DataFrame, group: Sequence[str], threshold: float = 0.30,
                        vi: str = "vi") -> DataFrame:
    """Each pixel takes the closest matched cluster curve of its own tile (and window) if strictly nearer than threshold.

    ``clusters``: group columns, ``cluster_id``, ``cluster_vi`` and carried columns; one tile has k clusters,
    so they travel as one small array per tile.
    """
    carried = [c for c in clusters.columns if c not in (*group, "cluster_id", "cluster_vi")]
    packed = clusters.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("cluster_id", "cluster_vi", *carried))).alias("_clusters"))
    joined = pixels.filter(_usable(vi)).join(packed, list(group))
    best = F.array_min(F.transform("_clusters", lambda c: F.struct(
        curves.euclidean(c["cluster_vi"], vi).alias("distance"), c["cluster_id"].alias("cluster_id"),
        *[c[n].alias(n) for n in carried])))
    return (joined.select("*", _within(best, lambda b: b["distance"] < threshold))
            .select(*pixels.columns, F.col("_best")["distance"].alias("distance"),
                    F.col("_best")["cluster_id"].alias("cluster_id"), *[F.col("_best")[n].alias(n) for n in carried]))
