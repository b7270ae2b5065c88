"""Token features and k-means regions with Spark ML."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Observation, functions as F
from pyspark.sql.window import Window

from ..relational import first_k_per_key, join_null_safe, seeded_hash, unit_hash
from ..session import written_table


def _vectors(df: DataFrame, embedding: str) -> DataFrame:
    return df.withColumn("_v", array_to_vector(F.transform(embedding, lambda v: v.cast("double"))))


def fit_token_reduction(tokens: DataFrame, k: int = 2, embedding: str = "embedding") -> PCAModel:
    """Fit once; the model can be saved, loaded and applied to every tile and month."""
    return PCA(k=k, inputCol="_v", outputCol="_f").fit(_vectors(tokens, embedding))


def token_reduce(tokens: DataFrame, model: PCAModel | None = None, k: int = 2, embedding: str = "embedding",
                 out: str = "features") -> DataFrame:
    """Tokens to k features with a given or newly fitted reduction."""
    model = model or fit_token_reduction(tokens, k, embedding)
    return model.transform(_vectors(tokens, embedding)).withColumn(out, vector_to_array("_f")).drop("_v", "_f")


def fit_token_clusters(features: DataFrame, k: int, seed: int = 42, column: str = "features",
                       max_iter: int = 20) -> KMeansModel:
    """K-means reads its input once per iteration, so the vectors stay persisted (spilling to disk) while it fits."""
    vectors = _vectors(features, column).select("_v").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_v", predictionCol="_c").fit(vectors)
    finally:
        vectors.unpersist()


def token_clusters(features: DataFrame, k: int, seed: int = 42, column: str = "features",
                   model: KMeansModel | None = None, max_iter: int = 20) -> DataFrame:
    """Fit on all (pixel, month) features, then label each row with its ``cluster_id``."""
    model = model or fit_token_clusters(features, k, seed, column, max_iter)
    labelled = model.transform(_vectors(features, column))
    return labelled.withColumn("cluster_id", F.col("_c").cast("int")).drop("_v", "_c")


def _distance2(a: Column | str, b: Column | str) -> Column:
    """Squared distance of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def _weighted_starts(points: DataFrame, tile: Sequence[str], ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """(tile, cluster_id, _p): first centres of every tile, each drawn with the squared distance to the nearest one before as its weight.

    The row with the smallest -ln(u) / weight is such a draw, u being the row's own number for this round, so a round is one combining
    aggregate over all tiles, its result a written table of at most k rows a tile. Tiles with fewer different rows get fewer."""
    name = [F.col(i) for i in ids]
    drawn = lambda weight, k: F.min_by("_p", F.struct(-F.log(unit_hash(seed, F.lit(k), *name) + 1e-18) / weight, *name))
    chosen = written_table(points.groupBy(*tile).agg(drawn(F.lit(1.0), 0).alias("_p")).withColumn("cluster_id", F.lit(0)), "starts")
    for c in range(1, k):
        known = chosen.groupBy(*tile).agg(F.collect_list("_p").alias("_known"))
        nearest = F.array_min(F.transform("_known", lambda o: _distance2("_p", o)))
        away = join_null_safe(points, known, tile).withColumn("_d", nearest).filter("_d > 0")
        following = away.groupBy(*tile).agg(drawn(F.col("_d"), c).alias("_p")).withColumn("cluster_id", F.lit(c))
        chosen = written_table(chosen.unionByName(following), "starts")
    return chosen


def token_clusters_restarted(features: DataFrame, tile: Sequence[str], ids: Sequence[str], k: int, size: int, runs: int = 3, seed: int = 42,
                             column: str = "features", max_iter: int = 20, tolerance: float = 0.0) -> DataFrame:
    """As ``token_clusters_by_tile``, the best of several runs for each tile: ``cluster_id`` and ``inertia`` of the tile per row.

    Run 0 starts as ``token_clusters_by_tile`` does, the others from weighted draws (``_weighted_starts``). All runs of all tiles go on at
    once, a run of a tile being a tile of its own, so the jobs are those of one run and its draws; the rows are copied once a run. Of a
    tile's runs the one with the smallest sum of squared distances stays, of equal ones the first: never a worse one than run 0."""
    tile, ids = list(tile), list(ids)
    run = "_run"
    points = written_table(features.withColumn("_p", F.transform(column, lambda v: v.cast("double"))).withColumn(run, F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))), "points")
    plain = points.filter(F.col(run) == 0).select(*{*tile, *ids}, "_p", run)
    starts = _hash_starts(plain, [*tile, run], ids, k, seed)
    if runs > 1:
        others = points.filter(F.col(run) > 0).select(*{*tile, *ids}, "_p", run)
        starts = starts.unionByName(_weighted_starts(others, [*tile, run], [*ids, run], k, seed))
    fitted = written_table(_fitted(points, starts, [*tile, run], size, max_iter, tolerance), "runs")
    inertia = fitted.groupBy(*tile, run).agg(F.sum("_d2").alias("inertia")).groupBy(*tile).agg(F.min(F.struct("inertia", run)).alias("_b"))
    best = inertia.select(*tile, F.col("_b.inertia").alias("inertia"), F.col(f"_b.{run}").alias(run))
    return join_null_safe(fitted, best, [*tile, run]).drop("_p", "_d2", run)


def _hash_starts(points: DataFrame, tile: Sequence[str], ids: Sequence[str], k: int, seed: int) -> DataFrame:
    """(tile, cluster_id, _p): the k rows of smallest seeded hash of each tile."""
    order = [seeded_hash(seed, *ids), *[F.col(i) for i in ids]]
    starts = first_k_per_key(points.select(*tile, *[i for i in ids if i not in tile], "_p"), tile, order, k)
    numbered = starts.withColumn("cluster_id", F.row_number().over(Window.partitionBy(*tile).orderBy(*order)) - 1)  # k rows a tile
    return numbered.select(*tile, "cluster_id", "_p")


def _fitted(points: DataFrame, starts: DataFrame, tile: Sequence[str], size: int, max_iter: int, tolerance: float) -> DataFrame:
    """``points`` with ``cluster_id`` and squared distance ``_d2`` to its centre after the rounds of every tile's k-means."""
    def packed(centres: DataFrame) -> DataFrame:
        return centres.groupBy(*tile).agg(F.sort_array(F.collect_list(F.struct("cluster_id", F.col("_p").alias("c")))).alias("_centres"))

    def assigned(centres: DataFrame) -> DataFrame:
        best = F.array_min(F.transform("_centres", lambda c: F.struct(_distance2("_p", c["c"]).alias("d"), c["cluster_id"].alias("cluster_id"))))
        return join_null_safe(points, centres, tile).withColumn("_best", F.explode(F.array(best))).withColumns({"cluster_id": F.col("_best.cluster_id"), "_d2": F.col("_best.d")}).drop("_best")

    current = written_table(packed(starts), "centres")
    for _ in range(max_iter):
        means = assigned(current).groupBy(*tile, "cluster_id").agg(F.array(*[F.avg(F.col("_p")[i]) for i in range(size)]).alias("_p"))
        old = current.select(*tile, F.inline(F.transform("_centres", lambda c: F.struct(c["cluster_id"].alias("cluster_id"), c["c"].alias("_old")))))
        merged = join_null_safe(old, means, [*tile, "cluster_id"], "left").select(
            *tile, "cluster_id", F.coalesce("_p", "_old").alias("_p"), (_distance2(F.coalesce("_p", "_old"), "_old") > tolerance * tolerance).alias("_moved"))
        moved = Observation()
        current = written_table(packed(merged.observe(moved, F.count(F.when(F.col("_moved"), 1)).alias("n"))), "centres")
        if not moved.get["n"]:
            break
    return assigned(current).drop("_centres")


def token_clusters_by_tile(features: DataFrame, tile: Sequence[str], ids: Sequence[str], k: int, size: int, seed: int = 42,
                           column: str = "features", max_iter: int = 20, tolerance: float = 0.0) -> DataFrame:
    """Every tile's own k-means, all tiles at once: ``cluster_id`` per row.

    The first centres of a tile are its ``k`` rows of smallest seeded hash of ``ids`` (fewer where a tile has fewer rows).
    Then, as often as ``max_iter`` or until no centre moves by more than ``tolerance``, each row goes to the nearest centre of its tile, the lowest
    id on ties, and centres become the means of their rows; a cluster left without rows keeps its centre. Assignment is a
    join with one small row per tile, the means are combining aggregates by tile and cluster, and the centres of each
    round are a written table, so no tile has to fit into one task. Moved centres are counted as they are written, so a round is one
    job. ``size``: numbers in a feature array.
    """
    tile, ids = list(tile), list(ids)
    points = written_table(features.withColumn("_p", F.transform(column, lambda v: v.cast("double"))), "points")  # read in every round
    return _fitted(points, _hash_starts(points, tile, ids, k, seed), tile, size, max_iter, tolerance).drop("_p", "_d2")
