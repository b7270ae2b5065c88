"""Join and ranking helpers shared by the operators.

All of them keep three rules: no side is broadcast without a size check, a hot key is
spread before it is grouped or joined, and no ranking runs over an unpartitioned window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
SALTS = 32
RANK_BUCKETS = 65_536
SPREAD_ROWS = 1 << 18


def seeded_hash(seed: int, *cols: str | Column) -> Column:
    """Order key from 0 to 2^60 - 1 that depends on the row's identity and the seed, not on partitioning.

    The first 15 hex digits of the MD5 of seed and columns as text, so that other engines draw the same numbers.
    """
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def unit_hash(seed: int, *cols: str | Column) -> Column:
    """Uniform number in [0, 1) from a seeded hash."""
    return F.pmod(seeded_hash(seed, *cols), F.lit(1 << 52)).cast("double") / float(1 << 52)


def spread(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """Hash rows over all shuffle partitions, keeping that number, or over more: one for each ``SPREAD_ROWS`` of ``rows``.

    For steps that cost far more time than bytes (window expansion, curve fits): size-based coalescing would
    put their small input into a few tasks. ``rows`` keeps what a task groups or sorts from growing with the input.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(partitions, -(-rows // SPREAD_ROWS)), *keys)


def fits_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROWS, row_bytes: Column | None = None) -> bool:
    """Counts at most ``max_rows + 1`` rows and, where ``row_bytes`` estimates a row's size, adds up their bytes."""
    size = F.lit(0) if row_bytes is None else F.coalesce(F.sum(row_bytes), F.lit(0))
    head = df.limit(max_rows + 1)
    rows, total = head.agg(F.count("*"), size).first()
    return rows <= max_rows and total <= BROADCAST_BYTES


def join_null_safe(df: DataFrame, side: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the columns of ``df``, then the others of ``side``."""
    renamed = side.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & df[k].eqNullSafe(renamed[f"_right_{k}"])
    return df.join(renamed, same, how).drop(*[f"_right_{k}" for k in keys])


def join_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "inner",
                max_rows: int = BROADCAST_ROWS, row_bytes: Column | None = None) -> DataFrame:
    """Join a lookup table: broadcast if its counted rows (and ``row_bytes``) allow, else a salted shuffle join.

    The salt spreads a hot key of ``df`` over ``SALTS`` tasks; the lookup side is copied once per salt, so only kinds
    of join that emit no unmatched lookup rows are taken.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join_lookup can't join {how!r}")
    on = list(on)
    if fits_broadcast(lookup, max_rows, row_bytes):
        return df.join(F.broadcast(lookup), on, how)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def with_group_stats(df: DataFrame, keys: Sequence[str], *aggregates: Column) -> DataFrame:
    """Attach per-group aggregates to every row; rows with a NULL key form a group of their own.

    An aggregate (combined on the map side) plus an equi-join instead of a window, so that one hot
    group never has to sit in one task: adaptive execution broadcasts the small aggregate when its
    measured size allows it and otherwise splits skewed join partitions.
    """
    return join_null_safe(df, df.groupBy(*keys).agg(*aggregates), keys)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the smallest by ``order``; a partial aggregate, so hot keys combine map-side."""
    rest = [c for c in df.columns if c not in keys]
    order_cols = [F.col(c) if isinstance(c, str) else c for c in order]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def first_k_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """At most ``k`` rows per key in ``order``; ranked within salts first so that few keys still use many tasks."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    overall = Window.partitionBy(*keys).orderBy(*order)
    return (salted.withColumn("_rank", F.row_number().over(local)).filter(F.col("_rank") <= k)
            .withColumn("_rank", F.row_number().over(overall)).filter(F.col("_rank") <= k)
            .drop("_rank", "_salt"))


def hash_ranked(df: DataFrame, ids: Sequence[str], seed: int) -> DataFrame:
    """Add ``rank`` (1-based position in seeded-hash order) and ``total`` without a global sort.

    Rows are hashed into equal buckets, the bucket counts (a bounded table) give each bucket's offset,
    and rows are numbered inside their bucket only. ``ids`` must identify a row.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, *ids)).withColumn("_b", F.pmod("_h", F.lit(RANK_BUCKETS)))
    counts = hashed.groupBy("_b").agg(F.count("*").alias("_n"))
    # at most RANK_BUCKETS rows, whatever the size of df
    running = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_offset"))
    total = counts.agg(F.sum("_n").alias("total")).scalar()
    inside = Window.partitionBy("_b").orderBy("_h", *ids)
    return (hashed.join(F.broadcast(offsets), "_b")
            .withColumn("rank", (F.row_number().over(inside) + F.col("_offset")).cast("bigint"))
            .withColumn("total", total)
            .drop("_h", "_b", "_offset"))


def first_by_hash(df: DataFrame, ids: Sequence[str], seed: int, wanted) -> Column:
    """Whether a row is among the first ``wanted(total)`` rows in the order of :func:`hash_ranked`.

    The bucket counts tell which bucket the boundary falls into; only that bucket's ids are ranked. The result compares
    each row with the last one taken (a scalar), so the rows themselves are neither shuffled nor sorted.
    """
    keyed = df.select(*ids).withColumn("_h", seeded_hash(seed, *ids)).withColumn("_b", F.pmod("_h", F.lit(RANK_BUCKETS)))
    counts = keyed.groupBy("_b").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_b")  # at most RANK_BUCKETS rows
    reached = counts.select("_b", "_n", F.sum("_n").over(running).alias("_end"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    wanted_rows = wanted(F.col("_total")).cast("bigint")
    edge = reached.filter(F.col("_end") >= wanted_rows).agg(F.min_by(F.struct(F.col("_b").alias("b"), (wanted_rows - F.col("_end") + F.col("_n")).alias("k")), "_b").alias("_edge"))
    place = F.struct("_b", "_h", *ids)
    inside = keyed.crossJoin(F.broadcast(edge)).filter(F.col("_b") == F.col("_edge.b"))
    ranked = inside.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ids)))
    last = ranked.filter(F.col("_r") <= F.col("_edge.k")).agg(F.max(place)).scalar()
    hashed = seeded_hash(seed, *ids)
    return F.coalesce(F.struct(F.pmod(hashed, F.lit(RANK_BUCKETS)).alias("_b"), hashed.alias("_h"), *ids) <= last, F.lit(False))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, alias: str, accuracy: int = 10_000) -> DataFrame:
    """Exact median (mean of the middle two) per group for groups of any size.

    One combining aggregate of sketches reads all values. A sketch of fewer values than half its accuracy holds them all,
    so its middle is exact: the lower one from the values, the upper one from their negatives. For larger groups the
    sketch brackets the middle, and in a second reading only their values inside the bracket are counted and ranked, so
    no task holds a whole group's values. Groups with no value give no row; NULL keys are a group.
    """
    keys = list(keys)
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    slack = 2.0 / accuracy
    summary = values.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_v", [0.5, 0.5 - slack, 0.5 + slack], accuracy).alias("_q"),
        (-F.percentile_approx(-F.col("_v"), 0.5, accuracy)).alias("_upper"),
        F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    whole = F.col("_n") * 2 < accuracy
    small = summary.filter(whole).select(*keys, ((F.col("_q")[0] + F.col("_upper")) / 2).alias(alias))
    # up to the accuracy the full range is kept, where the bracket could fall between the middle two
    wide = F.col("_n") <= accuracy
    bracket = summary.filter(~whole).select(*keys, "_n",
                                            F.when(wide, F.col("_min")).otherwise(F.col("_q")[1]).alias("_lo"),
                                            F.when(wide, F.col("_max")).otherwise(F.col("_q")[2]).alias("_hi"))
    placed = (join_null_safe(values, bracket, keys).filter(F.col("_v") <= F.col("_hi"))
              .groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_lo"), F.col("_v")).alias("_v"))
              .agg(F.count("*").alias("_c")))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first())
    ranked = placed.withColumn("_end", F.sum("_c").over(order))
    lower, upper = F.floor((F.col("_n") + 1) / 2), F.floor((F.col("_n") + 2) / 2)
    hit = lambda k: F.max(F.when((F.col("_end") >= k) & (F.col("_end") - F.col("_c") < k), F.col("_v")))
    return small.unionByName(ranked.groupBy(*keys).agg(((hit(lower) + hit(upper)) / 2).alias(alias)))
