"""Helpers that keep hot keys and global ranks distributed give exact results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropseries import relational as rel
from cropseries.operators import splits, timegrid
from cropseries.sources import catalog


@pytest.mark.parametrize("kind", ["continuous", "ties"])
def test_exact_median_of_a_hot_group(spark, kind):
    rng = np.random.default_rng(2)
    values = rng.normal(size=20_001) if kind == "continuous" else rng.integers(0, 5, 20_001).astype(float)
    keys = np.where(rng.random(20_001) < 0.6, 0, rng.integers(1, 40, 20_001))
    df = spark.createDataFrame([(int(k), float(v)) for k, v in zip(keys, values)] + [(99, None)], "k int, v double")
    got = {r.k: r.m for r in rel.exact_median(df, ["k"], "v", "m", accuracy=500).collect()}
    assert got == {int(k): pytest.approx(float(np.median(values[keys == k])), abs=1e-12) for k in np.unique(keys)}


def test_hash_rank_is_a_permutation(spark):
    df = spark.range(3000)
    ranked = rel.hash_ranked(df, ["id"], 7)
    got = ranked.collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 3001)) and {r.total for r in got} == {3000}
    again = {r.id: r["rank"] for r in rel.hash_ranked(df.repartition(13), ["id"], 7).collect()}
    assert again == {r.id: r["rank"] for r in got}
    assert again != {r.id: r["rank"] for r in rel.hash_ranked(df, ["id"], 8).collect()}


def test_lookup_join_beyond_the_broadcast_bound(spark, rows):
    df = spark.range(500).select((F.col("id") % 3).alias("k"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([(0, "a"), (1, "b"), (7, "z")], "k long, name string")
    small, big = rel.join_lookup(df, lookup, ["k"]), rel.join_lookup(df, lookup, ["k"], max_rows=1)
    assert rows(small, "k", "v", "name") == rows(big, "k", "v", "name")
    plan = big._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" not in plan
    left = rel.join_lookup(df, lookup, ["k"], "left", max_rows=1)
    assert left.count() == 500


def test_first_rows_per_key(spark, rows):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7 % 1000).alias("v"))
    assert rows(rel.first_per_key(df, ["k"], ["v"])) == [(0, 0), (1, 1)]
    assert rows(rel.first_k_per_key(df, ["k"], [F.col("v")], 3)) == [(0, 0), (0, 2), (0, 4), (1, 1), (1, 3), (1, 5)]


def test_split_sizes(spark):
    df = spark.range(1001).select((F.col("id") % 40).alias("tile_id"), "id")
    out = splits.split_by_tile(df, share=0.15, seed=1)
    tiles = out.groupBy("tile_id").agg(F.countDistinct("split").alias("n"), F.first("split").alias("s")).collect()
    assert {r.n for r in tiles} == {1} and sum(r.s == "validation" for r in tiles) == 6 and out.count() == 1001
    parts = {r.split: r["count"] for r in splits.random_split(df, ["id"], 0.15).groupBy("split").count().collect()}
    assert parts == {"validation": 150, "training": 851}
    tiny = splits.random_split(spark.range(3), ["id"], 0.15)
    assert tiny.filter("split = 'validation'").count() == 1
    assert splits.subset(df, ["id"], 0.15).select("id").distinct().count() == 150


def test_tile_sample(spark):
    grid = catalog.tile_grid(spark, catalog.bbox_frame(spark, -89.35, 12.95, -83.1, 16.45), 0.25)
    assert grid.count() == 25 * 14
    a = {r.cell_id for r in catalog.tile_sample(grid, 50, 42).collect()}
    assert len(a) == 50 and a == {r.cell_id for r in catalog.tile_sample(grid.repartition(5), 50, 42).collect()}
    assert catalog.tile_sample(grid, 9999, 42).count() == 350


def test_hot_join_key_is_salted(spark):
    df = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("v"))
    lookup = spark.createDataFrame([(1, "a"), (2, "b")], "k int, name string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        parts = rel.join_lookup(df, lookup, ["k"], max_rows=1).withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 1200


def test_windows_are_spread_by_their_rows(spark, monkeypatch):
    monkeypatch.setattr(rel, "SPREAD_ROWS", 10)
    df = spark.range(200).select((F.col("id") % 40).alias("k"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 90).cast("int")).alias("obs_date"), F.lit(1.0).alias("v"))
    windows = timegrid.month_window_series(df, ["k"], ["v"], "2020-03-31", 3)
    plan = windows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [k" in plan and ", 20" in next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert rel.spread(df, "k", rows=95).rdd.getNumPartitions() == 10
    assert rel.spread(df, "k").rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
