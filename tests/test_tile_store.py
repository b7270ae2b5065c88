"""The store of finished tiles and the raster store along a curve."""

import glob

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cropseries.plans import tile_store
from cropseries.sources import rasters


def work(bad, empty=()):
    def process(tiles):
        fail = F.raise_error(F.concat(F.lit("cannot read tile "), "tile_id")).cast("int")
        rows = tiles.withColumn("x", F.explode(F.sequence(F.lit(1), F.length("tile_id"))))
        return rows.filter(~F.col("tile_id").isin(list(empty))).withColumn("v", F.when(F.col("tile_id").isin(list(bad)), fail).otherwise(F.col("x") * 10))
    return process


def test_failed_tiles_are_set_aside_and_a_rerun_completes_the_store(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    names = [f"t{'a' * (i % 5)}{i}" for i in range(23)]
    tiles = spark.createDataFrame([(n,) for n in names] + [(names[0],), (None,)], "tile_id string")
    first = {r.tile_id: r for r in tile_store.run_tiles(tiles, work([names[4], names[17]], [names[9]]), path, batch=8).collect()}
    assert set(first) == set(names) and {n for n in names if first[n].status == "failed"} == {names[4], names[17]}
    assert f"cannot read tile {names[4]}" in first[names[4]].message and first[names[9]].n_rows == 0 and first[names[9]].status == "done"
    assert all(first[n].n_rows == len(n) for n in names if n not in (names[4], names[9], names[17]))
    assert {r.tile_id for r in tile_store.finished(spark, path).collect()} == set(names) - {names[4], names[9], names[17]}
    kept = tile_store.run_tiles(tiles, work(names), path, retry_failed=False)  # nothing is left to do
    assert {r.tile_id: r.attempt for r in kept.collect()} == {n: 1 for n in names}
    second = {r.tile_id: r for r in tile_store.run_tiles(tiles, work([], [names[9]]), path, batch=8).collect()}
    assert all(r.status == "done" for r in second.values()) and {n for n in names if second[n].attempt == 2} == {names[4], names[17]}
    want = sorted((n, x, 10 * x) for n in names if n != names[9] for x in range(1, len(n) + 1))
    assert rows(tile_store.finished(spark, path), "tile_id", "x", "v") == want


def test_what_was_not_committed_does_not_count_and_is_overwritten(spark, tmp_path, rows):
    path = str(tmp_path / "store")
    tile_store.run_tiles(spark.createDataFrame([("a",)], "tile_id string"), work([]), path)
    # a run that ended after writing a tile and before its record
    spark.createDataFrame([("bb", 7, 7), ("bb", 8, 8), ("bb", 9, 9)], "tile_id string, x int, v int").write.mode("append").partitionBy("tile_id").parquet(f"{path}/data")
    assert rows(tile_store.finished(spark, path), "tile_id", "x", "v") == [("a", 1, 10)]
    tile_store.run_tiles(spark.createDataFrame([("a",), ("bb",)], "tile_id string"), work([]), path)
    assert rows(tile_store.finished(spark, path), "tile_id", "x", "v") == [("a", 1, 10), ("bb", 1, 10), ("bb", 2, 20)]


def test_folders_grow_with_the_batches_and_a_batch_reads_its_own_rows(spark, tmp_path, rows):
    path, n = str(tmp_path / "store"), 40
    source = spark.range(n * 3).select((F.col("id") % n).alias("tile_id"), "id").union(spark.sql("SELECT CAST(NULL AS BIGINT), 7L"))
    met = []

    def process(tiles, its):
        met.append((tiles.count(), its.count()))
        return its.withColumn("id", F.when(F.col("tile_id") == 5, F.raise_error(F.lit("bad")).cast("bigint")).otherwise(F.col("id")))
    done = tile_store.run_tiles(spark.range(n + 1).withColumnRenamed("id", "tile_id"), process, path, batch=10, source=source)  # the last tile has no rows
    assert rows(done, "tile_id", "status", "n_rows") == [(i, "failed" if i == 5 else "done", 0 if i in (5, n) else 3) for i in range(n + 1)]
    assert rows(tile_store.finished(spark, path), "tile_id", "id") == sorted((i % n, i) for i in range(n * 3) if i % n != 5)
    assert all(read <= 3 * tiles for tiles, read in met) and len(met) < 20
    assert len(glob.glob(f"{path}/data/*")) < 20


def test_no_tiles(spark, tmp_path):
    assert tile_store.run_tiles(spark.createDataFrame([], "tile_id string"), work([]), str(tmp_path / "s")).count() == 0


def groups_met(path, x1, x2, y1, y2):
    """Row groups whose least and greatest coordinates meet a box, and all."""
    met = total = 0
    for file in glob.glob(f"{path}/*/*.parquet"):
        meta = pq.ParquetFile(file).metadata
        names = [meta.schema.column(i).name for i in range(meta.num_columns)]
        for g in range(meta.num_row_groups):
            stats = {n: meta.row_group(g).column(names.index(n)).statistics for n in ("x", "y")}
            total += 1
            met += stats["x"].min < x2 and stats["x"].max >= x1 and stats["y"].min < y2 and stats["y"].max >= y1
    return met, total


def test_a_box_meets_few_row_groups(spark, tmp_path, rows):
    side = 512
    pixels = spark.range(side * side).select(F.lit(1).alias("tile_id"), (F.col("id") % side).cast("int").alias("x"), F.floor(F.col("id") / side).cast("int").alias("y"),
                                             F.rand(1).alias("v"))
    by_row, by_place = str(tmp_path / "rows"), str(tmp_path / "place")
    (pixels.repartition(1).sortWithinPartitions("tile_id", "y", "x").write.option("parquet.block.size", str(1 << 14))
     .option("parquet.block.size.row.check.min", "100").partitionBy("tile_id").parquet(by_row))
    rasters.write_raster_by_place(pixels, by_place, files=4, group_bytes=1 << 14)
    box = (300, 415, 200, 315)  # 5 % of the tile
    before, after = groups_met(by_row, *box), groups_met(by_place, *box)
    print("row groups met, all:", before, after)
    assert before[1] > 16 and after[1] > 16 and after[0] / after[1] < 0.6 * before[0] / before[1] and after[0] / after[1] < 0.2
    inside = "x >= 300 and x < 415 and y >= 200 and y < 315"
    assert rows(spark.read.parquet(by_place).filter(inside), "x", "y", "v") == rows(spark.read.parquet(by_row).filter(inside), "x", "y", "v")
    odd = spark.createDataFrame([(2, None, 3, 1.0), (2, -4, 3, 2.0), (None, 1, 1, 3.0)], "tile_id int, x int, y int, v double")
    rasters.write_raster_by_place(odd, by_place, files=2)
    assert spark.read.parquet(by_place).count() == side * side + 3


@pytest.mark.parametrize("message, kept", [("Job aborted\nCaused by: java.lang.X: [USER] a\n", "Caused by: java.lang.X: [USER] a"), ("", "ValueError")])
def test_messages(message, kept):
    assert tile_store._message(ValueError(message)) == kept
