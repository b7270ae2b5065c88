"""Patches packed as tensors, scored and unpacked."""

import numpy as np
from pyspark.sql import functions as F

from cropseries.operators import patches


def stack(spark, t, h, w, tile=1, seed=0):
    a = np.random.default_rng(seed).random((t, 2, h, w)) + 0.1
    rows = [(tile, s, y, x, float(a[s, 0, y, x]), float(a[s, 1, y, x])) for s in range(t) for y in range(h) for x in range(w)]
    return a, spark.createDataFrame(rows, "tile_id int, slot int, y int, x int, a double, b double")


def test_tensors_hold_the_image(spark):
    a, df = stack(spark, 3, 10, 13)
    odd = spark.createDataFrame([(1, 0, 2, 3, 0.0, None), (1, 7, 0, 0, 9.0, 9.0), (1, 0, 10, 0, 9.0, 9.0), (1, 0, -1, 0, 9.0, 9.0), (None, 1, 9, 12, None, 5.0), (2, None, 0, 0, 1.0, 1.0)], df.schema)
    got = {(r.tile_id, r.patch): r for r in patches.pack_patches(df.unionByName(odd), ["tile_id"], ["a", "b"], 4, 3, 10, 13, dtype="<f8").collect()}
    assert set(got) == {(t, p) for t in (1, 2, None) for p in range(12)}
    padded = np.zeros((3, 2, 12, 16))
    padded[:, :, :10, :13] = a
    for p in range(12):
        y, x = p // 4 * 4, p % 4 * 4
        assert np.allclose(np.frombuffer(got[1, p].tensor, "<f8").reshape(3, 2, 4, 4), padded[:, :, y:y + 4, x:x + 4])
        assert got[2, p].n_values == 0 and not any(got[2, p].tensor)
    lone = np.frombuffer(got[None, 11].tensor, "<f8").reshape(3, 2, 4, 4)
    assert got[None, 11].n_values == 1 and lone[1, 1, 1, 0] == 5 and lone.sum() == 5


def test_pixels_come_back(spark):
    a, df = stack(spark, 2, 10, 13)
    got = patches.score_images(df, lambda v, _: v[:, :, 0], ["tile_id"], ["a", "b"], 4, 2, 10, 13, dtype="<f8").collect()
    assert len(got) == 130 and len({(r.y, r.x) for r in got}) == 130
    for r in got:
        assert np.allclose(r.scores, a[:, 0, r.y, r.x]) and r["class"] == int(np.argmax(a[:, 0, r.y, r.x]))


def test_batches_are_bounded_and_one_bad_patch_stops_nothing(spark):
    _, df = stack(spark, 1, 8, 8)
    marked = df.withColumn("a", F.when((F.col("y") == 0) & (F.col("x") == 0), -1.0).otherwise(F.col("a")))
    packed = patches.pack_patches(marked, ["tile_id"], ["a"], 4, 1, 8, 8).coalesce(1)
    broken = packed.unionByName(packed.limit(1).withColumns({"patch": F.lit(9), "tensor": F.lit(b"xy")}))

    def model(values, most):
        if len(values) > most:
            raise MemoryError("too many")
        if (values < 0).any():
            raise ValueError("negative")
        return values[:, 0]

    got = {r.patch: r for r in patches.score_patches(broken.coalesce(1), model, ["tile_id"], (1, 1, 4, 4), 2, batch_bytes=2 * 64).collect()}
    assert got[0].error == "ValueError: negative" and got[0].scores is None and got[9].scores is None and "ValueError" in got[9].error
    assert all(got[p].error is None and len(got[p].scores) == 64 for p in (1, 2, 3))
    wrong = patches.score_patches(packed, lambda v, _: v[:, 0, 0], ["tile_id"], (1, 1, 4, 4)).collect()
    assert all("shape" in r.error for r in wrong)


def test_empty(spark):
    _, df = stack(spark, 1, 4, 4)
    assert patches.score_images(df.limit(0), lambda v, _: v[:, 0], ["tile_id"], ["a"], 4, 1, 4, 4).count() == 0
