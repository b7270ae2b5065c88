"""Composed jobs, sources, scoring and metrics."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropseries.operators import clustering, metrics, scoring
from cropseries.plans import calendar_maps
from cropseries.session import scratch_path
from cropseries.sources import catalog, library, rasters

DAYS = 1 + 14 * np.arange(13)


def gauss(centre):
    return np.exp(-0.5 * ((DAYS - centre) / 30.0) ** 2) * 0.5 + 0.2


def season(spark, peaks, start=dt.date(2022, 1, 2), side=4):
    """Pixels whose EVI peaks ``peaks[pixel]`` days after the first slot of one 182-day window."""
    data = []
    for p, peak in enumerate(peaks):
        for i, d in enumerate(DAYS):
            vi = math.exp(-0.5 * ((d - peak) / 30.0) ** 2) * 0.5 + 0.2
            # EVI = 2.5 (n - r) / (n + 6 r - 7.5 b + 1) with r = b = 0.05
            nir = (vi * (6 * 0.05 - 7.5 * 0.05 + 1) + 2.5 * 0.05) / (2.5 - vi)
            data.append((1, p // side, p % side, start + dt.timedelta(int(d) - 1), 0.05, 0.05, nir, 0))
    return spark.createDataFrame(data, "tile_id int, y int, x int, obs_date date, blue double, red double, nir double, fmask int")


@pytest.fixture(scope="module")
def inputs(spark):
    peaks = [95.0] * 6 + [85.0] * 6 + [95.0] * 4
    obs = season(spark, peaks)
    classes = spark.createDataFrame([(1, p // 4, p % 4, m, 11 if p < 12 else 14) for p in range(16) for m in range(3)],
                                    "tile_id int, y int, x int, m int, class int")
    refs = spark.createDataFrame([(0, [float(v) for v in gauss(85)], [60.0, 85.0, 110.0, 140.0], "maize"),
                                  (1, [0.9] * 13, [50.0], "beans")], "ref_id int, vi array<double>, phen_days array<double>, crop string")
    return obs, classes, refs


def check_map(out, pixels_with_days):
    got = {}
    for r in out.collect():
        got.setdefault((r.y, r.x), {})[r.stage] = (r.doy, r.crop_code)
    assert len(got) == 16 and all(set(v) == {"Greenup", "Maturity", "Senescence", "Dormancy"} for v in got.values())
    found = {k for k, v in got.items() if v["Maturity"][0] is not None}
    assert found == pixels_with_days
    return got


CROPS = {(p // 4, p % 4) for p in range(12)}
END = "2022-06-30"


def test_pixel_job_recovers_the_shift(spark, inputs):
    obs, classes, refs = inputs
    # one window ending with the season: slot 0 holds the first day
    end = (dt.date(2022, 1, 2) + dt.timedelta(181)).isoformat()
    assert end == "2022-07-02"
    out = calendar_maps.phenology_pixels(obs, classes, refs, "2022-06-15", 1).cache()
    got = check_map(out, CROPS)
    shifted, same = got[(0, 0)]["Maturity"], got[(2, 0)]["Maturity"]
    assert shifted[1] == same[1] == 1
    # ten days later than the reference pixels, within one two-week bin
    assert 0 <= shifted[0] - same[0] <= 14


def test_cluster_job(spark, inputs):
    obs, classes, refs = inputs
    clusters = spark.createDataFrame([(1, p // 4, p % 4, 0 if p < 6 else 1) for p in range(16)], "tile_id int, y int, x int, cluster_id int")
    out = calendar_maps.phenology_clusters(obs, classes, clusters, refs, "2022-06-15", 1, reference_threshold=0.5)
    check_map(out, CROPS)


def test_reference_library(spark, tmp_path, rows):
    assert library.read_reference_library(spark, str(tmp_path / "absent")).count() == 0
    for i, (vi, phe, crop) in enumerate([("0.1 0.2\n0.3", "15\n40", "maize\n"), ("0.5 0.6 0.7", "20.5", None), ("0.9", None, "beans")]):
        for kind, text in (("vi", vi), ("phe", phe), ("crop", crop)):
            if text is not None:
                (tmp_path / f"ref_{kind}_6months_{i}.txt").write_text(text)
    got = rows(library.read_reference_library(spark, str(tmp_path)))
    assert got == [(0, [0.1, 0.2, 0.3], [15.0, 40.0], "maize"), (1, [0.5, 0.6, 0.7], [20.5], "unknown")]


def test_list_files(spark, tmp_path, rows):
    for name in ("synth_20231patch_0000.nc", "synth_20231patch_0001.nc", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    got = catalog.patch_catalog(catalog.list_files(spark, str(tmp_path)))
    assert rows(got, "tile_id", "patch_id") == [("synth", "0000"), ("synth", "0001")]


def test_raster_roundtrip_prunes_tiles(spark):
    df = spark.range(200).select((F.col("id") % 4).cast("int").alias("tile_id"), (F.col("id") % 10).cast("int").alias("y"),
                                 (F.col("id") % 7).cast("int").alias("x"), F.col("id").cast("double").alias("v"))
    path = scratch_path(spark, "rasters")
    rasters.write_raster(df, path)
    back = rasters.read_raster(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    plan = back.filter("tile_id = 2 AND y > 3")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(tile_id" in plan and "GreaterThan(y,3)" in plan


def test_metrics_log_rejects_unknown_keys(spark):
    df = spark.createDataFrame([(1, 0.5)], "epoch int, loss double")
    path = scratch_path(spark, "log")
    rasters.append_metrics(df, path, ["epoch", "loss"])
    rasters.append_metrics(df.withColumn("epoch", F.lit(2)), path, ["epoch", "loss"])
    assert rasters.load_metrics(spark, path, df.schema).count() == 2
    with pytest.raises(KeyError):
        rasters.append_metrics(df, path, ["epoch"])


def test_scoring_keeps_failed_rows(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0] if i != 3 else [1.0]) for i in range(6)], "k int, features array<double>")
    out = {r.k: r for r in scoring.score_batches(df, lambda m, w: m @ w, ids=["k"], model=np.array([[1.0, 0.0], [0.0, 2.5]])).collect()}
    assert len(out) == 6 and out[3].scores is None and "ValueError" in out[3].error and out[3]["class"] is None
    assert [out[i]["class"] for i in (0, 1, 2, 4, 5)] == [1, 1, 1, 0, 0] and out[4].error is None


def test_clusters_repeat_for_a_seed(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(5 * (i % 3), 0.1, 6)]) for i in range(90)], "k int, embedding array<double>")
    reduced = clustering.token_reduce(df)
    assert len(reduced.first().features) == 2
    a = {r.k: r.cluster_id for r in clustering.token_clusters(reduced, 3).collect()}
    b = {r.k: r.cluster_id for r in clustering.token_clusters(reduced, 3).collect()}
    assert a == b and len(set(a.values())) == 3
    assert all(len({a[k] for k in range(90) if k % 3 == g}) == 1 for g in range(3))


def test_models_are_saved_and_reused(spark, tmp_path):
    from pyspark.ml.feature import PCAModel
    df = spark.createDataFrame([(i, [float(i), float(i * i), 1.0]) for i in range(20)], "k int, embedding array<double>")
    model = clustering.fit_token_reduction(df)
    model.write().overwrite().save(str(tmp_path / "pca"))
    again = PCAModel.load(str(tmp_path / "pca"))
    assert clustering.token_reduce(df, model).collect() == clustering.token_reduce(df, again).collect()


def test_metrics_with_an_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "label int, predicted int")
    m = metrics.confusion_matrix(df, 3)
    assert m.count() == 9 and m.agg(F.sum("n")).first()[0] == 4
    got = {(r.scope, r["class"]): r for r in metrics.class_metrics(df, 3).collect()}
    assert got[("class", 2)].f1 == 0.0 and got[("class", 2)].iou == 0.0
    assert got[("macro", None)].iou == pytest.approx((1 / 2 + 2 / 3) / 2)
    assert got[("micro", None)].precision == 0.75 and got[("micro", None)].iou == pytest.approx(3 / 5)
    iou = {r["class"]: r.iou for r in metrics.iou_report(df, 3).collect()}
    assert iou[2] == 0.0 and iou[None] == pytest.approx((1 / 2 + 2 / 3 + 0) / 3)


def test_losses(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], 2), ([0.0, 0.0, 5.0], 0), ([2.0, 1.0, 0.0], 1)], "scores array<double>, label int")
    lp = lambda s, i: s[i] - math.log(sum(math.exp(v) for v in s))
    a, b = lp([1, 2, 3], 2), lp([2, 1, 0], 1)
    assert metrics.masked_cross_entropy(df).first().loss == pytest.approx(-(a + b) / 2)
    assert metrics.masked_cross_entropy(df, reduction=None).count() == 2
    assert metrics.masked_cross_entropy(df.filter("label = 0")).first().loss == 0.0
    focal = metrics.masked_focal(df, gamma=2.0, alpha=[1.0, 0.5, 2.0], ignore_class=0, reduction="sum").first().loss
    assert focal == pytest.approx(-(1 - math.exp(a)) ** 2 * a * 2 - (1 - math.exp(b)) ** 2 * b * 0.5)
    with pytest.raises(ValueError):
        metrics.masked_focal(df, reduction="median")


def test_summary_skips_nan(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 1, float("nan")), ("b", 2, 4.0)], "k string, j int, v double")
    got = {r.group_key: r.v for r in metrics.metrics_summary(df, ["k", "j"], ["v"]).collect()}
    assert got == {"a-1": 2.0, "b-2": 4.0}
