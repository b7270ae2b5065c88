"""NULL keys, limits, foreign labels and repeated keys: nothing is lost and size never changes an answer."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from cropseries import relational as rel
from cropseries.operators import augment, clustering, matching, metrics, phenology, quality, splits, timegrid
from cropseries.plans import calendar_maps
from cropseries.sources import granules


def test_null_keys_are_a_group(spark, rows):
    df = spark.createDataFrame([(None, 1, 0.5), ("a", 1, 0.5), (None, 2, None)], "tile string, y int, red double")
    assert quality.valid_scenes(df, ["tile"], "red", 0.1).count() == 3
    assert quality.coverage_filter(df, ["tile"], "red", 60).count() == 1
    assert quality.valid_steps(df, ["tile"], "red").count() == 3
    assert augment.add_noise(df, ["tile"], ["tile", "y"], ["red"], 1).count() == 3
    assert {r[0] for r in splits.split_by_tile(df, "tile", 0.5).select("tile").collect()} == {None, "a"}
    med = rel.exact_median(df, ["tile"], "red", "m")
    assert rows(med) == [("a", 0.5), (None, 0.5)]


def test_rare_values_of_an_image_without_a_key(spark):
    data = [(None, 7.0)] * 300 + [(None, 21.0)] + [(None, None)] * 20 + [("a", 21.0)] * 5
    got = phenology.suppress_rare(spark.createDataFrame(data, "tile string, doy double"), ["tile"]).collect()
    assert len(got) == 326 and sum(r.doy == 7.0 for r in got) == 300 and sum(r.doy == 21.0 for r in got) == 5


def test_lookup_joins_that_would_repeat_rows_are_refused(spark):
    df = spark.range(3).withColumnRenamed("id", "k")
    for how in ("right", "full", "outer"):
        with pytest.raises(ValueError):
            rel.join_lookup(df, df, ["k"], how)


def test_foreign_labels_fail(spark):
    for bad in ((7, 0), (0, -1), (None, 1)):
        df = spark.createDataFrame([(0, 0), bad], "label int, predicted int")
        with pytest.raises(Exception, match="is not one of 2 classes"):
            metrics.class_metrics(df, 2).collect()
    masked = spark.createDataFrame([(0, 0, True), (9, 0, False)], "label int, predicted int, ok boolean")
    assert metrics.confusion_matrix(masked, 2, mask="ok").agg(F.sum("n")).first()[0] == 1


def test_search_has_no_limit_of_its_own(spark):
    df = spark.range(2500).select(F.concat(F.lit("g"), "id").alias("granule_id"), F.lit("HLSS30").alias("product"), *[F.lit(0.5).alias(c) for c in ("min_lon", "max_lon", "min_lat", "max_lat")],
                                  F.lit("2022-01-01 00:00:00").cast("timestamp_ntz").alias("begin_ts"))
    find = lambda **k: granules.granule_search(df, (0, 0, 1, 1), "2021-01-01", "2023-01-01", **k).count()
    assert find() == 2500 and find(max_results=100) == 100


def test_granules_without_links_lack_all_bands(spark):
    all_ = spark.createDataFrame([("a",), ("b",)], "granule_id string")
    links = spark.createDataFrame([("a", "red", "x")], "granule_id string, band string, link string")
    assert sorted(map(tuple, granules.missing_bands(all_, links, ("red", "nir")).collect())) == [("a", "nir"), ("b", "nir"), ("b", "red")]


def test_masked_share_reaches_what_is_drawn(spark):
    images = spark.range(400).withColumnRenamed("id", "patch").withColumn("step", F.lit(1))
    drawn = augment.block_rectangles(images, ["patch", "step"], 48, 48, 11)
    area = sum(F.coalesce(F.col(f"_h_{i}") * F.col(f"_w_{i}"), F.lit(0)) for i in range(4)) / (48 * 48)
    low, mean, high = drawn.agg(F.min(area), F.avg(area), F.max(area)).first()
    assert high <= 0.15 and high > 0.14 and 0.065 < mean < 0.08 and low < 0.01


@pytest.mark.parametrize("match", [matching.nearest_reference, matching.nearest_reference_dtw])
def test_repeated_keys_and_library_size(spark, match, monkeypatch):
    monkeypatch.setattr(matching, "LIBRARY", 100)
    series = [(1, [0.1, 0.2, 0.3]), (1, [0.3, 0.2, 0.1]), (2, [0.5, 0.5, 0.5])]
    refs = lambda n: spark.createDataFrame([(i, [0.1 + i * 1e-4, 0.2, 0.3], f"c{i}") for i in range(n)], "ref_id int, vi array<double>, crop string")
    df = spark.createDataFrame(series, "px int, vi array<double>")
    small = sorted((r.px, r.vi, r.ref_id) for r in match(df, ["px"], refs(20), 2.0).collect())
    large = sorted((r.px, r.vi, r.ref_id) for r in match(df, ["px"], refs(1200), 2.0).collect())
    assert len(small) == len(large) == 3 and small[0][2] == large[0][2] == 0


def test_library_stays_out_of_the_exchange(spark):
    df = spark.createDataFrame([(1, [0.1, 0.2, 0.3])], "px int, vi array<double>")
    refs = spark.range(1200).select(F.col("id").cast("int").alias("ref_id"), F.array(*[F.lit(0.1)] * 3).alias("vi"))
    plan = matching.nearest_reference(df, ["px"], refs)._jdf.queryExecution().optimizedPlan().toString()
    top = plan.split("Aggregate [px")[0]
    assert "_refs" not in top and "min_by(struct(" in plan and "_refs" not in plan.split("min_by(struct(")[1].split("),")[0]


def test_pixels_outside_the_window_stay(spark):
    day = dt.date
    df = spark.createDataFrame([(1, day(2022, 6, 1), 0.5), (2, day(2019, 1, 1), 0.7)], "px int, obs_date date, red double")
    for out in (timegrid.composite_nanmean(df, ["px"], ["red"], "2022-06-30"), timegrid.composite_grid(df, ["px"], ["red"], "2022-06-30", 13)):
        got = out.groupBy("px").agg(F.count("*").alias("n"), F.sum("red").alias("s")).orderBy("px").collect()
        assert [(r.n, r.s) for r in got] == [(13, 0.5), (13, 0.0)]


def test_modal_crop_counts_windows_without_a_match(spark):
    windows = [dt.date(2022, m, 28) for m in range(1, 9)]
    codes = [("t", 1, w, 1) for w in windows[:1]] + [("t", 2, w, 2) for w in windows[:5]] + [("t", 3, w, 1) for w in windows[:4]] \
        + [("t", 4, w, 1 + i % 2) for i, w in enumerate(windows)] + [("u", 1, windows[0], 0)]
    df = spark.createDataFrame(codes, "tile string, px int, window_end date, crop_code int")
    pixels = spark.createDataFrame([("t", i) for i in range(1, 6)] + [("u", 1)], "tile string, px int")
    crops, kept = calendar_maps.modal_crop(df, pixels, ["tile", "px"], ["tile"])
    assert {(r.tile, r.px): r.crop_code for r in crops.collect()} == {("t", 1): 0, ("t", 2): 2, ("t", 3): 0, ("t", 4): 1, ("t", 5): 0, ("u", 1): 0}
    assert kept.count() == 8


def test_split_doesnt_move_wide_rows(spark):
    df = spark.range(5000).withColumn("wide", F.lit("x" * 50))
    out = splits.random_split(df, ["id"], 0.15, seed=5)
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"validation": 750, "training": 4250}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "wide" not in "".join(line for line in plan.split("\n") if "Window" in line or "Aggregate" in line or "Join" in line)
    ranked = {r.id for r in rel.hash_ranked(df, ["id"], 5).filter("rank <= 750").collect()}
    assert {r.id for r in out.filter("split = 'validation'").collect()} == ranked
    assert splits.subset(spark.range(3), ["id"], 0.1).count() == 0 and splits.subset(spark.range(0), ["id"], 0.5).count() == 0


def test_statistics_and_draws_per_image(spark):
    from cropseries.operators import bands
    df = spark.createDataFrame([("a", 0, 0, 1.0), ("a", 0, 1, 3.0), ("b", 0, 0, 10.0), ("b", 0, 1, 20.0), (None, 0, 0, 5.0)], "tile string, y int, x int, v double")
    got = {(r.tile, r.x): r.v for r in bands.minmax_scale(df, "v", keys=["tile"]).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 1.0, ("b", 0): 0.0, ("b", 1): 1.0, (None, 0): 0.0}
    many = spark.range(64).select(F.col("id").alias("tile"), F.explode(F.array(F.lit(0), F.lit(1))).alias("x")).withColumn("y", F.lit(0))
    flipped = augment.flip(many, augment.draw_one(3, ["tile"], [1, None]), 1, 2).withColumn("moved", F.col("x"))
    assert flipped.groupBy("tile").agg(F.sum("x")).filter("`sum(x)` <> 1").count() == 0


def test_clusters_of_each_tile(spark):
    import numpy as np
    from cropseries.operators import clustering
    rng = np.random.default_rng(4)
    rows = [(i, "ab"[i % 2] if i < 90 else None, [float(v) for v in rng.normal((i % 3) * 4, 1, 2)]) for i in range(95)]
    df = spark.createDataFrame(rows, "k long, tile string, features array<double>")
    got = {r.k: r.cluster_id for r in clustering.token_clusters_by_tile(df, ["tile"], ["k"], 3, 2, seed=9).collect()}
    order = {r.k: r.h for r in df.select("k", rel.seeded_hash(9, "k").alias("h")).collect()}
    for tile in ("a", "b", None):
        mine = [(k, np.array(v)) for k, t, v in rows if t == tile]
        points = np.stack([v for _, v in mine])
        centres = np.stack([v for _, v in sorted(mine, key=lambda m: (order[m[0]], m[0]))[:3]])
        for _ in range(20):
            label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
            centres = np.stack([points[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(3)])
        label = ((points[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        assert [got[k] for k, _ in mine] == label.tolist()


def test_smoothing_of_missing_and_unequal_lists(spark):
    from cropseries.functions import smoothing
    rows = [([0.0, 14.0, 28.0, 42.0], [0.1, 0.2, 0.3, 0.4]), (None, [0.1]), ([0.0], None), ([], [])]
    df = spark.createDataFrame(rows, "d array<double>, v array<double>")
    got = [r.s for r in df.select(smoothing.kernel_regression("d", "v").alias("s")).collect()]
    assert len(got[0]) == 4 and got[1] is None and got[2] is None and got[3] == []
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([0.0, 1.0], [0.1])], df.schema).select(smoothing.kernel_regression("d", "v")).collect()


def test_restarts_are_never_worse(spark):
    rng = np.random.default_rng(4)
    centres = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0], [10.0, 10.0], [5.0, 30.0]])
    data = [(t, i, (centres[i % 5] + rng.normal(0, 0.3, 2)).tolist()) for t in ("a", None, "b") for i in range(60)] + [("one", 0, [1.0, 2.0]), ("one", 1, [1.0, 2.0])]
    df = spark.createDataFrame(data, "tile string, k int, features array<double>")

    def inertia(out):
        sums = {}
        for t in {d[0] for d in data}:
            rows = [r for r in out if r.tile == t]
            for c in {r.cluster_id for r in rows}:
                p = np.array([r.features for r in rows if r.cluster_id == c])
                sums[t] = sums.get(t, 0) + float(((p - p.mean(axis=0)) ** 2).sum())
        return sums
    plain = inertia(clustering.token_clusters_by_tile(df, ["tile"], ["k"], 5, 2).collect())
    out = clustering.token_clusters_restarted(df, ["tile"], ["k"], 5, 2, runs=4).collect()
    best = inertia(out)
    assert len(out) == len(data) and all(best[t] <= plain[t] + 1e-9 for t in plain)
    assert all(abs(r.inertia - best[r.tile]) < 1e-6 for r in out) and best["a"] < 60 * 2 * 0.3 ** 2 * 2 and best["one"] == 0
