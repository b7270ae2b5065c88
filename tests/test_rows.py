"""Row-level operators: masks, scaling, indices, labels, names."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cropseries.functions import labels, spectral
from cropseries.operators import bands, phenology, quality
from cropseries.plans import chain
from cropseries.sources import catalog, granules


def test_quality_masks(spark, rows):
    df = spark.createDataFrame([(0, 1.0), (2, 1.0), (32, 1.0), (None, 1.0)], "fmask int, v double")
    assert rows(bands.fmask_mask(df, ["v"])) == [(0, 1.0), (2, None), (32, 1.0), (None, 1.0)]
    assert rows(bands.fmask_mask(df, ["v"], spectral.GENERIC_BITS)) == [(0, 1.0), (2, None), (32, None), (None, 1.0)]
    twice = bands.fmask_mask(bands.fmask_mask(df, ["v"]), ["v"])
    assert rows(twice) == rows(bands.fmask_mask(df, ["v"]))
    assert bands.fmask_mask(df, ["v"], blank_quality=True).filter("fmask = 2").count() == 0


def test_custom_index_rejects_unknown_bands_and_code(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    assert bands.custom_index(df, "a / b", "q").first().q is None
    assert bands.custom_index(df, "-(a + 1) ** 2", "q").first().q == -4.0
    for bad in ("a + missing", "__import__('os')", "a if b else a"):
        with pytest.raises(ValueError):
            bands.custom_index(df, bad, "q")


def test_guarded_ratio_only_where_absent(spark):
    df = spark.createDataFrame([(0.5, 0.1, 0.2, 9.0)], "nir double, red double, green double, ndvi double")
    r = bands.ndvi_guarded(df).first()
    assert r.ndvi == 9.0 and abs(r.gndvi - 0.3 / (0.7 + 1e-9)) < 1e-12


def test_scaling_keeps_zeros(spark, rows):
    df = spark.createDataFrame([(0.0,), (2.0,), (None,), (4.0,)], "v double")
    assert [round(r[0], 6) for r in rows(bands.standard_scale(df, "v", 3.0, 1.0))] == [-1.0, 0.0, 0.0, 1.0]
    assert rows(bands.minmax_scale(df, "v")) == [(0.0,), (0.0,), (0.5,), (1.0,)]
    assert rows(bands.minmax_scale(df, "v", navalue=None)) == [(0.0,), (0.5,), (1.0,), (None,)]


def test_normalize_needs_known_band_count(spark):
    with pytest.raises(ValueError):
        bands.normalize_bands(spark.range(1), 6)


def test_repair_scale(spark, rows):
    df = spark.createDataFrame([(0.5,), (5000.0,), (-9999.0,), (-3.0,), (200000.0,)], "v double")
    assert rows(bands.repair_scale(df, ["v"])) == [(-3.0,), (0.5,), (0.5,), (200000.0,), (None,)]


def test_labels(spark):
    df = spark.createDataFrame([(12, "maize", [0.1, 0.9, 0.9]), (99, "rice", [0.5, 0.1, 0.2])], "c int, w string, s array<double>")
    got = df.select(labels.lc_group("c").alias("g"), labels.is_crop("c").alias("k"), labels.crop_code("w").alias("n"),
                    labels.argmax_class("s").alias("a")).collect()
    assert [tuple(r) for r in got] == [("crops", True, 1, 1), (None, False, 0, 0)]
    assert sorted(v for g in labels.LC_GROUPS.values() for v in g) == list(range(1, 22))


def test_file_names(spark, rows):
    df = spark.createDataFrame([("synth_20231patch_0000.nc",), ("hls_patch_00001.nc",), ("other.nc",)], "file_name string")
    assert rows(catalog.patch_catalog(df)) == [("hls_patch_00001.nc", None, "00001"), ("other.nc", None, None),
                                               ("synth_20231patch_0000.nc", "synth", "0000")]


def test_granule_ids(spark, rows):
    df = spark.createDataFrame([("HLS.S30.T16PDV.2023060T160000.v2.0",), ("HLS.L30.T16PDV.2024060T160000.v2.0",),
                                ("x.HLSS30.none",)], "granule_id string")
    assert rows(granules.granule_parse(df), "product", "obs_date") == [
        ("HLSL30", dt.date(2024, 2, 29)), ("HLSS30", dt.date(2023, 3, 1)), ("HLSS30", None)]
    assert granules.granule_rejects(df).count() == 1


def test_cloud_filter_unset_means_all(spark):
    df = spark.createDataFrame([(10.0,), (30.0,)], "cloud_cover double")
    assert (granules.cloud_filter(df).count(), granules.cloud_filter(df, 0).count(), granules.cloud_filter(df, 10).count()) == (2, 2, 0)


def test_granule_cap_per_product_is_exact(spark):
    df = spark.range(5000).select(F.concat(F.lit("g"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("granule_id"),
                                  F.when(F.col("id") % 10 == 0, "HLSL30").otherwise("HLSS30").alias("product"),
                                  F.lit(0.0).alias("min_lon"), F.lit(1.0).alias("max_lon"), F.lit(0.0).alias("min_lat"), F.lit(1.0).alias("max_lat"),
                                  F.lit("2022-01-01").cast("timestamp_ntz").alias("begin_ts"))
    got = granules.granule_search(df, (0, 0, 1, 1), "2021-01-01", "2023-01-01", max_results=1500)
    counts = {r.product: r["count"] for r in got.groupBy("product").count().collect()}
    assert counts == {"HLSS30": 1500, "HLSL30": 500}
    assert got.filter("product = 'HLSS30'").agg(F.max("granule_id")).first()[0] == "g01666"


def test_day_bins(spark):
    df = spark.createDataFrame([(0,), (13,), (14,), (363,), (364,)], "doy int")
    assert [r.doy for r in phenology.biweekly_snap(df).collect()] == [7.0, 7.0, 21.0, 357.0, 364.0]


def test_constant_series_is_flagged(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(5)], "k int, obs_date int, v double")
    assert quality.rolling_zscore(df, ["k"], "v").filter("is_outlier AND z IS NULL").count() == 5


def test_one_band_never_removes_a_date(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(5)], "k int, obs_date int, v double")
    assert quality.remove_anomalies(df, ["k"], ["v"]).count() == 5
    two = df.withColumn("w", F.col("v"))
    assert quality.remove_anomalies(two, ["k"], ["v", "w"]).count() == 0


def test_rare_values_count_missing_pixels_in_the_total(spark, rows):
    df = spark.createDataFrame([(1, 7.0)] * 1 + [(1, 21.0)] * 60 + [(1, None)] * 100, "t int, doy double")
    out = phenology.suppress_rare(df, ["t"])
    assert {r.doy: r["count"] for r in out.groupBy("doy").count().collect()} == {21.0: 60, None: 101}


CASES = [  # g, m, s, d, validate, check
    ((None, 50.0, 90.0, 120.0), (None, None, None, 120.0), (None, 50.0, 90.0, 120.0)),
    ((None, 50.0, None, 120.0), (None, None, None, 120.0), (None, None, None, 120.0)),
    ((10.0, 130.0, 140.0, 160.0), (None, None, 140.0, 160.0), (None, None, 140.0, 160.0)),
    ((60.0, 50.0, 90.0, None), (None, None, None, None), (None, None, None, None)),
    ((10.0, 50.0, 60.0, 170.0), (10.0, 50.0, None, None), (10.0, 50.0, None, None)),
    ((10.0, 50.0, 90.0, None), (10.0, 50.0, 90.0, None), (10.0, 50.0, 90.0, None)),
    ((0.0, 50.0, 90.0, 120.0), (None, None, None, 120.0), (0.0, 50.0, 90.0, 120.0)),
    ((10.0, 115.0, None, None), (10.0, 115.0, None, None), (10.0, 115.0, None, None)),
]


@pytest.mark.parametrize("given,validated,checked", CASES)
def test_stage_rules(spark, given, validated, checked):
    df = spark.createDataFrame([given], "greenup double, maturity double, senescence double, dormancy double")
    assert tuple(phenology.validate_phenology(df).first()) == validated
    assert tuple(phenology.check_phenology(df).first()) == checked


def test_chain_rejects_unknown_steps(spark):
    df = spark.createDataFrame([(0.5,)], "v double")
    assert chain.run_steps(df, ["scale_bands"], {"scale_bands": {"bands": ["v"], "factor": 2.0}}).first().v == 1.0
    with pytest.raises(ValueError):
        chain.run_steps(df, ["no_such_step"])


def test_merge_bands_is_an_outer_join(spark, rows):
    a = spark.createDataFrame([(1, 0.1), (2, 0.2)], "k int, a double")
    b = spark.createDataFrame([(2, 0.5), (3, 0.6)], "k int, b double")
    assert rows(bands.merge_bands({"a": a, "b": b}, ["k"])) == [(1, 0.1, None), (2, 0.2, 0.5), (3, None, 0.6)]


def test_areas_meet_granules_once(spark):
    import datetime as dt
    import random
    from cropseries.sources import granules
    rnd = random.Random(2)
    day = lambda n: dt.datetime(2020, 1, 1) + dt.timedelta(hours=n)
    box = lambda most: (lambda x, y: (x, x + rnd.uniform(0, most), y, y + rnd.uniform(0, most)))(rnd.uniform(-5, 5), rnd.uniform(-5, 5))
    scenes = [(f"g{i}", rnd.choice(["HLSS30", "HLSL30", "other"]), *box(1.5), day(rnd.randrange(9000))) for i in range(150)]
    scenes += [("late", "HLSS30", 0.0, 1.0, 0.0, 1.0, None), ("turned", "HLSS30", 1.0, 0.0, 0.0, 1.0, day(5)), ("edge", "HLSL30", 2.0, 3.0, -1.0, 0.0, day(100)), (None, "HLSS30", -9.0, 9.0, -9.0, 9.0, day(100))]
    areas = [(i, *box(4), day(a), day(a + rnd.randrange(-100, 4000))) for i in range(40) for a in [rnd.randrange(8000)]]
    areas += [(100, 1.0, 2.0, 0.0, 1.0, day(100), day(100)), (101, 0.0, None, 0.0, 1.0, day(0), day(9000)), (102, -9.0, 9.0, -9.0, 9.0, day(0), day(9000))]
    g = spark.createDataFrame(scenes, "granule_id string, product string, min_lon double, max_lon double, min_lat double, max_lat double, begin_ts timestamp_ntz")
    a = spark.createDataFrame(areas, "area_id int, min_lon double, max_lon double, min_lat double, max_lat double, start timestamp_ntz, end timestamp_ntz")
    want = sorted(((k, s[0]) for k, x1, x2, y1, y2, t1, t2 in areas for s in scenes if s[1] != "other" and None not in (x2, s[6]) and s[2] <= s[3]
                   and x1 <= s[3] and s[2] <= x2 and y1 <= s[5] and s[4] <= y2 and t1 <= s[6] <= t2), key=str)
    for cell, days in ((1.0, 32), (0.7, 500), (20.0, 7)):
        found = granules.search_areas(g, a, cell, days)
        assert sorted(((r.area_id, r.granule_id) for r in found.collect()), key=str) == want
    assert (100, "edge") in want and "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    assert granules.search_areas(g, a.limit(0)).count() == 0
