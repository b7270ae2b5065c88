"""Slots, windows and date conventions on hand-computed frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cropseries.functions import calendar as cal
from cropseries.operators import timegrid

END = dt.date(2022, 6, 30)


def frame(spark, data):
    return spark.createDataFrame(data, "p int, obs_date date, v double")


def test_slot_edges(spark, rows):
    dates = [END, END - dt.timedelta(13), END - dt.timedelta(14), END + dt.timedelta(1), END - dt.timedelta(181), END - dt.timedelta(182)]
    df = frame(spark, [(i, d, 1.0) for i, d in enumerate(dates)])
    slot = cal.backward_slot("obs_date", F.lit(END), 13, 14)
    assert rows(df.select("p", slot.alias("s"))) == [(0, 12), (1, 12), (2, 11), (3, None), (4, 0), (5, None)]


def test_missing_pixel_counts_only_in_grid_mean(spark):
    df = frame(spark, [(1, END, 0.4), (1, END - dt.timedelta(3), None)])
    nanmean = timegrid.composite_nanmean(df, ["p"], ["v"], str(END), 1).filter("slot = 2").first()
    grid = timegrid.composite_grid(df, ["p"], ["v"], str(END), 3).filter("slot = 2").first()
    assert (nanmean.v, grid.v) == (0.4, 0.2)
    assert nanmean.slot_date == dt.date(2022, 6, 28)
    assert (grid.doy, grid.day) == (181, 181 / 365.0)


def test_every_pixel_has_all_slots_and_empty_ones_are_zero(spark):
    df = frame(spark, [(1, END, 0.4), (2, END - dt.timedelta(100), 0.7)])
    out = timegrid.composite_nanmean(df, ["p"], ["v"], str(END))
    assert out.groupBy("p").count().collect() and {r["count"] for r in out.groupBy("p").count().collect()} == {13}
    assert out.filter("v = 0").count() == 24
    empty = out.filter("p = 1 AND slot = 0").first()
    assert empty.slot_date == END - dt.timedelta(14 * 12)


def test_month_windows_equal_single_composites(spark):
    import random
    rnd = random.Random(1)
    data = [(p, END - dt.timedelta(rnd.randrange(400)), rnd.choice([None, rnd.random()])) for p in range(3) for _ in range(80)]
    df = frame(spark, data)
    many = timegrid.month_window_series(df, ["p"], ["v"], str(END), 5)
    assert many.select("window_end").distinct().count() == 5
    for end in ("2022-06-30", "2022-02-28"):
        one = timegrid.composite_nanmean(df, ["p"], ["v"], end)
        want = {r.p: [round(v, 9) for v in r.vs] for r in one.groupBy("p").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("slot", "v"))), lambda s: s["v"]).alias("vs")).collect()}
        first = {r.p: r.slot_date for r in one.filter("slot = 0").collect()}
        got = many.filter(F.col("window_end") == F.lit(end).cast("date")).collect()
        assert {r.p: [round(v, 9) for v in r.v] for r in got} == want
        assert {r.p: r.first_date for r in got} == first


def test_day_of_year_conventions(spark):
    r = spark.range(1).select(cal.doy(F.lit(dt.date(2024, 1, 1))).alias("a"), cal.julian0(F.lit(dt.date(2024, 1, 1))).alias("b"),
                              cal.doy(F.lit(dt.date(2024, 12, 31))).alias("c")).first()
    assert (r.a, r.b, r.c) == (1, 0, 366)


def test_february_always_ends_on_the_28th(spark):
    ends = [r.window_end for r in timegrid.month_ends(spark, "2024-03-15", 3).orderBy("position").collect()]
    assert ends == [dt.date(2024, 3, 31), dt.date(2024, 2, 28), dt.date(2024, 1, 31)]


def test_time_window_includes_both_ends(spark, rows):
    days = [dt.date(2022, 1, 1), dt.date(2022, 3, 3), dt.date(2022, 3, 4)]
    df = frame(spark, [(i, d, 0.0) for i, d in enumerate(days)])
    assert rows(timegrid.time_window(df, start="2022-01-01", n_months=2), "p") == [(0,), (1,)]
    assert rows(timegrid.time_window(df, end="2022-03-03", n_months=2), "p") == [(0,), (1,)]
    with pytest.raises(ValueError):
        timegrid.time_window(df)


def test_day_offset_with_reference_date(spark, rows):
    df = frame(spark, [(1, dt.date(2022, 1, 5), 0.0), (1, dt.date(2022, 1, 9), 0.0)])
    assert rows(timegrid.day_offset(df, ["p"], reference_date="2022-02-01"), "day_offset") == [(0,), (4,)]


def test_random_window_is_a_window_of_the_key(spark):
    df = frame(spark, [(p, dt.date(2020, 1, 1) + dt.timedelta(7 * i), float(i)) for p in range(4) for i in range(100)])
    out = timegrid.random_window(df, ["p"], 6, seed=3)
    again = timegrid.random_window(df.repartition(7), ["p"], 6, seed=3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, again.collect()))
    last = dt.date(2020, 1, 1) + dt.timedelta(7 * 99)
    for r in out.groupBy("p").agg(F.min("obs_date").alias("lo"), F.max("obs_date").alias("hi"), F.first("window_start").alias("s"),
                                  F.count("*").alias("n")).collect():
        assert r.s == r.lo <= last - dt.timedelta(121) and r.hi <= r.s + dt.timedelta(181)
        expected = sum(1 for i in range(100) if r.s <= dt.date(2020, 1, 1) + dt.timedelta(7 * i) <= r.s + dt.timedelta(181))
        assert r.n == expected


def test_random_month_window_keeps_months_of_every_year(spark):
    df = frame(spark, [(p, dt.date(2020, 1, 10) + dt.timedelta(15 * i), 0.0) for p in range(6) for i in range(72)])
    out = timegrid.random_month_window(df, ["p"], 4, seed=9)
    for r in out.groupBy("p").agg(F.collect_set(F.month("obs_date")).alias("m"), F.first("start_month").alias("s"),
                                  F.countDistinct(F.year("obs_date")).alias("y")).collect():
        assert sorted(r.m) == list(range(r.s, r.s + 4)) and 1 <= r.s <= 9 and r.y >= 2


def test_pad_dates(spark, rows):
    df = frame(spark, [(1, dt.date(2022, 1, 9), 0.5), (1, dt.date(2022, 1, 5), None)])
    assert rows(timegrid.pad_dates(df, ["p"], ["v"], 4), "step", "v") == [(0, 0.0), (1, 0.5), (2, 0.0), (3, 0.0)]


def test_steps_reach_back_to_the_first_date(spark):
    days = [0, 13, 14, 2519, 2520, 4000]
    df = spark.createDataFrame([(1, d) for d in days], "k int, d int").selectExpr("k", "date_add(date'2010-01-01', d) AS obs_date", "d + 1.0 AS v")
    steps = timegrid.steps_between(df)
    assert steps == 4000 // 14 + 1 and timegrid.steps_between(df.limit(0)) == 1
    full = timegrid.composite_nanmean(df, ["k"], ["v"], "2020-12-14", steps=steps).collect()
    assert len(full) == steps and sum(r.v > 0 for r in full) == len({(4000 - d) // 14 for d in days})
