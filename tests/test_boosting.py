"""Keyed boosting, the folded forecast, published models, segments of a series and flows by period."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pondflow.operators import boosting, models, recursive, windows
from pondflow.operators import stats as st

ROWS = "site string, x double, z double, y double"


def training(spark, sites=("a", "b"), n=60):
    draw = random.Random(4)
    rows = [(s, float(i % 12), None if i % 7 == 0 else draw.random(), (3.0 if s == "a" else -2.0) * (i % 12 > 5) + (1.0 if i % 7 == 0 else 0.0))
            for s in sites for i in range(n)]
    return spark.createDataFrame(rows, ROWS)


def test_every_site_learns_its_own_signal_and_blanks_have_a_side(spark):
    df = training(spark)
    m = boosting.fit_boosted(df, ["site"], ["x", "z"], "y", dict(trees=6, depth=3, rate=0.6, bins=16, l2=0.0))
    out = boosting.score_boosted(m, df).collect()
    assert max(abs(r["prediction"] - r["y"]) for r in out) < 0.05


def test_null_keys_unknown_keys_and_missing_labels(spark):
    df = training(spark, ("a", None)).unionByName(spark.createDataFrame([("c", 1.0, 1.0, None), ("c", 2.0, 1.0, float("nan"))], ROWS))
    m = boosting.fit_boosted(df, ["site"], ["x", "z"], "y", dict(trees=2, depth=2, rate=0.5))
    got = {r["site"]: r["n"] for r in boosting.score_boosted(m, df).groupBy("site").agg(F.count("prediction").alias("n")).collect()}
    assert got == {"a": 60, None: 60, "c": 0}


def test_gain_floor_and_unkeyed_fit(spark):
    df = training(spark, ("a",))
    flat = boosting.fit_boosted(df, [], ["x", "z"], "y", dict(trees=2, depth=2, rate=0.5, gamma=1e9))
    mean = df.agg(F.avg("y")).first()[0]
    assert {round(r["prediction"], 9) for r in boosting.score_boosted(flat, df).collect()} == {round(mean, 9)}


def jobs_of(spark, fn) -> int:
    group = f"count-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        fn()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_do_not_grow_with_sites(spark):
    params = dict(trees=1, depth=2, rate=0.5)

    def fit(sites):
        df = training(spark, sites, 20)
        return jobs_of(spark, lambda: boosting.fit_boosted(df, ["site"], ["x", "z"], "y", params))
    few, many = fit(("a", "b")), fit([f"s{i}" for i in range(40)])
    assert many <= few + 3


def series(spark, days=60, gap=None):
    rows = [("s", dt.date(2021, 1, 1) + dt.timedelta(d), float(d % 7) + 0.1 * d) for d in range(days) if d != gap]
    return spark.createDataFrame(rows, "site string, date date, y double")


def test_folded_forecast_equals_the_numpy_walk(spark):
    """The fold over days against the same recursion written as a loop over the scored expression."""
    hist = series(spark)
    fm = recursive.fit_folded(hist, ["site"], "y", [], lags=3, windows=(5,), params=dict(trees=3, depth=2, rate=0.5, bins=8))
    got = {r["date"]: r["prediction"] for r in recursive.forecast_folded(fm, hist, "2021-03", "2021-03").collect()}
    import math
    import statistics
    values = [r["y"] for r in hist.orderBy("date").collect()]
    tree = fm.model.table.first()
    day = dt.date(2021, 3, 2)  # the day after the last one
    for step in range(10):
        past = values[-5:]
        doy = day.timetuple().tm_yday
        x = [math.sin(2 * math.pi * doy / 365), math.cos(2 * math.pi * doy / 365), math.sin(2 * math.pi * day.month / 12), math.cos(2 * math.pi * day.month / 12),
             float(60 + step), statistics.mean(values), statistics.stdev(values), statistics.mean(past), statistics.stdev(past), *values[-1:-4:-1]]
        p = tree["base"]
        for t in tree["ensemble"]:
            i = 0
            while t["feature"][i] is not None:
                i = 2 * i + (1 if x[t["feature"][i]] <= t["cut"][i] else 2)
            p += t["value"][i]
        assert got[day] == pytest.approx(p, abs=1e-9)
        values.append(p)
        day += dt.timedelta(1)


def test_short_series_and_long_horizons_are_not_cut(spark):
    hist = series(spark).unionByName(spark.createDataFrame([("short", dt.date(2021, 1, 1), 1.0)], "site string, date date, y double"))
    fm = recursive.fit_folded(hist, ["site"], "y", [], lags=3, windows=(5,), params=dict(trees=1, depth=1, rate=0.5))
    out = recursive.forecast_folded(fm, hist, "2021-03", "2022-12").collect()
    assert len([r for r in out if r["site"] == "s"]) == 670 and {r["status"] for r in out if r["site"] == "short"} == {"series too short"}


def test_a_broken_save_leaves_the_version_before(spark, tmp_path):
    root = str(tmp_path / "model")

    def write(text):
        return lambda folder: spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{folder}/x")
    assert models.current_version(spark, root) is None
    models.publish(spark, root, write("one"))

    def broken(folder):
        write("half")(folder)
        raise RuntimeError("lost")
    with pytest.raises(RuntimeError):
        models.publish(spark, root, broken)
    assert models.read_saved(spark, f"{models.current_version(spark, root)}/x") == "one"
    for text in ("two", "three"):
        models.publish(spark, root, write(text))
    assert models.read_saved(spark, f"{models.current_version(spark, root)}/x") == "three"
    assert len([p for p in (tmp_path / "model").iterdir() if p.name.startswith("v-")]) == 2


def test_one_series_is_many_groups_and_features_stay_the_same(spark):
    df = series(spark, 400, gap=100).withColumn("y", F.when(F.dayofmonth("date") != 13, F.col("y")))
    month = F.trunc("date", "month")
    for plain, cut in ((windows.rolling_stats(df, ["site"], "y", (5, 40)), windows.rolling_stats(df, ["site"], "y", (5, 40), segment=month)),
                       (windows.lag_features(df, ["site"], "y", 40), windows.lag_features(df, ["site"], "y", 40, segment=month)),
                       (windows.expanding_stats(df, ["site"], "y"), windows.expanding_stats(df, ["site"], "y", segment=month))):
        a, b = ([[None if v is None else round(v, 9) if isinstance(v, float) else v for v in r] for r in x.orderBy("date").collect()] for x in (plain, cut))
        assert plain.columns == cut.columns and a == b
    halo = windows.with_halo(df, ["site"], ["y"], 40, month)
    assert halo.groupBy("site", "_seg").count().count() == 14 and halo.groupBy("site", "_seg").count().agg(F.max("count")).first()[0] <= 71


def test_quantiles_of_ties_infinities_and_hot_values(spark):
    import numpy as np
    values = [1.0] * 500 + [2.0, 3.0, float("inf"), -5.0] + [7.0] * 300
    df = spark.createDataFrame([("k", v) for v in values] + [(None, 4.0), ("k", None), ("k", float("nan"))], "k string, v double").repartition(5)
    got = {r["k"]: [r["q0"], r["q1"], r["q2"]] for r in st.quantiles(df, ["k"], "v", [0.0, 0.62, 0.9]).collect()}
    assert got["k"] == pytest.approx([float(np.quantile(values, p)) for p in (0.0, 0.62, 0.9)]) and got[None] == [4.0] * 3


def test_monthly_evaporation_keeps_all_flows_and_makes_no_day_up(spark):
    from pondflow.plans import balance as bal

    def ts(m, d):
        return dt.datetime(2024, m, d)
    ev = spark.createDataFrame([("p", ts(m, 1), 5.0) for m in (1, 2, 3)], "site string, ts timestamp_ntz, evaporation double")
    days = [(m, d) for m in (1, 2, 3) for d in range(1, 29)]
    fin = spark.createDataFrame([("p", ts(m, d), 100.0) for m, d in days] + [("p", ts(1, 5), 100.0)], "site string, ts timestamp_ntz, brine_in double")
    fout = spark.createDataFrame([("p", ts(m, d), 40.0) for m, d in days if m != 2], "site string, ts timestamp_ntz, brine_out double")
    out = bal.pond_balance_from_readings(ev, fin, fout, 0.3).orderBy("date").collect()
    assert [(r["date"], r["cum_net_flow"]) for r in out] == [(dt.date(2024, 1, 31), 29 * 100.0 - 28 * 40.0), (dt.date(2024, 3, 31), 29 * 100.0 + 28 * 60.0 - 28 * 40.0)]
