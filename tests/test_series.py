"""L1/L4: frequency, resampling, spines, interpolation, windows, lookups."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pondflow.operators import filters as flt
from pondflow.operators import lookup as lk
from pondflow.operators import scan
from pondflow.operators import series as sr
from pondflow.operators import windows as wn


def ts(*a):
    return dt.datetime(*a)


def test_detect_frequency(spark):
    rows = [("h", ts(2024, 1, 1, h)) for h in range(5)] + [("d", ts(2024, 1, d)) for d in range(1, 6)] + \
           [("m", ts(2024, m, 1)) for m in range(1, 4)] + [("one", ts(2024, 1, 1))]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz")
    got = {r["site"]: r["freq"] for r in sr.detect_frequency(df, ["site"], "ts").collect()}
    assert got == {"h": "hourly", "d": "daily", "m": "monthly", "one": "monthly"}


def test_resample_sum_mean_with_empty_days(spark):
    rows = [("s", ts(2024, 1, 1, 1), 1.0), ("s", ts(2024, 1, 1, 5), 2.0), ("s", ts(2024, 1, 3, 0), 4.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double")
    s = {r["date"]: r["v"] for r in sr.resample(df, ["site"], "ts", ["v"], "D", "sum").collect()}
    m = {r["date"]: r["v"] for r in sr.resample(df, ["site"], "ts", ["v"], "D", "mean").collect()}
    d1, d2, d3 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)
    assert s == {d1: 3.0, d2: 0.0, d3: 4.0}
    assert m == {d1: 1.5, d2: None, d3: 4.0}


def test_resample_monthly_label_is_month_end(spark):
    rows = [("s", ts(2024, 1, 5), 1.0), ("s", ts(2024, 1, 20), 3.0), ("s", ts(2024, 3, 2), 5.0)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double")
    got = {r["date"]: r["v"] for r in sr.resample(df, ["site"], "ts", ["v"], "M", "mean").collect()}
    assert got == {dt.date(2024, 1, 31): 2.0, dt.date(2024, 2, 29): None, dt.date(2024, 3, 31): 5.0}


def test_resample_sum_preserves_total(spark):
    """L4: sum of daily bins == sum of raw readings."""
    rng = np.random.default_rng(1)
    rows = [("s%d" % (i % 3), ts(2024, 1, 1) + dt.timedelta(hours=int(h)), float(v))
            for i, (h, v) in enumerate(zip(rng.integers(0, 24 * 40, 500), rng.random(500)))]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz, v double")
    tot = sr.resample(df, ["site"], "ts", ["v"]).agg(F.sum("v")).first()[0]
    assert tot == pytest.approx(sum(r[2] for r in rows))


def test_interpolate_matches_pandas_time(spark):
    dates = pd.date_range("2024-01-01", periods=12, freq="D")
    vals = [1.0, np.nan, np.nan, 4.0, 10.0, np.nan, 2.0, np.nan, np.nan, np.nan, 6.0, 7.0]
    pdf = pd.DataFrame({"date": dates.date, "v": vals})
    df = spark.createDataFrame([("s", d, None if np.isnan(v) else v) for d, v in zip(pdf["date"], vals)],
                               "site string, date date, v double")
    got = sorted(sr.interpolate_time(df, ["site"], ["v"]).collect(), key=lambda r: r["date"])
    exp = pd.Series(vals, index=dates).interpolate(method="time").to_numpy()
    assert [g["v"] for g in got] == pytest.approx(list(exp), abs=1e-12)


def test_interpolate_exact_on_linear_data_with_gapped_spine(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=d), 2.0 * d + 1) for d in (0, 3, 4, 9)]
    df = spark.createDataFrame(rows, "site string, date date, v double")
    full = sr.interpolate_time(sr.asfreq_daily(df, ["site"]), ["site"], ["v"]).collect()
    assert len(full) == 10
    for r in full:
        assert r["v"] == pytest.approx(2.0 * (r["date"] - dt.date(2024, 1, 1)).days + 1)


def test_spines(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 30)), ("a", dt.date(2024, 2, 2)), ("b", dt.date(2024, 1, 1))],
                               "site string, date date")
    sp = sr.spine_for(df, ["site"]).groupBy("site").count().collect()
    assert {r["site"]: r["count"] for r in sp} == {"a": 4, "b": 1}
    after = sr.spine_after_last(df, ["site"], 3).where("site = 'a'").orderBy("date").collect()
    assert [r["date"] for r in after] == [dt.date(2024, 2, 3), dt.date(2024, 2, 4), dt.date(2024, 2, 5)]


def test_rolling_expanding_guards(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(6)]
    df = spark.createDataFrame(rows, "site string, date date, v double")
    out = wn.expanding_stats(wn.rolling_stats(df, ["site"], "v", (3,)), ["site"], "v").orderBy("date").collect()
    assert [r["v_rolling_mean_3"] for r in out] == [None, None, 1.0, 2.0, 3.0, 4.0]
    assert out[2]["v_rolling_std_3"] == pytest.approx(1.0)
    assert out[0]["v_cumulative_std"] is None
    assert out[5]["v_cumulative_mean"] == pytest.approx(2.5)
    s = pd.Series([float(i) for i in range(6)])
    assert [r["v_cumulative_std"] for r in out[1:]] == pytest.approx(list(s.expanding().std()[1:]))


def test_lags_array_and_columns(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "site string, date date, v double")
    cols = wn.lag_features(df, ["site"], "v", 2).orderBy("date").collect()
    arr = wn.lag_features(df, ["site"], "v", 2, as_array=True).orderBy("date").collect()
    assert [(r["lag_1"], r["lag_2"]) for r in cols] == [(None, None), (0.0, None), (1.0, 0.0), (2.0, 1.0), (3.0, 2.0)]
    assert [r["lags"] for r in arr] == [None, None, [1.0, 0.0], [2.0, 1.0], [3.0, 2.0]]
    tr = wn.trend_index(df, ["site"]).orderBy("date").collect()
    assert [r["trend"] for r in tr] == [0, 1, 2, 3, 4]


def test_last_rows(spark):
    rows = [("s", dt.date(2024, 1, i), float(i)) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "site string, date date, v double")
    assert sorted(r["v"] for r in wn.last_n_rows(df, ["site"], 2).collect()) == [4.0, 5.0]
    lr = wn.last_row(df, ["site"]).first()
    assert lr["date"] == dt.date(2024, 1, 5) and lr["v"] == 5.0


def test_cyclic_lookup(spark):
    series = spark.createDataFrame([("s", dt.date(2024, 1, i), float(i)) for i in (1, 2, 3)],
                                   "site string, date date, v double")
    target = spark.createDataFrame([("s", dt.date(2024, 1, 2), 0), ("s", dt.date(2024, 2, 1), 4),
                                    ("s", dt.date(2024, 2, 2), 5)], "site string, date date, idx int")
    got = {r["date"]: r["v"] for r in lk.cyclic_lookup(target, series, ["site"], ["v"]).collect()}
    assert got == {dt.date(2024, 1, 2): 2.0, dt.date(2024, 2, 1): 2.0, dt.date(2024, 2, 2): 3.0}


def test_map_lookup_default(spark):
    df = spark.createDataFrame([("a",), ("B",), ("z",)], "p string")
    got = [r[0] for r in df.select(lk.map_lookup("p", {"A": 1.0, "B": 2.0}, default=9.0)).collect()]
    assert got == [1.0, 2.0, 9.0]


def test_range_filter_fallback(spark):
    rows = [("in", dt.date(2024, 1, 5)), ("in", dt.date(2024, 3, 5)), ("out", dt.date(2024, 5, 1)),
            ("out", dt.date(2024, 6, 1))]
    df = spark.createDataFrame(rows, "site string, date date")
    got = sorted((r["site"], r["date"]) for r in flt.month_range_with_fallback(df, ["site"], "2024-01", "2024-01").collect())
    assert got == [("in", dt.date(2024, 1, 5)), ("out", dt.date(2024, 5, 1)), ("out", dt.date(2024, 6, 1))]
    assert flt.month_range_with_fallback(df, ["site"], None, None).count() == 4


def test_validation_errors(spark):
    df = spark.createDataFrame([(None, 1.0), (dt.date(2024, 1, 1), float("nan"))], "date date, y double")
    with pytest.raises(ValueError, match="missing required columns"):
        flt.require_columns(df, ["date", "Wl"])
    with pytest.raises(ValueError, match="could not be parsed"):
        flt.require_dates(df)
    with pytest.raises(ValueError, match="NaN"):
        flt.require_finite_target(df, "y")
    with pytest.raises(ValueError, match="no usable rows"):
        flt.require_rows(flt.drop_null_rows(df))
    with pytest.raises(ValueError, match="mismatch"):
        flt.require_feature_count(3, 4)


def test_result_page_stable(spark):
    df = spark.createDataFrame([(i, float(i % 4)) for i in range(25)], "id int, v double")
    p1 = [r["id"] for r in flt.result_page(df, "v", page=1, page_size=10, descending=True, tie_break=["id"]).collect()]
    allrows = sorted(((-r["v"], r["id"]) for r in df.collect()))
    assert p1 == [i for _, i in allrows[10:20]]


def test_normalize_readings_mixed_frequencies(spark):
    ev_rows = ([("h", ts(2024, 1, 1) + dt.timedelta(minutes=10 * i), 1.0) for i in range(144)]
               + [("h", ts(2024, 1, 3, 0, 30), 2.0)]
               + [("d", ts(2024, 1, dd), float(dd)) for dd in range(1, 4)]
               + [("m", ts(2024, mm, 10), float(mm)) for mm in (1, 2)] + [("m", ts(2024, 2, 20), 4.0)])
    wl_rows = [(s, t, v / 10) for s, t, v in ev_rows]
    ev = spark.createDataFrame(ev_rows, "site string, ts timestamp_ntz, evaporation double")
    wl = spark.createDataFrame(wl_rows, "site string, ts timestamp_ntz, wl double")
    out = sr.normalize_readings(ev, wl, ["site"]).collect()
    assert {r["site"]: r["freq"] for r in out} == {"h": "hourly", "d": "daily", "m": "monthly"}
    got = {(r["site"], r["date"]): r["evaporation"] for r in out}
    assert got[("h", dt.date(2024, 1, 1))] == 144.0         # hourly -> daily sum
    e_only = {(r["site"], r["date"]): r["evaporation"]
              for r in sr.normalize_readings(ev, None, ["site"]).collect()}
    assert e_only[("h", dt.date(2024, 1, 2))] == 0.0        # empty day inside the record -> 0
    assert got[("d", dt.date(2024, 1, 2))] == 2.0
    assert got[("m", dt.date(2024, 2, 29))] == 3.0          # monthly -> month-end mean
    wg = {(r["site"], r["date"]): r["wl"] for r in out}
    assert wg[("h", dt.date(2024, 1, 1))] == pytest.approx(0.1)   # water level -> daily mean


def test_pond_balance_from_readings(spark):
    from pondflow.plans import balance as bal
    ev = spark.createDataFrame([("p", ts(2024, 1, d), 5.0) for d in range(1, 6)], "site string, ts timestamp_ntz, evaporation double")
    fin = spark.createDataFrame([("p", ts(2024, 1, d, h), 1000.0) for d in range(1, 6) for h in (1, 9)],
                                "site string, ts timestamp_ntz, brine_in double")
    fout = spark.createDataFrame([("p", ts(2024, 1, d, 3), 500.0) for d in range(1, 6)],
                                 "site string, ts timestamp_ntz, brine_out double")
    out = bal.pond_balance_from_readings(ev, fin, fout, 0.3).orderBy("date").collect()
    assert len(out) == 5
    assert [r["cum_net_flow"] for r in out] == [1500.0, 3000.0, 4500.0, 6000.0, 7500.0]


def test_frequency_ignores_session_time_zone(spark):
    """Wall-clock hourly readings across a DST switch keep a 1 h mean gap in any session zone."""
    rows = [("s", ts(2024, 3, 10, 0) + dt.timedelta(hours=h)) for h in range(6)]
    df = spark.createDataFrame(rows, "site string, ts timestamp_ntz")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = sr.detect_frequency(df, ["site"], "ts").first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r["avg_gap_s"] == 3600.0 and r["freq"] == "hourly"


def test_dimension_join_broadcast_and_default(spark):
    df = spark.createDataFrame([("A", 1.0), ("B", 2.0), ("Z", 3.0)], "pond string, v double")
    dim = spark.createDataFrame([("A", 10.0), ("B", 20.0)], "pond string, area double")
    got = {r["pond"]: r["area"] for r in lk.dimension_join(df, dim, ["pond"]).collect()}
    assert got == {"A": 10.0, "B": 20.0, "Z": None}
    small = lk.dimension_join(df, dim, ["pond"], max_broadcast_rows=1)   # too big to broadcast -> shuffle join
    assert small.count() == 3


def test_duplicate_dates_detected_and_tie_break(spark):
    from pondflow.operators.scan import running_sum
    rows = [("s", dt.date(2024, 1, 1), 1.0, 0), ("s", dt.date(2024, 1, 1), 2.0, 1), ("s", dt.date(2024, 1, 2), 4.0, 2)]
    df = spark.createDataFrame(rows, "site string, date date, v double, line int")
    with pytest.raises(ValueError, match="duplicate rows"):
        flt.require_unique(df, ["site", "date"])
    got = [r["cum"] for r in running_sum(df, ["site"], "v", "cum", tie_break="line").orderBy("line").collect()]
    assert got == [1.0, 3.0, 7.0]
    assert flt.require_unique(df, ["site", "date", "line"]) is df


def test_interpolation_in_segments_equals_one_window(spark):
    """Gaps longer than a segment, at both ends, a key that is null and one without values."""
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=i) for i in range(400)]
    rows = [(k, d, float(i % 17) if i in keep else None, None if k else 1.0) for k, keep in
            (("a", {3, 4, 90, 300}), ("b", set()), (None, {0, 399}), ("c", set(range(400)))) for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "site string, date date, v double, u double")
    one = sr.interpolate_time(df, ["site"], ["v", "u"])
    cut = sr.interpolate_time(df, ["site"], ["v", "u"], segment=F.trunc("date", "month"))
    assert cut.columns == df.columns

    def norm(x):
        return sorted((tuple(r) for r in x.collect()), key=str)

    assert norm(one) == norm(cut)


def test_scaled_product_outlasts_the_range_of_doubles(spark):
    """100,000 days whose plain product is 0 from day 6,712 on; compared with sums of logarithms."""
    n = 100_000
    df = spark.range(n).select(F.lit("a").alias("site"), F.date_add(F.lit("1800-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                               F.when(F.col("id") < n // 2, 0.9).otherwise(1 / 0.9).alias("x"), "id")
    out = scan.scaled_product(df, ["site"], "x", "p", exclusive_out="pe")
    got = {r["id"]: (r["p"], r["pe"]) for r in out.where("id in (0, 10, 5000, 50000, 95000, 99998, 99999)").collect()}
    for i, (p, pe) in got.items():
        for value, days in ((p, i + 1), (pe, i)):
            net = days if days <= n // 2 else n - days
            assert value == pytest.approx(math.exp(net * math.log(0.9)) if net < 6500 else 0.0, rel=1e-9, abs=1e-300)
    assert got[0][1] == 1.0 and got[99999][0] == pytest.approx(1.0)


def test_scaled_product_of_odd_factors(spark):
    rows = [("a", dt.date(2020, 1, d), x) for d, x in enumerate([2.0, None, -3.0, 1e300, 1e300, 1e-300, 5e-324], 1)]
    rows += [("z", dt.date(2020, 1, 1), 0.0), ("z", dt.date(2020, 1, 2), 5.0), (None, dt.date(2020, 1, 1), float("inf")), (None, dt.date(2020, 1, 2), 0.0)]
    df = spark.createDataFrame(rows, "site string, date date, x double")
    got = {(r["site"], r["date"].day): r["p"] for r in scan.scaled_product(df, ["site"], "x", "p").collect()}
    assert [got["a", d] for d in (1, 2, 3)] == [2.0, 2.0, -6.0] and got["a", 4] == pytest.approx(-6e300)
    assert got["a", 5] == float("-inf") and got["a", 6] == pytest.approx(-6e300) and got["a", 7] == pytest.approx(-6e300 * 5e-324)
    assert got["z", 1] == got["z", 2] == 0.0 and got[None, 1] == float("inf") and math.isnan(got[None, 2])
    assert scan.scaled_product(df.where("false"), ["site"], "x", "p").count() == 0
