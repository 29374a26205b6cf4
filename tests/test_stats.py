"""L1/L4: quantiles (three methods vs numpy), trim, scaling, OLS."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pondflow.operators import stats as st


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    vals = {"a": rng.normal(size=997), "b": rng.exponential(size=31), "c": np.array([2.0])}
    rows = [(k, float(v)) for k, arr in vals.items() for v in arr]
    df = spark.createDataFrame(rows, "site string, y double").repartition(5)
    return df, vals


@pytest.mark.parametrize("method", ["sort", "hash"])
def test_quantiles_exact_match_numpy(data, method):
    df, vals = data
    got = {r["site"]: (r["q0"], r["q1"], r["q2"]) for r in st.quantiles(df, ["site"], "y", [0.01, 0.5, 0.99], method=method).collect()}
    for k, arr in vals.items():
        assert got[k] == pytest.approx(tuple(np.percentile(arr, [1, 50, 99])), abs=1e-12)


def test_quantiles_approx_close(data):
    df, vals = data
    got = {r["site"]: r["q0"] for r in st.quantiles(df, ["site"], "y", [0.5], method="approx").collect()}
    assert got["a"] == pytest.approx(np.median(vals["a"]), abs=0.05)


def test_trim_and_robust_scale(data):
    df, vals = data
    kept = st.percentile_trim(df, ["site"], "y").where("site = 'a'").count()
    lo, hi = np.percentile(vals["a"], [1, 99])
    assert kept == int(((vals["a"] > lo) & (vals["a"] < hi)).sum())
    sc = st.robust_scale(df, ["site"], "y").where("site = 'a'")
    r = sc.agg(F.min("y_scaled"), F.max("y_scaled")).first()
    assert r[0] < 0 and r[1] > 1   # outliers land outside [0, 1]


def test_minmax_roundtrip(data):
    df, vals = data
    stats = st.minmax_fit(df, ["site"], "y")
    fwd = st.minmax_apply(df, stats, ["site"], "y", out="t")
    back = st.minmax_apply(fwd.select("site", F.col("t").alias("y")), stats, ["site"], "y", out="b", inverse=True)
    a = sorted(r["y"] for r in df.collect())
    b = sorted(r["b"] for r in back.collect())
    assert b == pytest.approx(a, abs=1e-12)


def test_ols_slope(spark):
    x = np.linspace(0, 10, 50)
    rows = [("s", float(xi), float(3.0 * xi + 2.0)) for xi in x]
    df = spark.createDataFrame(rows, "site string, x double, y double")
    r = st.ols_fit(df, ["site"], "y", "x").first()
    assert r["slope"] == pytest.approx(3.0) and r["intercept"] == pytest.approx(2.0)


def test_feature_ranges_and_out_of_range(spark):
    tr = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0)], "a double, b double")
    cur = spark.createDataFrame([(1.5, 25.0)], "a double, b double")
    rep = {r["feature"]: r["violated"] for r in st.out_of_range(cur, st.feature_ranges(tr, [], ["a", "b"]), ["a", "b"]).collect()}
    assert rep == {"a": False, "b": True}


def test_null_report(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", None), ("s", float("nan"))], "site string, v double")
    r = st.null_report(df, ["site"], ["v"]).first()
    assert (r["n_rows"], r["n_null_v"]) == (3, 2)
