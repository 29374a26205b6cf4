"""Model operators (small trees so tests stay fast; defaults keep reference sizes)."""

import datetime as dt
import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from pondflow.operators import models as M
from pondflow.operators.recursive import feature_names, recursive_forecast, training_frame

SMALL = dict(maxIter=8, stepSize=0.3, maxDepth=3, subsamplingRate=0.9, seed=42)


def test_reference_capacity_defaults():
    assert M.GBT_CALENDAR["maxIter"] == 200 and M.GBT_CALENDAR["maxDepth"] == 5
    assert M.GBT_RECURSIVE["maxIter"] == 300 and M.GBT_RECURSIVE["maxDepth"] == 6


def test_hash_split_stable_under_repartition(spark):
    df = spark.range(5000).withColumnRenamed("id", "k")
    a, _ = M.hash_split(df, ["k"], 0.2)
    b, _ = M.hash_split(df.repartition(7), ["k"], 0.2)
    ida = {r[0] for r in a.collect()}
    assert ida == {r[0] for r in b.collect()}
    assert 0.75 < len(ida) / 5000 < 0.85


@pytest.fixture(scope="module")
def seasonal(spark):
    rows = []
    for site, amp in (("a", 1.0), ("b", 2.0)):
        for i in range(400):
            d = dt.date(2020, 1, 1) + dt.timedelta(days=i)
            y = 10 + amp * math.sin(2 * math.pi * i / 365) + 0.1 * ((i * 7919) % 13) / 13
            rows.append((site, d, y, 5.0 + (i % 9)))
    return spark.createDataFrame(rows, "site string, date date, y double, evap double")


def test_tree_walk_equals_transform(spark, seasonal):
    feats = ["evap", "yy"]
    df = seasonal.withColumn("yy", F.dayofyear("date").cast("double"))
    model = M.fit_regressor(df, feats, "y", SMALL)
    path = tempfile.mkdtemp(prefix="pf-model-") + "/gbt"
    trees = M.tree_arrays(spark, M.tree_stage(model), path)
    pdf = model.transform(df).select(*feats, "prediction").limit(50).toPandas()
    for _, r in pdf.iterrows():
        x = np.array([r[c] for c in feats], dtype=float)
        assert M.predict_trees(trees, x) == pytest.approx(r["prediction"], abs=1e-9)


def test_registry_load_or_fit(spark, seasonal):
    reg = M.ModelRegistry(spark, tempfile.mkdtemp(prefix="pf-reg-"))
    calls = []

    def fit():
        calls.append(1)
        return M.fit_regressor(seasonal, ["evap"], "y", SMALL)

    reg.load_or_fit("m", ["evap"], fit)
    reg.load_or_fit("m", ["evap"], fit)
    assert len(calls) == 1
    reg.load_or_fit("m", ["evap", "x"], fit)   # feature list changed -> refit (M10)
    assert len(calls) == 2


def test_registry_compares_parameters_and_data(spark, seasonal):
    reg = M.ModelRegistry(spark, tempfile.mkdtemp(prefix="pf-reg-"))
    calls = []

    def fit():
        calls.append(1)
        return M.fit_regressor(seasonal, ["evap"], "y", SMALL)

    shifted = seasonal.withColumn("y", F.col("y") + 100)
    for params, data, fits in ((SMALL, seasonal, 1), (SMALL, seasonal, 1), ({**SMALL, "maxIter": 3}, seasonal, 2),
                               ({**SMALL, "maxIter": 3}, shifted, 3), ({**SMALL, "maxIter": 3}, shifted, 3)):
        reg.load_or_fit("m", ["evap"], fit, params=params, data=data)
        assert len(calls) == fits


def test_registry_raises_what_is_not_a_missing_path(spark, tmp_path):
    assert M.read_saved(spark, str(tmp_path / "none")) is None
    reg = M.ModelRegistry(spark, str(tmp_path))
    (tmp_path / "m" / "features").mkdir(parents=True)
    (tmp_path / "m" / "features" / "part-0").write_text("no json")
    with pytest.raises(ValueError):
        reg.load("m")


def test_training_frame_drops_incomplete_rows(seasonal):
    tf = training_frame(seasonal, ["site"], "y", ["evap"], lags=10, windows=(5, 7))
    assert tf.groupBy("site").count().collect()[0]["count"] == 400 - 10
    assert tf.columns[3:] == feature_names(["evap"], 10, (5, 7))


def test_recursive_forecast_shape_and_determinism(spark, seasonal):
    kw = dict(lags=20, windows=(7, 14), params=SMALL)
    a = recursive_forecast(spark, seasonal, ["site"], "y", ["evap"], "2021-03", "2021-04", **kw)
    pa = sorted((r["site"], r["date"], r["prediction"]) for r in a.collect())
    assert len(pa) == 2 * (31 + 30)
    assert all(5 < p < 15 for _, _, p in pa)
    b = recursive_forecast(spark, seasonal, ["site"], "y", ["evap"], "2021-03", "2021-04", **kw)
    pb = sorted((r["site"], r["date"], r["prediction"]) for r in b.collect())
    assert [p for *_, p in pa] == pytest.approx([p for *_, p in pb])


def test_recursive_forecast_compat_mode(spark, seasonal):
    kw = dict(lags=20, windows=(7, 14), params=SMALL, compat=True)
    out = recursive_forecast(spark, seasonal, ["site"], "y", ["evap"], "2021-03", "2021-03", **kw)
    assert out.count() == 2 * 31


def test_impute_with_null_indicators(spark):
    rows = [(float(i), None if i % 5 == 0 else float(i % 7), 2.0 * i) for i in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    model = M.fit_regressor(df, ["a", "b"], "y", SMALL, impute=True)
    out = M.score(model, df.limit(10))
    assert out.count() == 10 and "prediction" in out.columns


def test_per_key_models(spark, seasonal):
    models = M.fit_per_key(seasonal, ["site"], ["evap"], "y", SMALL)
    assert set(models) == {("a",), ("b",)}
    out = M.score_per_key(models, seasonal, ["site"])
    assert out.count() == seasonal.count()
    # rows of keys without a model stay, marked
    new = seasonal.limit(15).withColumn("site", F.lit("new")).unionByName(seasonal.limit(1).withColumn("site", F.lit(None).cast("string")))
    out = M.score_per_key(models, seasonal.unionByName(new), ["site"])
    assert out.count() == seasonal.count() + 16
    assert out.where("status = 'no model' and prediction is null").count() == 16


def test_key_signal_keeps_rows_of_unseen_keys(seasonal):
    new = seasonal.limit(15).withColumn("site", F.lit("new"))
    out = M.with_key_signal(seasonal.unionByName(new), seasonal, ["site"], "y")
    assert out.count() == seasonal.count() + 15
    assert out.where("site = 'new' and key_rows = 0 and key_mean is null").count() == 15


def test_short_series_come_out_of_the_recursive_forecast(spark, seasonal):
    last = seasonal.agg(F.max("date")).first()[0]
    short = seasonal.where("site = 'a'").where(F.col("date") > F.date_sub(F.lit(last), 15)).withColumn("site", F.lit("short"))
    out = recursive_forecast(spark, seasonal.unionByName(short), ["site"], "y", ["evap"], "2021-03", "2021-03",
                             lags=20, windows=(7, 14), params=SMALL)
    rows = {(r["site"], r["status"]): r["n"] for r in out.groupBy("site", "status").agg(F.count("*").alias("n")).collect()}
    assert rows == {("a", "forecast"): 31, ("b", "forecast"): 31, ("short", "series too short"): 31}


def test_recursive_fixed_horizon_slice(spark, seasonal):
    """Forecast a fixed number of days after the last observation, then slice."""
    from pondflow.operators.recursive import fit_recursive, forecast_recursive
    rm = fit_recursive(spark, seasonal, ["site"], "y", ["evap"], lags=20, windows=(7, 14), params=SMALL)
    # history ends 2021-02-03; 40 days reach 2021-03-15, the slice keeps March 1-15
    out = forecast_recursive(rm, seasonal, "2021-03", "2021-03", horizon_days=40, index_base=1)
    dates = sorted({r["date"] for r in out.collect()})
    assert dates[0] == dt.date(2021, 3, 1) and dates[-1] == dt.date(2021, 3, 15) and len(dates) == 15


def test_kg_variant_parameters(spark, seasonal):
    """The 'kg' variant (30 lags, one 14-day window, column sampling, min gain)."""
    kw = dict(lags=30, windows=(14,), params=dict(M.GBT_RECURSIVE_KG, maxIter=4))
    out = recursive_forecast(spark, seasonal, ["site"], "y", ["evap"], "2021-03", "2021-03", **kw)
    assert out.count() == 2 * 31


def test_fit_or_load_recursive_reuses_forest(spark, seasonal):
    import tempfile
    from pondflow.operators.recursive import fit_or_load_recursive, forecast_recursive
    root = tempfile.mkdtemp(prefix="pf-rec-") + "/m"
    kw = dict(lags=20, windows=(7, 14), params=SMALL)
    a = fit_or_load_recursive(spark, seasonal, ["site"], "y", ["evap"], root, **kw)
    b = fit_or_load_recursive(spark, seasonal, ["site"], "y", ["evap"], root, **kw)   # loaded
    pa = sorted(tuple(r) for r in forecast_recursive(a, seasonal, "2021-03", "2021-03").collect())
    pb = sorted(tuple(r) for r in forecast_recursive(b, seasonal, "2021-03", "2021-03").collect())
    assert pa == pb
    other = dict(kw, params=dict(SMALL, maxIter=3))                                  # other params -> refit
    c = fit_or_load_recursive(spark, seasonal, ["site"], "y", ["evap"], root, **other)
    assert c.trees.value["weight"].shape[0] == 3
