"""Forecast plans (Q1, Q2, Q5, Q10, Q11) with small ensembles."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from pondflow.operators.models import EVAPORATION_TARGETS
from pondflow.plans import forecast as fc

SMALL = dict(maxIter=5, stepSize=0.3, maxDepth=3, subsamplingRate=0.9, seed=42)


@pytest.fixture(scope="module")
def weather(spark):
    rows = []
    for i in range(2 * 365):
        d = dt.date(2022, 1, 1) + dt.timedelta(days=i)
        s = math.sin(2 * math.pi * i / 365)
        rows.append((d, 20 + 5 * s, 1.5 + 0.3 * s, 3 + s, 1.5, 3 + 0.5 * s, 4 + s, 3 + 0.5 * s, 0.066))
    cols = ["date"] + EVAPORATION_TARGETS
    return spark.createDataFrame(rows, ", ".join([f"{cols[0]} date"] + [f"{c} double" for c in cols[1:]]))


@pytest.fixture(scope="module")
def cm(weather):
    return fc.fit_calendar_models(weather, EVAPORATION_TARGETS, params=SMALL)


def test_evaporation_forecast_modes(spark, cm):
    a, report = fc.forecast_evaporation(spark, cm, "2024-01", "2024-03", mode="a")
    b, _ = fc.forecast_evaporation(spark, cm, "2024-01", "2024-03", mode="b")
    pa = sorted((r["date"], r["evaporation"]) for r in a.collect())
    pb = sorted((r["date"], r["evaporation"]) for r in b.collect())
    assert len(pa) == 31 + 29 + 31 and pa[0][0] == dt.date(2024, 1, 1)
    running = 0.0
    for (d, e), (_, c) in zip(pa, pb):        # mode b = running sum of mode a (W2)
        running += e
        assert c == pytest.approx(running)
    viol = {r["feature"]: r["violated"] for r in report.collect()}
    assert viol["year"] is True and viol["month"] is False   # P15: 2024 outside trained years


def test_forecast_after_last(spark, cm, weather):
    out = fc.forecast_after_last(spark, cm, weather, 10).orderBy("date").collect()
    assert [r["date"] for r in out][:2] == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]   # day after last
    assert len(out) == 10


def test_water_level_forecast(spark, weather):
    hist = weather.select("date", F.col("slope").alias("wl"))
    m = fc.fit_calendar_models(hist, ["wl"], params=SMALL)
    out = fc.forecast_water_level(spark, m, "2024-02", "2024-02").collect()
    assert len(out) == 29 and all(1.0 < r["wl"] < 2.0 for r in out)
    assert {r["month"] for r in out} == {2} and out[0]["month_sin"] == pytest.approx(math.sin(2 * math.pi * 2 / 12))


def test_keyed_forecast_tells_sites_apart(spark, weather):
    hist = (weather.select(F.lit("low").alias("site"), "date", F.col("slope").alias("wl"))
            .unionByName(weather.select(F.lit("high").alias("site"), "date", (F.col("slope") + 100).alias("wl"))))
    m = fc.fit_calendar_models(hist, ["wl"], params=dict(numTrees=5, maxDepth=3, seed=42), keys=["site"])
    out = fc.forecast_water_level(spark, m, "2024-02", "2024-02").collect()
    assert len(out) == 58 and len({(r["site"], r["date"]) for r in out}) == 58
    assert all((1.0 < r["wl"] < 2.0) if r["site"] == "low" else (101.0 < r["wl"] < 102.0) for r in out)
    new = spark.createDataFrame([("other", dt.date(2024, 2, 1))], "site string, date date")
    assert [r["wl"] for r in fc.predict_calendar(m, new).collect()] == [None]     # unseen site: kept, not scored


def test_final_concentration_scoring_with_fallback(spark):
    rows = []
    for pond in ("P1", "P2"):
        for i in range(200):
            d = dt.date(2024 if pond == "P1" else 2023, 1, 1) + dt.timedelta(days=i)
            bi, bo = 1000.0 + i, 500.0 + (i % 7) * 10
            rows.append((pond, d, bi, None if i % 50 == 0 else bo, 0.3, 0.3 + bi / 1e5))
    df = spark.createDataFrame(rows, "pond string, date date, brine_in double, brine_out double, "
                                     "initial_concentration double, final_concentration double")
    model = fc.fit_concentration_model(df, keys=["pond"], params=SMALL)
    scored = fc.score_final_concentration(model, df.drop("final_concentration"), "2024-02", "2024-02", keys=["pond"])
    got = scored.groupBy("pond").count().collect()
    assert {r["pond"]: r["count"] for r in got} == {"P1": 29, "P2": 200}   # P2 has no Feb 2024 -> all rows
    assert scored.where(F.col("predicted_final").isNull()).count() == 0    # blanks imputed


def test_compare_series(spark):
    h = spark.createDataFrame([(dt.date(2023, 1, i), float(i)) for i in range(1, 11)] + [(dt.date(2023, 1, 11), None)],
                              "date date, c2 double")
    f = spark.createDataFrame([(dt.date(2023, 2, 1), 5.0)], "date date, c2 double")
    out = fc.compare_series(h, f, "2023-01-03", "2023-01-20", "c2").collect()
    assert sorted(r["trace"] for r in out).count("history") == 8
    assert [r["y"] for r in out if r["trace"] == "forecast"] == [5.0]


def test_calendar_model_registry_roundtrip(spark, cm, weather):
    import tempfile
    root = tempfile.mkdtemp(prefix="pf-cal-") + "/evap"
    fc.save_calendar_model(spark, cm, root)
    back = fc.load_calendar_model(spark, root, EVAPORATION_TARGETS)
    assert back is not None
    assert fc.load_calendar_model(spark, root, ["slope"]) is None        # other targets -> refit (M10)
    a, _ = fc.forecast_evaporation(spark, cm, "2024-01", "2024-01")
    b, _ = fc.forecast_evaporation(spark, back, "2024-01", "2024-01")
    pa = sorted((r["date"], r["evaporation"]) for r in a.collect())
    pb = sorted((r["date"], r["evaporation"]) for r in b.collect())
    assert [x for _, x in pa] == pytest.approx([x for _, x in pb])


def test_calendar_model_beats_mean_baseline(spark, cm, weather):
    """On a seasonal series the calendar regressor beats predicting the mean."""
    import numpy as np
    hist = weather.select("date", "slope").toPandas()
    pred = fc.predict_calendar(cm, weather.select("date")).select("date", "slope").toPandas()
    j = hist.merge(pred, on="date", suffixes=("", "_hat"))
    rmse = float(np.sqrt(np.mean((j["slope"] - j["slope_hat"]) ** 2)))
    baseline = float(np.sqrt(np.mean((j["slope"] - j["slope"].mean()) ** 2)))
    assert rmse < 0.5 * baseline
