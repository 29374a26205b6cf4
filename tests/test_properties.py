"""L4 property tests against pandas on random inputs (Hypothesis, few examples: each runs Spark)."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pondflow.operators import series as sr

readings = st.lists(
    st.tuples(st.sampled_from(["a", "b", "c"]),
              st.integers(min_value=0, max_value=24 * 120 - 1),      # hour offset within ~4 months
              st.floats(min_value=-50, max_value=50, allow_nan=False, allow_infinity=False)),
    min_size=1, max_size=60)

BASE = dt.datetime(2024, 1, 1)


@settings(max_examples=6, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=readings, how=st.sampled_from(["sum", "mean"]), freq=st.sampled_from(["D", "M"]))
def test_resample_matches_pandas(spark, rows, how, freq):
    data = [(k, BASE + dt.timedelta(hours=h), float(v)) for k, h, v in rows]
    df = spark.createDataFrame(data, "site string, ts timestamp_ntz, v double")
    got = {(r["site"], r["date"]): r["v"] for r in sr.resample(df, ["site"], "ts", ["v"], freq, how).collect()}
    pdf = pd.DataFrame(data, columns=["site", "ts", "v"])
    exp = {}
    for site, g in pdf.groupby("site"):
        s = g.set_index("ts")["v"].resample("D" if freq == "D" else "ME")
        s = s.sum() if how == "sum" else s.mean()
        for ts, v in s.items():
            exp[(site, ts.date())] = None if pd.isna(v) else float(v)
    assert set(got) == set(exp)
    for key, v in exp.items():
        if v is None:
            assert got[key] is None
        else:
            assert got[key] == pytest.approx(v, rel=1e-9, abs=1e-9)


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.one_of(st.none(), st.floats(min_value=-100, max_value=100, allow_nan=False)),
                     min_size=2, max_size=40))
def test_interpolation_matches_pandas(spark, vals):
    dates = pd.date_range("2024-01-01", periods=len(vals), freq="D")
    df = spark.createDataFrame([("s", d.date(), v) for d, v in zip(dates, vals)], "site string, date date, v double")
    got = [r["v"] for r in sorted(sr.interpolate_time(df, ["site"], ["v"]).collect(), key=lambda r: r["date"])]
    exp = pd.Series([np.nan if v is None else v for v in vals], index=dates, dtype=float).interpolate(method="time")
    for g, e in zip(got, exp):
        if np.isnan(e):
            assert g is None
        else:
            assert g == pytest.approx(e, rel=1e-9, abs=1e-9)


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b"]),
                               st.floats(min_value=-1e6, max_value=1e6, allow_nan=False)), min_size=1, max_size=80),
       probs=st.lists(st.floats(min_value=0.0, max_value=1.0), min_size=1, max_size=3))
def test_sort_quantiles_match_numpy(spark, rows, probs):
    from pondflow.operators import stats
    df = spark.createDataFrame(rows, "site string, y double").repartition(3)
    got = {r["site"]: [r[f"q{i}"] for i in range(len(probs))]
           for r in stats.quantiles(df, ["site"], "y", probs).collect()}
    for site in {k for k, _ in rows}:
        vals = np.array([v for k, v in rows if k == site])
        assert got[site] == pytest.approx(list(np.percentile(vals, [100 * p for p in probs])), rel=1e-9, abs=1e-6)


@settings(max_examples=5, deadline=None, derandomize=True, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(series_days=st.sets(st.integers(min_value=0, max_value=60), min_size=1, max_size=25),
       targets=st.lists(st.tuples(st.integers(min_value=0, max_value=90), st.integers(min_value=0, max_value=500)),
                        min_size=1, max_size=25, unique_by=lambda t: t[0]))
def test_cyclic_lookup_matches_rule(spark, series_days, targets):
    from pondflow.operators import lookup
    d0 = dt.date(2024, 1, 1)
    series = sorted((d0 + dt.timedelta(days=d), float(d) * 1.5) for d in series_days)
    sdf = spark.createDataFrame([("k", d, v) for d, v in series], "site string, date date, v double")
    tdf = spark.createDataFrame([("k", d0 + dt.timedelta(days=d), i) for d, i in targets],
                                "site string, date date, idx long")
    got = {r["date"]: r["v"] for r in lookup.cyclic_lookup(tdf, sdf, ["site"], ["v"]).collect()}
    by_date = dict(series)
    for d, i in targets:
        day = d0 + dt.timedelta(days=d)
        exp = by_date[day] if day in by_date else series[i % len(series)][1]
        assert got[day] == exp
