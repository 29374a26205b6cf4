"""Plan-shape regression tests: the physical plans keep the shape reviewed in PLANS.md."""

import re

import pytest

import __spark_entry__ as E

SKIP = {"evaporation_forecast", "evaporation_forecast_after_last", "evaporation_forecast_cumulative",
        "water_level_forecast", "forecast_days", "final_concentration_score", "recursive_forecast", "csv_roundtrip"}


def plan(df) -> str:
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def count(txt: str, node: str) -> int:
    return len(re.findall(rf"^\(\d+\) {node}\b", txt, flags=re.M))


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    return {n: plan(f(spark, sf_small)) for n, f in E.queries().items() if n not in SKIP}


def test_flagship_is_one_scan_one_aggregate_one_window_exchange(plans):
    p = plans["zone_balance_chained"]
    assert count(p, "Scan parquet") == 1
    assert count(p, "Exchange") == 2                   # aggregate (site, date), then window (site)
    assert "Join" not in p
    assert "partial_avg" in p                          # combined map-side before the shuffle


def test_pond_balance_single_scan_no_join(plans):
    p = plans["pond_balance_chained"]
    assert count(p, "Scan parquet") == 1 and "Join" not in p


def test_gap_filling_and_readings_pipeline_join_free(plans):
    for name in ("resample_daily_sum", "resample_monthly_mean", "asfreq_daily", "interpolate_gaps",
                 "zone_balance_from_readings", "cyclic_lookup"):
        assert "Join" not in plans[name], name


def test_no_cartesian_products_anywhere(plans):
    for name, p in plans.items():
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name


def test_scans_prune_columns(plans):
    # lineitem has 11 columns; no query reads more than 6 of them
    for name, p in plans.items():
        for loc, schema in re.findall(r"Location: [^\n]*?(\w+)\.parquet\][^\n]*\n(?:[^\n]*\n)*?ReadSchema: struct<(.*)>", p):
            if loc == "lineitem":
                assert schema.count(":") <= 6, (name, schema)
