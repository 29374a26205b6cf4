"""Sources (S1-S6) and sinks."""

import datetime as dt
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from pondflow.functions.labels import result_label
from pondflow.operators import series as sr
from pondflow.sources import csv as C
from pondflow.sources import sinks


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_dirty_header_day_first(spark):
    d = tempfile.mkdtemp(prefix="pf-csv-")
    # blank header cells and a unit-bearing name, as in the reference's files
    _write(f"{d}/Dhordo.csv", "Date,Brine_In,Brine_Out,Initial_Concentration_(gpl),,\n"
                              "01-01-2024,220186,174828,0.26,,\n02-01-2024,180910,,0.24,,\n")
    _write(f"{d}/Khavda.csv", "Date,Brine_In,Brine_Out,Initial_Concentration_(gpl),,\n"
                              "2024-01-03,1,2,,,\n")
    df = C.read_readings(spark, f"{d}/*.csv", ["Brine_In", "Brine_Out", "Initial_Concentration_(gpl)"],
                         site_from_path=r"/([^/]+)\.csv$", hourly=False)
    rows = sorted(df.collect(), key=lambda r: r["date"])
    assert df.columns == ["site", "date", "brine_in", "brine_out", "initial_concentration_gpl"]
    assert rows[0]["date"] == dt.date(2024, 1, 1) and rows[0]["site"] == "Dhordo"
    assert rows[1]["brine_out"] is None                      # blank cell -> NULL
    assert rows[2]["date"] == dt.date(2024, 1, 3) and rows[2]["site"] == "Khavda"   # ISO in the same family


def test_hourly_dialect_resampled_to_days(spark):
    d = tempfile.mkdtemp(prefix="pf-csv-")
    _write(f"{d}/evap.csv", "Date,Evaporation\n01-06-2023 0.00,1.5\n01-06-2023 13.30,2.5\n02-06-2023 1.00,4\n")
    df = C.read_readings(spark, f"{d}/evap.csv", {"Evaporation": "evaporation"}, hourly=True, site="z")
    assert sr.detect_frequency(df, ["site"], "ts").first()["freq"] == "daily"
    got = {r["date"]: r["evaporation"] for r in sr.resample(df, ["site"], "ts", ["evaporation"]).collect()}
    assert got == {dt.date(2023, 6, 1): 4.0, dt.date(2023, 6, 2): 4.0}


def test_missing_source_and_columns(spark):
    with pytest.raises(FileNotFoundError):
        C.read_csv(spark, "/nonexistent/file.csv")
    d = tempfile.mkdtemp(prefix="pf-csv-")
    _write(f"{d}/x.csv", "Date,Wl\n01-01-2025,0.5\n")
    with pytest.raises(ValueError, match="missing required columns"):
        C.read_csv(spark, f"{d}/x.csv", columns=["Date", "Evaporation"])
    assert C.read_csv(spark, f"{d}/x.csv", columns=["Date"]).columns == ["Date"]   # S4 pruning


def test_canonical_names():
    assert C.canonical("Initial_Concentration_(gpl)") == "initial_concentration_gpl"
    assert C.canonical("C2 (wt%)") == "c2_wt"


def test_chart_series_and_union(spark):
    df = spark.createDataFrame([("s", dt.date(2024, 1, 1), 1.0, 2.0)], "site string, date date, v1 double, v2 double")
    cs = sinks.chart_series(df, ["site"], "date", ["v1", "v2"], names={"v1": "Volume V1"})
    assert sorted((r["trace"], r["y"]) for r in cs.collect()) == [("Volume V1", 1.0), ("v2", 2.0)]
    u = sinks.labelled_union({"history": df.select("date", "v1"), "forecast": df.select("date", "v1")})
    assert sorted(r["trace"] for r in u.collect()) == ["forecast", "history"]


def test_records_descriptors_display(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1), 0.5, 0.301)], "date date, wl double, c2 double")
    rec = json.loads(sinks.records_json(df).first()["record"])
    assert rec == {"date": "2024-01-01", "wl": 0.5, "c2": 0.301}
    desc = sinks.column_descriptors(spark, df).collect()
    assert [(r["headerName"], r["field"]) for r in desc] == [("date", "date"), ("wl", "wl"), ("c2", "c2")]
    disp = sinks.to_display(df, "zone")
    assert disp.columns == ["Date", "Water Level (m)", "Final Concentration C2 (gpl)"]


def test_write_csv_partitioned(spark):
    out = tempfile.mkdtemp(prefix="pf-out-") + "/res"
    df = spark.createDataFrame([("A", "wt%", 1.0), ("B", "kg", 2.0)], "site string, unit string, v double")
    sinks.write_csv(df, out, partition_by=["site", "unit"])
    assert os.path.isdir(f"{out}/site=A/unit=wt%25") or os.path.isdir(f"{out}/site=A/unit=wt%")
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2


def test_result_label(spark):
    df = spark.createDataFrame([("a", None), ("b", "Khavda"), ("b", None)], "mode string, pond string")
    got = [r[0] for r in df.select(result_label("mode", "pond")).collect()]
    assert got == ["Prediction for Zone-B", "Prediction for Khavda", "Prediction"]
    got = [r[0] for r in df.select(result_label("mode", "pond", "Calculation")).collect()]
    assert got == ["Calculation for Zone-B", "Calculation for Khavda", ""]


def test_write_csv_sorted_per_site(spark):
    out = tempfile.mkdtemp(prefix="pf-out-") + "/sorted"
    rows = [("A", dt.date(2024, 1, d), float(d)) for d in (5, 1, 3)] + [("B", dt.date(2024, 2, d), float(d)) for d in (2, 1)]
    df = spark.createDataFrame(rows, "site string, date date, v double").repartition(3)
    sinks.write_csv(df, out, partition_by=["site"], sort_by=["site", "date"])
    for site, exp in (("A", ["2024-01-01", "2024-01-03", "2024-01-05"]), ("B", ["2024-02-01", "2024-02-02"])):
        files = sorted(f for f in os.listdir(f"{out}/site={site}") if f.endswith(".csv"))
        assert len(files) == 1                                # one task per site
        with open(f"{out}/site={site}/{files[0]}") as fh:
            lines = fh.read().splitlines()[1:]
        assert [ln.split(",")[0] for ln in lines] == exp      # O1: date order inside the file


def test_a_large_partition_value_is_written_in_order_by_several_tasks(spark):
    out = tempfile.mkdtemp(prefix="pf-out-") + "/ranges"
    df = spark.range(2000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("site"),
                                  F.date_format(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7919 % 2000).cast("int")), "dd-MM-yyyy").alias("Date"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        sinks.write_csv(df, out, partition_by=["site"], sort_by=[F.to_date("Date", "dd-MM-yyyy")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(f for f in os.listdir(f"{out}/site=large") if f.endswith(".csv"))
    dates = []
    for f in files:
        with open(f"{out}/site=large/{f}") as fh:
            dates += [dt.datetime.strptime(x, "%d-%m-%Y") for x in fh.read().split()[1:]]
    assert len(files) > 1 and len(dates) == 1800 and dates == sorted(dates)


def test_documented_cluster_workflow_end_to_end(spark):
    """The README example on local files: per-site folders, reference date dialects."""
    from pondflow.plans import balance
    d = tempfile.mkdtemp(prefix="pf-flow-")
    _write(f"{d}/wl/site=A/part.csv", "Date,Wl\n01-08-2025,2.8807013\n02-08-2025,2.8928807\n03-08-2025,3.0343904\n")
    _write(f"{d}/ev/site=A/part.csv", "Date,Evaporation\n01-08-2025,8.277748\n02-08-2025,8.060364\n03-08-2025,7.9807916\n")
    # site B reports hourly in the "dd-MM-yyyy H.MM" dialect
    hours = "".join(f"01-08-2025 {h}.00,{0.5}\n" for h in range(24)) + "02-08-2025 0.00,0.5\n"
    _write(f"{d}/ev/site=B/part.csv", "Date,Evaporation\n" + hours)
    _write(f"{d}/wl/site=B/part.csv", "Date,Wl\n" + "".join(f"01-08-2025 {h}.00,1.0\n" for h in range(24)))
    wl = C.read_readings(spark, f"{d}/wl/site=*/*.csv", {"Wl": "wl"}, site_from_path=r"site=([^/]+)")
    ev = C.read_readings(spark, f"{d}/ev/site=*/*.csv", {"Evaporation": "evaporation"}, site_from_path=r"site=([^/]+)")
    out = balance.zone_balance_from_readings(ev, wl, in_con=0.3)
    sinks.write_parquet(out, f"{d}/out", partition_by=["site"])
    got = {(r["site"], r["date"]): r for r in spark.read.parquet(f"{d}/out").collect()}
    a1 = got[("A", dt.date(2025, 8, 1))]
    assert (a1["c1"], a1["c2"], a1["quantity_t"]) == (0.3, 0.301, 204821.728)   # golden zone row
    b1 = got[("B", dt.date(2025, 8, 1))]
    assert b1["evaporation"] == pytest.approx(12.0) and b1["wl"] == pytest.approx(1.0)   # hourly: sum / mean


def test_read_readings_infers_canonical_names(spark):
    d = tempfile.mkdtemp(prefix="pf-csv-")
    _write(f"{d}/x.csv", "Date,C2 (wt%),Final_Concentration_(gpl),\n01-01-2025,26.4,0.3,\n02-01-2025,bad,0.31,\n")
    df = C.read_readings(spark, f"{d}/x.csv", hourly=False, site="s")
    assert df.columns == ["site", "date", "c2_wt", "final_concentration_gpl"]    # blank header dropped
    rows = sorted(df.collect(), key=lambda r: r["date"])
    assert rows[0]["c2_wt"] == 26.4 and rows[1]["c2_wt"] is None                  # bad text -> NULL (F23)
