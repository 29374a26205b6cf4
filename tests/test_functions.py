"""L1/L2: scalar column functions (dates, physics, rounding)."""

import datetime as dt
import math

import pytest

from pondflow.functions import dates as fd
from pondflow.functions import numeric as nm
from pondflow.functions import physics as ph


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_fix_date_format_cases(spark):
    rows = [("01-06-2023 0.00",), ("01-06-2023 5.30",), ("01-06-2023 14.59",), ("01-06-2023",),
            ("2023-06-01 05:30:00",), ("01-06-2023 x.00",), (None,)]
    got = one(spark, fd.fix_date_format("s"), rows, "s string")
    assert got == ["01-06-2023 00:00", "01-06-2023 05:00", "01-06-2023 14:00", "01-06-2023",
                   "2023-06-01 05:30:00", "01-06-2023 x.00", None]


def test_parse_hourly_strict(spark):
    got = one(spark, fd.parse_hourly("s"), [("01-06-2023 05:00",), ("2023-06-01",), ("bad",)], "s string")
    assert got == [dt.datetime(2023, 6, 1, 5, 0), None, None]


def test_parse_date_dialects(spark):
    got = one(spark, fd.parse_date("s"), [("02-01-2025",), ("2025-01-02",), ("x",), (None,)], "s string")
    assert got == [dt.date(2025, 1, 2), dt.date(2025, 1, 2), None, None]


def test_month_range_and_horizon(spark):
    df = spark.createDataFrame([("2025-01", "2025-11"), ("2024-02", "2024-02")], "a string, b string")
    r = df.select(fd.month_start("a").alias("s"), fd.month_end("b").alias("e")).collect()
    assert r[0]["s"] == dt.date(2025, 1, 1) and r[0]["e"] == dt.date(2025, 11, 30)
    assert r[1]["e"] == dt.date(2024, 2, 29)
    n = df.select(fd.horizon_days(fd.month_start("a"), fd.month_end("b"))).collect()
    assert [x[0] for x in n] == [334, 29]


def test_calendar_golden(spark):
    # golden rows of the reference's water-level output (Day, Month, Year, Month_sin, Month_cos)
    df = spark.createDataFrame([(dt.date(2025, 1, 1),), (dt.date(2025, 2, 28),), (dt.date(2025, 3, 1),)], "date date")
    r = df.select(*[c.alias(k) for k, c in fd.calendar_columns("date").items()]).collect()
    assert (r[0]["day"], r[0]["month"], r[0]["year"]) == (1, 1, 2025)
    assert r[0]["month_sin"] == pytest.approx(0.49999999999999994, abs=1e-15)
    assert r[0]["month_cos"] == pytest.approx(0.8660254037844387, abs=1e-15)
    assert r[1]["month_sin"] == pytest.approx(0.8660254037844386, abs=1e-15)
    assert r[2]["month_cos"] == pytest.approx(6.123233995736766e-17, abs=1e-15)
    assert r[1]["dayofyear"] == 59
    assert r[1]["dayofyear_sin"] == pytest.approx(math.sin(2 * math.pi * 59 / 365), abs=1e-15)


def test_zone_geometry_both_branches(spark):
    # golden rows of the reference (wl, volume, surface area), both geometry branches
    rows = [(-0.01, 34.74824717, 36.18876741), (0.05, 36.99684872, 38.98306299),
            (0.77, 127.7203, 263.99), (0.62, 88.1218, 263.99)]
    df = spark.createDataFrame(rows, "wl double, v double, a double")
    for r in df.select("v", "a", ph.zone_volume("wl").alias("vv"), ph.zone_area("wl").alias("aa")).collect():
        assert r["vv"] == pytest.approx(r["v"], abs=1e-8)
        assert r["aa"] == pytest.approx(r["a"], abs=1e-8)


def test_cubic_legacy_surface_is_as_written(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "wl double")
    r = df.select(ph.cubic_volume("wl"), ph.cubic_surface("wl")).collect()
    A, B, C, D = ph.CUBIC_A, ph.CUBIC_B, ph.CUBIC_C, ph.CUBIC_D
    assert r[1][0] == pytest.approx(A * 8 + B * 4 + C * 2 + D)
    assert r[1][1] == pytest.approx(3 * A * 2 + 2 * B * 2 + C)


def test_penman_golden(spark):
    # evaporation_prediction_output rows: Evaporation, Slope, gamma, Er, Ea (float32 data)
    rows = [(5.1888947, 142.67696, 66.440704, 5.6032286, 4.2991405),
            (5.137478, 141.54047, 66.43631, 5.6181426, 4.113436)]
    df = spark.createDataFrame(rows, "e double, d double, g double, er double, ea double")
    for r in df.select("e", ph.penman("d", "g", "er", "ea").alias("p")).collect():
        assert r["p"] == pytest.approx(r["e"], abs=1.5e-5)


def test_aerodynamic_base(spark):
    df = spark.createDataFrame([(3.0, 2.5, 1.0)], "u double, es double, ea double")
    got = df.select(ph.aerodynamic_base("u", "es", "ea")).first()[0]
    assert got == pytest.approx(0.102 * 3.0 / math.log(200 / 0.04) ** 2 * 1.5)


def test_rounding_modes(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (0.0003125,), (-2.5,)], "x double")
    r = df.select(nm.round_even("x", 0), nm.round_half_away("x", 0), nm.round_half_away("x", 6)).collect()
    assert [x[0] for x in r] == [2.0, 4.0, 0.0, -2.0]
    assert [x[1] for x in r] == [3.0, 4.0, 0.0, -3.0]
    assert r[2][2] == 0.000313


def test_minmax_constant_column_and_inverse(spark):
    df = spark.createDataFrame([(5.0, 5.0, 5.0), (7.0, 2.0, 12.0)], "x double, lo double, hi double")
    r = df.select(nm.minmax_transform("x", "lo", "hi").alias("t")).collect()
    assert r[0]["t"] == 0.0          # constant column: x - min (range 1), as sklearn
    assert r[1]["t"] == pytest.approx(0.5)
    back = df.select(nm.minmax_inverse(nm.minmax_transform("x", "lo", "hi"), "lo", "hi")).collect()
    assert [b[0] for b in back] == pytest.approx([5.0, 7.0])


def test_to_number(spark):
    got = one(spark, fd.to_number("s"), [("0.3",), (" 26.3 ",), ("abc",)], "s string")
    assert got == [0.3, 26.3, None]


def test_safe_div_like_numpy(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 2.0)], "a double, b double")
    r = [x[0] for x in df.select(nm.safe_div("a", "b")).collect()]
    assert r[0] == math.inf and r[1] == -math.inf and math.isnan(r[2]) and r[3] == 0.5
