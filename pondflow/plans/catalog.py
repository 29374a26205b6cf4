"""Driver catalog: every registered query as a Spark plan plus its DuckDB oracle.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame that reads
the driver tables (whole tables, no sampling), so its work grows with them.
The oracle SQL restates the same query over the same tables. Floating
results are rounded on both sides (6 digits unless the reference rounds
itself) because the check compares value hashes; ``zero_safe`` maps -0.0 to
+0.0 in the SQL. ``QUERY_IDS`` (end of file) lists the SURVEY §2 operators
each query exercises.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.functions import dates as fd
from pondflow.functions import physics as ph
from pondflow.functions.numeric import round_half_away
from pondflow.operators import filters as flt
from pondflow.operators import lookup as lk
from pondflow.operators import series as sr
from pondflow.operators import stats as st
from pondflow.operators import windows as wn
from pondflow.plans import balance as bal
from pondflow.plans import sqlgen as q
from pondflow.sources import sinks
from pondflow.sources import tables as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


_ROUND_CALL = re.compile(r"\b(round_even|round)\(")


def zero_safe(sql: str) -> str:
    """Wrap every ``round(...)``/``round_even(...)`` of the oracle SQL as ``(... + 0.0)``.

    DuckDB's rounding can return -0.0 (e.g. ``round(cos(3*pi/2), 6)``) where
    Spark's returns +0.0; adding +0.0 maps -0.0 to +0.0 and leaves every other
    value unchanged, so value hashes compare equal.
    """
    out, i = [], 0
    while True:
        m = _ROUND_CALL.search(sql, i)
        if not m:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:m.start()])
        depth, j = 0, m.end() - 1
        while True:
            if sql[j] == "(":
                depth += 1
            elif sql[j] == ")":
                depth -= 1
                if depth == 0:
                    break
            j += 1
        inner = sql[m.end():j]
        out.append(f"({m.group(1)}({zero_safe(inner)}) + 0.0)")
        i = j + 1


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = zero_safe(sql)
        return fn
    return deco


def r(df: DataFrame, digits: int = 6, cols=None) -> DataFrame:
    """Round the given (default: all double) columns for hash comparison."""
    cols = cols or [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: round_half_away(F.col(c), digits) + F.lit(0.0) for c in cols})


def _bigint(df: DataFrame, cols) -> DataFrame:
    """Integer calendar parts as BIGINT (the oracle engine's integer width)."""
    return df.withColumns({c: F.col(c).cast("bigint") for c in cols})


IN_CON_ZONE = 0.3
IN_CON_POND = 0.3
IN_CON_CONST = 26.3
IN_CON_CONST_CHAINED = 175.0
D = q.d

# ---------------------------------------------------------------------------
# Q3 / Q7 / Q8: zone balances
# ---------------------------------------------------------------------------

_ZONE_JOIN = T.with_sql("zone_wl", "zone_evap") + """,
j AS (SELECT w.site, w.date, w.wl, e.evaporation FROM zone_wl w JOIN zone_evap e USING (site, date)
      WHERE w.wl IS NOT NULL AND e.evaporation IS NOT NULL AND NOT isnan(w.wl) AND NOT isnan(e.evaporation))"""


def zone_balance_chained(spark, sf):
    df = bal.zone_balance_frame(T.zone_inputs(spark, sf), IN_CON_ZONE)
    return r(df, 6, ["volume_v1_m3", "evap_volume", "surface_area", "volume_v2_m3"])


ZONE_CHAINED_SQL = _ZONE_JOIN + f""",
g AS (SELECT *, {q.zone_volume()} AS volume, {q.zone_area()} AS surface_area FROM j),
h AS (SELECT *, evaporation * surface_area / {D(1000)} AS evap_volume FROM g),
i AS (SELECT *, volume - evap_volume AS v2 FROM h),
c AS (SELECT *, {q.running('product', 'volume / v2')} AS p,
             COALESCE({q.running('product', 'volume / v2', exclusive=True)}, {D(1)}) AS pe FROM i)
SELECT site, date, wl, evaporation,
       round(volume * {D(1e6)}, 6) AS volume_v1_m3, round(evap_volume, 6) AS evap_volume,
       round(surface_area, 6) AS surface_area, round(v2 * {D(1e6)}, 6) AS volume_v2_m3,
       round_even({D(IN_CON_ZONE)} * pe, 3) AS c1, round_even({D(IN_CON_ZONE)} * p, 3) AS c2,
       round_even(v2 * {D(1e6)} * {D(IN_CON_ZONE)} / {D(1000)}, 3) AS quantity_t
FROM c"""
register("zone_balance_chained", ZONE_CHAINED_SQL)(zone_balance_chained)


def zone_balance_two_frames(spark, sf):
    """Q3 as users call it: water level and evaporation as two frames, joined on site and date."""
    df = bal.zone_balance(T.zone_wl(spark, sf), T.zone_evap(spark, sf), IN_CON_ZONE)
    return r(df, 6, ["volume_v1_m3", "evap_volume", "surface_area", "volume_v2_m3"])


register("zone_balance_two_frames", ZONE_CHAINED_SQL)(zone_balance_two_frames)


def display_names_q(spark, sf):
    """P1 + P2: the zone balance as an ordered projection under its display names."""
    return sinks.to_display(zone_balance_chained(spark, sf), "zone", keep_keys=["site"])


register("display_names", "SELECT site, " + ", ".join(f'{c} AS "{n}"' for c, n in sinks.DISPLAY_NAMES["zone"].items())
         + f" FROM ({ZONE_CHAINED_SQL})")(display_names_q)


def zone_balance_stateless(spark, sf):
    return r(bal.zone_balance_frame(T.zone_inputs(spark, sf), IN_CON_ZONE, chained=False))


register("zone_balance_stateless", _ZONE_JOIN + f""",
g AS (SELECT *, {q.zone_volume()} AS volume, {q.zone_area()} AS surface_area FROM j),
h AS (SELECT *, evaporation * surface_area / {D(1000)} AS evap_volume FROM g),
i AS (SELECT *, volume - evap_volume AS v2 FROM h)
SELECT site, date, round(wl, 6) AS wl, round(evaporation, 6) AS evaporation, round(volume, 6) AS volume,
       round(v2, 6) AS v2, round(surface_area, 6) AS surface_area, round(evap_volume, 6) AS evap_volume,
       round(volume * {D(IN_CON_ZONE)} / v2, 6) AS c2
FROM i""")(zone_balance_stateless)


def zone_balance_cubic_wt(spark, sf):
    return r(bal.zone_balance_frame(T.zone_inputs(spark, sf), IN_CON_ZONE, geometry="cubic", unit="wt%"))


register("zone_balance_cubic_wt", _ZONE_JOIN + f""",
g AS (SELECT *, {q.cubic_volume()} AS volume, {q.cubic_surface()} AS surface_area FROM j),
h AS (SELECT *, evaporation * surface_area / {D(1000)} AS evap_volume FROM g)
SELECT site, date, round(wl, 6) AS wl, round(evaporation, 6) AS evaporation, round(volume, 6) AS volume,
       round(surface_area, 6) AS surface_area, round(evap_volume, 6) AS evap_volume,
       round(volume * {D(IN_CON_ZONE)} / (volume - evap_volume), 6) AS c2
FROM h""")(zone_balance_cubic_wt)


def zone_balance_cubic_kg(spark, sf):
    return r(bal.zone_balance_frame(T.zone_inputs(spark, sf), IN_CON_ZONE, geometry="cubic", unit="kg"))


register("zone_balance_cubic_kg", _ZONE_JOIN + f""",
g AS (SELECT *, {q.cubic_volume()} AS volume, {q.cubic_surface()} AS surface_area FROM j),
h AS (SELECT *, evaporation * surface_area AS water_evaporated FROM g)
SELECT site, date, round(wl, 6) AS wl, round(evaporation, 6) AS evaporation, round(volume, 6) AS volume,
       round(surface_area, 6) AS surface_area, round(water_evaporated, 6) AS water_evaporated,
       round({D(IN_CON_ZONE / (100 - IN_CON_ZONE))} * water_evaporated, 6) AS c2
FROM h""")(zone_balance_cubic_kg)

# ---------------------------------------------------------------------------
# Q4 / Q9: pond balances
# ---------------------------------------------------------------------------

POND_AREA_SQL = f"CASE WHEN site LIKE '1%' THEN {D(ph.POND_AREA_DHORDO)} ELSE {D(ph.POND_AREA_OTHER)} END"


def _pond_area():
    return F.when(F.col("site").startswith("1"), F.lit(ph.POND_AREA_DHORDO)).otherwise(F.lit(ph.POND_AREA_OTHER))


def pond_balance_chained(spark, sf):
    df = bal.pond_balance_frame(T.pond_inputs(spark, sf), IN_CON_POND, area=_pond_area())
    return r(df, 6, ["cum_net_flow", "evaporation"])


register("pond_balance_chained", T.with_sql("pond_evap", "pond_in", "pond_out") + f""",
j AS (SELECT e.site, e.date, e.evaporation, i.brine_in, o.brine_out
      FROM pond_evap e JOIN pond_in i USING (site, date) JOIN pond_out o USING (site, date)
      WHERE e.evaporation IS NOT NULL AND i.brine_in IS NOT NULL AND o.brine_out IS NOT NULL
        AND NOT isnan(e.evaporation) AND NOT isnan(i.brine_in) AND NOT isnan(o.brine_out)),
f AS (SELECT *, {q.running('sum', 'brine_in - brine_out')} AS cum_net_flow, {POND_AREA_SQL} AS surface_area FROM j),
g AS (SELECT *, {D(ph.POND_BASE_DEPTH)} + cum_net_flow / surface_area AS depth FROM f),
h AS (SELECT *, surface_area * depth AS volume, surface_area * (evaporation / {D(1000)}) AS evap_loss FROM g),
i AS (SELECT *, volume - evap_loss AS v2 FROM h),
c AS (SELECT *, {q.running('product', 'volume / v2')} AS p,
             COALESCE({q.running('product', 'volume / v2', exclusive=True)}, {D(1)}) AS pe FROM i)
SELECT site, date, round(cum_net_flow, 6) AS cum_net_flow, round_even(depth, 6) AS water_level,
       round_even(volume, 2) AS volume_v1_m3, round(evaporation, 6) AS evaporation,
       round_even(evap_loss, 2) AS evap_volume, round_even(surface_area, 2) AS surface_area,
       round_even(v2, 2) AS volume_v2_m3, round_even({D(IN_CON_POND)} * pe, 3) AS c1,
       round_even({D(IN_CON_POND)} * p, 3) AS c2,
       round_even(v2 * {D(IN_CON_POND)} / {D(1000)}, 0) AS quantity_t
FROM c""")(pond_balance_chained)


def _pond_letter():
    """Pond letter A..G from the priority digit and month (G is not in the table -> default)."""
    idx = F.pmod(F.substring("site", 1, 1).try_cast("int") + F.month("date"), F.lit(7)) + 1
    return F.substring(F.lit("ABCDEFG"), idx, F.lit(1))


_POND_LETTER_SQL = "substr('ABCDEFG', CAST(((CAST(substr(site, 1, 1) AS INTEGER) + month(date)) % 7) + 1 AS INTEGER), 1)"


def pond_balance_constant(spark, sf):
    ev = T.pond_evap(spark, sf).withColumn("pond", _pond_letter())
    df = bal.pond_constant_balance(ev, "pond", IN_CON_CONST, volume_set="m3")
    return r(df, 6)


register("pond_balance_constant", T.with_sql("pond_evap") + f""",
p AS (SELECT site, date, evaporation, {_POND_LETTER_SQL} AS pond FROM pond_evap
      WHERE evaporation IS NOT NULL AND NOT isnan(evaporation)),
v AS (SELECT *, {q.pond_volume_case('pond', ph.POND_VOLUMES_M3, ph.POND_VOLUME_DEFAULT)} AS volume,
             {D(ph.POND_CONST_AREA)} AS surface_area FROM p),
h AS (SELECT *, evaporation * surface_area / {D(1000)} AS evap_volume FROM v)
SELECT site, date, round(evaporation, 6) AS evaporation, round(volume, 6) AS volume,
       round(volume - evap_volume, 6) AS v2, round(surface_area, 6) AS surface_area,
       round(evap_volume, 6) AS evap_volume,
       round(volume * {D(IN_CON_CONST)} / (volume - evap_volume), 6) AS c2
FROM h""")(pond_balance_constant)


def pond_balance_constant_chained(spark, sf):
    ev = T.pond_evap(spark, sf).withColumn("pond", _pond_letter())
    df = bal.pond_constant_balance(ev, "pond", IN_CON_CONST_CHAINED, volume_set="ml", chained=True)
    return r(df, 6)


register("pond_balance_constant_chained", T.with_sql("pond_evap") + f""",
p AS (SELECT site, date, evaporation, {_POND_LETTER_SQL} AS pond FROM pond_evap
      WHERE evaporation IS NOT NULL AND NOT isnan(evaporation)),
v AS (SELECT *, {q.pond_volume_case('pond', ph.POND_VOLUMES_ML, ph.POND_VOLUME_DEFAULT, 1000.0)} AS volume,
             {D(ph.POND_CONST_AREA)} AS surface_area FROM p),
h AS (SELECT *, evaporation * surface_area / {D(1000)} AS evap_volume FROM v),
i AS (SELECT *, volume - evap_volume AS v2 FROM h),
c AS (SELECT *, {q.running('product', 'volume / v2')} AS pr,
             COALESCE({q.running('product', 'volume / v2', exclusive=True)}, {D(1)}) AS pe FROM i)
SELECT site, date, round(evaporation, 6) AS evaporation, round(volume, 6) AS volume, round(v2, 6) AS v2,
       round(surface_area, 6) AS surface_area, round(evap_volume, 6) AS evap_volume,
       round({D(IN_CON_CONST_CHAINED)} * pe, 6) AS c1, round({D(IN_CON_CONST_CHAINED)} * pr, 6) AS c2
FROM c""")(pond_balance_constant_chained)


def running_sum_q(spark, sf):
    from pondflow.operators.scan import running_sum
    j = T.pond_inputs(spark, sf).drop("evaporation")
    j = j.withColumn("net_flow", F.col("brine_in") - F.col("brine_out"))
    return r(running_sum(j, ["site"], "net_flow", "cum_net_flow"), 6)


register("running_sum", T.with_sql("pond_in", "pond_out") + f"""
SELECT site, date, round(brine_in, 6) AS brine_in, round(brine_out, 6) AS brine_out,
       round(brine_in - brine_out, 6) AS net_flow,
       round({q.running('sum', 'brine_in - brine_out')}, 6) AS cum_net_flow
FROM pond_in JOIN pond_out USING (site, date)""")(running_sum_q)

# ---------------------------------------------------------------------------
# Frequency, resampling, spines, interpolation
# ---------------------------------------------------------------------------


def detect_frequency_q(spark, sf):
    a = sr.detect_frequency(T.ev_readings(spark, sf), ["site"], "ts")
    b = sr.detect_frequency(T.user_readings(spark, sf), ["site"], "ts")
    return r(a.unionByName(b), 6)


register("detect_frequency", T.with_sql("ev_readings", "user_readings") + """,
u AS (SELECT * FROM ev_readings UNION ALL SELECT * FROM user_readings),
a AS (SELECT site, count(ts) AS n, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi
      FROM u GROUP BY site),
g AS (SELECT site, n, CASE WHEN n >= 2 THEN ((hi - lo) / 1e6) / (n - 1) END AS avg_gap_s FROM a)
SELECT site, n, round(avg_gap_s, 6) AS avg_gap_s,
       CASE WHEN avg_gap_s <= 3600.0 THEN 'hourly' WHEN avg_gap_s <= 86400.0 THEN 'daily'
            ELSE 'monthly' END AS freq
FROM g""")(detect_frequency_q)


def _resample_sql(src: str, how: str, value: str = "value") -> str:
    agg = f"COALESCE(sum({value}), 0.0)" if how == "sum" else f"avg({value})"
    return T.with_sql(src) + f""",
b AS (SELECT site, CAST(ts AS DATE) AS date, {value} FROM {src} WHERE ts IS NOT NULL),
sp AS (SELECT site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
       FROM b GROUP BY site),
u AS (SELECT site, date, {value} FROM b UNION ALL SELECT site, date, NULL FROM sp)
SELECT site, date, round({agg}, 6) AS {value} FROM u GROUP BY site, date"""


register("resample_daily_sum", _resample_sql("user_readings", "sum"))(
    lambda spark, sf: r(sr.resample(T.user_readings(spark, sf), ["site"], "ts", ["value"], "D", "sum")))
register("resample_daily_mean", _resample_sql("user_readings", "mean"))(
    lambda spark, sf: r(sr.resample(T.user_readings(spark, sf), ["site"], "ts", ["value"], "D", "mean")))
register("resample_hourly_to_daily", _resample_sql("ev_hourly", "sum"))(
    lambda spark, sf: r(sr.resample(T.ev_hourly(spark, sf), ["site"], "ts", ["value"], "D", "sum")))


def resample_monthly_mean_q(spark, sf):
    li = T.table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site"),
        F.col("l_shipdate").alias("ts"), F.col("l_quantity").alias("value"))
    return r(sr.resample(li, ["site"], "ts", ["value"], "M", "mean"))


register("resample_monthly_mean", """
WITH b AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS site, last_day(CAST(l_shipdate AS DATE)) AS date,
                  l_quantity AS value FROM lineitem WHERE l_shipdate IS NOT NULL),
sp AS (SELECT site, last_day(unnest(generate_series(date_trunc('month', min(date)), date_trunc('month', max(date)),
                                                     INTERVAL 1 MONTH))::DATE) AS date
       FROM b GROUP BY site),
u AS (SELECT site, date, value FROM b UNION ALL SELECT site, date, NULL FROM sp)
SELECT site, date, round(avg(value), 6) AS value FROM u GROUP BY site, date""")(resample_monthly_mean_q)


def asfreq_daily_q(spark, sf):
    return r(sr.asfreq_daily(T.user_daily(spark, sf), ["site"]))


_USER_SPINE = T.with_sql("user_daily") + """,
sp AS (SELECT site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
       FROM user_daily GROUP BY site),
a AS (SELECT sp.site, sp.date, user_daily.v FROM sp LEFT JOIN user_daily USING (site, date))"""

register("asfreq_daily", _USER_SPINE + "\nSELECT site, date, round(v, 6) AS v FROM a")(asfreq_daily_q)


def interpolate_gaps_q(spark, sf):
    a = sr.asfreq_daily(T.user_daily(spark, sf), ["site"])
    return r(sr.interpolate_time(a, ["site"], ["v"]))


register("interpolate_gaps", _USER_SPINE + """,
b AS (SELECT site, date, v,
        last_value(v IGNORE NULLS) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v0,
        last_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS d0,
        first_value(v IGNORE NULLS) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS v1,
        first_value(CASE WHEN v IS NOT NULL THEN date END IGNORE NULLS) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS d1
      FROM a)
SELECT site, date, round(CASE WHEN v IS NOT NULL THEN v WHEN v0 IS NULL THEN NULL WHEN v1 IS NULL THEN v0
       ELSE (v1 - v0) / CAST(date_diff('day', d0, d1) AS DOUBLE) * CAST(date_diff('day', d0, date) AS DOUBLE) + v0 END, 6) AS v
FROM b""")(interpolate_gaps_q)



def interpolate_gaps_segmented_q(spark, sf):
    a = sr.asfreq_daily(T.user_daily(spark, sf), ["site"])
    return r(sr.interpolate_time(a, ["site"], ["v"], segment=F.trunc("date", "month")))


register("interpolate_gaps_segmented", ORACLE["interpolate_gaps"])(interpolate_gaps_segmented_q)

# ---------------------------------------------------------------------------
# Window features on a long daily series
# ---------------------------------------------------------------------------

_W = "OVER (PARTITION BY site ORDER BY date ROWS BETWEEN {lo} PRECEDING AND CURRENT ROW)"


def rolling_stats_q(spark, sf):
    return r(wn.rolling_stats(T.line_daily(spark, sf), ["site"], "v", (14, 30, 60)))


def _rolling_sql():
    cols = []
    for w in (14, 30, 60):
        o = _W.format(lo=w - 1)
        cols.append(f"round(CASE WHEN count(v) {o} = {w} THEN avg(v) {o} END, 6) AS v_rolling_mean_{w}")
        cols.append(f"round(CASE WHEN count(v) {o} = {w} THEN stddev_samp(v) {o} END, 6) AS v_rolling_std_{w}")
    return T.with_sql("line_daily") + f"SELECT site, date, round(v, 6) AS v, {', '.join(cols)} FROM line_daily"


register("rolling_stats", _rolling_sql())(rolling_stats_q)

register("expanding_stats", T.with_sql("line_daily") + """
SELECT site, date, round(v, 6) AS v,
       round(avg(v) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v_cumulative_mean,
       round(stddev_samp(v) OVER (PARTITION BY site ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS v_cumulative_std
FROM line_daily""")(lambda spark, sf: r(wn.expanding_stats(T.line_daily(spark, sf), ["site"], "v")))

N_LAGS = 120

register("lag_features", T.with_sql("line_daily") + "SELECT site, date, round(v, 6) AS v, " + ", ".join(
    f"round(lag(v, {i}) OVER (PARTITION BY site ORDER BY date), 6) AS lag_{i}" for i in range(1, N_LAGS + 1))
    + " FROM line_daily")(lambda spark, sf: r(wn.lag_features(T.line_daily(spark, sf), ["site"], "v", N_LAGS)))

# the same features with every series cut in years: one series is many tasks' work
for _name, _of in (("rolling_stats", lambda df: wn.rolling_stats(df, ["site"], "v", (14, 30, 60), segment=F.year("date"))),
                   ("expanding_stats", lambda df: wn.expanding_stats(df, ["site"], "v", segment=F.year("date"))),
                   ("lag_features", lambda df: wn.lag_features(df, ["site"], "v", N_LAGS, segment=F.year("date")))):
    register(f"{_name}_segmented", ORACLE[_name])(lambda spark, sf, of=_of: r(of(T.line_daily(spark, sf))))

register("trend_index", T.with_sql("line_daily") + """
SELECT site, date, round(v, 6) AS v, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS trend,
       round(v - lag(v) OVER (PARTITION BY site ORDER BY date), 6) AS v_diff
FROM line_daily""")(lambda spark, sf: r(wn.diff_prev(wn.trend_index(T.line_daily(spark, sf), ["site"]), ["site"], "v")
                                        .withColumn("trend", F.col("trend").cast("bigint"))))

register("last_n_rows", T.with_sql("line_daily") + """
SELECT site, date, round(v, 6) AS v FROM line_daily
QUALIFY row_number() OVER (PARTITION BY site ORDER BY date DESC) <= 120""")(
    lambda spark, sf: r(wn.last_n_rows(T.line_daily(spark, sf), ["site"], 120)))

register("last_row", T.with_sql("zone_wl") + """
SELECT site, max(date) AS date, round(arg_max(wl, date), 6) AS wl FROM zone_wl GROUP BY site""")(
    lambda spark, sf: r(wn.last_row(T.zone_wl(spark, sf), ["site"])))

# ---------------------------------------------------------------------------
# Dates and ranges
# ---------------------------------------------------------------------------


def calendar_features_q(spark, sf):
    d = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date")).distinct()
    return r(_bigint(d.withColumns(fd.calendar_columns("date")), ["day", "month", "year", "dayofyear"]), 6)


register("calendar_features", f"""
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders)
SELECT date, day(date) AS day, month(date) AS month, year(date) AS year,
       round(sin({D(fd.TWO_PI)} * month(date) / {D(12)}), 6) AS month_sin,
       round(cos({D(fd.TWO_PI)} * month(date) / {D(12)}), 6) AS month_cos,
       dayofyear(date) AS dayofyear,
       round(sin({D(fd.TWO_PI)} * dayofyear(date) / {D(365)}), 6) AS dayofyear_sin,
       round(cos({D(fd.TWO_PI)} * dayofyear(date) / {D(365)}), 6) AS dayofyear_cos
FROM d""")(calendar_features_q)


def _raw_stamp():
    """Hourly strings in the reference's ``dd-MM-yyyy H.MM`` dialect; errors get a date-only string."""
    base = F.date_format("ts", "dd-MM-yyyy")
    stamp = F.concat(base, F.lit(" "), F.hour("ts").cast("string"), F.lit("."),
                     F.lpad(F.minute("ts").cast("string"), 2, "0"))
    return F.when(F.col("event_type") == "error", base).otherwise(stamp)


def fix_dates_q(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "event_type", "ts").withColumn("raw", _raw_stamp())
    return (e.withColumn("fixed", fd.fix_date_format("raw"))
            .withColumn("parsed", fd.parse_hourly("fixed"))
            .select("event_id", "raw", "fixed", "parsed"))


register("fix_dates", """
WITH e AS (SELECT event_id, CASE WHEN event_type = 'error' THEN strftime(ts, '%d-%m-%Y')
                  ELSE strftime(ts, '%d-%m-%Y') || ' ' || CAST(hour(ts) AS VARCHAR) || '.' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') END AS raw
           FROM events),
p AS (SELECT event_id, raw, string_split_regex(raw, '[.\\s]') AS parts FROM e),
h AS (SELECT *, TRY_CAST(TRY_CAST(parts[2] AS DOUBLE) AS BIGINT) AS hr FROM p),
f AS (SELECT event_id, raw, CASE WHEN len(parts) >= 2 AND hr IS NOT NULL
             THEN parts[1] || ' ' || printf('%02d', hr) || ':00' ELSE raw END AS fixed FROM h)
SELECT event_id, raw, fixed, try_strptime(fixed, '%d-%m-%Y %H:%M') AS parsed FROM f""")(fix_dates_q)


def parse_dates_q(spark, sf):
    e = T.table(spark, sf, "events").select("event_id", "event_type", "ts")
    raw = F.when(F.col("event_type").isin("click", "view"), F.date_format("ts", "dd-MM-yyyy")).otherwise(
        F.date_format("ts", "yyyy-MM-dd"))
    e = e.withColumn("raw", raw)
    return e.select("event_id", "raw", fd.parse_date("raw").alias("date"))


register("parse_dates", """
WITH e AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN strftime(ts, '%d-%m-%Y')
                                  ELSE strftime(ts, '%Y-%m-%d') END AS raw FROM events)
SELECT event_id, raw, CAST(COALESCE(try_strptime(raw, '%d-%m-%Y'), try_strptime(raw, '%Y-%m-%d')) AS DATE) AS date
FROM e""")(parse_dates_q)

register("month_range_filter", T.with_sql("pond_in") + """
SELECT site, date, round(brine_in, 6) AS brine_in FROM pond_in
WHERE date BETWEEN DATE '1996-03-01' AND last_day(DATE '1997-08-01')""")(
    lambda spark, sf: r(flt.month_range(T.pond_in(spark, sf), "1996-03", "1997-08")))


def _supp_daily(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return (li.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("site"),
                      F.to_date("l_shipdate").alias("date"), "l_quantity")
            .groupBy("site", "date").agg(F.sum("l_quantity").alias("v")))


_SUPP_DAILY_SQL = """supp_daily AS (SELECT 's' || CAST(l_suppkey AS VARCHAR) AS site, CAST(l_shipdate AS DATE) AS date,
                      sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"""

register("range_filter_fallback", f"""
WITH {_SUPP_DAILY_SQL},
f AS (SELECT *, date BETWEEN DATE '1998-12-01' AND DATE '1998-12-31' AS in_r FROM supp_daily),
h AS (SELECT site, max(CAST(in_r AS INTEGER)) AS hit FROM f GROUP BY site)
SELECT site, date, round(v, 6) AS v FROM f JOIN h USING (site) WHERE in_r OR hit = 0""")(
    lambda spark, sf: r(flt.month_range_with_fallback(_supp_daily(spark, sf), ["site"], "1998-12", "1998-12")))


def future_spine_q(spark, sf):
    sp = sr.range_spine(T.pond_in(spark, sf), ["site"], "2025-01-01", "2025-11-30")
    return _bigint(sp.withColumns(fd.calendar_columns("date", day_of_year=False)), ["day", "month", "year"]).transform(r)


register("future_spine", T.with_sql("pond_in") + f""",
s AS (SELECT DISTINCT site FROM pond_in),
sp AS (SELECT site, unnest(generate_series(DATE '2025-01-01', DATE '2025-11-30', INTERVAL 1 DAY))::DATE AS date FROM s)
SELECT site, date, day(date) AS day, month(date) AS month, year(date) AS year,
       round(sin({D(fd.TWO_PI)} * month(date) / {D(12)}), 6) AS month_sin,
       round(cos({D(fd.TWO_PI)} * month(date) / {D(12)}), 6) AS month_cos
FROM sp""")(future_spine_q)

register("future_spine_after_last", T.with_sql("zone_wl") + """,
m AS (SELECT site, max(date) AS last FROM zone_wl GROUP BY site)
SELECT site, unnest(generate_series(last + 1, last + 30, INTERVAL 1 DAY))::DATE AS date FROM m""")(
    lambda spark, sf: sr.spine_after_last(T.zone_wl(spark, sf), ["site"], 30))

# ---------------------------------------------------------------------------
# Statistics and scaling
# ---------------------------------------------------------------------------


def _price(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return li.select(F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("site"),
                     "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("y"))


_PRICE_SQL = """price AS (SELECT l_returnflag || l_linestatus AS site, l_orderkey, l_linenumber,
                        l_extendedprice AS y FROM lineitem)"""

register("quantiles", f"""
WITH {_PRICE_SQL}
SELECT site, round(quantile_cont(y, 0.01), 6) AS q0, round(quantile_cont(y, 0.5), 6) AS q1,
       round(quantile_cont(y, 0.99), 6) AS q2
FROM price WHERE y IS NOT NULL AND NOT isnan(y) GROUP BY site""")(
    lambda spark, sf: r(st.quantiles(_price(spark, sf), ["site"], "y", [0.01, 0.5, 0.99])))

_TRIM_SQL = f"""
WITH {_PRICE_SQL},
qq AS (SELECT site, quantile_cont(y, 0.01) AS plo, quantile_cont(y, 0.99) AS phi FROM price
       WHERE y IS NOT NULL AND NOT isnan(y) GROUP BY site),
t AS (SELECT p.* FROM price p JOIN qq USING (site) WHERE p.y > qq.plo AND p.y < qq.phi)"""

register("percentile_trim", _TRIM_SQL + "\nSELECT site, l_orderkey, l_linenumber, round(y, 6) AS y FROM t")(
    lambda spark, sf: r(st.percentile_trim(_price(spark, sf), ["site"], "y")))

register("robust_scale", _TRIM_SQL + """,
mm AS (SELECT site, min(y) AS lo, max(y) AS hi FROM t GROUP BY site)
SELECT site, l_orderkey, l_linenumber, round(y, 6) AS y,
       round((y - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 6) AS y_scaled
FROM price JOIN mm USING (site)""")(
    lambda spark, sf: r(flt.drop_columns(st.robust_scale(_price(spark, sf), ["site"], "y"), ["y_min", "y_max"])))


def minmax_scale_q(spark, sf):
    p = _price(spark, sf)
    stats = st.minmax_fit(p, ["site"], "y")
    return r(flt.drop_columns(st.minmax_apply(p, stats, ["site"], "y", out="y_scaled"), ["y_min", "y_max"]))


_MINMAX_SQL = f"""
WITH {_PRICE_SQL}, mm AS (SELECT site, min(y) AS lo, max(y) AS hi FROM price GROUP BY site),
s AS (SELECT site, l_orderkey, l_linenumber, y, lo, hi,
             (y - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END AS y_scaled FROM price JOIN mm USING (site))"""

register("minmax_scale", _MINMAX_SQL + """
SELECT site, l_orderkey, l_linenumber, round(y, 6) AS y, round(y_scaled, 6) AS y_scaled FROM s""")(minmax_scale_q)


def inverse_scale_q(spark, sf):
    p = _price(spark, sf)
    stats = st.minmax_fit(p, ["site"], "y")
    s = st.minmax_apply(p, stats, ["site"], "y", out="y_scaled")
    from pondflow.functions.numeric import minmax_inverse
    s = s.withColumn("y_back", minmax_inverse("y_scaled", "y_min", "y_max"))
    return r(s.select("site", "l_orderkey", "l_linenumber", "y", "y_back"))


register("inverse_scale", _MINMAX_SQL + """
SELECT site, l_orderkey, l_linenumber, round(y, 6) AS y,
       round(y_scaled * CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END + lo, 6) AS y_back FROM s""")(inverse_scale_q)

_FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

register("feature_ranges", """
WITH u AS (UNPIVOT (SELECT l_returnflag AS site, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)
           ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value)
SELECT site, feature, round(min(value), 6) AS min, round(max(value), 6) AS max FROM u GROUP BY site, feature""")(
    lambda spark, sf: r(st.feature_ranges(
        T.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("site"), *_FEATS), ["site"], _FEATS)))


def out_of_range_q(spark, sf):
    d = T.table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("date"))
    cal = d.withColumns(fd.calendar_columns("date", day_of_year=False))
    feats = ["day", "month", "year", "month_sin", "month_cos"]
    trained = st.feature_ranges(cal.where(F.col("date") <= F.lit("1996-12-31").cast("date")), [], feats)
    inputs = cal.where(F.col("date") > F.lit("1996-12-31").cast("date"))
    return r(st.out_of_range(inputs, trained, feats))


register("out_of_range", f"""
WITH c AS (SELECT CAST(o_orderdate AS DATE) AS date FROM orders),
f AS (SELECT date, CAST(day(date) AS DOUBLE) AS day, CAST(month(date) AS DOUBLE) AS month,
             CAST(year(date) AS DOUBLE) AS year,
             sin({D(fd.TWO_PI)} * month(date) / {D(12)}) AS month_sin,
             cos({D(fd.TWO_PI)} * month(date) / {D(12)}) AS month_cos FROM c),
u AS (UNPIVOT f ON day, month, year, month_sin, month_cos INTO NAME feature VALUE value),
tr AS (SELECT feature, min(value) AS tr_min, max(value) AS tr_max FROM u WHERE date <= DATE '1996-12-31' GROUP BY feature),
cu AS (SELECT feature, min(value) AS in_min, max(value) AS in_max FROM u WHERE date > DATE '1996-12-31' GROUP BY feature)
SELECT feature, round(in_min, 6) AS in_min, round(in_max, 6) AS in_max, round(tr_min, 6) AS tr_min,
       round(tr_max, 6) AS tr_max, (in_min < tr_min) OR (in_max > tr_max) AS violated
FROM cu LEFT JOIN tr USING (feature)""")(out_of_range_q)


def _aero(spark, sf):
    li = T.table(spark, sf, "lineitem")
    return li.select(F.col("l_returnflag").alias("site"),
                     ph.aerodynamic_base(F.col("l_quantity") / 10.0, F.col("l_extendedprice") / 10000.0,
                                         F.col("l_discount") * 10.0).alias("ea_base"),
                     (F.col("l_tax") * 100.0).alias("ea"))


register("ols_slope", f"""
WITH a AS (SELECT l_returnflag AS site,
                  {D(ph.AERO_COEF)} * (l_quantity / {D(10)}) / {D(ph.AERO_LOG_SQ)}
                  * ((l_extendedprice / {D(10000)}) - (l_discount * {D(10)})) AS ea_base,
                  l_tax * {D(100)} AS ea FROM lineitem)
SELECT site, round(regr_slope(ea, ea_base), 6) AS slope, round(regr_intercept(ea, ea_base), 6) AS intercept,
       CAST(regr_count(ea, ea_base) AS BIGINT) AS n
FROM a GROUP BY site""")(lambda spark, sf: r(st.ols_fit(_aero(spark, sf), ["site"], "ea", "ea_base")
                                              .withColumn("n", F.col("n").cast("bigint"))))


def penman_q(spark, sf):
    li = T.table(spark, sf, "lineitem")
    delta = F.col("l_quantity") / 10.0 + 0.5
    gamma = F.col("l_discount") + 0.06
    er = F.col("l_extendedprice") / 10000.0
    ea = F.col("l_tax") * 100.0
    return li.select("l_orderkey", "l_linenumber", round_half_away(ph.penman(delta, gamma, er, ea), 6).alias("evaporation"))


register("penman", f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / {D(10)} + {D(0.5)} AS delta, l_discount + {D(0.06)} AS gamma,
                  l_extendedprice / {D(10000)} AS er, l_tax * {D(100)} AS ea FROM lineitem)
SELECT l_orderkey, l_linenumber, round(delta / (delta + gamma) * er + gamma / (delta + gamma) * ea, 6) AS evaporation
FROM v""")(penman_q)

# ---------------------------------------------------------------------------
# J4, O5, U1, K3, K6, P-reports
# ---------------------------------------------------------------------------


def cyclic_lookup_q(spark, sf):
    series = T.zone_inputs(spark, sf)
    months = series.groupBy("site").agg(F.trunc(F.min("date"), "month").alias("lo"))
    months = months.withColumn("hi", F.last_day("lo"))
    target = sr.date_spine(months, ["site"], "lo", "hi").withColumn("idx", (F.dayofmonth("date") - 1).cast("bigint"))
    return r(lk.cyclic_lookup(target, series, ["site"], ["wl", "evaporation"]))


register("cyclic_lookup", T.with_sql("zone_wl", "zone_evap") + """,
s AS (SELECT site, date, wl, evaporation FROM zone_wl JOIN zone_evap USING (site, date)),
si AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY date) - 1 AS rn,
              count(*) OVER (PARTITION BY site) AS n FROM s),
m AS (SELECT site, date_trunc('month', min(date))::DATE AS lo, max(n) AS n FROM si GROUP BY site),
t AS (SELECT site, n, unnest(generate_series(lo, last_day(lo), INTERVAL 1 DAY))::DATE AS date FROM m),
t2 AS (SELECT site, date, day(date) - 1 AS idx, (day(date) - 1) % n AS pos FROM t)
SELECT t2.site, t2.date, t2.idx,
       round(CASE WHEN x.date IS NOT NULL THEN x.wl ELSE c.wl END, 6) AS wl,
       round(CASE WHEN x.date IS NOT NULL THEN x.evaporation ELSE c.evaporation END, 6) AS evaporation
FROM t2 LEFT JOIN si x ON x.site = t2.site AND x.date = t2.date
        LEFT JOIN si c ON c.site = t2.site AND c.rn = t2.pos""")(cyclic_lookup_q)

register("result_page", _ZONE_JOIN + f""",
g AS (SELECT *, {q.zone_volume()} AS volume, {q.zone_area()} AS surface_area FROM j),
i AS (SELECT *, volume - evaporation * surface_area / {D(1000)} AS v2 FROM g)
SELECT site, date, round(volume * {D(IN_CON_ZONE)} / v2, 6) AS c2 FROM i
ORDER BY c2 DESC NULLS LAST, site, date LIMIT 10 OFFSET 30""")(
    lambda spark, sf: flt.result_page(zone_balance_stateless(spark, sf).select("site", "date", "c2"), "c2",
                                      page=3, descending=True, tie_break=["site", "date"]))


def history_vs_forecast_q(spark, sf):
    """Q10: the chained balance of 1996 (null rows dropped, P6) beside the stateless one of 1997."""
    from pondflow.plans.forecast import compare_series
    z = T.zone_inputs(spark, sf)
    fc = r(bal.zone_balance_frame(z, IN_CON_ZONE, chained=False), 6, ["c2"])
    return compare_series(bal.zone_balance_frame(z, IN_CON_ZONE), flt.date_range(fc, "1997-01-01", "1997-12-31"),
                          "1996-01-01", "1996-12-31", "c2", ["site"])


register("history_vs_forecast", _ZONE_JOIN + f""",
g AS (SELECT *, {q.zone_volume()} AS volume, {q.zone_area()} AS surface_area FROM j),
i AS (SELECT *, volume - evaporation * surface_area / {D(1000)} AS v2 FROM g),
c AS (SELECT *, {q.running('product', 'volume / v2')} AS p FROM i),
h AS (SELECT site, date, round_even({D(IN_CON_ZONE)} * p, 3) AS y FROM c)
SELECT site, 'history' AS trace, date AS x, y FROM h
WHERE date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND y IS NOT NULL AND NOT isnan(y)
UNION ALL
SELECT site, 'forecast' AS trace, date AS x, round(volume * {D(IN_CON_ZONE)} / v2, 6) AS y FROM i
WHERE date BETWEEN DATE '1997-01-01' AND DATE '1997-12-31'""")(history_vs_forecast_q)


def chart_series_q(spark, sf):
    z = zone_balance_chained(spark, sf)
    return sinks.chart_series(z, ["site"], "date", ["volume_v1_m3", "volume_v2_m3", "quantity_t"])


register("chart_series", _ZONE_JOIN + f""",
g AS (SELECT *, {q.zone_volume()} AS volume, {q.zone_area()} AS surface_area FROM j),
i AS (SELECT *, volume - evaporation * surface_area / {D(1000)} AS v2 FROM g),
c AS (SELECT site, date, round(volume * {D(1e6)}, 6) AS volume_v1_m3, round(v2 * {D(1e6)}, 6) AS volume_v2_m3,
             round_even(v2 * {D(1e6)} * {D(IN_CON_ZONE)} / {D(1000)}, 3) AS quantity_t FROM i)
SELECT site, trace, date AS x, y FROM (UNPIVOT c ON volume_v1_m3, volume_v2_m3, quantity_t INTO NAME trace VALUE y)""")(
    chart_series_q)



def records_json_q(spark, sf):
    """K3: the zone balance as one JSON record per row, read back from the JSON."""
    z = zone_balance_chained(spark, sf)
    return sinks.records_json(z).select(F.inline(F.array(F.from_json("record", z.schema))))


register("records_json", ZONE_CHAINED_SQL)(records_json_q)


def null_quality_report_q(spark, sf):
    a = sr.asfreq_daily(T.user_daily(spark, sf), ["site"])
    return st.null_report(a, ["site"], ["v"])


register("null_quality_report", _USER_SPINE + """
SELECT site, count(*) AS n_rows, CAST(count_if(v IS NULL OR isnan(v)) AS BIGINT) AS n_null_v FROM a GROUP BY site""")(
    null_quality_report_q)

# ---------------------------------------------------------------------------
# Models (rows-only checks: tree ensembles have no SQL form)
# ---------------------------------------------------------------------------


def hash_split_q(spark, sf):
    from pondflow.operators.models import hash_split
    train, test = hash_split(T.table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), ["o_orderkey"], 0.2)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


register("hash_split", """
SELECT o_orderkey, o_orderdate, CASE WHEN ('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')), 1, 8))::BIGINT % 10000
       < 8000 THEN 'train' ELSE 'test' END AS part FROM orders""")(hash_split_q)


def calendar_training_frame_q(spark, sf):
    """P5, P11, P12, P16, F5, F7, M1 and M2 together: the rows a keyed calendar model learns from."""
    from pondflow.operators import models as M
    from pondflow.plans import forecast as fc
    df = st.robust_scale(fc.calendar_history(T.line_daily(spark, sf), ["v"]), ["site"], "v").drop("v_min", "v_max")
    train, test = M.hash_split(df, ["site", "date"], 0.1)
    out = train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))
    return r(_bigint(out, ["day", "month", "year"]))


register("calendar_training_frame", T.with_sql("line_daily") + f""",
h AS (SELECT * FROM line_daily WHERE date IS NOT NULL AND v IS NOT NULL AND NOT isnan(v)),
qq AS (SELECT site, quantile_cont(v, 0.01) AS plo, quantile_cont(v, 0.99) AS phi FROM h GROUP BY site),
mm AS (SELECT site, min(v) AS lo, max(v) AS hi FROM h JOIN qq USING (site) WHERE v > plo AND v < phi GROUP BY site)
SELECT site, date, round(v, 6) AS v, CAST(day(date) AS BIGINT) AS day, CAST(month(date) AS BIGINT) AS month, CAST(year(date) AS BIGINT) AS year,
       round(sin({D(fd.TWO_PI)} * month(date) / {D(12)}), 6) AS month_sin, round(cos({D(fd.TWO_PI)} * month(date) / {D(12)}), 6) AS month_cos,
       round((v - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 6) AS v_scaled,
       CASE WHEN ('0x' || substr(md5(concat_ws('|', site, CAST(date AS VARCHAR), '42')), 1, 8))::BIGINT % 10000
            < 9000 THEN 'train' ELSE 'test' END AS part
FROM h JOIN mm USING (site)""")(calendar_training_frame_q)


def recursive_training_frame_q(spark, sf):
    """The feature rows of the recursive forecast, every window full."""
    from pondflow.operators.recursive import training_frame
    return r(training_frame(T.line_daily(spark, sf), ["site"], "v", [], lags=5, windows=(7, 14)))


_N = "ROW_NUMBER() OVER (PARTITION BY site ORDER BY date)"


def _frame(w: int) -> str:
    return f"OVER (PARTITION BY site ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


register("recursive_training_frame", T.with_sql("line_daily") + f""",
f AS (SELECT site, date, v, sin({D(fd.TWO_PI)} * dayofyear(date) / {D(365)}) AS dayofyear_sin, cos({D(fd.TWO_PI)} * dayofyear(date) / {D(365)}) AS dayofyear_cos,
             sin({D(fd.TWO_PI)} * month(date) / {D(12)}) AS month_sin, cos({D(fd.TWO_PI)} * month(date) / {D(12)}) AS month_cos,
             CAST({_N} - 1 AS DOUBLE) AS trend, {q.running('avg', 'v')} AS cumulative_mean, {q.running('stddev_samp', 'v')} AS cumulative_std,
             {", ".join(f"avg(v) {_frame(w)} AS rolling_mean_{w}, stddev_samp(v) {_frame(w)} AS rolling_std_{w}" for w in (7, 14))},
             {", ".join(f"lag(v, {i}) OVER (PARTITION BY site ORDER BY date) AS lag_{i}" for i in range(1, 6))}
      FROM line_daily)
SELECT site, date, round(trend, 6) AS trend, {", ".join(f"round({c}, 6) AS {c}" for c in [
    "v", "dayofyear_sin", "dayofyear_cos", "month_sin", "month_cos", "cumulative_mean", "cumulative_std",
    "rolling_mean_7", "rolling_std_7", "rolling_mean_14", "rolling_std_14", *[f"lag_{i}" for i in range(1, 6)]])}
FROM f WHERE trend >= 13""")(recursive_training_frame_q)


def cumulative_evaporation_q(spark, sf):
    """F19 + W2: daily Penman evaporation per return flag and its running sum."""
    from pondflow.plans import forecast as fc
    w = T.weather_daily(spark, sf).withColumn("evaporation", fc._penman())
    return r(fc.cumulative_evaporation(w, ["site"]).select("site", "date", "evaporation"), 4)


register("cumulative_evaporation", f"""
WITH w AS (SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) / {D(10)} AS delta, avg(l_tax) * {D(10)} + {D(0.06)} AS gamma,
                  avg(l_quantity) / {D(5)} AS er, avg(l_discount) * {D(100)} AS ea FROM lineitem GROUP BY 1, 2),
e AS (SELECT site, date, delta / (delta + gamma) * er + gamma / (delta + gamma) * ea AS e FROM w)
SELECT site, date, round({q.running('sum', 'e')}, 4) AS evaporation FROM e""")(cumulative_evaporation_q)


def horizon_lengths_q(spark, sf):
    """F4 + A7: days from each series' first to its last date, both counted."""
    b = T.zone_wl(spark, sf).groupBy("site").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    return b.select("site", fd.horizon_days("lo", "hi").cast("bigint").alias("days"))


register("horizon_lengths", T.with_sql("zone_wl") + """
SELECT site, CAST(max(date) - min(date) + 1 AS BIGINT) AS days FROM zone_wl GROUP BY site""")(horizon_lengths_q)


def _model_root(spark, sf, name):
    """Registry folder under the shared checkpoint dir, one per input table set and model."""
    import hashlib
    from pondflow.session import checkpoint_dir
    tag = hashlib.sha1(os.path.abspath(sf).encode()).hexdigest()[:12]
    return f"{checkpoint_dir(spark).rstrip('/')}/pondflow-models/{name}-{tag}"


def _evaporation_model(spark, sf, targets, name):
    """M9: the saved forest for these targets and this history, else fitted and saved."""
    from pondflow.operators.models import FOREST_CALENDAR
    from pondflow.plans import forecast as fc
    hist = T.weather_daily(spark, sf)
    return hist, fc.calendar_models(spark, hist, targets, _model_root(spark, sf, name), params=FOREST_CALENDAR, keys=["site"])


def evaporation_forecast_q(spark, sf):
    from pondflow.operators.models import EVAPORATION_TARGETS
    from pondflow.plans import forecast as fc
    _, cm = _evaporation_model(spark, sf, EVAPORATION_TARGETS, "evaporation")
    out, _ = fc.forecast_evaporation(spark, cm, "2002-01", "2002-11", mode="a")
    return sinks.to_display(out, "evaporation", keep_keys=["site"])


register("evaporation_forecast", None)(evaporation_forecast_q)


def evaporation_forecast_cumulative_q(spark, sf):
    """Q1 in pond mode: the running sum of the daily forecast (W2); only the targets Penman needs are fitted."""
    from pondflow.operators.models import PENMAN_TARGETS
    from pondflow.plans import forecast as fc
    _, cm = _evaporation_model(spark, sf, PENMAN_TARGETS, "penman")
    out, _ = fc.forecast_evaporation(spark, cm, "2002-01", "2002-11", mode="b")
    return out.select("site", "date", "evaporation")


register("evaporation_forecast_cumulative", None)(evaporation_forecast_cumulative_q)


def evaporation_after_last_q(spark, sf):
    from pondflow.operators.models import EVAPORATION_TARGETS
    from pondflow.plans import forecast as fc
    hist, cm = _evaporation_model(spark, sf, EVAPORATION_TARGETS, "evaporation")
    return fc.forecast_after_last(spark, cm, hist, 365).select("site", "date", "evaporation", *EVAPORATION_TARGETS)


register("evaporation_forecast_after_last", None)(evaporation_after_last_q)


def water_level_forecast_q(spark, sf):
    from pondflow.operators.models import FOREST_CALENDAR
    from pondflow.plans import forecast as fc
    hist, _ = T.zone_flag_inputs(spark, sf)
    cm = fc.calendar_models(spark, hist, ["wl"], _model_root(spark, sf, "water-level"), params=FOREST_CALENDAR, keys=["site"])
    out = fc.forecast_water_level(spark, cm, "2002-01", "2002-11")
    return out.select("site", "date", *fc.FEATURES, "wl")


register("water_level_forecast", None)(water_level_forecast_q)


def forecast_days_q(spark, sf):
    """Q2's rows per site: every day of the range once, with a level inside the site's observed range."""
    hist, _ = T.zone_flag_inputs(spark, sf)
    seen = hist.groupBy("site").agg(F.min("wl").alias("lo"), F.max("wl").alias("hi"))
    f = water_level_forecast_q(spark, sf).join(seen, "site")
    return f.groupBy("site").agg(F.countDistinct("date").alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day"),
                                 F.count_if(F.col("wl").between(F.col("lo"), F.col("hi"))).alias("in_range"))


register("forecast_days", """
SELECT DISTINCT l_returnflag AS site, CAST(334 AS BIGINT) AS days, DATE '2002-01-01' AS first_day, DATE '2002-11-30' AS last_day,
       CAST(334 AS BIGINT) AS in_range FROM lineitem""")(forecast_days_q)


def _pond_rows(spark, sf):
    inputs = T.pond_inputs(spark, sf)
    p = bal.pond_balance_frame(inputs, IN_CON_POND, area=_pond_area())
    j = p.select("site", "date", "c1", "c2").join(inputs.select("site", "date", "brine_in", "brine_out"), ["site", "date"])
    return j.select(F.substring_index("site", "-", 2).alias("pond"), "date", "brine_in", "brine_out",
                    F.col("c1").alias("initial_concentration"), F.col("c2").alias("final_concentration"))


STACK_SMALL = dict(trees=2, depth=3, rate=0.3, bins=16, rows=1.0, columns=1.0)
_WEATHER = {"solar_irradiance": "avg(l_extendedprice) / 100.0", "slope": "avg(l_quantity) / 10.0", "saturation_vapour": "avg(l_tax) * 30.0",
            "actual_vapour": "avg(l_discount) * 20.0", "wind_speed": "count(*) / 10.0", "radiation_based_evaporation": "avg(l_quantity) / 5.0",
            "aerodynamics_evaporation": "avg(l_discount) * 100.0", "psychrometric_constant": "avg(l_tax) * 10.0 + 0.06"}


def _stacked_sql(history: str, targets: list[str], days: str) -> str:
    """CTEs up to ``wide`` (site, date, targets…): small ensembles of every (site, target) of ``hist`` at the days of ``future`` (site, date)."""
    from pondflow.operators.models import CALENDAR_FEATURES as feats
    cal = {c: f"{c}({{x}})::DOUBLE" for c in ("day", "month", "year")} | {
        f"month_{f}": f"{f}({D(fd.TWO_PI)} * month({{x}}) / {D(12)})" for f in ("sin", "cos")}
    spread = "CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END"
    return f"""
WITH hist AS ({history}),
long AS ({" UNION ALL ".join(f"SELECT site || '|{t}' AS k, site, date, {t}::DOUBLE AS v FROM hist" for t in targets)}),
qq AS (SELECT k, quantile_cont(v, 0.01) AS plo, quantile_cont(v, 0.99) AS phi FROM long GROUP BY k),
mm AS (SELECT k, min(v) AS lo, max(v) AS hi FROM long JOIN qq USING (k) WHERE v > plo AND v < phi GROUP BY k),
rows AS (SELECT k, {", ".join(cal[f].format(x="date") + f" AS {f}" for f in feats)}, (v - lo) / {spread} AS scaled FROM long JOIN mm USING (k)
         WHERE ('0x' || substr(md5(concat_ws('|', site, CAST(date AS VARCHAR), '42')), 1, 8))::BIGINT % 10000 < 9000),
{q.boosted("rows", "k", feats, "scaled", STACK_SMALL["trees"], STACK_SMALL["depth"], STACK_SMALL["rate"], STACK_SMALL["bins"])},
{q.boosted_nodes("k", feats, STACK_SMALL["trees"], STACK_SMALL["depth"], STACK_SMALL["rate"])},
bases AS (SELECT k, avg(scaled) AS base FROM rows GROUP BY k),
future AS ({days}),
asked AS (SELECT f.site, f.date, mm.k, lo, hi, base, m, [{", ".join(cal[x].format(x="f.date") for x in feats)}] AS x
          FROM future f JOIN mm ON split_part(mm.k, '|', 1) = f.site JOIN bases USING (k) JOIN walks USING (k)),
pred AS (SELECT site, date, split_part(k, '|', 2) AS target, ({q.boosted_walk("x", "base", STACK_SMALL["trees"], STACK_SMALL["depth"])}) * {spread} + lo AS y FROM asked),
wide AS (SELECT site, date, {", ".join(f"max(y) FILTER (target = '{t}') AS {t}" for t in targets)} FROM pred GROUP BY site, date)"""


_HISTORY_SQL = (f"SELECT l_returnflag AS site, l_shipdate::DATE AS date, {', '.join(f'round({x}, 6) AS {t}' for t, x in _WEATHER.items())} FROM lineitem GROUP BY 1, 2")
_MONTHS_SQL = "SELECT site, unnest(generate_series(DATE '2002-01-01', DATE '2002-11-30', INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT site FROM hist)"
_AFTER_SQL = "SELECT site, unnest(generate_series(last + INTERVAL 1 DAY, last + INTERVAL 365 DAY, INTERVAL 1 DAY))::DATE AS date FROM (SELECT site, max(date) AS last FROM hist GROUP BY site)"
_PENMAN_SQL = ("slope / (slope + psychrometric_constant) * radiation_based_evaporation + psychrometric_constant / (slope + psychrometric_constant) * "
               "aerodynamics_evaporation")


def _stacked_weather(spark, sf):
    from pondflow.plans import forecast as fc
    hist = r(T.weather_daily(spark, sf))
    return hist, fc.fit_stacked_calendar(hist, list(_WEATHER), ["site"], params=STACK_SMALL)


def evaporation_stacked_q(spark, sf):
    """Q1 with an ensemble for every site and target, all grown in the same jobs."""
    from pondflow.plans import forecast as fc
    out, _ = fc.forecast_evaporation(spark, _stacked_weather(spark, sf)[1], "2002-01", "2002-11")
    return r(out.select("site", "date", *_WEATHER, "evaporation"))


def evaporation_stacked_after_last_q(spark, sf):
    """Q11: the 365 days after each site's last one."""
    from pondflow.plans import forecast as fc
    hist, sm = _stacked_weather(spark, sf)
    return r(fc.forecast_after_last(spark, sm, hist, 365).select("site", "date", *_WEATHER, "evaporation"))


def water_level_stacked_q(spark, sf):
    """Q2/M5: the water level of every day of the range, per site."""
    from pondflow.plans import forecast as fc
    hist, _ = T.zone_flag_inputs(spark, sf)
    out = fc.forecast_water_level(spark, fc.fit_stacked_calendar(hist, ["wl"], ["site"], params=STACK_SMALL), "2002-01", "2002-11")
    return r(out.select("site", "date", "wl"))


_ROUNDED = ", ".join(f"round({t}, 6) AS {t}" for t in _WEATHER)
for _name, _days, _fn in (("evaporation_stacked", _MONTHS_SQL, evaporation_stacked_q), ("evaporation_stacked_after_last", _AFTER_SQL, evaporation_stacked_after_last_q)):
    register(_name, _stacked_sql(_HISTORY_SQL, list(_WEATHER), _days) + f" SELECT site, date, {_ROUNDED}, round({_PENMAN_SQL}, 6) AS evaporation FROM wide")(_fn)
register("water_level_stacked", _stacked_sql(
    "SELECT l_returnflag AS site, l_shipdate::DATE AS date, round(avg(l_quantity) / 25.5 - 0.4, 6) AS wl FROM lineitem GROUP BY 1, 2", ["wl"], _MONTHS_SQL)
    + " SELECT site, date, round(wl, 6) AS wl FROM wide")(water_level_stacked_q)


SITE_CONCENTRATION = dict(trees=15, depth=4, rate=0.35, rows=0.8, columns=0.8)  # far fewer trees than the default


def final_concentration_q(spark, sf):
    from pondflow.plans import forecast as fc
    from pondflow.session import stored
    rows = stored(_pond_rows(spark, sf), "pond-rows")  # read by the fingerprint, the fit and the scoring
    model = fc.site_concentration_model(spark, rows, ["pond"], _model_root(spark, sf, "final-concentration"), SITE_CONCENTRATION)  # M9
    return fc.score_site_concentration(model, rows.drop("final_concentration"), "1998-01", "1998-12")


register("final_concentration_score", None)(final_concentration_q)


# ---------------------------------------------------------------------------
# M3/M6/M8 per site: second-order boosting whose trees SQL can replay
# ---------------------------------------------------------------------------

SITE_FEATURES = ["brine_in", "brine_out", "month", "year"]
SITE_SMALL = dict(trees=2, depth=3, rate=0.3, bins=16, rows=1.0, columns=1.0)


def _site_rows(spark, sf):
    """(pond, date, features, evaporation); outflow is blank on days without one."""
    p = T.pond_inputs(spark, sf)
    return p.select(F.substring_index("site", "-", 2).alias("pond"), "date", "brine_in", F.when(F.col("brine_out") != 0, F.col("brine_out")).alias("brine_out"),
                    F.month("date").cast("double").alias("month"), F.year("date").cast("double").alias("year"), "evaporation")


_SITE_ROWS = T.with_sql("pond_evap", "pond_in", "pond_out") + """,
rows AS (SELECT site[1:len(site) - 7] AS pond, date, brine_in, CASE WHEN brine_out <> 0 THEN brine_out END AS brine_out,
         month(date)::DOUBLE AS month, year(date)::DOUBLE AS year, evaporation
         FROM pond_evap JOIN pond_in USING (site, date) JOIN pond_out USING (site, date)),
"""


def boosted_by_site_q(spark, sf):
    """One small ensemble per pond, all grown in the same jobs, published, loaded again, and its value at every row."""
    from pondflow.operators import models as M
    from pondflow.operators.boosting import fit_boosted, load_boosted, score_boosted
    rows = _site_rows(spark, sf)
    model = fit_boosted(rows, ["pond"], SITE_FEATURES, "evaporation", SITE_SMALL)
    root = _model_root(spark, sf, "by-site")
    M.publish(spark, root, model.save)  # K5
    loaded = load_boosted(spark, M.current_version(spark, root), ["pond"], SITE_FEATURES)  # S10
    return r(score_boosted(loaded, rows).select("pond", "date", "prediction"))


register("boosted_by_site", _SITE_ROWS + q.boosted("rows", "pond", SITE_FEATURES, "evaporation", 2, 3, 0.3, 16) + """
SELECT pond, date, round(pred, 6) AS prediction FROM fitted""")(boosted_by_site_q)


def _flag_history(spark, sf):
    wl, ev = T.zone_flag_inputs(spark, sf)
    z = bal.zone_balance(wl, ev, IN_CON_ZONE, chained=False)
    cols = ["c2", "wl", "evaporation", "volume", "surface_area", "evap_volume"]
    h = sr.asfreq_daily(z.select("site", "date", *cols), ["site"])
    return sr.interpolate_time(h, ["site"], cols)


FOLD_SMALL = dict(trees=2, depth=2, rate=0.3, bins=8, rows=1.0, columns=1.0)
FOLD_KG = {**FOLD_SMALL, "gamma": 0.1}


def recursive_folded_q(spark, sf):
    """The recursive forecast of each return flag's daily value by a small ensemble of its own."""
    from pondflow.operators.recursive import fit_folded, forecast_folded
    hist = T.line_daily(spark, sf)
    fm = fit_folded(hist, ["site"], "v", [], lags=5, windows=(7, 14), params=FOLD_SMALL)
    return r(forecast_folded(fm, hist, "2002-01", "2002-03"))


def recursive_folded_kg_q(spark, sf):
    """The "kg" variant (30 lags, one window, a least gain) over 365 days from the last one, cut to the months asked for."""
    from pondflow.operators.recursive import fit_folded, forecast_folded
    hist = T.line_daily(spark, sf)
    fm = fit_folded(hist, ["site"], "v", [], lags=30, windows=(14,), params=FOLD_KG)
    return r(forecast_folded(fm, hist, "2002-01", "2002-06", horizon_days=365))


def _mean_sql(n: int) -> str:
    return f"list_avg(buf[-{n}:])"


def _std_sql(n: int) -> str:
    """Of the last n values, which there are."""
    return f"sqrt(list_sum(list_transform(buf[-{n}:], lambda z: (z - {_mean_sql(n)}) * (z - {_mean_sql(n)}))) / {D(n - 1)})"


def _fold_sql(lags: int, windows: tuple, params: dict, start: str, end: str, until: str, source: str | None = None, exog: tuple = ()) -> str:
    """The folded forecast as a recursive query, a row for each series and day up to ``until`` (an expression over ``last``).
    ``source``: common table expressions that end with ``line_daily`` (site, date, v, exogenous columns)."""
    features = ["dayofyear_sin", "dayofyear_cos", "month_sin", "month_cos", "trend", "cumulative_mean", "cumulative_std", *exog,
                *[f"rolling_mean_{w}" for w in windows], *[f"rolling_std_{w}" for w in windows], *[f"lag_{i}" for i in range(1, lags + 1)]]
    span, (t, d) = max(lags, *windows), (params["trees"], params["depth"])
    fit = q.boosted("rows", "site", features, "v", t, d, params["rate"], params["bins"], gamma=params.get("gamma", 0.0))

    def cal(x: str) -> str:
        return ", ".join(f"{f}({D(fd.TWO_PI)} * {part}({x}) / {D(n)})" for part, n in (("dayofyear", 365), ("month", 12)) for f in ("sin", "cos"))

    named = ", ".join(f"{x} AS {c}" for x, c in zip(cal("date").split(", "), features))
    own = "".join(f"{c}, " for c in exog)
    return (source or T.with_sql("line_daily")).replace("WITH ", "WITH RECURSIVE ", 1) + f""",
f AS (SELECT site, date, v, {own}{named}, CAST({_N} - 1 AS DOUBLE) AS trend, {q.running('avg', 'v')} AS cumulative_mean, {q.running('stddev_samp', 'v')} AS cumulative_std,
             {", ".join(f"avg(v) {_frame(w)} AS rolling_mean_{w}, stddev_samp(v) {_frame(w)} AS rolling_std_{w}" for w in windows)},
             {", ".join(f"lag(v, {i}) OVER (PARTITION BY site ORDER BY date) AS lag_{i}" for i in range(1, lags + 1))}
      FROM line_daily),
rows AS (SELECT * FROM f WHERE trend >= {max(lags, max(windows) - 1)}),
{fit},
{q.boosted_nodes("site", features, t, d, params["rate"])},
first AS (SELECT site, list(v ORDER BY date) AS buf, count(*)::DOUBLE AS n, avg(v) AS mean, coalesce(var_samp(v) * (count(*) - 1), 0) AS m2,
                 max(date) AS last FROM line_daily GROUP BY site),
bases AS (SELECT site, avg(v) AS base, list([{", ".join(f"{c}::DOUBLE" for c in exog) or "0::DOUBLE"}] ORDER BY date) AS ex, count(*) AS n_ex FROM rows GROUP BY site),
steps AS (SELECT site, last AS date, buf[-{span}:] AS buf, n, mean, m2, n AS trend, NULL::DOUBLE AS p FROM first
    UNION ALL
    SELECT site, date, list_append(buf, p)[-{span}:], n + 1, mean + (p - mean) / (n + 1), m2 + (p - mean) * (p - (mean + (p - mean) / (n + 1))), trend + 1, p
    FROM (SELECT *, {q.boosted_walk("x", "base", t, d)} AS p FROM (
        SELECT site, day AS date, buf, n, mean, m2, trend, base, m, [{cal("day")}, trend, mean, sqrt(m2 / (n - 1)),
            {"".join(f"e[{i}], " for i in range(1, len(exog) + 1))}{", ".join(_mean_sql(w) for w in windows)}, {", ".join(_std_sql(w) for w in windows)}, {", ".join(f"buf[-{i}]" for i in range(1, lags + 1))}] AS x
        FROM (SELECT s.* EXCLUDE (p, date), (s.date + 1)::DATE AS day, base, m, ex[date_diff('day', last, s.date) % n_ex + 1] AS e FROM steps s JOIN bases USING (site) JOIN walks USING (site)
              JOIN (SELECT site, last FROM first) USING (site) WHERE s.date < {until}))))
SELECT site, date, round(p, 6) AS prediction, 'forecast' AS status FROM steps WHERE p IS NOT NULL AND date BETWEEN DATE '{start}' AND DATE '{end}'"""


register("recursive_folded", _fold_sql(5, (7, 14), FOLD_SMALL, "2002-01-01", "2002-03-31", "DATE '2002-03-31'"))(recursive_folded_q)
register("recursive_folded_kg", _fold_sql(30, (14,), FOLD_KG, "2002-01-01", "2002-06-30", "last + 365"))(recursive_folded_kg_q)


POND_EXOG = ["initial_conc", "evaporation", "volume"]


def recursive_folded_pond_q(spark, sf):
    """The pond variant: the opening concentration is a feature besides evaporation and volume (M16); each pond's closing
    concentration is forecast, exogenous values from the cyclic lookup (J4)."""
    from pondflow.operators.recursive import fit_folded, forecast_folded
    p = pond_balance_chained(spark, sf)
    hist = p.select(F.substring_index("site", "-", 2).alias("site"), "date",
                    F.col("c2").alias("v"), F.col("c1").alias("initial_conc"), "evaporation", F.col("volume_v1_m3").alias("volume"))
    fm = fit_folded(hist, ["site"], "v", POND_EXOG, lags=5, windows=(7,), params=FOLD_SMALL)
    return r(forecast_folded(fm, hist, "2001-08", "2001-10"))


_POND_HISTORY = f"""WITH line_daily AS (SELECT site[1:len(site) - 7] AS site, date, c2 AS v, c1 AS initial_conc, evaporation, volume_v1_m3 AS volume
    FROM ({ORACLE["pond_balance_chained"]}))"""

register("recursive_folded_pond", _fold_sql(5, (7,), FOLD_SMALL, "2001-08-01", "2001-10-31", "DATE '2001-10-31'", _POND_HISTORY, tuple(POND_EXOG)))(
    recursive_folded_pond_q)


RECURSIVE_EXOG = ["wl", "evaporation", "volume", "surface_area", "evap_volume"]


def recursive_forecast_q(spark, sf):
    from pondflow.operators.recursive import fit_or_load_recursive, forecast_recursive
    hist = _flag_history(spark, sf)
    rm = fit_or_load_recursive(spark, hist, ["site"], "c2", RECURSIVE_EXOG,
                               _model_root(spark, sf, "recursive"))  # M9: saved forest for these inputs
    return forecast_recursive(rm, hist, "2002-01", "2002-03")


register("recursive_forecast", None)(recursive_forecast_q)


def recursive_forecast_365_q(spark, sf):
    """365 days after each series' last day (cyclic exogenous index from 1), sliced
    to the requested months; reuses the forest saved by ``recursive_forecast``."""
    from pondflow.operators.recursive import fit_or_load_recursive, forecast_recursive
    hist = _flag_history(spark, sf)
    rm = fit_or_load_recursive(spark, hist, ["site"], "c2", RECURSIVE_EXOG, _model_root(spark, sf, "recursive"))
    return forecast_recursive(rm, hist, "2002-01", "2002-06", horizon_days=365, index_base=1)


register("recursive_forecast_365", None)(recursive_forecast_365_q)

# ---------------------------------------------------------------------------
# S1/S2/K1 round trip, F22/F25 labels, M11
# ---------------------------------------------------------------------------


def csv_roundtrip_q(spark, sf):
    """Write the zone water level as reference-style CSV (dd-MM-yyyy, display header,
    one folder per site prefix) to shared storage, then read it back with the
    multi-file, multi-dialect reader."""
    from pondflow.session import checkpoint_dir
    from pondflow.sources import csv as C
    out = f"{checkpoint_dir(spark).rstrip('/')}/pondflow-csv/zone_wl-{abs(hash(sf)) % 10**8}"
    wl = T.zone_wl(spark, sf).withColumn("flag", F.substring("site", 1, 1))
    sinks.write_csv(wl.select("flag", "site", F.date_format("date", "dd-MM-yyyy").alias("Date"),
                              F.col("wl").alias("Wl"), F.lit(None).cast("string").alias("")),
                    out, partition_by=["flag"], sort_by=["site", F.to_date("Date", "dd-MM-yyyy")])
    back = C.read_readings(spark, f"{out}/flag=*/*.csv", {"Wl": "wl"}, hourly=False)
    return r(back.select("site", "date", "wl"))


register("csv_roundtrip", T.with_sql("zone_wl") + "SELECT site, date, round(wl, 6) AS wl FROM zone_wl")(csv_roundtrip_q)


def csv_order_q(spark, sf):
    """Each row's place in the files of its flag, in the order of their names: that of site and date (O1)."""
    from pyspark.sql import Window

    from pondflow.session import checkpoint_dir
    out = f"{checkpoint_dir(spark).rstrip('/')}/pondflow-csv/order-{abs(hash(sf)) % 10**8}"
    wl = T.zone_wl(spark, sf).withColumn("flag", F.substring("site", 1, 1))
    sinks.write_csv(wl.select("flag", "site", F.date_format("date", "dd-MM-yyyy").alias("Date"), "wl"), out, partition_by=["flag"],
                    sort_by=["site", F.to_date("Date", "dd-MM-yyyy")])
    back = spark.read.schema("site string, Date string, wl double, flag string").option("header", True).csv(out)
    lines = back.select("flag", "site", F.to_date("Date", "dd-MM-yyyy").alias("date"), "_metadata.file_name", "_metadata.file_block_start",
                        F.monotonically_increasing_id().alias("line"))
    place = F.row_number().over(Window.partitionBy("flag").orderBy("file_name", "file_block_start", "line")).cast("long")
    return lines.select("flag", "site", "date", place.alias("place"))


register("csv_order", T.with_sql("zone_wl") + """
SELECT site[1:1] AS flag, site, date, row_number() OVER (PARTITION BY site[1:1] ORDER BY site, date) AS place FROM zone_wl""")(csv_order_q)


def result_labels_q(spark, sf):
    from pondflow.functions.labels import result_label, site_key
    s = T.pond_in(spark, sf).select(F.substring_index("site", "-", 2).alias("pond")).distinct()
    modes = s.withColumn("mode", F.explode(F.array(F.lit("a"), F.lit("b"))))
    return modes.select("pond", "mode", site_key("pond").alias("pond_key"),
                        result_label("mode", "pond").alias("prediction_label"),
                        result_label("mode", "pond", "Calculation").alias("calculation_label"))


register("result_labels", T.with_sql("pond_in") + """,
p AS (SELECT DISTINCT split_part(site, '-', 1) || '-' || split_part(site, '-', 2) AS pond FROM pond_in),
m AS (SELECT * FROM p, (VALUES ('a'), ('b')) t(mode))
SELECT pond, mode, upper(trim(pond)) AS pond_key,
       CASE WHEN mode = 'a' THEN 'Prediction for Zone-B' WHEN mode = 'b' AND pond IS NOT NULL AND pond <> ''
            THEN 'Prediction for ' || pond ELSE 'Prediction' END AS prediction_label,
       CASE WHEN mode = 'a' THEN 'Calculation for Zone-B' WHEN mode = 'b' AND pond IS NOT NULL AND pond <> ''
            THEN 'Calculation for ' || pond ELSE '' END AS calculation_label
FROM m""")(result_labels_q)


def ea_scaling_q(spark, sf):
    from pondflow.operators.models import ea_scaling_constant
    li = T.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("site"), (F.col("l_quantity") / 10.0).alias("wind"),
        (F.col("l_extendedprice") / 10000.0).alias("es"), (F.col("l_discount") * 10.0).alias("ea"),
        (F.col("l_tax") * 100.0).alias("ea_obs"))
    return r(ea_scaling_constant(li, "wind", "es", "ea", "ea_obs", ["site"]))


register("ea_scaling_constant", f"""
WITH a AS (SELECT l_returnflag AS site,
                  {D(ph.AERO_COEF)} * (l_quantity / {D(10)}) / {D(ph.AERO_LOG_SQ)}
                  * ((l_extendedprice / {D(10000)}) - (l_discount * {D(10)})) AS ea_base,
                  l_tax * {D(100)} AS ea FROM lineitem)
SELECT site, round(regr_slope(ea, ea_base), 6) AS k FROM a GROUP BY site""")(ea_scaling_q)


register("row_counts", T.with_sql("zone_wl") + "SELECT site, count(*) AS n_rows FROM zone_wl GROUP BY site")(
    lambda spark, sf: st.row_counts(T.zone_wl(spark, sf), ["site"]))


# ---------------------------------------------------------------------------
# physical variants and the frequency probe
# ---------------------------------------------------------------------------


def running_sum_segmented_q(spark, sf):
    from pondflow.operators.scan import running_sum
    return r(running_sum(T.line_daily(spark, sf), ["site"], "v", "cum_v", segment=F.trunc("date", "month")))


register("running_sum_segmented", T.with_sql("line_daily") + f"""
SELECT site, date, round(v, 6) AS v, round({q.running('sum', 'v')}, 6) AS cum_v FROM line_daily""")(
    running_sum_segmented_q)


def chained_ratio_scaled_q(spark, sf):
    """Opening and closing value (base-2 logarithms) of a chain over all days of a return flag; null where no double holds them.
    Partial products pass that range and come back into it."""
    from pondflow.operators.scan import chained_ratio
    days = T.line_daily(spark, sf).select("site", "date", F.when(F.day("date") <= 15, F.lit(2.0 ** 100)).otherwise(F.lit(2.0 ** -100)).alias("ratio"))
    out = chained_ratio(days, ["site"], "ratio", 0.5, "closing", "opening", scaled=True)
    return r(out.select("site", "date", *[F.when((F.col(c) > 1e-300) & (F.col(c) < float("inf")), F.log2(c)).alias(c) for c in ("opening", "closing")]))


register("chained_ratio_scaled", T.with_sql("line_daily") + """,
p AS (SELECT site, date, CASE WHEN day(date) <= 15 THEN 100 ELSE -100 END AS own,
             sum(CASE WHEN day(date) <= 15 THEN 100 ELSE -100 END) OVER (PARTITION BY site ORDER BY date) AS e FROM line_daily)
SELECT site, date, round(CASE WHEN e - own - 1 BETWEEN -996 AND 1023 THEN (e - own - 1)::DOUBLE END, 6) AS opening,
       round(CASE WHEN e - 1 BETWEEN -996 AND 1023 THEN (e - 1)::DOUBLE END, 6) AS closing FROM p""")(chained_ratio_scaled_q)

register("quantiles_p1_p99", f"""
WITH {_PRICE_SQL}
SELECT site, round(quantile_cont(y, 0.01), 6) AS q0, round(quantile_cont(y, 0.99), 6) AS q1
FROM price WHERE y IS NOT NULL AND NOT isnan(y) GROUP BY site""")(
    lambda spark, sf: r(st.quantiles(_price(spark, sf), ["site"], "y", [0.01, 0.99])))


def frequency_probe_q(spark, sf):
    """The reference's pre-check: repair hourly strings (F1), strict parse (F2), A4 per type."""
    e = T.table(spark, sf, "events").select("event_type", "ts").withColumn("raw", _raw_stamp())
    e = e.select(F.col("event_type").alias("site"), fd.parse_hourly(fd.fix_date_format("raw")).alias("ts"))
    return r(sr.detect_frequency(e, ["site"], "ts"))


register("frequency_probe", """
WITH e AS (SELECT event_type AS site, CASE WHEN event_type = 'error' THEN strftime(ts, '%d-%m-%Y')
                  ELSE strftime(ts, '%d-%m-%Y') || ' ' || CAST(hour(ts) AS VARCHAR) || '.' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') END AS raw
           FROM events),
p AS (SELECT site, raw, string_split_regex(raw, '[.\\s]') AS parts FROM e),
h AS (SELECT *, TRY_CAST(TRY_CAST(parts[2] AS DOUBLE) AS BIGINT) AS hr FROM p),
f AS (SELECT site, CASE WHEN len(parts) >= 2 AND hr IS NOT NULL
             THEN parts[1] || ' ' || printf('%02d', hr) || ':00' ELSE raw END AS fixed FROM h),
t AS (SELECT site, try_strptime(fixed, '%d-%m-%Y %H:%M') AS ts FROM f),
a AS (SELECT site, count(ts) AS n, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM t
      GROUP BY site),
g AS (SELECT site, n, CASE WHEN n >= 2 THEN ((hi - lo) / 1e6) / (n - 1) END AS avg_gap_s FROM a)
SELECT site, n, round(avg_gap_s, 6) AS avg_gap_s,
       CASE WHEN avg_gap_s <= 3600.0 THEN 'hourly' WHEN avg_gap_s <= 86400.0 THEN 'daily' ELSE 'monthly' END AS freq
FROM g""")(frequency_probe_q)


def _event_readings(spark, sf):
    """Raw readings per event type: evaporation from ``value``, water level scaled from it."""
    e = T.table(spark, sf, "events").select(F.col("event_type").alias("site"), "ts", "value")
    ev = e.select("site", "ts", (F.col("value") / 1000.0).alias("evaporation"))
    wl = e.select("site", "ts", (F.col("value") / 50.0 - 0.4).alias("wl"))
    return ev, wl


def zone_balance_from_readings_q(spark, sf):
    ev, wl = _event_readings(spark, sf)
    df = bal.zone_balance_from_readings(ev, wl, IN_CON_ZONE)
    return r(df, 6, ["wl", "evaporation", "volume_v1_m3", "evap_volume", "surface_area", "volume_v2_m3"])


register("zone_balance_from_readings", f"""
WITH e AS (SELECT event_type AS site, ts, value FROM events),
fq AS (SELECT site, CASE WHEN count(ts) >= 2 THEN ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) / (count(ts) - 1) END AS g
       FROM e GROUP BY site),
f AS (SELECT site, CASE WHEN g <= 3600.0 THEN 'hourly' WHEN g <= 86400.0 THEN 'daily' ELSE 'monthly' END AS freq FROM fq),
b AS (SELECT e.site, f.freq, CASE WHEN f.freq = 'monthly' THEN last_day(CAST(e.ts AS DATE)) ELSE CAST(e.ts AS DATE) END AS date,
             e.value FROM e JOIN f USING (site) WHERE e.ts IS NOT NULL),
ev0 AS (SELECT site, freq, date, CASE WHEN freq = 'hourly' THEN COALESCE(sum(value / {D(1000)}), 0.0)
                                     ELSE avg(value / {D(1000)}) END AS evaporation
        FROM b GROUP BY site, freq, date),
sp AS (SELECT site, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date
       FROM ev0 WHERE freq = 'hourly' GROUP BY site),
ev AS (SELECT sp.site, sp.date, COALESCE(ev0.evaporation, 0.0) AS evaporation FROM sp LEFT JOIN ev0 USING (site, date)
       UNION ALL SELECT site, date, evaporation FROM ev0 WHERE freq <> 'hourly'),
wl AS (SELECT site, date, avg(value / {D(50)} - {D(0.4)}) AS wl FROM b GROUP BY site, date),
j AS (SELECT w.site, w.date, w.wl, v.evaporation FROM wl w JOIN ev v USING (site, date)
      WHERE w.wl IS NOT NULL AND v.evaporation IS NOT NULL AND NOT isnan(w.wl) AND NOT isnan(v.evaporation)),
g AS (SELECT *, {q.zone_volume()} AS volume, {q.zone_area()} AS surface_area FROM j),
h AS (SELECT *, evaporation * surface_area / {D(1000)} AS evap_volume FROM g),
i AS (SELECT *, volume - evap_volume AS v2 FROM h),
c AS (SELECT *, {q.running('product', 'volume / v2')} AS p,
             COALESCE({q.running('product', 'volume / v2', exclusive=True)}, {D(1)}) AS pe FROM i)
SELECT site, date, round(wl, 6) AS wl, round(evaporation, 6) AS evaporation,
       round(volume * {D(1e6)}, 6) AS volume_v1_m3, round(evap_volume, 6) AS evap_volume,
       round(surface_area, 6) AS surface_area, round(v2 * {D(1e6)}, 6) AS volume_v2_m3,
       round_even({D(IN_CON_ZONE)} * pe, 3) AS c1, round_even({D(IN_CON_ZONE)} * p, 3) AS c2,
       round_even(v2 * {D(1e6)} * {D(IN_CON_ZONE)} / {D(1000)}, 3) AS quantity_t
FROM c""")(zone_balance_from_readings_q)


def _order_readings(spark, sf):
    """Per-order readings keyed by priority and month: evaporation, inflow and (status F) outflow."""
    o = T.table(spark, sf, "orders")
    site = F.concat(F.col("o_orderpriority"), F.lit("-"), F.date_format("o_orderdate", "yyyyMM")).alias("site")
    ev = o.select(site, F.col("o_orderdate").alias("ts"), ((F.col("o_orderkey") % 9) + 0.5).alias("evaporation"))
    fin = o.select(site, F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("brine_in"))
    fout = o.where(F.col("o_orderstatus") == "F").select(site, F.col("o_orderdate").alias("ts"),
                                                         (F.col("o_totalprice") * 0.6).alias("brine_out"))
    return ev, fin, fout


def pond_balance_from_readings_q(spark, sf):
    ev, fin, fout = _order_readings(spark, sf)
    df = bal.pond_balance_from_readings(ev, fin, fout, IN_CON_POND, area=_pond_area())
    return r(df, 6, ["cum_net_flow", "evaporation"])


def _pond_from_readings_sql(readings: str) -> str:
    """The balance after CTEs ``e`` (site, ts, e), ``fin`` and ``fout`` (site, ts, v)."""
    period = "CASE WHEN freq = 'monthly' THEN last_day(CAST(ts AS DATE)) ELSE CAST(ts AS DATE) END"
    return f"""
WITH {readings},
fq AS (SELECT site, CASE WHEN count(ts) >= 2 THEN ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6) / (count(ts) - 1) END AS g
       FROM e GROUP BY site),
f AS (SELECT site, CASE WHEN g <= 3600.0 THEN 'hourly' WHEN g <= 86400.0 THEN 'daily' ELSE 'monthly' END AS freq FROM fq),
eb AS (SELECT site, freq, {period} AS date, e FROM e JOIN f USING (site) WHERE ts IS NOT NULL),
ev AS (SELECT site, date, CASE WHEN freq = 'hourly' THEN COALESCE(sum(e), 0.0) ELSE avg(e) END AS evaporation
       FROM eb GROUP BY site, freq, date),
bi AS (SELECT site, {period} AS date, sum(v) AS brine_in FROM fin JOIN f USING (site) GROUP BY ALL),
bo AS (SELECT site, {period} AS date, sum(v) AS brine_out FROM fout JOIN f USING (site) GROUP BY ALL),
j AS (SELECT ev.site, ev.date, ev.evaporation, bi.brine_in, bo.brine_out
      FROM ev JOIN bi USING (site, date) JOIN bo USING (site, date)
      WHERE ev.evaporation IS NOT NULL AND NOT isnan(ev.evaporation)),
g0 AS (SELECT *, {q.running('sum', 'brine_in - brine_out')} AS cum_net_flow, {POND_AREA_SQL} AS surface_area FROM j),
g AS (SELECT *, {D(ph.POND_BASE_DEPTH)} + cum_net_flow / surface_area AS depth FROM g0),
h AS (SELECT *, surface_area * depth AS volume, surface_area * (evaporation / {D(1000)}) AS evap_loss FROM g),
i AS (SELECT *, volume - evap_loss AS v2 FROM h),
c AS (SELECT *, {q.running('product', 'volume / v2')} AS p,
             COALESCE({q.running('product', 'volume / v2', exclusive=True)}, {D(1)}) AS pe FROM i)
SELECT site, date, round(cum_net_flow, 6) AS cum_net_flow, round_even(depth, 6) AS water_level,
       round_even(volume, 2) AS volume_v1_m3, round(evaporation, 6) AS evaporation,
       round_even(evap_loss, 2) AS evap_volume, round_even(surface_area, 2) AS surface_area,
       round_even(v2, 2) AS volume_v2_m3, round_even({D(IN_CON_POND)} * pe, 3) AS c1,
       round_even({D(IN_CON_POND)} * p, 3) AS c2,
       round_even(v2 * {D(IN_CON_POND)} / {D(1000)}, 0) AS quantity_t
FROM c"""


_FLOWS_SQL = """
fin AS (SELECT site, ts, o_totalprice AS v FROM o), fout AS (SELECT site, ts, o_totalprice * CAST(0.6 AS DOUBLE) AS v FROM o WHERE o_orderstatus = 'F')"""

register("pond_balance_from_readings", _pond_from_readings_sql("""
o AS (SELECT o_orderpriority || '-' || strftime(o_orderdate, '%Y%m') AS site, o_orderdate AS ts, o_orderkey, o_totalprice, o_orderstatus FROM orders),
e AS (SELECT site, ts, (o_orderkey % 9) + CAST(0.5 AS DOUBLE) AS e FROM o),""" + _FLOWS_SQL))(pond_balance_from_readings_q)


def pond_balance_monthly_q(spark, sf):
    """Monthly evaporation readings and daily flows with gaps: every flow counts in the month that holds it."""
    ev, fin, fout = (x.withColumn("site", F.substring_index("site", "-", 2)) for x in _order_readings(spark, sf))
    monthly = ev.groupBy("site", F.trunc("ts", "month").alias("ts")).agg(F.avg("evaporation").alias("evaporation"))
    df = bal.pond_balance_from_readings(monthly.withColumn("ts", F.col("ts").cast("timestamp_ntz")), fin, fout, IN_CON_POND, area=_pond_area())
    return r(df, 6, ["cum_net_flow", "evaporation"])


register("pond_balance_monthly", _pond_from_readings_sql("""
o AS (SELECT o_orderpriority AS site, o_orderdate AS ts, o_orderkey, o_totalprice, o_orderstatus FROM orders),
e AS (SELECT site, date_trunc('month', ts)::TIMESTAMP AS ts, avg((o_orderkey % 9) + CAST(0.5 AS DOUBLE)) AS e FROM o GROUP BY ALL),""" + _FLOWS_SQL))(pond_balance_monthly_q)


# ---------------------------------------------------------------------------
# SURVEY §2 ids exercised by each registered query (read by tools/coverage_map.py)
# ---------------------------------------------------------------------------
QUERY_IDS = {
    "zone_balance_chained": "Q3 P5 F9 F10 F13 F14 W10 W11 W12 F21",
    "zone_balance_two_frames": "Q3 J1 P5 W10 W11 W12",
    "display_names": "P1 P2",
    "calendar_training_frame": "P5 P11 P12 P16 F5 F7 M1 M2 A6 P10 A8",
    "recursive_training_frame": "W3 W4 W5 W6 W7 W8 F6 F8 P6",
    "cumulative_evaporation": "F19 W2",
    "horizon_lengths": "F4 A7",
    "forecast_days": "S7",
    "zone_balance_stateless": "Q8 P5 F9 F10 F14 F15",
    "zone_balance_cubic_wt": "Q7 P5 F11 F12 F14 F15",
    "zone_balance_cubic_kg": "Q7 P5 F11 F12 F16",
    "pond_balance_chained": "Q4 J2 P5 W1 J5 F17 F14 W10 W11 W12 F21",
    "pond_balance_constant": "Q9 F18 J5 F14 F15 P4 P5",
    "pond_balance_constant_chained": "Q9 F18 J5 F14 W10 W12",
    "running_sum": "W1 J2",
    "detect_frequency": "A4",
    "resample_daily_sum": "A1 J3 S7",
    "resample_daily_mean": "A2 J3 S7",
    "resample_hourly_to_daily": "A1 J3",
    "resample_monthly_mean": "A3 J3",
    "asfreq_daily": "J3 S7",
    "interpolate_gaps": "W13 J3",
    "interpolate_gaps_segmented": "W13 J3",
    "csv_order": "O1 K1 K2",
    "chained_ratio_scaled": "W10 W12",
    "rolling_stats": "W4 W5",
    "expanding_stats": "W6 W7",
    "lag_features": "W3",
    "rolling_stats_segmented": "W4 W5",
    "expanding_stats_segmented": "W6 W7",
    "lag_features_segmented": "W3",
    "trend_index": "W8 W9",
    "last_n_rows": "O3",
    "last_row": "O4 A7",
    "calendar_features": "F5 F6 F7 F8",
    "fix_dates": "F1 F2 P14",
    "parse_dates": "S2 S3 P14",
    "month_range_filter": "F3 P7 P9",
    "range_filter_fallback": "P8 F3",
    "future_spine": "S7 F3 F5 F7",
    "future_spine_after_last": "S8 A7",
    "quantiles": "A6",
    "percentile_trim": "A6 P10",
    "robust_scale": "M2 A6 P10 A8 F24 P3",
    "minmax_scale": "A8 F24 P3",
    "inverse_scale": "A8 F24",
    "feature_ranges": "A5",
    "out_of_range": "P15 A5 F5 F7",
    "ols_slope": "A9 F20",
    "penman": "F19",
    "cyclic_lookup": "J4",
    "result_page": "O5 F15",
    "history_vs_forecast": "Q10 U1 P6 P7",
    "chart_series": "K6 U1",
    "records_json": "K3",
    "null_quality_report": "P13 P16 A10 J3",
    "hash_split": "M1",
    "evaporation_forecast": "Q1 M2 M3 M4 M7 M9 M10 M17 F3 F5 F7 F19 F24 S7 S10 P1 P2 P11 P12 P15 P16 K5",
    "evaporation_forecast_after_last": "Q11 S8 A7 M7 F19",
    "evaporation_forecast_cumulative": "Q1 W2 M7 M9 F19",
    "water_level_forecast": "Q2 M5 M7 M9 S7 S10 F24",
    "final_concentration_score": "Q5 M1 M6 M8 M9 P8 F5 F7 S10 K5",
    "boosted_by_site": "M3 M6 M8 K5 S10",
    "evaporation_stacked": "Q1 M1 M2 M3 M4 M7 F3 F5 F7 F19 F24 S7 P11 P12 P16",
    "evaporation_stacked_after_last": "Q11 M3 M4 M7 A7 S8 F19",
    "water_level_stacked": "Q2 M2 M5 M7 S7 F24",
    "recursive_folded_pond": "Q4 Q6 M12 M14 M16 J4 A11 W3 W6 W7 W8",
    "recursive_folded_kg": "Q6 M13 M14 M15 A11 P9",
    "recursive_folded": "Q6 M12 M14 A11 W3 W4 W5 W6 W7 W8 F6 F8 O3 P6",
    "recursive_forecast": "Q6 M9 M12 M14 M16 M17 W3 W4 W5 W6 W7 W8 W13 J3 J4 O3 A11 F6 F8 S9 S10 K5 P6 P17",
    "recursive_forecast_365": "Q6 M9 M14 M15 J4 P9",
    "csv_roundtrip": "S1 S2 S4 S5 K1 K2 F23",
    "result_labels": "F25 F22",
    "ea_scaling_constant": "M11 A9 F20",
    "row_counts": "A10",
    "running_sum_segmented": "W1",
    "quantiles_p1_p99": "A6",
    "frequency_probe": "F1 F2 A4",
    "zone_balance_from_readings": "Q3 A1 A2 A3 A4 P5 W10 W11 W12",
    "pond_balance_monthly": "Q4 A3 A4",
    "pond_balance_from_readings": "Q4 A1 A4 J2 W1 F17 W10 W11 W12",
}
