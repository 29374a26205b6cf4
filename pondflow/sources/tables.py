"""Driver tables and the keyed series derived from them (FIXTURES §3).

Each derived series is defined twice, once with the DataFrame API (what the
library runs) and once as a SQL ``SELECT`` for the DuckDB oracle, next to each
other so the two definitions cannot drift apart.

Only the needed columns are selected, so Parquet scans read just those
columns. Every series reads all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.functions.numeric import round_half_away as rnd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one driver table (Parquet)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ym(ts: str):
    return F.date_format(F.col(ts), "yyyyMM")


# --- zone series: lineitem keyed by return flag and ship month ----------------

def zone_wl(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.concat(F.col("l_returnflag"), F.lit("-"), _ym("l_shipdate")).alias("site"),
                      F.to_date("l_shipdate").alias("date"), "l_quantity")
            .groupBy("site", "date")
            .agg(rnd(F.avg("l_quantity") / 25.5 - 0.4, 6).alias("wl")))


def zone_evap(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.concat(F.col("l_returnflag"), F.lit("-"), _ym("l_shipdate")).alias("site"),
                      F.to_date("l_shipdate").alias("date"), "l_tax")
            .groupBy("site", "date")
            .agg(rnd(F.avg("l_tax") * 100, 6).alias("evaporation")))


# --- pond series: orders keyed by priority and order month --------------------

def _pond_keys():
    return [F.concat(F.col("o_orderpriority"), F.lit("-"), _ym("o_orderdate")).alias("site"),
            F.to_date("o_orderdate").alias("date")]


def _fulfilled():
    return F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).otherwise(0.0)


def pond_in(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.select(*_pond_keys(), "o_totalprice").groupBy("site", "date")
            .agg(rnd(F.sum("o_totalprice"), 2).alias("brine_in")))


def pond_out(spark, sf_dir) -> DataFrame:
    """Outflow from fulfilled orders; 0 on days that have none."""
    o = table(spark, sf_dir, "orders")
    return (o.select(*_pond_keys(), _fulfilled().alias("_f")).groupBy("site", "date")
            .agg(rnd(F.sum("_f") * 0.6, 2).alias("brine_out")))


def pond_evap(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return (o.select(*_pond_keys(), "o_orderkey").groupBy("site", "date")
            .agg(rnd(F.avg(F.col("o_orderkey") % 9) + 0.5, 6).alias("evaporation")))


# --- one-scan inputs ----------------------------------------------------------
# The balances need several series of the same table on the same (site, date)
# grid. Reading them as separate aggregates scans the fact table once per
# series; one grouping reads it once and needs no join.

def zone_inputs(spark, sf_dir) -> DataFrame:
    """``(site, date, wl, evaporation)`` = ``zone_wl`` inner-joined with ``zone_evap``, one scan."""
    li = table(spark, sf_dir, "lineitem")
    agg = (li.select(F.concat(F.col("l_returnflag"), F.lit("-"), _ym("l_shipdate")).alias("site"),
                     F.to_date("l_shipdate").alias("date"), "l_quantity", "l_tax")
           .groupBy("site", "date").agg(F.avg("l_quantity").alias("_q"), F.avg("l_tax").alias("_t")))
    return agg.select("site", "date", rnd(F.col("_q") / 25.5 - 0.4, 6).alias("wl"),
                      rnd(F.col("_t") * 100, 6).alias("evaporation"))


def pond_inputs(spark, sf_dir) -> DataFrame:
    """``(site, date, evaporation, brine_in, brine_out)`` = ``pond_evap`` ⋈ ``pond_in`` ⋈ ``pond_out``, one scan."""
    o = table(spark, sf_dir, "orders")
    agg = (o.select(*_pond_keys(), "o_totalprice", "o_orderkey", _fulfilled().alias("_f"))
           .groupBy("site", "date")
           .agg(F.sum("o_totalprice").alias("_in"), F.sum("_f").alias("_out"), F.avg(F.col("o_orderkey") % 9).alias("_e")))
    return agg.select("site", "date", rnd(F.col("_e") + 0.5, 6).alias("evaporation"), rnd(F.col("_in"), 2).alias("brine_in"),
                      rnd(F.col("_out") * 0.6, 2).alias("brine_out"))


# --- event series ------------------------------------------------------------

def ev_readings(spark, sf_dir) -> DataFrame:
    """Raw readings ``(site = event type, ts, value)``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("site"), "ts", "value")


def user_readings(spark, sf_dir) -> DataFrame:
    """Raw readings ``(site = 'u'||user, ts, value)`` of all events (gappy days)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("site"), "ts", "value")


def ev_hourly(spark, sf_dir) -> DataFrame:
    e = ev_readings(spark, sf_dir)
    return (e.groupBy("site", F.date_trunc("hour", "ts").alias("ts"))
            .agg(F.sum("value").alias("value")))


def user_daily(spark, sf_dir) -> DataFrame:
    e = user_readings(spark, sf_dir)
    return e.groupBy("site", F.to_date("ts").alias("date")).agg(F.sum("value").alias("v"))


def line_daily(spark, sf_dir) -> DataFrame:
    """Long dense daily series ``(site = return flag, date, v = sum(quantity))``."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("date"), "l_quantity")
            .groupBy("site", "date").agg(F.sum("l_quantity").alias("v")))


# --- the same series for the oracle -------------------------------------------

SQL = {
    "zone_wl": """
        SELECT l_returnflag || '-' || strftime(l_shipdate, '%Y%m') AS site,
               CAST(l_shipdate AS DATE) AS date,
               round(avg(l_quantity) / 25.5 - 0.4, 6) AS wl
        FROM lineitem GROUP BY 1, 2""",
    "zone_evap": """
        SELECT l_returnflag || '-' || strftime(l_shipdate, '%Y%m') AS site,
               CAST(l_shipdate AS DATE) AS date,
               round(avg(l_tax) * 100, 6) AS evaporation
        FROM lineitem GROUP BY 1, 2""",
    "pond_in": """
        SELECT o_orderpriority || '-' || strftime(o_orderdate, '%Y%m') AS site,
               CAST(o_orderdate AS DATE) AS date,
               round(sum(o_totalprice), 2) AS brine_in
        FROM orders GROUP BY 1, 2""",
    "pond_out": """
        SELECT o_orderpriority || '-' || strftime(o_orderdate, '%Y%m') AS site,
               CAST(o_orderdate AS DATE) AS date,
               round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) * 0.6, 2) AS brine_out
        FROM orders GROUP BY 1, 2""",
    "pond_evap": """
        SELECT o_orderpriority || '-' || strftime(o_orderdate, '%Y%m') AS site,
               CAST(o_orderdate AS DATE) AS date,
               round(avg(o_orderkey % 9) + 0.5, 6) AS evaporation
        FROM orders GROUP BY 1, 2""",
    "ev_readings": "SELECT event_type AS site, ts, value FROM events",
    "user_readings": """
        SELECT 'u' || CAST(user_id AS VARCHAR) AS site, ts, value
        FROM events""",
    "ev_hourly": """
        SELECT event_type AS site, date_trunc('hour', ts) AS ts, sum(value) AS value
        FROM events GROUP BY 1, 2""",
    "user_daily": """
        SELECT 'u' || CAST(user_id AS VARCHAR) AS site, CAST(ts AS DATE) AS date, sum(value) AS v
        FROM events GROUP BY 1, 2""",
    "line_daily": """
        SELECT l_returnflag AS site, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS v
        FROM lineitem GROUP BY 1, 2""",
}


def with_sql(*names: str) -> str:
    """``WITH`` clause defining the named derived series for an oracle query."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n"


def weather_daily(spark, sf_dir) -> DataFrame:
    """Daily history per return flag with the 8 evaporation-model targets, derived from lineitem by ship date."""
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("date"),
                      "l_quantity", "l_extendedprice", "l_discount", "l_tax")
            .groupBy("site", "date")
            .agg((F.avg("l_extendedprice") / 100.0).alias("solar_irradiance"),
                 (F.avg("l_quantity") / 10.0).alias("slope"),
                 (F.avg("l_tax") * 30.0).alias("saturation_vapour"),
                 (F.avg("l_discount") * 20.0).alias("actual_vapour"),
                 (F.count(F.lit(1)) / 10.0).alias("wind_speed"),
                 (F.avg("l_quantity") / 5.0).alias("radiation_based_evaporation"),
                 (F.avg("l_discount") * 100.0).alias("aerodynamics_evaporation"),
                 (F.avg("l_tax") * 10.0 + 0.06).alias("psychrometric_constant")))


def zone_flag_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Zone water level and evaporation keyed by return flag only (long daily series)."""
    li = table(spark, sf_dir, "lineitem")
    base = li.select(F.col("l_returnflag").alias("site"), F.to_date("l_shipdate").alias("date"),
                     "l_quantity", "l_tax")
    wl = base.groupBy("site", "date").agg(rnd(F.avg("l_quantity") / 25.5 - 0.4, 6).alias("wl"))
    ev = base.groupBy("site", "date").agg(rnd(F.avg("l_tax") * 100, 6).alias("evaporation"))
    return wl, ev
