"""Mass-balance queries: zone (Q3, Q7, Q8) and pond (Q4, Q9).

Each is one lazy plan: an equi-join on (keys, date), row-local physics
columns (P4 computed/constant columns, F13 unit scaling by 1e6 and 1/1000),
and at most one prefix scan per key for the chained concentration.
Inputs are keyed daily series; outputs keep canonical snake_case names
(display names are applied at the sink, see ``sources.sinks.DISPLAY_NAMES``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pondflow.functions import physics as ph
from pondflow.functions.numeric import round_even
from pondflow.keys import as_keys as _keys
from pondflow.operators.filters import drop_null_rows
from pondflow.operators.lookup import map_lookup
from pondflow.operators.scan import chained_ratio, running_sum, telescoped_quantity

MEGA = 1_000_000.0


def zone_balance(wl: DataFrame, evap: DataFrame, in_con: float, keys=("site",), date: str = "date",
                 chained: bool = True, geometry: str = "piecewise", unit: str = "wt%",
                 segment: Column | None = None) -> DataFrame:
    """Zone balance from water level ``wl`` and daily evaporation ``evaporation``.

    ``geometry='piecewise'`` + ``chained=True``  -> Q3 (current product)
    ``geometry='piecewise'`` + ``chained=False`` -> Q8 (stateless C2)
    ``geometry='cubic'``, ``unit='wt%'|'kg'``    -> Q7 (legacy)
    """
    k = _keys(keys)
    df = wl.select(*k, date, "wl").join(evap.select(*k, date, "evaporation"), k + [date], "inner")  # J1
    return zone_balance_frame(df, in_con, keys=k, date=date, chained=chained, geometry=geometry, unit=unit,
                              segment=segment)


def zone_balance_frame(df: DataFrame, in_con: float, keys=("site",), date: str = "date",
                       chained: bool = True, geometry: str = "piecewise", unit: str = "wt%",
                       segment: Column | None = None, tie_break: str | None = None) -> DataFrame:
    """:func:`zone_balance` on an already joined ``(keys, date, wl, evaporation)`` frame.

    ``tie_break`` orders rows that share a date inside the chain (see
    ``scan.prefix_scan``)."""
    k = _keys(keys)
    df = drop_null_rows(df, ["wl", "evaporation"])  # P5
    if geometry == "cubic":
        df = df.withColumns({"volume": ph.cubic_volume("wl"), "surface_area": ph.cubic_surface("wl")})
        if unit == "kg":
            we = F.col("evaporation") * F.col("surface_area")
            return (df.withColumn("water_evaporated", we)
                    .withColumn("c2", ph.solids_ratio_quantity("water_evaporated", in_con))
                    .select(*k, date, "wl", "evaporation", "volume", "surface_area", "water_evaporated", "c2"))
        df = df.withColumn("evap_volume", ph.evaporated_volume("evaporation", "surface_area"))
        df = df.withColumn("v2", F.col("volume") - F.col("evap_volume"))
        return (df.withColumn("c2", ph.stateless_concentration("volume", "v2", in_con))
                .select(*k, date, "wl", "evaporation", "volume", "surface_area", "evap_volume", "c2"))
    if geometry != "piecewise":
        raise ValueError("geometry must be 'piecewise' or 'cubic'")

    df = df.withColumns({"volume": ph.zone_volume("wl"), "surface_area": ph.zone_area("wl")})
    df = df.withColumn("evap_volume", ph.evaporated_volume("evaporation", "surface_area"))
    df = df.withColumn("v2", F.col("volume") - F.col("evap_volume"))
    if not chained:
        return (df.withColumn("c2", ph.stateless_concentration("volume", "v2", in_con))
                .select(*k, date, "wl", "evaporation", "volume", "v2", "surface_area", "evap_volume", "c2"))

    df = chained_ratio(df, k, ph.volume_ratio("volume", "v2"), in_con, "c2", "c1",
                       date=date, segment=segment, tie_break=tie_break)  # W10, W12
    v2_m3 = F.col("v2") * MEGA
    return df.select(
        *k, date, "wl", "evaporation",
        (F.col("volume") * MEGA).alias("volume_v1_m3"),
        "evap_volume", "surface_area",
        v2_m3.alias("volume_v2_m3"),
        round_even("c1", 3).alias("c1"),
        round_even("c2", 3).alias("c2"),
        round_even(telescoped_quantity(v2_m3, in_con) / 1000.0, 3).alias("quantity_t"),  # W11
    )


def pond_balance(evap: DataFrame, inflow: DataFrame, outflow: DataFrame, in_con: float,
                 keys=("site",), date: str = "date", area: Column | None = None,
                 segment: Column | None = None) -> DataFrame:
    """Q4: pond balance from daily evaporation and brine in/out flows.

    Level is the running net inflow over the pond area (W1), depth adds the
    0.8 m base, and C2 chains ``V1/V2`` (W10). ``area`` defaults to the
    reference's name rule (``dhordo`` or the other pond, F17/J5).
    """
    k = _keys(keys)
    df = (evap.select(*k, date, "evaporation")
          .join(inflow.select(*k, date, "brine_in"), k + [date], "inner")
          .join(outflow.select(*k, date, "brine_out"), k + [date], "inner"))  # J2
    return pond_balance_frame(df, in_con, keys=k, date=date, area=area, segment=segment)


def pond_balance_frame(df: DataFrame, in_con: float, keys=("site",), date: str = "date",
                       area: Column | None = None, segment: Column | None = None,
                       tie_break: str | None = None) -> DataFrame:
    """:func:`pond_balance` on an already joined ``(keys, date, evaporation, brine_in, brine_out)`` frame."""
    k = _keys(keys)
    df = drop_null_rows(df, ["evaporation", "brine_in", "brine_out"])
    df = df.withColumn("net_flow", F.col("brine_in") - F.col("brine_out"))
    df = running_sum(df, k, "net_flow", "cum_net_flow", date=date, segment=segment, tie_break=tie_break)  # W1
    a = area if area is not None else ph.pond_area(F.col(k[0]))
    df = df.withColumn("surface_area", a)
    df = df.withColumn("level", F.col("cum_net_flow") / F.col("surface_area"))
    df = df.withColumn("depth", F.lit(ph.POND_BASE_DEPTH) + F.col("level"))
    df = df.withColumn("volume", F.col("surface_area") * F.col("depth"))
    df = df.withColumn("evap_loss", F.col("surface_area") * (F.col("evaporation") / 1000.0))
    df = df.withColumn("v2", F.col("volume") - F.col("evap_loss"))
    df = chained_ratio(df, k, ph.volume_ratio("volume", "v2"), in_con, "c2", "c1",
                       date=date, segment=segment, tie_break=tie_break)
    return df.select(
        *k, date,
        "cum_net_flow",
        round_even("depth", 6).alias("water_level"),
        round_even("volume", 2).alias("volume_v1_m3"),
        "evaporation",
        round_even("evap_loss", 2).alias("evap_volume"),
        round_even("surface_area", 2).alias("surface_area"),
        round_even("v2", 2).alias("volume_v2_m3"),
        round_even("c1", 3).alias("c1"),
        round_even("c2", 3).alias("c2"),
        round_even(telescoped_quantity("v2", in_con) / 1000.0, 0).alias("quantity_t"),
    )


def pond_constant_balance(evap: DataFrame, pond: str | Column, in_con: float, keys=("site",),
                          date: str = "date", volume_set: str = "m3", chained: bool = False,
                          segment: Column | None = None) -> DataFrame:
    """Constant-volume pond (legacy) with area 9 m^2, volume looked up by pond letter.

    ``volume_set='ml'``: table values are ML and multiplied by 1000 (older code);
    ``volume_set='m3'``: table values used as is. Unknown ponds take the
    reference's default. ``chained=True`` chains C2 (the chained constant-volume variant).
    """
    k = _keys(keys)
    pond_col = F.col(pond) if isinstance(pond, str) else pond
    df = drop_null_rows(evap, ["evaporation"])
    table = ph.POND_VOLUMES_ML if volume_set == "ml" else ph.POND_VOLUMES_M3
    vol = map_lookup(pond_col, table, default=ph.POND_VOLUME_DEFAULT)  # J5
    if volume_set == "ml":
        vol = vol * 1000.0
    df = df.withColumns({"volume": vol, "surface_area": F.lit(ph.POND_CONST_AREA)})
    df = df.withColumn("evap_volume", ph.evaporated_volume("evaporation", "surface_area"))
    df = df.withColumn("v2", F.col("volume") - F.col("evap_volume"))
    if chained:
        df = chained_ratio(df, k, ph.volume_ratio("volume", "v2"), in_con, "c2", "c1",
                           date=date, segment=segment)
        return df.select(*k, date, "evaporation", "volume", "v2", "surface_area", "evap_volume",
                         "c1", "c2")
    df = df.withColumn("c2", ph.stateless_concentration("volume", "v2", in_con))
    return df.select(*k, date, "evaporation", "volume", "v2", "surface_area", "evap_volume", "c2")


def zone_balance_from_readings(evap_readings: DataFrame, wl_readings: DataFrame, in_con: float,
                               keys=("site",), ts: str = "ts", **kw) -> DataFrame:
    """Q3 end to end: readings -> per-key frequency (A4) -> daily/monthly
    normalisation (A1-A3) -> zone balance. Readings carry ``ts`` plus
    ``evaporation`` / ``wl`` (see ``sources.csv.read_readings``)."""
    from pondflow.operators.series import normalize_readings
    daily = normalize_readings(evap_readings, wl_readings, _keys(keys), ts)
    return zone_balance_frame(daily.drop("freq"), in_con, keys=keys, **kw)


def flows_by_period(flow: DataFrame, periods: DataFrame, keys, value: str, ts: str = "ts", date: str = "date") -> DataFrame:
    """(keys…, date, value): raw flow readings summed over the evaporation period that holds them.

    ``periods`` has each key's evaporation ``freq``: a period is a day, or under monthly evaporation a month named by its last day.
    Readings are summed per day before they meet the periods, so the join sees one row per key and day.
    """
    k = _keys(keys)
    daily = flow.groupBy(*k, F.to_date(ts).alias("_day")).agg(F.sum(value).alias(value))
    period = F.when(F.col("freq") == "monthly", F.last_day("_day")).otherwise(F.col("_day"))
    return daily.join(periods.select(*k, "freq").distinct(), k).groupBy(*k, period.alias(date)).agg(F.sum(value).alias(value))


def pond_balance_from_readings(evap_readings: DataFrame, inflow: DataFrame, outflow: DataFrame,
                               in_con: float, keys=("site",), ts: str = "ts", **kw) -> DataFrame:
    """Q4 end to end: evaporation normalised by its frequency, flows summed over its periods.

    A row is an evaporation period with readings of both flows, as the merge of the daily files gives it: no day is made up,
    repeated dates are one row, and under monthly evaporation every flow of the month counts.
    """
    from pondflow.operators.series import normalize_readings
    k = _keys(keys)
    ev = normalize_readings(evap_readings, None, k, ts)
    fin = flows_by_period(inflow, ev, k, "brine_in", ts)
    fout = flows_by_period(outflow, ev, k, "brine_out", ts)
    return pond_balance(ev.drop("freq"), fin, fout, in_con, keys=keys, **kw)
