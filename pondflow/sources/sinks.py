"""Sinks (K1-K6, U1, P2).

Writes are distributed: one file per task (``coalesce(1)`` only on request,
for small reports). Display names with units are applied here only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Display names with units, as the reference labels its outputs.
# ---------------------------------------------------------------------------
DISPLAY_NAMES = {
    "zone": {
        "date": "Date", "wl": "Water Level (m)", "evaporation": "Evaporation (mm/day)",
        "volume_v1_m3": "Volume V1(m3)", "evap_volume": "Evaporation Volume (mm3)",
        "surface_area": "Surface Area (mm2)", "volume_v2_m3": "Volume V2(m3)",
        "c1": "Initial Concentration C1 (gpl)", "c2": "Final Concentration C2 (gpl)",
        "quantity_t": "Quantity (tonnes)",
    },
    "pond": {
        "date": "Date", "water_level": "Water Level (m)", "volume_v1_m3": "Volume V1 (m3)",
        "evaporation": "Evaporation (mm/day)", "evap_volume": "Evaporation Volume (mm3)",
        "surface_area": "SurfaceArea (m2)", "volume_v2_m3": "Volume V2 (m3)",
        "c1": "Initial Concentration (gpl)", "c2": "Final Concentration C2 (gpl)",
        "quantity_t": "Quantity (tonnes)",
    },
    "evaporation": {
        "date": "Date", "evaporation": "Evaporation (mm/day)", "slope": "Slope (kPa/°C)",
        "psychrometric_constant": "Psychrometric constant (kPa/°C)",
        "radiation_based_evaporation": "Radiation Based Evaporation (mm/day)",
        "aerodynamics_evaporation": "Aerodynamics Evaporation (mm/day)",
        "saturation_vapour": "Saturation Vapour (kPa)", "actual_vapour": "Actual Vapour (kPa)",
        "solar_irradiance": "Solar Irradiance (MJ m2/day)", "wind_speed": "Wind Speed (m/s)",
    },
    "water_level": {"date": "Date", "wl": "Water Level (m)"},
    "final_concentration": {"date": "Date", "predicted_final": "Final Concentration (gpl)"},
}


def to_display(df: DataFrame, kind: str, keep_keys: Sequence[str] = ()) -> DataFrame:
    """P1 + P2: ordered projection under unit-bearing display names."""
    names = DISPLAY_NAMES[kind]
    cols = [F.col(k) for k in keep_keys]
    cols += [F.col(c).alias(n) for c, n in names.items() if c in df.columns]
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = (), single_file: bool = False,
              sort_by: Sequence[str | Column] = ()) -> None:
    """K1/K2: overwrite CSV with header; optional ``site=``/``unit=`` partitions.

    O1: ``sort_by`` (names or expressions, e.g. ``["site", "date"]``; a date written as text is
    sorted by the date, not by its text) orders the rows of a partition value over all of its files,
    read in the order of their names. Rows are split by ranges of (partition columns,
    ``sort_by``), so a large partition value is written by several tasks and small ones share one.
    """
    out = df
    if sort_by:
        order = [F.col(c) if isinstance(c, str) else c for c in (*partition_by, *sort_by)]
        out = out.repartitionByRange(*order).sortWithinPartitions(*order)
    out = out.coalesce(1) if single_file else out
    w = out.write.mode("overwrite").option("header", True)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink partitioned by key, so later reads prune by site."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def records_json(df: DataFrame) -> DataFrame:
    """K3: one JSON record per row (``to_dict(orient='records')``)."""
    return df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns])).alias("record"))


def column_descriptors(spark: SparkSession, df: DataFrame) -> DataFrame:
    """K4: ``{headerName, field}`` per schema field (schema metadata only)."""
    rows = [(f.name, f.name) for f in df.schema.fields]
    return spark.createDataFrame(rows, "headerName string, field string")


def chart_series(df: DataFrame, keys: Sequence[str], x: str, measures: Sequence[str],
                 names: Mapping[str, str] | None = None) -> DataFrame:
    """K6: long ``(keys…, trace, x, y)`` frame, one trace per measure (unpivot)."""
    long = df.select(*keys, x, *measures).unpivot([*keys, x], list(measures), "trace", "y")
    long = long.withColumnRenamed(x, "x") if x != "x" else long
    if names:
        m = F.create_map(*[v for kv in names.items() for v in (F.lit(kv[0]), F.lit(kv[1]))])
        long = long.withColumn("trace", F.coalesce(F.try_element_at(m, F.col("trace")), F.col("trace")))
    return long.select(*keys, "trace", "x", "y")


def labelled_union(parts: Mapping[str, DataFrame], label: str = "trace") -> DataFrame:
    """Concatenate series under a label column (``unionByName``)."""
    out = None
    for name, df in parts.items():
        d = df.withColumn(label, F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
