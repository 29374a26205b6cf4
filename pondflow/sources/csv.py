"""CSV readings (S1-S6): dirty headers, several date dialects, many sites at once.

The reference reads one file per site with pandas; here one read covers any
number of files, the site comes from a column, a ``site=`` partition folder
or the file name, and only the selected columns are parsed.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.functions.dates import fix_date_format, parse_date, parse_hourly, parse_timestamp, to_number

_BLANK = re.compile(r"^_c\d+$")


def canonical(name: str) -> str:
    """Display name -> snake_case: ``'Initial_Concentration_(gpl)'`` -> ``initial_concentration_gpl``."""
    s = re.sub(r"[^0-9a-zA-Z]+", "_", name.strip()).strip("_").lower()
    return s or name


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path or glob names anything, on the file system Spark itself reads from."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = jpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(jpath)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] | None = None,
             site: str | None = None, site_from_path: str | None = None) -> DataFrame:
    """Header CSV read as strings; blank header cells (``_cN``) dropped.

    ``columns`` prunes to the named raw columns (S4). ``site`` adds a constant
    key; ``site_from_path`` is a regex with one group applied to the file path
    (e.g. ``r'/([^/]+)\\.csv$'``). A missing path raises a clear error (S6).
    """
    plist = [paths] if isinstance(paths, str) else list(paths)
    for p in plist:
        if not path_exists(spark, p):
            raise FileNotFoundError(f"input not found: {p}")
    df = spark.read.option("header", True).option("inferSchema", False).csv(plist)
    keep = [c for c in df.columns if not _BLANK.match(c)]
    if columns is not None:
        missing = [c for c in columns if c not in df.columns]
        if missing:
            raise ValueError(f"missing required columns: {missing}")
        keep = list(columns)
    out = df.select(*[F.col(f"`{c}`") for c in keep])
    if site is not None:
        out = out.withColumn("site", F.lit(site))
    elif site_from_path:
        out = out.withColumn("site", F.regexp_extract(F.col("_metadata.file_path"), site_from_path, 1))
    return out


def read_readings(spark: SparkSession, paths, measures: Mapping[str, str] | Sequence[str] | None = None,
                  date_col: str = "Date", hourly: bool | None = None, site: str | None = None,
                  site_from_path: str | None = None) -> DataFrame:
    """S2/S3 + F1/F2: readings with a parsed ``date`` (daily) or ``ts`` (hourly).

    ``measures`` maps raw names to canonical names (a list keeps canonical
    forms of the raw names). ``hourly=None`` keeps both ``ts`` and ``date``;
    hourly strings in the ``dd-MM-yyyy H.MM`` dialect are repaired first.
    """
    if measures is None:
        raw = read_csv(spark, paths, site=site, site_from_path=site_from_path)
        names = {c: canonical(c) for c in raw.columns if c not in (date_col, "site")}
    else:
        names = dict(measures) if isinstance(measures, Mapping) else {m: canonical(m) for m in measures}
        cols = [date_col, *names]
        if site is None and not site_from_path:
            probe = spark.read.option("header", True).csv(paths if isinstance(paths, str) else list(paths))
            cols += ["site"] if "site" in probe.columns else []
        raw = read_csv(spark, paths, columns=cols, site=site, site_from_path=site_from_path)
    d = F.col(f"`{date_col}`")
    keys = ["site"] if "site" in raw.columns else []
    vals = [to_number(F.col(f"`{r}`")).alias(c) for r, c in names.items()]  # F23
    if hourly:
        ts = F.coalesce(parse_hourly(fix_date_format(d)), parse_timestamp(d))
        return raw.select(*keys, ts.alias("ts"), *vals)
    if hourly is None:
        ts = F.coalesce(parse_hourly(fix_date_format(d)), parse_timestamp(d))
        return raw.select(*keys, ts.alias("ts"), F.to_date(ts).alias("date"), *vals)
    return raw.select(*keys, parse_date(d).alias("date"), *vals)
