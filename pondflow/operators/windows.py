"""Window features over ``W(keys) = partitionBy(keys).orderBy(date)``.

All windows in one call share the same partitioning and ordering, so Spark
plans one Exchange and one Sort for the whole feature block.

These operators expect daily (or coarser) series, where a key holds at most
one row per day, so a window partition is bounded by the calendar rather than
by data volume. Resample raw readings first (``series.resample``), which
combines them map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondflow.keys import as_keys as _keys


def w_keys(keys, date: str = "date"):
    return Window.partitionBy(*_keys(keys)).orderBy(date)


def with_halo(df: DataFrame, keys, cols: Sequence[str], n: int, segment: Column, date: str = "date") -> DataFrame:
    """``df`` with ``_seg`` and ``_halo`` = 0, and for every segment copies (``_halo`` = 1) of the ``n`` rows of its key before it.

    ``segment`` must not fall as ``date`` rises (a year, a month). Windows of up to ``n`` rows before the current one can then be
    partitioned by (keys, ``_seg``), so one long series is many tasks' work. A copy holds ``keys``, ``date`` and ``cols`` only; at most ``n``
    rows leave a segment, and a segment looks back over the ``n`` segments before it, as each has a row at least.
    """
    k = _keys(keys)
    own = df.withColumn("_seg", segment)
    late = Window.partitionBy(*k, "_seg").orderBy(F.desc(date))
    row = F.struct(F.col(date), *[F.col(c) for c in cols])
    tails = (own.withColumn("_r", F.row_number().over(late)).where(F.col("_r") <= n).groupBy(*k, "_seg")
             .agg(F.sort_array(F.collect_list(row)).alias("_tail")))
    before = Window.partitionBy(*k).orderBy("_seg").rowsBetween(-n, -1)
    flat = F.flatten(F.collect_list("_tail").over(before))
    carried = tails.withColumn("_all", flat).select(*k, "_seg", F.explode(F.slice("_all", F.greatest(F.size("_all") - n + 1, F.lit(1)), n)).alias("_x"))
    copies = carried.toDF(*carried.columns).select(*k, "_seg", "_x.*", F.lit(1).alias("_halo"))
    return own.withColumn("_halo", F.lit(0)).unionByName(copies, allowMissingColumns=True)


def _framed(df: DataFrame, keys, col: str, n: int, segment: Column | None, date: str):
    """(rows to window over, the window, how to leave): per key, or with ``segment`` per (key, segment) with its halo."""
    k = _keys(keys)
    if segment is None:
        return df, w_keys(k, date), lambda out: out
    rows = with_halo(df, k, [col], n, segment, date)
    return rows, Window.partitionBy(*k, "_seg").orderBy(date), lambda out: out.where("_halo = 0").drop("_halo", "_seg")


def rolling_stats(df: DataFrame, keys, col: str, windows: Sequence[int] = (14, 30, 60),
                  date: str = "date", prefix: str | None = None, segment: Column | None = None) -> DataFrame:
    """Rolling mean and sample std, NULL until ``w`` non-null rows are in the frame.
    ``segment`` (e.g. ``year(date)``) spreads one series over tasks, see ``with_halo``."""
    p = prefix or col
    rows, line, leave = _framed(df, keys, col, max([int(w) for w in windows], default=1), segment, date)
    cols = {}
    for w in windows:
        frame = line.rowsBetween(-(int(w) - 1), 0)
        full = F.count(col).over(frame) == int(w)
        cols[f"{p}_rolling_mean_{w}"] = F.when(full, F.avg(col).over(frame))
        cols[f"{p}_rolling_std_{w}"] = F.when(full, F.stddev_samp(col).over(frame))
    return leave(rows.withColumns(cols))


def expanding_stats(df: DataFrame, keys, col: str, date: str = "date",
                    prefix: str | None = None, segment: Column | None = None) -> DataFrame:
    """Expanding mean and sample std (one row -> NULL std).

    With ``segment`` (see ``with_halo``) each segment's (count, mean, squared deviations) are summed up over the segments before it and
    merged with the running ones inside it, so no task holds a whole series.
    """
    p, k = prefix or col, _keys(keys)
    mean, std = f"{p}_cumulative_mean", f"{p}_cumulative_std"
    if segment is None:
        frame = w_keys(k, date).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumns({mean: F.avg(col).over(frame), std: F.stddev_samp(col).over(frame)})
    own = df.withColumn("_seg", segment)
    parts = own.groupBy(*k, "_seg").agg(F.count(col).alias("_n"), F.avg(col).alias("_m"), (F.var_pop(col) * F.count(col)).alias("_d"))
    whole, before = Window.partitionBy(*k), Window.partitionBy(*k).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    # deviations are carried about the key's mean, so nothing cancels
    parts = parts.withColumn("_c", F.sum(F.col("_m") * F.col("_n")).over(whole) / F.sum("_n").over(whole))
    parts = parts.withColumns({"_pn": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                               "_ps": F.coalesce(F.sum((F.col("_m") - F.col("_c")) * F.col("_n")).over(before), F.lit(0.0)),
                               "_pd": F.coalesce(F.sum(F.col("_d") + F.col("_n") * F.pow(F.col("_m") - F.col("_c"), 2)).over(before), F.lit(0.0))})
    ahead = parts.select(*[F.col(c).alias(f"_k_{c}") for c in k], F.col("_seg").alias("_k_seg"), "_c", "_pn", "_ps", "_pd")
    cond = F.col("_seg").eqNullSafe(F.col("_k_seg"))
    for c in k:
        cond = cond & own[c].eqNullSafe(ahead[f"_k_{c}"])
    rows = own.join(ahead, cond)
    frame = Window.partitionBy(*k, "_seg").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    n, m, dev = F.count(col).over(frame), F.coalesce(F.avg(col).over(frame) - F.col("_c"), F.lit(0.0)), F.coalesce(F.var_pop(col).over(frame), F.lit(0.0))
    rows = rows.withColumns({"_wn": n, "_wm": m, "_wd": dev})
    total = F.col("_pn") + F.col("_wn")
    shift = (F.col("_ps") + F.col("_wm") * F.col("_wn")) / total
    spread = F.col("_pd") + F.col("_wn") * (F.col("_wd") + F.col("_wm") * F.col("_wm")) - total * shift * shift
    return (rows.withColumns({mean: F.when(total > 0, F.col("_c") + shift), std: F.when(total > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (total - 1)))})
            .select(*df.columns, mean, std))


def lag_features(df: DataFrame, keys, col: str, n: int, date: str = "date",
                 as_array: bool = False, prefix: str = "lag", segment: Column | None = None) -> DataFrame:
    """Lags 1..n of ``col``.

    One sliding frame of the ``n`` preceding rows is collected per row (values
    wrapped in structs so NULLs keep their positions) and the lags are read
    from it, instead of ``n`` separate offset-window functions. Rows with
    fewer than ``i`` predecessors get NULL for ``lag_i``, as ``shift`` gives.
    ``as_array=True`` keeps one ``ARRAY<DOUBLE>`` column (newest first), NULL
    until ``n`` predecessors exist. ``segment`` spreads one series over tasks, see ``with_halo``.
    """
    rows, line, leave = _framed(df, keys, col, int(n), segment, date)
    hist = F.collect_list(F.struct(F.col(col).alias("v"))).over(line.rowsBetween(-int(n), -1))
    out = leave(rows.withColumn("_hist", hist))
    if as_array:
        arr = F.when(F.size("_hist") == int(n), F.reverse(F.transform("_hist", lambda s: s["v"])))
        return out.withColumn(f"{prefix}s", arr).drop("_hist")
    lags = {f"{prefix}_{i}": F.try_element_at(F.col("_hist"), F.lit(-i))["v"] for i in range(1, int(n) + 1)}
    return out.withColumns(lags).drop("_hist")


def trend_index(df: DataFrame, keys, date: str = "date", out: str = "trend") -> DataFrame:
    """0-based running row index per key."""
    return df.withColumn(out, F.row_number().over(w_keys(keys, date)) - 1)


def diff_prev(df: DataFrame, keys, col: str, date: str = "date", out: str | None = None) -> DataFrame:
    """Difference with the previous row of the same key."""
    return df.withColumn(out or f"{col}_diff", F.col(col) - F.lag(col).over(w_keys(keys, date)))


def last_n_rows(df: DataFrame, keys, n: int, date: str = "date", rank_col: str | None = None) -> DataFrame:
    """O3: the last ``n`` rows of every key (recursion seed)."""
    w = Window.partitionBy(*_keys(keys)).orderBy(F.col(date).desc())
    r = F.row_number().over(w)
    out = df.withColumn("_rn", r).where(F.col("_rn") <= int(n))
    if rank_col:
        return out.withColumnRenamed("_rn", rank_col)
    return out.drop("_rn")


def last_row(df: DataFrame, keys, date: str = "date") -> DataFrame:
    """The last row per key via ``max_by`` (one hash aggregate, no sort)."""
    k = _keys(keys)
    others = [c for c in df.columns if c not in k]
    s = F.struct(*[F.col(c) for c in others])
    agg = df.groupBy(*k).agg(F.max_by(s, F.col(date)).alias("_last"))
    return agg.select(*k, *[F.col("_last")[c].alias(c) for c in others])
