"""Keyed time-series shaping: frequency (A4), resampling (A1-A3), spines
and time interpolation (W13).

Every operator takes ``keys`` (the series identity, e.g. ``["site"]``) so one
DataFrame carries any number of series. Spines are generated per key from that
key's own bounds, so their size is bounded by the calendar, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondflow.keys import as_keys as _keys

HOUR_S = 3600.0
DAY_S = 86400.0


def epoch_seconds(ts) -> Column:
    """Seconds since epoch (with micros) for TIMESTAMP or TIMESTAMP_NTZ columns."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(ts.cast("timestamp")) / F.lit(1e6)


def span_seconds(lo, hi) -> Column:
    """``hi - lo`` in seconds, computed on the values as given (no session time-zone
    conversion, so wall-clock readings are not shifted by daylight-saving rules)."""
    lo = F.col(lo) if isinstance(lo, str) else lo
    hi = F.col(hi) if isinstance(hi, str) else hi
    return F.timestamp_diff("MICROSECOND", lo, hi) / F.lit(1e6)


def frequency_class(avg_gap_s) -> Column:
    """Mean gap -> ``hourly`` (<= 1 h), ``daily`` (<= 1 day), else ``monthly``.

    An undefined mean (fewer than two readings) falls through to ``monthly``
    exactly like a NaN comparison does in the reference.
    """
    g = F.col(avg_gap_s) if isinstance(avg_gap_s, str) else avg_gap_s
    return (F.when(g <= HOUR_S, F.lit("hourly"))
            .when(g <= DAY_S, F.lit("daily"))
            .otherwise(F.lit("monthly")))


def detect_frequency(df: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """A4: per key ``(n, avg_gap_s, freq)``.

    The mean of sorted consecutive differences telescopes to
    ``(max - min) / (n - 1)``, so this is one partial+final hash aggregate and
    needs no sort or window. ``n`` counts parseable timestamps; a key with
    fewer than two (even none) is ``monthly``, as the reference's NaN mean is.
    """
    k = _keys(keys)
    agg = df.groupBy(*k).agg(F.count(ts).alias("n"), F.min(ts).alias("_lo"), F.max(ts).alias("_hi"))
    gap = F.when(F.col("n") >= 2, span_seconds("_lo", "_hi") / (F.col("n") - 1))
    return (agg.withColumn("avg_gap_s", gap)
            .withColumn("freq", frequency_class("avg_gap_s"))
            .drop("_lo", "_hi"))


def bucket_of(ts, freq: str) -> Column:
    """Label of the resample bin: the day (``D``) or the month end (``M``)."""
    d = F.to_date(F.col(ts) if isinstance(ts, str) else ts)
    if freq == "D":
        return d
    if freq == "M":
        return F.last_day(d)
    raise ValueError(f"unsupported frequency {freq!r}; use 'D' or 'M'")


def date_spine(bounds: DataFrame, keys: Sequence[str], lo: str = "lo", hi: str = "hi",
               out: str = "date", freq: str = "D") -> DataFrame:
    """One row per key and day (or month end) between ``lo`` and ``hi`` inclusive."""
    k = _keys(keys)
    if freq == "D":
        seq = F.sequence(F.col(lo), F.col(hi), F.expr("interval 1 day"))
        return bounds.select(*k, F.explode(seq).alias(out))
    start, end = F.trunc(F.col(lo), "month"), F.trunc(F.col(hi), "month")
    seq = F.sequence(start, end, F.expr("interval 1 month"))
    months = bounds.select(*k, F.explode(seq).alias(out))
    return months.withColumn(out, F.last_day(out))


def spine_for(df: DataFrame, keys: Sequence[str], date: str = "date", freq: str = "D") -> DataFrame:
    """Per-key spine spanning that key's own first and last date."""
    k = _keys(keys)
    b = df.where(F.col(date).isNotNull()).groupBy(*k).agg(F.min(date).alias("lo"), F.max(date).alias("hi"))
    return date_spine(b, k, "lo", "hi", out=date, freq=freq)


def range_spine(df_keys: DataFrame, keys: Sequence[str], start, end, out: str = "date") -> DataFrame:
    """S7 for a fixed closed range, once per distinct key of ``df_keys``."""
    k = _keys(keys)
    b = (df_keys.select(*k).distinct()
         .withColumn("lo", F.to_date(F.lit(str(start))))
         .withColumn("hi", F.to_date(F.lit(str(end)))))
    return date_spine(b, k, "lo", "hi", out=out)


def spine_after_last(df: DataFrame, keys: Sequence[str], n_days: int, date: str = "date",
                     out: str = "date") -> DataFrame:
    """``n_days`` dates after each key's last date (A7 + sequence)."""
    k = _keys(keys)
    last = df.groupBy(*k).agg(F.max(date).alias("_last"))
    b = last.select(*k, F.date_add("_last", 1).alias("lo"), F.date_add("_last", int(n_days)).alias("hi"))
    return date_spine(b, k, "lo", "hi", out=out)


def fill_gaps(df: DataFrame, keys: Sequence[str], values: Sequence[str], date: str = "date",
              freq: str = "D", fill: float | None = None, only_if: Column | None = None) -> DataFrame:
    """Insert the missing days (or month ends) between each key's observed bins.

    Each row looks at the next observed bin of its key (``lead``) and emits
    itself plus one row per missing bin, with ``fill`` (NULL by default) as the
    value. This is a window over already-binned rows, so the source is read
    once and nothing is joined. ``only_if`` restricts gap filling to rows where
    it holds (other rows pass through unchanged).
    """
    k = _keys(keys)
    others = [c for c in df.columns if c not in k and c != date]
    nxt = F.lead(date).over(Window.partitionBy(*k).orderBy(date))
    if freq == "D":
        stop = F.coalesce(F.date_sub(nxt, 1), F.col(date))
        seq = F.sequence(F.col(date), stop, F.expr("interval 1 day"))
    elif freq == "M":
        start = F.trunc(F.col(date), "month")
        stop = F.coalesce(F.add_months(F.trunc(nxt, "month"), -1), start)
        seq = F.sequence(start, stop, F.expr("interval 1 month"))
    else:
        raise ValueError(f"unsupported frequency {freq!r}; use 'D' or 'M'")
    if only_if is not None:
        seq = F.when(only_if, seq).otherwise(F.array(F.col(date)))
    g = df.withColumn("_seq", seq).select(*k, date, *others, F.posexplode("_seq").alias("_i", "_d"))
    if freq == "M":
        g = g.withColumn("_d", F.last_day("_d"))
    filler = F.lit(fill).cast("double") if fill is not None else F.lit(None)
    vals = {c: F.when(F.col("_i") == 0, F.col(c)).otherwise(filler if c in values else F.lit(None))
            for c in others}
    return g.withColumns(vals).withColumn(date, F.col("_d")).select(*k, date, *others)


def resample(df: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str],
             freq: str = "D", how: str = "sum", out: str = "date") -> DataFrame:
    """A1-A3: bin readings to days or month ends per key, including empty bins.

    ``how='sum'`` gives 0 for empty bins, ``how='mean'`` gives NULL, matching
    pandas ``resample().sum()`` / ``.mean()``. The readings are scanned once and
    combined map-side (partial + final aggregate); empty bins are then added
    from the small binned result (:func:`fill_gaps`), without a join.
    """
    k = _keys(keys)
    if how not in ("sum", "mean"):
        raise ValueError("how must be 'sum' or 'mean'")
    binned = df.select(*k, bucket_of(ts, freq).alias(out), *[F.col(v).try_cast("double").alias(v) for v in values])
    binned = binned.where(F.col(out).isNotNull())
    if how == "sum":
        agg = binned.groupBy(*k, out).agg(*[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])
        return fill_gaps(agg, k, values, out, freq, fill=0.0)
    agg = binned.groupBy(*k, out).agg(*[F.avg(v).alias(v) for v in values])
    return fill_gaps(agg, k, values, out, freq)


def normalize_readings(evap: DataFrame, wl: DataFrame | None, keys: Sequence[str], ts: str = "ts",
                       evap_values: Sequence[str] = ("evaporation",),
                       wl_values: Sequence[str] = ("wl",)) -> DataFrame:
    """Daily normalisation driven by the evaporation readings' frequency, per key.

    Returns ``(keys…, date, freq, <evap_values>, <wl_values>)``:

    * ``hourly`` keys: evaporation summed per day (A1; days inside the
      evaporation record without readings give 0), water level averaged (A2);
    * ``daily`` keys: one row per day (mean of same-day readings);
    * ``monthly`` keys: both averaged per month end (A3).

    One pipeline, no join on raw data: both sources are unioned and combined
    map-side into per-(key, day) sums/counts plus the evaporation timestamp
    bounds; the frequency (A4) is then a window over that small per-key result,
    and month-end keys are re-binned from the daily partials. A row keeps NULL
    for a measure its source did not report (the balance's inner join drops it).
    """
    k = _keys(keys)
    ev_v, wl_v = list(evap_values), list(wl_values) if wl is not None else []
    parts = [evap.select(*k, F.col(ts).alias("_ts"), *[F.col(v).try_cast("double").alias(v) for v in ev_v],
                         *[F.lit(None).cast("double").alias(v) for v in wl_v], F.lit(True).alias("_e"))]
    if wl is not None:
        parts.append(wl.select(*k, F.col(ts).alias("_ts"), *[F.lit(None).cast("double").alias(v) for v in ev_v],
                               *[F.col(v).try_cast("double").alias(v) for v in wl_v], F.lit(False).alias("_e")))
    u = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    u = u.withColumn("date", F.to_date("_ts")).where(F.col("date").isNotNull())
    ee = F.when(F.col("_e"), F.col("_ts"))
    aggs = [F.count_if(F.col("_e")).alias("_n"), F.min(ee).alias("_lo"), F.max(ee).alias("_hi")]
    for v in ev_v + wl_v:
        aggs += [F.sum(v).alias(f"_s_{v}"), F.count(v).alias(f"_c_{v}")]
    daily = u.groupBy(*k, "date").agg(*aggs)
    wkey = Window.partitionBy(*k)
    n, lo, hi = F.sum("_n").over(wkey), F.min("_lo").over(wkey), F.max("_hi").over(wkey)
    daily = daily.withColumns({"_ntot": n, "_elo": lo, "_ehi": hi})
    gap = F.when(F.col("_ntot") >= 2, span_seconds("_elo", "_ehi") / (F.col("_ntot") - 1))
    daily = daily.withColumn("freq", frequency_class(gap))
    daily = daily.withColumn("date", F.when(F.col("freq") == "monthly", F.last_day("date")).otherwise(F.col("date")))
    sums = [F.sum(f"_s_{v}").alias(f"_s_{v}") for v in ev_v + wl_v]
    cnts = [F.sum(f"_c_{v}").alias(f"_c_{v}") for v in ev_v + wl_v]
    binned = daily.groupBy(*k, "date", "freq").agg(*sums, *cnts, F.first("_elo").alias("_elo"),
                                                   F.first("_ehi").alias("_ehi"))
    in_record = F.col("date").between(F.to_date("_elo"), F.to_date("_ehi"))
    outs = {}
    for v in ev_v:
        mean = F.col(f"_s_{v}") / F.col(f"_c_{v}")
        outs[v] = (F.when(F.col("freq") == "hourly",
                          F.when(in_record, F.coalesce(F.col(f"_s_{v}"), F.lit(0.0))))
                   .otherwise(F.when(F.col(f"_c_{v}") > 0, mean)))
    for v in wl_v:
        outs[v] = F.when(F.col(f"_c_{v}") > 0, F.col(f"_s_{v}") / F.col(f"_c_{v}"))
    out = binned.withColumns(outs).select(*k, "date", "freq", *ev_v, *wl_v)
    if wl is None:
        # evaporation alone (pond mode): hourly keys get explicit zero days across gaps
        out = fill_gaps(out, k, ev_v, "date", "D", fill=0.0, only_if=F.col("freq") == "hourly")
        out = out.withColumn("freq", F.last("freq", ignorenulls=True).over(
            Window.partitionBy(*k).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))
    return out


def asfreq_daily(df: DataFrame, keys: Sequence[str], date: str = "date") -> DataFrame:
    """Each series on its dense daily spine (missing days -> NULL rows), one pass."""
    k = _keys(keys)
    others = [c for c in df.columns if c not in k and c != date]
    return fill_gaps(df.where(F.col(date).isNotNull()), k, others, date, "D")


def _between(c: str, date: str, v0: Column, d0: Column, v1: Column, d1: Column) -> Column:
    """Column ``c`` with its gaps filled from the known values v0 (day d0) and v1 (day d1) around them."""
    slope = (v1 - v0) / F.datediff(d1, d0)
    return (F.when(F.col(c).isNotNull(), F.col(c))
            .when(v0.isNull(), F.lit(None))
            .when(v1.isNull(), v0)
            .otherwise(slope * F.datediff(F.col(date), d0) + v0))


def _carried_neighbours(df: DataFrame, k: list[str], cols: Sequence[str], date: str) -> DataFrame:
    """``df`` with, for each of ``cols``, the last known (date, value) of the segments before a row's own
    (``_before_c``) and the first known one of those after it (``_after_c``)."""
    ends = [x for c in cols for known in (F.when(F.col(c).isNotNull(), F.struct(F.col(date).alias("d"), F.col(c).alias("v"))),)
            for x in (F.min(known).alias(f"_first_{c}"), F.max(known).alias(f"_last_{c}"))]
    small = df.groupBy(*k, "_seg").agg(*ends)
    up = Window.partitionBy(*k).orderBy(F.col("_seg").asc()).rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy(*k).orderBy(F.col("_seg").desc()).rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*[F.col(c).alias(f"_j_{c}") for c in [*k, "_seg"]],
                         *[F.last(f"_last_{c}", ignorenulls=True).over(up).alias(f"_before_{c}") for c in cols],
                         *[F.last(f"_first_{c}", ignorenulls=True).over(down).alias(f"_after_{c}") for c in cols])
    same = F.lit(True)
    for c in [*k, "_seg"]:
        same = same & df[c].eqNullSafe(small[f"_j_{c}"])
    return df.join(small, same).drop(*[f"_j_{c}" for c in [*k, "_seg"]])


def interpolate_time(df: DataFrame, keys: Sequence[str], cols: Sequence[str],
                     date: str = "date", segment: Column | None = None) -> DataFrame:
    """Time-weighted linear interpolation of NULL gaps per key.

    Inner gaps use the nearest known neighbours on both sides; a trailing gap
    carries the last known value (as pandas does); a leading gap stays NULL.
    With ``segment`` (a year, say; never decreasing with the date) one long series is spread over
    as many tasks as it has segments: the known values nearest to a segment are carried
    over from the others, which takes one row per segment.
    """
    k = _keys(keys)
    if segment is not None:
        df = _carried_neighbours(df.withColumn("_seg", segment), k, cols, date)
        own, names = [*k, "_seg"], df.columns
        before = Window.partitionBy(*own).orderBy(F.col(date).asc()).rowsBetween(Window.unboundedPreceding, 0)
        after = Window.partitionBy(*own).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)
        for c in cols:
            known = F.when(F.col(c).isNotNull(), F.struct(F.col(date).alias("d"), F.col(c).alias("v")))
            df = df.withColumns({"_n0": F.coalesce(F.last(known, ignorenulls=True).over(before), F.col(f"_before_{c}")),
                                 "_n1": F.coalesce(F.last(known, ignorenulls=True).over(after), F.col(f"_after_{c}"))})
            df = df.withColumn(c, _between(c, date, F.col("_n0.v"), F.col("_n0.d"), F.col("_n1.v"), F.col("_n1.d"))).drop("_n0", "_n1")
        return df.select(*[c for c in names if c != "_seg" and not c.startswith(("_before_", "_after_"))])
    # both neighbours are running frames (O(n) per key): the next known value is
    # the running last non-null in descending date order. A frame from the
    # current row to UNBOUNDED FOLLOWING would be re-aggregated for every row.
    before = Window.partitionBy(*k).orderBy(F.col(date).asc()).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*k).orderBy(F.col(date).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df
    for c in cols:
        known_d = F.when(F.col(c).isNotNull(), F.col(date))
        v0 = F.last(c, ignorenulls=True).over(before)
        d0 = F.last(known_d, ignorenulls=True).over(before)
        v1 = F.last(c, ignorenulls=True).over(after)
        d1 = F.last(known_d, ignorenulls=True).over(after)
        out = out.withColumn(c, _between(c, date, v0, d0, v1, d1))
    return out
