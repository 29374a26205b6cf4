"""Recurrences as prefix scans.

The reference runs row loops with carried scalars. Here they are closed forms:

* additive recurrence ``x_i = x_{i-1} + d_i``  -> running ``sum``;
* multiplicative ``C_i = C_{i-1} * r_i``       -> ``C_0 * product(r)``;
* the opening value of row i is the closing value of row i-1, i.e. the same
  product over the frame that ends one row earlier (bit-identical to the
  unrounded previous closing value, because Spark accumulates growing frames
  in order).

Two physical shapes are offered:

``segment=None``
    one window per key (``partitionBy(keys)``). A key's rows after daily
    normalisation are bounded by its calendar, so this is the cheap default.

``segment=<Column>`` (e.g. ``F.trunc('date', 'month')``)
    two-phase scan for arbitrarily long or hot series: per-(key, segment)
    totals, an exclusive prefix over the small totals table, and a window
    partitioned by (key, segment). A single key is then spread over as many
    tasks as it has segments. Valid because sum and product are associative.

``scaled_product`` carries a product as (mantissa, exponent), so a chain that passes
through values no double can hold (0 or infinity to a plain product) comes out right
where its value can be held again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondflow.keys import as_keys as _keys

_AGG = {"sum": (F.sum, 0.0), "product": (F.product, 1.0)}


def _combine(kind: str, a: Column, b: Column) -> Column:
    return a + b if kind == "sum" else a * b


def prefix_scan(df: DataFrame, keys, col, kind: str, out: str, date: str = "date",
                exclusive_out: str | None = None, segment: Column | None = None,
                tie_break: str | None = None) -> DataFrame:
    """Running ``sum`` or ``product`` of ``col`` per key in date order.

    ``out`` gets the inclusive prefix; ``exclusive_out`` (optional) the prefix
    ending one row earlier, with the identity (0 or 1) on a key's first row.
    ``tie_break`` orders rows sharing a date (e.g. a file line number), so the
    result is deterministic when dates repeat (see ``filters.require_unique``).
    """
    order = [date, tie_break] if tie_break else [date]
    if kind not in _AGG:
        raise ValueError("kind must be 'sum' or 'product'")
    fn, identity = _AGG[kind]
    k = _keys(keys)
    val = F.col(col) if isinstance(col, str) else col
    if segment is None:
        # the input is materialised once, so an expression (e.g. a guarded ratio) is
        # not rebuilt for both the inclusive and the exclusive frame
        base = df.withColumn("_v", val)
        w = Window.partitionBy(*k).orderBy(*order)
        res = base.withColumn(out, fn("_v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if exclusive_out:
            res = res.withColumn(exclusive_out, F.coalesce(
                fn("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(identity)))
        return res.drop("_v")

    seg = "_seg"
    base = df.withColumn(seg, segment).withColumn("_v", val)
    totals = base.groupBy(*k, seg).agg(fn("_v").alias("_tot"))
    ws = Window.partitionBy(*k).orderBy(seg).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*k, seg, F.coalesce(fn("_tot").over(ws), F.lit(identity)).alias("_off"))
    wi = Window.partitionBy(*k, seg).orderBy(*order)
    joined = base.join(offsets, k + [seg], "inner")
    res = joined.withColumn(out, _combine(kind, F.col("_off"), fn("_v").over(
        wi.rowsBetween(Window.unboundedPreceding, 0))))
    if exclusive_out:
        inner_excl = F.coalesce(fn("_v").over(wi.rowsBetween(Window.unboundedPreceding, -1)), F.lit(identity))
        res = res.withColumn(exclusive_out, _combine(kind, F.col("_off"), inner_excl))
    return res.drop(seg, "_v", "_off")


BLOCK_DAYS = 1024  # of a scaled product: mantissas stay within 2**(+-0.5) a row, so a block of daily rows within 2**(+-512)


def _times_power(x: Column, e: Column) -> Column:
    """``x * 2**e`` in two steps, so that neither factor leaves the range of doubles on the way."""
    half = F.floor(e / 2)
    return x * F.pow(F.lit(2.0), half) * F.pow(F.lit(2.0), e - half)


def _scaled(x: Column) -> tuple[Column, Column]:
    """(mantissa, exponent) of x; zero, infinities and NaN are their own mantissas."""
    plain = (x != 0) & ~F.isnan(x) & (F.abs(x) != float("inf"))
    e = F.when(plain, F.floor(F.log2(F.abs(x)) + 0.5)).otherwise(F.lit(0)).cast("long")
    return F.when(plain, _times_power(x, -e)).otherwise(x), e


def scaled_product(df: DataFrame, keys, col, out: str, date: str = "date", exclusive_out: str | None = None,
                   tie_break: str | None = None) -> DataFrame:
    """Running product of ``col`` per key in date order, for chains of any length.

    Products are carried as (mantissa, exponent) in two phases: a window within blocks of
    ``BLOCK_DAYS`` days, so one key is spread over as many tasks as it has blocks, and a prefix over
    the blocks' totals. ``exclusive_out`` gets the prefix ending one row earlier, 1 on a key's first row.
    A null factor counts as 1; zero, infinite and NaN factors act as in a plain product.
    """
    k, order = _keys(keys), [date, tie_break] if tie_break else [date]
    value = F.coalesce((F.col(col) if isinstance(col, str) else col).cast("double"), F.lit(1.0))
    base = df.withColumn("_v", value).withColumn("_b", F.floor(F.datediff(F.col(date), F.lit("1970-01-01")) / BLOCK_DAYS))
    m, e = _scaled(F.col("_v"))
    base = base.withColumns({"_m": m, "_e": e}).drop("_v")
    totals = base.groupBy(*k, "_b").agg(F.product("_m").alias("_tm"), F.sum("_e").alias("_te"))
    m, e = _scaled(F.col("_tm"))
    before = Window.partitionBy(*k).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (totals.withColumns({"_tm": m, "_te": F.col("_te") + e})
               .select(*[F.col(c).alias(f"_j_{c}") for c in [*k, "_b"]], F.coalesce(F.product("_tm").over(before), F.lit(1.0)).alias("_om"),
                       F.coalesce(F.sum("_te").over(before), F.lit(0)).alias("_oe")))
    same = F.lit(True)
    for c in [*k, "_b"]:
        same = same & base[c].eqNullSafe(offsets[f"_j_{c}"])
    joined = base.join(offsets, same)
    w = Window.partitionBy(*k, "_b").orderBy(*order)
    for name, last in ((out, 0), (exclusive_out, -1)):
        if name:
            frame = w.rowsBetween(Window.unboundedPreceding, last)
            joined = joined.withColumn(name, _times_power(F.col("_om") * F.coalesce(F.product("_m").over(frame), F.lit(1.0)),
                                                          F.col("_oe") + F.coalesce(F.sum("_e").over(frame), F.lit(0))))
    return joined.drop("_m", "_e", "_om", "_oe", "_b", *[f"_j_{c}" for c in [*k, "_b"]])


def running_sum(df: DataFrame, keys, col, out: str, date: str = "date",
                segment: Column | None = None, tie_break: str | None = None) -> DataFrame:
    """Cumulative sum per key."""
    return prefix_scan(df, keys, col, "sum", out, date=date, segment=segment, tie_break=tie_break)


def chained_ratio(df: DataFrame, keys, ratio, initial: float, closing: str, opening: str,
                  date: str = "date", segment: Column | None = None, tie_break: str | None = None,
                  scaled: bool = False) -> DataFrame:
    """W10 + W12: ``closing_i = initial * prod(ratio_1..i)``, ``opening_i = closing_{i-1}``
    (``initial`` on the first row). Both unrounded; round at the sink (F21). ``scaled`` is for
    chains of very many days (``scaled_product``).
    """
    if scaled:
        res = scaled_product(df, keys, ratio, "_p", date=date, exclusive_out="_pe", tie_break=tie_break)
    else:
        res = prefix_scan(df, keys, ratio, "product", "_p", date=date,
                          exclusive_out="_pe", segment=segment, tie_break=tie_break)
    c0 = F.lit(float(initial))
    return (res.withColumn(closing, c0 * F.col("_p"))
            .withColumn(opening, c0 * F.col("_pe"))
            .drop("_p", "_pe"))


def telescoped_quantity(v2, in_con: float) -> Column:
    """``Q_0 = V2_0*c``, ``Q_i = Q_{i-1} + (V2_i - V2_{i-1})*c`` telescopes to ``V2_i*c``.

    Row-local, so it needs no window at all.
    """
    v2 = F.col(v2) if isinstance(v2, str) else v2
    return v2 * F.lit(float(in_con))
