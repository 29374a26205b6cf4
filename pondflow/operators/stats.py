"""Statistics and scaling.

Fitted statistics are small DataFrames keyed like the data (one row per key,
or per key and feature). They are applied with equi-joins whose small side is
broadcast only behind a row-count check.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pondflow.functions.numeric import minmax_inverse, minmax_transform
from pondflow.session import checkpoint_dir, stored
from pondflow.keys import as_keys as _keys

# Stats tables with at most this many rows are broadcast when joined back.
BROADCAST_ROW_LIMIT = 200_000
BRACKET_ACCURACY = 10_000  # of the sketch that brackets exact quantiles; its error is a share of 1/accuracy of the rows
MARGIN = 3                 # errors between a quantile and the ends of its bracket


def join_small(df: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner",
               limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Join a statistics table back; broadcast it only when its row count is proven small.

    The small side is materialised once with a reliable checkpoint into the
    shared ``spark.checkpoint.dir`` (lineage cut, nothing to recompute after an
    executor loss); its row count then decides the join strategy and the join
    reads the checkpointed rows instead of recomputing them.
    """
    on = list(on)
    checkpoint_dir(small.sparkSession)
    small = small.checkpoint(eager=True)
    n = small.count()
    if not on:
        if n > 1:
            _one_row_error()
        return attach_one_row(df, small)
    right = F.broadcast(small) if n <= limit else small
    return df.join(right, on, how)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a single-row table to every row of ``df``.

    A broadcast equi-join on a constant key (a hash join that streams ``df``),
    not a cartesian product. A table of any other number of rows is refused.
    """
    if one_row.limit(2).count() != 1:
        _one_row_error()
    key = "_one"
    return df.withColumn(key, F.lit(1)).join(F.broadcast(one_row.withColumn(key, F.lit(1))), key).drop(key)


def _one_row_error():
    raise ValueError("a key-less statistics table must have exactly one row")


def feature_ranges(df: DataFrame, keys, features: Sequence[str]) -> DataFrame:
    """A5: ``(keys…, feature, min, max)``.

    One aggregate computes min and max of every feature column (map-side
    combined, no row multiplication); the small per-key result is then
    reshaped to one row per feature.
    """
    k = _keys(keys)
    aggs = []
    for i, f in enumerate(features):
        x = F.col(f).try_cast("double")
        aggs += [F.min(x).alias(f"_min{i}"), F.max(x).alias(f"_max{i}")]
    wide = df.groupBy(*k).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"_min{i}").alias("min"),
                              F.col(f"_max{i}").alias("max")) for i, f in enumerate(features)])
    return wide.select(*k, F.inline(rows))


def minmax_fit(df: DataFrame, keys, col: str) -> DataFrame:
    """Per key ``(min, max)`` of ``col`` (sklearn MinMaxScaler.fit)."""
    k = _keys(keys)
    return df.groupBy(*k).agg(F.min(col).alias(f"{col}_min"), F.max(col).alias(f"{col}_max"))


def minmax_apply(df: DataFrame, stats: DataFrame, keys, col: str, out: str | None = None,
                 inverse: bool = False) -> DataFrame:
    """scale (or inverse-scale) ``col`` with fitted per-key statistics."""
    k = _keys(keys)
    j = join_small(df, stats, k)
    fn = minmax_inverse if inverse else minmax_transform
    return j.withColumn(out or col, fn(col, f"{col}_min", f"{col}_max"))


def _lerp(lo, hi, frac):
    return lo + (hi - lo) * frac


def quantiles(df: DataFrame, keys, col: str, probs: Sequence[float], method: str = "sort",
              accuracy: int = 100_000) -> DataFrame:
    """Per key quantiles with linear interpolation (numpy's default).

    ``method``:

    ``sort``   exact and skew-proof. A quantile sketch per key brackets each wanted
               rank; a second pass counts what lies below, above and, value by
               value, inside the brackets, so only their few values are shuffled and
               sorted. Both passes combine map-side: neither a hot key nor a hot value
               lands whole in one task. The input is read twice.
    ``hash``   exact, Spark's ``percentile`` aggregate: one task per key holds
               all of the key's distinct values, so use it only for groups of
               known small size (never for raw data with hot keys).
    ``approx`` ``percentile_approx`` (bounded memory, approximate).

    Result: ``(keys…, q_<i>)`` with one column per probability.
    """
    k = _keys(keys)
    names = [f"q{i}" for i in range(len(probs))]
    x = F.col(col).try_cast("double")
    base = df.select(*k, x.alias("_x")).where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    if method == "hash":
        arr = F.percentile("_x", F.array(*[F.lit(float(p)) for p in probs]))
        agg = base.groupBy(*k).agg(arr.alias("_q"))
        return agg.select(*k, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if method == "approx":
        arr = F.percentile_approx("_x", [float(p) for p in probs], accuracy)
        agg = base.groupBy(*k).agg(arr.alias("_q"))
        return agg.select(*k, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    if method != "sort":
        raise ValueError("method must be 'sort', 'hash' or 'approx'")

    # 1. a sketch brackets every quantile: its values at p -+ MARGIN errors stand below and above the wanted ranks
    eps = 1.0 / BRACKET_ACCURACY
    ends = [min(1.0, max(0.0, float(p) + d)) for p in probs for d in (-MARGIN * eps, MARGIN * eps)]
    sketch = stored(base.groupBy(*k).agg(F.percentile_approx("_x", ends, BRACKET_ACCURACY).alias("_b")), "brackets")
    rows = _with_brackets(base, sketch, k)
    # 2. one pass counts the values of each bracket one by one and those beside it whole (combined map-side); beside it only
    # the next value can be wanted
    cells = []
    for i in range(len(probs)):
        lo, hi = F.col("_b")[2 * i], F.col("_b")[2 * i + 1]
        side = F.when(F.col("_x") < lo, -1).when(F.col("_x") > hi, 1).otherwise(0)
        cells.append(F.struct(F.lit(i).alias("_i"), side.alias("_side"), F.when(side == 0, F.col("_x")).alias("_v")))
    counted = (rows.select(*k, "_x", F.inline(F.array(*cells))).groupBy(*k, "_i", "_side", "_v")
               .agg(F.count(F.lit(1)).alias("_c"), F.min("_x").alias("_min"), F.max("_x").alias("_max")))
    # 3. ranks: only what lies inside a bracket is sorted
    line = Window.partitionBy(*k, "_i").orderBy("_side", "_v")
    upto = F.sum("_c").over(line.rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"_to": upto, "_n": F.sum("_c").over(Window.partitionBy(*k, "_i"))})
    prob = F.element_at(F.array(*[F.lit(float(p)) for p in probs]), F.col("_i") + 1)
    ranked = ranked.withColumn("_pos", prob * (F.col("_n") - 1))
    first, last = F.col("_to") - F.col("_c"), F.col("_to") - 1

    def value_at(rank):
        return F.max(F.when((F.col("_side") == 0) & rank.between(first, last), F.col("_v")).when((F.col("_side") < 0) & (rank == last), F.col("_max"))
                     .when((F.col("_side") > 0) & (rank == first), F.col("_min")))

    picked = ranked.groupBy(*k, "_i").agg(F.first("_pos").alias("_pos"), value_at(F.floor("_pos")).alias("_lo"), value_at(F.ceil("_pos")).alias("_hi"))
    outside = F.raise_error(F.lit("a sketch missed its error bound: no bracket holds a wanted rank")).cast("double")
    picked = picked.withColumn("_q", F.when(F.col("_lo").isNull() | F.col("_hi").isNull(), outside)
                               .otherwise(_lerp(F.col("_lo"), F.col("_hi"), F.col("_pos") - F.floor("_pos"))))
    return picked.groupBy(*k).agg(*[F.max(F.when(F.col("_i") == i, F.col("_q"))).alias(n) for i, n in enumerate(names)])


def _with_brackets(base: DataFrame, sketch: DataFrame, k: list[str]) -> DataFrame:
    """Each row beside its key's brackets: a join on the keys that Spark plans by the sketch table's written size."""
    if not k:
        return base.withColumn("_one", F.lit(1)).join(sketch.withColumn("_one", F.lit(1)), "_one").drop("_one")
    other = sketch.withColumnsRenamed({c: f"_k_{c}" for c in k})
    cond = F.lit(True)
    for c in k:
        cond = cond & base[c].eqNullSafe(other[f"_k_{c}"])
    return base.join(other, cond).drop(*[f"_k_{c}" for c in k])


def percentile_trim(df: DataFrame, keys, col: str, lo_p: float = 0.01, hi_p: float = 0.99,
                    method: str = "sort") -> DataFrame:
    """P10: keep rows with ``p_lo < col < p_hi`` (strict, per key)."""
    k = _keys(keys)
    q = quantiles(df, k, col, [lo_p, hi_p], method=method).withColumnsRenamed({"q0": "_plo", "q1": "_phi"})
    j = join_small(df, q, k)
    return j.where((F.col(col) > F.col("_plo")) & (F.col(col) < F.col("_phi"))).drop("_plo", "_phi")


def robust_minmax_fit(df: DataFrame, keys, col: str, method: str = "sort") -> DataFrame:
    """M2 fit: min/max over the p1 < y < p99 rows only.

    One aggregate after the quantile join computes the trimmed and the full
    range together; a key whose trimmed set is empty (a constant or
    two-valued column) falls back to its full min/max instead of failing.
    """
    k = _keys(keys)
    q = quantiles(df, k, col, [0.01, 0.99], method=method).withColumnsRenamed({"q0": "_plo", "q1": "_phi"})
    j = join_small(df.select(*k, col), q, k)
    inside = (F.col(col) > F.col("_plo")) & (F.col(col) < F.col("_phi"))
    return j.groupBy(*k).agg(
        F.coalesce(F.min(F.when(inside, F.col(col))), F.min(col)).alias(f"{col}_min"),
        F.coalesce(F.max(F.when(inside, F.col(col))), F.max(col)).alias(f"{col}_max"))


def robust_scale(df: DataFrame, keys, col: str, out: str | None = None, method: str = "sort") -> DataFrame:
    """M2: fit on the trimmed rows, apply to all rows (outliers land outside [0,1])."""
    stats = robust_minmax_fit(df, keys, col, method=method)
    return minmax_apply(df, stats, keys, col, out=out or f"{col}_scaled")


def ols_fit(df: DataFrame, keys, y: str, x: str) -> DataFrame:
    """Univariate least squares with intercept, per key (``regr_slope``)."""
    k = _keys(keys)
    return df.groupBy(*k).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"),
        F.regr_intercept(F.col(y), F.col(x)).alias("intercept"),
        F.regr_count(F.col(y), F.col(x)).alias("n"))


def out_of_range(inputs: DataFrame, trained: DataFrame, features: Sequence[str], keys=()) -> DataFrame:
    """Input ranges vs trained ranges per feature, with a ``violated`` flag."""
    k = _keys(keys)
    cur = feature_ranges(inputs, k, features).withColumnsRenamed({"min": "in_min", "max": "in_max"})
    tr = trained.withColumnsRenamed({"min": "tr_min", "max": "tr_max"})
    j = cur.join(tr, k + ["feature"], "left")
    return j.withColumn("violated", (F.col("in_min") < F.col("tr_min")) | (F.col("in_max") > F.col("tr_max")))


def row_counts(df: DataFrame, keys) -> DataFrame:
    """A10: rows per key."""
    return df.groupBy(*_keys(keys)).agg(F.count(F.lit(1)).alias("n_rows"))


def null_report(df: DataFrame, keys, cols: Sequence[str]) -> DataFrame:
    """P5/P13/P14/P16 as counts: rows, and NULL-or-NaN per column, per key."""
    k = _keys(keys)
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for c in cols:
        bad = F.col(c).isNull()
        dt = dict(df.dtypes)[c]
        if dt in ("double", "float"):
            bad = bad | F.isnan(c)
        aggs.append(F.count_if(bad).alias(f"n_null_{c}"))
    return df.groupBy(*k).agg(*aggs)
