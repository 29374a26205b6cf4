"""Lookups (J4, J5).

J4 replaces a Python closure (value at the date, else the ``idx % len`` row of
the series) with two equi-joins; J5 replaces dict lookups with a literal map
(no join at all) or, for a user-supplied dimension table, a join that is only
broadcast when the table's size has been checked.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pondflow.keys import as_keys as _keys

# Dimension tables larger than this are joined with a shuffle instead of a broadcast.
BROADCAST_ROW_LIMIT = 100_000


def map_lookup(key, table: Mapping[str, float], default: float | None = None,
               normalise: str | None = "upper") -> Column:
    """J5 for constant tables: ``table.get(key.upper(), default)`` as a literal map.

    The map is part of the expression, so there is nothing to broadcast and the
    lookup stays inside whole-stage codegen.
    """
    k = F.col(key) if isinstance(key, str) else key
    if normalise == "upper":
        k = F.upper(k)
    elif normalise == "lower":
        k = F.lower(k)
    m = F.create_map(*[x for kv in table.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))])
    v = F.try_element_at(m, k)
    return F.coalesce(v, F.lit(default)) if default is not None else v


def dimension_join(df: DataFrame, dim: DataFrame, on: Sequence[str], how: str = "left",
                   max_broadcast_rows: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """J5 for dimension DataFrames: broadcast only after proving the row count is small
    (the dimension is materialised once, see ``stats.join_small``)."""
    from pondflow.operators.stats import join_small
    return join_small(df, dim, on, how, limit=max_broadcast_rows)


def cyclic_lookup(target: DataFrame, series: DataFrame, keys, value_cols: Sequence[str],
                  idx: str = "idx", date: str = "date") -> DataFrame:
    """For each target row take the series value at ``date``; when that date
    is not in the series take the row at position ``pmod(idx, n)`` (0-based, in
    date order, ``n`` = rows of that key's series).

    No join: target and series rows are unioned, one window per key numbers the
    series rows and counts them, and the value is read from the series row that
    shares the target's date (window over key+date) or its cyclic slot (window
    over key+slot). Each input is scanned once; every window holds one key's
    calendar-bounded rows at most.
    """
    k = _keys(keys)
    vals = list(value_cols)
    vtypes = {f.name: f.dataType for f in series.schema.fields}
    tcols = [c for c in target.columns if c not in k and c not in vals]
    tstruct = F.struct(*[F.col(c) for c in tcols])
    t = target.select(*k, F.col(date).alias("_d"), F.col(idx).cast("long").alias("_idx"),
                      *[F.lit(None).cast(vtypes[v]).alias(v) for v in vals], F.lit(0).alias("_s"),
                      tstruct.alias("_t"))
    s = series.select(*k, F.col(date).alias("_d"), F.lit(None).cast("long").alias("_idx"), *vals,
                      F.lit(1).alias("_s"), F.lit(None).cast(t.schema["_t"].dataType).alias("_t"))
    u = s.unionByName(t)
    wk = Window.partitionBy(*k).orderBy("_d", F.col("_s").desc())
    u = (u.withColumn("_rn", F.sum("_s").over(wk.rowsBetween(Window.unboundedPreceding, 0)) - 1)
         .withColumn("_n", F.sum("_s").over(Window.partitionBy(*k))))
    u = u.withColumn("_slot", F.when(F.col("_s") == 1, F.col("_rn"))
                     .when(F.col("_n") > 0, F.pmod(F.col("_idx"), F.col("_n"))))
    by_slot = Window.partitionBy(*k, "_slot")
    by_date = Window.partitionBy(*k, "_d")
    hit = F.max("_s").over(by_date) == 1
    picks = {v: F.when(hit, F.max(F.when(F.col("_s") == 1, F.col(v))).over(by_date))
             .otherwise(F.max(F.when(F.col("_s") == 1, F.col(v))).over(by_slot)) for v in vals}
    return u.withColumns(picks).where(F.col("_s") == 0).select(*k, "_t.*", *vals)
