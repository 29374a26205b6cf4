"""Row filters and validation.

Validation helpers run one small aggregate and raise on the driver with a
message naming the problem; they never pull data rows to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pondflow.functions.dates import month_end, month_start
from pondflow.keys import as_keys as _keys


def drop_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring absent ones (Spark's ``drop`` already does)."""
    return df.drop(*cols)


def drop_null_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with NULL (or NaN) in ``subset`` (all columns when None)."""
    cols = list(subset) if subset else df.columns
    types = dict(df.dtypes)
    cond = F.lit(True)
    for c in cols:
        ok = F.col(c).isNotNull()
        if types.get(c) in ("double", "float"):
            ok = ok & ~F.isnan(c)
        cond = cond & ok
    return df.where(cond)


def date_range(df: DataFrame, start, end, date: str = "date") -> DataFrame:
    """Closed range ``start <= date <= end`` (pushed down to the scan)."""
    return df.where(F.col(date).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def month_range(df: DataFrame, start_ym: str, end_ym: str, date: str = "date") -> DataFrame:
    """F3 + P7: from the first day of ``start_ym`` to the last day of ``end_ym``."""
    return df.where(F.col(date).between(month_start(F.lit(start_ym)), month_end(F.lit(end_ym))))


def month_range_with_fallback(df: DataFrame, keys, start_ym: str | None, end_ym: str | None,
                              date: str = "date") -> DataFrame:
    """Per key keep the rows in range; a key with no row in range keeps all rows.

    No range (D13) keeps everything. The per-key "any row in range" flag is a
    map-side combined aggregate joined back (broadcast when the key count is
    small, which a row count checks).
    """
    if not start_ym or not end_ym:
        return df
    k = _keys(keys)
    inr = F.col(date).between(month_start(F.lit(start_ym)), month_end(F.lit(end_ym)))
    flagged = df.withColumn("_in", inr)
    # one row per key (partial aggregation, skew-safe); joined back on the key
    hits = flagged.groupBy(*k).agg(F.max(F.col("_in").cast("int")).alias("_hit"))
    # one row per key: broadcast behind a row-count check, so the data is never reshuffled
    from pondflow.operators.stats import join_small
    joined = join_small(flagged, hits, k)
    return joined.where(F.col("_in") | (F.col("_hit") == 0)).drop("_in", "_hit")


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Raise listing every missing column; checked on the schema, no job."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def require_unique(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Raise when two rows share ``cols`` (e.g. keys + date): ordered windows and the
    chained balance would otherwise depend on arbitrary row order. One aggregate;
    only a single offending key is brought to the driver for the message."""
    dup = df.groupBy(*cols).count().where(F.col("count") > 1).limit(1).collect()
    if dup:
        raise ValueError(f"duplicate rows for {dict((c, dup[0][c]) for c in cols)}; "
                         "aggregate first or pass a tie-break column")
    return df


def require_rows(df: DataFrame, what: str = "input") -> DataFrame:
    """Raise when nothing is left after cleaning (``isEmpty`` reads one row at most)."""
    if df.isEmpty():
        raise ValueError(f"no usable rows in {what} after cleaning")
    return df


def require_dates(df: DataFrame, date: str = "date", strict: bool = True) -> DataFrame:
    """All-null dates always raise; with ``strict`` any NULL date raises."""
    r = df.agg(F.count(date).alias("ok"), F.count(F.lit(1)).alias("n")).first()
    if r["ok"] == 0:
        raise ValueError(f"column {date!r} has only null or invalid values")
    if strict and r["ok"] != r["n"]:
        raise ValueError(f"{r['n'] - r['ok']} values in {date!r} could not be parsed")
    return df


def split_valid_dates(df: DataFrame, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """P14 quarantine form: (rows with a date, rows without)."""
    return df.where(F.col(date).isNotNull()), df.where(F.col(date).isNull())


def require_finite_target(df: DataFrame, target: str) -> DataFrame:
    """The target must not contain NULL or NaN."""
    bad = df.agg(F.count_if(F.col(target).isNull() | F.isnan(target)).alias("b")).first()["b"]
    if bad:
        raise ValueError(f"target column {target!r} contains {bad} NaN/NULL values")
    return df


def require_feature_count(n_given: int, n_expected: int) -> None:
    """Feature-count contract between an assembled row and a fitted model."""
    if n_given != n_expected:
        raise ValueError(f"feature count mismatch: {n_given} vs expected {n_expected}")


def head(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """O2: first ``n`` rows (in ``order`` when given)."""
    return (df.orderBy(*order) if order else df).limit(int(n))


def result_page(df: DataFrame, sort_col: str, page: int = 0, page_size: int = 10,
                descending: bool = False, filter_col: str | None = None,
                contains: str | None = None, tie_break: Sequence[str] = ()) -> DataFrame:
    """Filter any column by substring, sort any column, return one page.

    A unique ``tie_break`` makes pages stable. Spark plans ``orderBy + offset +
    limit`` as a top-K (TakeOrderedAndProject), so no full sort is shuffled.
    """
    out = df
    if filter_col and contains is not None:
        out = out.where(F.col(filter_col).cast("string").contains(contains))
    key = F.col(sort_col).desc_nulls_last() if descending else F.col(sort_col).asc_nulls_first()
    return (out.orderBy(key, *[F.col(c).asc() for c in tie_break])
            .offset(int(page) * int(page_size)).limit(int(page_size)))
