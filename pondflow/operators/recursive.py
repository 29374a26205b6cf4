"""Autoregressive multi-step forecast (W3-W8 features, M12-M16, Q6).

Training: lag / rolling / expanding / calendar features are window
expressions over ``W(keys)``; one pooled boosted-tree regressor is fitted for
all series (Spark ML, distributed).

Forecast: every future day depends on the previous prediction, so the steps
are sequential *within* a series but independent *across* series. The
fitted ensemble is exported once as small node arrays (size bounded by the
model parameters), broadcast, and walked in numpy inside
``cogroup(...).applyInPandas`` - one task per group of series, no
``transform`` call per step. Each group only receives its seed rows (the last
``max(lags, windows)`` values) and its future spine, so group size is bounded
by the model's memory and the horizon, never by the history length.

Defects of the reference (SURVEY §3, D1-D5) are fixed by default:
lags are newest-first at both fit and forecast time, std uses ddof=1 in both,
cumulative statistics carry the full history, the trend continues from the
last training row, and the forecast starts the day after the last
observation (then is cut to the requested range). ``compat=True`` reproduces
the reference's behaviour instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from pondflow.functions.dates import calendar_columns, month_end, month_start
from pondflow.keys import as_keys as _keys
from pondflow.operators import models as M
from pondflow.operators.boosting import RECURSIVE, Boosted, fit_boosted, keyed, prediction
from pondflow.operators.filters import require_feature_count
from pondflow.operators.lookup import cyclic_lookup
from pondflow.operators.series import date_spine
from pondflow.operators.windows import lag_features, last_n_rows
from pondflow.session import checkpoint_dir, stored

CAL = ["dayofyear_sin", "dayofyear_cos", "month_sin", "month_cos"]


def feature_names(exog: Sequence[str], lags: int, windows: Sequence[int]) -> list[str]:
    """Feature order shared by fit and forecast (M16: exogenous set is a parameter)."""
    return (CAL + ["trend", "cumulative_mean", "cumulative_std"] + list(exog)
            + [f"rolling_mean_{w}" for w in windows] + [f"rolling_std_{w}" for w in windows]
            + [f"lag_{i}" for i in range(1, lags + 1)])


def training_frame(hist: DataFrame, keys, y: str, exog: Sequence[str], lags: int = 120,
                   windows: Sequence[int] = (14, 30, 60), date: str = "date") -> DataFrame:
    """Feature rows for every history day with a full lag/rolling window (P6 after features)."""
    k = _keys(keys)
    w = Window.partitionBy(*k).orderBy(date)
    grow = w.rowsBetween(Window.unboundedPreceding, 0)
    cal = calendar_columns(date)
    cols = {c: cal[c] for c in CAL}
    cols["trend"] = (F.row_number().over(w) - 1).cast("double")
    cols["cumulative_mean"] = F.avg(y).over(grow)
    cols["cumulative_std"] = F.stddev_samp(y).over(grow)
    for n in windows:
        fr = w.rowsBetween(-(int(n) - 1), 0)
        full = F.count(y).over(fr) == int(n)
        cols[f"rolling_mean_{n}"] = F.when(full, F.avg(y).over(fr))
        cols[f"rolling_std_{n}"] = F.when(full, F.stddev_samp(y).over(fr))
    feats = feature_names(exog, lags, windows)
    out = lag_features(hist.withColumns(cols), k, y, lags, date=date).select(*k, date, y, *feats)
    ok = F.lit(True)
    for c in [y, *feats]:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c)
    return out.where(ok)


def _forecast_fn(bc, lo: np.ndarray, rng: np.ndarray, keys: list[str], y: str, exog: list[str],
                 lags: int, windows: list[int], compat: bool):
    """Per-group scoring loop. Trailing means/stds of the growing prediction list
    (A11; population std in ``compat`` mode, as the reference) feed each step; the
    result is a schema'd frame built from parallel columns (S9)."""
    span = max([lags, *windows])

    def fn(seed: pd.DataFrame, fut: pd.DataFrame) -> pd.DataFrame:
        if seed.empty or fut.empty:
            return pd.DataFrame(columns=[*keys, "date", "prediction"])
        trees = bc.value
        seed = seed.sort_values("date")
        fut = fut.sort_values("date").reset_index(drop=True)
        init = seed[y].to_numpy(dtype=float)[-span:]
        h = len(fut)
        buf = np.empty(len(init) + h)          # history tail followed by the predictions
        buf[:len(init)] = init
        m = len(init)
        first = fut.iloc[0]
        n, mean, m2 = float(first["_n"]), float(first["_mean"]), float(first["_m2"])
        trend0 = float(first["_n_train"] if compat else first["_last_trend"] + 1)
        ddof = 0 if compat else 1
        calx = fut[CAL].to_numpy(dtype=float)
        exx = fut[exog].to_numpy(dtype=float) if exog else np.empty((h, 0))
        nc, ne, nw = len(CAL), exx.shape[1], len(windows)
        x = np.empty(nc + 3 + ne + 2 * nw + lags)
        o_ex, o_rm = nc + 3, nc + 3 + ne
        o_lag = o_rm + 2 * nw
        for i in range(h):
            x[:nc] = calx[i]
            x[nc] = trend0 + i
            if compat:
                hist = buf[:m]                 # the reference keeps every value
                x[nc + 1], x[nc + 2] = hist.mean(), hist.std()
                lagv = buf[max(0, m - lags):m]
            else:
                x[nc + 1] = mean
                x[nc + 2] = math.sqrt(m2 / (n - 1)) if n > 1 else np.nan
                lagv = buf[max(0, m - lags):m][::-1]
            x[o_ex:o_rm] = exx[i]
            for j, w in enumerate(windows):
                win = buf[max(0, m - w):m]
                x[o_rm + j] = win.mean()
                x[o_rm + nw + j] = win.std(ddof=ddof) if len(win) > ddof else np.nan
            x[o_lag:o_lag + len(lagv)] = lagv
            x[o_lag + len(lagv):] = np.nan    # fewer predecessors than lags
            p = M.predict_trees(trees, (x - lo) / rng)
            buf[m] = p
            m += 1
            n += 1.0  # Welford update of the carried full-history statistics
            d = p - mean
            mean += d / n
            m2 += d * (p - mean)
        out = fut[[*keys, "date"]].copy()
        out["prediction"] = buf[len(init):]
        return out

    return fn


@dataclass
class RecursiveModel:
    """A fitted recursive forecaster: broadcast trees, scaler vectors and settings."""
    trees: object          # Broadcast of the node arrays
    lo: np.ndarray
    rng: np.ndarray
    keys: list[str]
    y: str
    exog: list[str]
    lags: int
    windows: list[int]
    train: DataFrame       # cached training frame (exogenous lookup, trend state)
    date: str = "date"


def fit_recursive(spark: SparkSession, hist: DataFrame, keys, y: str, exog: Sequence[str], lags: int = 120,
                  windows: Sequence[int] = (14, 30, 60), params: dict | None = None, date: str = "date",
                  model_path: str | None = None) -> RecursiveModel:
    """M12 fit: window features -> min-max scaling -> one pooled boosted-tree regressor,
    exported as bounded node arrays and broadcast once."""
    k = _keys(keys)
    exog = list(exog)
    windows = [int(w) for w in windows]
    feats = feature_names(exog, lags, windows)
    # cached: read by the fit, the scaler, the per-key state and the exogenous lookup
    train = training_frame(hist, k, y, exog, lags, windows, date).cache()
    stats = M.fit_minmax(train, feats)
    lo, hi = M.minmax_arrays(stats, feats)
    rng = np.where(hi == lo, 1.0, hi - lo)
    scaled = M.apply_minmax(train, stats, feats)
    model = M.fit_regressor(scaled, feats, y, params or M.GBT_RECURSIVE)
    require_feature_count(len(feats), M.tree_stage(model).numFeatures)  # P17
    path = model_path or f"{checkpoint_dir(spark).rstrip('/')}/pondflow-models/recursive-{model.uid}"
    trees = M.tree_arrays(spark, M.tree_stage(model), path)
    return RecursiveModel(spark.sparkContext.broadcast(trees), lo, rng, k, y, exog, lags, windows, train, date)


def fit_or_load_recursive(spark: SparkSession, hist: DataFrame, keys, y: str, exog: Sequence[str], root: str,
                          lags: int = 120, windows: Sequence[int] = (14, 30, 60), params: dict | None = None,
                          date: str = "date") -> RecursiveModel:
    """M9 for the recursive model: reuse the forest saved under ``root`` when it was
    fitted for the same feature list, parameters and history, else fit and save it there.

    Only the fitted ensemble and the scaler vectors are reused; the training
    frame (exogenous lookup, per-key state) is rebuilt from ``hist``.
    """
    import json

    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
    k = _keys(keys)
    windows = [int(w) for w in windows]
    feats = feature_names(list(exog), lags, windows)
    p = dict(params or M.GBT_RECURSIVE)
    tag = M.fit_tag(p, hist.select(*k, date, y, *exog), features=feats, y=y)
    folder = M.current_version(spark, root)
    if folder is None or json.loads(M.read_saved(spark, f"{folder}/meta"))["tag"] != tag:
        def write(at: str) -> None:
            rm = fit_recursive(spark, hist, k, y, exog, lags, windows, p, date, model_path=f"{at}/trees")
            meta = {"tag": tag, "lo": rm.lo.tolist(), "rng": rm.rng.tolist()}
            spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{at}/meta")
            rm.train.unpersist()

        folder = M.publish(spark, root, write)
    meta = json.loads(M.read_saved(spark, f"{folder}/meta"))
    model = (RandomForestRegressionModel if "numTrees" in p else GBTRegressionModel).load(f"{folder}/trees")
    trees = M.tree_arrays(spark, model, f"{folder}/trees", save=False)
    train = stored(training_frame(hist, k, y, list(exog), lags, windows, date), "train")
    return RecursiveModel(spark.sparkContext.broadcast(trees), np.array(meta["lo"]), np.array(meta["rng"]),
                          k, y, list(exog), lags, windows, train, date)


def _future(rm, hist: DataFrame, start_ym: str, end_ym: str, compat: bool, horizon_days: int | None, index_base: int):
    """What both ways to forecast start from: the last values of every series, its future days with calendar, exogenous values (J4) and
    state, the rows of series too short to forecast, and the condition for the days asked for."""
    k, y, exog, date = rm.keys, rm.y, rm.exog, rm.date
    span = max([rm.lags, *rm.windows])
    hist_y = hist.select(*k, date, y).where(F.col(y).isNotNull())
    state = hist_y.groupBy(*k).agg(
        F.count(y).cast("double").alias("_n"), F.avg(y).alias("_mean"),
        F.coalesce(F.var_samp(y) * (F.count(y) - 1), F.lit(0.0)).alias("_m2"),
        F.max(date).alias("_last"))
    tstate = rm.train.groupBy(*k).agg(F.max("trend").alias("_last_trend"),
                                      F.count(F.lit(1)).cast("double").alias("_n_train"))
    start, end = month_start(F.lit(start_ym)), month_end(F.lit(end_ym))
    first = start if compat else F.date_add("_last", 1)
    last = F.date_add("_last", int(horizon_days)) if horizon_days else end
    bounds = state.join(tstate, k).select(*k, first.alias("lo"), last.alias("hi"))
    fut = date_spine(bounds, k, "lo", "hi", out=date)
    fut = fut.join(bounds.select(*k, "lo"), k).withColumn("idx", F.datediff(date, "lo") + int(index_base))
    cal = calendar_columns(date)
    fut = fut.withColumns({c: cal[c] for c in CAL})
    fut = cyclic_lookup(fut, rm.train.select(*k, date, *exog), k, exog, idx="idx", date=date)  # J4
    fut = fut.join(state, k).join(tstate, k)
    fut = fut.select(*k, date, *CAL, *exog, "_n", "_mean", "_m2", "_last_trend", "_n_train")
    seed = last_n_rows(hist_y, k, span, date=date)  # O3
    asked = F.col(date).between(start, end)
    short = state.join(tstate, k, "left_anti").select(*k, first.alias("lo"), last.alias("hi"))
    short = short.toDF(*short.columns)
    short = (date_spine(short, k, "lo", "hi", out=date).where(asked)
             .select(*k, date, F.lit(None).cast("double").alias("prediction"), F.lit("series too short").alias("status")))
    return seed, fut, short, asked


def forecast_recursive(rm: RecursiveModel, hist: DataFrame, start_ym: str, end_ym: str,
                       compat: bool = False, horizon_days: int | None = None,
                       index_base: int = 0) -> DataFrame:
    """M14/M15 scoring: ``(keys…, date, prediction, status)`` over ``start_ym..end_ym``.

    Series too short for one full training row (lag window) are not dropped: their days come
    out with a NULL prediction and the status ``series too short``.

    ``horizon_days`` (M15) forecasts a fixed number of days after the last
    observation and then slices the requested range. ``index_base`` is where
    the cyclic exogenous lookup (J4) starts counting (0, or 1 in the older
    fixed-horizon variant).
    """
    k, y, exog, date = rm.keys, rm.y, rm.exog, rm.date
    seed, fut, short, span_dates = _future(rm, hist, start_ym, end_ym, compat, horizon_days, index_base)
    key_types = {f.name: f.dataType for f in hist.schema.fields if f.name in k}
    schema = Ty.StructType([Ty.StructField(c, key_types[c]) for c in k]
                           + [Ty.StructField(date, Ty.DateType()), Ty.StructField("prediction", Ty.DoubleType())])
    fn = _forecast_fn(rm.trees, rm.lo, rm.rng, k, y, exog, rm.lags, rm.windows, compat)
    # fresh attribute ids on both sides: they share lineage with ``hist``
    seed, fut = seed.toDF(*seed.columns), fut.toDF(*fut.columns)
    out = seed.groupBy(*k).cogroup(fut.groupBy(*k)).applyInPandas(fn, schema)
    return out.where(span_dates).withColumn("status", F.lit("forecast")).unionByName(short)


def recursive_forecast(spark: SparkSession, hist: DataFrame, keys, y: str, exog: Sequence[str],
                       start_ym: str, end_ym: str, lags: int = 120, windows: Sequence[int] = (14, 30, 60),
                       params: dict | None = None, compat: bool = False, date: str = "date",
                       model_path: str | None = None, horizon_days: int | None = None) -> DataFrame:
    """Fit on ``hist`` and forecast ``y`` per key over ``start_ym..end_ym``.

    ``hist`` is a daily series per key without gaps (use ``asfreq_daily`` +
    ``interpolate_time`` first, as the reference does).
    Returns ``(keys…, date, prediction, status)``.
    """
    rm = fit_recursive(spark, hist, keys, y, exog, lags, windows, params, date, model_path)
    return forecast_recursive(rm, hist, start_ym, end_ym, compat=compat, horizon_days=horizon_days)


# --- recursion as a column expression ----------------------------------------

@dataclass
class FoldedModel:
    """A keyed or pooled boosted ensemble over the recursive features (M12, M13), with what its forecasts start from."""
    model: Boosted
    keys: list[str]
    y: str
    exog: list[str]
    lags: int
    windows: list[int]
    train: DataFrame
    date: str = "date"


def fit_folded(hist: DataFrame, keys, y: str, exog: Sequence[str] = (), lags: int = 120, windows: Sequence[int] = (14, 30, 60),
               params: dict | None = None, date: str = "date", pooled: bool = False) -> FoldedModel:
    """Boosted trees on the lag, rolling, expanding, calendar and exogenous features: one ensemble per series, all
    grown in the same jobs, or with ``pooled`` one for all. ``boosting.RECURSIVE`` and ``RECURSIVE_KG`` are the reference's capacities.
    Trees split on order alone, so the features are not scaled."""
    k, exog, windows = _keys(keys), list(exog), [int(w) for w in windows]
    train = stored(training_frame(hist, k, y, exog, lags, windows, date), "train")
    model = fit_boosted(train, [] if pooled else k, feature_names(exog, lags, windows), y, RECURSIVE if params is None else params)
    return FoldedModel(model, k, y, exog, lags, windows, train, date)


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _step(fm: FoldedModel) -> str:
    """The state after one more day: features from the last values (A11), the ensemble's walk, the prediction appended."""
    def last(n: int) -> str:
        return f"slice(s.buf, greatest(size(s.buf) - {n - 1}, 1), {n})"

    def mean(w: str) -> str:
        return f"aggregate({w}, 0D, (a, v) -> a + v) / size({w})"

    means = [_let(last(w), "w", mean("w")) for w in fm.windows]
    stds = [_let(last(w), "w", _let(mean("w"), "m", "if(size(w) > 1, sqrt(aggregate(w, 0D, (a, v) -> a + (v - m) * (v - m)) / (size(w) - 1)), null)"))
            for w in fm.windows]
    parts = ["d.cal", "array(d.trend0 + s.i, s.mean, if(s.n > 1, sqrt(s.m2 / (s.n - 1)), null))", "d.exog",
             f"array({', '.join([*means, *stds])})" if means else "cast(array() as array<double>)", f"reverse({last(fm.lags)})"]
    walked = prediction(x="x", as_text=True)
    moved = ("struct(slice(concat(s.buf, array(p)), -least(size(s.buf) + 1, {span}), least(size(s.buf) + 1, {span})) as buf, s.i + 1D as i, s.n + 1D as n, "
             "s.mean + (p - s.mean) / (s.n + 1D) as mean, s.m2 + (p - s.mean) * (p - (s.mean + (p - s.mean) / (s.n + 1D))) as m2, "
             "concat(s.days, array(struct(d.date as date, p as prediction))) as days)").format(span=max([fm.lags, *fm.windows]))
    return _let(f"concat({', '.join(parts)})", "x", _let(walked, "p", moved))


def forecast_folded(fm: FoldedModel, hist: DataFrame, start_ym: str, end_ym: str, horizon_days: int | None = None, index_base: int = 0) -> DataFrame:
    """``(keys…, date, prediction, status)``, as ``forecast_recursive`` gives, without Python and without a limit on steps or rows.

    Each series is one row: its last values, its state and its future days. A fold over the days builds the features of a day, walks
    the trees and appends the prediction, so a series' work is its horizon and its memory the values it looks back on. (A recursive
    query would run one job a day over all series and stop at the session's level and row limits.) Series without an ensemble
    come out with a NULL prediction, like those too short.
    """
    k, date = fm.keys, fm.date
    seed, fut, short, asked = _future(fm, hist, start_ym, end_ym, False, horizon_days, index_base)
    values = seed.groupBy(*k).agg(F.transform(F.sort_array(F.collect_list(F.struct(date, F.col(fm.y).cast("double").alias("v")))), lambda r: r["v"]).alias("_seed"))
    day = F.struct(F.col(date).alias("date"), F.array(*[F.col(c).cast("double") for c in CAL]).alias("cal"),
                   F.array(*[F.col(c).cast("double") for c in fm.exog]).cast("array<double>").alias("exog"), (F.col("_last_trend") + 1).cast("double").alias("trend0"))
    days = fut.groupBy(*k).agg(F.sort_array(F.collect_list(day)).alias("_days"), *[F.first(c).alias(c) for c in ("_n", "_mean", "_m2")])
    rows = days.join(values.toDF(*values.columns), k)
    rows = keyed(rows, fm.model.table.select(*fm.model.keys, "base", "depth", "ensemble"), fm.model.keys, "left")
    start = ("struct(_seed as buf, 0D as i, _n as n, _mean as mean, _m2 as m2, cast(array() as array<struct<date: date, prediction: double>>) as days)")
    done = rows.select(*k, F.explode(F.expr(f"aggregate(_days, {start}, (s, d) -> {_step(fm)}).days")).alias("o"))
    out = done.select(*k, F.col("o.date").alias(date), F.col("o.prediction").alias("prediction")).where(asked)
    return out.withColumn("status", F.when(F.col("prediction").isNull(), "no model").otherwise("forecast")).unionByName(short)
