"""Forecast and scoring queries: Q1, Q2, Q5, Q6, Q10, Q11.

Q1/Q2 and Q11 take ``keys``: one forecast per series. They fit calendar-feature regressors (robust-scaled targets) and predict a
future date spine; Q5 scores supplied rows with a concentration model; Q6 is
the recursive forecast (``operators.recursive``); Q10 labels history and
forecast series for charts; Q11 is Q1 starting the day after the last
observation.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.functions import physics as ph
from pondflow.functions.numeric import minmax_inverse, minmax_transform
from pondflow.functions.dates import calendar_columns, month_end, month_start
from pondflow.operators import models as M
from pondflow.operators import stats as st
from pondflow.operators.boosting import CALENDAR, Boosted, fit_boosted, load_boosted, score_boosted
from pondflow.operators.filters import (date_range, drop_null_rows, month_range_with_fallback, require_columns,
                                        require_finite_target, require_rows)
from pondflow.operators.scan import running_sum
from pondflow.operators.series import date_spine, spine_after_last
from pondflow.session import checkpoint_dir, stored
from pondflow.sources.sinks import labelled_union

FEATURES = M.CALENDAR_FEATURES


@dataclass
class CalendarModel:
    """Fitted calendar regressors: X scaler, per-target Y scalers, models, feature ranges.

    With ``keys`` one pooled model per target serves every series: targets are scaled per key, and
    ``signals`` (a row per key: mean and deviation of its scaled targets over the training rows) are
    features beside the calendar.
    """
    x_stats: DataFrame
    y_stats: dict[str, DataFrame]
    models: dict[str, PipelineModel]
    ranges: DataFrame
    keys: tuple[str, ...] = ()
    signals: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return _features(list(self.models), self.keys)


def _features(targets: Sequence[str], keys: Sequence[str]) -> list[str]:
    return FEATURES + ([f"key_{s}_{t}" for t in targets for s in ("mean", "std")] if keys else [])


def with_calendar(df: DataFrame, date: str = "date") -> DataFrame:
    """F5 + F7: Day, Month, Year, Month_sin, Month_cos."""
    cal = calendar_columns(date, day_of_year=False)
    return df.withColumns({c: cal[c] for c in FEATURES})


def calendar_history(hist: DataFrame, targets: Sequence[str], date: str = "date") -> DataFrame:
    """The rows a calendar model learns from: calendar features added (F5, F7), required columns
    present (P11), rows with blanks dropped (P5), something left (P12), finite targets (P16)."""
    df = with_calendar(hist, date)
    require_columns(df, [*targets, *FEATURES])
    df = require_rows(drop_null_rows(df, [*targets, *FEATURES]), "history")
    for t in targets:
        require_finite_target(df, t)
    return df


def fit_calendar_models(hist: DataFrame, targets: Sequence[str], date: str = "date",
                        params: dict | None = None, test_fraction: float = 0.1,
                        threads: int = 8, keys: Sequence[str] = ()) -> CalendarModel:
    """M2-M5: calendar features -> min-max X; robust min-max Y per target and key; one tree ensemble
    per target, for all series of ``keys`` together."""
    k = list(keys)
    checkpoint_dir(hist.sparkSession)
    df = calendar_history(hist, targets, date).cache()  # read by every statistic below
    try:
        x_stats = M.fit_minmax(df, FEATURES).checkpoint()  # A8
        ranges = st.feature_ranges(df, [], FEATURES).checkpoint()  # A5
        with ThreadPoolExecutor(max_workers=max(1, min(threads, len(targets)))) as ex:  # independent jobs: A6 + P10 + A8
            y_stats = dict(zip(targets, ex.map(lambda t: st.robust_minmax_fit(df, k, t).checkpoint(), targets)))
        scaled = _attach(M.apply_minmax(df, x_stats, FEATURES), y_stats, k)
        scaled = scaled.withColumns({t: minmax_transform(t, f"{t}_min", f"{t}_max") for t in targets})  # F24 (outliers fall outside [0,1])
        train, _ = M.hash_split(scaled, [*k, date], test_fraction)  # M1
        signals = None
        if k:
            signals = train.groupBy(*k).agg(*[x for t in targets for x in (
                F.avg(t).alias(f"key_mean_{t}"), F.coalesce(F.stddev_samp(t), F.lit(0.0)).alias(f"key_std_{t}"))]).checkpoint()
            train = st.join_small(train, signals, k)
        models = M.fit_many(train, _features(targets, k), list(targets), params or M.GBT_CALENDAR, threads=threads)  # M4
    finally:
        df.unpersist()
    return CalendarModel(x_stats, y_stats, models, ranges, tuple(k), signals)


def _attach(df: DataFrame, y_stats: dict[str, DataFrame], keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``df`` with the ``<target>_min`` and ``<target>_max`` of every target, in one join on the keys."""
    one = list(keys) or ["_one"]
    tables = [t if keys else t.withColumn("_one", F.lit(1)) for t in y_stats.values()]
    wide = functools.reduce(lambda x, y: x.join(y, one), tables)
    return st.join_small(df, wide.drop("_one"), list(keys), how)


@dataclass
class StackedModel:
    """Second-order ensembles for every (key, target): ``scalers`` has each one's target range, ``ranges`` the features' (A5)."""
    model: Boosted
    scalers: DataFrame
    ranges: DataFrame
    keys: list[str]
    targets: list[str]


def _stacked(df: DataFrame, keys: Sequence[str], targets: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    """One row per target: (keys…, more…, target, y)."""
    each = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in targets])
    return df.select(*keys, *more, F.inline(each))


def fit_stacked_calendar(hist: DataFrame, targets: Sequence[str], keys: Sequence[str] = (), date: str = "date", params: dict | None = None,
                         test_fraction: float = 0.1) -> StackedModel:
    """M2-M5 with second-order boosting: the target is one more key, so the trees of all targets and series grow in the same jobs.

    Rows, split and robust target scaling are those of ``fit_calendar_models``; features are not scaled, as trees split on order alone.
    """
    k, targets = list(keys), list(targets)
    df = stored(calendar_history(hist, targets, date), "history")
    long = _stacked(df, k, targets, [date, *FEATURES])
    scalers = stored(st.robust_minmax_fit(long, [*k, "target"], "y"), "scalers")  # A6 + P10 + A8, all targets in one pass
    train, _ = M.hash_split(long, [*k, date], test_fraction)  # M1
    scaled = st.join_small(train, scalers, [*k, "target"]).withColumn("y", minmax_transform("y", "y_min", "y_max"))  # F24
    return StackedModel(fit_boosted(scaled, [*k, "target"], FEATURES, "y", params or CALENDAR), scalers,
                        st.feature_ranges(df, [], FEATURES), k, targets)


def predict_stacked(sm: StackedModel, future: DataFrame, date: str = "date") -> DataFrame:
    """M7: (keys…, date, calendar, targets…): every target of every row of ``future``, inverse-scaled; NULL for keys not seen."""
    k = sm.keys
    rows = with_calendar(future, date).select(*k, date, *FEATURES, F.explode(F.array(*[F.lit(t) for t in sm.targets])).alias("target"))
    out = score_boosted(sm.model, st.join_small(rows, sm.scalers, [*k, "target"], "left"))
    out = out.withColumn("y", minmax_inverse("prediction", "y_min", "y_max"))
    return out.groupBy(*k, date, *FEATURES).agg(*[F.max(F.when(F.col("target") == t, F.col("y"))).alias(t) for t in sm.targets])


def save_calendar_model(spark: SparkSession, cm: CalendarModel, root: str, tag: str = "") -> None:
    """K5: models through the registry, scaler statistics and feature ranges as Parquet, all in one published version."""
    def write(folder: str) -> None:
        reg = M.ModelRegistry(spark, folder)
        for t, m in cm.models.items():
            reg.save(f"model-{t}", m, cm.features, tag)
        cm.x_stats.write.parquet(f"{folder}/x_stats")
        cm.ranges.write.parquet(f"{folder}/ranges")
        if cm.signals is not None:
            cm.signals.write.parquet(f"{folder}/signals")
        for t, df in cm.y_stats.items():
            df.write.parquet(f"{folder}/y_stats-{t}")
        spark.createDataFrame([(",".join(cm.models),)], "value string").coalesce(1).write.text(f"{folder}/targets")

    M.publish(spark, root, write)


def load_calendar_model(spark: SparkSession, root: str, targets: Sequence[str], tag: str = "",
                        keys: Sequence[str] = ()) -> CalendarModel | None:
    """The saved bundle, or None when absent or saved for other targets, features,
    parameters or data (M10); a bundle that cannot be read raises."""
    root = M.current_version(spark, root)
    saved = M.read_saved(spark, f"{root}/targets") if root else None
    if saved is None or saved.split(",") != list(targets):
        return None
    reg = M.ModelRegistry(spark, root)
    models = {}
    for t in targets:
        got = reg.load(f"model-{t}")
        if got is None or got[1:] != (_features(targets, keys), tag):
            return None
        models[t] = got[0]
    return CalendarModel(spark.read.parquet(f"{root}/x_stats"),
                         {t: spark.read.parquet(f"{root}/y_stats-{t}") for t in targets},
                         models, spark.read.parquet(f"{root}/ranges"), tuple(keys),
                         spark.read.parquet(f"{root}/signals") if keys else None)


def calendar_models(spark: SparkSession, hist: DataFrame, targets: Sequence[str], root: str,
                    **kw) -> CalendarModel:
    """M9: load the bundle under ``root`` when it was fitted with the same options on the same
    history (which is scanned for its fingerprint), else fit and save it."""
    tag = M.fit_tag(kw.get("params"), hist, **{n: v for n, v in kw.items() if n not in ("params", "threads")})
    keys = kw.get("keys", ())
    cm = load_calendar_model(spark, root, targets, tag, keys)
    if cm is None:
        cm = fit_calendar_models(hist, targets, **kw)
        save_calendar_model(spark, cm, root, tag)
    return cm


def predict_calendar(cm: CalendarModel, future: DataFrame, date: str = "date") -> DataFrame:
    """M7: scale X, predict every target, inverse-scale each prediction. Rows of a key the model has
    not seen come out with NULL predictions."""
    k = list(cm.keys)
    df = with_calendar(future, date)
    raw = {f"_raw_{c}": F.col(c) for c in FEATURES}
    out = M.apply_minmax(df.withColumns(raw), cm.x_stats, FEATURES)  # scaled in place for the models
    extra = [c for c in cm.features if c not in FEATURES]
    if k:
        out = st.join_small(out, cm.signals, k, "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in extra})
    for t, m in cm.models.items():
        out = m.transform(out).drop("_features")
    out = _attach(out, cm.y_stats, k, "left" if k else "inner")
    out = out.withColumns({t: minmax_inverse(f"pred_{t}", f"{t}_min", f"{t}_max") for t in cm.models})
    used = [f"{a}{t}{b}" for t in cm.models for a, b in (("pred_", ""), ("", "_min"), ("", "_max"))]
    return out.withColumns({c: F.col(f"_raw_{c}") for c in FEATURES}).drop(*raw, *extra, *used)


def _month_spine(spark: SparkSession, cm: CalendarModel | StackedModel, start_ym: str, end_ym: str) -> DataFrame:
    """The days of the month range, for every key of the model."""
    table = cm.scalers if isinstance(cm, StackedModel) else cm.signals
    series = table.select(*cm.keys).distinct() if cm.keys else spark.range(1)
    bounds = series.withColumns({"lo": month_start(F.lit(start_ym)), "hi": month_end(F.lit(end_ym))})
    return date_spine(bounds, list(cm.keys), "lo", "hi")


def _predict(cm: CalendarModel | StackedModel, future: DataFrame, date: str = "date") -> DataFrame:
    return predict_stacked(cm, future, date) if isinstance(cm, StackedModel) else predict_calendar(cm, future, date)


def _penman() -> Column:
    return ph.penman("slope", "psychrometric_constant", "radiation_based_evaporation", "aerodynamics_evaporation")  # F19


def forecast_evaporation(spark: SparkSession, cm: CalendarModel | StackedModel, start_ym: str, end_ym: str,
                         mode: str = "a") -> tuple[DataFrame, DataFrame]:
    """Q1: spine over the month range per key, target predictions, Penman evaporation.

    ``mode='b'`` (pond) emits each key's running sum of evaporation (W2). Returns the
    forecast and the out-of-range report (P15).
    """
    future = _month_spine(spark, cm, start_ym, end_ym)
    report = st.out_of_range(with_calendar(future), cm.ranges, FEATURES)
    out = _predict(cm, future).withColumn("evaporation", _penman())
    if mode != "a":
        out = cumulative_evaporation(out, cm.keys)
    return out, report


def cumulative_evaporation(daily: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``evaporation`` as each key's running sum by date."""
    if keys:
        return running_sum(daily, list(keys), "evaporation", "evaporation")
    return running_sum(daily.withColumn("_k", F.lit(1)), ["_k"], "evaporation", "evaporation").drop("_k")


def forecast_after_last(spark: SparkSession, cm: CalendarModel | StackedModel, hist: DataFrame, n_days: int,
                        date: str = "date") -> DataFrame:
    """Q11: Q1 for the ``n_days`` after each key's last observed date (A7 + S8)."""
    k = list(cm.keys) or ["_k"]
    future = spine_after_last(hist if cm.keys else hist.withColumn("_k", F.lit(1)), k, n_days, date=date)
    return _predict(cm, future.drop("_k"), date).withColumn("evaporation", _penman())


def forecast_water_level(spark: SparkSession, cm: CalendarModel | StackedModel, start_ym: str, end_ym: str) -> DataFrame:
    """Q2: one calendar regressor for ``wl`` over the month range, per key."""
    return _predict(cm, _month_spine(spark, cm, start_ym, end_ym))


CONC_FEATURES = ["brine_in", "brine_out", "initial_concentration", *FEATURES]


def fit_concentration_model(train: DataFrame, label: str = "final_concentration", date: str = "date",
                            keys: Sequence[str] = (), params: dict | None = None,
                            test_fraction: float = 0.2) -> PipelineModel:
    """M6: raw (unscaled) flow + opening concentration + calendar features, median-imputed."""
    df = with_calendar(train, date).where(F.col(label).isNotNull())
    tr, _ = M.hash_split(df, [*keys, date], test_fraction)
    p = dict(params or M.GBT_CALENDAR)
    return M.fit_regressor(tr, CONC_FEATURES, label, p, impute=True, prediction="predicted_final")


def score_final_concentration(model: PipelineModel, rows: DataFrame, start_ym: str | None,
                              end_ym: str | None, keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Q5: P8 range filter with fallback, then score every remaining row (M8)."""
    df = with_calendar(rows.where(F.col(date).isNotNull()), date)  # P14 quarantine: undated rows skipped
    df = month_range_with_fallback(df, list(keys), start_ym, end_ym, date)
    df = M.with_null_indicators(df.withColumns({c: F.col(c).cast("double") for c in CONC_FEATURES}), CONC_FEATURES)
    scored = model.transform(df)
    return scored.select(*keys, date, *CONC_FEATURES, "predicted_final")


def fit_site_concentration(train: DataFrame, keys: Sequence[str], label: str = "final_concentration", date: str = "date",
                           params: dict | None = None, test_fraction: float = 0.2) -> Boosted:
    """M6 per site: one second-order ensemble for every key, all grown in the same jobs. Blank inputs stay blank."""
    df = with_calendar(train, date).where(F.col(label).isNotNull())
    tr, _ = M.hash_split(df, [*keys, date], test_fraction)  # M1
    return fit_boosted(tr, keys, CONC_FEATURES, label, params or CALENDAR)


def site_concentration_model(spark: SparkSession, train: DataFrame, keys: Sequence[str], root: str, params: dict | None = None) -> Boosted:
    """M9: the ensembles published under ``root`` when they were fitted with the same parameters on the same rows, else fitted and published."""
    tag = M.fit_tag(params, train, keys=list(keys), features=CONC_FEATURES)
    folder = M.current_version(spark, root)
    if folder and M.read_saved(spark, f"{folder}/tag") == tag:
        return load_boosted(spark, f"{folder}/ensembles", keys, CONC_FEATURES)
    model = fit_site_concentration(train, keys, params=params)

    def write(folder: str) -> None:
        model.save(f"{folder}/ensembles")
        spark.createDataFrame([(tag,)], "value string").coalesce(1).write.text(f"{folder}/tag")

    return load_boosted(spark, f"{M.publish(spark, root, write)}/ensembles", keys, CONC_FEATURES)


def score_site_concentration(model: Boosted, rows: DataFrame, start_ym: str | None, end_ym: str | None, date: str = "date") -> DataFrame:
    """Q5: P8 range filter with fallback, then every remaining row by its own site's ensemble (M8); sites without one get NULL."""
    df = with_calendar(rows.where(F.col(date).isNotNull()), date)  # P14 quarantine: undated rows skipped
    df = month_range_with_fallback(df, model.keys, start_ym, end_ym, date)
    return score_boosted(model, df, "predicted_final").select(*model.keys, date, *CONC_FEATURES, "predicted_final")


def compare_series(history: DataFrame, forecast: DataFrame, start, end, y: str,
                   keys: Sequence[str] = (), date: str = "date") -> DataFrame:
    """Q10: history (P6 + P7) and forecast as one labelled long frame."""
    h = date_range(drop_null_rows(history.select(*keys, date, y)), start, end, date)
    f = forecast.select(*keys, date, F.col(y))
    return labelled_union({"history": h, "forecast": f}).select(*keys, "trace", F.col(date).alias("x"),
                                                                   F.col(y).alias("y"))
