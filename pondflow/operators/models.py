"""Regressors (M1-M13, K5, S10) on Spark ML.

Parameters with ``maxIter`` fit boosted trees, those with ``numTrees`` a random forest, whose
trees grow together: its jobs grow with the depth and not with the number of trees. Boosted trees are Spark's ``GBTRegressor`` with the reference's capacity
knobs; they are not XGBoost (per-node column sampling, first-order gain, no
base score), so equal *capability* is claimed, not equal numbers.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.functions.numeric import minmax_inverse, minmax_transform

SEED = 42  # M17
# ---------------------------------------------------------------------------
# Model capacity as configured in the reference.
# ---------------------------------------------------------------------------
GBT_CALENDAR = dict(maxIter=200, stepSize=0.05, maxDepth=5, subsamplingRate=0.8,
                    featureSubsetStrategy="0.8", seed=SEED)               # M3-M6
GBT_RECURSIVE = dict(maxIter=300, stepSize=0.05, maxDepth=6, subsamplingRate=0.9, seed=SEED)  # M12
GBT_RECURSIVE_KG = dict(maxIter=300, stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
                        featureSubsetStrategy="0.8", minInfoGain=0.1, seed=SEED)  # M13
# The same tree count, depth and sampling for a forest; maxMemoryInMB bounds a task's histograms.
FOREST_CALENDAR = dict(numTrees=200, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8", maxMemoryInMB=64, seed=SEED)
CALENDAR_FEATURES = ["day", "month", "year", "month_sin", "month_cos"]
EVAPORATION_TARGETS = ["solar_irradiance", "slope", "saturation_vapour", "actual_vapour", "wind_speed",
                       "radiation_based_evaporation", "aerodynamics_evaporation", "psychrometric_constant"]
PENMAN_TARGETS = ["slope", "psychrometric_constant", "radiation_based_evaporation", "aerodynamics_evaporation"]
# ---------------------------------------------------------------------------

# Upper bound on nodes collected from a fitted ensemble (trees * 2^(depth+1)).
MAX_MODEL_NODES = 2_000_000
# Training rows per partition: at least the first (tree fitting runs many small jobs), at most the second.
FIT_PARTITION_ROWS = (1_000, 200_000)


def sized_for_fit(df: DataFrame, rows: tuple[int, int] = FIT_PARTITION_ROWS) -> DataFrame:
    """Repartition a training frame over all cores, with ``rows`` per partition at least and at
    most (more partitions than cores for large frames), and cache it for the many passes of a fit."""
    n = df.count()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(1, min(cores, n // rows[0]), -(-n // rows[1]))).cache()


def hash_split(df: DataFrame, cols: Sequence[str], test_fraction: float = 0.1,
               seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """M1: deterministic train/test split by an MD5 bucket of ``cols`` and ``seed``.

    Stable under repartitioning and re-execution (``randomSplit`` is not), and
    needs no shuffle.
    """
    digest = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))
    b = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000
    cut = int(round((1.0 - test_fraction) * 10_000))
    return df.where(b < cut), df.where(b >= cut)


def with_null_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``_isnull_<f>`` = 1.0 where a feature is NULL/NaN, so imputed rows stay distinguishable."""
    return df.withColumns({f"_isnull_{c}": (F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).cast("double")
                           for c in features})


def fit_regressor(df: DataFrame, features: Sequence[str], label: str, params: dict | None = None,
                  impute: bool = False, prediction: str = "prediction") -> PipelineModel:
    """Assemble ``features`` and fit boosted trees (``maxIter``) or a forest (``numTrees``).

    ``impute=True`` adds median imputation plus one null-indicator column per
    feature (Spark's GBT rejects NULL/NaN where XGBoost routes them; M6 inputs
    contain blanks). Score with :func:`score` / ``transform`` on a frame passed
    through :func:`with_null_indicators` the same way (``score`` does it).
    """
    p = dict(GBT_CALENDAR if params is None else params)
    feats = list(features)
    stages = []
    if impute:
        df = with_null_indicators(df, feats)
        imp_out = [f"_imp_{c}" for c in feats]
        stages.append(Imputer(inputCols=feats, outputCols=imp_out, strategy="median"))
        feats = imp_out + [f"_isnull_{c}" for c in features]
    stages.append(VectorAssembler(inputCols=feats, outputCol="_features", handleInvalid="error"))
    kind = RandomForestRegressor if "numTrees" in p else GBTRegressor
    stages.append(kind(featuresCol="_features", labelCol=label, predictionCol=prediction, **p))
    own = not df.is_cached
    cast = df.withColumns({c: F.col(c).cast("double") for c in features})
    if own:
        cast = sized_for_fit(cast)
    try:
        return Pipeline(stages=stages).fit(cast)
    finally:
        if own:
            cast.unpersist()


def fit_many(df: DataFrame, features: Sequence[str], labels: Sequence[str], params: dict | None = None,
             impute: bool = False, threads: int = 8) -> dict[str, PipelineModel]:
    """M4: one regressor per target over a shared (cached) feature frame.

    The fits are independent Spark jobs, so they are submitted from a thread
    pool and run concurrently on the cluster.
    """
    shared = sized_for_fit(df.withColumns({c: F.col(c).cast("double") for c in features}))
    try:
        with ThreadPoolExecutor(max_workers=max(1, min(threads, len(labels)))) as ex:
            futs = {t: ex.submit(fit_regressor, shared, features, t, params, impute, f"pred_{t}")
                    for t in labels}
            return {t: f.result() for t, f in futs.items()}
    finally:
        shared.unpersist()


def fit_per_key(df: DataFrame, keys: Sequence[str], features: Sequence[str], label: str,
                params: dict | None = None, impute: bool = False, threads: int = 8) -> dict[tuple, PipelineModel]:
    """M6/M9 per site: one model per key value, ``threads`` of them fitted at a time.

    The driver holds the key values and one model each, so the work grows with the
    number of keys; where sites are many, :func:`with_key_signal` gives one pooled
    model the sites' own statistics instead.
    """
    keys = list(keys)
    values = [tuple(r) for r in df.select(*keys).distinct().toLocalIterator()]

    def one(v):
        cond = F.lit(True)
        for c, x in zip(keys, v):
            cond = cond & (F.col(c) == F.lit(x))
        return fit_regressor(df.where(cond), features, label, params, impute)

    with ThreadPoolExecutor(max_workers=max(1, min(threads, len(values)))) as ex:
        futs = {v: ex.submit(one, v) for v in values}
        return {v: f.result() for v, f in futs.items()}


def score_per_key(models: dict[tuple, PipelineModel], df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Score each key's rows with its own model.

    Every row comes out: ``status`` is ``scored``, or ``no model`` with a NULL
    prediction for keys (null ones too) that no model was fitted for.
    """
    keys = list(keys)
    out, known = None, F.lit(False)
    for v, m in models.items():
        cond = F.lit(True)
        for c, x in zip(keys, v):
            cond = cond & F.col(c).eqNullSafe(F.lit(x))
        known = known | cond
        part = score(m, df.where(cond)).withColumn("status", F.lit("scored"))
        out = part if out is None else out.unionByName(part)
    rest = df.where(~known).withColumns({"status": F.lit("no model"), "prediction": F.lit(None).cast("double")})
    return rest if out is None else out.unionByName(rest, allowMissingColumns=True)


def with_key_signal(df: DataFrame, train: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Append ``key_mean``, ``key_std`` and ``key_rows`` of ``label``, computed per key on the training
    part only, so one pooled model can tell any number of sites apart. Rows of keys without
    training rows stay, with NULL statistics and 0 rows."""
    k = list(keys)
    stats = (train.where(F.col(label).isNotNull()).groupBy(*k)
             .agg(F.avg(label).alias("key_mean"), F.stddev_samp(label).alias("key_std"), F.count(F.lit(1)).alias("key_rows")))
    return df.join(stats, k, "left").withColumn("key_rows", F.coalesce("key_rows", F.lit(0)))



def score(models: dict[str, PipelineModel] | PipelineModel, df: DataFrame,
          keep: Sequence[str] | None = None) -> DataFrame:
    """M7/M8: chained ``transform`` of one or many fitted models.

    Pipelines fitted with ``impute=True`` get their null-indicator columns here.
    """
    from pyspark.ml.feature import ImputerModel
    out = df
    if isinstance(models, PipelineModel):
        models = {"": models}
    for _, m in models.items():
        for st in m.stages:
            if isinstance(st, ImputerModel):
                cols = st.getInputCols()
                out = with_null_indicators(out.withColumns({c: F.col(c).cast("double") for c in cols}), cols)
        out = m.transform(out)
        out = out.drop(*[c for c in out.columns if c.startswith("_")])
    return out.select(*keep) if keep else out


def ea_scaling_constant(df: DataFrame, wind: str, es: str, ea: str, target: str, keys=()) -> DataFrame:
    """Slope K of ``target ~ aerodynamic_base(wind, es, ea)`` (least squares with intercept).

    One partial+final aggregate (``regr_slope``) instead of a fitted estimator.
    """
    from pondflow.functions.physics import aerodynamic_base
    base = df.where(F.col(wind).isNotNull() & F.col(es).isNotNull() & F.col(ea).isNotNull()
                    & F.col(target).isNotNull())
    base = base.withColumn("_ea_base", aerodynamic_base(wind, es, ea))
    return base.groupBy(*keys).agg(F.regr_slope(F.col(target), F.col("_ea_base")).alias("k"))


# --- scaling statistics (A8, F24, M2) ---------------------------------------

def fit_minmax(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One-row statistics frame ``<f>_min``, ``<f>_max`` for every feature."""
    aggs = []
    for c in features:
        aggs += [F.min(F.col(c).cast("double")).alias(f"{c}_min"), F.max(F.col(c).cast("double")).alias(f"{c}_max")]
    return df.agg(*aggs)


def apply_minmax(df: DataFrame, stats: DataFrame, features: Sequence[str], suffix: str = "",
                 inverse: bool = False) -> DataFrame:
    """F24 with a one-row statistics frame (attached by a broadcast constant-key join)."""
    from pondflow.operators.stats import attach_one_row
    fn = minmax_inverse if inverse else minmax_transform
    j = attach_one_row(df, stats)
    j = j.withColumns({f"{c}{suffix}": fn(c, f"{c}_min", f"{c}_max") for c in features})
    return j.drop(*[f"{c}_{s}" for c in features for s in ("min", "max")])


def minmax_arrays(stats: DataFrame, features: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fitted scaler as two small numpy vectors (one row, bounded by #features)."""
    row = stats.first()
    lo = np.array([row[f"{c}_min"] for c in features], dtype=float)
    hi = np.array([row[f"{c}_max"] for c in features], dtype=float)
    return lo, hi


# --- persistence and registry (K5, S10, M9, M10) ----------------------------

def publish(spark: SparkSession, root: str, write: Callable[[str], None]) -> str:
    """K5: let ``write`` fill a new version folder under ``root``, then name it in the manifest ``root/current`` by one rename.

    Until that rename the version before stays current and whole, so a save that breaks half-way loses nothing; readers of the
    version before keep their files until the next save but one.
    """
    root = root.rstrip("/")
    before = read_saved(spark, f"{root}/current")
    version = f"v-{uuid.uuid4().hex}"
    write(f"{root}/{version}")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(conf)
    fresh = path(f"{root}/.current-{version}")
    out = fs.create(fresh, True)
    out.write(bytearray(f"{version}\n".encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(root).toUri(), conf).rename(
        fs.makeQualified(fresh), fs.makeQualified(path(f"{root}/current")), how)
    for found in fs.listStatus(path(root)):
        name = found.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            fs.delete(found.getPath(), True)
    return f"{root}/{version}"


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that was published last under ``root``, or None."""
    name = read_saved(spark, f"{root.rstrip('/')}/current")
    return None if name is None else f"{root.rstrip('/')}/{name}"


class ModelRegistry:
    """Fitted pipelines under ``root/<name>`` plus their feature list (M9/M10), saved in versions (see ``publish``).

    Everything goes through Spark's file systems, so ``root`` can be any shared Hadoop
    path (it must be shared storage on a cluster).
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def save(self, name: str, model: PipelineModel, features: Sequence[str], tag: str = "") -> None:
        def write(folder: str) -> None:
            model.write().save(f"{folder}/model")
            meta = self.spark.createDataFrame([(json.dumps({"features": list(features), "tag": tag}),)], "value string")
            meta.coalesce(1).write.text(f"{folder}/features")

        publish(self.spark, f"{self.root}/{name}", write)

    def load(self, name: str) -> tuple[PipelineModel, list[str], str] | None:
        """(model, features, tag), or None when nothing is saved under the name; other errors are raised."""
        folder = current_version(self.spark, f"{self.root}/{name}")
        if folder is None:
            return None
        meta = json.loads(read_saved(self.spark, f"{folder}/features"))
        return PipelineModel.load(f"{folder}/model"), meta["features"], meta["tag"]

    def load_or_fit(self, name: str, features: Sequence[str], fit: Callable[[], PipelineModel],
                    params: dict | None = None, data: DataFrame | None = None) -> PipelineModel:
        """M9 + M10: reuse a saved model when its features, parameters and training data are the
        same, else refit and save it. ``data`` is scanned each time for its fingerprint."""
        tag = fit_tag(params, data)
        got = self.load(name)
        if got is not None and got[1:] == (list(features), tag):
            return got[0]
        model = fit()
        self.save(name, model, features, tag)
        return model


def read_saved(spark: SparkSession, path: str) -> str | None:
    """The one line saved at ``path``, or None where the path does not exist."""
    from pyspark.errors import AnalysisException
    try:
        row = spark.read.text(path).first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return row[0] if row is not None else None


def fingerprint(df: DataFrame) -> str:
    """Row count and the sum of the rows' hashes: the same for the same rows in any order."""
    n, h = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))).first()
    return f"{n}:{h}"


def fit_tag(params: dict | None, data: DataFrame | None, **more) -> str:
    """What a fit depends on besides its features, as text."""
    return json.dumps({"params": params, "data": None if data is None else fingerprint(data), **more}, sort_keys=True, default=str)


# --- tree ensemble export for in-task scoring (M14) -------------------------

Ensemble = GBTRegressionModel | RandomForestRegressionModel


def tree_stage(model: PipelineModel) -> Ensemble:
    for s in model.stages:
        if isinstance(s, Ensemble):
            return s
    raise ValueError("pipeline has no tree ensemble stage")


def tree_arrays(spark: SparkSession, model: Ensemble, path: str,
                save: bool = True) -> dict[str, np.ndarray]:
    """Flatten a fitted ensemble into node arrays for numpy scoring.

    The model is saved to ``path`` (shared storage; ``save=False`` when it is
    already there) and its node table read back. Its size is bounded by
    ``trees * 2^(maxDepth+1)`` nodes and checked against ``MAX_MODEL_NODES``
    before it is collected.
    """
    if save:
        model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data")
    n = nodes.count()
    if n > MAX_MODEL_NODES:
        raise ValueError(f"ensemble has {n} nodes, above the {MAX_MODEL_NODES} broadcast bound")
    pdf = nodes.select("treeID", F.col("nodeData.id").alias("id"), F.col("nodeData.prediction").alias("pred"),
                       F.col("nodeData.leftChild").alias("left"), F.col("nodeData.rightChild").alias("right"),
                       F.col("nodeData.split.featureIndex").alias("feat"),
                       F.col("nodeData.split.leftCategoriesOrThreshold").alias("thr")).toPandas()
    pdf = pdf.sort_values(["treeID", "id"]).reset_index(drop=True)
    trees = sorted(pdf["treeID"].unique())
    sizes = pdf.groupby("treeID").size().reindex(trees).to_numpy()
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    off = offsets[np.searchsorted(trees, pdf["treeID"].to_numpy())]
    leaf = pdf["left"].to_numpy() < 0
    idx = np.arange(len(pdf))
    left = np.where(leaf, idx, pdf["left"].to_numpy() + off)
    right = np.where(leaf, idx, pdf["right"].to_numpy() + off)
    feat = np.where(leaf, 0, pdf["feat"].to_numpy())
    thr = np.array([t[0] if (t is not None and len(t)) else np.inf for t in pdf["thr"]], dtype=float)
    thr = np.where(leaf, np.inf, thr)
    return {"root": offsets.astype(np.int64), "left": left.astype(np.int64), "right": right.astype(np.int64),
            "feat": feat.astype(np.int64), "thr": thr, "value": pdf["pred"].to_numpy(dtype=float),
            "weight": np.asarray(model.treeWeights, dtype=float) / (len(trees) if isinstance(model, RandomForestRegressionModel) else 1),
            "depth": np.int64(model.getOrDefault("maxDepth"))}


def predict_trees(t: dict[str, np.ndarray], x: np.ndarray) -> float:
    """Score one feature vector against all trees at once (vectorised over trees)."""
    node = t["root"].copy()
    for _ in range(int(t["depth"]) + 1):
        go_left = x[t["feat"][node]] <= t["thr"][node]
        node = np.where(go_left, t["left"][node], t["right"][node])
    return float(np.dot(t["weight"], t["value"][node]))
