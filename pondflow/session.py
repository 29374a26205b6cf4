"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Settings every pondflow job relies on. Dates are parsed explicitly and all
# timestamps are read in UTC so that Spark and the DuckDB oracle agree.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    # checkpointed statistics tables are deleted once no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_tb: float = 100.0, executors: int = 1000, cores_per_executor: int = 4) -> dict:
    """Settings for a large cluster run (e.g. 100 TB over 1000 executors).

    * initial shuffle partitions sized for ~128 MB partitions, assuming map-side
      combining shrinks the scanned volume about 8x before the shuffle, and never
      fewer than two per core; AQE then coalesces the (usually much smaller,
      already aggregated) shuffles down to ~64 MB partitions;
    * 256 MB scan splits keep the number of scan tasks near 400k for 100 TB;
    * AQE skew-join splitting for the few joins on non-aggregated data;
    * Arrow batches bounded for the grouped-pandas steps.
    """
    total_cores = executors * cores_per_executor
    shuffle_parts = max(total_cores * 2, int(input_tb * 1024 * 1024 / 128 / 8))
    return {
        "spark.sql.shuffle.partitions": str(shuffle_parts),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(shuffle_parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    }


def get_spark(master: str | None = None, app: str = "pondflow",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the pondflow defaults.

    ``master`` is only set when given, so on a cluster the launcher decides.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package's source to the executors, once per SparkContext.

    Python workers import pondflow for the Arrow and pandas steps; they cannot see
    the driver's folders, so the sources travel as one small zip file.
    """
    sc = spark.sparkContext
    if getattr(sc, "_pondflow_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    fd, path = tempfile.mkstemp(prefix="pondflow-", suffix=".zip")
    with os.fdopen(fd, "wb") as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(package):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    sc._pondflow_shipped = True


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is; without
    it a cluster session is refused, as a machine-local folder would be seen by one
    machine only. Only a ``local`` master (tests) gets a private folder.
    pondflow's own folders (model registry, stream checkpoints) live under the
    returned base path; RDD checkpoints go where the SparkContext puts them
    (its directory is only set here when it has none, since every
    ``setCheckpointDir`` call creates a new subfolder).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="pondflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", base)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return base


def stored(df, name: str):
    """Write ``df`` to the shared checkpoint folder as Parquet and read it back: the lineage is cut, a lost executor
    costs no recomputation, later readers fetch only the columns they use, and Spark plans with the table's real size.
    The folder goes when the driver's JVM ends, or with ``drop_stored``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pondflow-tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def drop_stored(df) -> None:
    """Remove the folder of a table that ``stored`` wrote and no later step reads."""
    spark = df.sparkSession
    jpath = spark._jvm.org.apache.hadoop.fs.Path(df._stored)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
