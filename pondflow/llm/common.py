"""Helpers shared by the operators of ``pondflow.llm``."""

from __future__ import annotations

import gc
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pondflow.session import checkpoint_dir


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table, read by Spark alone (any file system Spark knows)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage like ``checkpoint()`` but keeps the rows columnar, so later
    readers fetch only the columns they use and a lost executor costs no
    recomputation. The folder is removed when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/pondflow-llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the folders of materialised tables that no later step reads, and let Spark's cleaner
    drop the shuffle files of finished steps now instead of at the driver's next collection: at scale both
    are most of a job's disk."""
    for df in tables:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(df._written)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    gc.collect()
    tables[0].sparkSession._jvm.System.gc()


def documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of a table, a null text as the empty one; other columns are left out,
    so whatever else the table holds cannot clash with an operator's own names."""
    return df.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def keep_rows(df: DataFrame, kept: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` whose id is among ``kept.doc_id`` (distinct, no nulls needed),
    with all their columns. The ids are joined null-safely and never collected."""
    packed = df.select(F.struct("*").alias("_row"), F.col(doc_id).alias("_id"))
    ids = kept.select(F.col("doc_id").alias("_kept"))
    return packed.join(ids, F.col("_id").eqNullSafe(F.col("_kept")), "left_semi").select("_row.*")


def row_key(doc_id: Column, text: Column) -> Column:
    """(no id, id, digest of the text): tells rows of one id apart, and those without an id; the latter sort last.
    A null text is the empty one. Never null."""
    digest = F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)
    return F.struct(F.when(doc_id.isNull(), F.lit(1)).alias("no_id"), doc_id.alias("id"), digest.alias("digest"))


def without_rows(df: DataFrame, keys: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` whose ``row_key`` is not among ``keys.row_key``, with all their columns."""
    rows = df.select(F.struct("*").alias("_row"), row_key(F.col(doc_id), F.col(text)).alias("_key"))
    gone = keys.select(F.col("row_key").alias("_gone")).distinct()
    return rows.join(gone, F.col("_key").eqNullSafe(F.col("_gone")), "left_anti").select("_row.*")


def crc_fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds`` (a null id counts as the text '')."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, those with the smallest hash of ``key``: the same rows on every run."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


# --------------------------------------------------------------------------- hashing in numpy

GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift rounds) over uint64 values."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * GOLDEN
    return x ^ (x >> np.uint64(32))


def text_slices(batch, column: int, size: int):
    """Parts of an Arrow batch with at most ``size`` bytes of text in ``column`` each (or one row), without copying."""
    _, offsets = string_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield batch.slice(at, min(stop, batch.num_rows) - at)
        at = stop


def release() -> None:
    """Give freed memory back to the system: Python workers are used again by later stages, and what their allocators
    keep adds up."""
    import ctypes

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another C library
        pass


def string_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying; offsets has one entry more than rows."""
    import pyarrow as pa

    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offs, data = array.buffers()
    if offs is None or len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, kind)[array.offset:array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, offsets
