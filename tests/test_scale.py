"""Skew behaviour: one key holds a third of all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pondflow.operators import scan
from pondflow.operators import series as sr
from pondflow.operators import stats as st

N = 300_000


@pytest.fixture(scope="module")
def skewed(spark):
    # key "hot" gets every third row, the rest spread over 500 keys
    df = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 500).cast("string")))
        .alias("site"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 37) % (86400 * 90)).cast("timestamp_ntz").alias("ts"),
        (F.sin(F.col("id")) * 10 + 20).alias("value"))
    return df.repartition(16).cache()


def test_resample_hot_key_is_combined_map_side(skewed):
    out = sr.resample(skewed, ["site"], "ts", ["value"], "D", "sum")
    plan = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    assert "partial_sum" in plan                       # map-side combine before the shuffle
    got = out.where("site = 'hot'").agg(F.sum("value")).first()[0]
    exp = skewed.where("site = 'hot'").agg(F.sum("value")).first()[0]
    assert got == pytest.approx(exp)


def test_sort_quantiles_split_hot_key_and_stay_exact(spark, skewed):
    spark.conf.set("spark.sql.adaptive.enabled", "false")   # keep the 8 range partitions visible
    try:
        ranked = skewed.repartitionByRange(F.col("site"), F.col("value")).withColumn("_pid", F.spark_partition_id())
        hot_parts = ranked.where("site = 'hot'").select("_pid").distinct().count()
        assert hot_parts > 1                              # the hot key is spread over several tasks
        q = {r["site"]: r["q0"] for r in st.quantiles(skewed, ["site"], "value", [0.37]).where("site = 'hot'").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    vals = np.array([r[0] for r in skewed.where("site = 'hot'").select("value").collect()])
    assert q["hot"] == pytest.approx(np.percentile(vals, 37), abs=1e-12)


def test_sort_quantiles_split_a_hot_value(spark):
    # 80% of one key's rows hold the same value: counted into one row, the rest spread by range
    df = spark.range(200_000).select(F.lit("hot").alias("site"), F.when(F.col("id") % 5 == 0, F.col("id") % 40_003)
                                     .otherwise(7).cast("double").alias("value")).repartition(8)
    q = st.quantiles(df, ["site"], "value", [0.01, 0.5, 0.85, 0.99]).first()
    vals = np.array([r[0] for r in df.select("value").collect()])
    assert [q[f"q{i}"] for i in range(4)] == pytest.approx(list(np.percentile(vals, [1, 50, 85, 99])), abs=1e-9)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        parts = (df.groupBy("site", "value").count().repartitionByRange("site", "value")
                 .groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")))
        sizes = [r["n"] for r in parts.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 0.25 * sum(sizes)


def test_segmented_scan_spreads_a_long_key(spark):
    # one key with 30 years of daily values: segments by month -> 360 window groups
    df = spark.range(30 * 365).select(F.lit("hot").alias("site"),
                                      F.date_add(F.lit("1990-01-01").cast("date"), F.col("id").cast("int")).alias("date"),
                                      (F.col("id") % 7).cast("double").alias("v"))
    seg = scan.running_sum(df, ["site"], "v", "cum", segment=F.trunc("date", "month"))
    plan = seg._sc._jvm.PythonSQLUtils.explainString(seg._jdf.queryExecution(), "formatted")
    assert "_seg" in plan                                 # window partitioned by (key, segment)
    one = scan.running_sum(df, ["site"], "v", "cum")
    a = {r["date"]: r["cum"] for r in seg.collect()}
    b = {r["date"]: r["cum"] for r in one.collect()}
    assert a == b
