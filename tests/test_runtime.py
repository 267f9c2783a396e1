"""The shared folder and its tables."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from eventloom import ranges, runtime


def test_written_tables(spark):
    df = spark.range(10).withColumn("_b", F.lit("x"))
    done = runtime.written(df, "some")
    assert done.schema == df.schema or done.count() == 10
    assert runtime.shared_folder(spark).removeprefix("file://") in done.inputFiles()[0]
    assert runtime.drop_scratch(spark)


def test_checkpoint_setting_names_the_folder():
    def session(setting, master="spark://x:1"):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: setting or d), sparkContext=SimpleNamespace(master=master, applicationId="a-test"))

    assert runtime.shared_folder(session("hdfs://x/shared/")) == "hdfs://x/shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_folder(session(None))
    assert runtime.shared_folder(session(None, "local[2]")).startswith("file://")


def test_ranges(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 10 != 0, F.col("id") * 7))
    lower = ranges.bounds(df, "x", 9)
    assert 1 <= len(lower) <= 8 and lower == sorted(lower)
    rows = df.withColumn("bucket", ranges.bucket(F.col("x"), lower)).collect()
    for r in rows:
        assert r.bucket == (0 if r.x is None else sum(b <= r.x for b in lower))
    assert ranges.bounds(df, "x", 1) == [] and ranges.bounds(df.limit(0), "x", 5) == []
    dealt = ranges.dealt(df.withColumn("bucket", ranges.bucket(F.col("x"), lower)), len(lower) + 1)
    parts = dealt.select("bucket", F.spark_partition_id().alias("p")).distinct().collect()
    assert len(parts) == len({r.bucket for r in parts}) == len({r.p for r in parts})


def test_even_ranges(spark):
    df = spark.range(4000).select(F.col("id").alias("x"), F.when(F.col("id") % 4000 < 100, 390).otherwise(10).alias("w"))
    lower = ranges.even_bounds(df, "x", "w", 8)
    sums = [r.w for r in df.groupBy(ranges.bucket(F.col("x"), lower).alias("b")).agg(F.sum("w").alias("w")).collect()]
    assert len(sums) == len(lower) + 1 <= 8 and max(sums) <= 1.6 * sum(sums) / 8
    assert ranges.even_bounds(df, "x", "w", 1) == [] and ranges.even_bounds(df.limit(0), "x", "w", 5) == []
