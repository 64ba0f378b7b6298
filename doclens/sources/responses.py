"""Answers of a model by key, in buckets of keys: a look-up reads the buckets of its keys alone.

A key's bucket is two hexadecimal digits of its hash, so buckets stay alike in size. Writing appends; of a key's rows the newest counts, and of
equally new ones the least answer. ``compact`` joins the small files of a bucket. At no moment is an answer missing: a run that breaks
off leaves rows twice at worst, which readers do not see.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STORED = "key string, response string, stored_at long, bucket string"
#: Files of a bucket from which it is compacted.
MOST_FILES = 16


def bucket(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 2)


def put(new: DataFrame, path: str) -> None:
    """Store answers (key, response); a key that is there already gets a new answer. Rows without either are left out."""
    rows = new.where("key is not null and response is not null").select("key", "response", F.lit(time.time_ns()).alias("stored_at"), bucket(F.col("key")).alias("bucket"))
    # one file for each bucket and task that has it
    rows.repartition("bucket").sortWithinPartitions("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min_by("response", F.struct(-F.col("stored_at"), F.col("response"))).alias("response"), F.max("stored_at").alias("stored_at"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, response) of the whole store; nothing where there is none."""
    return _newest(_rows(spark, path)).select("key", "response")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], _STORED)
    return spark.read.schema(_STORED).option("ignoreMissingFiles", "true").parquet(path)


def look_up(keys: DataFrame, path: str) -> DataFrame:
    """(key, response) of those keys (key) that have an answer. Only their buckets are read, of which the driver learns the names, 256 at most."""
    spark = keys.sparkSession
    asked = keys.select("key").distinct()
    some = [r["bucket"] for r in asked.select(bucket(F.col("key")).alias("bucket")).distinct().collect()]
    rows = _rows(spark, path).where(F.col("bucket").isin(some))
    return _newest(rows.join(asked, "key", "left_semi")).select("key", "response")


def compact(spark: SparkSession, path: str, most_files: int = MOST_FILES) -> int:
    """Join the files of every bucket that has more than ``most_files``, and drop answers that newer ones replace; the number of buckets done.

    The new files are moved in before the old ones go. Files that are written meanwhile are not touched.
    """
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    root = jvm_path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    crowded = {}
    for folder in fs.globStatus(jvm_path(f"{path}/bucket=*")) or []:
        files = [str(f.getPath()) for f in fs.listStatus(folder.getPath()) if f.getPath().getName().endswith(".parquet")]
        if len(files) > most_files:
            crowded[folder.getPath().getName()] = files
    if not crowded:
        return 0
    old = [f for files in crowded.values() for f in files]
    beside = f"{path}/_compacted-{uuid.uuid4().hex}"
    rows = _newest(spark.read.schema(_STORED).option("basePath", path).parquet(*old)).withColumn("bucket", bucket(F.col("key")))
    rows.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(beside)
    for f in fs.globStatus(jvm_path(f"{beside}/bucket=*/*.parquet")):
        to = jvm_path(f"{path}/{f.getPath().getParent().getName()}/{f.getPath().getName()}")
        if not fs.rename(f.getPath(), to):
            raise OSError(f"could not move {f.getPath()} to {to}")
    for f in old:
        fs.delete(jvm_path(f), False)
    fs.delete(jvm_path(beside), True)
    return len(crowded)
