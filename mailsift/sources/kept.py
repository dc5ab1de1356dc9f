"""Stored tables that are changed in place: keyed by hash buckets, or by day.

Only the partitions that a change touches are rewritten, by dynamic partition overwrite from a copy; all others keep their files.
A job that ends between the copy and the overwrite can be run again with the same result. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.operators import retention as RT
from mailsift.session import materialise

BUCKETS = 64
BUCKET, DAY = "_bucket", "_day"
NO_DAY = "none"  # the partition of rows without a time


def bucket_of(key: Column, n: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _overwrite(rows: DataFrame, path: str, partition: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def _drop(spark: SparkSession, path: str, partition: str, values: list[str]) -> None:
    """Remove whole partitions, in whatever file system the table lies."""
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in values:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{partition}={value}"), True)


def create_keyed(rows: DataFrame, path: str, key: str, n: int = BUCKETS) -> None:
    """Store a table in ``n`` buckets of its key."""
    rows.withColumn(BUCKET, bucket_of(F.col(key), n)).write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(BUCKET, DAY)


def upsert(path: str, changes: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame], n: int = BUCKETS) -> list[int]:
    """Merge ``changes`` into a keyed table and rewrite the buckets of their keys, which are returned.

    ``merge`` takes stored and changed rows and gives the rows to store; keys must be spelled as they are stored.
    """
    spark = changes.sparkSession
    changes = materialise(changes.withColumn(BUCKET, bucket_of(F.col(key), n)), "changes")
    touched = sorted(r[BUCKET] for r in changes.select(BUCKET).distinct().collect())
    if touched:
        stored = spark.read.parquet(path).filter(F.col(BUCKET).isin(touched)).drop(BUCKET)  # prunes the other folders
        merged = merge(stored, changes.drop(BUCKET)).withColumn(BUCKET, bucket_of(F.col(key), n))
        _overwrite(materialise(merged, "merged"), path, BUCKET)
    return touched


def create_daily(rows: DataFrame, path: str, ts: str) -> None:
    """Store a table by the day of its time."""
    day = F.coalesce(F.date_format(ts, "yyyy-MM-dd"), F.lit(NO_DAY))
    rows.withColumn(DAY, day).write.mode("overwrite").partitionBy(DAY).parquet(path)


def expire(spark: SparkSession, path: str, as_of: str, days: int, ts: str = "timestamp") -> DataFrame:
    """Remove rows older than ``days`` before ``as_of`` from a daily table; returns the audit row, if any expired.

    Days before the cut-off are dropped whole, the day of the cut-off is rewritten, later days and rows without a time stay.
    """
    at = F.to_timestamp(F.lit(as_of))
    cut = spark.range(1).select(F.date_format(at - F.make_dt_interval(F.lit(days)), "yyyy-MM-dd")).first()[0]
    table = spark.read.parquet(path).withColumn(DAY, F.col(DAY).cast("string"))
    old = table.filter((F.col(DAY) <= cut) & (F.col(DAY) != NO_DAY))
    audit = materialise(RT.audit(old, at, days, ts), "retention-audit")
    gone = [r[DAY] for r in old.filter(F.col(DAY) < cut).select(DAY).distinct().collect()]
    edge = materialise(RT.kept(table.filter(F.col(DAY) == cut), at, days, ts), "retention-edge")
    if edge.isEmpty():
        gone.append(cut)
    else:
        _overwrite(edge, path, DAY)
    _drop(spark, path, DAY, gone)
    return audit
