"""Exact samples and splits that are stable across runs and partitionings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def _order(seed: int, key: str):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))


def exact_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer) in a pseudo-random order of the key.

    No task orders the sample: counts per hash bucket (at most 65,536 rows, in hash order) tell which buckets are
    taken whole and in which one the boundary falls; only that one is ranked.
    """
    rows = df.withColumn("_order", _order(seed, key)).withColumn("_bucket", F.substring("_order", 1, 4))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = rows.groupBy("_bucket").agg(F.count("*").alias("_n")).select(
        F.col("_bucket").alias("_b"), "_n", (F.lit(n) - before).alias("_quota")).filter("_quota > 0")
    placed = rows.join(limits, F.col("_bucket") == F.col("_b"))
    whole = placed.filter("_quota >= _n")
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_order", key))
    edge = placed.filter("_quota < _n").withColumn("_rank", rank).filter(F.col("_rank") <= F.col("_quota"))
    return whole.select(*df.columns).unionByName(edge.select(*df.columns))


def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2, seed: int = 42,
                     n_buckets: int = 1024) -> DataFrame:
    """Add ``is_test``: exactly ``round(share * n)`` rows of each label, chosen by a hash of the key.

    A label may hold nearly all rows, so rows are not ranked within a label. Counts per label and hash
    bucket (at most ``labels * n_buckets`` rows) tell in which bucket the boundary falls; only that bucket is ranked.
    """
    order = _order(seed, key)
    rows = df.withColumn("_order", order).withColumn(
        "_bucket", F.conv(F.substring("_order", 1, 8), 16, 10).cast("long") % n_buckets)
    w = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(label, "_bucket").agg(F.count("*").alias("_n"))
    total = Window.partitionBy(label)
    limits = counts.select(
        F.col(label).alias("_label"), F.col("_bucket").alias("_b"),
        (F.round(F.sum("_n").over(total) * test_share).cast("long")
         - F.coalesce(F.sum("_n").over(w), F.lit(0))).alias("_quota"), "_n")
    placed = rows.join(limits, (F.col(label) == F.col("_label")) & (F.col("_bucket") == F.col("_b")))
    split = (F.col("_quota") > 0) & (F.col("_quota") < F.col("_n"))
    whole = placed.filter(~split).withColumn("is_test", F.col("_quota") > 0)
    rank = F.row_number().over(Window.partitionBy(label, "_bucket").orderBy("_order", key))
    edge = placed.filter(split).withColumn("is_test", rank <= F.col("_quota"))
    return whole.unionByName(edge).select(*df.columns, "is_test")
