"""Places in a global order without a single task: a range shuffle, sorted partitions, and offsets from their sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift.session import materialise

_IN_PARTITION = (1 << 33) - 1  # row numbers of monotonically_increasing_id below the partition's number


def global_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add ``name``, the place of every row from 0 in the order of the columns, which must tell all rows apart.

    Only one row per partition is summed up by a window; a value that repeats meets in one partition of the range shuffle.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialise(dealt.withColumn("_at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("_at", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before: dict[int, int] = {}
    total = 0
    for r in sorted(sizes.collect(), key=lambda r: r["_part"]):  # one row per partition
        before[r["_part"]] = total
        total += r["_n"]
    offsets = df.sparkSession.createDataFrame(list(before.items()), "_part long, _before long")
    ranked = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return ranked.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(_IN_PARTITION)).drop("_part", "_before", "_at")


def most_frequent(df: DataFrame, n: int, count: str, tie: str) -> DataFrame:
    """The ``n`` rows of the highest ``count``, ties by the lower ``tie``.

    Counts fall into at most some 16,000 levels of equal leading bits; levels above the boundary are taken whole, and only
    the one that holds the boundary is ordered.
    """
    # Shifting by the length less nine bits keeps nine leading bits: exact below 512, about half a percent above.
    shift = F.greatest(F.length(F.bin(count)) - 9, F.lit(0))
    level = (shift * 512 + F.expr(f"shiftright({count}, greatest(length(bin({count})) - 9, 0))")).cast("int")
    rows = df.withColumn("_level", level)
    sizes = {r["_level"]: r["n"] for r in rows.groupBy("_level").agg(F.count("*").alias("n")).collect()}
    if sum(sizes.values()) <= n:
        return df
    taken, boundary = 0, 0
    for boundary in sorted(sizes, reverse=True):
        if taken + sizes[boundary] > n:
            break
        taken += sizes[boundary]
    whole = rows.filter(F.col("_level") > boundary)
    edge = global_rank(rows.filter(F.col("_level") == boundary), "_rank", F.col(count).desc(), F.col(tie))
    return whole.unionByName(edge.filter(F.col("_rank") < n - taken).drop("_rank")).drop("_level")
