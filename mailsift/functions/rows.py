"""Row-producing steps that keep expensive inputs from being evaluated twice.

The optimizer turns ``explode(x)`` into a filter on ``size(x)`` followed by the explosion, and pushes filters on
computed columns below the projection that computes them; either way a costly expression runs once more per
filter. The outer forms of the generators are exempt from the former.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def explode_rows(df: DataFrame, items: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """One row per element of an array without nulls."""
    return df.select(*keep, F.explode_outer(items).alias(name)).filter(F.col(name).isNotNull())


def posexplode_rows(df: DataFrame, items: Column | str, name: str, *keep: Column | str) -> DataFrame:
    """The same with the position of the element as ``pos``."""
    return df.select(*keep, F.posexplode_outer(items).alias("pos", name)).filter(F.col(name).isNotNull())


def inline_rows(df: DataFrame, entries: Column | str, key: str, *keep: Column | str) -> DataFrame:
    """One row per struct of an array; ``key`` is a field that is never null."""
    return df.select(*keep, F.inline_outer(entries)).filter(F.col(key).isNotNull())


def filter_computed(df: DataFrame, condition: Column) -> DataFrame:
    """Filter on costly computed columns after they were computed, instead of once more below their projection.

    A filter does not move below a projection with a row number of its own. Batch only.
    """
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter(condition & (F.col("_row") >= 0)).drop("_row")
