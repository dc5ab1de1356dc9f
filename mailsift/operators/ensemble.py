"""Combining the probabilities of several models."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def soft_vote(scores: DataFrame, key: str = "email_id") -> DataFrame:
    """Mean probability over models and the class it favours; ham on an exact tie, as the first class."""
    mean = scores.groupBy(key).agg(F.avg("p_spam").alias("p_spam"))
    return mean.withColumn("prediction", F.when(F.round("p_spam", 9) > 0.5, "spam").otherwise("ham"))
