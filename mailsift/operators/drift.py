"""Shift between training and live data: spam share, text length and vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import config
from mailsift.functions import text as T
from mailsift.functions.rows import explode_rows


def words(texts: DataFrame, column: str = "text") -> DataFrame:
    """Word frequencies; combined before the shuffle, so frequent words are no hot keys."""
    tokens = explode_rows(texts, T.tokenize(F.col(column)), "word")
    return tokens.groupBy("word").agg(F.count("*").alias("n"))


def baseline_vocabulary(texts: DataFrame, column: str = "text", size: int = config.BASELINE_VOCAB) -> DataFrame:
    """The ``size`` most frequent words, alphabetical among equals."""
    return words(texts, column).orderBy(F.col("n").desc(), "word").limit(size)


def text_stats(rows: DataFrame, label: str = "label", column: str = "text") -> DataFrame:
    """``spam_ratio, avg_text_length, total_samples`` in one aggregation."""
    spam = F.avg(F.when(F.col(label) == "spam", 1.0).otherwise(0.0))
    return rows.agg(F.coalesce(spam, F.lit(0.0)).alias("spam_ratio"),
                    F.coalesce(F.avg(F.length(column)), F.lit(0.0)).alias("avg_text_length"),
                    F.count("*").alias("total_samples"))


def vocabulary_shift(live_words: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``live_words, new_words``: the vocabulary has a fixed maximum size, so it may be broadcast."""
    known = F.broadcast(vocabulary.select("word", F.lit(True).alias("known")))
    return live_words.join(known, "word", "left").agg(
        F.count("*").alias("live_words"), F.count_if(F.col("known").isNull()).alias("new_words"))


def check(train: DataFrame, live: DataFrame, shift: DataFrame) -> DataFrame:
    """One row of live statistics and alerts from three one-row inputs."""
    tagged = [df.select(F.lit(tag).alias("_side"), F.struct("*").alias("_v"))
              for tag, df in (("train", train), ("live", live))]
    one = tagged[0].unionByName(tagged[1]).agg(
        F.first(F.when(F.col("_side") == "train", F.col("_v")), ignorenulls=True).alias("t"),
        F.first(F.when(F.col("_side") == "live", F.col("_v")), ignorenulls=True).alias("l"))
    counts = shift.select(F.struct("*").alias("w"))
    both = one.withColumn("_k", F.lit(1)).join(counts.withColumn("_k", F.lit(1)), "_k").drop("_k")
    values = both.select(
        F.col("t.spam_ratio").alias("train_ratio"), F.col("l.spam_ratio").alias("live_ratio"),
        F.col("t.avg_text_length").alias("train_length"), F.col("l.avg_text_length").alias("live_length"),
        F.col("l.total_samples").alias("num_predictions"),
        F.abs(F.col("l.spam_ratio") - F.col("t.spam_ratio")).alias("ratio_diff"),
        F.coalesce(F.abs(F.col("l.avg_text_length") - F.col("t.avg_text_length"))
                   / F.nullif(F.col("t.avg_text_length"), F.lit(0.0)), F.lit(0.0)).alias("length_shift"),
        F.coalesce(F.col("w.new_words") / F.nullif(F.col("w.live_words"), F.lit(0)), F.lit(0.0)).alias("vocab_ratio"),
        F.col("w.new_words").alias("new_words"))
    return values.withColumn("alerts", drift_alerts()).withColumn("has_drift", F.size("alerts") > 0)


def _alert(condition: Column, kind: str, message: Column, severity: Column | str) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.when(condition, F.struct(F.lit(kind).alias("type"), message.alias("message"), level.alias("severity")))


def drift_alerts() -> Column:
    return F.array_compact(F.array(
        _alert(F.col("ratio_diff") > config.DRIFT_SPAM_RATIO, "prediction_distribution",
               F.format_string("Spam ratio shifted: train=%.3f → live=%.3f (Δ=%.3f)",
                               "train_ratio", "live_ratio", "ratio_diff"),
               F.when(F.col("ratio_diff") < config.DRIFT_SPAM_RATIO_CRITICAL, "warning").otherwise("critical")),
        _alert(F.col("length_shift") > config.DRIFT_LENGTH, "input_length",
               F.format_string("Avg text length shifted: train=%.0f → live=%.0f (%.0f%%)",
                               "train_length", "live_length", F.col("length_shift") * 100), "warning"),
        _alert(F.col("vocab_ratio") > config.DRIFT_VOCAB, "vocabulary_drift",
               F.format_string("%.0f%% of live words not in training vocabulary (%d new words)",
                               F.col("vocab_ratio") * 100, "new_words"), "warning")))
