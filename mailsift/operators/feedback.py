"""User corrections: storing, merging into training data and deciding when to retrain."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift import config
from mailsift.functions import text as T


def entries(feedback: DataFrame) -> DataFrame:
    """Corrections as they are stored: personal data removed, unknown model named."""
    return feedback.withColumns({
        "email_text": T.anonymize(F.col("email_text")),
        "model_used": F.coalesce("model_used", F.lit("unknown"))})


def append(feedback: DataFrame, path: str) -> None:
    """One typed sink; new files only, so concurrent appends do not disturb each other."""
    entries(feedback).write.mode("append").parquet(path)


def merge(training: DataFrame, feedback: DataFrame) -> DataFrame:
    """Training rows plus corrected ones, with the correction as the label."""
    new = feedback.filter(F.col("correct_label").isNotNull()).select(
        F.col("email_text").alias("text"), F.col("correct_label").alias("label"))
    return training.select("text", "label").unionByName(new)


def retrain_trigger(feedback: DataFrame, since: str | None = None) -> DataFrame:
    """One row: number of corrections, new since the last training, and whether either threshold is reached."""
    new = F.col("timestamp") > F.to_timestamp(F.lit(since)) if since else F.lit(True)
    return feedback.agg(F.count("*").alias("n_feedback"), F.count_if(new).alias("n_new")).select(
        "n_feedback", "n_new", (F.col("n_new") >= config.RETRAIN_LEARNER).alias("learner_due"),
        (F.col("n_new") >= config.RETRAIN_SCHEDULER).alias("scheduler_due"))


def match(feedback: DataFrame, predictions: DataFrame) -> DataFrame:
    """Corrections with the score of the model that made the prediction."""
    return feedback.join(predictions, (F.col("id") == F.col("email_id")) & (F.col("model_used") == F.col("model")))
