"""Quality of predictions: metrics, confusion matrices, comparisons and A/B results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.functions.hashing import unit

METRICS = ["accuracy", "precision", "recall", "f1_score"]


def _ratio(part: Column, whole: Column) -> Column:
    return F.bround(F.coalesce(part / F.nullif(whole, F.lit(0)), F.lit(0.0)), 4)


def confusion_counts(predictions: DataFrame, *by: str) -> DataFrame:
    """``tp, fp, fn, tn`` with spam as the positive class, in one aggregation."""
    said, truth = F.col("prediction") == "spam", F.col("label") == "spam"
    return predictions.groupBy(*by).agg(
        F.count_if(said & truth).alias("tp"), F.count_if(said & ~truth).alias("fp"),
        F.count_if(~said & truth).alias("fn"), F.count_if(~said & ~truth).alias("tn"))


def metrics(predictions: DataFrame, *by: str) -> DataFrame:
    """Accuracy, precision, recall and F1 to four places; empty denominators give 0."""
    c = {n: F.col(n) for n in ("tp", "fp", "fn", "tn")}
    return confusion_counts(predictions, *by).select(
        *by,
        _ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]).alias("accuracy"),
        _ratio(c["tp"], c["tp"] + c["fp"]).alias("precision"),
        _ratio(c["tp"], c["tp"] + c["fn"]).alias("recall"),
        _ratio(c["tp"] * 2, c["tp"] * 2 + c["fp"] + c["fn"]).alias("f1_score"),
        confusion_matrix(c).alias("confusion_matrix"))


def confusion_matrix(c: dict[str, Column]) -> Column:
    """Rows are true labels, columns predictions, both in sorted order; one class gives a 1 x 1 matrix."""
    full = F.array(F.array(c["tn"], c["fp"]), F.array(c["fn"], c["tp"]))
    spam_seen = (c["tp"] + c["fn"] + c["fp"]) > 0
    ham_seen = (c["tn"] + c["fn"] + c["fp"]) > 0
    return (F.when(spam_seen & ham_seen, full).when(spam_seen, F.array(F.array(c["tp"])))
            .otherwise(F.array(F.array(c["tn"]))))


def leaderboard(model_metrics: DataFrame) -> DataFrame:
    """Metrics with ``is_best``: the highest F1, the first name among equals. One row per model, so ranking is small."""
    best = F.row_number().over(Window.orderBy(F.col("f1_score").desc(), "model"))
    return model_metrics.withColumn("is_best", best == 1)


def best_name(model_metrics: DataFrame, default: str) -> DataFrame:
    """One row with the best model, or the default when nothing was evaluated."""
    top = model_metrics.orderBy(F.col("f1_score").desc(), "model").limit(1)
    return top.agg(F.coalesce(F.max("model"), F.lit(default)).alias("model"))


def ab_outcome(prediction: str = "prediction", correct: str = "correct_label") -> Column:
    """Whether the prediction was right; unknown while there is no correction."""
    return F.when(F.col(correct).isNotNull(), F.col(prediction) == F.col(correct))


def ab_summary(results: DataFrame) -> DataFrame:
    """Per model: rows, right ones (unknown counts as not right) and both accuracies."""
    right = F.count_if(F.coalesce("is_correct", F.lit(False)))
    known = F.count("is_correct")
    return results.groupBy("model").agg(F.count("*").alias("total"), right.alias("correct"), known.alias("labelled")).select(
        "model", "total", "correct", _ratio(F.col("correct"), F.col("total")).alias("accuracy"),
        _ratio(F.col("correct"), F.col("labelled")).alias("labelled_accuracy"))


def assign(key: str, model_a: str, model_b: str, split: float = 0.8) -> Column:
    """Stable A/B routing: the same key always meets the same model."""
    return F.when(unit("ab", key) < split, model_a).otherwise(model_b)
