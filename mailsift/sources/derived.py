"""Tables that downstream jobs expect, derived from the given ones row by row.

Model outputs are stand-ins: a stable pseudo-random share of each model's answers is wrong, so that metrics,
A/B results and decisions have something to measure on every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from mailsift.functions.hashing import bucket, unit
from mailsift.sources.emails import emails, events, table

MODELS = ["logistic_regression", "naive_bayes", "random_forest", "svm"]


def _flip(label: Column) -> Column:
    return F.when(label == "spam", "ham").otherwise("spam")


def predicted(model: Column, label: Column) -> tuple[Column, Column]:
    """(noise, prediction) of a model for an email with a known label."""
    noise = unit("score", model, "email_id")
    share = 0.05 + bucket("error", model, size=10) / 50.0
    return noise, F.when(noise < share, _flip(label)).otherwise(label)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``email_id, source, received_at, label, model, prediction, p_spam`` for every labelled email and model."""
    source = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("email_id"), "source")
    base = (emails(spark, sf_dir, received=True, labelled=True).filter("label IS NOT NULL")
            .select("email_id", "received_at", "label").join(source, "email_id"))
    rows = base.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    noise, prediction = predicted(F.col("model"), F.col("label"))
    rows = rows.withColumns({"noise": noise, "prediction": prediction})
    p = F.when(F.col("prediction") == "spam", 0.5 + F.col("noise") / 2).otherwise(0.5 - F.col("noise") / 2)
    return rows.withColumn("p_spam", F.round(p, 7)).drop("noise")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections on labelled emails by the model an A/B test gave them; a fifth has no correction yet."""
    base = emails(spark, sf_dir, received=True, labelled=True).filter("label IS NOT NULL")
    base = base.withColumn("model_used", F.when(unit("ab", "email_id") < 0.5, "naive_bayes").otherwise("svm"))
    _, prediction = predicted(F.col("model_used"), F.col("label"))
    correct = F.when(unit("corrected", "email_id") >= 0.2, F.col("label"))
    return base.select(
        F.col("email_id").alias("id"), F.col("received_at").alias("timestamp"), F.col("body").alias("email_text"),
        prediction.alias("predicted_label"), correct.alias("correct_label"), "model_used")


def evidence() -> dict[str, Column]:
    """Answers of the text model, of an external classifier and of neighbour search for every email."""
    near = [F.struct(unit(f"near{i}", "email_id").alias("distance"),
                     F.when(unit(f"kind{i}", "email_id") < 0.5, "spam").otherwise("ham").alias("label"))
            for i in range(3)]
    return {
        "ml_prediction": F.when(unit("ml", "email_id") < 0.3, "spam").otherwise("ham"),
        "ml_confidence": 0.5 + unit("mlc", "email_id") / 2,
        "dl_prediction": F.when(unit("dl", "email_id") < 0.2, "spam").when(unit("dl", "email_id") < 0.6, "ham"),
        "dl_confidence": unit("dlc", "email_id"),
        "similar_threats": F.array(*near),
    }


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported domains ``domain, reason, added_at``: one per page, some of them already seeded."""
    from mailsift.functions import urls as U
    pages = table(spark, sf_dir, "pages").select("page_id", U.with_scheme(U.decode(F.col("url"))).alias("full"))
    seen = events(spark, sf_dir).select("event_id", "ts")
    host = U.host(F.col("full"))
    domain = (F.when(F.col("page_id") % 50 == 0, "Earn-Money.xyz")
              .when(F.col("page_id") % 2 == 0, F.upper(host)).otherwise(host))
    return pages.join(seen, F.col("event_id") == F.col("page_id"), "left").select(
        domain.alias("domain"), F.concat(F.lit("reported on page "), F.col("page_id").cast("string")).alias("reason"),
        F.col("ts").alias("added_at"))
