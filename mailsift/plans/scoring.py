"""Scoring a table of emails: one composed job from text to verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mailsift.functions import text as T
from mailsift.operators import decision as D, features as FE, naive_bayes as NB, risk as R, training as TR
from mailsift.operators.vectors import to_vectors
from mailsift.session import materialise


def score_emails(emails: DataFrame, blocklist: DataFrame, prepared, model, model_name: str,
                 similar: DataFrame | None = None, external: DataFrame | None = None) -> DataFrame:
    """``email_id, prediction, ml_prediction, ml_confidence, dl_*, model_used, risk_*`` and reasons.

    ``similar`` has ``email_id, similar_threats``; ``external`` has ``email_id, dl_prediction, dl_confidence``.
    Without them the decision rests on the text model and the rules. Linear models name the words behind their
    scores in the explanation. Bodies are not shuffled: analysis and term
    weights leave the scan as narrow rows that meet on the email id.
    """
    docs = emails.select(F.col("email_id").alias("doc_id"), T.preprocess(F.col("body")).alias("text"))
    vecs = FE.vectors(FE.with_tokens(docs, prepared.vectorizer), prepared.vocabulary, prepared.vectorizer)
    coefficients = TR.coefficients(model, prepared.vocabulary)
    if coefficients is not None:
        vecs = materialise(vecs, "scored-terms")  # read for the score and for the words behind it
    scored = model.score(to_vectors(vecs, max(prepared.size, 1))).select(
        F.col("doc_id").alias("email_id"), F.col("prediction").alias("ml_prediction"),
        F.col("confidence").alias("ml_confidence"))
    out = R.analyse(emails, blocklist).select(
        "email_id", "risk_score", "risk_level", "threat_reasons", "security_flags").join(scored, "email_id")
    none = F.lit(None)
    if external is not None:
        out = out.join(external.select("email_id", "dl_prediction", "dl_confidence"), "email_id", "left")
    else:
        out = out.withColumns({"dl_prediction": none.cast("string"), "dl_confidence": none.cast("double")})
    if similar is not None:
        out = out.join(similar.select("email_id", "similar_threats"), "email_id", "left")
    else:
        out = out.withColumn("similar_threats", none.cast("array<struct<distance: double, label: string>>"))
    no_words = F.array().cast("array<struct<word: string, impact: double>>")
    if coefficients is not None:
        words = NB.contributions(vecs, coefficients).withColumnRenamed("doc_id", "email_id")
        out = out.join(words, "email_id", "left").withColumn("keywords", F.coalesce("keywords", no_words))
    else:
        out = out.withColumn("keywords", no_words)
    return out.withColumn("prediction", D.decide()).select(
        "email_id", "prediction", "ml_prediction", "ml_confidence", "dl_prediction", "dl_confidence",
        F.lit(model_name).alias("model_used"), "risk_score", "risk_level", "security_flags", "threat_reasons",
        "similar_threats",
        D.explain(F.col("prediction"), F.size("threat_reasons"), F.col("keywords")).alias("threat_explanation"))
