"""Final verdict on a message and its explanation in words."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import config


def spam_matches(similar: Column, limit: float = config.NEIGHBOUR_DISTANCE) -> Column:
    """Neighbours closer than ``limit`` that are known spam."""
    return F.size(F.filter(similar, lambda m: (m["label"] == "spam") & (m["distance"] < limit)))


def decide() -> Column:
    """From ``ml_*``, optional ``dl_*``, ``similar_threats`` and ``risk_score``; the later rules of the list win.

    The text model decides, unless the external classifier is sure of spam or contradicts with more confidence;
    two close spam neighbours or a very high risk make it spam in any case.
    """
    dl, ml = F.col("dl_prediction"), F.col("ml_prediction")
    dl_conf, ml_conf = F.coalesce("dl_confidence", F.lit(0.0)), F.coalesce("ml_confidence", F.lit(0.0))
    near = F.coalesce(spam_matches(F.col("similar_threats")), F.lit(0)) >= config.NEIGHBOUR_MIN_SPAM
    return (F.when((F.col("risk_score") > config.DECISION_OVERRIDE) | near, "spam")
            .when((dl == "spam") & (dl_conf > config.DL_CONFIDENCE), "spam")
            .when(dl.isNotNull() & (dl != ml) & (dl_conf > ml_conf), dl)
            .otherwise(ml))


def is_inbox_threat() -> Column:
    return (F.col("prediction") == "spam") | (F.col("risk_score") > config.INBOX_RISK)


def explain(prediction: Column, n_reasons: Column, keywords: Column) -> Column:
    """Summary sentence; ``keywords`` is an ``ARRAY<STRUCT<word,impact>>``, strongest first."""
    words = F.slice(F.transform(F.filter(keywords, lambda k: k["impact"] > 0), lambda k: k["word"]), 1, 3)
    threats = F.when(n_reasons > 0, F.format_string("Detected %d security threats.", n_reasons))
    around = F.when(F.size(words) > 0, F.concat(
        F.lit("Suspicious semantic patterns identified around: "), F.array_join(words, ", "), F.lit(".")))
    factors = F.concat_ws(" ", threats, around)
    return F.when(prediction == "spam", F.concat(
        F.lit("Classified as SPAM. "),
        F.when(factors == "", "Based on deep model confidence patterns.").otherwise(factors),
    )).otherwise("Classified as HAM (Safe). No significant threats detected.")
