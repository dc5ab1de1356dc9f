"""Alerts on messages of high risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import config
from mailsift.functions.rows import filter_computed


def level(score: Column) -> Column:
    return F.when(score >= config.ALERT_CRITICAL, "CRITICAL").when(score >= config.ALERT_WARNING, "WARNING")


def preview(body: Column) -> Column:
    return F.concat(F.substring(body, 1, 100), F.lit("..."))


def alerts(analysed: DataFrame, event_type: str = "Phishing Detection") -> DataFrame:
    """Rows at warning level or above; ``analysed`` carries ``received_at`` and ``email_preview``.

    The filter stays above the analysis, which would run a second time below it.
    """
    narrow = analysed.select("email_id", "received_at", "risk_score", "threat_reasons", "email_preview")
    return filter_computed(narrow, F.col("risk_score") >= config.ALERT_WARNING).select(
        "email_id", F.col("received_at").alias("timestamp"), level(F.col("risk_score")).alias("level"),
        F.lit(event_type).alias("type"), F.col("threat_reasons").alias("reasons"), "email_preview")
