"""Retention of personal data with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import config


def is_kept(as_of: Column, days: int = config.RETENTION_DAYS, ts: str = "timestamp") -> Column:
    """Rows older than the period are dropped; rows without a time stay, as no comparison holds for them."""
    return F.coalesce(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)), F.lit(True))


def kept(rows: DataFrame, as_of: Column, days: int = config.RETENTION_DAYS, ts: str = "timestamp") -> DataFrame:
    return rows.filter(is_kept(as_of, days, ts))


def audit(rows: DataFrame, as_of: Column, days: int = config.RETENTION_DAYS, ts: str = "timestamp") -> DataFrame:
    """Audit row ``timestamp, event_type, details`` for what retention removes; none when nothing expires."""
    n = rows.agg(F.count_if(~is_kept(as_of, days, ts)).alias("n")).filter("n > 0")
    return n.select(as_of.alias("timestamp"), F.lit("DATA_RETENTION").alias("event_type"), F.format_string(
        f"Deleted %d expired records (older than {days} days)", "n").alias("details"))
