"""Message bodies from raw inbox payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RAW = ("id STRING, received_at TIMESTAMP, "
       "payload STRUCT<parts: ARRAY<STRUCT<mimeType: STRING, data: STRING>>, data: STRING>")


def decode_base64url(data: Column) -> Column:
    return F.decode(F.unbase64(F.translate(data, "-_", "+/")), "UTF-8")


def encode_base64url(text: Column) -> Column:
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/", "-_")


def body(parts: Column, data: Column) -> Column:
    """Last ``text/plain`` part of a multipart message (empty without one), else the payload's own data."""
    plain = F.filter(parts, lambda p: p["mimeType"] == "text/plain")
    last = F.try_element_at(plain, F.lit(-1))["data"]
    return F.coalesce(F.when(parts.isNull(), decode_base64url(data)).otherwise(decode_base64url(last)), F.lit(""))


def read_inbox(spark, path: str) -> DataFrame:
    """Raw messages as JSON lines with ``id`` and ``payload``."""
    return spark.read.schema(RAW).json(path)


def latest(emails: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` newest messages."""
    return emails.orderBy(F.col("received_at").desc(), F.col("email_id").desc()).limit(n)
