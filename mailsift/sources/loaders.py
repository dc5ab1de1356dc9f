"""Datasets from files: column aliases, label cleaning and admission checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from mailsift import config
from mailsift.functions import text as T


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; quoted fields may span lines."""
    raw = (spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
           .csv(path))
    return resolve_columns(raw)


def _match(columns: list[str], name: str, aliases: list[str]) -> str | None:
    by_lower = {c.strip().lower(): c for c in reversed(columns)}
    return next((by_lower[a] for a in [name, *aliases] if a in by_lower), None)


def resolve_columns(df: DataFrame) -> DataFrame:
    """Rename the text and label columns, whatever their case; without a label every row counts as ham."""
    df = df.toDF(*[c.strip() for c in df.columns])
    text = _match(df.columns, "text", config.TEXT_ALIASES)
    if text is None:
        strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
        if not strings:
            raise ValueError(f"no text column among {df.columns}")
        text = strings[0]
    label = _match([c for c in df.columns if c != text], "label", config.LABEL_ALIASES)
    df = df.withColumnRenamed(text, "text")
    return df.withColumnRenamed(label, "label") if label else df.withColumn("label", F.lit("ham"))


def clean_labels(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows with text and a label that is spam or ham once trimmed and lower-cased."""
    return (df.filter(F.col(text).isNotNull()).withColumn("label", F.lower(T.strip(F.col("label"))))
            .filter(F.col("label").isin("spam", "ham")))


def _admissible():
    return F.coalesce(F.length("body").between(1, config.MAX_TEXT_LENGTH), F.lit(False))


def accepted(emails: DataFrame) -> DataFrame:
    """Messages of admissible length; only afterwards is the text stripped, so blank text survives as empty."""
    return emails.filter(_admissible()).withColumn("body", T.strip(F.col("body")))


def rejected(emails: DataFrame) -> DataFrame:
    """The others, for a quarantine table."""
    return emails.filter(~_admissible())
