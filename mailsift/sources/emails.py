"""The given tables as emails, feedback and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# One text for every engine: an opening line that carries an attack pattern, before the whole document.
BODY_SQL = """CASE d.doc_id % 16
    WHEN 0  THEN 'Visit https://вася.com '
    WHEN 1  THEN 'Visit https://аpple.com '
    WHEN 2  THEN 'Urgent: Verify your account at http://192.168.1.55 '
    WHEN 3  THEN 'Claim http://paypa1.xyz/login '
    WHEN 4  THEN 'See http://earn-money.xyz today '
    WHEN 5  THEN 'Free G​ift Ca​rd '
    WHEN 6  THEN 'Go http://microsoft.com/x '
    WHEN 7  THEN 'a http://a.com http://b.com http://c.com http://d.com '
    WHEN 8  THEN 'URGENT ACTION REQUIRED: ACCOUNT SUSPENDED!!! ACT NOW '
    WHEN 9  THEN 'Contact Jane Doe at jane.doe@example.com or 555-123-4567 via http://evil.com:8080/a%20b '
    WHEN 10 THEN 'aaaaaaaaaaaaaaa '
    ELSE '' END || {text}"""

HEADERS_SQL = """replace(CASE d.doc_id % 5
    WHEN 0 THEN 'From: ceo@bank.com|Return-Path: x@evil.ru|Authentication-Results: spf=fail'
    WHEN 1 THEN 'From: a@b.com|Return-Path: a@b.com|Reply-To: c@d.com'
    WHEN 2 THEN 'From: a@b.com|Authentication-Results: spf=pass dkim=fail'
    ELSE '' END, '|', chr(10))"""

LABEL_SQL = """CASE WHEN l.doc_id IS NULL THEN NULL
       WHEN l.quality = 0 OR l.toxic = 1 THEN 'spam' ELSE 'ham' END"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_INPUT = 1 << 30  # bytes
SMALL_PART = 256 << 10


def spread(df: DataFrame) -> DataFrame:
    """Spread a small table, often one file with one row group, over the cores; larger tables stay as they are read."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = min(df.sparkSession.sparkContext.defaultParallelism, size // SMALL_PART)
    return df.repartition(parts) if size < SMALL_INPUT and parts > 1 else df


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def emails(spark: SparkSession, sf_dir: str, received: bool = False, labelled: bool = False,
           text: str = "d.text") -> DataFrame:
    """Documents as emails. The joins for receipt time and label are made only when asked for."""
    out = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).alias("d")
    cols = [F.expr("d.doc_id").alias("email_id"), F.expr(BODY_SQL.format(text=text)).alias("body"),
            F.expr(HEADERS_SQL).alias("raw_headers")]
    if received:
        e = events(spark, sf_dir).select("event_id", "ts", "user_id").alias("e")
        out = out.join(e, F.expr("e.event_id = d.doc_id"), "left")
        cols += [F.expr("e.ts").alias("received_at"), F.expr("e.user_id").alias("sender_id")]
    if labelled:
        out = out.join(table(spark, sf_dir, "labels").alias("l"), F.expr("l.doc_id = d.doc_id"), "left")
        cols.append(F.expr(LABEL_SQL).alias("label"))
    return out.select(*cols)


