"""Structured Streaming forms of the jobs.

Scoring keeps no state: every micro-batch is analysed as a table is. Windowed jobs declare watermarks, beyond which Spark
drops late rows; ``split_late`` writes them, and invalid ones, beside the kept rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from mailsift import config, schemas
from mailsift.functions import urls as U
from mailsift.functions.rows import explode_rows
from mailsift.operators import alerts as A, risk as R, rules
from mailsift.session import scratch_path


def read_files(spark: SparkSession, folder: str, schema, files: str = "*.parquet",
               max_files: int | None = None) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(folder)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A Parquet table as a stream, whether it is one file or a folder of files.

    A stream's path must be a folder, unless it is a pattern; the braces make a pattern that only ``path`` matches.
    """
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}")


def read_kafka(spark: SparkSession, servers: str, topic: str = "email_ingest", schema: str | None = None) -> DataFrame:
    """Emails as JSON values of a topic; the connector package comes with the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parse_messages(raw, schema)


def parse_messages(raw: DataFrame, schema: str | None = None) -> DataFrame:
    """Columns of JSON messages in a binary ``value``; what isn't JSON becomes a row of nulls, unknown fields are left out."""
    parsed = F.from_json(F.col("value").cast("string"), schema or schemas.EMAILS)
    return raw.select(parsed.alias("m")).select("m.*")


def run_available(stream: DataFrame, name: str, checkpoint: str | None = None, path: str | None = None) -> DataFrame:
    """Process what is there, append it to Parquet and return it as a table."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
             .option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


Listed = DataFrame | Callable[[], DataFrame]


def _current(blocklist: Listed) -> DataFrame:
    """The list as it is now: a function is asked again for every micro-batch."""
    return blocklist() if callable(blocklist) else blocklist


def score_batches(emails: DataFrame, blocklist: Listed, path: str, checkpoint: str, *columns: str) -> None:
    """Risk of every arriving email against a list of any size, which is read again for every micro-batch.

    Each micro-batch is analysed like a table: hosts are sifted in place and those that may be listed are joined. Its
    results lie in a folder of their own, so a repeated batch replaces what it wrote before.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        scored = R.analyse(batch, _current(blocklist))
        scored.select(*(columns or ("email_id", "risk_score", "risk_level"))).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _each_batch(emails, write, checkpoint)


def _each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def write_alerts(emails: DataFrame, blocklist: Listed, path: str, checkpoint: str) -> None:
    """Alerts of each micro-batch in a folder of its own: a repeated batch replaces what it wrote before."""
    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("email_preview", A.preview(F.col("body")))
        analysed = R.analyse(rows, _current(blocklist), ("email_id", "received_at", "email_preview"))
        A.alerts(analysed).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    _each_batch(emails, write, checkpoint)


def split_late(stream: DataFrame, ts: str, delay: str, valid: Column, path: str, checkpoint: str) -> None:
    """Every row of a stream once: kept ones, late ones and rejected ones, each micro-batch in folders of its own.

    A row is late when it is older than the newest time of all earlier micro-batches less ``delay``; that time is kept
    beside the results, so a repeated batch decides as before. A row that isn't ``valid``, or has no time, is rejected.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.createDataFrame([(-1, None)], "batch long, newest timestamp")
        if batch_id:
            seen = spark.read.schema("newest timestamp, batch long").parquet(f"{path}/newest").filter(F.col("batch") < batch_id)
        limit = seen.agg((F.max("newest") - F.expr(f"INTERVAL {delay}")).alias("t")).first()["t"]
        good = F.coalesce(valid, F.lit(False)) & F.col(ts).isNotNull()
        late = F.lit(False) if limit is None else F.col(ts) < F.lit(limit)
        kind = F.when(~good, "rejected").when(late, "late").otherwise("kept")
        # Columns that decide are computed once and written with the row.
        (batch.withColumn("kind", kind).write.mode("overwrite").partitionBy("kind").parquet(f"{path}/rows/batch={batch_id}"))
        batch.filter(good).agg(F.max(ts).alias("newest")).write.mode("overwrite").parquet(f"{path}/newest/batch={batch_id}")

    _each_batch(stream, write, checkpoint)


def drift_windows(rows: DataFrame, spam_ratio: float, avg_length: float, width: str = "1 day",
                  delay: str = "1 hour") -> DataFrame:
    """Spam share and mean length per window against a fixed baseline; ``rows`` has ``received_at, is_spam, n_chars``."""
    w = rows.withWatermark("received_at", delay).groupBy(F.window("received_at", width).alias("w")).agg(
        F.count("*").alias("n"), F.avg(F.col("is_spam").cast("double")).alias("spam_ratio"),
        F.avg("n_chars").alias("avg_length"))
    return w.select(
        F.col("w.start").alias("window_start"), "n", "spam_ratio", "avg_length",
        (F.abs(F.col("spam_ratio") - spam_ratio) > config.DRIFT_SPAM_RATIO).alias("ratio_alert"),
        (F.abs(F.col("avg_length") - avg_length) / avg_length > config.DRIFT_LENGTH).alias("length_alert"))


def error_windows(events: DataFrame, width: str = "5 minutes", slide: str = "1 minute",
                  delay: str = "10 minutes") -> DataFrame:
    """Error share and 95th percentile over sliding windows, merged from sketches per minute.

    An event updates the state of one minute; only minutes, not events, are copied into the windows that slide over them.
    """
    out = rules.from_minutes(rules.minute_sketches(events.withWatermark("ts", delay)), width, slide)
    return out.select("window_start", "n", "errors", "p95", (F.col("errors") / F.col("n") > rules.ERROR_SHARE).alias("error_alert"),
                      (F.col("p95") > rules.LATENCY_SECONDS).alias("latency_alert"))


def activity_sessions(events: DataFrame, source: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Uninterrupted activity per source: the time between two sessions is silence, a full session is a burst."""
    return (events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), source)
            .agg(F.count("*").alias("n"))
            .select(source, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n"))


def retrain_crossings(feedback: DataFrame, threshold: int = config.RETRAIN_LEARNER) -> DataFrame:
    """``model_used, n_feedback``: one row each time a model's corrections pass a multiple of the threshold.

    The state is one counter per model; rows arrive in chunks and are only counted.
    """
    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        after = before + sum(len(chunk) for chunk in chunks)
        state.update((after,))
        hits = range((before // threshold + 1) * threshold, after + 1, threshold)
        yield pd.DataFrame({"model_used": [key[0]] * len(hits), "n_feedback": list(hits)})

    return feedback.select("model_used", "id").groupBy("model_used").applyInPandasWithState(
        step, "model_used STRING, n_feedback LONG", "n LONG", "append", GroupStateTimeout.NoTimeout)


def blocklist_hits(emails: DataFrame, blocklist: DataFrame) -> DataFrame:
    """Listed hosts of arriving emails by a join with the dimension as it is at each micro-batch."""
    links = explode_rows(emails, F.array_distinct(U.hosts(U.extract(F.col("body")))), "host", "email_id")
    listed = blocklist.select(F.col("domain").alias("_domain"), "reason")
    return links.join(listed, F.lower("host") == F.col("_domain")).select("email_id", "host", "reason")


def deduplicated(emails: DataFrame, delay: str = "1 day") -> DataFrame:
    """First delivery of every email; ids are remembered for the length of the watermark."""
    return emails.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["email_id"])


def match_feedback(predictions: DataFrame, feedback: DataFrame, within: str = "2 hours",
                   delay: str = "1 hour") -> DataFrame:
    """Corrections joined to the prediction they follow, both streams bounded in time."""
    p = predictions.withWatermark("scored_at", delay).alias("p")
    f = feedback.withWatermark("timestamp", delay).alias("f")
    return p.join(f, F.expr(
        f"f.id = p.email_id AND f.timestamp >= p.scored_at AND f.timestamp <= p.scored_at + INTERVAL {within}"))
