"""Streaming jobs run over the given tables until everything available is processed.

Append mode emits a window once the watermark has passed it, so the SQL counterparts keep closed windows only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift.functions.hashing import unit
from mailsift.operators import blocklist as B
from mailsift.plans import sqlparts as S
from mailsift.plans.catalog import query
from mailsift.session import scratch_path
from mailsift.sources.emails import BODY_SQL, HEADERS_SQL, LABEL_SQL, events, table
from mailsift.streaming import jobs as J


def _stream(spark, sf_dir, name):
    return J.read_table(spark, f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name).schema)


def _events(spark, sf_dir):
    return _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _emails(spark, sf_dir, joined: bool = False):
    docs = _stream(spark, sf_dir, "documents").alias("d")
    cols = [F.expr("d.doc_id").alias("email_id"), F.expr(BODY_SQL.format(text="d.text")).alias("body"),
            F.expr(HEADERS_SQL).alias("raw_headers")]
    if joined:
        docs = docs.join(events(spark, sf_dir).select("event_id", "ts", "user_id").alias("e"),
                         F.expr("e.event_id = d.doc_id"), "left")
        docs = docs.join(table(spark, sf_dir, "labels").alias("l"), F.expr("l.doc_id = d.doc_id"), "left")
        cols += [F.expr("e.ts").alias("received_at"), F.expr("e.user_id").alias("sender_id"),
                 F.expr(LABEL_SQL).alias("label")]
    return docs.select(*cols)


_SCORES = f"WITH {S.RISK} SELECT email_id, risk_score, risk_level FROM risk"


def _scored(spark, sf_dir, blocklist, name):
    path = scratch_path(spark, name)
    J.score_batches(_emails(spark, sf_dir), blocklist, path, scratch_path(spark, f"{name}-cp"))
    return spark.read.parquet(path).select("email_id", "risk_score", "risk_level")


@query("stream_score", _SCORES)
def stream_score(spark, sf_dir):
    return _scored(spark, sf_dir, B.seeds(spark), "stream-score")


@query("stream_score_long_list", _SCORES)
def stream_score_long_list(spark, sf_dir):
    """The same against the seeds and one unused domain per event, read again for every micro-batch."""
    def current():
        other = table(spark, sf_dir, "events").select(
            F.concat(F.lit("host"), F.col("event_id"), F.lit(".invalid")).alias("domain"), F.lit("unused").alias("reason"),
            F.lit(None).cast("timestamp").alias("added_at"))
        return B.insert_missing(B.seeds(spark), other)
    return _scored(spark, sf_dir, current, "stream-score-long")


@query("stream_late", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' OR ts IS NULL THEN 'rejected' ELSE 'kept' END AS kind
  FROM events) GROUP BY kind""")
def stream_late(spark, sf_dir):
    """Rows kept, late and rejected, which add up to the input; one batch has no earlier one to be late for."""
    path = scratch_path(spark, "stream-late")
    J.split_late(_events(spark, sf_dir), "ts", "1 hour", F.col("event_type") != "error", path, scratch_path(spark, "stream-late-cp"))
    return spark.read.parquet(f"{path}/rows").groupBy("kind").agg(F.count("*").alias("n"))


@query("stream_alerts", f"""WITH {S.RISK} SELECT email_id, CASE WHEN risk_score >= 90 THEN 'CRITICAL' ELSE 'WARNING' END AS level
  FROM risk WHERE risk_score >= 75""")
def stream_alerts(spark, sf_dir):
    path = scratch_path(spark, "stream-alerts")
    J.write_alerts(_emails(spark, sf_dir, joined=True), B.seeds(spark), path, scratch_path(spark, "stream-alerts-cp"))
    return spark.read.parquet(path).select("email_id", "level")


@query("stream_drift", f"""WITH {S.EMAILS}, w AS (SELECT time_bucket(INTERVAL '1 day', received_at) AS w, label, length(body) AS n FROM emails),
last AS (SELECT max(received_at) - INTERVAL 1 HOUR AS t FROM emails)
SELECT CAST(epoch_us(w) AS BIGINT) AS window_start, count(*) AS n, round(avg(CASE WHEN label = 'spam' THEN 1.0::DOUBLE ELSE 0 END), 6) AS spam_ratio,
  round(avg(n), 6) AS avg_length, abs(avg(CASE WHEN label = 'spam' THEN 1.0::DOUBLE ELSE 0 END) - 0.25) > 0.15 AS ratio_alert,
  abs(avg(n) - 2000.0) / 2000.0 > 0.3 AS length_alert
FROM w WHERE w + INTERVAL 1 DAY <= (SELECT t FROM last) GROUP BY w""")
def stream_drift(spark, sf_dir):
    rows = _emails(spark, sf_dir, joined=True).select(
        "received_at", F.coalesce(F.col("label") == "spam", F.lit(False)).alias("is_spam"), F.length("body").alias("n_chars"))
    out = J.run_available(J.drift_windows(rows, 0.25, 2000.0), "stream-drift")
    return out.select(F.unix_micros("window_start").alias("window_start"), "n",
                      F.round("spam_ratio", 6).alias("spam_ratio"), F.round("avg_length", 6).alias("avg_length"),
                      "ratio_alert", "length_alert")


@query("stream_error_rate", """WITH w AS (SELECT time_bucket(INTERVAL '1 minute', ts) - INTERVAL (i) MINUTE AS w, event_type
  FROM events, (SELECT unnest(range(5)) AS i)), last AS (SELECT max(ts) - INTERVAL 10 MINUTE AS t FROM events)
SELECT CAST(epoch_us(w) AS BIGINT) AS window_start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors,
  count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE > 0.05 AS error_alert
FROM w WHERE w + INTERVAL 5 MINUTE <= (SELECT t FROM last) GROUP BY w""")
def stream_error_rate(spark, sf_dir):
    out = J.run_available(J.error_windows(_events(spark, sf_dir)), "stream-error-rate")
    return out.select(F.unix_micros("window_start").alias("window_start"), "n", "errors", "error_alert")


def _sessions_sql(source: str, minutes: int) -> str:
    return f"""WITH g AS (SELECT {source}, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY {source} ORDER BY ts) < INTERVAL {minutes} MINUTE
  THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY {source} ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g),
last AS (SELECT max(ts) - INTERVAL 10 MINUTE AS t FROM events)
SELECT {source}, CAST(epoch_us(min(ts)) AS BIGINT) AS session_start, CAST(epoch_us(max(ts)) + {minutes * 60_000_000} AS BIGINT) AS session_end,
  count(*) AS n FROM s GROUP BY {source}, sid HAVING max(ts) + INTERVAL {minutes} MINUTE <= (SELECT t FROM last)"""


def _session_rows(spark, sf_dir, source: str, gap: str, name: str):
    out = J.run_available(J.activity_sessions(_events(spark, sf_dir), source, gap), name)
    return out.withColumns({c: F.unix_micros(c) for c in ("session_start", "session_end")})


@query("stream_silence", _sessions_sql("event_type", 1))
def stream_silence(spark, sf_dir):
    return _session_rows(spark, sf_dir, "event_type", "1 minute", "stream-silence")


@query("stream_sessions", _sessions_sql("user_id", 10))
def stream_sessions(spark, sf_dir):
    return _session_rows(spark, sf_dir, "user_id", "10 minutes", "stream-sessions")


@query("stream_retrain_trigger", f"""WITH {S.EMAILS}, {S.FEEDBACK}, n AS (SELECT model_used, count(*) AS n FROM feedback GROUP BY 1)
SELECT model_used, CAST(unnest(range(50, n + 1, 50)) AS BIGINT) AS n_feedback FROM n""")
def stream_retrain_trigger(spark, sf_dir):
    rows = _emails(spark, sf_dir, joined=True).filter("label IS NOT NULL").select(
        F.col("email_id").alias("id"),
        F.when(unit("ab", "email_id") < 0.5, "naive_bayes").otherwise("svm").alias("model_used"))
    return J.run_available(J.retrain_crossings(rows), "stream-retrain")


@query("stream_blocklist", f"WITH {S.RISK}, l AS (SELECT email_id, unnest(listed) AS host FROM risk) SELECT email_id, host FROM l")
def stream_blocklist(spark, sf_dir):
    hits = J.blocklist_hits(_emails(spark, sf_dir), B.seeds(spark)).select("email_id", "host")
    return J.run_available(hits, "stream-blocklist")


@query("stream_dedup", "SELECT doc_id AS email_id FROM documents")
def stream_dedup(spark, sf_dir):
    """Every email delivered twice arrives once."""
    once = _emails(spark, sf_dir, joined=True).select("email_id", "received_at")
    again = _emails(spark, sf_dir, joined=True).select("email_id", "received_at")
    return J.run_available(J.deduplicated(once.union(again)), "stream-dedup").select("email_id")


@query("stream_feedback_join", f"""WITH {S.EMAILS}, {S.FEEDBACK} SELECT id AS email_id, correct_label FROM feedback WHERE correct_label IS NOT NULL""")
def stream_feedback_join(spark, sf_dir):
    predictions = _emails(spark, sf_dir, joined=True).select("email_id", F.col("received_at").alias("scored_at"))
    feedback = _emails(spark, sf_dir, joined=True).filter(
        F.col("label").isNotNull() & (unit("corrected", "email_id") >= 0.2)).select(
        F.col("email_id").alias("id"), F.expr("received_at + INTERVAL 30 MINUTES").alias("timestamp"),
        F.col("label").alias("correct_label"))
    joined = J.match_feedback(predictions, feedback).select("email_id", "correct_label")
    return J.run_available(joined, "stream-feedback-join")
