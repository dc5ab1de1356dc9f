"""Queries on model quality, A/B tests, drift, decisions and operational rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import config
from mailsift.operators import blocklist as B, decision as D, drift, evaluation as E, risk as R, rules
from mailsift.operators.sampling import stratified_split
from mailsift.plans import sqlparts as S
from mailsift.plans.catalog import query
from mailsift.sources import derived
from mailsift.sources.emails import emails, events, table

_SCORES = f"{S.EMAILS}, {S.SCORES}"


@query("eval_metrics", f"WITH {_SCORES} SELECT model, accuracy, precision, recall, f1_score FROM ({S.metrics('model')})")
def eval_metrics(spark, sf_dir):
    return E.metrics(derived.scores(spark, sf_dir), "model").drop("confusion_matrix")


@query("confusion_matrix", f"WITH {_SCORES} SELECT model, tn, fp, fn, tp FROM ({S.metrics('model')})")
def confusion_matrix(spark, sf_dir):
    m = F.col("confusion_matrix")
    return E.metrics(derived.scores(spark, sf_dir), "model").select(
        "model", m[0][0].alias("tn"), m[0][1].alias("fp"), m[1][0].alias("fn"), m[1][1].alias("tp"))


@query("model_comparison", f"""WITH {_SCORES}, m AS ({S.metrics('model')}) SELECT model, f1_score,
  row_number() OVER (ORDER BY f1_score DESC, model) = 1 AS is_best FROM m""")
def model_comparison(spark, sf_dir):
    return E.leaderboard(E.metrics(derived.scores(spark, sf_dir), "model")).select("model", "f1_score", "is_best")


@query("experiment_log", f"""WITH {_SCORES}, m AS ({S.metrics('model')}) SELECT 'tfidf' AS vectorizer, CAST(count(*) AS INT) AS n_results,
  max(f1_score) AS best_f1, (SELECT model FROM m ORDER BY f1_score DESC, model LIMIT 1) AS best_model FROM m""")
def experiment_log(spark, sf_dir):
    from mailsift.plans.training import experiment_entry
    entry = experiment_entry(E.metrics(derived.scores(spark, sf_dir), "model"), "tfidf")
    return entry.select("vectorizer", F.size("results").alias("n_results"),
                        F.array_max(F.transform("results", lambda r: r["f1_score"])).alias("best_f1"), "best_model")


@query("ab_assign", f"""WITH {S.EMAILS} SELECT CASE WHEN {S.unit('ab', 'email_id')} < 0.8 THEN 'naive_bayes' ELSE 'svm' END AS model,
  count(*) AS n_emails FROM emails GROUP BY 1""")
def ab_assign(spark, sf_dir):
    return emails(spark, sf_dir).groupBy(E.assign("email_id", "naive_bayes", "svm", 0.8).alias("model")).agg(
        F.count("*").alias("n_emails"))


@query("ab_summary", f"""WITH {S.EMAILS}, {S.FEEDBACK} SELECT model_used AS model, count(*) AS total,
  count(*) FILTER (WHERE predicted_label = correct_label) AS correct,
  {S.round4('count(*) FILTER (WHERE predicted_label = correct_label)', 'count(*)')} AS accuracy,
  {S.round4('count(*) FILTER (WHERE predicted_label = correct_label)', 'count(correct_label)')} AS labelled_accuracy
FROM feedback GROUP BY 1""")
def ab_summary(spark, sf_dir):
    results = derived.feedback(spark, sf_dir).select(
        F.col("model_used").alias("model"), E.ab_outcome("predicted_label").alias("is_correct"))
    return E.ab_summary(results)


def _words(name: str) -> str:
    return f"{name}_words AS (SELECT word, count(*) AS n FROM (SELECT unnest({S.tokens('text')}) AS word FROM {name}) GROUP BY 1)"


_TRAIN = f"{S.EMAILS}, train AS (SELECT label, body AS text FROM emails WHERE label IS NOT NULL)"
_LIVE = "live AS (SELECT CASE WHEN length(text) > 200 THEN 'spam' ELSE 'ham' END AS label, text FROM conversations)"
_BASE = f"base AS (SELECT word FROM train_words ORDER BY n DESC, word LIMIT {config.BASELINE_VOCAB})"


def _train(spark, sf_dir):
    return emails(spark, sf_dir, labelled=True).filter("label IS NOT NULL").select("label", F.col("body").alias("text"))


def _live(spark, sf_dir):
    """Conversations as live traffic; long turns stand in for predicted spam."""
    return table(spark, sf_dir, "conversations").select(
        F.when(F.length("text") > 200, "spam").otherwise("ham").alias("label"), "text")


@query("train_stats", f"""WITH {_TRAIN}, {_words('train')}, {_BASE}
SELECT round(avg(CASE WHEN label = 'spam' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS spam_ratio,
  round(avg(length(text)), 6) AS avg_text_length, (SELECT count(*) FROM base) AS vocab_size,
  count(*) AS total_samples FROM train""")
def train_stats(spark, sf_dir):
    train = _train(spark, sf_dir)
    size = drift.baseline_vocabulary(train).agg(F.count("*")).scalar()
    return drift.text_stats(train).select(
        F.round("spam_ratio", 6).alias("spam_ratio"), F.round("avg_text_length", 6).alias("avg_text_length"),
        size.alias("vocab_size"), "total_samples")


@query("baseline_vocab", f"WITH {_TRAIN}, {_words('train')}, {_BASE} SELECT word FROM base")
def baseline_vocab(spark, sf_dir):
    return drift.baseline_vocabulary(_train(spark, sf_dir)).select("word")


@query("vocab_drift", f"""WITH {_TRAIN}, {_LIVE}, {_words('train')}, {_words('live')}, {_BASE}
SELECT word, n FROM live_words WHERE word NOT IN (SELECT word FROM base)""")
def vocab_drift(spark, sf_dir):
    known = drift.baseline_vocabulary(_train(spark, sf_dir))
    return drift.words(_live(spark, sf_dir)).join(F.broadcast(known.select("word")), "word", "left_anti")


@query("drift_check", f"""WITH {_TRAIN}, {_LIVE}, {_words('train')}, {_words('live')}, {_BASE},
v AS (SELECT (SELECT avg(CASE WHEN label = 'spam' THEN 1.0::DOUBLE ELSE 0 END) FROM train) AS tr,
  (SELECT avg(CASE WHEN label = 'spam' THEN 1.0::DOUBLE ELSE 0 END) FROM live) AS lr,
  (SELECT avg(length(text)) FROM train) AS tl, (SELECT avg(length(text)) FROM live) AS ll,
  (SELECT count(*) FROM live_words) AS nw, (SELECT count(*) FROM live_words WHERE word NOT IN (SELECT word FROM base)) AS nn),
a AS (SELECT *, concat_ws('|', CASE WHEN abs(lr - tr) > 0.15 THEN 'prediction_distribution:' || CASE WHEN abs(lr - tr) < 0.3 THEN 'warning' ELSE 'critical' END END,
  CASE WHEN abs(ll - tl) / tl > 0.3 THEN 'input_length:warning' END,
  CASE WHEN nn / nw::DOUBLE > 0.4 THEN 'vocabulary_drift:warning' END) AS alerts FROM v)
SELECT round(lr, 4) AS live_spam_ratio, round(ll, 1) AS live_avg_length, (SELECT count(*) FROM live) AS num_predictions,
  nn AS new_words, alerts, alerts <> '' AS has_drift FROM a""")
def drift_check(spark, sf_dir):
    train, live = _train(spark, sf_dir), _live(spark, sf_dir)
    shift = drift.vocabulary_shift(drift.words(live), drift.baseline_vocabulary(train))
    result = drift.check(drift.text_stats(train), drift.text_stats(live), shift)
    names = F.transform("alerts", lambda a: F.concat_ws(":", a["type"], a["severity"]))
    return result.select(
        F.round("live_ratio", 4).alias("live_spam_ratio"), F.round("live_length", 1).alias("live_avg_length"),
        "num_predictions", "new_words", F.array_join(names, "|").alias("alerts"), "has_drift")


@query("decision", f"WITH {S.RISK}, {S.EVIDENCE} SELECT r.email_id, {S.DECIDE} AS prediction FROM risk r JOIN evidence USING (email_id)")
def decision(spark, sf_dir):
    analysed = R.analyse(emails(spark, sf_dir), B.seeds(spark)).select("email_id", "risk_score")
    return analysed.withColumns(derived.evidence()).select("email_id", D.decide().alias("prediction"))


@query("vote", f"""WITH {_SCORES} SELECT email_id, round(avg(p_spam), 9) AS p_spam,
  CASE WHEN round(avg(p_spam), 9) > 0.5 THEN 'spam' ELSE 'ham' END AS prediction FROM scores GROUP BY 1""")
def vote(spark, sf_dir):
    from mailsift.operators.ensemble import soft_vote
    return soft_vote(derived.scores(spark, sf_dir)).withColumn("p_spam", F.round("p_spam", 9))


@query("strat_split", f"""WITH {S.EMAILS}, r AS (SELECT email_id, label,
  row_number() OVER (PARTITION BY label ORDER BY ('0x' || substr(md5('42:' || email_id), 1, 8))::BIGINT % 1024, md5('42:' || email_id), email_id) AS rn,
  round(count(*) OVER (PARTITION BY label) * 0.2) AS k FROM emails WHERE label IS NOT NULL)
SELECT email_id, label, rn <= k AS is_test FROM r""")
def strat_split(spark, sf_dir):
    rows = emails(spark, sf_dir, labelled=True).filter("label IS NOT NULL").select("email_id", "label")
    return stratified_split(rows, "email_id", "label")


_W = "SELECT time_bucket(INTERVAL '5 minutes', ts) AS w, * FROM events"


@query("error_rate", f"""SELECT CAST(epoch_us(w) AS BIGINT) AS window_start, count(*) AS n_events,
  round(count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE, 6) AS error_share,
  count(*) FILTER (WHERE event_type = 'error') / count(*)::DOUBLE > 0.05 AS is_alert FROM ({_W}) GROUP BY w""")
def error_rate(spark, sf_dir):
    return rules.error_rate(events(spark, sf_dir)).select(
        F.unix_micros("window_start").alias("window_start"), "n_events",
        F.round("error_share", 6).alias("error_share"), "is_alert")


@query("p95_latency", f"""SELECT CAST(epoch_us(w) AS BIGINT) AS window_start, round(quantile_cont(value, 0.95), 6) AS p95,
  quantile_cont(value, 0.95) > 2 AS is_alert FROM ({_W}) GROUP BY w""")
def p95_latency(spark, sf_dir):
    return rules.p95_latency(events(spark, sf_dir)).select(
        F.unix_micros("window_start").alias("window_start"), F.round("p95", 6).alias("p95"), "is_alert")


@query("p95_sketch", """SELECT CAST(epoch_us(time_bucket(INTERVAL '1 day', ts)) AS BIGINT) AS window_start, count(*) AS n, true AS within
FROM events GROUP BY 1""")
def p95_sketch(spark, sf_dir):
    """Daily 95th percentiles merged from sketches per minute, and whether their ranks lie within the stated error."""
    rows = events(spark, sf_dir)
    days = rules.from_minutes(rules.minute_sketches(rows), "1 day")
    ranks = rows.withColumn("window_start", F.window("ts", "1 day")["start"]).join(F.broadcast(days), "window_start")
    below, upto = F.count_if(F.col("value") < F.col("p95")) / F.count("value"), F.count_if(F.col("value") <= F.col("p95")) / F.count("value")
    # A value stands for all ranks from below to upto.
    within = (below <= 0.95 + rules.RANK_ERROR) & (upto >= 0.95 - rules.RANK_ERROR)
    return ranks.groupBy("window_start").agg(F.count("*").alias("n"), within.alias("within")).withColumn(
        "window_start", F.unix_micros("window_start"))


@query("silence_gaps", """WITH g AS (SELECT ts, lead(ts) OVER (ORDER BY ts) AS nxt FROM events)
SELECT CAST(epoch_us(ts) AS BIGINT) AS gap_start, CAST(epoch_us(nxt) AS BIGINT) AS gap_end,
  round((epoch_us(nxt) - epoch_us(ts)) / 1000000.0::DOUBLE, 6) AS seconds FROM g WHERE epoch_us(nxt) - epoch_us(ts) > 60000000""")
def silence_gaps(spark, sf_dir):
    return rules.silence_gaps(events(spark, sf_dir)).withColumn("seconds", F.round("seconds", 6))


@query("throughput_summary", """SELECT count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS success,
  round(count(*) FILTER (WHERE event_type <> 'error') / count(*)::DOUBLE, 6) AS success_share,
  round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE), 6) AS per_second,
  round(avg(value), 6) AS mean_latency FROM events""")
def throughput_summary(spark, sf_dir):
    return rules.throughput_summary(events(spark, sf_dir))
