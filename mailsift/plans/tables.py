"""Queries on loading, storing and maintaining tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import config, schemas
from mailsift.functions.rows import filter_computed
from mailsift.operators import (alerts as A, blocklist as B, decision as D, evaluation as E, feedback as FB,
                                registry as G, retention as RT, risk as R)
from mailsift.plans import sqlparts as S
from mailsift.plans.catalog import query
from mailsift.session import scratch_path
from mailsift.sources import derived, generate, kept, loaders, mime, stores
from mailsift.sources.emails import emails, events, table


@query("load_alias", "SELECT conv_id, turn, md5(text) AS text, role AS label FROM conversations")
def load_alias(spark, sf_dir):
    raw = table(spark, sf_dir, "conversations").toDF("conv_id", "turn", " Category", "Message")
    return loaders.resolve_columns(raw).select("conv_id", "turn", F.md5("text").alias("text"), "label")


@query("clean_labels", f"""WITH {S.EMAILS} SELECT label, count(*) AS n_emails FROM emails
  WHERE label IN ('spam', 'ham') GROUP BY 1""")
def clean_labels(spark, sf_dir):
    messy = emails(spark, sf_dir, labelled=True).withColumn("label", F.concat(
        F.lit(" "), F.when(F.col("email_id") % 3 == 0, F.upper("label")).otherwise(F.initcap("label")), F.lit(" ")))
    return loaders.clean_labels(messy, "body").groupBy("label").agg(F.count("*").alias("n_emails"))


def _pick_sql(values: list[str], seed: str) -> str:
    options = "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
    return f"{options}[{S.bucket(seed, 'c_custkey', size=len(values))} + 1]"


def _number_sql(seed: str, low: int, high: int) -> str:
    return f"CAST({S.bucket(seed, 'c_custkey', size=high - low + 1)} + {low} AS VARCHAR)"


@query("gen_corpus", f"""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'spam' ELSE 'ham' END AS label,
  replace(replace(replace(replace(replace(CASE WHEN c_custkey % 2 = 0 THEN {_pick_sql(generate.SPAM, '42.spam')}
    ELSE {_pick_sql(generate.HAM, '42.ham')} END, '{{name}}', {_pick_sql(generate.NAMES, '42.name')}),
    '{{item}}', {_pick_sql(generate.ITEMS, '42.item')}), '{{amount}}', {_number_sql('42.amount', 50, 50000)}),
    '{{percent}}', {_number_sql('42.percent', 5, 80)}), '{{days}}', {_number_sql('42.days', 3, 30)}) AS text
FROM customer""")
def gen_corpus(spark, sf_dir):
    return generate.corpus(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey")


_VERSIONED = ["benchmark", "conversations", "documents"]


@query("dataset_versions", " UNION ALL ".join(
    f"SELECT 'v{i + 1}' AS version, '{t}' AS source, count(*) AS num_samples, "
    f"(SELECT string_agg(column_name, ',' ORDER BY column_index) FROM duckdb_columns() WHERE table_name = '{t}') AS columns "
    f"FROM {t}" for i, t in enumerate(_VERSIONED)))
def dataset_versions(spark, sf_dir):
    entries = [stores.version_entry(table(spark, sf_dir, t), f"v{i + 1}", t) for i, t in enumerate(_VERSIONED)]
    out = entries[0]
    for e in entries[1:]:
        out = out.unionByName(e)
    return out.select("version", "source", "num_samples", F.array_join("columns", ",").alias("columns"))


@query("version_read", "SELECT item_id, md5(text) AS text FROM benchmark")
def version_read(spark, sf_dir):
    store = stores.DatasetVersions(spark, scratch_path(spark, "versions"))
    store.register(table(spark, sf_dir, "documents"), "v1", "documents")
    tag = store.register(table(spark, sf_dir, "benchmark"), None, "benchmark")
    return store.read(tag).select("item_id", F.md5("text").alias("text"))


@query("feature_store", f"WITH {S.RISK} SELECT email_id, latin_ratio, CAST(url_count AS INT) AS url_count FROM risk")
def feature_store(spark, sf_dir):
    """Save the structural features, save them again (the last write wins) and read them back."""
    store = stores.FeatureStore(spark, scratch_path(spark, "features"))
    feats = R.extract_features(emails(spark, sf_dir)).select(
        F.col("email_id").alias("doc_id"), F.lit(0).alias("term_id"), R.SCRIPT["latin_ratio"].alias("latin_ratio"),
        R.URL["url_count"].alias("url_count"))
    store.save(feats, "structure", "v1", "security")
    return store.load("structure").select(F.col("doc_id").alias("email_id"), "latin_ratio", "url_count")


@query("feedback_append", f"WITH {S.EMAILS}, {S.FEEDBACK} SELECT id, predicted_label, correct_label, model_used FROM feedback")
def feedback_append(spark, sf_dir):
    path = scratch_path(spark, "feedback")
    FB.append(derived.feedback(spark, sf_dir), path)
    return spark.read.schema(schemas.FEEDBACK).parquet(path).select("id", "predicted_label", "correct_label", "model_used")


@query("feedback_count", f"WITH {S.EMAILS}, {S.FEEDBACK} SELECT model_used, count(*) AS n_feedback FROM feedback GROUP BY 1")
def feedback_count(spark, sf_dir):
    return derived.feedback(spark, sf_dir).groupBy("model_used").agg(F.count("*").alias("n_feedback"))


@query("merge_feedback", f"""WITH {S.EMAILS}, {S.FEEDBACK}, merged AS (
  SELECT body AS text, label FROM emails WHERE label IS NOT NULL
  UNION ALL SELECT email_text, correct_label FROM feedback WHERE correct_label IS NOT NULL)
SELECT label, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM merged GROUP BY 1""")
def merge_feedback(spark, sf_dir):
    training = emails(spark, sf_dir, labelled=True).filter("label IS NOT NULL").select(
        F.col("body").alias("text"), "label")
    merged = FB.merge(training, derived.feedback(spark, sf_dir))
    return merged.groupBy("label").agg(F.count("*").alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


@query("retrain_trigger", f"""WITH {S.EMAILS}, {S.FEEDBACK} SELECT count(*) AS n_feedback, n_new, n_new >= 50 AS learner_due,
  n_new >= 100 AS scheduler_due FROM (SELECT count(*) FILTER (WHERE timestamp > TIMESTAMP '2024-01-02 00:00:00') AS n_new FROM feedback), feedback
GROUP BY n_new""")
def retrain_trigger(spark, sf_dir):
    return FB.retrain_trigger(derived.feedback(spark, sf_dir), "2024-01-02 00:00:00")


@query("feedback_join", f"""WITH {S.EMAILS}, {S.FEEDBACK}, {S.SCORES}
SELECT f.id, f.model_used, f.correct_label, s.prediction, s.p_spam FROM feedback f
JOIN scores s ON s.email_id = f.id AND s.model = f.model_used""")
def feedback_join(spark, sf_dir):
    matched = FB.match(derived.feedback(spark, sf_dir).drop("email_text"), derived.scores(spark, sf_dir))
    return matched.select("id", "model_used", "correct_label", "prediction", "p_spam")


@query("blocklist_seed", f"""WITH {S.REPORTS}, {S.SEEDS}, latest AS (
  SELECT lower(domain) AS domain, max(added_at) AS added_at FROM reports GROUP BY 1)
SELECT domain, CAST(epoch_us(added_at) AS BIGINT) AS added_at FROM latest
UNION ALL SELECT domain, CAST(epoch_us(added_at) AS BIGINT) FROM seeds WHERE domain NOT IN (SELECT domain FROM latest)""")
def blocklist_seed(spark, sf_dir):
    current = B.upsert(B.empty(spark), derived.reports(spark, sf_dir))
    return B.insert_missing(current, B.seeds(spark)).select("domain", F.unix_micros("added_at").alias("added_at"))


_UPSERT = f"""{S.REPORTS}, {S.SEEDS}, both_sides AS (
  SELECT lower(domain) AS domain, reason, added_at FROM reports UNION ALL SELECT domain, reason, added_at FROM seeds),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY added_at DESC NULLS LAST, reason DESC) AS rn FROM both_sides),
blocklist AS (SELECT domain, reason, added_at FROM ranked WHERE rn = 1)"""


def _blocklist(spark, sf_dir):
    return B.upsert(B.seeds(spark), derived.reports(spark, sf_dir))


@query("blocklist_upsert", f"WITH {_UPSERT} SELECT domain, reason, CAST(epoch_us(added_at) AS BIGINT) AS added_at FROM blocklist")
def blocklist_upsert(spark, sf_dir):
    return _blocklist(spark, sf_dir).withColumn("added_at", F.unix_micros("added_at"))


@query("blocklist_store", f"WITH {_UPSERT} SELECT domain, reason, CAST(epoch_us(added_at) AS BIGINT) AS added_at FROM blocklist")
def blocklist_store(spark, sf_dir):
    """The same by writing reports into the stored list, of which only the touched buckets are rewritten."""
    path = scratch_path(spark, "blocklist-store")
    kept.create_keyed(B.upsert(B.seeds(spark), B.empty(spark)), path, "domain")
    reports = derived.reports(spark, sf_dir).withColumn("domain", F.lower("domain"))
    kept.upsert(path, reports, "domain", B.upsert)
    return kept.read(spark, path).withColumn("added_at", F.unix_micros("added_at")).select("domain", "reason", "added_at")


@query("blocklist_count", f"WITH {_UPSERT} SELECT count(*) AS n_domains FROM blocklist")
def blocklist_count(spark, sf_dir):
    return _blocklist(spark, sf_dir).agg(F.count("*").alias("n_domains"))


@query("blocklist_lookup", f"""WITH {_UPSERT}, {S.EMAILS}, found AS (
  SELECT unnest(regexp_extract_all(body, '{S.URL}')) AS url FROM emails),
hosts AS (SELECT DISTINCT {S.host('x')} AS host FROM (SELECT {S.full_url('url')} AS x FROM found))
SELECT host, b.domain IS NOT NULL AS known_threat, b.reason FROM hosts LEFT JOIN blocklist b ON b.domain = lower(host)""")
def blocklist_lookup(spark, sf_dir):
    from mailsift.plans.forensics import url_table
    hosts = url_table(emails(spark, sf_dir)).select("host").distinct()
    return B.lookup(hosts, _blocklist(spark, sf_dir)).select("host", "known_threat", "reason")


@query("risk_with_reports", f"""WITH {S.RISK}, {_UPSERT}, hits AS (
  SELECT email_id, count(*) AS n FROM (SELECT email_id, unnest(hosts) AS host FROM risk) h
  JOIN blocklist b ON b.domain = lower(h.host) GROUP BY 1)
SELECT risk.email_id, CAST(coalesce(n, 0) AS INT) AS known_malicious_count FROM risk LEFT JOIN hits USING (email_id)""")
def risk_with_reports(spark, sf_dir):
    """Blocklist hits of every email against the full reported list, by the join that works at any size."""
    feats = R.extract_features(emails(spark, sf_dir)).select("email_id", "hosts")
    listed = B.listed_joined(feats, _blocklist(spark, sf_dir))
    return listed.select("email_id", F.size("listed").alias("known_malicious_count"))


@query("alerts", f"""WITH {S.RISK} SELECT email_id, CAST(epoch_us(received_at) AS BIGINT) AS timestamp,
  CASE WHEN risk_score >= 90 THEN 'CRITICAL' ELSE 'WARNING' END AS level, array_to_string(threat_reasons, '|') AS reasons,
  substr(body, 1, 100) || '...' AS email_preview FROM risk WHERE risk_score >= 75""")
def alerts(spark, sf_dir):
    mails = emails(spark, sf_dir, received=True).withColumn("email_preview", A.preview(F.col("body")))
    analysed = R.analyse(mails, B.seeds(spark), ("email_id", "received_at", "email_preview"))
    return A.alerts(analysed).select("email_id", F.unix_micros("timestamp").alias("timestamp"), "level",
                                     F.array_join("reasons", "|").alias("reasons"), "email_preview")


_AS_OF = "2024-01-30 12:00:00"
_DAYS = 29


@query("retention", f"""WITH {S.EMAILS}, {S.FEEDBACK} SELECT id, CAST(epoch_us(timestamp) AS BIGINT) AS timestamp FROM feedback
  WHERE coalesce(timestamp >= TIMESTAMP '{_AS_OF}' - INTERVAL {_DAYS} DAY, true)""")
def retention(spark, sf_dir):
    rows = derived.feedback(spark, sf_dir)
    return RT.kept(rows, F.to_timestamp(F.lit(_AS_OF)), _DAYS).select("id", F.unix_micros("timestamp").alias("timestamp"))


@query("retention_store", f"""WITH {S.EMAILS}, {S.FEEDBACK} SELECT id, CAST(epoch_us(timestamp) AS BIGINT) AS timestamp FROM feedback
  WHERE coalesce(timestamp >= TIMESTAMP '{_AS_OF}' - INTERVAL {_DAYS} DAY, true)""")
def retention_store(spark, sf_dir):
    """The same on a stored table by day: expired days are removed, the day of the cut-off is rewritten."""
    path = scratch_path(spark, "feedback-store")
    kept.create_daily(derived.feedback(spark, sf_dir), path, "timestamp")
    kept.expire(spark, path, _AS_OF, _DAYS)
    return kept.read(spark, path).select("id", F.unix_micros("timestamp").alias("timestamp"))


@query("retention_audit", f"""WITH {S.EMAILS}, {S.FEEDBACK}, n AS (SELECT count(*) AS n FROM feedback
  WHERE timestamp < TIMESTAMP '{_AS_OF}' - INTERVAL {_DAYS} DAY)
SELECT 'DATA_RETENTION' AS event_type, 'Deleted ' || n || ' expired records (older than {_DAYS} days)' AS details FROM n WHERE n > 0""")
def retention_audit(spark, sf_dir):
    return RT.audit(derived.feedback(spark, sf_dir), F.to_timestamp(F.lit(_AS_OF)), _DAYS).select("event_type", "details")


@query("usage_by_user", """SELECT c_custkey AS user_id, c_name AS username, count(*) AS n_requests,
  count(DISTINCT event_type) AS n_endpoints, CAST(epoch_us(max(ts)) AS BIGINT) AS last_used
FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2""")
def usage_by_user(spark, sf_dir):
    """Usage per user; the log is reduced to one row per user and endpoint before it meets the user table."""
    log = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    usage = log.groupBy("user_id").agg(F.sum("n").alias("n_requests"), F.count("*").alias("n_endpoints"),
                                       F.unix_micros(F.max("last")).alias("last_used"))
    users = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"))
    return usage.join(users, "user_id")


@query("mime_body", """SELECT doc_id AS message_id, md5(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN 'tail ' || lang ELSE '' END) AS body
FROM documents""")
def mime_body(spark, sf_dir):
    """Payloads of four shapes: plain, multipart with one text part, with two, and without any."""
    docs = table(spark, sf_dir, "documents")

    def part(kind: str, text):
        return F.struct(F.lit(kind).alias("mimeType"), mime.encode_base64url(text).alias("data"))

    text, tail, html = F.col("text"), F.concat(F.lit("tail "), F.col("lang")), F.lit("<p>x</p>")
    shape = F.col("doc_id") % 4
    parts = (F.when(shape == 1, F.array(part("text/html", html), part("text/plain", text)))
             .when(shape == 2, F.array(part("text/plain", text), part("text/plain", tail)))
             .when(shape == 3, F.array(part("text/html", html))))
    raw = docs.select(F.col("doc_id").alias("message_id"), parts.alias("parts"),
                      F.when(shape == 0, mime.encode_base64url(text)).alias("data"))
    return raw.select("message_id", F.md5(mime.body(F.col("parts"), F.col("data"))).alias("body"))


@query("export_report")
def export_report(spark, sf_dir):
    """One JSON document per email: time, text, links and the whole analysis."""
    mails = emails(spark, sf_dir, received=True)
    analysed = R.analyse(mails, B.seeds(spark), ("email_id", "received_at", "body"))
    return analysed.select("email_id", F.to_json(R.report(F.col("received_at"), F.col("body"))).alias("report"))


@query("inbox_threats", f"""WITH {S.RISK}, {S.EVIDENCE} SELECT r.email_id, risk_score, ml_prediction AS prediction FROM risk r
  JOIN evidence e USING (email_id) WHERE ml_prediction = 'spam' OR risk_score > 70""")
def inbox_threats(spark, sf_dir):
    analysed = R.analyse(emails(spark, sf_dir), B.seeds(spark)).select("email_id", "risk_score")
    scored = analysed.withColumn("prediction", derived.evidence()["ml_prediction"])
    return filter_computed(scored, D.is_inbox_threat())


@query("latest_emails", f"""WITH {S.EMAILS} SELECT email_id, CAST(epoch_us(received_at) AS BIGINT) AS received_at FROM emails
  ORDER BY emails.received_at DESC NULLS LAST, email_id DESC LIMIT 10""")
def latest_emails(spark, sf_dir):
    return mime.latest(emails(spark, sf_dir, received=True).select("email_id", "received_at")).withColumn(
        "received_at", F.unix_micros("received_at"))


_REGISTRY = f"""{S.EMAILS}, {S.SCORES}, m AS ({S.metrics('model, source')}),
seen_at AS (SELECT model, source, max(received_at) AS registered_at FROM scores GROUP BY 1, 2),
registry AS (SELECT model AS model_name, source AS dataset_version, f1_score, registered_at,
  CASE WHEN {S.unit('status', 'model', 'source')} < 0.3 THEN 'archived' ELSE 'active' END AS status,
  CAST(row_number() OVER (PARTITION BY model ORDER BY registered_at, source) AS INT) AS version
FROM m JOIN seen_at USING (model, source))"""


def _registry(spark, sf_dir):
    """One entry per model and document source, with the metrics on that source."""
    from mailsift.functions.hashing import unit
    rows = derived.scores(spark, sf_dir)
    at = rows.groupBy("model", "source").agg(F.max("received_at").alias("registered_at"))
    entries = E.metrics(rows, "model", "source").join(at, ["model", "source"])
    return G.with_versions(entries.select(
        F.col("model").alias("model_name"), F.col("source").alias("dataset_version"), "f1_score", "registered_at",
        F.when(unit("status", "model", "source") < 0.3, "archived").otherwise("active").alias("status")))


@query("registry_versions", f"WITH {_REGISTRY} SELECT model_name, dataset_version, version, status, f1_score FROM registry")
def registry_versions(spark, sf_dir):
    return _registry(spark, sf_dir).select("model_name", "dataset_version", "version", "status", "f1_score")


@query("registry_active", f"WITH {_REGISTRY} SELECT model_name, version FROM registry WHERE status = 'active'")
def registry_active(spark, sf_dir):
    return G.list_models(_registry(spark, sf_dir), "active").select("model_name", "version")


@query("registry_archive", f"""WITH {_REGISTRY} SELECT model_name, version,
  CASE WHEN f1_score < 0.5 THEN 'archived' ELSE status END AS status FROM registry""")
def registry_archive(spark, sf_dir):
    registry = _registry(spark, sf_dir)
    weak = registry.filter("f1_score < 0.5").select("model_name", "version")
    return G.archive_all(registry, weak).select("model_name", "version", "status")


@query("registry_latest", f"""WITH {_REGISTRY} SELECT model_name, version, f1_score FROM registry r WHERE status = 'active'
  AND version = (SELECT max(version) FROM registry x WHERE x.model_name = r.model_name AND x.status = 'active')""")
def registry_latest(spark, sf_dir):
    return G.latest_active(_registry(spark, sf_dir)).select("model_name", "version", "f1_score")


@query("registry_best", f"""WITH {_REGISTRY} SELECT model_name, version, f1_score FROM registry WHERE status = 'active'
  ORDER BY f1_score DESC, registered_at, model_name, version LIMIT 1""")
def registry_best(spark, sf_dir):
    return G.best_active(_registry(spark, sf_dir)).select("model_name", "version", "f1_score")


@query("default_model", f"""WITH {_REGISTRY} SELECT coalesce((SELECT model_name FROM registry WHERE status = 'active'
  ORDER BY f1_score DESC, registered_at, model_name, version LIMIT 1), '{config.DEFAULT_MODEL}') AS model_name""")
def default_model(spark, sf_dir):
    return G.default_model(_registry(spark, sf_dir))
