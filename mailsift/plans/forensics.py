"""Queries on links, hosts, headers, content and risk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift import config
from mailsift.functions import headers as HD, hosts as H, urls as U
from mailsift.functions.rows import explode_rows, posexplode_rows
from mailsift.operators import blocklist as B, risk as R
from mailsift.operators.domains import cluster_analysis
from mailsift.plans import sqlparts as S
from mailsift.plans.catalog import query
from mailsift.sources.emails import emails, table


def analysed(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ("email_id",), **source) -> DataFrame:
    return R.analyse(emails(spark, sf_dir, **source), B.seeds(spark), keep)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.attach_listed(R.extract_features(emails(spark, sf_dir)), B.seeds(spark))


def url_table(mails: DataFrame) -> DataFrame:
    """One row per link: ``email_id, pos, url, domain, host``."""
    found = posexplode_rows(mails, U.extract(F.col("body")), "url", "email_id")
    full = found.withColumn("full", U.with_scheme(U.decode(F.col("url"))))
    return full.select("email_id", "pos", "url", U.domain(F.col("url")).alias("domain"),
                       U.host(F.col("full")).alias("host"))


_URLS = f"""{S.EMAILS}, found AS (SELECT email_id, regexp_extract_all(body, '{S.URL}') AS l FROM emails),
urls AS (SELECT email_id, CAST(i AS INT) AS pos, l[i + 1] AS url
  FROM (SELECT email_id, l, unnest(range(len(l))) AS i FROM found)),
full_urls AS (SELECT *, {S.full_url('url')} AS x FROM urls)"""


@query("url_extract", f"WITH {_URLS} SELECT email_id, pos, url FROM urls")
def url_extract(spark, sf_dir):
    return posexplode_rows(emails(spark, sf_dir), U.extract(F.col("body")), "url", "email_id")


@query("url_domains", f"""WITH {_URLS} SELECT {S.domain('url')} AS domain, count(*) AS n_links,
  count(DISTINCT email_id) AS n_emails FROM urls GROUP BY 1""")
def url_domains(spark, sf_dir):
    """Links and emails per domain. Counting per email first keeps a popular domain from becoming a hot spot."""
    found = explode_rows(emails(spark, sf_dir), U.extract(F.col("body")), "url", "email_id")
    per_mail = found.groupBy(U.domain(F.col("url")).alias("domain"), "email_id").agg(F.count("*").alias("n"))
    return per_mail.groupBy("domain").agg(F.sum("n").alias("n_links"), F.count("*").alias("n_emails"))


@query("url_normalize", f"""WITH {_URLS}
SELECT email_id, pos, x AS original, {S.host('x')} AS normalized_host,
  CASE WHEN NOT {S.broken('x')} THEN rtrim(regexp_replace(regexp_extract(x, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/') END AS path,
  CASE WHEN NOT {S.broken('x')} THEN regexp_extract(x, '^(https?)://', 1) END AS scheme,
  CASE WHEN NOT {S.broken('x')} THEN regexp_extract(x, '^[^?#]*\\?([^#]*)', 1) END AS query,
  CASE WHEN NOT {S.broken('x')} THEN regexp_extract(x, '^(https?)://', 1) || '://' || {S.host('x')} ||
    rtrim(regexp_replace(regexp_extract(x, '^https?://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/') END AS full_normalized
FROM full_urls""")
def url_normalize(spark, sf_dir):
    found = posexplode_rows(emails(spark, sf_dir), U.extract(F.col("body")), "url", "email_id")
    full = found.select("email_id", "pos", U.with_scheme(U.decode(F.col("url"))).alias("full"))
    return full.select("email_id", "pos", U.normalize_full(F.col("full")).alias("n")).select("email_id", "pos", "n.*")


@query("page_hosts", f"""WITH p AS (SELECT page_id, {S.full_url('url')} AS x FROM pages)
SELECT {S.host('x')} AS host, count(*) AS n_pages FROM p GROUP BY 1""")
def page_hosts(spark, sf_dir):
    full = table(spark, sf_dir, "pages").select(U.with_scheme(U.decode(F.col("url"))).alias("full"))
    return full.groupBy(U.host(F.col("full")).alias("host")).agg(F.count("*").alias("n_pages"))


_URL_FEATURES = ["url_count", "has_ip_url", "has_shortener", "suspicious_tld_count", "max_subdomains",
                 "max_hyphens_in_domain", "long_domain_detected", "has_cyrillic"]


@query("url_features", f"WITH {S.RISK} SELECT email_id, {', '.join(_URL_FEATURES)}, suspicious_url AS is_url_suspicious FROM risk")
def url_features(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", *[R.URL[n].alias(n) for n in _URL_FEATURES], U.is_suspicious(R.URL).alias("is_url_suspicious"))


@query("homograph", f"""WITH {S.RISK} SELECT email_id, is_homograph AS homograph_detected,
  n_mixed > 0 AS mixed_script_domain, CAST(n_mixed + n_punycode AS INT) AS homograph_count FROM risk""")
def homograph(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", F.col("is_homograph").alias("homograph_detected"),
        (R.HOMOGRAPH["mixed"] > 0).alias("mixed_script_domain"),
        (R.HOMOGRAPH["mixed"] + R.HOMOGRAPH["punycode"]).alias("homograph_count"))


@query("script_ratio", f"WITH {S.RISK} SELECT email_id, latin_ratio, greek_ratio, cyrillic_ratio, mixed_script FROM risk")
def script_ratio(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", *[R.SCRIPT[n].alias(n) for n in ("latin_ratio", "greek_ratio", "cyrillic_ratio", "mixed_script")])


_SIM = "greatest(" + ", ".join(
    f"CASE WHEN m <> '{b}' THEN greatest(CASE WHEN {S.similar('m', b)} > 0.75 THEN {S.similar('m', b)} ELSE 0 END, "
    f"CASE WHEN {S.variant('m', b)} THEN 0.9 ELSE 0 END) ELSE 0 END" for b in config.BRANDS) + ")"


@query("brand_spoof", f"""WITH {S.RISK} SELECT email_id, len(brands) > 0 AS brand_impersonation_detected,
  array_to_string(brands, ',') AS impersonated_brands,
  coalesce(round_even(list_max(list_transform(labels, lambda m: CAST({_SIM} AS DOUBLE))), 2), 0.0) AS max_brand_similarity
FROM risk""")
def brand_spoof(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", (F.size("brands") > 0).alias("brand_impersonation_detected"),
        F.array_join("brands", ",").alias("impersonated_brands"),
        H.brand_similarity(F.col("labels")).alias("max_brand_similarity"))


@query("obfuscation", f"""WITH {S.RISK} SELECT email_id, CAST(invisible_count AS INT) AS invisible_count, repetition,
  round(symbol_ratio, 6) AS symbol_ratio, is_obfuscated FROM risk""")
def obfuscation(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", R.OBFUSCATION["invisible_count"].alias("invisible_count"),
        R.OBFUSCATION["repetition"].alias("repetition"),
        F.round(R.OBFUSCATION["symbol_ratio"], 6).alias("symbol_ratio"), "is_obfuscated")


@query("text_behavior", f"""WITH {S.RISK} SELECT email_id, CAST(behaviour_score AS INT) AS behavior_score,
  n_urgency > 0 AS is_urgent, n_reward > 0 AS is_reward_bait, high_caps AS high_caps_flag,
  exclamations > 3 AS exclamation_excess FROM risk""")
def text_behavior(spark, sf_dir):
    p = R.BEHAVIOUR
    return features(spark, sf_dir).select(
        "email_id", F.col("behaviour_score").alias("behavior_score"),
        (F.size(p["urgency_triggers"]) > 0).alias("is_urgent"), (F.size(p["reward_triggers"]) > 0).alias("is_reward_bait"),
        p["high_caps_flag"].alias("high_caps_flag"), (p["exclamations"] > 3).alias("exclamation_excess"))


@query("headers_parse", f"""WITH {S.EMAILS}, lines AS (
  SELECT email_id, unnest(string_split(raw_headers, chr(10))) AS x FROM emails)
SELECT email_id, {S.strip('lower(split_part(x, chr(58), 1))')} AS key,
  {S.strip("regexp_replace(x, '^[^:]*:', '')")} AS value FROM lines WHERE contains(x, ':')""")
def headers_parse(spark, sf_dir):
    parsed = F.explode(F.map_entries(HD.as_map(HD.entries(F.col("raw_headers")))))
    return emails(spark, sf_dir).select("email_id", parsed.alias("e")).select("email_id", "e.key", "e.value")


@query("header_spoof", f"""WITH {S.RISK} SELECT email_id, is_spoofed, mismatched_domains, reply_differs, spf_failed,
  dkim_failed FROM risk""")
def header_spoof(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", "is_spoofed",
        *[R.HEADER[n].alias(n) for n in ("mismatched_domains", "reply_differs", "spf_failed", "dkim_failed")])


@query("domain_intel", f"""WITH {S.RISK} SELECT email_id, CAST(domain_max_score AS INT) AS max_risk_score,
  array_to_string(list_sort(domain_threats), '|') AS threat_flags, CAST(len(listed) AS INT) AS known_malicious_count
FROM risk""")
def domain_intel(spark, sf_dir):
    return features(spark, sf_dir).select(
        "email_id", R.domain_max_score().alias("max_risk_score"),
        F.array_join(F.array_sort(R.domain_threats()), "|").alias("threat_flags"),
        F.size("listed").alias("known_malicious_count"))


@query("ip_cluster", f"""WITH {_URLS}, nodes AS (SELECT DISTINCT {S.domain('url')} AS domain, email_id FROM urls),
shared AS (SELECT domain, email_id % 97 AS ip FROM nodes), distinct_nodes AS (
  SELECT domain, min(ip) AS ip FROM shared GROUP BY 1),
n AS (SELECT ip, count(*) AS c FROM distinct_nodes GROUP BY 1)
SELECT domain, c > 5 AS network_threat, 'IP_Cluster_' || CAST(distinct_nodes.ip AS VARCHAR) AS cluster_id, c AS shared_domains
FROM distinct_nodes JOIN n USING (ip)""")
def ip_cluster(spark, sf_dir):
    """Domains sharing an address; the address here is derived from the first sender of the domain."""
    nodes = url_table(emails(spark, sf_dir)).groupBy("domain").agg(F.min(F.col("email_id") % 97).alias("ip"))
    return cluster_analysis(nodes)


@query("risk_score", f"WITH {S.RISK} SELECT email_id, risk_score, risk_level FROM risk")
def risk_score(spark, sf_dir):
    return analysed(spark, sf_dir).select("email_id", "risk_score", "risk_level")


@query("risk_level_counts", f"""WITH {S.RISK} SELECT risk_level, count(*) AS n_emails,
  CAST(sum(risk_score) AS BIGINT) AS total_score FROM risk GROUP BY 1""")
def risk_level_counts(spark, sf_dir):
    return analysed(spark, sf_dir).groupBy("risk_level").agg(
        F.count("*").alias("n_emails"), F.sum("risk_score").alias("total_score"))


@query("risk_rollup", f"""WITH {S.RISK} SELECT coalesce(risk_level, 'ALL') AS risk_level, coalesce(lang, 'ALL') AS lang,
  count(*) AS n_emails, round(avg(risk_score), 4) AS avg_score FROM risk GROUP BY ROLLUP (risk_level, lang)""")
def risk_rollup(spark, sf_dir):
    lang = table(spark, sf_dir, "documents").select("doc_id", "lang")
    scored = analysed(spark, sf_dir).select("email_id", "risk_level", "risk_score")
    joined = scored.join(lang, scored["email_id"] == lang["doc_id"])
    return joined.rollup("risk_level", "lang").agg(
        F.count("*").alias("n_emails"), F.round(F.avg("risk_score"), 4).alias("avg_score")).select(
        F.coalesce("risk_level", F.lit("ALL")).alias("risk_level"), F.coalesce("lang", F.lit("ALL")).alias("lang"),
        "n_emails", "avg_score")


@query("threat_reasons", f"WITH {S.RISK} SELECT email_id, array_to_string(threat_reasons, '|') AS reasons FROM risk")
def threat_reasons(spark, sf_dir):
    return analysed(spark, sf_dir).select("email_id", F.array_join("threat_reasons", "|").alias("reasons"))


_FLAGS_SQL = {
    "homograph": "is_homograph", "mixed_script": "mixed_script", "suspicious_url": "suspicious_url",
    "brand_spoof": "len(brands) > 0", "ip_url": "has_ip_url", "cyrillic_url": "has_cyrillic",
    "behavioral_threat": "behaviour_score > 50", "domain_risk": "len(listed) > 0",
    "header_spoof": "is_spoofed", "obfuscation": "is_obfuscated"}


@query("security_flags", f"WITH {S.RISK} SELECT email_id, "
       + ", ".join(f"{e} AS {n}" for n, e in _FLAGS_SQL.items()) + " FROM risk")
def security_flags(spark, sf_dir):
    return analysed(spark, sf_dir).select("email_id", "security_flags.*")


@query("flag_frequency", f"WITH {S.RISK} " + " UNION ALL ".join(
    f"SELECT '{n}' AS flag, count(*) FILTER (WHERE {e}) AS n_emails FROM risk" for n, e in _FLAGS_SQL.items()))
def flag_frequency(spark, sf_dir):
    return R.flag_frequency(analysed(spark, sf_dir))


@query("rule_spam", f"WITH {S.RISK} SELECT email_id, risk_score >= 75 AS is_rule_spam FROM risk")
def rule_spam(spark, sf_dir):
    return analysed(spark, sf_dir).select("email_id", R.is_rule_spam(F.col("risk_score")).alias("is_rule_spam"))


@query("rules_override", f"""WITH {S.RISK}, r AS (SELECT email_id, list_filter([
  CASE WHEN has_ip_url THEN 'Url contains direct IP address' END,
  CASE WHEN is_homograph THEN 'Homograph visual spoiler detected' END,
  CASE WHEN has_cyrillic THEN 'Suspicious Cyrillic characters in URL detected' END,
  CASE WHEN risk_score > 75 THEN 'Aggregate forensic risk critically high' END,
  CASE WHEN mixed_script THEN 'Highly suspicious Unicode mixed-scripts detected' END], lambda x: x IS NOT NULL) AS l FROM risk)
SELECT email_id, len(l) > 0 AS rule_spam_flag, array_to_string(l, '|') AS reason FROM r""")
def rules_override(spark, sf_dir):
    reasons = R.override_reasons(F.col("security_flags"), F.col("risk_score"))
    return (analysed(spark, sf_dir).select("email_id", reasons.alias("l"))
            .select("email_id", (F.size("l") > 0).alias("rule_spam_flag"), F.array_join("l", "|").alias("reason")))


# The matrix scores the text alone, without headers.
_TEXT_RISK = S.RISK.replace(S.HEADERS_SQL, "''")


@query("security_matrix", f"""WITH {_TEXT_RISK} SELECT email_id, risk_score / 100.0::DOUBLE AS risk,
  CAST(is_homograph AS DOUBLE) AS homograph, CAST(mixed_script AS DOUBLE) AS mixed_script,
  CAST(suspicious_url AS DOUBLE) AS suspicious_url, CAST(has_ip_url AS DOUBLE) AS ip_url,
  CAST(url_count AS DOUBLE) AS url_count, CAST(max_subdomains AS DOUBLE) AS max_subdomains,
  CAST(has_shortener AS DOUBLE) AS has_shortener, latin_ratio FROM risk""")
def security_matrix(spark, sf_dir):
    return R.security_matrix(R.analyse(emails(spark, sf_dir).drop("raw_headers"), B.seeds(spark)))
