"""Risk analysis of messages: features, score, level, reasons and flags.

The whole analysis is a projection. A message is read once, scored in place and leaves as a narrow row;
nothing is shuffled unless the blocklist is too large to travel inside the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mailsift import config
from mailsift.functions import content, headers, hosts as H, urls as U
from mailsift.functions.parts import Parts
from mailsift.operators import blocklist as B
from mailsift.session import materialise

W = config.WEIGHTS
FLAGS = ["homograph", "mixed_script", "suspicious_url", "brand_spoof", "ip_url", "cyrillic_url",
         "behavioral_threat", "domain_risk", "header_spoof", "obfuscation"]


URL, HOMOGRAPH, SCRIPT, COUNTS = Parts("url"), Parts("homograph"), Parts("script"), Parts("letters")
VIEW, OBFUSCATION, BEHAVIOUR, HEADER, FIELDS = Parts("view"), Parts("obf"), Parts("behaviour"), Parts("header"), Parts("field")


def extract_features(emails: DataFrame, keep: tuple[str, ...] = ("email_id",)) -> DataFrame:
    """Narrow features per message; the body itself is not carried on."""
    body = F.coalesce("body", F.lit(""))
    raw = F.col("raw_headers") if "raw_headers" in emails.columns else F.lit(None).cast("string")
    step = emails.select(*keep, body.alias("_body"), raw.alias("_raw"))
    body, raw = F.col("_body"), F.col("_raw")
    step = step.select(
        *keep, U.extract(body).alias("urls"), *VIEW.define(content.views(body)), *FIELDS.define(headers.fields(raw)))
    step = step.select(
        "*", F.transform("urls", U.domain).alias("domains"),
        F.array_distinct(F.filter(U.hosts(F.col("urls")), lambda h: h != "")).alias("hosts"))
    step = step.select(
        *keep, "urls", "domains", "hosts",
        *URL.define(U.features(F.col("urls"), F.col("domains"))),
        *HOMOGRAPH.define(H.homograph_counts(F.col("domains"))),
        *COUNTS.define(content.script_counts(VIEW)),
        *OBFUSCATION.define(content.obfuscation_parts(VIEW)),
        *BEHAVIOUR.define(content.behaviour_parts(VIEW)),
        *HEADER.define(headers.spoof_parts(FIELDS)),
        F.transform("hosts", H.first_label).alias("labels"))
    return (step.select("*", *SCRIPT.define(content.script_features(COUNTS)))
            .withColumns({
                "brands": H.imitated_brands(F.col("labels")),
                "behaviour_score": content.behaviour_score(BEHAVIOUR),
                "is_obfuscated": content.is_obfuscated(OBFUSCATION),
                "is_spoofed": headers.is_spoofed(HEADER),
                "is_homograph": (HOMOGRAPH["mixed"] + HOMOGRAPH["punycode"]) > 0,
            }))


def attach_listed(features: DataFrame, blocklist: DataFrame, key: str = "email_id") -> DataFrame:
    """Add ``listed``, the blocklist entries among the hosts of a message."""
    entries = B.inline_entries(blocklist)
    if entries is not None:
        return features.withColumn("listed", B.listed_inline(F.col("hosts"), entries))
    return B.listed_joined(materialise(features, "features"), blocklist, key)


def domain_threats() -> Column:
    known = F.transform("listed", lambda e: F.concat(F.lit("Known threat: "), e["reason"]))
    long_name = F.when(F.exists("hosts", H.is_long), F.array(F.lit("Excessively long domain name")))
    return F.array_distinct(F.concat(known, F.coalesce(long_name, F.array().cast("array<string>"))))


def domain_max_score() -> Column:
    """Highest points of one host: 80 when listed plus what its form adds."""
    listed = F.transform("listed", lambda e: e["domain"])
    points = F.transform("hosts", lambda h: H.structural_score(h)
                         + F.when(F.array_contains(listed, h), 80).otherwise(0))
    return F.coalesce(F.array_max(points), F.lit(0))


def _terms() -> list[tuple[Column, Column, Column]]:
    """(condition, points, messages) of every scoring rule."""
    tlds = URL["suspicious_tld_count"]

    def one(text: str | Column) -> Column:
        return F.array(F.lit(text) if isinstance(text, str) else text)

    return [
        (F.size("domain_threats") > 0, F.lit(W["domain_blacklist"]), F.col("domain_threats")),
        (F.col("is_spoofed"), F.lit(W["header_spoof"]), headers.spoof_threats(HEADER)),
        (F.col("is_obfuscated"), F.lit(W["obfuscation"]),
         content.obfuscation_threats(OBFUSCATION)),
        (F.col("is_homograph"), F.lit(W["homograph"]), one("Homograph (IDN) attack detected")),
        (SCRIPT["mixed_script"], F.lit(W["mixed_script"]), one("Mixed Unicode scripts detected")),
        (F.size("brands") > 0, F.lit(W["brand_spoof"]),
         one(F.concat(F.lit("Brand Impersonation detected: "), F.array_join("brands", ", ")))),
        (F.col("behaviour_score") > W["behavioral_threshold"], F.lit(W["behavioral_low"]),
         one("Suspicious writing behavior (Urgency/Reward Bait)")),
        (URL["has_cyrillic"], F.lit(W["cyrillic_url"]),
         one("URL contains suspicious Cyrillic characters (potential homograph attack)")),
        (URL["has_ip_url"], F.lit(W["ip_url"]), one("Url contains direct IP address")),
        (tlds > 0, tlds * W["suspicious_tld"],
         one(F.concat(F.lit("Suspicious TLD(s) detected: "), tlds.cast("string")))),
        (URL["has_shortener"], F.lit(W["url_shortener"]), one("URL shortener used")),
        (URL["url_count"] > 3, F.lit(W["multiple_urls"]), one("Multiple URLs detected (> 3)")),
    ]


def score() -> Column:
    total = F.lit(0)
    for condition, points, _ in _terms():
        total = total + F.when(condition, points).otherwise(0)
    return F.least(total, F.lit(100)).cast("int")


def reasons() -> Column:
    """Distinct messages of the rules that fired, sorted."""
    none = F.array().cast("array<string>")
    parts = [F.when(condition, messages).otherwise(none) for condition, _, messages in _terms()]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def level(score: Column) -> Column:
    return (F.when(score > config.LEVEL_HIGH, "HIGH RISK")
            .when(score > config.LEVEL_SUSPICIOUS, "SUSPICIOUS").otherwise("LOW"))


def flags() -> Column:
    return F.struct(
        F.col("is_homograph").alias("homograph"),
        SCRIPT["mixed_script"].alias("mixed_script"),
        U.is_suspicious(URL).alias("suspicious_url"),
        (F.size("brands") > 0).alias("brand_spoof"),
        URL["has_ip_url"].alias("ip_url"),
        URL["has_cyrillic"].alias("cyrillic_url"),
        (F.col("behaviour_score") > config.BEHAVIOUR_FLAG).alias("behavioral_threat"),
        (F.size("listed") > 0).alias("domain_risk"),
        F.col("is_spoofed").alias("header_spoof"),
        F.col("is_obfuscated").alias("obfuscation"))


def analyse(emails: DataFrame, blocklist: DataFrame, keep: tuple[str, ...] = ("email_id",)) -> DataFrame:
    """Kept columns plus features, ``risk_score``, ``risk_level``, ``threat_reasons`` and ``security_flags``."""
    feats = attach_listed(extract_features(emails, keep), blocklist, keep[0])
    return (feats.withColumn("domain_threats", domain_threats())
            .withColumns({"risk_score": score(), "threat_reasons": reasons(), "security_flags": flags()})
            .withColumn("risk_level", level(F.col("risk_score"))))


def is_rule_spam(score: Column) -> Column:
    return score >= config.RULE_SPAM


def override_reasons(flag: Column, score: Column) -> Column:
    """Ordered reasons for which a rule alone makes a message spam; empty when none applies."""
    return F.array_compact(F.array(
        F.when(flag["ip_url"], F.lit("Url contains direct IP address")),
        F.when(flag["homograph"], F.lit("Homograph visual spoiler detected")),
        F.when(flag["cyrillic_url"], F.lit("Suspicious Cyrillic characters in URL detected")),
        F.when(score > config.RULE_OVERRIDE, F.lit("Aggregate forensic risk critically high")),
        F.when(flag["mixed_script"], F.lit("Highly suspicious Unicode mixed-scripts detected"))))


def flag_frequency(analysed: DataFrame) -> DataFrame:
    """How many messages raise each flag, from one aggregation."""
    totals = analysed.agg(*[F.count_if(F.col(f"security_flags.{f}")).alias(f) for f in FLAGS])
    return totals.unpivot([], FLAGS, "flag", "n_emails")


def security_matrix(analysed: DataFrame) -> DataFrame:
    """The nine numeric columns that extend text features."""
    number = {
        "risk": F.col("risk_score") / 100.0,
        "homograph": F.col("security_flags.homograph"),
        "mixed_script": F.col("security_flags.mixed_script"),
        "suspicious_url": F.col("security_flags.suspicious_url"),
        "ip_url": F.col("security_flags.ip_url"),
        "url_count": URL["url_count"],
        "max_subdomains": URL["max_subdomains"],
        "has_shortener": URL["has_shortener"],
        "latin_ratio": SCRIPT["latin_ratio"],
    }
    return analysed.select("email_id", *[c.cast("double").alias(n) for n, c in number.items()])


def report(at: Column, body: Column) -> Column:
    """Export document: time, original text, links and the nested analysis."""
    def group(parts: Parts, *names: str) -> Column:
        return F.struct(*[parts[n].alias(n) for n in names])

    details = F.struct(
        group(URL, "url_count", "has_ip_url", "has_shortener", "suspicious_tld_count", "max_subdomains",
              "max_hyphens_in_domain", "long_domain_detected", "has_cyrillic").alias("urls"),
        group(SCRIPT, "latin_ratio", "greek_ratio", "cyrillic_ratio", "mixed_script").alias("scripts"),
        group(HOMOGRAPH, "mixed", "punycode").alias("homograph"),
        F.struct("brands", H.brand_similarity(F.col("labels")).alias("max_brand_similarity")).alias("brand"),
        F.struct(F.col("behaviour_score").alias("behavior_score"),
                 BEHAVIOUR["urgency_triggers"].alias("urgency_triggers"),
                 BEHAVIOUR["reward_triggers"].alias("reward_triggers")).alias("behavior"),
        F.struct(domain_max_score().alias("max_risk_score"), F.col("domain_threats").alias("threat_flags"),
                 F.size("listed").alias("known_malicious_count")).alias("domain_intel"),
        F.struct("is_spoofed", headers.spoof_threats(HEADER).alias("threats")).alias("headers"),
        F.struct("is_obfuscated", OBFUSCATION["invisible_count"].alias("invisible_count"),
                 OBFUSCATION["symbol_ratio"].alias("symbol_ratio")).alias("obfuscation"))
    analysis = F.struct("risk_score", "risk_level", "threat_reasons", "security_flags", details.alias("details"))
    return F.struct(at.alias("timestamp"), body.alias("original_email"), F.col("urls").alias("extracted_urls"),
                    analysis.alias("forensic_analysis"))
