"""The library from SQL: functions of messages and links, and the settings as tables that a caller may replace."""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F

from mailsift import config
from mailsift.functions import patterns as P
from mailsift.operators import blocklist as B, risk as R
from mailsift.plans import sqlparts as S
from mailsift.plans.catalog import query
from mailsift.sources.emails import emails

WORDS = {"urgency": config.URGENCY_WORDS, "reward": config.REWARD_WORDS}


def _quoted(pattern: str) -> str:
    """A SQL string that stands for exactly these characters."""
    escaped = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


FUNCTIONS = [
    f"""risk_level(score INT) RETURNS STRING
    RETURN CASE WHEN score > {config.LEVEL_HIGH} THEN 'HIGH RISK' WHEN score > {config.LEVEL_SUSPICIOUS} THEN 'SUSPICIOUS' ELSE 'LOW' END""",
    f"""url_domain(url STRING) RETURNS STRING RETURN regexp_extract(lower(url), {_quoted(P.DOMAIN)}, 1)""",
    # Text without any link marker skips the full pattern.
    f"""urls_of(text STRING) RETURNS TABLE(pos INT, url STRING) RETURN
    SELECT pos, col FROM posexplode(CASE WHEN text RLIKE {_quoted(P.HAS_URL)} THEN regexp_extract_all(text, {_quoted(P.URL)}, 0) END)""",
]


def register(spark: SparkSession) -> None:
    """Functions ``risk_level``, ``url_domain``, ``urls_of`` (for LATERAL), and the views ``mail_weights(name, weight)``,
    ``mail_brands(brand, variants)`` and ``mail_words(kind, word)``. A view of the same name replaces a setting."""
    for text in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    tables = {"mail_weights": (list(config.WEIGHTS.items()), "name string, weight int"),
              "mail_brands": (list(config.BRANDS.items()), "brand string, variants array<string>"),
              "mail_words": ([(k, w) for k, words in WORDS.items() for w in words], "kind string, word string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)


def view(spark, sf_dir: str, name: str = "mails") -> None:
    emails(spark, sf_dir).createOrReplaceTempView(name)


@query("sql_domains", f"""WITH {S.EMAILS}, u AS (SELECT unnest(regexp_extract_all(body, '{S.URL}')) AS url FROM emails)
SELECT {S.domain('url')} AS domain, count(*) AS n FROM u GROUP BY 1""")
def sql_domains(spark, sf_dir):
    """Links per domain, with the links of a text as rows."""
    register(spark)
    view(spark, sf_dir)
    return spark.sql("SELECT url_domain(u.url) AS domain, count(*) AS n FROM mails, LATERAL urls_of(body) u GROUP BY ALL")


@query("sql_risk_levels", f"WITH {S.RISK} SELECT risk_level, count(*) AS n FROM risk GROUP BY 1")
def sql_risk_levels(spark, sf_dir):
    """Emails per risk level, the level named in SQL from the score."""
    register(spark)
    R.analyse(emails(spark, sf_dir), B.seeds(spark)).select("risk_score").createOrReplaceTempView("mail_scores")
    return spark.sql("SELECT risk_level(risk_score) AS risk_level, count(*) AS n FROM mail_scores GROUP BY ALL")


_WORD_ROWS = ", ".join(f"('{k}', '{w}')" for k, words in WORDS.items() for w in words)


@query("sql_words", f"""WITH {S.EMAILS}, w(kind, word) AS (VALUES {_WORD_ROWS})
SELECT kind, word, count(*) AS n FROM emails, w WHERE contains(lower(body), word) GROUP BY ALL""")
def sql_words(spark, sf_dir):
    """Emails per phrase of the word lists, taken from their table."""
    register(spark)
    view(spark, sf_dir)
    return spark.sql("""SELECT w.kind, w.word, count(*) AS n FROM mails m
      JOIN mail_words w ON contains(lower(m.body), w.word) GROUP BY ALL""")


@query("sql_weights", f"""WITH {S.RISK} SELECT email_id, (CASE WHEN is_homograph THEN {config.WEIGHTS['homograph']} ELSE 0 END
  + CASE WHEN has_ip_url THEN {config.WEIGHTS['ip_url']} ELSE 0 END)::BIGINT AS points FROM risk""")
def sql_weights(spark, sf_dir):
    """Points of two flags by the table of weights."""
    register(spark)
    flags = R.analyse(emails(spark, sf_dir), B.seeds(spark)).select("email_id", F.expr("security_flags.homograph"), F.expr("security_flags.ip_url"))
    flags.createOrReplaceTempView("mail_flags")
    return spark.sql("""SELECT f.email_id, coalesce(sum(w.weight), 0) AS points
      FROM (SELECT email_id, explode_outer(array_compact(array(IF(homograph, 'homograph', NULL), IF(ip_url, 'ip_url', NULL)))) AS name FROM mail_flags) f
      LEFT JOIN mail_weights w ON w.name = f.name GROUP BY f.email_id""")
