"""Queries on text preparation, anonymisation and repeated texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from mailsift import config
from mailsift.functions import text as T
from mailsift.operators import campaigns as C, stemming
from mailsift.plans import sqlparts as S
from mailsift.functions import patterns as P
from mailsift.plans.catalog import query
from mailsift.sources.emails import emails, table


@query("validate", f"""WITH {S.EMAILS} SELECT CASE WHEN length(body) BETWEEN 1 AND {config.MAX_TEXT_LENGTH}
  THEN 'accepted' ELSE 'rejected' END AS status, count(*) AS n_emails,
  CAST(sum(length({S.strip('body')})) AS BIGINT) AS n_chars FROM emails GROUP BY 1""")
def validate(spark, sf_dir):
    from mailsift.sources.loaders import accepted, rejected
    mails = emails(spark, sf_dir)
    parts = [f(mails).select(F.lit(s).alias("status"), F.length("body").alias("n"))
             for f, s in ((accepted, "accepted"), (lambda m: rejected(m).withColumn("body", T.strip(F.col("body"))), "rejected"))]
    return parts[0].unionByName(parts[1]).groupBy("status").agg(
        F.count("*").alias("n_emails"), F.sum("n").alias("n_chars"))


@query("clean_text", f"""WITH {S.EMAILS} SELECT email_id, md5({S.clean('body')}) AS cleaned,
  length({S.clean('body')}) AS n_chars FROM emails""")
def clean_text(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", T.clean(F.col("body")).alias("c")).select(
        "email_id", F.md5("c").alias("cleaned"), F.length("c").alias("n_chars"))


@query("text_helpers", f"""WITH {S.EMAILS} SELECT email_id, md5(lower(body)) AS lowered,
  md5(trim(regexp_replace(regexp_replace(body, '{P.PUNCT}+', ' ', 'g'), '{P.SPACE}+', ' ', 'g'))) AS unpunctuated,
  md5(regexp_replace(body, '{P.DIGITS}+', '', 'g')) AS without_numbers,
  CAST(len({S.tokens('body')}) AS INT) AS n_tokens FROM emails""")
def text_helpers(spark, sf_dir):
    body = F.col("body")
    return emails(spark, sf_dir).select(
        "email_id", F.md5(F.lower(body)).alias("lowered"), F.md5(T.remove_punctuation(body)).alias("unpunctuated"),
        F.md5(T.remove_numbers(body)).alias("without_numbers"), F.size(T.tokenize(body)).alias("n_tokens"))


@query("stopwords", f"""WITH {S.EMAILS}, t AS (SELECT email_id, {S.tokens('lower(body)')} AS tokens FROM emails)
SELECT email_id, CAST(len(tokens) AS INT) AS n_tokens, CAST(len({S.no_stops('tokens')}) AS INT) AS n_kept,
  md5(coalesce(array_to_string({S.no_stops('tokens')}, ' '), '')) AS kept FROM t""")
def stopwords(spark, sf_dir):
    tokens = emails(spark, sf_dir).select("email_id", T.tokenize(F.lower("body")).alias("tokens"))
    return tokens.select("email_id", "tokens", T.drop_stopwords(F.col("tokens")).alias("kept")).select(
        "email_id", F.size("tokens").alias("n_tokens"), F.size("kept").alias("n_kept"),
        F.md5(F.array_join("kept", " ")).alias("kept"))


@query("preprocess", f"""WITH {S.EMAILS} SELECT email_id, md5({S.preprocess('body')}) AS text,
  length({S.preprocess('body')}) AS n_chars FROM emails""")
def preprocess(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", T.preprocess(F.col("body")).alias("t")).select(
        "email_id", F.md5("t").alias("text"), F.length("t").alias("n_chars"))


@query("clean_text_fast", f"""WITH {S.EMAILS} SELECT email_id, md5({S.clean_fast('body')}) AS text,
  length({S.clean_fast('body')}) AS n_chars FROM emails""")
def clean_text_fast(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", T.clean_fast(F.col("body")).alias("t")).select(
        "email_id", F.md5("t").alias("text"), F.length("t").alias("n_chars"))


@query("stem_vocab")
def stem_vocab(spark, sf_dir):
    cleaned = emails(spark, sf_dir).select("email_id", T.preprocess(F.col("body")).alias("text"))
    return stemming.vocabulary(cleaned)


@query("stem_text")
def stem_text(spark, sf_dir):
    cleaned = emails(spark, sf_dir).select("email_id", T.preprocess(F.col("body")).alias("text"))
    return stemming.stem_texts(cleaned, "email_id")


# RE2 word boundaries know ASCII only. Marking every other letter or digit with underscores, which are word
# characters outside the classes of these patterns, gives the Unicode meaning; the marks are removed again.
_WIDE = r"([^\x00-\x7f\P{L}]|[^\x00-\x7f\P{N}])"


def _mark(x: str) -> str:
    return rf"regexp_replace({x}, '{_WIDE}', '_\1_', 'g')"


def _unmark(x: str) -> str:
    return rf"regexp_replace({x}, '_{_WIDE}_', '\1', 'g')"


_B = r"\b"
_PHONE = P.PII_PHONE.replace(rf"(?=[+({P.DIGITS}])", "").replace(P.EDGE, _B)
_NAME = rf"\b[A-Z][a-z]+(?:{P.SPACE}[A-Z][a-z]+)+\b"
_EMAIL = P.PII_EMAIL.replace(P.EDGE, _B)
_MASKED = f"""{S.EMAILS},
s1 AS (SELECT email_id, body AS b0, {_mark(f"regexp_replace(body, '{_EMAIL}', '[EMAIL]', 'g')")} AS b1 FROM emails),
s2 AS (SELECT *, regexp_replace(b1, '{_PHONE}', '[PHONE]', 'g') AS b2 FROM s1),
s3 AS (SELECT *, regexp_replace(b2, '{P.CLEAN_URL}', '[URL]', 'g') AS b3 FROM s2),
s4 AS (SELECT *, regexp_replace(b3, '{_NAME}', '[NAME]', 'g') AS b4 FROM s3)"""


@query("anonymize", f"WITH {_MASKED} SELECT email_id, md5({_unmark('b4')}) AS masked, length({_unmark('b4')}) AS n_chars FROM s4")
def anonymize(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", T.anonymize(F.col("body")).alias("m")).select(
        "email_id", F.md5("m").alias("masked"), F.length("m").alias("n_chars"))


@query("pii_counts", f"""WITH {_MASKED} SELECT email_id, CAST(len(regexp_extract_all(b0, '{_EMAIL}')) AS INT) AS n_email,
  CAST(len(regexp_extract_all(b1, '{_PHONE}')) AS INT) AS n_phone,
  CAST(len(regexp_extract_all(b2, '{P.CLEAN_URL}')) AS INT) AS n_url,
  CAST(len(regexp_extract_all(b3, '{_NAME}')) AS INT) AS n_name FROM s4""")
def pii_counts(spark, sf_dir):
    return emails(spark, sf_dir).select("email_id", *[c.alias(n) for n, c in T.pii_hits(F.col("body")).items()])


@query("campaigns", f"""WITH {S.EMAILS} SELECT md5({S.preprocess('body')}) AS fingerprint, count(*) AS n_emails,
  count(DISTINCT sender_id) AS n_senders, CAST(epoch_us(min(received_at)) AS BIGINT) AS first_seen,
  CAST(epoch_us(max(received_at)) AS BIGINT) AS last_seen FROM emails GROUP BY 1""")
def campaigns(spark, sf_dir):
    return C.campaigns(emails(spark, sf_dir, received=True)).withColumns({
        "first_seen": F.unix_micros("first_seen"), "last_seen": F.unix_micros("last_seen")})


@query("sample_n", f"""WITH {S.EMAILS}, n AS (SELECT CAST(floor(count(*) / 4.0) AS BIGINT) AS k FROM emails)
SELECT email_id FROM emails ORDER BY md5('42:' || CAST(email_id AS VARCHAR)), email_id LIMIT (SELECT k FROM n)""")
def sample_n(spark, sf_dir):
    from mailsift.operators.sampling import exact_sample
    ids = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("email_id"))
    return exact_sample(ids, "email_id", ids.count() // 4)
