"""Literal messages with known scores, fixture totals and properties of the score."""

import pytest
from pyspark.sql import functions as F

from mailsift.operators import blocklist as B, risk as R
from mailsift.sources.emails import emails

HEADERS = "From: ceo@bank.com\nReturn-Path: x@evil.ru\nAuthentication-Results: spf=fail"
GOLDEN = [
    ("Visit https://вася.com", "", 100, "HIGH RISK", {"homograph", "mixed_script", "suspicious_url", "cyrillic_url"}),
    ("Visit https://аpple.com", "", 100, "HIGH RISK",
     {"homograph", "mixed_script", "suspicious_url", "cyrillic_url", "brand_spoof"}),
    ("Urgent: Verify your account at http://192.168.1.55", "", 45, "SUSPICIOUS", {"ip_url", "suspicious_url"}),
    ("Claim http://paypa1.xyz/login", "", 100, "HIGH RISK", {"homograph", "brand_spoof", "suspicious_url"}),
    ("See http://earn-money.xyz today", "", 80, "HIGH RISK", {"domain_risk", "suspicious_url"}),
    ("Go http://microsoft.com/x", "", 15, "LOW", set()),
    ("Free G​ift Ca​rd", "", 35, "SUSPICIOUS", {"obfuscation"}),
    ("a http://a.com http://b.com http://c.com http://d.com", "", 10, "LOW", {"suspicious_url"}),
    ("URGENT ACTION REQUIRED: ACCOUNT SUSPENDED!!! ACT NOW", "", 15, "LOW", {"behavioral_threat"}),
    ("hi", HEADERS, 40, "SUSPICIOUS", {"header_spoof"}),
    ("", "", 0, "LOW", set()),
]


@pytest.fixture(scope="module")
def analysed(spark):
    rows = [(i, g[0], g[1]) for i, g in enumerate(GOLDEN)]
    df = spark.createDataFrame(rows, "email_id LONG, body STRING, raw_headers STRING")
    return {r["email_id"]: r for r in R.analyse(df, B.seeds(spark)).collect()}


@pytest.mark.parametrize("i", range(len(GOLDEN)))
def test_golden_messages(analysed, i):
    _, _, score, level, flags = GOLDEN[i]
    row = analysed[i]
    assert (row["risk_score"], row["risk_level"]) == (score, level)
    assert {k for k, v in row["security_flags"].asDict().items() if v} == flags


def test_two_header_reasons_score_once(analysed):
    assert analysed[9]["threat_reasons"] == ["From domain mismatch with Return-Path", "SPF authentication failed"]


def test_totals_of_the_short_fixture(spark):
    """The totals published with the fixtures were computed on the first 400 characters."""
    short = emails(spark, "/root/testdata/sf0.01", text="substr(d.text, 1, 400)")
    a = R.analyse(short, B.seeds(spark))
    row = a.agg(F.count("*").alias("n"), F.sum("risk_score").alias("s"), F.sum(F.size("urls")).alias("u"),
                F.count_if(F.col("risk_level") == "HIGH RISK").alias("high"),
                *[F.count_if(F.col(f"security_flags.{f}")).alias(f) for f in R.FLAGS]).first().asDict()
    assert (row["n"], row["s"], row["u"], row["high"]) == (1000, 48790, 759, 303)
    assert [row[f] for f in R.FLAGS] == [255, 126, 378, 126, 63, 126, 67, 63, 400, 125]


def test_large_blocklist_gives_the_same_result(spark):
    mails = emails(spark, "/root/testdata/sf0.001")
    feats = R.extract_features(mails)
    inline = feats.withColumn("listed", B.listed_inline(F.col("hosts"), B.inline_entries(B.seeds(spark))))
    joined = B.listed_joined(feats, B.seeds(spark))

    def hits(df):
        return sorted((r["email_id"], tuple(r["listed"])) for r in df.select("email_id", "listed").collect())
    assert hits(inline) == hits(joined)
    assert B.inline_entries(B.seeds(spark), limit=2) is None


def test_scoring_shuffles_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mails = docs.select(F.col("doc_id").alias("email_id"), F.col("text").alias("body"))
    plan = R.analyse(mails, B.seeds(spark)).select("email_id", "risk_score")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and "Join" not in text


def test_blocklist_takes_any_spelling_repeats_and_nulls(spark):
    rows = [("Bad.Example", "old", "2020-01-01"), ("bad.example", "new", "2021-01-01"), (None, "none", "2021-01-01")]
    listed = spark.createDataFrame(rows, "domain string, reason string, added string").selectExpr(
        "domain", "reason", "CAST(added AS TIMESTAMP) AS added_at")
    hosts = spark.createDataFrame([(1, ["BAD.example", "good.example"])], "email_id long, hosts array<string>")
    from mailsift.operators import blocklist as B
    inline = hosts.withColumn("listed", B.listed_inline(hosts["hosts"], B.inline_entries(listed)))
    for df in (inline, B.listed_joined(hosts, listed)):
        assert [tuple(x) for x in df.first()["listed"]] == [("BAD.example", "new")]


def test_alerts_analyse_once(spark):
    from mailsift.plans import catalog
    catalog.load_all()
    df = catalog.QUERIES["alerts"](spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") <= 8
