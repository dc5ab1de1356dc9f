"""Streams in several batches: restart without duplicates, late rows, repeated deliveries."""

import datetime as dt

from pyspark.sql import functions as F

from mailsift.operators import blocklist as B, risk as R, rules
from mailsift.streaming import jobs as J

SCHEMA = "email_id LONG, received_at TIMESTAMP, body STRING, raw_headers STRING"


def write(spark, path, rows):
    start = dt.datetime(2024, 1, 1)
    data = [(i, start + dt.timedelta(minutes=m), body, "") for i, m, body in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_restart_scores_only_new_rows(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    write(spark, src, [(1, 0, "See http://earn-money.xyz today"), (2, 1, "hello")])

    def run():
        J.score_batches(J.read_files(spark, src, SCHEMA), B.seeds(spark), out, cp, "email_id", "risk_score")
        return spark.read.parquet(out).select("email_id", "risk_score")
    assert sorted(map(tuple, run().collect())) == [(1, 80), (2, 0)]
    write(spark, src, [(3, 2, "Go http://microsoft.com/x")])
    assert sorted(map(tuple, run().collect())) == [(1, 80), (2, 0), (3, 15)]


def test_alert_batches_are_replaced_not_repeated(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, src, [(1, 0, "See http://earn-money.xyz today"), (2, 1, "hello")])
    for cp in ("a", "b"):  # a second run from scratch repeats batch 0
        J.write_alerts(J.read_files(spark, src, SCHEMA), B.seeds(spark), out, str(tmp_path / cp))
    assert [r["email_id"] for r in spark.read.parquet(out).collect()] == [1]


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in ([(1, 0, "aa"), (2, 5, "aa")], [(3, 3000, "aa")], [(4, 1, "aa"), (5, 6000, "aa")]):
        write(spark, src, rows)
        stream = J.read_files(spark, src, SCHEMA).select(
            "received_at", F.lit(False).alias("is_spam"), F.length("body").alias("n_chars"))
        got = J.run_available(J.drift_windows(stream, 0.0, 2.0), "d", cp, out)
    assert sum(r["n"] for r in got.collect() if r["window_start"] == dt.datetime(2024, 1, 1)) == 2


def test_repeated_delivery(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for rows in ([(1, 0, "a"), (1, 1, "a")], [(1, 2, "a"), (2, 3, "b")]):
        write(spark, src, rows)
        got = J.run_available(J.deduplicated(J.read_files(spark, src, SCHEMA)).select("email_id"), "x", cp, out)
    assert sorted(r["email_id"] for r in got.collect()) == [1, 2]


def test_long_lists_and_lists_that_change(spark, tmp_path):
    """100,000 entries score a stream; an entry added between two batches counts for the second only."""
    src, out, cp, listed = (str(tmp_path / n) for n in ("in", "out", "cp", "list"))
    spark.range(100_000).selectExpr("concat('d', id, '.org') AS domain", "concat('r', id) AS reason",
                                    "timestamp'2024-01-01' AS added_at").write.parquet(listed)
    rows = [(1, 0, "see http://d77777.org now"), (2, 1, "see http://D5.org and http://fresh.org"), (3, 2, "see http://unknown.org"), (4, 3, "")]

    def run():
        J.score_batches(J.read_files(spark, src, SCHEMA, max_files=1), lambda: spark.read.parquet(listed), out, cp,
                        "email_id", "risk_score", "threat_reasons")
    write(spark, src, rows)
    run()
    first = {r["email_id"]: r for r in spark.read.parquet(out).collect()}
    assert len(first) == 4 and first[3]["risk_score"] < first[1]["risk_score"]
    assert any("r77777" in x for x in first[1]["threat_reasons"]) and any("r5" in x for x in first[2]["threat_reasons"])
    spark.createDataFrame([("fresh.org", "just reported", dt.datetime(2024, 1, 2))], "domain string, reason string, added_at timestamp"
                          ).write.mode("append").parquet(listed)
    write(spark, src, [(12, 1, "see http://D5.org and http://fresh.org")])
    run()
    both = {r["email_id"]: r for r in spark.read.parquet(out).collect()}
    assert any("just reported" in x for x in both[12]["threat_reasons"])
    assert not any("just reported" in x for x in both[2]["threat_reasons"])
    # The same as a table.
    batch = R.analyse(spark.read.schema(SCHEMA).parquet(src), spark.read.parquet(listed)).collect()
    table = {r["email_id"]: r["risk_score"] for r in batch}
    assert all(both[i]["risk_score"] == table[i] for i in (1, 2, 3, 4, 12))


def test_the_sieve_loses_no_listed_host(spark):
    listed = spark.range(5000).selectExpr("concat('Host', id, '.com') AS domain", "'r' AS reason", "timestamp'2024-01-01' AS added_at")
    hosts = spark.range(10_000).selectExpr("id", "array(concat('hOST', id, '.com')) AS hosts")
    found = hosts.withColumn("maybe", B.may_be_listed(F.col("hosts"), B.bloom(listed))).filter(F.size("maybe") > 0)
    ids = {r["id"] for r in found.collect()}
    assert set(range(5000)) <= ids and len(ids) < 5100


def test_late_and_rejected_rows_are_written_and_add_up(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    batches = ([(1, 600, "a"), (2, 700, None)], [(3, 650, "c"), (4, 100, "d"), (5, 800, "e")], [(6, 710, "f"), (7, 50, None), (8, 745, "g")])
    for rows in batches:
        write(spark, src, rows)
        J.split_late(J.read_files(spark, src, SCHEMA), "received_at", "60 minutes", F.col("body").isNotNull(), out, cp)
    got = {r["email_id"]: r["kind"] for r in spark.read.parquet(f"{out}/rows").collect()}
    # Limits: none, 600 - 60 (row 2 is rejected and has no say), 800 - 60.
    assert got == {1: "kept", 2: "rejected", 3: "kept", 4: "late", 5: "kept", 6: "late", 7: "rejected", 8: "kept"}


def test_messages_of_a_topic(spark):
    raw = spark.createDataFrame([(b'{"email_id": 5, "body": "hi", "other": 1}',), (b"no json",), (None,), ("{\"body\": \"\u00e9\"}".encode(),)], "value binary")
    got = [(r["email_id"], r["body"]) for r in J.parse_messages(raw, SCHEMA).collect()]
    assert got == [(5, "hi"), (None, None), (None, None), (None, "\u00e9")]


def test_sketches_keep_their_rank_error(spark):
    import random
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    rows = [(start + dt.timedelta(seconds=rng.randrange(3600)), rng.choice(["error", "view"]), rng.lognormvariate(0, 1)) for _ in range(30_000)]
    events = spark.createDataFrame(rows + [(start + dt.timedelta(hours=2), "view", None)], "ts timestamp, event_type string, value double")
    for width, slide in (("1 hour", None), ("5 minutes", "1 minute")):
        got = rules.from_minutes(rules.minute_sketches(events), width, slide).collect()
        span = dt.timedelta(hours=1) if slide is None else dt.timedelta(minutes=5)
        for r in got:
            own = [x for x in rows if r["window_start"] <= x[0] < r["window_start"] + span]
            if own:
                assert r["n"] == len(own) and r["errors"] == sum(x[1] == "error" for x in own)
                assert abs(sum(x[2] <= r["p95"] for x in own) / len(own) - 0.95) <= rules.RANK_ERROR + 1 / len(own)
            else:
                assert r["p95"] is None
        assert len(got) >= 2


def test_tables_of_one_file_or_of_many_are_streamed_whole(spark, tmp_path):
    from mailsift.plans import streams
    folder = str(tmp_path / "folder" / "documents.parquet")
    docs = spark.createDataFrame([(i, f"See http://earn-money.xyz today {i}") for i in range(40)], "doc_id LONG, text STRING")
    docs.repartition(3).write.parquet(folder)
    part = str(tmp_path / "parts")
    docs.coalesce(1).write.parquet(part)
    (tmp_path / "file").mkdir()
    next((tmp_path / "parts").glob("*.parquet")).rename(tmp_path / "file" / "documents.parquet")
    want = None
    for kind in ("folder", "file"):
        scored = sorted(map(tuple, streams.stream_score(spark, str(tmp_path / kind)).collect()))
        assert [r[0] for r in scored] == list(range(40))
        want = want or scored
        assert scored == want
