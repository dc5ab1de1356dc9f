"""Stored tables changed in place: results as of whole tables, untouched partitions with their files."""

import datetime as dt
import glob
import os

from pyspark.sql import functions as F

from mailsift.operators import blocklist as B, retention as RT
from mailsift.sources import kept

LIST = "domain string, reason string, added_at timestamp"


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/*/*.parquet")}


def day(n, hour=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n, hours=hour)


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "list")
    stored = spark.createDataFrame([(f"d{i}.org", f"old {i}", day(0)) for i in range(500)], LIST)
    kept.create_keyed(stored, path, "domain", 16)
    before = files(path)
    reports = spark.createDataFrame([("d7.org", "newer", day(3)), ("d8.org", "older", day(-3)), ("fresh.org", "new", day(1)), ("fresh.org", "last", day(2))], LIST)
    touched = kept.upsert(path, reports, "domain", B.upsert, 16)
    want = sorted(map(tuple, B.upsert(stored, reports).collect()))
    assert sorted(map(tuple, kept.read(spark, path).select("domain", "reason", "added_at").collect())) == want and len(want) == 501
    after, changed = files(path), {f"{path}/_bucket={b}/" for b in touched}
    assert 1 <= len(touched) <= 3
    same = {f: t for f, t in before.items() if not any(f.startswith(c) for c in changed)}
    assert same and all(after.get(f) == t for f, t in same.items())
    # A repeated run changes nothing but the files of the same buckets.
    assert kept.upsert(path, reports, "domain", B.upsert, 16) == touched
    assert sorted(map(tuple, kept.read(spark, path).select("domain", "reason", "added_at").collect())) == want
    assert kept.upsert(path, reports.limit(0), "domain", B.upsert, 16) == []


def test_retention_rewrites_the_day_of_the_cut_only(spark, tmp_path):
    path = str(tmp_path / "feedback")
    rows = spark.createDataFrame([(i, day(i // 4, 6 * (i % 4)) if i else None) for i in range(60)], "id long, timestamp timestamp")
    kept.create_daily(rows, path, "timestamp")
    before = files(path)
    audit = kept.expire(spark, path, "2024-01-12 12:00:00", 5).collect()
    want = RT.kept(rows, F.to_timestamp(F.lit("2024-01-12 12:00:00")), 5)
    assert sorted(r["id"] for r in kept.read(spark, path).collect()) == sorted(r["id"] for r in want.collect())
    assert [r["details"] for r in audit] == [f"Deleted {rows.count() - want.count()} expired records (older than 5 days)"]
    after = files(path)
    later = {f: t for f, t in before.items() if "_day=none" in f or f.split("_day=")[1][:10] > "2024-01-07"}
    assert later and all(after.get(f) == t for f, t in later.items())
    assert not glob.glob(f"{path}/_day=2024-01-06/*.parquet") and glob.glob(f"{path}/_day=2024-01-07/*.parquet")
    assert kept.expire(spark, path, "2024-01-12 12:00:00", 5).count() == 0
