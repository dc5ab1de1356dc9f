"""Blocklist dimension: seeding, upsert and lookup."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift import config, schemas
from mailsift.functions.rows import explode_rows

INLINE_ROWS = 1000  # up to this many entries the list travels inside the plan


def seeds(spark: SparkSession, added_at: str = "1970-01-01 00:00:00") -> DataFrame:
    rows = spark.createDataFrame(config.BLOCKLIST_SEEDS, "domain STRING, reason STRING")
    return rows.withColumn("added_at", F.to_timestamp(F.lit(added_at)))


def insert_missing(blocklist: DataFrame, new: DataFrame) -> DataFrame:
    """Add the entries whose domain is not listed yet; listed ones stay as they are."""
    return blocklist.unionByName(new.join(blocklist, "domain", "left_anti"))


def upsert(blocklist: DataFrame, reports: DataFrame) -> DataFrame:
    """One entry per lower-cased domain; the latest report replaces what was there.

    ``max_by`` is combined before the shuffle, so a domain reported by a third of all rows is no hot spot.
    """
    both = blocklist.unionByName(reports).withColumn("domain", F.lower("domain"))
    latest = F.max(F.struct("added_at", "reason"))
    return both.groupBy("domain").agg(latest.alias("last")).select(
        "domain", F.col("last.reason").alias("reason"), F.col("last.added_at").alias("added_at"))


def entries(blocklist: DataFrame) -> DataFrame:
    """Domain in lower case and reason, one row per domain: of several the latest, as in ``upsert``. Nulls are no entries."""
    last = F.max(F.struct("added_at", "reason"))["reason"]
    return blocklist.filter("domain IS NOT NULL").groupBy(F.lower("domain").alias("domain")).agg(last.alias("reason"))


def lookup(hosts: DataFrame, blocklist: DataFrame, key: str = "host") -> DataFrame:
    """Hosts with ``known_threat`` and ``reason``; the size of the list decides how Spark joins."""
    listed = entries(blocklist).withColumnRenamed("domain", "_domain")
    return (hosts.join(listed, F.lower(F.col(key)) == F.col("_domain"), "left")
            .withColumn("known_threat", F.col("_domain").isNotNull())
            .drop("_domain"))


def inline_entries(blocklist: DataFrame, limit: int = INLINE_ROWS) -> list[tuple[str, str]] | None:
    """The entries when there are at most ``limit``, else None. Never reads more than ``limit + 1`` rows."""
    rows = entries(blocklist).limit(limit + 1).collect()
    return None if len(rows) > limit else [(r["domain"], r["reason"]) for r in rows]


def listed_inline(hosts, entries: list[tuple[str, str]]):
    """``ARRAY<STRUCT<domain,reason>>`` of the listed hosts in an array column, without a join."""
    if not entries:
        return F.from_json(F.lit("[]"), "ARRAY<STRUCT<domain: STRING, reason: STRING>>")
    reasons = F.create_map(*[F.lit(x) for entry in sorted(entries) for x in entry])
    found = F.filter(hosts, lambda h: F.lower(h).isin([d for d, _ in entries]))
    return F.transform(found, lambda h: F.struct(
        h.alias("domain"), F.try_element_at(reasons, F.lower(h)).alias("reason")))


BLOOM_BITS = 1 << 20
BLOOM_HASHES = 4


def bloom(blocklist: DataFrame) -> list[int]:
    """Bloom filter of the listed domains as 64-bit words; its size is fixed, whatever the length of the list.

    Up to some 100,000 domains one unlisted host in a hundred passes; with more, more pass, and the join decides.
    """
    spots = F.explode(F.array(*[F.pmod(F.xxhash64(F.lit(k), "domain"), F.lit(BLOOM_BITS)) for k in range(BLOOM_HASHES)]))
    words = entries(blocklist).select(spots.alias("spot")).groupBy(F.floor(F.col("spot") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(spot % 64 AS int))")).alias("bits"))
    out = [0] * (BLOOM_BITS // 64)
    for r in words.collect():
        out[r["word"]] = r["bits"]
    return out


def may_be_listed(hosts, words: list[int]):
    """The hosts of an array column that the Bloom filter lets through: all listed ones and a few others."""
    table = F.from_json(F.lit(json.dumps(words)), "array<bigint>")  # one constant

    def passes(host):
        found = F.lit(True)
        for k in range(BLOOM_HASHES):
            spot = F.pmod(F.xxhash64(F.lit(k), F.lower(host)), F.lit(BLOOM_BITS))
            word = F.get(table, F.floor(spot / 64).cast("int"))
            found &= F.getbit(word, (spot % 64).cast("int")) == 1
        return found
    return F.filter(hosts, passes)


def listed_joined(df: DataFrame, blocklist: DataFrame, key: str = "email_id", hosts: str = "hosts") -> DataFrame:
    """The same column for a list of any size.

    ``df`` must be narrow and cheap to read twice. A Bloom filter of fixed size tells in place which hosts may be
    listed; only messages with such hosts are shuffled, and of their hosts only these are looked up.
    """
    sifted = df.withColumn("_maybe", may_be_listed(F.array_distinct(hosts), bloom(blocklist)))
    empty = F.from_json(F.lit("[]"), "ARRAY<STRUCT<domain: STRING, reason: STRING>>")
    clear = sifted.filter(F.size("_maybe") == 0).drop("_maybe").withColumn("listed", empty)
    rest = sifted.filter(F.size("_maybe") > 0)
    listed = entries(blocklist).withColumnRenamed("domain", "_domain")
    hits = (explode_rows(rest, "_maybe", "host", key).join(listed, F.lower("host") == F.col("_domain"))
            .groupBy(key).agg(F.collect_list(F.struct(F.col("host").alias("domain"), "reason")).alias("listed")))
    return clear.unionByName(rest.drop("_maybe").join(hits, key, "left").withColumn("listed", F.coalesce("listed", empty)))


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.BAD_DOMAINS)
