"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run of (digest, best id, count) entries, one for each digest it holds. The runs exchange in
binomial rounds: in round r, the runs whose numbers differ in digit r only meet, each gives the others the entries whose
digest has their digit, and each merges the sorted pieces it holds. After the last round a run holds all entries of its
slice of the digests. So a round moves every entry once, between ``fan_in`` partners and not between all pairs of tasks,
and a group that fills a third of the table reaches a task as at most ``fan_in`` entries. An entry is trusted only where
SHA-256, byte length and an independent 64-bit hash agree, at every level.

The answer goes back the same way: first to the runs that hold the digest, then to the rows of each run, so the rows of a
large group never meet in one task.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import materialise, narrow

KEY = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null counts as empty. Pure ASCII takes the short way with the same result."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, what identifies its normalised text - SHA-256, byte length and a second hash - and its run, the partition."""
    text = narrow(docs, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("folded"))
    return text.select("doc_id", F.unhex(F.sha2(F.col("folded"), 256)).alias("digest"),
                       F.octet_length("folded").alias("n_bytes"), F.xxhash64("folded").alias("check"),
                       F.spark_partition_id().alias("run"))


def merged(entries: DataFrame) -> DataFrame:
    """Equal digests of a run as one entry with the best id. Struct maxima are merged from sorted rows, not hashed."""
    return entries.groupBy("run", *KEY).agg(F.max(F.struct("keep_id"))["keep_id"].alias("keep_id"),
                                            F.sum("group_size").alias("group_size"))


def merge_runs(runs: DataFrame, fan_in: int = 4) -> DataFrame:
    """One row per digest: its best id (largest, null only if all are) and group size. ``fan_in`` is a power of two."""
    bits, levels = fan_in.bit_length() - 1, 0
    count = 1 + (runs.agg(F.max("run")).first()[0] or 0)
    while fan_in ** levels < count:
        levels += 1
    entries = runs
    for level in range(levels):
        mask = (fan_in - 1) << (bits * level)
        place = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long").bitwiseAND(mask).cast("int")
        moved = entries.withColumn("run", F.col("run").bitwiseAND(~mask).bitwiseOR(place))
        entries = merged(moved.repartition(fan_in ** levels, "run").sortWithinPartitions("run", *KEY))
    return entries.drop("run")


def exact_groups(docs: DataFrame, fan_in: int = 4) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts and form one group with them. Rows that repeat a doc_id are counted and reported each;
    of equal texts with equal ids all are marked kept, as no id tells them apart. A null doc_id stays only where its
    group has no other id. An empty table gives no rows.
    """
    prints = materialise(fingerprints(docs), "digests")
    runs = materialise(prints.groupBy("run", *KEY).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "runs")
    best = runs.select("run", *KEY).join(merge_runs(runs, fan_in), KEY)
    return (prints.join(best, ["run", *KEY])
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("digest")).alias("text_sha256")))


def drop_exact(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns: one row for each text, also where equal rows share an id.

    Bodies move once, by their id, so a large group of copies doesn't meet in one task.
    """
    no_id = F.lit(-(1 << 63)).cast("long")
    kept = exact_groups(docs).filter("kept").select(
        F.coalesce("doc_id", no_id).alias("id_key"), F.unhex("text_sha256").alias("sha")).distinct()
    rows = docs.select(F.coalesce(docs["doc_id"], no_id).alias("id_key"),
                       F.unhex(F.sha2(normalised(docs["text"]), 256)).alias("sha"), F.struct("*").alias("doc"))
    return rows.join(kept, ["id_key", "sha"]).dropDuplicates(["id_key", "sha"]).select("doc.*")
