"""Quality rules: surface counts, then the likelihood ratio of hashed n-grams between a trusted target and the corpus.

Only DataFrame functions; no row is moved but the bucket counts, which are combined in every task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.functions.rows import explode_rows, filter_computed
from mailsift.llm.common import narrow

SPACE = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 15
THRESHOLD = -0.05  # mean log ratio per n-gram at which a document is still kept
PRIOR = 50  # pseudo-count: buckets seen less often than this say little
TARGET_ROWS = 200_000  # labelled documents that form the target, at most


def with_words(docs: DataFrame, *keep: str) -> DataFrame:
    text = narrow(docs, *dict.fromkeys((*keep, "text"))).withColumn("text", F.coalesce("text", F.lit("")))
    return text.withColumn("words", F.array_remove(F.split("text", SPACE), ""))


def grams(words: Column) -> Column:
    """Bucket numbers of all words and of all pairs of neighbours."""
    def bucket(*parts: Column) -> Column:
        return F.pmod(F.xxhash64(*parts), F.lit(BUCKETS)).cast("int")
    singles = F.transform(words, lambda w: bucket(w))
    pairs = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                        lambda w, i: bucket(w, F.get(words, i + 1)))
    return F.concat(singles, pairs)


def surface(docs: DataFrame, *keep: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed of every document.

    Windows of three words are compared by 64-bit hash within one document.
    """
    df = with_words(docs, *keep)
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("words")
    df = df.select(
        *keep, "words", n.alias("n_words"), F.char_length(F.array_join("words", "")).alias("word_chars"),
        F.char_length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).alias("n_symbols"), lines.alias("lines"),
        F.transform(F.slice("words", 1, F.greatest(n - 2, F.lit(0))), lambda w, i: F.xxhash64(
            w, F.get("words", i + 1), F.get("words", i + 2))).alias("windows"))
    df = df.withColumn("sorted", F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    df = df.withColumn("again", F.sort_array(F.transform(
        F.filter("sorted", lambda e, k: (e["h"] == F.get("sorted", k + 1)["h"]) | (
            (k > 0) & (e["h"] == F.get("sorted", F.greatest(k - 1, F.lit(0)))["h"]))), lambda e: e["i"])))
    covered = F.aggregate(
        F.transform("again", lambda i, k: F.least(F.lit(3), F.coalesce(F.get("again", k + 1) - i, F.lit(3)))),
        F.lit(0), lambda total, x: total + x)
    df = df.select(
        *keep, "words", F.col("n_words").cast("long"), F.col("word_chars").cast("long"),
        F.col("n_symbols").cast("long"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"))
    return df.withColumn("base_failed", (F.col("n_words") < 50) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words")))


def target_ids(labels: DataFrame, most: int = TARGET_ROWS) -> DataFrame:
    """Ids of documents labelled good: all, or where there are more than ``most`` an even share chosen by hash."""
    good = narrow(labels, "doc_id", "quality").filter("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    n = good.count()
    if n > most:
        good = good.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return good


def log_ratios(docs: DataFrame, labels: DataFrame, most: int = TARGET_ROWS) -> list[float]:
    """ln p(bucket | target) - ln p(bucket | corpus) by bucket, from all documents; zeros without a target.

    The target's shares are shrunk to the corpus's by ``PRIOR`` pseudo-counts, so that a small corpus doesn't speak
    against documents only because they are not in the target.
    """
    target = F.broadcast(target_ids(labels, most).withColumn("trusted", F.lit(1)))  # at most about ``most`` ids
    df = with_words(docs, "doc_id").join(target, "doc_id", "left")
    counts = (explode_rows(df, grams(F.col("words")), "bucket", F.coalesce("trusted", F.lit(0)).alias("trusted"))
              .groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("target")))
    raw, target_n = [0] * BUCKETS, [0] * BUCKETS
    for row in counts.collect():  # one row per bucket
        raw[row["bucket"]], target_n[row["bucket"]] = row["raw"], row["target"]
    all_raw, all_target = sum(raw), sum(target_n)
    if not all_target:
        return [0.0] * BUCKETS
    share = all_target / all_raw
    return [math.log((t + PRIOR) / (r * share + PRIOR)) for r, t in zip(raw, target_n)]


def judge(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD, *keep: str) -> DataFrame:
    """Surface counts plus score and verdict. The ratios, a table of fixed size, travel in the plan."""
    table = F.split(F.lit(",".join(f"{w:.4f}" for w in ratios)), ",").cast("array<double>")
    df = surface(docs, *keep).withColumn("grams", grams(F.col("words")))
    total = F.aggregate("grams", F.lit(0.0), lambda total, b: total + F.get(table, b))
    df = df.withColumn("score", F.round(total / F.greatest(F.size("grams"), F.lit(1)), 6))
    return df.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                     (~F.col("base_failed") & (F.col("score") >= threshold)).alias("kept"), "score")


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD,
                  target_rows: int = TARGET_ROWS) -> DataFrame:
    """One row per document with its counts, score and verdict.

    Null and empty texts have no words and fail the base rule. Rows that repeat an id are judged each on its own text.
    Without good labels every score is 0 and only the base rule decides. Labels for unknown or null ids are ignored.
    An empty table gives no rows.
    """
    return judge(docs, log_ratios(docs, labels, target_rows), threshold, "doc_id")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their columns; a projection and a filter over the documents."""
    ratios = log_ratios(docs, labels)
    rows = docs.select(docs["doc_id"], docs["text"], F.struct("*").alias("doc"))
    judged = judge(rows, ratios, THRESHOLD, "doc").select("doc", "kept")
    return filter_computed(judged, F.col("kept")).select("doc.*")
