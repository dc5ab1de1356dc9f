"""Multinomial naive Bayes as relational aggregates over weighted terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from mailsift.operators.termcounts import chunks
from mailsift.session import materialise

ALPHA = 0.1
_ENTRIES = 1 << 18  # entries that are ranked at once
_HALF = 4e-5  # less than what rounds to a share of four digits that is not zero


def fit(long: DataFrame, vocab: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``term_id, term, lp_ham, lp_spam``: smoothed log probabilities of every vocabulary term.

    ``long`` has ``term_id, weight, label``. The result has one row per vocabulary term, so it stays small.
    """
    spam = F.col("label") == "spam"
    sums = long.groupBy("term_id").agg(
        F.sum(F.when(spam, F.col("weight")).otherwise(0.0)).alias("spam"),
        F.sum(F.when(spam, 0.0).otherwise(F.col("weight"))).alias("ham"))
    terms = vocab.select("term_id", "term").join(sums, "term_id", "left").fillna(0.0, ["spam", "ham"])
    totals = terms.agg(F.sum(F.col("spam") + alpha).alias("spam"), F.sum(F.col("ham") + alpha).alias("ham"))
    return terms.select(
        "term_id", "term",
        (F.log(F.col("ham") + alpha) - F.log(totals.select("ham").scalar())).alias("lp_ham"),
        (F.log(F.col("spam") + alpha) - F.log(totals.select("spam").scalar())).alias("lp_spam"))


def predict(vecs: DataFrame, model: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, p_spam, prediction``; class priors are the label shares."""
    n_spam = labels.agg(F.count_if(F.col("label") == "spam")).scalar()
    n_ham = labels.agg(F.count_if(F.col("label") == "ham")).scalar()
    parts = vecs.select(key, F.inline_outer("entries")).join(
        F.broadcast(model.select("term_id", "lp_ham", "lp_spam")), "term_id", "left")
    sums = parts.groupBy(key).agg(
        F.coalesce(F.sum(F.col("weight") * (F.col("lp_spam") - F.col("lp_ham"))), F.lit(0.0)).alias("gap"))
    gap = F.col("gap") + F.log(n_spam / n_ham)
    return sums.select(key, (F.lit(1.0) / (F.exp(-gap) + 1.0)).alias("p_spam")).withColumn(
        "prediction", F.when(F.col("p_spam") > 0.5, "spam").otherwise("ham"))


def coefficients(model: DataFrame) -> DataFrame:
    """The model as a linear one: ``term_id, term, coefficient`` in favour of spam."""
    return model.select("term_id", "term", (F.col("lp_spam") - F.col("lp_ham")).alias("coefficient"))


def _strongest(vecs: DataFrame, coefs: DataFrame, k: int, key: str) -> DataFrame:
    """``key, entries`` that may be among the ``k`` largest shares of their row; rounding moves a share by half of the fourth digit."""
    told = vecs.sparkSession.sparkContext.broadcast(coefs.select("term_id", "coefficient").toArrow().combine_chunks())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, values = (told.value.column(c).to_numpy() for c in ("term_id", "coefficient"))
        coefficient = np.zeros(ids.max(initial=0) + 1)
        coefficient[ids] = values
        for whole in batches:
            sizes = whole.column("entries").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for first, last in chunks(sizes, _ENTRIES):
                batch = whole.slice(first, last - first)
                lists = batch.column("entries")
                row = np.repeat(np.arange(len(lists)), sizes[first:last])
                entries = lists.flatten()
                term, weight = (entries.field(c).to_numpy(zero_copy_only=False) for c in ("term_id", "weight"))
                share = np.abs(weight * np.where(term < len(coefficient), coefficient[np.minimum(term, len(coefficient) - 1)], 0.0))
                some = np.flatnonzero(share >= _HALF)
                some = some[np.lexsort((-share[some], row[some]))]
                of, share = row[some], share[some]
                start = np.searchsorted(of, np.arange(len(lists) + 1))
                least = share[np.minimum(start[of] + k, start[of + 1]) - 1]  # the k-th share of the row, or its last
                kept = some[share >= least - 4 * _HALF]
                offsets = np.searchsorted(row[kept], np.arange(len(lists) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.ListArray.from_arrays(pa.array(offsets), entries.take(pa.array(kept)))],
                                                 names=[key, "entries"])

    return vecs.select(key, "entries").mapInArrow(run, StructType([vecs.schema[key], vecs.schema["entries"]]))


def contributions(vecs: DataFrame, coefs: DataFrame, k: int = 5, key: str = "doc_id") -> DataFrame:
    """``key, keywords``: the ``k`` terms with the largest absolute share in the score, zeros left out.

    Shares are taken against an empty document, so a share is coefficient times weight. The coefficients are
    as many as the vocabulary has terms; what cannot be among a document's top is left out within its row.
    """
    coefs = materialise(coefs, "coefficients")
    parts = _strongest(vecs, coefs, k, key).select(key, F.inline("entries")).join(F.broadcast(coefs), "term_id")
    impact = F.bround(F.col("weight") * F.col("coefficient"), 4)
    ranked = parts.withColumn("impact", impact).filter("impact <> 0").groupBy(key).agg(F.slice(F.array_sort(
        F.collect_list(F.struct((-F.abs("impact")).alias("order"), F.col("term").alias("word"), "impact"))), 1, k).alias("top"))
    return ranked.select(key, F.transform("top", lambda t: F.struct(t["word"].alias("word"), t["impact"].alias("impact"))).alias("keywords"))
