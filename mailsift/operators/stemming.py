"""Stemming by distinct vocabulary: of the corpus for a table of stems, of each batch for texts, which stay where they are."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from mailsift.functions.rows import explode_rows, posexplode_rows
from mailsift.functions import text as T
from mailsift.session import materialise

REPEATED_KEYS = 10_000  # keys of several texts that may be broadcast

# --- fixed values: suffix rules of the published Porter algorithm, longest first ----
STEP2 = [("ational", "ate"), ("fulness", "ful"), ("iveness", "ive"), ("ization", "ize"), ("ousness", "ous"),
         ("biliti", "ble"), ("tional", "tion"), ("alism", "al"), ("aliti", "al"), ("ation", "ate"), ("entli", "ent"),
         ("fulli", "ful"), ("iviti", "ive"), ("ousli", "ous"), ("abli", "able"), ("alli", "al"), ("anci", "ance"),
         ("ator", "ate"), ("enci", "ence"), ("izer", "ize"), ("bli", "ble"), ("eli", "e"), ("logi", "log")]
STEP3 = [("alize", "al"), ("ative", ""), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
STEP4 = ["ement", "able", "ance", "ence", "ible", "ment", "ant", "ate", "ent", "ion", "ism", "iti", "ive", "ize",
         "ous", "al", "er", "ic", "ou"]
# --- fixed values: irregular forms ---------------------------------------------------
IRREGULAR = {
    "skies": "sky", "sky": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}


def _kinds(word: str) -> str:
    """One letter per character: ``v`` for vowels, ``c`` for consonants."""
    out = ""
    for i, ch in enumerate(word):
        vowel = ch in "aeiou" or (ch == "y" and i > 0 and out[-1] == "c")
        out += "v" if vowel else "c"
    return out


def _measure(stem: str) -> int:
    return _kinds(stem).count("vc")


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _ends_cvc(stem: str) -> bool:
    kinds = _kinds(stem)
    if len(stem) == 2:
        return kinds == "vc"
    return kinds[-3:] == "cvc" and stem[-1] not in "wxy"


def _double(stem: str) -> bool:
    return len(stem) > 1 and stem[-1] == stem[-2] and _kinds(stem)[-1] == "c"


def _plural_and_past(w: str) -> str:
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and _has_vowel(w[:-len(suffix)]):
            w = w[:-len(suffix)]
            if w.endswith(("at", "bl", "iz")):
                return w + "e"
            if _double(w):
                return w if w[-1] in "lsz" else w[:-1]
            return w + "e" if _measure(w) == 1 and _ends_cvc(w) else w
    return w


def _final_y(w: str) -> str:
    if w.endswith("y") and len(w) > 2 and _kinds(w[:-1])[-1] == "c":
        return w[:-1] + "i"
    return w


def _replace(w: str, rules: list[tuple[str, str]]) -> str:
    for suffix, new in rules:
        if w.endswith(suffix):
            stem = w[:-len(suffix)]
            # "logi" needs its l to be counted with the stem
            return stem + new if _measure(stem + ("l" if suffix == "logi" else "")) > 0 else w
    return w


def _step2(w: str) -> str:
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        return _step2(w[:-4] + "al")
    return _replace(w, STEP2)


def _drop(w: str) -> str:
    for suffix in STEP4:
        if w.endswith(suffix):
            stem = w[:-len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem[-1] in "st"):
                return stem
            return w
    return w


def _tidy(w: str) -> str:
    if w.endswith("e"):
        stem = w[:-1]
        if _measure(stem) > 1 or (_measure(stem) == 1 and not _ends_cvc(stem)):
            w = stem
    return w[:-1] if w.endswith("ll") and _measure(w[:-1]) > 1 else w


def porter(word: str) -> str:
    word = word.lower()
    if word in IRREGULAR:
        return IRREGULAR[word]
    if len(word) <= 2:
        return word
    return _tidy(_drop(_replace(_step2(_final_y(_plural_and_past(word))), STEP3)))


def _stem_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch.assign(stem=batch["term"].map(porter))


def vocabulary(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct terms with their stems."""
    terms = explode_rows(texts, T.tokenize(F.col(column)), "term").distinct()
    return terms.mapInPandas(_stem_batches, "term STRING, stem STRING")


def _stem_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The second column, lists of tokens, as texts of their stems; every distinct token of a batch is stemmed once."""
    for batch in batches:
        tokens = batch.column(1)
        coded = tokens.flatten().dictionary_encode()
        stems = pa.array([porter(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
        ends = pc.cumulative_sum(pc.list_value_length(tokens).fill_null(0).cast(pa.int32()))
        lists = pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends]), stems)
        yield pa.RecordBatch.from_arrays([batch.column(0), pc.binary_join(lists, " ")], names=batch.schema.names)


def stem_texts(texts: DataFrame, key: str, column: str = "text") -> DataFrame:
    """Texts with every token replaced by its stem, in the original order; a row without a key gets an empty text.

    Nothing but keys is shuffled, unless a key comes twice: tokens of its texts are put together by their places.
    """
    again = materialise(texts.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > 1).select(F.col(key).alias("_again")),
                        "repeated-keys")
    own = texts.select(key, F.when(F.col(key).isNotNull(), T.tokenize(F.col(column))).alias(column))
    n = again.filter("_again IS NOT NULL").limit(REPEATED_KEYS + 1).count()
    again = F.broadcast(again) if n <= REPEATED_KEYS else again
    same = F.col(key) == F.col("_again")
    out = own.join(again, same, "left_anti") if n else own
    out = out.mapInArrow(_stem_tokens, StructType([texts.schema[key], StructField(column, StringType())]))
    return out.unionByName(_merged(texts.join(again, same, "left_semi"), key, column)) if n else out


def _merged(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Stemmed tokens of all texts of a key by their places; frequent terms are no hot keys, as they are grouped per key first."""
    tokens = posexplode_rows(texts, T.tokenize(F.col(column)), "term", key)
    grouped = tokens.groupBy(key, "term").agg(F.collect_list("pos").alias("positions"))
    stems = grouped.join(vocabulary(texts, column), "term")
    placed = stems.groupBy(key).agg(F.array_sort(F.flatten(F.collect_list(
        F.transform("positions", lambda p: F.struct(p.alias("pos"), F.col("stem").alias("stem")))))).alias("placed"))
    stemmed = placed.select(key, F.array_join(F.transform("placed", lambda s: s["stem"]), " ").alias(column))
    return texts.select(key).join(stemmed, key, "left").withColumn(column, F.coalesce(column, F.lit("")))
