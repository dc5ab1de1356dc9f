"""Text preparation as column expressions."""

from __future__ import annotations

import functools
import string
import unicodedata

from pyspark.sql import Column, functions as F

from mailsift import config
from mailsift.functions import patterns as P


def collapse(text: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{P.SPACE}+", " "))


def strip(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, rf"^{P.SPACE}+|{P.SPACE}+$", "")


def clean(text: Column) -> Column:
    """Lower case; links and addresses to tokens; digits, punctuation and space runs to blanks."""
    out = F.regexp_replace(F.lower(text), P.CLEAN_URL, " urltoken ")
    out = F.when(out.contains("@"), F.regexp_replace(out, P.CLEAN_EMAIL, " emailtoken ")).otherwise(out)
    return F.trim(F.regexp_replace(out, P.CLEAN_FILLER, " "))


def remove_punctuation(text: Column) -> Column:
    return collapse(F.regexp_replace(text, f"{P.PUNCT}+", " "))


def remove_numbers(text: Column) -> Column:
    return F.regexp_replace(text, f"{P.DIGITS}+", "")


def tokenize(text: Column) -> Column:
    """Tokens between white space; no tokens for blank text."""
    return F.filter(F.split(text, f"{P.SPACE}+"), lambda t: t != "")


def drop_stopwords(tokens: Column, words: list[str] | None = None) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(words or config.STOPWORDS))


def preprocess(text: Column, remove_stops: bool = True) -> Column:
    """Cleaned text, without stop words by default."""
    cleaned = clean(text)
    return F.array_join(drop_stopwords(tokenize(cleaned)), " ") if remove_stops else cleaned


def clean_fast(text: Column) -> Column:
    """The low-latency cleaner: punctuation and digits are deleted rather than replaced by blanks.

    Its tokens differ from those of :func:`clean`, so the two must not share a vocabulary.
    """
    out = F.translate(F.lower(text), string.punctuation, "")
    return F.array_join(drop_stopwords(tokenize(remove_numbers(out))), " ")


@functools.lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters that decompose into one ASCII letter plus marks, and those ASCII letters."""
    src, dst = [], []
    for cp in range(0x80, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(cp)) if not unicodedata.combining(c))
        if len(base) == 1 and base.isascii() and base.isalpha():
            src.append(chr(cp))
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(text: Column) -> Column:
    src, dst = _accents()
    return F.regexp_replace(F.translate(text, src, dst), r"\p{Mn}+", "")


def _masked(text: Column) -> list[Column]:
    """The text before and after each of the four replacements."""
    steps = [text]
    steps.append(F.when(text.contains("@"), F.regexp_replace(text, P.PII_EMAIL, "[EMAIL]")).otherwise(text))
    for pattern, mark in ((P.PII_PHONE, "[PHONE]"), (P.CLEAN_URL, "[URL]"), (P.PII_NAME, "[NAME]")):
        steps.append(F.regexp_replace(steps[-1], pattern, mark))
    return steps


def anonymize(text: Column) -> Column:
    """Addresses, phone numbers, links and capitalised name runs to placeholders, in this order."""
    return _masked(text)[-1]


def pii_hits(text: Column) -> dict[str, Column]:
    """How many replacements :func:`anonymize` makes of each kind."""
    patterns = {"n_email": P.PII_EMAIL, "n_phone": P.PII_PHONE, "n_url": P.CLEAN_URL, "n_name": P.PII_NAME}
    return {name: F.regexp_count(before, F.lit(pattern))
            for (name, pattern), before in zip(patterns.items(), _masked(text))}
