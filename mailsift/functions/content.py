"""Signals in the text itself: scripts, obfuscation and persuasion."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import config
from mailsift.functions import patterns as P
from mailsift.functions.parts import Parts


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _removed(text: Column, runs: str) -> Column:
    """Number of characters in runs of a class; deleting runs is cheaper than listing single matches."""
    return F.length(text) - F.length(F.regexp_replace(text, runs, ""))


def views(text: Column) -> dict[str, Column]:
    """What the counts below work on. Most text is ASCII, so the rare rest is split off once."""
    return {
        "text": text,
        "low": F.lower(text),
        "other": F.regexp_replace(text, P.ASCII_RUN, ""),
        "letters": _removed(text, P.ASCII_LETTERS),
    }


def script_counts(view: Parts) -> dict[str, Column]:
    other, ascii_letters = view["other"], view["letters"]
    return {
        "n_letters": ascii_letters + count(other, r"\p{L}"),
        "n_latin": ascii_letters + count(other, P.script_letters("LATIN")),
        "n_greek": count(other, P.script_letters("GREEK")),
        "n_cyrillic": count(other, P.script_letters("CYRILLIC")),
    }


def script_features(counts: Parts) -> dict[str, Column]:
    """Ratios over letters from the columns of :func:`script_counts`; text without letters counts as Latin."""
    total = F.nullif(counts["n_letters"], F.lit(0))

    def ratio(name: str, default: float) -> Column:
        return F.coalesce(F.bround(counts[name] / total, 3), F.lit(default))

    return {
        "latin_ratio": ratio("n_latin", 1.0),
        "greek_ratio": ratio("n_greek", 0.0),
        "cyrillic_ratio": ratio("n_cyrillic", 0.0),
        "mixed_script": (counts["n_latin"] > 0) & ((counts["n_greek"] > 0) | (counts["n_cyrillic"] > 0)),
    }


def obfuscation_parts(view: Parts) -> dict[str, Column]:
    text, other = view["text"], view["other"]
    symbols = _removed(text, P.ASCII_SYMBOLS) + count(other, P.SYMBOL)
    return {
        "invisible_count": count(other, P.INVISIBLE),
        "repetition": text.rlike(P.REPEATED),
        "symbol_ratio": F.when(text != "", symbols / F.length(text)).otherwise(0.0),
    }


def is_obfuscated(parts: Parts) -> Column:
    return (parts["invisible_count"] > 0) | parts["repetition"] | (parts["symbol_ratio"] > 0.4)


def obfuscation_threats(parts: Parts) -> Column:
    return F.array_compact(F.array(
        F.when(parts["invisible_count"] > 0, F.format_string(
            "Detected %d zero-width / invisible characters", parts["invisible_count"])),
        F.when(parts["repetition"], F.lit("Excessive character repetition detected")),
        F.when(parts["symbol_ratio"] > 0.4, F.format_string(
            "Suspicious symbol ratio: %.1f%%", parts["symbol_ratio"] * 100)),
    ))


def _found(low: Column, words: list[str]) -> Column:
    return F.array_compact(F.array(*[F.when(low.contains(w), F.lit(w)) for w in words]))


def behaviour_parts(view: Parts) -> dict[str, Column]:
    text, low = view["text"], view["low"]
    capitals = _removed(text, P.ASCII_UPPER) + count(view["other"], P.UPPER)
    return {
        "urgency_triggers": _found(low, config.URGENCY_WORDS),
        "reward_triggers": _found(low, config.REWARD_WORDS),
        "exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "high_caps_flag": F.when(text != "", capitals / F.length(text) > 0.3).otherwise(False),
    }


def behaviour_score(parts: Parts) -> Column:
    """15 per urgency phrase, 10 per reward word, 5 per exclamation mark up to 20, 20 for shouting; at most 100."""
    score = (F.size(parts["urgency_triggers"]) * 15 + F.size(parts["reward_triggers"]) * 10
             + F.least(parts["exclamations"] * 5, F.lit(20)) + F.when(parts["high_caps_flag"], 20).otherwise(0))
    return F.least(score, F.lit(100))
