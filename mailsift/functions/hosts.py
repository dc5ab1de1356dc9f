"""Host forensics: look-alike scripts, brand imitation and structural hints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift import config
from mailsift.functions import patterns as P


def mixed_script(domain: Column, letters_only: bool = False) -> Column:
    """More than one kind of character by the first word of its Unicode name.

    Digits, ports and stray punctuation count as kinds of their own; ``letters_only`` leaves them out.
    """
    dropped = r"[^\p{L}]" if letters_only else r"[.\-\p{Cc}\p{Co}\p{Cs}]"
    chars = F.regexp_replace(domain, dropped, "")
    plain = chars.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, ~chars.rlike(P.single_script(True))).otherwise(~chars.rlike(P.single_script(False)))


def is_punycode(domain: Column) -> Column:
    """The IDNA form starts with ``xn--``: a non-ASCII or already encoded first label, all labels valid."""
    valid = (domain != "") & ~domain.rlike(r"(^|\.)(\.|[^.]{64,})")
    first = F.substring_index(domain, ".", 1)
    return valid & (first.startswith("xn--") | first.rlike(r"[^\x00-\x7f]"))


def homograph_counts(domains: Column) -> dict[str, Column]:
    """Per message; a domain that is both mixed and encoded counts twice."""
    return {
        "mixed": F.size(F.filter(domains, lambda d: mixed_script(d))),
        "punycode": F.size(F.filter(domains, is_punycode)),
    }


def first_label(host: Column) -> Column:
    return F.substring_index(host, ".", 1)


def _edit_distance(label: Column, brand: str) -> Column:
    """Distance where it is at most two, else -1.

    Similarity above 0.75 means 4 * distance < longer length; brands have up to nine letters, so the
    longer length is at most eleven and the distance at most two.
    """
    return F.levenshtein(label, F.lit(brand), 2)


def _similar(label: Column, brand: str) -> Column:
    d = _edit_distance(label, brand)
    return (d >= 0) & (d * 4 < F.greatest(F.length(label), F.lit(len(brand))))


def _has_variant(label: Column, brand: str) -> Column:
    test = F.lit(False)
    for variant in config.BRANDS[brand]:
        test = test | label.contains(variant)
    return test


def imitated_brands(labels: Column) -> Column:
    """Sorted distinct brands that any of the first labels imitates without being the brand itself."""
    per_brand = [
        F.when(F.exists(labels, lambda m: (m != b) & (_similar(m, b) | _has_variant(m, b))), F.lit(b))
        for b in sorted(config.BRANDS)
    ]
    return F.array_compact(F.array(*per_brand))


def brand_similarity(labels: Column) -> Column:
    """Highest similarity above 0.75 to any brand, at least 0.9 where a known variant occurs, else 0."""
    def best(m: Column) -> Column:
        scores = []
        for b in config.BRANDS:
            longer = F.greatest(F.length(m), F.lit(len(b)))
            sim = F.when(_similar(m, b), F.lit(1.0) - _edit_distance(m, b) / longer)
            var = F.when(_has_variant(m, b), F.lit(0.9))
            scores.append(F.when(m != b, F.greatest(F.coalesce(sim, F.lit(0.0)), F.coalesce(var, F.lit(0.0)))))
        return F.array_max(F.array_compact(F.array(*scores)))
    return F.bround(F.coalesce(F.array_max(F.transform(labels, best)), F.lit(0.0)), 2)


def is_long(host: Column) -> Column:
    return F.length(host) > 30


def structural_score(host: Column) -> Column:
    """Points of a host by its own form: long name 10, digit in the first label 5."""
    return (F.when(is_long(host), 10).otherwise(0)
            + F.when(first_label(host).rlike(rf"{P.DIGITS}"), 5).otherwise(0))
