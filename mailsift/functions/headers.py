"""Sender headers: parsing and spoofing signals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mailsift.functions import patterns as P
from mailsift.functions.parts import Parts

_LINE_BREAK = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{P.SPACE}+|{P.SPACE}+$", "")


def entries(raw: Column) -> Column:
    """``ARRAY<STRUCT<key,value>>`` of the lines with a colon, in order, keys in lower case."""
    lines = F.filter(F.split(raw, _LINE_BREAK), lambda x: x.contains(":"))
    return F.transform(lines, lambda x: F.struct(
        F.lower(_strip(F.substring_index(x, ":", 1))).alias("key"),
        _strip(F.regexp_replace(x, r"(?s)^[^:]*:", "")).alias("value"),
    ))


def lookup(parsed: Column, key: str) -> Column:
    """Value of the last entry with the key, empty when absent."""
    return F.coalesce(F.try_element_at(F.filter(parsed, lambda e: e["key"] == key), F.lit(-1))["value"], F.lit(""))


def as_map(parsed: Column) -> Column:
    """Map of the entries; the last of several equal keys wins."""
    last = F.filter(parsed, lambda e, i: ~F.exists(
        F.slice(parsed, i + 2, F.size(parsed)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)


def fields(raw: Column) -> dict[str, Column]:
    parsed = entries(F.coalesce(raw, F.lit("")))
    return {
        "from": lookup(parsed, "from"),
        "return_path": lookup(parsed, "return-path"),
        "reply_to": lookup(parsed, "reply-to"),
        "auth": F.lower(lookup(parsed, "authentication-results")),
    }


def spoof_parts(f: Parts) -> dict[str, Column]:
    """Signals from the columns of :func:`fields`."""
    from_domain = F.regexp_extract(f["from"], P.HEADER_DOMAIN, 1)
    path_domain = F.regexp_extract(f["return_path"], P.HEADER_DOMAIN, 1)
    return {
        "mismatched_domains": (from_domain != "") & (path_domain != "") & (from_domain != path_domain),
        "reply_differs": (f["reply_to"] != "") & (f["from"] != "") & (F.lower(f["reply_to"]) != F.lower(f["from"])),
        "spf_failed": f["auth"].contains("spf=fail") | f["auth"].contains("spf=softfail"),
        "dkim_failed": f["auth"].contains("dkim=fail"),
    }


def is_spoofed(parts: Parts) -> Column:
    return parts["mismatched_domains"] | parts["spf_failed"] | parts["dkim_failed"]


def spoof_threats(parts: Parts) -> Column:
    return F.array_compact(F.array(
        F.when(parts["mismatched_domains"], F.lit("From domain mismatch with Return-Path")),
        F.when(parts["reply_differs"], F.lit("Reply-To differs from From address")),
        F.when(parts["spf_failed"], F.lit("SPF authentication failed")),
        F.when(parts["dkim_failed"], F.lit("DKIM authentication failed")),
    ))
