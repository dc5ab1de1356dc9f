"""Links in text: extraction, domains, normal form and structural features.

Everything works on the array of links of one message, so no message ever has to be
shuffled to be scored, and the same expressions run on streams without state.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from mailsift import config
from mailsift.functions import patterns as P
from mailsift.functions.parts import Parts


def extract(text: Column) -> Column:
    """All links in order; text without any link marker skips the full pattern."""
    found = F.regexp_extract_all(text, F.lit(P.URL), F.lit(0))
    return F.when(text.rlike(P.HAS_URL), found).otherwise(F.array().cast("array<string>"))


def domain(url: Column) -> Column:
    """Lower-cased authority without scheme and leading ``www.``; port and user stay."""
    return F.regexp_extract(F.lower(url), P.DOMAIN, 1)


def decode(url: Column) -> Column:
    """Percent-decoding that keeps ``+`` and malformed escapes."""
    protected = F.regexp_replace(F.replace(url, F.lit("+"), F.lit("%2B")), "%(?![0-9A-Fa-f]{2})", "%25")
    decoded = F.coalesce(F.try_url_decode(protected), url)
    return F.regexp_replace(decoded, rf"^{P.SPACE}+|{P.SPACE}+$", "")


def with_scheme(decoded: Column) -> Column:
    return F.when(decoded.rlike("^https?://"), decoded).otherwise(F.concat(F.lit("http://"), decoded))


def _authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://([^/?#]*)", 1)


def _broken(url: Column) -> Column:
    """One square bracket without the other: such a link has no parsable host."""
    authority = _authority(url)
    return authority.contains("[") != authority.contains("]")


def host(url: Column) -> Column:
    """Host of a decoded link with scheme: lower case, no ``www.``, no default port."""
    name = F.regexp_replace(F.lower(_authority(url)), r"^www\.", "")
    plain = (F.when(url.startswith("https:"), F.regexp_replace(name, "^([^:]*):443$", "$1"))
             .otherwise(F.regexp_replace(name, "^([^:]*):80$", "$1")))
    return F.when(_broken(url), url).otherwise(plain)


def normalize(url: Column) -> Column:
    """The six parts of a link. Where the host cannot be parsed, only the original and the host are set."""
    full = with_scheme(decode(url))
    return normalize_full(full)


def normalize_full(full: Column) -> Column:
    ok = ~_broken(full)
    scheme = F.regexp_extract(full, "^(https?)://", 1)
    raw_path = F.regexp_extract(full, r"^https?://[^/?#]*([^?#]*)", 1)
    path = F.regexp_replace(F.regexp_replace(raw_path, ";[^/]*$", ""), "/+$", "")
    query = F.regexp_extract(full, r"^[^?#]*\?([^#]*)", 1)
    return F.struct(
        full.alias("original"),
        host(full).alias("normalized_host"),
        F.when(ok, path).alias("path"),
        F.when(ok, scheme).alias("scheme"),
        F.when(ok, query).alias("query"),
        F.when(ok, F.concat(scheme, F.lit("://"), host(full), path)).alias("full_normalized"),
    )


def hosts(urls: Column) -> Column:
    """Normalised host of every link, in order. One step per lambda keeps each part evaluated once."""
    full = F.transform(F.transform(urls, decode), with_scheme)
    return F.transform(full, host)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_shortener(dom: Column, exact: bool = False) -> Column:
    """By default a shortener name anywhere in the domain counts; ``exact`` asks for the domain itself."""
    if exact:
        return dom.isin(config.SHORTENERS)
    return _any([dom.contains(s) for s in config.SHORTENERS])


def has_suspicious_tld(dom: Column) -> Column:
    return _any([dom.endswith(t) for t in config.SUSPICIOUS_TLDS])


def _count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def features(urls: Column, domains: Column) -> dict[str, Column]:
    """The eight link features of a message and the summary flag."""
    return {
        "url_count": F.size(urls),
        "has_ip_url": F.exists(urls, lambda u: u.rlike(P.IP)),
        "has_shortener": F.exists(domains, lambda d: is_shortener(d)),
        "suspicious_tld_count": F.size(F.filter(domains, has_suspicious_tld)),
        "max_subdomains": F.coalesce(F.array_max(F.transform(domains, lambda d: _count_char(d, "."))), F.lit(0)),
        "max_hyphens_in_domain": F.coalesce(
            F.array_max(F.transform(domains, lambda d: _count_char(d, "-"))), F.lit(0)),
        "long_domain_detected": F.exists(domains, lambda d: F.length(d) > 25),
        "has_cyrillic": F.exists(urls, lambda u: u.rlike(P.CYRILLIC)),
    }


def is_suspicious(feats: Parts) -> Column:
    """Summary flag over the columns of :func:`features`."""
    return (feats["has_ip_url"] | feats["has_cyrillic"] | (feats["suspicious_tld_count"] > 0)
            | (feats["url_count"] > 3) | (feats["max_subdomains"] > 2))
