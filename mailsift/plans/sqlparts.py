"""SQL fragments of the oracles: the email view and the risk rules in plain SQL."""

from __future__ import annotations

import string

from mailsift import config
from mailsift.functions import patterns as P
from mailsift.sources.emails import BODY_SQL, HEADERS_SQL, LABEL_SQL

SPAM_MODELS = ["logistic_regression", "naive_bayes", "random_forest", "svm"]

EMAILS = f"""emails AS (
  SELECT d.doc_id AS email_id, e.ts AS received_at, e.user_id AS sender_id,
    {BODY_SQL.format(text='d.text')} AS body, {HEADERS_SQL} AS raw_headers, {LABEL_SQL} AS label,
    d.lang AS lang, d.source AS source
  FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id)"""

_TLD = "|".join(config.LINK_TLDS)
URL = rf"(?:http|https)://[^{P.WS}/$.?#][^\n]{P.NONSPACE}*|www\.[^{P.WS}/$.?#][^\n]{P.NONSPACE}*|[a-zA-Z0-9.-]+\.(?:{_TLD})\b"
CLEAN_EMAIL = rf"{P.NONSPACE}+@{P.NONSPACE}+\.{P.NONSPACE}+"
STOP_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in config.STOPWORDS)


def bucket(seed: str, *keys: str, size: int) -> str:
    text = " || ':' || ".join([f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) % {size})"


def unit(seed: str, *keys: str) -> str:
    return f"({bucket(seed, *keys, size=1_000_000)} / 1000000.0::DOUBLE)"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{P.SPACE}+|{P.SPACE}+$', '', 'g')"


def clean(x: str) -> str:
    out = f"regexp_replace(lower({x}), '{P.CLEAN_URL}', ' urltoken ', 'g')"
    out = f"regexp_replace({out}, '{CLEAN_EMAIL}', ' emailtoken ', 'g')"
    out = f"regexp_replace({out}, '{P.DIGITS}+', ' ', 'g')"
    out = f"regexp_replace({out}, '{P.PUNCT}+', ' ', 'g')"
    return f"trim(regexp_replace({out}, '{P.SPACE}+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{P.SPACE}+'), lambda t: t <> '')"


def no_stops(tokens: str) -> str:
    return f"list_filter({tokens}, lambda t: t NOT IN ({STOP_LIST}))"


def preprocess(x: str) -> str:
    return f"coalesce(array_to_string({no_stops(tokens(clean(x)))}, ' '), '')"


def clean_fast(x: str) -> str:
    marks = string.punctuation.replace("'", "''")
    out = f"regexp_replace(translate(lower({x}), '{marks}', ''), '{P.DIGITS}+', '', 'g')"
    return f"coalesce(array_to_string({no_stops(tokens(out))}, ' '), '')"


def domain(u: str) -> str:
    return f"regexp_extract(lower({u}), '{P.DOMAIN}', 1)"


def full_url(u: str) -> str:
    dec = strip(f"url_decode({u})")
    return f"CASE WHEN regexp_matches({dec}, '^https?://') THEN {dec} ELSE 'http://' || {dec} END"


def authority(x: str) -> str:
    return f"regexp_extract({x}, '^https?://([^/?#]*)', 1)"


def broken(x: str) -> str:
    return f"(contains({authority(x)}, '[') <> contains({authority(x)}, ']'))"


def host(x: str) -> str:
    name = rf"regexp_replace(lower({authority(x)}), '^www\.', '')"
    return (f"CASE WHEN {broken(x)} THEN {x} WHEN starts_with({x}, 'https:') "
            rf"THEN regexp_replace({name}, '^([^:]*):443$', '\1') ELSE regexp_replace({name}, '^([^:]*):80$', '\1') END")


def mixed(d: str) -> str:
    kinds = dict(P._by_first_word(128))
    wide = P._by_first_word(0x3000)
    for script in ("LATIN", "GREEK", "CYRILLIC"):
        kinds[script] = wide[script]
    one = "^(?:" + "|".join(f"[{P._ranges(points)}]*" for points in kinds.values()) + ")$"
    one = one.replace("'", "''")
    return rf"NOT regexp_matches(regexp_replace({d}, '[.\-]', '', 'g'), '{one}')"


def punycode(d: str) -> str:
    first = f"split_part({d}, '.', 1)"
    return (rf"({d} <> '' AND NOT regexp_matches({d}, '(^|\.)(\.|[^.]{{64,}})') AND "
            rf"(starts_with({first}, 'xn--') OR regexp_matches({first}, '[^\x00-\x7f]')))")


def similar(m: str, brand: str) -> str:
    plain = rf"regexp_replace({m}, '[^\x00-\x7f]', '?', 'g')"
    return f"(1.0::DOUBLE - levenshtein({plain}, '{brand}')::DOUBLE / greatest(length({m}), {len(brand)}))"


def variant(m: str, brand: str) -> str:
    return "(" + " OR ".join(f"contains({m}, '{v}')" for v in config.BRANDS[brand]) + ")"


def imitates(m: str, brand: str) -> str:
    return f"({m} <> '{brand}' AND ({similar(m, brand)} > 0.75 OR {variant(m, brand)}))"


def count(text: str, cls: str) -> str:
    return f"len(regexp_extract_all({text}, '{cls}'))"


def any_of(items: str, var: str, test: str) -> str:
    return f"(len(list_filter({items}, lambda {var}: {test})) > 0)"


def found(low: str, words: list[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({low}, '{w}') AS INT)" for w in words) + ")"


def header(key: str) -> str:
    """Last value of a header in ``lines``."""
    name, value = strip("lower(split_part(x, ':', 1))"), strip("regexp_replace(x, '^[^:]*:', '')")
    rows = f"list_filter(lines, lambda x: contains(x, ':') AND {name} = '{key}')"
    return f"coalesce(list_extract(list_transform({rows}, lambda x: {value}), -1), '')"


W = config.WEIGHTS
_BL = " ".join(f"WHEN '{d}' THEN '{r}'" for d, r in config.BLOCKLIST_SEEDS)
_BL_LIST = ", ".join(f"'{d}'" for d, _ in config.BLOCKLIST_SEEDS)
_BRANDS = ", ".join(
    f"CASE WHEN {any_of('labels', 'm', imitates('m', b))} THEN '{b}' END" for b in sorted(config.BRANDS))
_DOM = rf"@([{P.WORD}.-]+)"

RISK = rf"""{EMAILS},
links AS (
  SELECT *, regexp_extract_all(body, '{URL}') AS urls, string_split(raw_headers, chr(10)) AS lines FROM emails),
parts AS (
  SELECT *, list_transform(urls, lambda u: {domain('u')}) AS domains,
    list_distinct(list_filter(list_transform(list_transform(urls, lambda u: {full_url('u')}),
      lambda x: {host('x')}), lambda h: h <> '')) AS hosts,
    {header('from')} AS h_from, {header('return-path')} AS h_path, {header('reply-to')} AS h_reply,
    lower({header('authentication-results')}) AS h_auth,
    {count('body', chr(92) + 'p{L}')} AS n_letters, {count('body', P.script_letters('LATIN'))} AS n_latin,
    {count('body', P.script_letters('GREEK'))} AS n_greek,
    {count('body', P.script_letters('CYRILLIC'))} AS n_cyrillic,
    {count('body', P.INVISIBLE)} AS invisible_count,
    {' OR '.join(f"contains(body, repeat('{c}', 11))" for c in string.ascii_letters + '0123456789 .-_=*#!?')} AS repetition,
    CASE WHEN length(body) > 0 THEN {count('body', P.SYMBOL)} / length(body)::DOUBLE ELSE 0 END AS symbol_ratio,
    {found('lower(body)', config.URGENCY_WORDS)} AS n_urgency, {found('lower(body)', config.REWARD_WORDS)} AS n_reward,
    length(body) - length(replace(body, '!', '')) AS exclamations,
    {count('body', P.UPPER)} / length(body)::DOUBLE > 0.3 AS high_caps
  FROM links),
feats AS (
  SELECT *, list_transform(hosts, lambda h: split_part(h, '.', 1)) AS labels,
    len(urls) AS url_count,
    {any_of('urls', 'u', f"regexp_matches(u, '{P.IP}')")} AS has_ip_url,
    {any_of('domains', 'd', ' OR '.join(f"contains(d, '{s}')" for s in config.SHORTENERS))} AS has_shortener,
    len(list_filter(domains, lambda d: {' OR '.join(f"ends_with(d, '{t}')" for t in config.SUSPICIOUS_TLDS)})) AS suspicious_tld_count,
    coalesce(list_max(list_transform(domains, lambda d: length(d) - length(replace(d, '.', '')))), 0) AS max_subdomains,
    coalesce(list_max(list_transform(domains, lambda d: length(d) - length(replace(d, '-', '')))), 0) AS max_hyphens_in_domain,
    {any_of('domains', 'd', 'length(d) > 25')} AS long_domain_detected,
    {any_of('urls', 'u', f"regexp_matches(u, '{P.CYRILLIC}')")} AS has_cyrillic,
    len(list_filter(domains, lambda d: {mixed('d')})) AS n_mixed,
    len(list_filter(domains, lambda d: {punycode('d')})) AS n_punycode,
    coalesce(round_even(n_latin / nullif(n_letters, 0)::DOUBLE, 3), 1.0) AS latin_ratio,
    coalesce(round_even(n_greek / nullif(n_letters, 0)::DOUBLE, 3), 0.0) AS greek_ratio,
    coalesce(round_even(n_cyrillic / nullif(n_letters, 0)::DOUBLE, 3), 0.0) AS cyrillic_ratio,
    n_latin > 0 AND (n_greek > 0 OR n_cyrillic > 0) AS mixed_script,
    invisible_count > 0 OR repetition OR symbol_ratio > 0.4 AS is_obfuscated,
    least(n_urgency * 15 + n_reward * 10 + least(exclamations * 5, 20) + CASE WHEN high_caps THEN 20 ELSE 0 END, 100) AS behaviour_score,
    regexp_extract(h_from, '{_DOM}', 1) <> '' AND regexp_extract(h_path, '{_DOM}', 1) <> ''
      AND regexp_extract(h_from, '{_DOM}', 1) <> regexp_extract(h_path, '{_DOM}', 1) AS mismatched_domains,
    h_reply <> '' AND h_from <> '' AND lower(h_reply) <> lower(h_from) AS reply_differs,
    contains(h_auth, 'spf=fail') OR contains(h_auth, 'spf=softfail') AS spf_failed,
    contains(h_auth, 'dkim=fail') AS dkim_failed,
    list_filter(hosts, lambda h: lower(h) IN ({_BL_LIST})) AS listed
  FROM parts),
signals AS (
  SELECT *, list_filter([{_BRANDS}], lambda b: b IS NOT NULL) AS brands,
    mismatched_domains OR spf_failed OR dkim_failed AS is_spoofed,
    n_mixed + n_punycode > 0 AS is_homograph,
    has_ip_url OR has_cyrillic OR suspicious_tld_count > 0 OR url_count > 3 OR max_subdomains > 2 AS suspicious_url,
    list_distinct(list_concat(list_transform(listed, lambda h: 'Known threat: ' || CASE lower(h) {_BL} END),
      CASE WHEN {any_of('hosts', 'h', 'length(h) > 30')} THEN ['Excessively long domain name'] ELSE [] END)) AS domain_threats,
    coalesce(list_max(list_transform(hosts, lambda h: CASE WHEN list_contains(listed, h) THEN 80 ELSE 0 END
      + CASE WHEN length(h) > 30 THEN 10 ELSE 0 END
      + CASE WHEN regexp_matches(split_part(h, '.', 1), '{P.DIGITS}') THEN 5 ELSE 0 END)), 0) AS domain_max_score
  FROM feats),
risk AS (
  SELECT *, CAST(least(100, CASE WHEN len(domain_threats) > 0 THEN {W['domain_blacklist']} ELSE 0 END
      + CASE WHEN is_spoofed THEN {W['header_spoof']} ELSE 0 END
      + CASE WHEN is_obfuscated THEN {W['obfuscation']} ELSE 0 END
      + CASE WHEN is_homograph THEN {W['homograph']} ELSE 0 END
      + CASE WHEN mixed_script THEN {W['mixed_script']} ELSE 0 END
      + CASE WHEN len(brands) > 0 THEN {W['brand_spoof']} ELSE 0 END
      + CASE WHEN behaviour_score > {W['behavioral_threshold']} THEN {W['behavioral_low']} ELSE 0 END
      + CASE WHEN has_cyrillic THEN {W['cyrillic_url']} ELSE 0 END
      + CASE WHEN has_ip_url THEN {W['ip_url']} ELSE 0 END
      + suspicious_tld_count * {W['suspicious_tld']}
      + CASE WHEN has_shortener THEN {W['url_shortener']} ELSE 0 END
      + CASE WHEN url_count > 3 THEN {W['multiple_urls']} ELSE 0 END) AS INT) AS risk_score,
    CASE WHEN risk_score > {config.LEVEL_HIGH} THEN 'HIGH RISK'
      WHEN risk_score > {config.LEVEL_SUSPICIOUS} THEN 'SUSPICIOUS' ELSE 'LOW' END AS risk_level,
    list_sort(list_distinct(list_filter(list_concat(domain_threats,
      CASE WHEN is_spoofed THEN [CASE WHEN mismatched_domains THEN 'From domain mismatch with Return-Path' END,
        CASE WHEN reply_differs THEN 'Reply-To differs from From address' END,
        CASE WHEN spf_failed THEN 'SPF authentication failed' END,
        CASE WHEN dkim_failed THEN 'DKIM authentication failed' END] ELSE [] END,
      CASE WHEN is_obfuscated THEN [
        CASE WHEN invisible_count > 0 THEN 'Detected ' || invisible_count || ' zero-width / invisible characters' END,
        CASE WHEN repetition THEN 'Excessive character repetition detected' END,
        CASE WHEN symbol_ratio > 0.4 THEN printf('Suspicious symbol ratio: %.1f%%', symbol_ratio * 100) END] ELSE [] END,
      [CASE WHEN is_homograph THEN 'Homograph (IDN) attack detected' END,
       CASE WHEN mixed_script THEN 'Mixed Unicode scripts detected' END,
       CASE WHEN len(brands) > 0 THEN 'Brand Impersonation detected: ' || array_to_string(brands, ', ') END,
       CASE WHEN behaviour_score > {W['behavioral_threshold']} THEN 'Suspicious writing behavior (Urgency/Reward Bait)' END,
       CASE WHEN has_cyrillic THEN 'URL contains suspicious Cyrillic characters (potential homograph attack)' END,
       CASE WHEN has_ip_url THEN 'Url contains direct IP address' END,
       CASE WHEN suspicious_tld_count > 0 THEN 'Suspicious TLD(s) detected: ' || suspicious_tld_count END,
       CASE WHEN has_shortener THEN 'URL shortener used' END,
       CASE WHEN url_count > 3 THEN 'Multiple URLs detected (> 3)' END]), lambda r: r IS NOT NULL))) AS threat_reasons
  FROM signals)"""

_ERROR = f"(0.05 + {bucket('error', 'model', size=10)} / 50.0::DOUBLE)"

# Derived predictions of four models on the labelled emails: a stable share of each model's answers is wrong.
SCORES = f"""scores AS (
  SELECT email_id, source, received_at, label, model, {unit('score', 'model', 'email_id')} AS noise,
    CASE WHEN noise < {_ERROR} THEN CASE label WHEN 'spam' THEN 'ham' ELSE 'spam' END ELSE label END AS prediction,
    round(CASE prediction WHEN 'spam' THEN 0.5::DOUBLE + noise / 2 ELSE 0.5::DOUBLE - noise / 2 END, 7) AS p_spam
  FROM emails CROSS JOIN (SELECT unnest({SPAM_MODELS}) AS model) WHERE label IS NOT NULL)"""

FEEDBACK = f"""feedback AS (
  SELECT email_id AS id, received_at AS timestamp, body AS email_text, model AS model_used,
    CASE WHEN {unit('score', 'model', 'email_id')} < {_ERROR} THEN CASE label WHEN 'spam' THEN 'ham' ELSE 'spam' END
      ELSE label END AS predicted_label,
    CASE WHEN {unit('corrected', 'email_id')} >= 0.2 THEN label END AS correct_label
  FROM (SELECT *, CASE WHEN {unit('ab', 'email_id')} < 0.5 THEN 'naive_bayes' ELSE 'svm' END AS model
        FROM emails WHERE label IS NOT NULL))"""


def round4(part: str, whole: str) -> str:
    return f"round_even(coalesce(({part})::DOUBLE / nullif({whole}, 0), 0.0::DOUBLE), 4)"


def metrics(by: str, source: str = "scores") -> str:
    """``by``, the four counts and the four metrics."""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {by + ',' if by else ''} tp, fp, fn, tn,
  {round4('tp + tn', 'tp + tn + fp + fn')} AS accuracy, {round4('tp', 'tp + fp')} AS precision,
  {round4('tp', 'tp + fn')} AS recall, {round4('2 * tp', '2 * tp + fp + fn')} AS f1_score
FROM (SELECT {by + ',' if by else ''} count(*) FILTER (WHERE prediction = 'spam' AND label = 'spam') AS tp,
  count(*) FILTER (WHERE prediction = 'spam' AND label <> 'spam') AS fp,
  count(*) FILTER (WHERE prediction <> 'spam' AND label = 'spam') AS fn,
  count(*) FILTER (WHERE prediction <> 'spam' AND label <> 'spam') AS tn FROM {source} {group})"""


REPORTS = f"""reports AS (
  SELECT CASE WHEN page_id % 50 = 0 THEN 'Earn-Money.xyz' WHEN page_id % 2 = 0 THEN upper({host('x')}) ELSE {host('x')} END AS domain,
    'reported on page ' || page_id AS reason, e.ts AS added_at
  FROM (SELECT page_id, {full_url('url')} AS x FROM pages) p LEFT JOIN events e ON e.event_id = p.page_id)"""
SEEDS = "seeds AS (SELECT * FROM (VALUES " + ", ".join(
    f"('{d}', '{r}', TIMESTAMP '1970-01-01 00:00:00')" for d, r in config.BLOCKLIST_SEEDS) + ") t(domain, reason, added_at))"

EVIDENCE = f"""evidence AS (
  SELECT email_id, CASE WHEN {unit('ml', 'email_id')} < 0.3 THEN 'spam' ELSE 'ham' END AS ml_prediction,
    0.5::DOUBLE + {unit('mlc', 'email_id')} / 2 AS ml_confidence,
    CASE WHEN {unit('dl', 'email_id')} < 0.2 THEN 'spam' WHEN {unit('dl', 'email_id')} < 0.6 THEN 'ham' END AS dl_prediction,
    {unit('dlc', 'email_id')} AS dl_confidence,
    """ + " + ".join(f"CASE WHEN {unit(f'near{i}', 'email_id')} < 0.5 AND {unit(f'kind{i}', 'email_id')} < 0.5 THEN 1 ELSE 0 END"
                     for i in range(3)) + """ AS spam_matches FROM emails)"""
DECIDE = """CASE WHEN risk_score > 80 OR spam_matches >= 2 THEN 'spam'
  WHEN dl_prediction = 'spam' AND dl_confidence > 0.7 THEN 'spam'
  WHEN dl_prediction IS NOT NULL AND dl_prediction <> ml_prediction AND dl_confidence > ml_confidence THEN dl_prediction
  ELSE ml_prediction END"""
