"""Personal data by weak supervision.

Fixed patterns give the base spans. Looser patterns give candidates, on which labelers - shape, gazetteers, context
words, check digits - vote yes, no or not at all. Expectation-maximisation estimates how reliable each labeler is and how
likely each pattern of votes is personal data; a logistic classifier of kind, votes and surroundings is trained on these
likelihoods over all candidates of the corpus and decides which candidates become spans. Candidates are counted by
their discrete features, a table of bounded size, so estimating needs neither a sample nor a large driver.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import materialise, narrow

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")

Span = tuple[int, int, int]  # kind number, start, end

# --- fixed values: patterns of the base spans ---------------------------------------
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# --- labeler knowledge --------------------------------------------------------------
LOOSE = [
    (0, re.compile(r"[A-Za-z0-9._+-]{1,64}\s?[(\[]\s?at\s?[)\]]\s?[A-Za-z0-9-]{1,63}"
                   r"(?:\s?(?:[(\[]\s?dot\s?[)\]]|\.)\s?[A-Za-z0-9-]{2,63}){1,4}", re.I)),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{1,7}(?![0-9])")),
    (3, re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    (4, re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])")),
    # The value runs to its closing quote or to white space, whatever marks it holds.
    (4, re.compile(r"(?<![A-Za-z0-9])(?:password|passwd|pwd|token|secret|api[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}"
                   r"(?:\"[^\s\"]{8,}\"?|'[^\s']{8,}'?|[^\s\"'][^\s]{7,})", re.I)),
]
GATE = re.compile(r"[0-9]|[(\[]\s?at\s?[)\]]|AKIA|ASIA|password|passwd|pwd|token|secret|api[_-]?key", re.I)
SECRET_LEAST = 8  # characters of a secret
CONTEXT = {
    0: re.compile(r"\b(?:e-?mail|mail|contact|correo|kontakt|courriel)\b", re.I),
    2: re.compile(r"\b(?:card|visa|credit|carte|karte|tarjeta|payment)\b", re.I),
    3: re.compile(r"\b(?:tel|phone|call|mobile|fax|telefon|t[ée]l[ée]phone|tel[ée]fono)\b", re.I),
    4: re.compile(r"\b(?:password|passwd|token|secret|key|aws|auth|login)\b", re.I),
}
AGAINST = re.compile(r"\b(?:version|licen[cs]e|isbn|issn|page|chapter|order|invoice|part|fig|sku|serial)\b[^0-9]{0,12}$", re.I)
PROVIDERS = re.compile(r"(?:com|org|net|edu|gov|io|de|fr|es|uk)$", re.I)
ISSUERS = re.compile(r"(?:4|5[1-5]|2[2-7]|3[47]|6011|65)")
AREA = re.compile(r"\(?[2-9]")
KEYS = re.compile(r"AKIA|ASIA|[0-9a-f]{16,}", re.I)
LABELERS = ("shape", "gazetteer", "context", "check", "against")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield 0, start, end
        at = text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[Span]:
    """Four runs of digits with single dots between them, from left to right."""
    runs: list[re.Match] = []
    for run in DIGITS.finditer(text):
        joined = runs and run.start() == runs[-1].end() + 1 and text[run.start() - 1] == "."
        runs = [*runs, run] if joined else [run]
        if len(runs) == 4:
            parts = [r.group().lstrip("0") for r in runs]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield 1, runs[0].start(), run.end()
            runs = []


def base_spans(text: str) -> list[Span]:
    """The fixed kinds, by kind and start."""
    spans = list(emails(text)) if "@" in text else []
    if DIGITS.search(text) is None:
        return spans
    spans += addresses(text)
    for m in CARD.finditer(text):
        digits = "".join(DIGITS.findall(m.group()))
        if 16 <= len(digits) <= 19 and luhn(digits):
            spans.append((2, m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(map(len, DIGITS.findall(m.group()))) <= 15:
            spans.append((3, m.start(), m.end()))
    return spans


def votes_on(kind: int, text: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 1 yes, 0 no, -1 none."""
    body, left, right = text[start:end], text[max(0, start - 40):start], text[end:end + 24]
    digits = "".join(DIGITS.findall(body))
    bounded = not left[-1:].isalnum() and not right[:1].isalnum()
    if kind == 0:
        known, check = bool(PROVIDERS.search(body)), -1
    elif kind == 2:
        known, check = bool(ISSUERS.match(digits)), int(luhn(digits))
    elif kind == 3:
        known, check = bool(AREA.match(body)), int(len(digits) == 10)
    else:
        value = re.split(r"[=:]", body, maxsplit=1)[-1].strip(" \"'")
        known, check = bool(KEYS.search(body)), int(len(set(value)) >= 6 and any(c.isdigit() for c in value))
    said = bool(CONTEXT[kind].search(left + " " + (body if kind == 4 else "") + " " + right))
    return int(bounded), int(known), 1 if said else -1, check, 0 if AGAINST.search(left) else -1


def outside(body: str, start: int, inner: list[tuple[int, int]]) -> int:
    """Characters of a secret's value that none of the spans covers; 0 if a span crosses the secret's bounds."""
    first = start + (m.end() if (m := re.search(r"[=:]\s*[\"']?", body)) else 0)
    end, left = first, start + len(body)
    if any(s < first or e > left for s, e in inner):
        return 0
    free = left - first
    for s, e in sorted(inner):
        free -= max(0, e - max(s, end))
        end = max(end, e)
    return free


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, int, str]]:
    """Loose matches that touch no base span and no earlier candidate, with their features as text.

    A secret may hold such spans, as long keys hold runs of digits, if enough of its value lies outside them.
    """
    if not GATE.search(text):
        return []
    taken, found = sorted((s, e) for _, s, e in base), []
    for kind, pattern in LOOSE:
        for m in pattern.finditer(text):
            start, end = m.span()
            inner = [(s, e) for s, e in taken if s < end and start < e]
            if inner and not (kind == 4 and outside(m.group(), start, inner) >= SECRET_LEAST):
                continue
            taken.append((start, end))
            digits = sum(map(len, DIGITS.findall(m.group())))
            around = "".join("d" if c.isdigit() else "a" if c.isalpha() else "s" if c.isspace() else "p"
                             for c in (text[start - 1:start] or " ", text[end:end + 1] or " "))
            votes = ",".join(map(str, votes_on(kind, text, start, end)))
            found.append((kind, start, end, f"{kind}|{votes}|{min(9, 10 * digits // (end - start))}|{around}"))
    return found


@dataclass
class LabelModel:
    """Share of personal data per kind, and each labeler's chance to vote yes on either class."""

    prior: np.ndarray  # kind
    yes: np.ndarray  # kind x labeler x class

    def likely(self, kinds: np.ndarray, votes: np.ndarray) -> np.ndarray:
        log = np.log(np.stack([1 - self.prior[kinds], self.prior[kinds]], axis=1))
        chance = self.yes[kinds]
        said = np.where((votes == 1)[:, :, None], np.log(chance), np.log(1 - chance))
        log += np.where((votes >= 0)[:, :, None], said, 0.0).sum(axis=1)
        return 1 / (1 + np.exp(log[:, 0] - log[:, 1]))

    @classmethod
    def fit(cls, kinds: np.ndarray, votes: np.ndarray, counts: np.ndarray, rounds: int = 25) -> LabelModel:
        """Expectation-maximisation from a majority vote, with pseudo-counts that hold labelers better than chance."""
        m = votes.shape[1]
        model = cls(np.full(len(KINDS), 0.5), np.tile([0.3, 0.7], (len(KINDS), m, 1)))
        for _ in range(rounds):
            p = model.likely(kinds, votes) if len(kinds) else np.zeros(0)
            prior, yes = np.full(len(KINDS), 0.5), np.tile([0.3, 0.7], (len(KINDS), m, 1))
            for k in range(len(KINDS)):
                of = kinds == k
                weight = counts[of, None] * np.stack([1 - p[of], p[of]], axis=1)
                prior[k] = (weight[:, 1].sum() + 5) / (weight.sum() + 10)
                for j in range(m):
                    said, agree = votes[of, j] >= 0, votes[of, j] == 1
                    yes[k, j] = (weight[agree].sum(axis=0) + [6, 14]) / (weight[said].sum(axis=0) + 20)
            model = cls(np.clip(prior, 0.02, 0.98), np.clip(yes, 0.02, 0.98))
        return model


def features(code: str) -> tuple[int, list[int], np.ndarray]:
    """Kind, votes and the classifier's indicator vector of a candidate's features."""
    kind, votes, share, around = code.split("|")
    k, v = int(kind), [int(x) for x in votes.split(",")]
    x = np.zeros(1 + len(KINDS) + 2 * len(v) + 10 + 8)
    x[0] = x[1 + k] = 1
    for j, vote in enumerate(v):
        if vote >= 0:
            x[1 + len(KINDS) + 2 * j + vote] = 1
    x[1 + len(KINDS) + 2 * len(v) + int(share)] = 1
    for j, c in enumerate(around):
        x[-8 + 4 * j + "dasp".index(c)] = 1
    return k, v, x


def train_classifier(table: dict[str, int], steps: int = 30) -> dict[str, float]:
    """Probability of personal data for every feature code met: label model, then ridge logistic regression on it."""
    if not table:
        return {}
    codes = sorted(table)
    parts = [features(code) for code in codes]
    kinds, votes = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    counts, x = np.array([table[c] for c in codes], float), np.array([p[2] for p in parts])
    target = LabelModel.fit(kinds, votes, counts).likely(kinds, votes)
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (counts * (target - p)) - w
        curve = (x * (counts * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return dict(zip(codes, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist()))


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


SCAN = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, "
        "found array<struct<kind int, start int, end int, code string>>")


def scan(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of each document, texts read once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                base = base_spans(text)
                kinds = [k for k, _, _ in base]
                line = written(base)
                rows.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(line.encode()).hexdigest(), line,
                             [dict(zip(("kind", "start", "end", "code"), c)) for c in candidates(text, base)]))
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.string())]))
            columns = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [kind]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "found"])
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCAN)


def learn(scanned: DataFrame) -> dict[str, float]:
    """Classifier from all candidates, counted by feature code (a few thousand codes at most)."""
    codes = scanned.select(F.explode("found.code").alias("code")).groupBy("code").count()
    return train_classifier({row["code"]: row["count"] for row in codes.collect()})


def find_pii(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per document: counts and digest of the base spans, and all spans.

    Null and empty texts have no spans. Rows are scanned each by itself, so repeated rows agree and null ids are kept.
    Where candidates overlap, the earlier pattern wins, but a secret may hold other spans. An empty table gives no rows.
    """
    scanned = materialise(scan(docs), "pii")
    chance = learn(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, found in zip(batch.column("base").to_pylist(), batch.column("found").to_pylist()):
                more = [(c["kind"], c["start"], c["end"]) for c in found if chance.get(c["code"], 0) >= threshold]
                if more:
                    own = [(KINDS.index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in base.split(",") if x)]
                    base = written(own + more)
                spans.append(base)
            names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"]
            n_spans = pa.array([s.count(",") + 1 if s else 0 for s in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(spans, pa.string()), n_spans],
                                             [*names, "spans", "n_spans"])
    return scanned.mapInArrow(run, SCAN.split(", base string")[0] + ", spans string, n_spans long")


def redact(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with each span replaced by its kind in brackets; other columns are as they were."""
    chance = learn(materialise(scan(docs).filter(F.size("found") > 0).select("found"), "pii"))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text in batch.column(at):
                text = text.as_py()
                if text is not None:
                    spans = base_spans(text)
                    spans += [c[:3] for c in candidates(text, spans) if chance.get(c[3], 0) >= threshold]
                    end, parts = 0, []
                    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
                        if a >= end:
                            parts += [text[end:a], f"[{KINDS[kind].upper()}]"]
                        end = max(end, b)
                    text = "".join(parts) + text[end:] if spans else text
                texts.append(text)
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, batch.schema.field(at).type))
    return docs.mapInArrow(run, docs.schema)
