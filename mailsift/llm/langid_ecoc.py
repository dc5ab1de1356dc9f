"""Language ID by error-correcting output codes over byte n-grams.

Every language gets a codeword; each of its bits is predicted by a binary classifier that weighs hashed n-grams by the
log odds of the languages on either side of the bit. The counts behind all classifiers are one table (language x
bucket), summed over all training documents where they lie. A text is given the codeword with the least weighted loss
over its bits, and is flagged as ambiguous where the runner-up is close.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import batched, narrow

BITS = 14
BUCKETS = 1 << BITS
LENGTHS = (1, 2, 3, 4)
BLOCK = 1 << 20  # bytes handled at once
AMBIGUOUS = 0.75  # scores below are flagged
OUT = "lang_pred string, score double, ambiguous boolean"


def code_matrix(k: int) -> np.ndarray:
    """Codewords of +1 and -1: all distinct splits of up to 6 languages, else seeded dense codes."""
    if k <= 1:
        return np.ones((k, 0))
    if k <= 6:
        return np.array([[1.0 if (split | 1) >> i & 1 else -1.0 for split in range(1, 2 ** k - 1, 2)] for i in range(k)])
    bits = int(np.ceil(15 * np.log2(k)))
    rng = np.random.default_rng(k)
    while True:
        code = rng.choice([-1.0, 1.0], (k, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(k) * bits
        if apart.min() >= bits / 5 and (abs(code.sum(axis=0)) < k).all():
            return code


def gram_buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the n-gram of each length at each byte, one row per length; the end is padded."""
    wide = np.concatenate([data, np.zeros(max(LENGTHS), np.uint8)]).astype(np.uint32)
    n, out = len(data), np.empty((len(LENGTHS), len(data)), np.uint16)
    for row, length in enumerate(LENGTHS):
        code = np.full(n, length, np.uint32)
        for k in range(length):
            code = code * np.uint32(0x01000193) ^ wide[k:n + k]
        out[row] = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    return out


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts framed by spaces in one buffer, and where each starts."""
    data = np.frombuffer(b"".join(b" " + t + b" " for t in texts), np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(t) + 2 for t in texts])[:-1]]).astype(np.int64)


def count_grams(rows: DataFrame) -> DataFrame:
    """n-gram counts by language and bucket; each task sends one row per language and bucket at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            frame = pd.DataFrame({"lang": batch.column("lang").to_pylist(), "text": batch.column("text").to_pylist()})
            for lang, texts in frame.groupby("lang")["text"]:
                own = total.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for part in batched(list(texts), [len(t) for t in texts], BLOCK):
                    for grams in gram_buckets(joined(part)[0]):
                        own += np.bincount(grams, minlength=BUCKETS)
        for lang, counts in total.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(seen), pa.string()), pa.array(seen, pa.int32()), pa.array(counts[seen])],
                ["lang", "bucket", "n"])
    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bit x bucket
    trust: np.ndarray  # weight of each bit in the loss

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray]) -> Model:
        languages = sorted(counts)
        code = code_matrix(len(languages))
        table = np.array([counts[lang] for lang in languages], float).reshape(len(languages), BUCKETS) + 0.5
        share = table / table.sum(axis=1, keepdims=True)  # every language counts alike, however much of it there is
        weights = np.zeros((code.shape[1], BUCKETS))
        trust = np.ones(code.shape[1])
        for bit in range(code.shape[1]):
            plus, minus = (share[code[:, bit] == side].mean(axis=0) for side in (1, -1))
            weights[bit] = np.log(plus) - np.log(minus)
            margin = code[:, bit] * (share @ weights[bit])  # mean margin of each language on its own n-grams
            trust[bit] = max(margin.min(), 1e-3)
        return cls(languages, code, weights, trust / trust.sum() if len(trust) else trust)

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each text."""
        if len(self.languages) == 1:
            return np.zeros(len(texts), int), np.ones(len(texts))
        data, starts = joined(texts)
        grams = gram_buckets(data)
        sizes = np.diff(np.append(starts, len(data)))
        margin = np.stack([np.add.reduceat(sum(w[g] for g in grams), starts) for w in self.weights], axis=1)
        margin = margin / np.sqrt(sizes)[:, None]  # evidence grows with the text, but neighbours overlap
        loss = np.stack([(np.logaddexp(0, -margin * word) * self.trust).sum(axis=1) for word in self.code], axis=1)
        likely = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        return loss.argmin(axis=1), likely.max(axis=1) / likely.sum(axis=1)


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")


def train(rows: DataFrame) -> Model:
    """Fit on rows of text and non-null lang."""
    rows = rows.filter("lang IS NOT NULL").select("lang", F.lower(F.coalesce("text", F.lit(""))).cast("binary").alias("text"))
    counts: dict[str, np.ndarray] = {}
    for row in count_grams(rows).collect():  # languages x buckets
        counts.setdefault(row["lang"], np.zeros(BUCKETS))[row["bucket"]] = row["n"]
    return Model.fit(counts)


def identify(docs: DataFrame, training: Column, *keep: Column) -> DataFrame:
    """Columns ``keep`` of every document with lang_pred, score and ambiguous.

    ``training`` says which rows may teach. Texts that are null or have no letter, and all texts where no language was
    taught, are "und" with score 0 and not ambiguous. Rows are judged by their text alone, so repeated rows agree.
    An empty table gives no rows.
    """
    model = train(docs.filter(training).select(docs["lang"], docs["text"]))
    names = [f"keep_{i}" for i in range(len(keep))]
    rows = docs.select(*[c.alias(name) for c, name in zip(keep, names)], F.when(
        has_letter(docs["text"]) & F.lit(bool(model.languages)), F.lower(docs["text"])).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if t is not None]
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            for part in batched(known, [len(texts[i]) for i in known], BLOCK):
                best, sure = model.predict([texts[i] for i in part])
                score[part] = sure
                for i, b in zip(part, best):
                    lang[i] = model.languages[b]
            unsure = [a != "und" and s < AMBIGUOUS for a, s in zip(lang, score)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(name) for name in names], pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                 pa.array(unsure, pa.bool_())], [*names, "lang_pred", "score", "ambiguous"])
    kinds = dict(rows.dtypes)
    out = rows.mapInArrow(run, ", ".join(f"{name} {kinds[name]}" for name in names) + ", " + OUT)
    return out.withColumnsRenamed({name: docs.select(c).columns[0] for c, name in zip(keep, names)})
