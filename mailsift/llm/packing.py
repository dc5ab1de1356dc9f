"""Best-fit packing of token pieces under three capacities: tokens, documents and attention cost.

Pieces of one length are interchangeable, so the plan is made from the counts per length - a table of at most
``capacity`` rows, whatever the size of the corpus - over groups of equal bins. Each step gives one piece of the current
length to every bin of the group that fits best, by weighted dot product or residual norm. The plan is a bounded
list of ranges "pieces number r to r+q of this length go to bins b to b+q at this offset"; pieces find their range by
their number among those of their length, which is counted over salted groups, never in one task.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import materialise, narrow

CAPACITY = 2048
SPECIAL = "<|endoftext|>"
OTHER = re.compile(r"[^\x00-\u024f]")  # beyond: characters on which the libraries' tables could differ
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Tokens:
    """Ids of texts as little-endian 32-bit values."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer
        self.slow = Tokenizer.from_file(path)
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=self._ranks(), special_tokens={})

    def _ranks(self) -> dict[bytes, int]:
        """The vocabulary of the tokenizer file, written in bytes instead of its printable stand-ins."""
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in plain}
        stand_in |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        vocabulary = self.slow.get_vocab(with_added_tokens=False)
        return {bytes(map(stand_in.__getitem__, word)): i for word, i in vocabulary.items() if word != SPECIAL}

    def exact(self, text: str) -> bytes:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The same ids from the quicker library wherever both surely cut a text alike."""
        if SPECIAL in text or OTHER.search(text):
            return self.exact(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


@lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids, closed by id 0, as pieces of at most ``capacity``; of a longer one the first may be shorter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokens(path)
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for name, text in zip(names, texts):
                ids = own.encode(text) + b"\0\0\0\0"
                n = len(ids) // 4
                starts = [0] if n <= capacity else [*([0] if n % capacity else []),
                                                    *range(n % capacity, n, capacity)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], n])):
                    rows.append((name, k, a, b - a, zlib.crc32(ids[4 * a:4 * b])))
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), *[pa.int64()] * 3))],
                    ["doc_id", "piece", "start", "length", "ids_crc32"])
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


@dataclass(frozen=True)
class Capacities:
    """Limits of one sequence. The defaults of the last two follow from the first and never bind."""

    tokens: int = CAPACITY
    documents: int = CAPACITY
    attention: int = CAPACITY * CAPACITY
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"

    def demand(self, length: int) -> np.ndarray:
        return np.array([length, 1, length * length], np.int64)

    @property
    def limit(self) -> np.ndarray:
        return np.array([self.tokens, self.documents, self.attention], np.int64)


@dataclass
class Plan:
    """Ranges of pieces and where they go, sorted by (length, first number)."""

    length: list[int] = field(default_factory=list)
    number: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    bins: int = 0

    def add(self, length: int, number: int, first_bin: int, offset: int) -> None:
        self.length.append(length)
        self.number.append(number)
        self.bin.append(first_bin)
        self.offset.append(offset)


def make_plan(counts: dict[int, int], caps: Capacities = Capacities()) -> Plan:
    """Vector best fit over groups of equal bins, longest pieces first."""
    plan, limit = Plan(), caps.limit
    weight = np.array(caps.weights) / limit.astype(float) ** 2
    residual, first, many = np.zeros((0, 3), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for length in sorted(counts, reverse=True):
        need, left, number = caps.demand(length), counts[length], 0
        if (need > limit).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacities")
        while left:
            fits = (residual >= need).all(axis=1)
            if fits.any():
                rest = residual - need
                score = (rest * rest * weight).sum(axis=1) if caps.rule == "norm" else -(residual * need * weight).sum(axis=1)
                at = int(np.where(fits, score, np.inf).argmin())
                took = int(min(left, many[at]))
                plan.add(length, number, int(first[at]), caps.tokens - int(residual[at, 0]))
                taken = residual[at] - need, first[at]
                if took == many[at]:
                    residual[at] = taken[0]
                else:
                    first[at] += took
                    many[at] -= took
                    residual = np.vstack([residual, taken[0]])
                    first, many = np.append(first, taken[1]), np.append(many, took)
                left, number = left - took, number + took
                continue
            each = int((limit // need).min())
            for size, rows in ((each, left // each), (left % each, 1)):
                if not size or not rows:
                    continue
                for k in range(size):
                    plan.add(length, number, plan.bins, k * length)
                    number += rows
                residual = np.vstack([residual, limit - size * need])
                first, many = np.append(first, plan.bins), np.append(many, rows)
                plan.bins += rows
            left = 0
        keep = (residual[:, 0] > 0) & (residual[:, 1] > 0) & (residual[:, 2] > 0)
        residual, first, many = residual[keep], first[keep], many[keep]
    return plan


def number_pieces(pieces: DataFrame, salt_rows: int = 100_000) -> DataFrame:
    """Add ``number``: 0, 1, ... among the pieces of one length. Lengths are dealt over salts, so none fills a task."""
    salts = 1 + pieces.count() // salt_rows
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "salt").count()
    before = counts.select("length", "salt", (F.sum("count").over(
        Window.partitionBy("length").orderBy("salt")) - F.col("count")).alias("before"))
    within = salted.withColumn("place", F.row_number().over(
        Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    return within.join(before, ["length", "salt"]).withColumn("number", F.col("before") + F.col("place"))


def pack(docs: DataFrame, path: str, caps: Capacities = Capacities()) -> DataFrame:
    """One row per piece with its sequence and its offset there.

    Null and empty texts are one piece that holds the closing id alone. Rows are packed each by itself, also where they
    repeat or lack an id. An empty table gives no rows.
    """
    pieces = materialise(cut_pieces(docs, path, caps.tokens), "pieces")
    counts = {row["length"]: row["count"] for row in pieces.groupBy("length").count().collect()}  # one row per length
    plan = make_plan(counts, caps)
    key = np.array(plan.length, np.int64) << 44 | np.array(plan.number, np.int64)
    order = np.argsort(key)
    key = key[order]
    number, bins, offsets = (np.array(v, np.int64)[order] for v in (plan.number, plan.bin, plan.offset))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = np.asarray(batch.column("number"))
            at = np.searchsorted(key, np.asarray(batch.column("length")) << 44 | of, side="right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(bins[at] + of - number[at]), pa.array(offsets[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return number_pieces(pieces).mapInArrow(place, PACKED)
