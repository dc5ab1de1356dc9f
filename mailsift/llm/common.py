"""Helpers shared by the operators: clash-free columns, byte windows, chunked tokenizer input."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.session import materialise, scratch_path

__all__ = ["Rolling", "batched", "chunks", "documents", "id_bucket", "materialise", "mix", "narrow", "scratch_path"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the columns an operator reads, so that extra columns never clash with its own."""
    return docs.select(*[docs[c] for c in columns])


def id_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Rolling:
    """Polynomial hashes of any byte range of one buffer, from prefix sums modulo 2^64."""

    BASE = 0x9E3779B97F4A7C15 | 1

    _powers: dict[int, np.ndarray] = {}

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.inverse = self.powers(pow(self.BASE, -1, 1 << 64), n)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers(self.BASE, n)[:n], out=self.prefix[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> np.ndarray:
        """1, base, base^2, ..., kept for the next buffer."""
        kept = cls._powers.get(base)
        if kept is None or len(kept) <= n:
            kept = np.full(n + 1, base, np.uint64)
            kept[0] = 1
            cls._powers[base] = np.cumprod(kept, out=kept)
        return kept[:n + 1]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])

    def windows(self, length: int) -> np.ndarray:
        """Hash of every window of ``length`` bytes, by its start."""
        n = len(self.prefix) - 1 - length + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[length:] - self.prefix[:n]) * self.inverse[:n])


_UNSAFE = regex.compile(r" \s|\s ")


def chunks(text: str) -> tuple[str, list[str]] | None:
    """The text cut before each single space, or None where that could cut inside a match of the split pattern.

    The pattern that precedes the merges lets a match hold a space only as its first character or inside a run of
    white space. A space between two other characters therefore always starts a match, and each chunk can be split alone.
    """
    if _UNSAFE.search(text) or text[:1] == " " or text[-1:] == " ":
        return None
    first, *rest = text.split(" ")
    return first, rest


def batched(items: list, sizes: list[int], most: int) -> Iterator[list]:
    """Consecutive groups whose sizes add up to ``most`` at the most, or that hold one larger item."""
    group, total = [], 0
    for item, size in zip(items, sizes):
        if group and total + size > most:
            yield group
            group, total = [], 0
        group.append(item)
        total += size
    if group:
        yield group
