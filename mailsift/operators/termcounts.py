"""Terms of documents counted on Arrow batches: sorted codes instead of one row per occurrence.

Words are coded once per batch. A pair of words is a code of two words; n-grams of characters are cut once from every distinct
word of a batch, and their counts follow from the counts of the words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ENTRIES = 1 << 18  # words and pairs that are sorted at once; a document beyond that is sorted alone
GRAMS = 16  # times as many n-grams of characters, which repeat more


@dataclass
class Counts:
    """Rows ``first`` to ``first + n`` of a batch: their distinct terms in order of the row, with counts, and the terms."""

    first: int
    n: int
    row: np.ndarray  # from 0
    term: np.ndarray  # place in ``terms``
    tf: np.ndarray
    terms: pa.Array


def _summed(row: np.ndarray, code: np.ndarray, n_rows: int, size: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, code and sum of ``times`` (or the number) of equal (row, code), in their order; codes are below ``size``."""
    if not len(row):
        return row, code, np.zeros(0, np.int64)
    most = 0 if times is None else int(times.max())
    if n_rows * size < 1 << (62 - most.bit_length()):
        both = row * size + code
        if times is not None:
            both = (both << most.bit_length()) | times
        both.sort()
        if times is not None:
            times, both = both & ((1 << most.bit_length()) - 1), both >> most.bit_length()
        first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
        row, code = np.divmod(both[first], size)
    else:
        order = np.lexsort((code, row))
        row, code, times = row[order], code[order], None if times is None else times[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (row[1:] != row[:-1])]))
        n, row, code = len(row), row[first], code[first]
        both = np.empty(n, np.int8)
    tf = np.diff(np.append(first, len(both))) if times is None else np.add.reduceat(times, first)
    return row, code, tf


def _ranges(start: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from every start on, one range after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(start - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


def chunks(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbouring rows whose sizes add up to ``most``, one row at least."""
    ends, first = np.cumsum(sizes), 0
    while first < len(sizes):
        before = ends[first] - sizes[first]
        last = max(int(np.searchsorted(ends, before + most, "right")), first + 1)
        yield first, last
        first = last


def _cut(words: pa.Array, sizes: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Substrings of words padded with blanks: where those of a word start in a list of codes, the list, and the substrings."""
    known: dict[str, int] = {}
    start, codes = [0], []
    for word in words.to_pylist():
        padded = f" {word} "
        for n in range(sizes[0], sizes[1] + 1):
            codes += [known.setdefault(padded[i:i + n], len(known)) for i in range(len(padded) - n + 1)]
        start.append(len(codes))
    return np.array(start, np.int64), np.array(codes, np.int64), list(known)


def counts(tokens: pa.Array, analyzer: str, sizes: tuple[int, int]) -> Iterator[Counts]:
    """Counts of the terms of all rows of a list column, null for no tokens."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    lengths = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = tokens.flatten().dictionary_encode()
    words = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.concatenate([[0], np.cumsum(lengths)])
    if analyzer == "char_wb":
        grams_at, gram_codes, grams = _cut(words, sizes)
        grams = pa.array(grams, pa.string())
        n_grams = np.diff(grams_at)
        weight = np.bincount(np.repeat(np.arange(len(lengths)), lengths), n_grams[code], len(lengths)).astype(np.int64)
    else:
        weight = 2 * lengths
    for first, last in chunks(weight, ENTRIES * GRAMS if analyzer == "char_wb" else ENTRIES):
        own = code[start[first]:start[last]]
        row = np.repeat(np.arange(last - first), lengths[first:last])
        if analyzer == "char_wb":
            r, w, times = _summed(row, own, last - first, len(words))
            n = n_grams[w]
            entries = gram_codes[_ranges(grams_at[w], n)]
            r, term, tf = _summed(np.repeat(r, n), entries, last - first, len(grams), np.repeat(times, n))
            yield Counts(first, last - first, r, term, tf, grams)
            continue
        size = len(words) + 1
        pairs = np.flatnonzero(row[1:] == row[:-1])
        both = np.concatenate([own * size, own[pairs] * size + own[pairs + 1] + 1])
        r, both, tf = _summed(np.concatenate([row, row[pairs]]), both, last - first, size ** 2)
        distinct = pa.array(both).dictionary_encode()
        a, b = np.divmod(distinct.dictionary.to_numpy(), size)
        one = words.take(pa.array(a))
        two = pc.binary_join_element_wise(one, words.take(pa.array(np.maximum(b - 1, 0))), " ") if len(a) else one
        yield Counts(first, last - first, r, distinct.indices.to_numpy(zero_copy_only=False).astype(np.int64), tf,
                     pc.if_else(pa.array(b > 0), two, one))
