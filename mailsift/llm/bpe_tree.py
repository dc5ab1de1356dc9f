"""Byte-level BPE, encoding and decoding, with a segment tree over the byte positions of each piece.

A leaf holds the rank of the pair that starts at its position, combined with the position, so the root of the tree
holds the leftmost minimum. A merge changes three leaves - the merged pair, its live left neighbour and the position
that died - each by an update along one path. Short pieces of similar length share numpy arrays and merge in step, one
merge per piece and step; long pieces run alone on plain lists. Pieces come from the split pattern and repeat often, so
each task keeps a bounded table of those it has met.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import batched, chunks, narrow

LONG = 128  # bytes from which a piece runs alone
TABLE_LIMIT = 400_000  # entries at which a task's table starts anew
TEXT_BLOCK = 1_000_000  # characters handled at once
OUT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class Bpe:
    """Ranks of a vocabulary: ``ids(piece)`` for many pieces, and ``decode(ids)``."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.words = {rank: token for token, rank in ranks.items()}
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self._fill(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _fill(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Open addressing: a pair that finds its slot taken goes to the next."""
        self.bits = max(8, (4 * len(keys)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]], self.values[slot[free]] = keys[free], values[free]
            lost = self.keys[slot] != keys
            self.values[slot[~lost]] = values[~lost]
            keys, values, slot = keys[lost], values[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    @classmethod
    def load(cls, path: str) -> Bpe:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def rank_of(self, left: np.ndarray, right: np.ndarray, none: int) -> np.ndarray:
        key = (left << 32 | right).ravel()
        out = np.full(len(key), none, np.int64)
        todo = np.flatnonzero(right.ravel() >= 0)
        key = key[todo]
        slot = self._slot(key)
        while len(todo):
            found = self.keys[slot]
            hit = found == key
            out[todo[hit]] = self.values[slot[hit]]
            go = ~hit & (found >= 0)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out.reshape(np.shape(right))

    def ids(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of each piece: the piece itself where it is a token, else by merging."""
        out: list[list[int]] = [[]] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[i] = [whole]
            elif len(piece) > LONG:
                out[i] = self.merge_alone(piece)
            elif piece:
                by_width.setdefault(1 << (len(piece) - 1).bit_length(), []).append(i)
        for width, members in by_width.items():
            for part in range(0, len(members), 20_000):
                rows = members[part:part + 20_000]
                for i, ids in zip(rows, self.merge_together([pieces[i] for i in rows], width)):
                    out[i] = ids
        return out

    def merge_together(self, pieces: list[bytes], width: int) -> Iterator[list[int]]:
        """Merge pieces of at most ``width`` bytes (a power of two), one merge per piece and step."""
        n, shift = len(pieces), max(1, width.bit_length() - 1)
        none = 1 << 40
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        position = np.arange(width)
        alive = position[None, :] < sizes[:, None]
        ids = np.where(alive, self.first[raw], -1)
        after = np.where(position[None, :] + 1 < sizes[:, None], position[None, :] + 1, width)
        before = np.broadcast_to(position - 1, (n, width)).copy()
        ids = np.concatenate([ids, np.full((n, 1), -1)], axis=1)  # column ``width``: no neighbour
        before = np.concatenate([before, np.zeros((n, 1), np.int64)], axis=1)
        tree = np.full((n, 2 * width), none << shift, np.int64)
        row = np.arange(n)[:, None]
        pair = self.rank_of(ids[:, :width], ids[row, after], none)
        tree[:, width:] = np.where(alive, pair, none) << shift | position
        level = width >> 1
        while level:
            kids = tree[:, 2 * level:4 * level]
            tree[:, level:2 * level] = np.minimum(kids[:, ::2], kids[:, 1::2])
            level >>= 1
        live = np.flatnonzero(tree[:, 1] >> shift < none)
        while len(live):
            root = tree[live, 1]
            at, merged = root & (width - 1), root >> shift
            gone = after[live, at]
            right = after[live, gone]
            left = before[live, at]
            ids[live, at] = merged
            alive[live, gone] = False
            after[live, at] = right
            before[live, right] = at
            tree[live, width + gone] = none << shift | gone
            tree[live, width + at] = self.rank_of(merged, ids[live, right], none) << shift | at
            has_left = left >= 0
            lived, where = live[has_left], left[has_left]
            tree[lived, width + where] = self.rank_of(ids[lived, where], merged[has_left], none) << shift | where
            for rows, leaf in ((live, gone), (live, at), (lived, where)):
                node = width + leaf >> 1
                for _ in range(shift if width > 1 else 0):
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node >>= 1
            live = live[tree[live, 1] >> shift < none]
        flat = ids[:, :width][alive].tolist()
        end = np.cumsum(alive.sum(axis=1)).tolist()
        return (flat[a:b] for a, b in zip([0, *end], end))

    def merge_alone(self, piece: bytes) -> list[int]:
        """The same for one long piece: logarithmic updates on lists."""
        n, pairs, none = len(piece), self.pairs, (1 << 60, 0)
        width = 1 << (n - 1).bit_length()
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        tree = [none] * (2 * width)

        def leaf(i: int) -> tuple[int, int]:
            rank = pairs.get(ids[i] << 32 | ids[after[i]]) if after[i] >= 0 else None
            return none if rank is None else (rank, i)

        def put(i: int, value: tuple[int, int]) -> None:
            node = width + i
            tree[node] = value
            while node > 1:
                node >>= 1
                left, right = tree[2 * node], tree[2 * node + 1]
                best = left if left <= right else right
                if tree[node] == best:
                    break
                tree[node] = best

        for i in range(n):
            tree[width + i] = leaf(i)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        alive = [True] * n
        while tree[1] != none:
            rank, i = tree[1]
            j = after[i]
            ids[i], alive[j], after[i] = rank, False, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return [token for token, lives in zip(ids, alive) if lives]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join([self.words[i] for i in ids])


class Encoder:
    """Texts to ids and back for one task, with a table of the chunks met so far."""

    def __init__(self, bpe: Bpe, pattern: str):
        self.bpe, self.pattern = bpe, regex.compile(pattern)
        self.written: dict[str, str] = {}  # chunk after a space -> decimal ids
        self.read: dict[str, bytes] = {}  # chunk after a space -> decoded ids

    def learn(self, new: list[str], others: list[list[str]]) -> tuple[dict[str, str], dict[str, bytes]]:
        """Tables for the pieces of the new chunks, which go to the task's tables, and of the other lists."""
        flat = self.pattern.findall(" " + " ".join(new)) if new else []
        starts = [i for i, piece in enumerate(flat) if piece[0] == " "]  # a chunk holds no other space
        pieces = list(set(flat).union(*others))
        ids = self.bpe.ids([p.encode() for p in pieces])
        written = dict(zip(pieces, (",".join(map(str, i)) for i in ids)))
        read = dict(zip(pieces, map(self.bpe.decode, ids)))
        for chunk, a, b in zip(new, starts, [*starts[1:], len(flat)]):
            if b == a + 1:
                self.written[chunk], self.read[chunk] = written[flat[a]], read[flat[a]]
            else:
                self.written[chunk] = ",".join([written[p] for p in flat[a:b]])
                self.read[chunk] = b"".join([read[p] for p in flat[a:b]])
        return written, read

    def block(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Decimal ids and decoded bytes of each text."""
        if len(self.written) > TABLE_LIMIT:
            self.written.clear()
            self.read.clear()
        cut = [chunks(text) for text in texts]
        heads = [self.pattern.findall(c[0] if c else text) for c, text in zip(cut, texts)]
        rest = set().union(*[c[1] for c in cut if c])
        written, read = self.learn([chunk for chunk in rest if chunk not in self.written], heads)
        ids_of, bytes_of = self.written.__getitem__, self.read.__getitem__
        out = []
        for c, head in zip(cut, heads):
            ids, data = [written[p] for p in head], [read[p] for p in head]
            if c:
                ids += map(ids_of, c[1])
                data += map(bytes_of, c[1])
            out.append((",".join(ids), b"".join(data)))
        return out

    def encode(self, text: str) -> list[int]:
        written = self.block([text])[0][0]
        return [int(i) for i in written.split(",")] if written else []


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(Bpe.load(path), pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the decimal ids and of the bytes they decode to, one row per document.

    Null and empty texts have no tokens. Strings that look like special tokens are ordinary text. A row is handled by
    itself, so repeated rows and null ids are kept as they are; an empty table gives no rows. No row is shuffled.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, pattern)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            tokens, ids_sha, data_sha = [], [], []
            for part in batched(texts, [len(t) for t in texts], TEXT_BLOCK):
                for written, data in own.block(part):
                    tokens.append(written.count(",") + 1 if written else 0)
                    ids_sha.append(hashlib.sha256(written.encode()).hexdigest())
                    data_sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(tokens, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(data_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    rows = narrow(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, OUT)
