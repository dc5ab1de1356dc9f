"""Trees on binned features: histogram boosting grown leaf by leaf, and forests, as jobs in passes over row blocks.

A split sends ``x <= threshold`` to the left. Features are sparse and not negative, so zero always goes left, and what a block
answers about a leaf are the sums of gradients over the bins that occur in it; sums over blocks give the sums over all rows.
"""

from __future__ import annotations

import copy
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from mailsift.operators.passes import Block, Blocks, Job

LEAST_HESSIAN = 1e-3
LEAST_GAIN = 1e-12
NODE_BYTES = 200  # of a node at the driver
RANGE = 2048  # features whose statistics are added up together
NODE_BITS = 40  # of a code, below the place of its node
REFRESH = 10  # trees after which blocks take the finished ones into their margins
GUESS_ROWS = 1 << 15  # rows, about and at most, that the driver guesses the course of a tree by
GUESS_ENTRIES = 200_000  # their entries between two trees, the features noted last are kept
LEADERS = 512  # features taken note of in one pass as the best, shared by its nodes, 6 to a node at least


@dataclass
class Sums:
    """Statistics of the rows of one node by occurring (feature, bin), in order, and over all of the node's rows."""

    code: np.ndarray  # feature * 256 + bin
    g: np.ndarray
    h: np.ndarray
    n: np.ndarray
    total: np.ndarray  # g, h, n

    def __add__(self, other: Sums) -> Sums:
        code = np.concatenate([self.code, other.code])
        order = np.argsort(code, kind="stable")
        return _runs(code[order], *[np.concatenate(p)[order] for p in ((self.g, other.g), (self.h, other.h), (self.n, other.n))],
                     self.total + other.total)


def _runs(code, g, h, n, total) -> Sums:
    if not len(code):
        return Sums(code, g, h, n, total)
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return Sums(code[first], np.add.reduceat(g, first), np.add.reduceat(h, first), np.add.reduceat(n, first), total)


def first_of(splits: list[tuple]) -> tuple | None:
    """The best of the best splits of ranges, ties to the lower feature and bin."""
    splits = [s for s in splits if s]
    top = max((s[0] for s in splits), default=0.0)
    return min((s for s in splits if s[0] >= top - 1e-9 * max(abs(top), 1e-3)), key=lambda s: s[1:3], default=None)


def leaf_sums(row: np.ndarray, code: np.ndarray, at: np.ndarray, n_leaves: int, g, h) -> Sums:
    """Sums by leaf and code. ``row`` and ``code`` are entries in order of their codes, ``at`` is the leaf of every row or -1."""
    total = np.stack([np.bincount(at + 1, x, n_leaves + 1)[1:] for x in (g, h, np.ones(len(at)))], axis=1)
    own = at[row]
    kept = np.flatnonzero(own >= 0)
    kept = kept[np.argsort(own[kept].astype(np.int16), kind="stable")]
    of = row[kept]
    return _runs((own[kept] << NODE_BITS) + code[kept], g[of], h[of], np.ones(len(of)), total)


class Thresholds:
    """Splits that leave enough rows on the right, in order, for sums of codes: zero of each feature, then its bins."""

    def __init__(self, code: np.ndarray, n: np.ndarray, least: float):
        first, last = _layout(code)
        upto = np.cumsum(n)
        at_zero = first[upto[last[first]] - upto[first] + n[first] > least - 1e-9]
        self.key = np.sort(np.concatenate([code[at_zero] & ~255, code[upto[last] - upto > least - 1e-9]]))
        self.known = np.isin(code & ~255, code[at_zero] & ~255)  # codes of features that have any

    def right(self, code: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Sums of what is above each threshold, within its feature, from sums by known code."""
        first, last = _layout(code)
        upto = np.cumsum(sums, axis=1)
        above = upto[:, last] - upto + sums  # from the code on
        end = np.searchsorted(self.key, code)
        start = np.empty_like(end)
        start[1:], start[first] = end[:-1], np.searchsorted(self.key, code[first] & ~255)
        # Between two codes stands the sum from the upper one on, between features nothing.
        lengths = np.empty(2 * len(code) + 1, np.int64)
        lengths[1::2], lengths[0:-1:2] = end - start, start - np.concatenate([[0], end[:-1]])
        lengths[-1] = len(self.key) - (end[-1] if len(end) else 0)
        values = np.zeros((len(sums), len(lengths)))
        values[:, 1::2] = above
        return np.stack([np.repeat(v, lengths) for v in values])

    def gains(self, right: np.ndarray, total: np.ndarray, l2: float, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Gain and code of every split worth making."""
        least -= 1e-9
        # Differences of sums carry rounding; counts are whole numbers or small fractions of them.
        valid = np.flatnonzero((right[2] > least) & (right[2] < total[2] - least) & (right[1] >= LEAST_HESSIAN)
                               & (right[1] <= total[1] - LEAST_HESSIAN))
        g, h = right[0][valid], right[1][valid]
        gain = g * g / (h + l2) + (total[0] - g) ** 2 / (total[1] - h + l2) - total[0] ** 2 / (total[1] + l2)
        worth = gain > LEAST_GAIN
        return gain[worth], self.key[valid[worth]]


def node_splits(s: Sums, tree: Tree, nodes: list[int], l2: float, least: float, n_leaders: int) -> dict[int, tuple]:
    """Total, best split and leaders of every node, from the sums of those without children, which are added up towards the root."""
    ends = [n for n in nodes if tree.left[n] < 0]
    codes, at = np.unique(s.code & ((1 << NODE_BITS) - 1), return_inverse=True)
    thresholds = Thresholds(codes, np.bincount(at, s.n, len(codes)), least)
    kept = np.flatnonzero(thresholds.known[at])
    code, stats = s.code[kept], np.stack([s.g[kept], s.h[kept], s.n[kept]])
    cut = np.searchsorted(code, np.arange(len(ends) + 1) << NODE_BITS)
    span = {n: (s.total[k], slice(a, b)) for k, (n, a, b) in enumerate(zip(ends, cut[:-1], cut[1:]))}
    code = code & ((1 << NODE_BITS) - 1)
    added, totals, out = {}, {}, {}

    def right_of(node: int) -> np.ndarray:
        return added.pop(node) if node in added else thresholds.right(code[span[node][1]], stats[:, span[node][1]])
    for node in sorted(nodes, reverse=True):
        if node in span:
            totals[node] = span[node][0]
            right = right_of(node) if totals[node][2] > 2 * least - 1e-9 else np.zeros((3, 0))
        else:
            a, b = tree.left[node], tree.left[node] + 1
            totals[node] = totals[a] + totals[b]
            right = added[node] = right_of(a)
            right += right_of(b)
        gain, key = thresholds.gains(right, totals[node], l2, least)
        out[node] = totals[node], _best(gain, key), _leaders(gain, key, n_leaders)
    return out


def _leaders(gain: np.ndarray, key: np.ndarray, n: int) -> list[tuple[float, int]]:
    """(gain, feature) of the ``n`` features with the highest gains, from splits in order."""
    if not n or not len(key):
        return []
    first = np.flatnonzero(np.diff(key >> 8, prepend=-1))
    best, feature = np.maximum.reduceat(gain, first), key[first] >> 8
    top = np.argpartition(-best, n)[:n] if len(best) > n else np.arange(len(best))
    return list(zip(best[top].tolist(), feature[top].tolist()))


def _best(gain: np.ndarray, key: np.ndarray) -> tuple[float, int, int] | None:
    if not len(gain):
        return None
    top = gain.max()
    near = np.flatnonzero(gain >= top - 1e-9 * max(abs(top), 1e-3))
    k = near[np.argmin(key[near])]
    return float(gain[k]), int(key[k] >> 8), int(key[k] & 255)


def _layout(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of codes in order, the places of the first code of each feature, and for each code that of its feature's last."""
    first = np.flatnonzero(np.diff(code >> 8, prepend=-1))
    last = np.append(first, len(code))[1:] - 1
    return first, np.repeat(last, last - first + 1)


def best_split(s: Sums, l2: float, least: float) -> tuple[float, int, int] | None:
    """(gain, feature, bin) of the best split, ties to the lower feature and bin."""
    if not len(s.code) or s.total[2] < 2 * least - 1e-9:
        return None
    feature, code, sums = s.code >> 8, s.code, np.stack([s.g, s.h, s.n])
    first = np.concatenate([[True], feature[1:] != feature[:-1]])
    start = np.flatnonzero(first)
    segment = np.cumsum(first) - 1
    # Only rows with an entry ever go right, so a feature needs as many entries as a leaf needs rows.
    enough = np.add.reduceat(s.n, start) > least - 1e-9
    if not enough.all():
        kept = enough[segment]
        feature, code, sums = feature[kept], code[kept], sums[:, kept]
        if not len(code):
            return None
        first = np.concatenate([[True], feature[1:] != feature[:-1]])
        start = np.flatnonzero(first)
        segment = np.cumsum(first) - 1
    upto = np.cumsum(sums, axis=1)
    before = upto[:, start] - sums[:, start]
    last = np.concatenate([start[1:], [len(feature)]]) - 1
    zero = s.total[:, None] - (upto[:, last] - before)  # rows without an entry
    # Thresholds at zero, then at every bin that occurs.
    left = np.concatenate([zero, upto - before[:, segment] + zero[:, segment]], axis=1)
    key = np.concatenate([code[start] & ~255, code])
    right = s.total[:, None] - left
    # Differences of sums carry rounding; counts are whole numbers or small fractions of them.
    valid = (left[2] > least - 1e-9) & (right[2] > least - 1e-9) & (left[1] >= LEAST_HESSIAN) & (right[1] >= LEAST_HESSIAN)
    if not valid.any():
        return None
    left, right, key = left[:, valid], right[:, valid], key[valid]
    gain = left[0] ** 2 / (left[1] + l2) + right[0] ** 2 / (right[1] + l2) - s.total[0] ** 2 / (s.total[1] + l2)
    top = gain.max()
    if top <= LEAST_GAIN:
        return None
    near = np.flatnonzero(gain >= top - 1e-9 * max(abs(top), 1e-3))
    k = near[np.argmin(key[near])]
    return float(gain[k]), int(key[k] >> 8), int(key[k] & 255)


@dataclass
class Tree:
    """Nodes in the order of their making; ``left`` is -1 for leaves, the right child follows the left one."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.bin, 0), (self.left, -1), (self.value, value)):
            column.append(x)
        return len(self.left) - 1

    def leaves_of(self, block: Block) -> np.ndarray:
        """The leaf of every row: zero goes left, only entries above a bin go right."""
        at, rows = np.zeros(len(block), np.int32), {0: np.arange(len(block))}
        for node, left in enumerate(self.left):
            if left >= 0 and (here := rows.pop(node, None)) is not None:
                span = slice(block.start[self.feature[node]], block.start[self.feature[node] + 1])
                right = block.row[span][block.bin[span] > self.bin[node]]
                right = right[at[right] == node]
                at[here] = left
                if len(right):
                    at[right] = left + 1
                    rows[left + 1], here = right, here[at[here] == left]
                if len(here):
                    rows[left] = here
        return at


class Grower:
    """One tree, best leaf first. Children are made, and measured, ahead of the leaves they would replace."""

    def __init__(self, leaves: int, l2: float, least: float, scale: float, depth: int | None = None):
        self.max_leaves, self.l2, self.least, self.scale, self.max_depth = leaves, l2, least, scale, depth
        self.tree = Tree()
        self.tree.add(0.0)
        self.depth = [0]
        self.split: dict[int, tuple | None] = {}  # of the nodes measured
        self.leaves = [0]
        self.done = False

    def wanted(self, width: int) -> list[int]:
        """Nodes to measure: children of the best open leaves."""
        if 0 not in self.split:
            return [0]
        self._commit()
        if self.done:
            return []
        ranked = sorted((leaf for leaf in self.leaves if self.split[leaf] and self.tree.left[leaf] < 0), key=self._rank)
        out = []
        for leaf in ranked[:max(min(width, self.max_leaves - len(self.leaves)), 1)]:
            _, self.tree.feature[leaf], self.tree.bin[leaf] = self.split[leaf]
            a, b = self.tree.add(0.0), self.tree.add(0.0)
            self.tree.left[leaf] = a
            self.depth += [self.depth[leaf] + 1] * 2
            out += [a, b]
        return out

    def _rank(self, leaf: int):
        return -self.split[leaf][0], leaf

    def settled(self) -> bool:
        """Whether the tree is complete by what has been measured."""
        if 0 in self.split:
            self._commit()
        return self.done

    def features(self) -> set[int]:
        """Features of the measured splits that may follow."""
        return {split[1] for split in self.split.values() if split}

    def guessed(self, root: Part) -> list[int]:
        """Nodes to measure: the rest of the tree as it would grow, with guesses for the splits that are not measured."""
        out, part, split, todo, leaves = [], {0: root}, {}, [0], set(self.leaves)

        def divide(node: int) -> int:
            a = self.tree.left[node]
            part[a], part[a + 1] = part.pop(node).divided(self.tree.feature[node], self.tree.bin[node])
            return a

        def expect(node: int) -> None:
            split[node] = self.split[node] if node in self.split else part[node].split()
        while todo:
            if (node := todo.pop()) in leaves:
                expect(node)
                out += [] if node in self.split else [node]
            else:
                a = divide(node)
                todo += [a, a + 1]
        while len(leaves) < self.max_leaves and (able := [leaf for leaf in leaves if split[leaf]]):
            best = min(able, key=lambda leaf: (-split[leaf][0], leaf))
            if self.tree.left[best] < 0:
                _, self.tree.feature[best], self.tree.bin[best] = split[best]
                self.tree.left[best] = self.tree.add(0.0)
                self.tree.add(0.0)
                self.depth += [self.depth[best] + 1] * 2
                out += [len(self.depth) - 2, len(self.depth) - 1]
            a = divide(best)
            leaves = leaves - {best} | {a, a + 1}
            expect(a)
            expect(a + 1)
        return out

    def corrected(self, nodes: list[int]) -> None:
        """Give up children that were made by a wrong guess."""
        for node in nodes:
            split = self.split[node]
            if self.tree.left[node] >= 0 and (split is None or split[1:] != (self.tree.feature[node], self.tree.bin[node])):
                self.tree.left[node] = -1

    def measured(self, node: int, total: np.ndarray, split: tuple | None) -> None:
        self.tree.value[node] = float(-self.scale * total[0] / (total[1] + self.l2)) if total[1] > 0 else 0.0
        deep = self.max_depth is not None and self.depth[node] >= self.max_depth
        self.split[node] = None if deep else split

    def _commit(self) -> None:
        """Replace best leaves by their children as long as these are measured."""
        while True:
            able = [leaf for leaf in self.leaves if self.split[leaf]]
            if not able or len(self.leaves) >= self.max_leaves:
                self.done = True
                return
            best = min(able, key=self._rank)
            a = self.tree.left[best]
            if a < 0 or a not in self.split:
                return
            self.split[best] = None
            self.leaves.remove(best)
            self.leaves += [a, a + 1]

    def finished(self) -> Tree:
        """The tree without children that were only tried, nodes numbered anew from the root."""
        kept, out = set(self.leaves), Tree()
        todo = [(0, out.add(self.tree.value[0]))]
        while todo:
            node, new = todo.pop(0)
            if node not in kept:
                a = self.tree.left[node]
                out.feature[new], out.bin[new] = self.tree.feature[node], self.tree.bin[node]
                out.left[new] = left = out.add(self.tree.value[a])
                right = out.add(self.tree.value[a + 1])
                todo += [(a, left), (a + 1, right)]
        return out


class LevelGrower(Grower):
    """One tree of any number of leaves: their order does not matter, so every pass takes a whole level."""

    def __init__(self, least: float, depth: int | None):
        super().__init__(0, 0.0, least, 1.0, depth)
        self.level = [0]

    def wanted(self, width: int) -> list[int]:
        if self.done or self.level[0] not in self.split:
            return self.level
        out = []
        for leaf in self.level:
            if (split := self.split.pop(leaf)) is not None:
                _, self.tree.feature[leaf], self.tree.bin[leaf] = split
                a, b = self.tree.add(0.0), self.tree.add(0.0)
                self.tree.left[leaf] = a
                self.depth += [self.depth[leaf] + 1] * 2
                out += [a, b]
        self.level, self.done = out, not out
        return out

    def finished(self) -> Tree:
        self.leaves = [i for i, left in enumerate(self.tree.left) if left < 0]
        return super().finished()


class Model:
    """Sum (boosting, with a prior and a logistic link) or mean (forest) over trees."""

    def __init__(self, trees: list[Tree], prior: float | None):
        self.trees, self.prior = trees, prior

    def probability(self, block: Block) -> np.ndarray:
        total = np.zeros(len(block))
        for t in self.trees:
            total += np.array(t.value)[t.leaves_of(block)]
        if self.prior is None:
            return total / max(len(self.trees), 1)
        return 1 / (1 + np.exp(-(self.prior + total)))


class Guess:
    """What the driver guesses the course of a tree by: some of the rows, with their entries in the features asked for lately.

    Guesses only tell which nodes are measured together. What is measured over all rows and features decides.
    """

    def __init__(self, n_rows: float, prior: float, l2: float, least: float):
        self.share, self.prior, self.l2, self.least = min(1.0, GUESS_ROWS / max(n_rows, 1)), prior, l2, least
        self.columns: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # rows and bins
        self.noted: dict[int, float] = {}  # features among the best: the last tree that had them, and a share for their rank
        self.n_trees = 0
        self.margin: np.ndarray | None = None
        self.block: Block | None = None

    def note(self, leaders: list[list[tuple[float, int]]], splits: list[tuple | None]) -> None:
        """Features that were among the best of each node, over all rows, and those of the splits."""
        most = max(LEADERS // max(len(leaders), 1), 6)
        for found in leaders:
            for rank, (_, f) in enumerate(sorted(found, reverse=True)[:most]):
                self.noted[f] = max(self.noted.get(f, 0.0), self.n_trees + 1 / (rank + 2))
        self.noted |= {split[1]: self.n_trees + 1.0 for split in splits if split}

    def lacking(self) -> list[int]:
        return sorted(self.noted.keys() - self.columns.keys())

    def add(self, parts: list[tuple]) -> None:
        """Entries from every block: numbers and targets of the rows, feature, place among the rows and bin of the entries."""
        number, target = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
        order = np.argsort(number)
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        first = np.cumsum([0, *(len(p[0]) for p in parts)])
        feature, bins = (np.concatenate([p[k] for p in parts]) for k in (2, 4))
        row = place[np.concatenate([p[3] + n for p, n in zip(parts, first)])]
        by = np.lexsort((row, bins, feature))
        feature, row, bins = feature[by], row[by], bins[by]
        for f in self.lacking():
            span = slice(*np.searchsorted(feature, [f, f + 1]))
            self.columns[f] = row[span], bins[span]
        if self.margin is None:
            self.margin = np.full(len(order), self.prior)
        self._fill(target[order], parts[0][5])

    def _fill(self, target: np.ndarray, n_features: int) -> None:
        known = sorted(self.columns)
        sizes = [len(self.columns[f][0]) for f in known]
        row, bins = (np.concatenate([np.zeros(0, kind), *(self.columns[f][k] for f in known)]) for k, kind in enumerate((np.int32, np.int16)))
        feature = np.repeat(np.array(known, np.int64), sizes)
        self.block = Block(target, np.arange(len(target)), {}, row, feature, bins, np.zeros(0), n_features)
        code = feature * 256 + bins
        codes, at = np.unique(code, return_inverse=True)
        self.thresholds = Thresholds(codes, np.bincount(at, minlength=len(codes)) / self.share, self.least)
        known = np.flatnonzero(self.thresholds.known[at])
        known = known[np.argsort(row[known], kind="stable")]
        self.row, self.code = row[known], code[known]
        self.start = np.searchsorted(self.row, np.arange(len(target) + 1))

    def grow(self, grower: Grower) -> list[int]:
        q = 1 / (1 + np.exp(-self.margin))
        self.stats = np.stack([q - self.block.target, np.maximum(q * (1 - q), 1e-16), np.ones(len(q))]) / self.share
        return grower.guessed(Part(self, np.arange(len(self.block))))

    def follow(self, tree: Tree) -> None:
        """Go on to the next tree, with the columns asked for last."""
        self.n_trees += 1
        if self.block is None:
            return
        self.margin = self.margin + np.array(tree.value)[tree.leaves_of(self.block)]
        lately = sorted(self.columns, key=lambda f: (-self.noted[f], f))
        sizes = np.cumsum([len(self.columns[f][0]) for f in lately])
        if len(sizes) and sizes[-1] > GUESS_ENTRIES:
            kept = lately[:int(np.searchsorted(sizes, GUESS_ENTRIES, "right"))]
            self.columns = {f: self.columns[f] for f in kept}
            self._fill(self.block.target, self.block.n_features)
        self.noted = {f: k for f, k in self.noted.items() if f in self.columns}


class Part:
    """Some rows of a guess, with the sums above each threshold."""

    def __init__(self, guess: Guess, rows: np.ndarray, right: np.ndarray | None = None):
        self.guess, self.rows, self.total, self._right = guess, rows, guess.stats[:, rows].sum(axis=1), right

    def right(self) -> np.ndarray:
        if self._right is None:
            start = self.guess.start
            lengths = start[self.rows + 1] - start[self.rows]
            entries = np.repeat(start[self.rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            code = self.guess.code[entries]
            order = np.argsort(code, kind="stable")
            self._right = self.guess.thresholds.right(code[order], self.guess.stats[:, self.guess.row[entries[order]]])
        return self._right

    def divided(self, feature: int, bin: int) -> tuple[Part, Part]:
        block = self.guess.block
        span, right = slice(block.start[feature], block.start[feature + 1]), np.zeros(len(block), bool)
        right[block.row[span][block.bin[span] > bin]] = True
        rows = self.rows[~right[self.rows]], self.rows[right[self.rows]]
        few = int(len(rows[1]) < len(rows[0]))
        small = Part(self.guess, rows[few])
        large = Part(self.guess, rows[1 - few], None if self._right is None else self._right - small.right())
        return (large, small) if few else (small, large)

    def split(self) -> tuple | None:
        if self.total[2] < 2 * self.guess.least:
            return None
        return _best(*self.guess.thresholds.gains(self.right(), self.total, self.guess.l2, self.guess.least))


class BoostJob(Job):
    """Gradient boosting of the logistic loss with histograms, leaf by leaf.

    Over several blocks the rest of a tree is guessed and all of it measured in one pass; it is kept up to the first wrong guess
    on each branch. Trees are those of measuring leaf by leaf.
    """

    binned = True

    def __init__(self, params: dict, without: list[tuple[str, int]]):
        self.p, self.without = params, without
        self.trees: list[Tree] = []
        self.n_absorbed = 0
        self.prior: float | None = None
        self.grower: Grower | None = None
        self.guess: Guess | None = None
        self.asked: tuple[Tree, list[int]] | None = None

    def request(self, width: int):
        if self.prior is None:
            return "prior"
        while len(self.trees) < self.p["max_iter"]:
            if self.grower is None:
                self.grower = Grower(self.p["max_leaf_nodes"], self.p["l2_regularization"], self.p["min_samples_leaf"],
                                     self.p["learning_rate"])
            if self.whole:
                wanted = self.grower.wanted(width)
            elif self.grower.settled():
                wanted = []
            elif not self.guess.noted:
                wanted = [0]
            elif self.guess.block is None or self.grower.features() - self.guess.columns.keys():
                return "columns", self.guess.share, self.guess.lacking()
            else:
                wanted = self.guess.grow(self.grower)
            if wanted:
                self.asked = self.grower.tree, wanted
                return "nodes", self.trees[self.n_absorbed:], *self.asked
            tree, self.grower = self.grower.finished(), None
            if tree.left[0] < 0:  # nothing splits any more: what follows would be the same root
                self.p = {**self.p, "max_iter": len(self.trees)}
                break
            self.trees.append(tree)
            if self.guess is not None:
                self.guess.follow(tree)
        return None

    def answer(self, block: Block, request):
        rows = block.rows_in(self.without)
        if request == "prior":
            return np.array([block.target[rows].sum(), rows.sum()], float)
        if request[0] == "columns":
            return self._columns(block, rows, *request[1:])
        _, recent, tree, wanted = request
        margin = self._margin(block, recent)
        q = 1 / (1 + np.exp(-margin))
        g, h = q - block.target, np.maximum(q * (1 - q), 1e-16)
        ends = [node for node in wanted if tree.left[node] < 0]
        place = np.full(len(tree.left) + 1, -1)
        place[ends] = np.arange(len(ends))
        at = place[np.where(rows, tree.leaves_of(block), -1)]
        row, code = self._entries(block)
        cut = np.searchsorted(code, np.append(np.arange(0, block.n_features, RANGE), block.n_features) * 256)
        return {k: leaf_sums(row[a:b], code[a:b], at, len(ends), g, h) for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]))}

    def _columns(self, block: Block, rows: np.ndarray, share: float, features: list[int]) -> dict:
        rows = np.flatnonzero(rows & (_mix(block.number.astype(np.uint64)) / 2.0 ** 64 <= share))
        place = np.full(len(block), -1)
        place[rows] = np.arange(len(rows))
        spans = [np.arange(block.start[f], block.start[f + 1]) for f in features]
        entries = np.concatenate([np.zeros(0, np.int64), *spans])
        entries = entries[place[block.row[entries]] >= 0]
        return {("columns", int(block.number[0])): (block.number[rows], block.target[rows], block.feature[entries],
                                                    place[block.row[entries]], block.bin[entries], block.n_features)}

    def _entries(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Rows and codes of the entries of features that have enough of them, over all blocks, for a leaf."""
        least = self.p["min_samples_leaf"]
        if (known := block.state.get(("entries", least))) is None:
            counts = np.diff(block.start) if self.whole else block.state["counts"]
            some = np.flatnonzero((counts >= least)[block.feature])
            known = block.state["entries", least] = block.row[some], block.feature[some].astype(np.int64) * 256 + block.bin[some]
        return known

    def _margin(self, block: Block, recent: list[Tree]) -> np.ndarray:
        margin = block.state.get(self.id)
        if margin is None:
            margin = np.full(len(block), self.prior)
        for t in recent:
            margin = margin + np.array(t.value)[t.leaves_of(block)]
        return margin

    def parts(self, answer, block: Block):
        return [(None, answer)] if isinstance(answer, np.ndarray) else list(answer.items())

    def digest(self, total):
        if not isinstance(total, Sums):
            return total
        tree, wanted = self.asked
        leaders = 0 if self.whole else max(LEADERS // len(wanted) // 8, 3)
        return node_splits(total, tree, wanted, self.p["l2_regularization"], self.p["min_samples_leaf"], leaders)

    def joined(self, digests):
        """By node, the total and the best split."""
        if digests[0][0] is None:
            return digests[0][1]
        if isinstance(digests[0][0], tuple):
            self.guess.add([part for _, part in sorted(digests, key=lambda d: d[0])])
            return {}
        totals, splits, leaders = {}, {}, {}
        for _, found in sorted(digests, key=lambda d: d[0]):
            for node, (total, split, leading) in found.items():
                totals.setdefault(node, total)
                splits.setdefault(node, []).append(split)
                leaders.setdefault(node, []).extend(leading)
        out = {node: (totals[node], first_of(splits[node])) for node in sorted(totals)}
        if self.guess is not None:
            self.guess.note(list(leaders.values()), [split for _, split in out.values()])
        return out

    def weight(self, n_rows: int) -> int:
        return self.p["max_iter"] * 2 * self.p["max_leaf_nodes"] * NODE_BYTES + 28 * GUESS_ENTRIES + 32 * min(n_rows, GUESS_ROWS)

    def receive(self, total) -> None:
        if isinstance(total, np.ndarray):
            share = np.clip(total[0] / max(total[1], 1), 1e-9, 1 - 1e-9)
            self.prior = float(np.log(share / (1 - share)))
            if not self.whole:
                self.guess = Guess(total[1], self.prior, self.p["l2_regularization"], self.p["min_samples_leaf"])
            return
        for node, found in total.items():
            self.grower.measured(node, *found)
        self.grower.corrected(list(total))

    def to_absorb(self, at_once: bool):
        new = self.trees[self.n_absorbed:]
        return new if new and (at_once or len(new) >= REFRESH) else None

    def absorb(self, block: Block, what) -> None:
        block.state[self.id] = self._margin(block, what)

    def absorbed(self) -> None:
        self.n_absorbed = len(self.trees)

    def light(self) -> BoostJob:
        out = copy.copy(self)
        out.trees, out.grower, out.guess = [], None, None
        return out

    def result(self) -> Model:
        return Model(self.trees, self.prior)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


#: Chances of drawing a row at most 0, 1, 2, ... times in a bootstrap.
_POISSON = np.cumsum(np.exp(-1) / np.concatenate([[1], np.cumprod(np.arange(1, 12))]))


class ForestJob(Job):
    """Random forest: bootstrap weights from a hash of row and tree, features drawn per node, all trees a level at a time."""

    binned = True

    def __init__(self, params: dict, without: list[tuple[str, int]], n_features: int, seed: int = 42):
        self.p, self.without, self.n_features, self.seed = params, without, n_features, seed
        draw = {"sqrt": np.sqrt, "log2": np.log2}[params.get("max_features", "sqrt")]
        self.n_drawn = max(math.ceil(draw(n_features)), 1)
        self.growers = [LevelGrower(params["min_samples_leaf"], params["max_depth"]) for _ in range(params["n_estimators"])]

    def request(self, width: int):
        wanted = {t: w for t, g in enumerate(self.growers) if (w := g.wanted(width))}
        return {t: (self.growers[t].tree, w) for t, w in wanted.items()} or None

    def answer(self, block: Block, request):
        """By tree, the sums of all wanted nodes; the code of an entry tells the node's place among them."""
        rows = block.rows_in(self.without)
        out = {}
        for t, (tree, wanted) in request.items():
            key = _mix(np.array([self.seed * 1_000_003 + t], np.uint64))[0]
            u = _mix(block.number.astype(np.uint64) ^ key) / 2.0 ** 64
            times = np.searchsorted(_POISSON, u).astype(float) * rows
            place = np.full(len(tree.left) + 1, -1)
            place[wanted] = np.arange(len(wanted))
            at, g = place[np.where(times > 0, tree.leaves_of(block), -1)], -times * block.target
            met = np.flatnonzero(np.bincount(at + 1, minlength=len(wanted) + 1)[1:])
            total = np.stack([np.bincount(at + 1, x, len(wanted) + 1)[1:] for x in (g, times, times)], axis=1)
            chosen = np.concatenate([np.zeros(0, np.int64), *(self._drawn(t, wanted[k]) for k in met)])
            lengths = block.start[chosen + 1] - block.start[chosen]
            entries = np.repeat(block.start[chosen] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
            node = np.repeat(np.repeat(met, self.n_drawn), lengths)
            inside = at[block.row[entries]] == node
            entries, node = entries[inside], node[inside]
            of = block.row[entries]
            code = (node << NODE_BITS) + block.feature[entries].astype(np.int64) * 256 + block.bin[entries]
            out[t] = _runs(code, g[of], times[of], times[of], total)
        return out

    def _drawn(self, t: int, node: int) -> np.ndarray:
        rng = np.random.default_rng((self.seed, t, node))
        return np.sort(rng.choice(self.n_features, self.n_drawn, replace=False, shuffle=False))

    def parts(self, answer, block: Block):
        return list(answer.items())

    def digest(self, total):
        cut = np.searchsorted(total.code, np.arange(len(total.total) + 1) << NODE_BITS)
        code = total.code & ((1 << NODE_BITS) - 1)
        return [(own, best_split(Sums(code[a:b], total.g[a:b], total.h[a:b], total.n[a:b], own), 0.0, self.p["min_samples_leaf"]))
                for own, a, b in zip(total.total, cut[:-1], cut[1:])]

    def joined(self, digests):
        return dict(digests)

    def weight(self, n_rows: int) -> int:
        most = n_rows // self.p["min_samples_leaf"] + 1
        leaves = most if self.p["max_depth"] is None else min(most, 2 ** self.p["max_depth"])
        return self.p["n_estimators"] * 2 * leaves * NODE_BYTES

    def receive(self, total) -> None:
        for t, nodes in total.items():
            for node, found in zip(self.growers[t].level, nodes):
                self.growers[t].measured(node, *found)

    def light(self) -> ForestJob:
        out = copy.copy(self)
        out.growers = []
        return out

    def result(self) -> Model:
        return Model([g.finished() for g in self.growers], None)


class TreeModel:
    """Trees with real thresholds, applied to a table of vectors; saved as a table of nodes."""

    NODES = "tree int, node int, feature int, threshold double, left int, value double"

    def __init__(self, nodes: list[tuple], prior: float | None):
        """``nodes``: tree, node, feature, threshold, left, value, in the order of trees and nodes."""
        self.nodes, self.prior = nodes, prior
        self.features = np.unique([n[2] for n in nodes if n[4] >= 0]).astype(int)
        place = {f: i for i, f in enumerate(self.features.tolist())}
        roots = [i for i, n in enumerate(nodes) if n[1] == 0]
        base = np.repeat(roots, np.diff([*roots, len(nodes)])) if nodes else np.zeros(0, int)
        own = np.arange(len(nodes))
        inner = np.array([n[4] >= 0 for n in nodes], bool)
        self.roots = np.array(roots, int)
        self.feature = np.array([place.get(n[2], 0) if n[4] >= 0 else 0 for n in nodes], int)
        self.threshold = np.array([n[3] for n in nodes], float)
        self.left = np.where(inner, base + np.array([n[4] for n in nodes], int), own) if nodes else own
        self.right = np.where(inner, self.left + 1, own)
        self.value = np.array([n[5] for n in nodes], float)

    @classmethod
    def of(cls, model: Model, blocks: Blocks) -> TreeModel:
        used = {(f, b) for t in model.trees for f, b, left in zip(t.feature, t.bin, t.left) if left >= 0}
        value = blocks.thresholds(used)
        nodes = [(k, i, f, value[f, b] if left >= 0 else 0.0, left, v) for k, t in enumerate(model.trees)
                 for i, (f, b, left, v) in enumerate(zip(t.feature, t.bin, t.left, t.value))]
        return cls(nodes, model.prior)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """For rows of the used features."""
        if not self.nodes:
            return np.full(len(x), 0.0 if self.prior is None else 1 / (1 + np.exp(-self.prior)))
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        if x.shape[1]:
            while True:
                to = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                if (to == at).all():
                    break
                at = to
        total = self.value[at].sum(axis=1)
        return total / len(self.roots) if self.prior is None else 1 / (1 + np.exp(-(self.prior + total)))

    def transform(self, rows: DataFrame) -> DataFrame:
        """Adds ``probability``, of class 0 and 1, and ``prediction``."""
        def score(indices: pd.Series, values: pd.Series) -> pd.Series:
            out = np.zeros((len(values), len(self.features)))
            lengths = np.array([len(v) for v in values])
            if len(self.features) and lengths.sum():
                row = np.repeat(np.arange(len(values)), lengths)
                feature, value = np.concatenate(indices.tolist()), np.concatenate(values.tolist())
                column = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
                known = self.features[column] == feature
                out[row[known], column[known]] = value[known]
            return pd.Series(self.probabilities(out))

        v = F.unwrap_udt("features")
        indices = F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1))
        p = F.pandas_udf(score, "double")(indices, v["values"])
        scored = rows.withColumn("_p", p)
        return scored.withColumns({"probability": array_to_vector(F.array(1 - F.col("_p"), F.col("_p"))),
                                   "prediction": (F.col("_p") > 0.5).cast("double")}).drop("_p")

    def save(self, path: str, spark: SparkSession) -> None:
        nodes = self.nodes or [(0, 0, -1, 0.0, -1, 0.0)]
        spark.createDataFrame(nodes, self.NODES).coalesce(1).withColumn("about", F.lit(json.dumps({"prior": self.prior}))).write.mode(
            "overwrite").parquet(path)

    @classmethod
    def load(cls, path: str, spark: SparkSession) -> TreeModel:
        rows = spark.read.parquet(path).orderBy("tree", "node").collect()
        return cls([tuple(r)[:6] for r in rows], json.loads(rows[0]["about"])["prior"])
