"""Exact nearest neighbours by squared Euclidean distance.

Every vector belongs to the cell of its nearest pivot. Distances to the pivots bound distances between vectors:
a query visits only cells that can still hold one of its ``k`` nearest, so far pairs are never formed, and the
result is exact. Neighbouring small cells form a group, large ones are cut, so that either side meets in blocks of
bounded size: a row is copied once per block of the other side, not per cell, and a cell that holds a third of all
vectors becomes many tasks. Within a task the distances of some rows to a block are one matrix product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from mailsift.session import materialise

BLOCK = 16384  # rows of one block on either side
MAX_PIVOTS = 1024
_ROWS = 512  # rows whose distances to a block, or bounds to all pivots, are held at once
_STRIDE = 64  # distances that are summed up by their least
_SINGLE = 1e30  # squared lengths below which single precision can tell distances
_MANY = 8  # times as many rows as are wanted that single precision may leave
_SLACK = 1e-6  # bounds are widened by this much against rounding


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(d, 0.0)


def choose_pivots(vectors: DataFrame, key: str, n: int) -> np.ndarray:
    """At most ``n`` vectors in a stable pseudo-random order; their number does not grow with the data."""
    order = F.md5(F.concat_ws(":", F.lit("pivot"), F.col(key).cast("string")))
    rows = vectors.select(key, "embedding").orderBy(order, key).limit(min(n, MAX_PIVOTS)).collect()
    return np.array([r["embedding"] for r in rows], dtype=np.float64)


def assign_cells(vectors: DataFrame, pivots: np.ndarray, key: str) -> DataFrame:
    """Add ``cell`` and ``to_pivot``, the nearest pivot and the distance to it."""
    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["embedding"])
                cell, least = np.empty(len(x), "int32"), np.empty(len(x))
                for i in range(0, len(x), _ROWS):
                    d = _squared(x[i:i + _ROWS], pivots)
                    cell[i:i + _ROWS], least[i:i + _ROWS] = d.argmin(1), d.min(1)
                yield batch.assign(cell=cell, to_pivot=np.sqrt(least))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInPandas(assign, f"{fields}, cell INT, to_pivot DOUBLE")


def cell_summary(cells: DataFrame, k: int) -> pd.DataFrame:
    """Per cell: count, radius and the ``k`` smallest distances to the pivot. At most one row per pivot."""
    near = F.row_number().over(Window.partitionBy("cell").orderBy("to_pivot"))
    closest = (cells.select("cell", "to_pivot").withColumn("rank", near).filter(F.col("rank") <= k)
               .groupBy("cell").agg(F.array_sort(F.collect_list("to_pivot")).alias("closest")))
    sizes = cells.groupBy("cell").agg(F.count("*").alias("n"), F.max("to_pivot").alias("radius"),
                                      F.min("to_pivot").alias("inner"))
    return sizes.join(closest, "cell").toPandas()


def cell_groups(pivots: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """Group of every cell: neighbouring cells in a chain of nearest pivots, as many as one block holds."""
    group, at, filled, left = np.zeros(len(sizes), int), 0, 0, np.ones(len(sizes), bool)
    cell = 0
    for i in range(len(sizes)):
        if i:
            rest = np.flatnonzero(left)
            cell = int(rest[_squared(pivots[cell][None], pivots[rest])[0].argmin()])
            if filled + sizes[cell] > block:
                at, filled = at + 1, 0
        left[cell] = False
        group[cell], filled = at, filled + sizes[cell]
    return group


def route(queries: DataFrame, pivots: np.ndarray, summary: pd.DataFrame, k: int, key: str, group: np.ndarray) -> DataFrame:
    """Queries with ``targets``, every group with a cell that can hold one of their ``k`` nearest vectors."""
    cells = summary["cell"].to_numpy()
    radius, inner = summary["radius"].to_numpy(), summary["inner"].to_numpy()
    width = max(len(c) for c in summary["closest"])
    closest = np.full((len(cells), width), np.inf)
    for i, c in enumerate(summary["closest"]):
        closest[i, :len(c)] = c

    def targets(x: np.ndarray) -> list[np.ndarray]:
        d = np.sqrt(_squared(x, pivots[cells]))
        # k-th smallest upper bound: query to pivot plus pivot to one of its closest vectors
        upper = (d[:, :, None] + closest[None, :, :]).reshape(len(x), -1)
        kth = min(k, upper.shape[1]) - 1
        bound = np.partition(upper, kth, axis=1)[:, kth][:, None] * (1 + _SLACK)
        bound = np.sqrt(bound * bound + 2 * _SLACK) + _SLACK  # what rounds to the same distance counts
        lower = np.maximum(np.maximum(d - radius[None, :], inner[None, :] - d), 0.0)
        return [np.unique(group[row]).astype("int32") for row in lower <= bound]

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = _matrix(batch["embedding"])
                yield batch.assign(targets=[t for i in range(0, len(x), _ROWS) for t in targets(x[i:i + _ROWS])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    return queries.mapInPandas(visit, f"{fields}, targets ARRAY<INT>")


def _salt(key: str, blocks) -> Column:
    return F.pmod(F.xxhash64(key), blocks).cast("int")


def _first_copies(vectors: DataFrame, n: int, key: str) -> DataFrame:
    """At most ``n`` rows of equal vectors, those with the smallest ids.

    No other copy can be among the first ``n`` by distance and id, so nothing is lost. The rank limit is applied
    before the shuffle, so copies that make up a third of all rows never meet in one task.
    """
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy(key))
    return vectors.select(key, "embedding").withColumn("copy", rank).filter(F.col("copy") <= n)


def nearest(queries: DataFrame, collection: DataFrame, k: int = 3, key: str = "vec_id", exclude_self: bool = False,
            n_pivots: int | None = None, block: int = BLOCK) -> DataFrame:
    """``query_id, neighbour_id, distance, rank`` with squared distances; ties go to the smaller id.

    Equal vectors are searched for once and found by their first copies.
    """
    wanted = k + 1 if exclude_self else k
    distinct = _first_copies(queries, 1, key).drop("copy")
    found = _search(distinct, _first_copies(collection, wanted, key).drop("copy"), wanted, key, n_pivots, block)
    firsts = distinct.select(F.col(key).alias("_first"), "embedding")
    members = queries.select(F.col(key).alias("query_id"), "embedding").join(firsts, "embedding")
    matches = members.select("query_id", "_first").join(found, "_first")
    if exclude_self:
        matches = matches.filter(F.col("query_id") != F.col("neighbour_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))
    return matches.select("query_id", "neighbour_id", "distance", rank.alias("rank")).filter(F.col("rank") <= k)


def _nearest_in_block(a: np.ndarray, qid: np.ndarray, b: np.ndarray, cid: np.ndarray, k: int) -> pd.DataFrame:
    """``_first, neighbour_id, distance``: the ``k`` nearest of every row of ``a`` in a block.

    The least of every few distances is taken first: the ``k``-th smallest of these is no less than the ``k``-th distance,
    so only strides with a smaller one are looked into. These distances are of single precision, with bounds wider by twice what rounding
    can make of them, unless too many are left within the bounds. Exact differences then decide the order.
    """
    n, stride = len(b), _STRIDE if len(b) >= _STRIDE * k else 1
    norms, own = (b * b).sum(1), (a * a).sum(1)
    good = np.flatnonzero(np.isfinite(norms))  # what isn't a number is nobody's neighbour
    longest = norms[good].max(initial=0.0)
    single = max(longest, own[np.isfinite(own)].max(initial=0.0)) < _SINGLE
    tables: dict[type, np.ndarray] = {}

    def within(x: np.ndarray, lengths: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        if kind not in tables:  # inner products with it are squared distances less the row's own norm
            wide = tables[kind] = np.zeros((-(-n // stride) * stride, b.shape[1] + 1), kind)
            wide[:, -1] = np.inf
            wide[good, :-1], wide[good, -1] = -2.0 * b[good], norms[good]
        d = np.concatenate([x, np.ones((len(x), 1))], axis=1, dtype=kind) @ tables[kind].T
        least = d.reshape(len(x), -1, stride).min(axis=2) if stride > 1 else d
        kth = min(k, n, least.shape[1]) - 1
        if kind is np.float32:
            slack = 2 * _SLACK + 2 * (b.shape[1] + 8) * np.finfo(kind).eps * (np.sqrt(longest) + np.sqrt(lengths)) ** 2
        else:
            slack = 2 * _SLACK + 1e-12 * (longest + lengths)
        bound = np.nextafter((np.partition(least, kth, axis=1)[:, kth] + slack).astype(kind), kind(np.inf))
        rows, at = np.nonzero(least <= bound[:, None])
        rows, cols = np.repeat(rows, stride), (at[:, None] * stride + np.arange(stride)).ravel()
        near = d[rows, cols]
        close = np.flatnonzero((near <= bound[rows]) & np.isfinite(near))
        return rows[close], cols[close]
    parts = []
    for start in range(0, len(a), _ROWS):
        x, lengths = a[start:start + _ROWS], own[start:start + _ROWS]
        rows, cols = within(x, lengths, np.float32 if single else np.float64)
        if single and len(rows) > _MANY * k * len(x):
            rows, cols = within(x, lengths, np.float64)
        exact = ((x[rows] - b[cols]) ** 2).sum(1).round(6)
        order = np.lexsort((cid[cols], exact, rows))
        rows, cols, exact = rows[order], cols[order], exact[order]
        first = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append(pd.DataFrame({"_first": qid[start + rows[first]], "neighbour_id": cid[cols[first]], "distance": exact[first]}))
    return pd.concat(parts)


def _search(queries: DataFrame, collection: DataFrame, k: int, key: str, n_pivots: int | None,
            block: int) -> DataFrame:
    """``_first, neighbour_id, distance``: the ``k`` nearest of every query, the query itself included."""
    collection = materialise(collection, "collection")
    pivots = choose_pivots(collection, key, n_pivots or max(16, int(collection.count() ** 0.5)))
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], "_first LONG, neighbour_id LONG, distance DOUBLE")
    cells = materialise(assign_cells(collection, pivots, key), "cells")
    summary = cell_summary(cells, k)
    group = cell_groups(pivots[summary["cell"].to_numpy()], summary["n"].to_numpy(), block)
    routed = materialise(route(queries, pivots, summary, k, key, group), "routed")
    visits = {r["target"]: r["n"] for r in routed.select(F.explode("targets").alias("target")).groupBy("target").agg(
        F.count("*").alias("n")).collect()}
    held = np.bincount(group, summary["n"].to_numpy())
    plan = [(int(c), int(g), max(1, -(-int(held[g]) // block)), max(1, -(-visits.get(int(g), 0) // block)))
            for c, g in zip(summary["cell"], group)]
    sizes = queries.sparkSession.createDataFrame(plan, "cell INT, grp INT, c_blocks INT, q_blocks INT")

    # Either side meets every block of the other exactly once; the number of blocks follows from the counts.
    left = (routed.select(key, "embedding", F.explode("targets").alias("grp"))
            .join(F.broadcast(sizes.drop("cell").distinct()), "grp")
            .withColumn("q_block", _salt(key, F.col("q_blocks")))
            .withColumn("c_block", F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)))
            .select("grp", "c_block", "q_block", F.col(key).alias("id"), "embedding"))
    right = (cells.join(F.broadcast(sizes), "cell")
             .withColumn("c_block", _salt(key, F.col("c_blocks")))
             .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
             .select("grp", "c_block", "q_block", F.col(key).alias("id"), "embedding"))

    def search(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"_first": [], "neighbour_id": [], "distance": []})
        return _nearest_in_block(_matrix(q["embedding"]), q["id"].to_numpy(), _matrix(c["embedding"]), c["id"].to_numpy(), k)

    keys = ["grp", "c_block", "q_block"]
    pairs = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
        search, "_first LONG, neighbour_id LONG, distance DOUBLE")
    # The rank limit keeps only k rows per query and input partition before the shuffle.
    rank = F.row_number().over(Window.partitionBy("_first").orderBy("distance", "neighbour_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank")


def similar_threats(matches: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """``query_id, similar_threats ARRAY<STRUCT<distance,label>>``, nearest first."""
    known = labels.select(F.col(key).alias("neighbour_id"), "label")
    return matches.join(known, "neighbour_id").groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "distance", "label"))),
        lambda m: F.struct(m["distance"].alias("distance"), m["label"].alias("label"))).alias("similar_threats"))


def add(store: DataFrame, path: str) -> None:
    """Append vectors with labels to the neighbour store."""
    store.write.mode("append").parquet(path)
