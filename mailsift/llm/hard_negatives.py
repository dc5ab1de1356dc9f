"""Hard negatives by a secondary sort: pairs packed into (anchor, descending score, kind, id) keys and read as a stream.

Rows and anchors meet in a grid of blocks of bounded size, each a matrix product. Before anything is shuffled, a block keeps
of every anchor only what can take part: its first positives and, once the positives of all blocks are known, the first
negatives inside each of their windows. Both are exact, since the first k of all rows are among the first k of the blocks.
The packed keys are then dealt by anchor and sorted within the partitions by the shuffle's sort (``repartition`` and
``sortWithinPartitions``, which spill); an iterator over the sorted keys opens a window with every positive and emits
negatives until the window is full or passed. It holds the open windows of one anchor, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import materialise

BLOCK_ROWS = 8192  # rows and anchors of a block; results are the same for every value
LEAST_ROWS = 1024  # blocks of a small table are at least as large
TILE = 256  # anchors of one matrix product

#: A packed key: anchor row, score from high to low, positive before negative, ids from low to high with null last, row.
KEY = np.dtype([("anchor", ">u8"), ("score", ">u8"), ("kind", "u1"), ("no_id", "u1"), ("id", ">u8"), ("row", ">u8")])
SIGN = np.uint64(1 << 63)
POSITIVE, NEGATIVE = 0, 1

PAIRS = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
RANGE = 1 << 63


def pack(anchor, score, kind, ids, no_id, row) -> np.ndarray:
    out = np.zeros(len(score), KEY)
    out["anchor"], out["kind"], out["no_id"], out["row"] = anchor, kind, no_id, row
    out["score"] = ~(score.view(np.uint64) ^ SIGN)
    out["id"] = np.where(no_id, 0, ids).astype(np.int64).view(np.uint64) ^ SIGN
    return out


def unpack(keys: pa.Array) -> tuple[list, ...]:
    """Anchor row, score, kind and id (None where it is null) of packed keys."""
    k = np.frombuffer(b"".join(keys.to_pylist()), KEY)
    score = ((~k["score"].astype(np.uint64)) ^ SIGN).view(np.int64).tolist()
    ids = (k["id"].astype(np.uint64) ^ SIGN).view(np.int64).tolist()
    ids = [None if gone else i for i, gone in zip(ids, k["no_id"].tolist())]
    return k["anchor"].tolist(), score, k["kind"].tolist(), ids


def window(score: int, low: int, high: int) -> tuple[int, int]:
    """Integer scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


class Block:
    """Columns of one side of a grid cell, rows in the order of their ids, null ids last."""

    def __init__(self, table: pa.Table, scale: int):
        table = table.combine_chunks()
        ids = table.column("id")
        self.no_id = ids.is_null().to_numpy()
        self.id = ids.fill_null(0).to_numpy()
        self.row = table.column("row").to_numpy()
        order = np.lexsort((self.row, self.id, self.no_id))
        self.id, self.no_id, self.row = self.id[order], self.no_id[order], self.row[order]
        self.label = table.column("label").to_numpy()[order]
        vectors = table.column("vector").combine_chunks()
        if isinstance(vectors, pa.ChunkedArray):
            vectors = pa.concat_arrays(vectors.chunks) if vectors.num_chunks else pa.array([], table.schema.field("vector").type)
        lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = np.asarray(vectors.flatten()).astype(np.float64)
        width = int(lengths.max(initial=0))
        self.units = np.zeros((len(lengths), width))
        self.units[np.arange(width) < lengths[:, None]] = np.floor(flat * scale)
        self.units = self.units[order]
        self.bounds = [[] for _ in order]
        if "windows" in table.column_names:
            given = table.column("windows").to_pylist()
            self.bounds = [given[i] or [] for i in order]

    def __len__(self):
        return len(self.row)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; the shorter vectors count as filled up with zeros, sums beyond a long as the nearest."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    if d * max(np.abs(a).max(initial=0), 1) * max(np.abs(b).max(initial=0), 1) < 2 ** 53:
        return (a @ b.T).astype(np.int64)
    exact = np.vectorize(int, otypes=[object])
    out = exact(a) @ exact(b).T
    return np.clip(out, -RANGE, RANGE - 1).astype(np.int64)


def first(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by place."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.argsort(-scores[places].astype(object) if len(places) and scores[places].min() == -RANGE
                             else -scores[places], kind="stable")][:k]


def _positives(k: int, scale: int):
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = Block(anchors, scale), Block(rows, scale)
        out = []
        for label in np.unique(a.label):
            own, same = np.flatnonzero(a.label == label), np.flatnonzero(r.label == label)
            for at in range(0, len(own), TILE):
                tile = own[at:at + TILE]
                for i, scores in zip(tile, products(a.units[tile], r.units[same])):
                    others = same[r.row[same] != a.row[i]]
                    scores = scores[r.row[same] != a.row[i]]
                    best = first(scores, k)
                    out += zip([int(a.row[i])] * len(best), scores[best].tolist(), r.id[others[best]].tolist(),
                               r.no_id[others[best]].tolist(), r.row[others[best]].tolist())
        names, types = ["anchor", "score", "id", "row"], [pa.int64()] * 4
        columns = list(zip(*((a, s, None if gone else i, row) for a, s, i, gone, row in out))) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=names)
    return run


def _candidates(k: int, low: int, high: int, scale: int):
    """Packed keys of a cell: the negatives that are among the first k of some window, and in one cell the positives."""
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        a, r = Block(anchors, scale), Block(rows, scale)
        keys, owners, ids = [], [], []

        def emit(i: int, packed: np.ndarray) -> None:
            keys.append(packed.tobytes())  # numpy would turn joined keys to its own byte order
            owners.append(np.full(len(packed), a.row[i]))
            ids.extend([None if a.no_id[i] else int(a.id[i])] * len(packed))

        if anchors.num_rows and anchors.column("r")[0].as_py() == 0:
            for i, own in enumerate(a.bounds):
                emit(i, pack(a.row[i], np.array([w["score"] for w in own], np.int64), POSITIVE,
                             np.array([w["id"] or 0 for w in own], np.int64), np.array([w["id"] is None for w in own], bool),
                             np.array([w["row"] for w in own], np.int64)))
        for at in range(0, len(a) if len(r) else 0, TILE):
            tile = np.arange(at, min(at + TILE, len(a)))
            for i, scores in zip(tile, products(a.units[tile], r.units)):
                wanted = [np.zeros(0, np.int64)]
                other = np.flatnonzero(r.label != a.label[i])
                own = scores[other]
                for least, most in {window(w["score"], low, high) for w in a.bounds[i]}:
                    inside = np.flatnonzero((own >= least) & (own <= most)) if least <= most else other[:0]
                    wanted.append(other[inside[first(own[inside], k)]])
                chosen = np.unique(np.concatenate(wanted))
                if len(chosen):
                    emit(i, pack(a.row[i], scores[chosen], NEGATIVE, r.id[chosen], r.no_id[chosen], r.row[chosen]))
        raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY.itemsize), len(ids), [None, pa.py_buffer(b"".join(keys))])
        return pa.table([pa.array(np.concatenate(owners) if owners else [], pa.int64()), pa.array(ids, pa.int64()),
                         raw.cast(pa.binary())], names=["anchor", "anchor_id", "key"])
    return run


def _stream(positives: int, negatives: int, low: int, high: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, opened, n_positives = None, [], 0
        for batch in batches:
            out = []
            for anchor, score, kind, row_id, anchor_id in zip(*unpack(batch.column("key")),
                                                              batch.column("anchor_id").to_pylist()):
                if anchor != current:
                    current, opened, n_positives = anchor, [], 0
                if kind == POSITIVE:
                    if n_positives < positives:
                        n_positives += 1
                        opened.append([row_id, score, *window(score, low, high), 0])
                    continue
                over = False
                for w in opened:
                    if w[2] <= score <= w[3] and w[4] < negatives:
                        w[4] += 1
                        out.append((anchor_id, w[0], w[4], row_id, w[1], score))
                    over |= score < w[2] or w[4] == negatives
                if over:
                    opened = [w for w in opened if score >= w[2] and w[4] < negatives]
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                 names=[x.split(" ")[0] for x in PAIRS.split(", ")])
    return run


def usable(vectors: DataFrame, vector_id: str, vector: str, label: str) -> DataFrame:
    """Rows with a label and a vector of finite components only, as ``id, vector, label``."""
    rows = vectors.select(vectors[vector_id].cast("long").alias("id"), vectors[vector].alias("vector"),
                          vectors[label].cast("long").alias("label"))
    broken = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~broken)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """For each anchor and each of its first positives, the first negatives whose score lies in the positive's window.

    ``rows`` has ``id, vector, label`` without null labels or components (``usable``). A component x counts as
    floor(scale * x), a row's score is its integer inner product with the anchor; higher scores come first, ties
    by smaller id, null ids last. Positives are other rows of the anchor's label, negatives rows of another label
    with low * p <= 100 * s <= high * p. Rows that share an id are rows of their own, and so are anchors. Vectors of
    different lengths count as filled up with zeros. Positives below zero have an empty window.
    An empty table, or one without anchors, gives no rows.
    """
    spark = rows.sparkSession
    kept = materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector", "label",
                                   F.coalesce(is_anchor, F.lit(False)).alias("is_anchor")), "mined-rows")
    n, n_anchors = kept.agg(F.count("*"), F.count_if("is_anchor")).first()
    cores = spark.sparkContext.defaultParallelism
    n_rows = max(-(-n // block_rows), min(2 * cores, -(-n // LEAST_ROWS)), 1)
    n_tall = max(-(-n_anchors // block_rows), 1)
    n_cells = n_rows * n_tall

    def side(df: DataFrame, own: int, other: int, by_row: bool) -> DataFrame:
        """Every block of a side once for each block of the other."""
        block = F.pmod(F.xxhash64("row"), F.lit(own))
        df = df.withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
        r, a = ("_own", "_other") if by_row else ("_other", "_own")
        df = df.withColumn("cell", F.col(a) * n_rows + F.col(r)).withColumnRenamed(r, "r").drop(a)
        renewed = df.select(*[F.col(c).alias(c) for c in df.columns])  # both sides come from one table
        return renewed.repartition(min(n_cells, 4096), "cell")

    columns = ["row", "id", "vector", "label"]
    right = side(kept.select(*columns), n_rows, n_tall, True).groupBy("cell")
    anchors = kept.filter("is_anchor").select(*columns)
    found = side(anchors, n_tall, n_rows, False).groupBy("cell").cogroup(right).applyInArrow(
        _positives(positives, scale), "anchor long, score long, id long, row long")
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    nearest = found.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= positives)
    windows = nearest.groupBy("anchor").agg(F.collect_list(F.struct("score", "id", "row")).alias("windows"))
    windows = materialise(windows, "mined-windows")
    with_windows = anchors.join(windows, anchors["row"] == windows["anchor"]).drop("anchor")
    keys = side(with_windows, n_tall, n_rows, False).groupBy("cell").cogroup(right).applyInArrow(
        _candidates(negatives, low, high, scale), "anchor long, anchor_id long, key binary")
    dealt = keys.repartition("anchor").sortWithinPartitions("key").select("anchor_id", "key")
    return dealt.mapInArrow(_stream(positives, negatives, low, high), PAIRS)
