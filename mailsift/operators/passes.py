"""Iterative fits as passes over blocks of rows, many fits advancing together.

Training rows are binned once and kept as column-wise blocks. A job asks a question of all rows, every block answers for its own,
the answers are added up over the blocks, and the job goes on from the sum: gradients of linear models, split
statistics of trees, counts of naive Bayes. All jobs of a search - draws, folds, members of an ensemble - ask in the same pass, so
that their number costs work but no further passes, up to the bytes that the driver may hold of them. Statistics of trees are added up
by node and range of features, and only the best split of each goes to the driver. Rows that fit into one block are asked where they lie: the jobs are
dealt to the tasks, each beside a copy of the block, and ask without going back to the driver. Both ways give the same fits.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailsift.session import materialise

BLOCK_ROWS = 4096
MAX_BINS = 255
CHECKPOINT_EVERY = 5  # refreshed states between two checkpoints
DRIVER_BYTES = 256_000_000  # of the jobs that advance together over several blocks


@dataclass
class Block:
    """Some rows: ``target``, ``tags`` (numbers of folds), and their non-zero entries in order of feature and value.

    ``bin`` counts from 1 in the order of a feature's values; zero, which has no entries, is bin 0. ``start[f]`` is the
    place of a feature's first entry.
    """

    target: np.ndarray
    number: np.ndarray  # of the row, the same in every layout
    tags: dict[str, np.ndarray]
    row: np.ndarray
    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray
    n_features: int
    start: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    state: dict[int, Any] = field(default_factory=dict)

    def __post_init__(self):
        if not len(self.start):
            self.start = np.searchsorted(self.feature, np.arange(self.n_features + 1))

    def __len__(self):
        return len(self.target)

    def rows_in(self, without: list[tuple[str, int]]) -> np.ndarray:
        """Rows outside the given folds."""
        kept = np.ones(len(self), bool)
        for tag, value in without:
            kept &= self.tags[tag] != value
        return kept

    def product(self, weights: np.ndarray) -> np.ndarray:
        """Inner product of every row with ``weights``."""
        return np.bincount(self.row, self.value * weights[self.feature], len(self))

    def combined(self, factors: np.ndarray) -> np.ndarray:
        """Sum of the rows times their factors, by feature."""
        return np.bincount(self.feature, self.value * factors[self.row], self.n_features)


class Job:
    """A fit in passes. ``id`` is its place among the jobs of a run."""

    id = 0
    whole = False  # set where one block holds all rows
    binned = False  # asks for bins

    def request(self, width: int) -> Any:
        """The next question, None when the fit is complete; ``width`` says how many splits may be tried ahead."""
        raise NotImplementedError

    def answer(self, block: Block, request: Any) -> Any:
        """The block's part of the answer; addable by ``merge``."""
        raise NotImplementedError

    @staticmethod
    def merge(a: Any, b: Any) -> Any:
        return a + b

    def parts(self, answer: Any, block: Block) -> list[tuple[Any, Any]]:
        """An answer as parts that are added up apart from each other, each with a key; every block gives all of them."""
        return [(None, answer)]

    def digest(self, total: Any) -> Any:
        """What the driver needs of the sum of a part; taken where the sum is."""
        return total

    def joined(self, digests: list[tuple[Any, Any]]) -> Any:
        """The digests of all parts, with their keys, as ``receive`` takes them."""
        return digests[0][1]

    def weight(self, n_rows: int) -> int:
        """Bytes that the job holds at the driver, about and at most."""
        return 0

    def receive(self, total: Any) -> None:
        raise NotImplementedError

    def result(self) -> Any:
        raise NotImplementedError

    def light(self) -> Job:
        """A copy that can answer and absorb, without what only the driver needs."""
        return self

    def to_absorb(self, at_once: bool) -> Any:
        """What blocks should add to their state now, None for nothing."""
        return None

    def absorb(self, block: Block, what: Any) -> None:
        raise NotImplementedError

    def absorbed(self) -> None:
        """Called when all blocks have."""


@dataclass
class Blocks:
    """A table of blocks, one per row, and the upper bounds of the bins."""

    table: DataFrame
    cuts: DataFrame | None  # feature, cuts; None where rows are not binned
    n_blocks: int
    n_rows: int
    n_features: int

    def thresholds(self, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], float]:
        """Values behind (feature, bin)."""
        wanted = sorted(p for p in pairs if p[1] > 0)
        out = {p: 0.0 for p in pairs if p[1] == 0}
        if wanted:
            asked = self.table.sparkSession.createDataFrame(wanted, "feature int, bin int")
            found = self.cuts.join(F.broadcast(asked), "feature").select("feature", "bin", F.get("cuts", F.col("bin") - 1).alias("t"))
            out |= {(r["feature"], r["bin"]): r["t"] for r in found.collect()}
        return out


def _below(cuts: str, rows: DataFrame) -> DataFrame:
    """Adds ``bin``, one more than the number of sorted ``cuts`` below ``value``: a step of a binary search per projection."""
    rows = rows.withColumn("bin", F.lit(0))
    for step in (128, 64, 32, 16, 8, 4, 2, 1):
        higher = F.get(cuts, F.col("bin") + (step - 1)) < F.col("value")
        rows = rows.withColumn("bin", F.when(higher, F.col("bin") + step).otherwise(F.col("bin")))
    return rows.withColumn("bin", F.col("bin") + 1)


def build(rows: DataFrame, target: str, tags: dict[str, Column], features: str = "features",
          block_rows: int = BLOCK_ROWS, bins: bool = True) -> Blocks:
    """Blocks of about ``block_rows`` rows from a vector column without negative values.

    A feature's bins are the ranges between up to 254 quantiles of its non-zero values, found once over all rows. Only trees
    ask for them; without, all are 0 and rows go into their blocks without being taken apart.
    """
    v = F.unwrap_udt(features)
    base = materialise(rows.select(
        F.monotonically_increasing_id().alias("row"), F.col(target).cast("double").alias("target"),
        *[c.cast("int").alias(f"tag_{name}") for name, c in tags.items()],
        F.coalesce(v["size"], F.size(v["values"])).alias("size"), v["values"].alias("values"),
        F.coalesce(v["indices"], F.sequence(F.lit(0), F.size(v["values"]) - 1)).alias("indices")), "fit-rows")
    n, size, lowest = base.agg(F.count("*"), F.max("size"), F.min(F.array_min("values"))).first()
    if (lowest or 0) < 0:
        raise ValueError("features must not be negative")
    cuts, zipped = None, F.arrays_zip(F.col("indices").alias("feature"), F.col("values").alias("value"))
    if bins:
        entries = base.select("row", F.inline(zipped)).filter("value <> 0")
        quantiles = [k / MAX_BINS for k in range(1, MAX_BINS)]
        cuts = materialise(entries.groupBy("feature").agg(
            F.array_sort(F.array_distinct(F.percentile_approx("value", quantiles, 2000))).alias("cuts")), "fit-cuts")
        binned = _below("cuts", entries.join(cuts, "feature")).select("row", F.struct("feature", "bin", "value").alias("entry"))
        whole = base.drop("indices", "values", "size").join(
            binned.groupBy("row").agg(F.collect_list("entry").alias("entries")), "row", "left")
    else:
        known = F.transform(F.filter(zipped, lambda e: e["value"] != 0), lambda e: F.struct(
            e["feature"].alias("feature"), F.lit(0).alias("bin"), e["value"].alias("value")))
        whole = base.withColumn("entries", known).drop("indices", "values", "size")
    n_blocks = max(-(-n // block_rows), 1)
    names = list(tags)
    packed = whole.repartition(n_blocks, "row").mapInArrow(_packer(names, size or 1), "block binary")
    table = materialise(packed, "fit-blocks")
    return Blocks(table, cuts, table.count(), n, size or 1)


def _packer(tags: list[str], size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts).combine_chunks()
        lists = rows.column("entries").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = lists.flatten()
        feature, bins, value = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        row = np.repeat(np.arange(len(lengths)), lengths)
        order = np.lexsort((row, value, feature))
        block = Block(rows.column("target").to_numpy(), rows.column("row").to_numpy(),
                      {t: rows.column(f"tag_{t}").to_numpy() for t in tags}, row[order].astype(np.int32),
                      feature[order].astype(np.int32), bins[order].astype(np.int16), value[order].astype(np.float64), size)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(block)], pa.binary())], names=["block"])
    return run


def _finish(block: Block, jobs: list[Job]) -> list[tuple[int, Any]]:
    """Complete jobs beside the only block."""
    out = []
    for job in jobs:
        job.whole = True
        while (request := job.request(1)) is not None:
            job.receive(job.joined([(k, job.digest(v)) for k, v in job.parts(job.answer(block, request), block)]))
            if (what := job.to_absorb(True)) is not None:
                job.absorb(block, what)
                job.absorbed()
        block.state.pop(job.id, None)
        out.append((job.id, job.result()))
    return out


def run(blocks: Blocks, jobs: list[Job], width: int = 8) -> list[Any]:
    """Results of all jobs, in their order."""
    sc = blocks.table.sparkSession.sparkContext
    for i, job in enumerate(jobs):
        job.id = i
    loaded = blocks.table.rdd.map(lambda r: bytes(r[0]))
    if blocks.n_blocks <= 1:
        groups = max(min(len(jobs), 2 * sc.defaultParallelism), 1)
        dealt = [pickle.dumps(jobs[g::groups]) for g in range(groups)]
        copies = loaded.flatMap(lambda b: [(g, b) for g in range(len(dealt))]).partitionBy(groups, lambda g: g)
        done = dict(copies.flatMap(lambda x: _finish(pickle.loads(x[1]), pickle.loads(dealt[x[0]]))).collect())
        return [done[i] for i in range(len(jobs))]
    from pyspark import StorageLevel
    if sc.getCheckpointDir() is None:
        from mailsift.session import scratch_path
        sc.setCheckpointDir(scratch_path(blocks.table.sparkSession, "fit-states"))
    trees = any(job.binned for job in jobs)
    # Answers of linear models are as long as the vocabulary: they are added up beside the blocks of a task before they go on.
    rdd = (loaded if trees else loaded.coalesce(sc.defaultParallelism)).map(pickle.loads)
    if trees:
        counts = sc.broadcast(rdd.map(lambda b: np.diff(b.start)).treeReduce(np.add))
        rdd = rdd.map(lambda b: replace(b, state={"counts": counts.value}))
    rdd = rdd.persist(StorageLevel.MEMORY_AND_DISK)
    n_parts = max(sc.defaultParallelism, blocks.n_blocks) if trees else sc.defaultParallelism
    refreshed, waiting, active, done = 0, list(jobs), [], {}
    while True:
        asked = []
        for job in active:
            if (request := job.request(width)) is not None:
                asked.append((job, request))
            else:
                done[job.id] = job.result()
        active = [job for job, _ in asked]
        while waiting and (not active or sum(job.weight(blocks.n_rows) for job in [*active, waiting[0]]) <= DRIVER_BYTES):
            job = waiting.pop(0)
            asked.append((job, job.request(width)))
            active.append(job)
        if not asked:
            break
        questions = sc.broadcast({job.id: (job.light(), request) for job, request in asked})

        def answers(block: Block, questions=questions) -> Iterator[tuple]:
            for i, (job, request) in questions.value.items():
                for part, answer in job.parts(job.answer(block, request), block):
                    yield (i, part), (i, answer)

        def added(x: tuple, y: tuple, questions=questions) -> tuple:
            return x[0], questions.value[x[0]][0].merge(x[1], y[1])

        def digested(x: tuple, questions=questions) -> tuple:
            (i, part), (_, total) = x
            return i, (part, questions.value[i][0].digest(total))
        told_by: dict[int, list] = {}
        for i, digest in rdd.flatMap(answers).reduceByKey(added, n_parts).map(digested).collect():
            told_by.setdefault(i, []).append(digest)
        for i, digests in told_by.items():
            jobs[i].receive(jobs[i].joined(digests))
        questions.unpersist()
        news = [(job, what) for job in active if (what := job.to_absorb(False)) is not None]
        if news:
            told = sc.broadcast([(job.light(), what) for job, what in news])

            def absorb(block: Block, told=told) -> Block:
                for job, what in told.value:
                    job.absorb(block, what)
                return block
            fresh = rdd.map(absorb).persist(StorageLevel.MEMORY_AND_DISK)
            refreshed += 1
            if refreshed % CHECKPOINT_EVERY == 0:
                fresh.checkpoint()
            fresh.count()
            rdd.unpersist()
            rdd = fresh
            for job, _ in news:
                job.absorbed()
    rdd.unpersist()
    return [done[i] for i in range(len(jobs))]
