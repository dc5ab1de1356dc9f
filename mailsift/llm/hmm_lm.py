"""Hidden Markov language model over words.

Frequent training words are symbols of their own, every other word shares the symbol of its class; a word of a class is
drawn by its training count. Baum-Welch runs over all training documents: each task adds up expected counts of its
documents, Spark sums them, the driver turns the sums into the next model, which has a fixed size. A text's score is the
exact log probability: the scaled forward recursion over its symbols plus the share of each word within its class.

Counts of all training words stay distributed. Only the ``FREQUENT`` commonest travel to the tasks; the remaining words
of the texts meet their counts in a join.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailsift.llm.common import batched, materialise, narrow

STATES = 4
ROUNDS = 3
FREQUENT = 200_000  # words whose counts every task holds
SYMBOLS = 16_384  # of these, words that are symbols of their own
CLASSES = 64  # symbols of all other words
WORD_BYTES = 64  # longer words are never among the frequent ones
SALTS = 32  # parts that the rows of a longer word are dealt to
BLOCK = 300_000  # tokens of the documents that run together
FLUSH = 400_000  # distinct words a task holds before it sends their counts
END = SYMBOLS + CLASSES
LOG10 = math.log(10)


def words_of(text: bytes) -> list[bytes]:
    """ASCII lower case, cut at ASCII white space: exactly what bytes methods do."""
    return text.lower().split()


def class_of(word: bytes) -> int:
    return SYMBOLS + zlib.crc32(word) % CLASSES


def word_counts(texts: DataFrame) -> DataFrame:
    """Counts of all words; tasks combine before they send."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                counts.update(words_of(text.as_py()))
                if len(counts) > FLUSH:
                    yield out()
                    counts.clear()
        yield out()
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Lexicon:
    """What tasks know of words: counts of the frequent ones, and totals of each class of the others."""

    counts: dict[bytes, int]
    symbols: dict[bytes, int]
    tokens: int  # N, with one end per training document
    distinct: int  # V, with the end
    ends: int
    class_total: np.ndarray  # tokens and distinct words of each class, plus one for words never met

    @classmethod
    def fit(cls, table: DataFrame, documents: int, frequent: int, symbols: int) -> Lexicon:
        level = F.floor(F.log2("n") * 16).cast("int")
        usable = table.filter(F.length("word") <= WORD_BYTES).withColumn("level", level)
        cut, room = 0, frequent
        for row in sorted(usable.groupBy("level").count().collect(), reverse=True):  # a few hundred levels
            room -= row["count"]
            if room < 0:
                cut = row["level"] + 1
                break
        top = usable.filter(F.col("level") >= cut).select("word", "n").collect()  # ``frequent`` rows at most
        counts = {bytes(r["word"]): r["n"] for r in sorted(top, key=lambda r: (-r["n"], r["word"]))}
        own = {word: i for i, word in enumerate(list(counts)[:symbols])}
        total = np.ones(CLASSES)
        all_n, all_v = 0, 0
        rows = table.groupBy(F.pmod(F.crc32("word"), F.lit(CLASSES)).alias("k")).agg(
            F.sum("n").alias("n"), F.count("*").alias("v")).collect()
        for r in rows:
            total[r["k"]] += r["n"] + r["v"]
            all_n, all_v = all_n + r["n"], all_v + r["v"]
        for word in own:
            total[class_of(word) - SYMBOLS] -= counts[word] + 1
        ends = documents
        return cls(counts, own, all_n + ends, all_v + (ends > 0), ends, total)

    def encode(self, words: list[bytes]) -> np.ndarray:
        get = self.symbols.get
        out = [get(word, -1) for word in words]
        codes = np.array([*out, END], np.int32)
        for i in np.flatnonzero(codes < 0).tolist():
            codes[i] = class_of(words[i])
        return codes


@dataclass
class Model:
    start: np.ndarray  # state
    move: np.ndarray  # state x next state
    emit: np.ndarray  # symbol x state

    @classmethod
    def seed(cls, lexicon: Lexicon, states: int) -> Model:
        """Training shares of the symbols, tilted by state in a fixed pseudo-random way."""
        share = np.full(END + 1, 0.5)
        for word, i in lexicon.symbols.items():
            share[i] += lexicon.counts[word]
        share[SYMBOLS:END] += lexicon.class_total
        share[END] += lexicon.ends
        rng = np.random.default_rng(7)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (END + 1, states))
        move = rng.uniform(0.5, 1.5, (states, states)) + np.eye(states)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def forward(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Scaled forward recursion over documents sorted by falling length.

        Steps hold the documents that still run, one after another: gives symbols by step, scaled states, scales,
        log likelihood of each document, and where each step starts.
        """
        sizes = np.array([len(c) for c in codes])
        steps = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(steps), side="left")  # documents longer than t
        at = np.concatenate([[0], np.cumsum(active)])
        flat = np.concatenate(codes)
        offset = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        step_of = np.repeat(np.arange(steps), active)
        symbols = flat[offset[np.arange(len(flat)) - at[step_of]] + step_of]
        seen = self.emit[symbols]
        alpha, scale = np.empty_like(seen), np.empty(len(seen))
        before = None
        bounds = at.tolist()
        for t in range(steps):
            a, b = bounds[t], bounds[t + 1]
            now = (before[:b - a] @ self.move if t else self.start) * seen[a:b]
            size = now.sum(axis=1)
            before = alpha[a:b] = now / size[:, None]
            scale[a:b] = size
        likely = np.bincount(np.arange(len(flat)) - at[step_of], np.log(scale), len(codes))
        return symbols, alpha, scale, likely, bounds

    def expected(self, codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of the documents."""
        symbols, alpha, scale, _, at = self.forward(codes)
        k = len(self.start)
        seen = self.emit[symbols] / scale[:, None]
        beta = np.ones_like(alpha)
        moves = np.zeros((k, k))
        for t in range(len(at) - 3, -1, -1):
            a, b, c = at[t], at[t + 1], at[t + 2]
            ahead = seen[b:c] * beta[b:c]
            beta[a:a + c - b] = ahead @ self.move.T
            moves += alpha[a:a + c - b].T @ ahead
        gamma = alpha * beta
        emitted = np.stack([np.bincount(symbols, gamma[:, s], END + 1) for s in range(k)], axis=1)
        return gamma[:at[1]].sum(axis=0), moves * self.move, emitted


def groups(lexicon: Lexicon, texts: list[bytes]) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Documents as symbols, longest first, in groups of about ``BLOCK`` tokens, with their places."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for part in batched(order, [1 + len(texts[i]) // 6 for i in order], BLOCK):
        codes = [lexicon.encode(words_of(texts[i])) for i in part]
        rank = sorted(range(len(part)), key=lambda j: -len(codes[j]))
        yield [part[j] for j in rank], [codes[j] for j in rank]


def baum_welch(texts: DataFrame, shared, model: Model, rounds: int) -> Model:
    """``rounds`` passes over all training texts."""
    k = len(model.start)
    fields = [f"s{i}" for i in range(k)]
    for _ in range(rounds):
        def run(batches: Iterator[pa.RecordBatch], model: Model = model) -> Iterator[pa.RecordBatch]:
            total = np.zeros((END + 2 + k, k))  # emissions, then starts, then moves
            for batch in batches:
                for _, codes in groups(shared.value, batch.column("text").to_pylist()):
                    start, moves, emitted = model.expected(codes)
                    total[:END + 1] += emitted
                    total[END + 1] += start
                    total[END + 2:] += moves
            rows = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.int32()), *[pa.array(total[rows, s]) for s in range(k)]], ["row", *fields])
        sums = texts.mapInArrow(run, "row int, " + ", ".join(f"{f} double" for f in fields)).groupBy("row").agg(
            *[F.sum(f).alias(f) for f in fields])
        total = np.zeros((END + 2 + k, k))
        for row in sums.collect():  # one row per symbol and state
            total[row["row"]] = row[1:]
        if not total.any():
            return model
        emit, start, move = total[:END + 1] + 1e-2 * model.emit, total[END + 1] + 1e-2, total[END + 2:] + 1e-2
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def rare_counts(rare: DataFrame, table: DataFrame) -> DataFrame:
    """Rows of words outside the frequent ones with the training count ``c`` of their word, if it has one.

    A word above ``WORD_BYTES`` may be in any share of the texts, such as a long link in a footer. The rows of such words
    are dealt over ``SALTS`` parts, and their counts go to every part; all other words are rarer than the frequent ones.
    """
    long = F.length("word") > WORD_BYTES
    dealt = rare.withColumn("part", F.when(long, F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)).cast("int")).otherwise(0))
    parts = F.when(long, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    counts = table.select("word", F.col("n").alias("c"), F.explode(parts).alias("part"))
    return dealt.join(counts, ["word", "part"])


def score_texts(docs: DataFrame, training: Column, states: int = STATES, rounds: int = ROUNDS,
                frequent: int = FREQUENT, symbols: int = SYMBOLS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of every document.

    Null and empty texts are one token, the end. Rows for which ``training`` is not true only get scores. Rows that
    repeat an id, or have none, are told apart by a 128-bit hash of the text: rows with equal id and text get
    equal scores. Without training rows N and V are 0, counts are 0 and the seed model scores. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"], F.coalesce(training, F.lit(False)).alias("teaches"),
                       F.coalesce(docs["text"], F.lit("")).cast("binary").alias("text"))
    teaching = rows.filter("teaches").select("text")
    table = materialise(word_counts(teaching), "word-counts")
    lexicon = Lexicon.fit(table, teaching.count(), frequent, min(symbols, SYMBOLS, frequent))
    shared = spark.sparkContext.broadcast(lexicon)  # ``frequent`` words of at most WORD_BYTES bytes
    model = baum_welch(teaching, shared, Model.seed(lexicon, states), rounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        log_class = np.log10(own.class_total)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            names, teaches = batch.column("doc_id").to_pylist(), batch.column("teaches").to_pylist()
            out, rare = [], []
            for places, codes in groups(own, texts):
                likely = model.forward(codes)[3] / LOG10
                for place, code, score in zip(places, codes, likely.tolist()):
                    words = words_of(texts[place])
                    counts = [own.counts.get(w, 0) for w in words]
                    known = np.array([*counts, own.ends], np.int64)
                    logs = np.log10(known + 1.0)
                    in_class = np.flatnonzero((code >= SYMBOLS) & (code < END))
                    score += (logs[in_class] - log_class[code[in_class] - SYMBOLS]).sum()
                    key = hashlib.blake2b(texts[place], digest_size=16).digest()
                    out.append((names[place], teaches[place], key, None, len(code), int((known > 0).sum()), logs.sum(), score))
                    rest = Counter(w for w, n in zip(words, counts) if not n)
                    rare += [(names[place], None, key, w, n, 0, 0.0, 0.0) for w, n in rest.items()]
                if len(rare) > FLUSH:
                    yield record(out + rare)
                    out, rare = [], []
            yield record(out + rare)

    def record(found: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        columns = list(zip(*found)) if found else [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], fields)

    fields = ["doc_id", "teaches", "key", "word", "n", "n_known", "logs", "score"]
    parts = materialise(rows.mapInArrow(
        run, "doc_id long, teaches boolean, key binary, word binary, n long, n_known long, logs double, score double"), "scores")
    rare = parts.filter("word IS NOT NULL").select("doc_id", "key", "word", "n")
    found = (rare_counts(rare, table)
             .select("doc_id", "key", "n", (F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"))
             .groupBy("doc_id", "key").agg(F.sum("n").alias("more_known"), F.sum("logs").alias("more_logs")))
    whole = parts.filter("word IS NULL")
    copies = whole.groupBy("doc_id", "key").agg(F.count("*").alias("copies"))
    found = found.join(copies, found["doc_id"].eqNullSafe(copies["doc_id"]) & (found["key"] == copies["key"])).select(
        found["doc_id"].alias("rare_id"), found["key"].alias("rare_key"),
        (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"),
        (F.col("more_logs") / F.col("copies")).alias("more_logs"))
    n, v = lexicon.tokens, lexicon.distinct
    each = math.log10(n + v + 1)
    return (whole.join(found, whole["doc_id"].eqNullSafe(found["rare_id"]) & (whole["key"] == found["rare_key"]), "left")
            .withColumns({"more_known": F.coalesce("more_known", F.lit(0)), "more_logs": F.coalesce("more_logs", F.lit(0.0))})
            .select("doc_id", (~F.col("teaches")).alias("held_out"), F.col("n").alias("n_tokens"),
                    (F.col("n_known") + F.col("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
                    (F.col("logs") + F.col("more_logs") - F.col("n") * each).alias("base_score"),
                    (F.col("score") + F.col("more_logs")).alias("score")))
