"""Conversation structure repair by generalised LR parsing with weighted edits.

The order of roles is a grammar: an optional system message, then one or more pairs of user and assistant. A conversation
is read message by message on a graph-structured stack. Stacks share the nodes below their tops; every message is kept,
given another role or deleted, messages can be inserted anywhere, and stacks with the same top are merged into the
one of least ``(cost, audit)``, where the audit is the string of the edits' initials.

Conversations are streamed: rows are hashed to tasks by conversation and sorted there by turn, so that a task holds the few
stack tops and the messages about which these still differ, never a conversation. One conversation is one sequence and stays
in one task, whatever its length; its rows are read once, in order.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailsift.llm.common import narrow

# --- fixed values: grammar of role initials, costs of the edits, damage rule ---------
GRAMMAR = [("S", ""), ("S", "T"), ("S", "sT"), ("T", "P"), ("T", "TP"), ("P", "ua")]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
DAMAGES = 20
WHITE = " \t\n\x0b\x0c\r"
SENTENCE_END = ".!?"

COMMIT_EVERY = 64  # messages between two looks for edits that all stack tops share
FLUSH_ROWS, FLUSH_CHARS = 4096, 4 << 20

END = "$"


class Table:
    """SLR actions of a grammar: ``action[state][terminal]`` is a rule to reduce by, or the state to shift to."""

    def __init__(self, grammar: list[tuple[str, str]]):
        self.rules = [("", grammar[0][0]), *grammar]
        heads = {h for h, _ in grammar}
        self.follow = self._follow(heads)
        start = self._closure({(0, 0)})
        states, self.goto = [start], [{}]
        for i, items in enumerate(states):
            for x in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                moved = self._closure({(r, d + 1) for r, d in items if self.rules[r][1][d:d + 1] == x})
                if moved not in states:
                    states.append(moved)
                    self.goto.append({})
                self.goto[i][x] = states.index(moved)
        self.reduce: list[dict[str, int]] = []
        for items in states:
            done = [r for r, d in items if d == len(self.rules[r][1])]
            chosen = {t: r for r in done for t in (self.follow[self.rules[r][0]] if r else {END})}
            if sum(len(self.follow[self.rules[r][0]]) if r else 1 for r in done) != len(chosen):
                raise ValueError("the grammar needs more than one symbol of lookahead")
            self.reduce.append(chosen)
        # A state that can only reduce by one rule does so at once, which lets more stacks meet.
        self.at_once = [next(iter(set(c.values()))) if len(set(c.values())) == 1 and not g and 0 not in c.values() else None
                        for c, g in zip(self.reduce, self.goto)]

    def _closure(self, items: set) -> frozenset:
        todo, out = list(items), set(items)
        while todo:
            r, d = todo.pop()
            head = self.rules[r][1][d:d + 1]
            for new in [(k, 0) for k, (h, _) in enumerate(self.rules) if k and h == head]:
                if new not in out:
                    out.add(new)
                    todo.append(new)
        return frozenset(out)

    def _follow(self, heads: set[str]) -> dict[str, set[str]]:
        """Terminals after each head; the only head with an empty body is the start symbol, which stands in no body."""
        first = {h: set() for h in heads}
        follow = {h: set() for h in heads} | {self.rules[0][1]: {END}}
        for _ in range(len(self.rules) ** 2):
            for h, body in self.rules[1:]:
                if body:
                    first[h] |= first.get(body[0], {body[0]})
                for k, x in enumerate(body):
                    if x in heads:
                        follow[x] |= first.get(body[k + 1], {body[k + 1]}) if k + 1 < len(body) else follow[h]
        return follow


class Graph:
    """Graph-structured stack: nodes ``(state, node below)`` that exist once, and the moves between them."""

    def __init__(self, table: Table):
        self.table = table
        self.nodes: list[tuple[int, int]] = []  # state, number of the node below
        self.numbers: dict[tuple[int, int], int] = {}
        self.moves: dict[tuple[int, str], int | None] = {}
        self.root = self.node(0, -1)

    def node(self, state: int, below: int) -> int:
        if (state, below) not in self.numbers:
            self.numbers[state, below] = len(self.nodes)
            self.nodes.append((state, below))
        return self.numbers[state, below]

    def _reduced(self, top: int, rule: int) -> int:
        head, body = self.table.rules[rule]
        for _ in body:
            top = self.nodes[top][1]
        return self.node(self.table.goto[self.nodes[top][0]][head], top)

    def move(self, top: int, symbol: str) -> int | None:
        """The top after reading a terminal, reductions included; None where the grammar forbids it."""
        if (top, symbol) not in self.moves:
            at: int | None = top
            while (rule := self.table.reduce[self.nodes[at][0]].get(symbol)) is not None and rule:
                at = self._reduced(at, rule)
            if symbol == END:
                at = at if rule == 0 else None
            else:
                to = self.table.goto[self.nodes[at][0]].get(symbol)
                at = None if to is None else self.node(to, at)
                while at is not None and (rule := self.table.at_once[self.nodes[at][0]]):
                    at = self._reduced(at, rule)
            self.moves[top, symbol] = at
        return self.moves[top, symbol]


class Repair:
    """Reads the messages of one conversation in order and hands out repaired ones as soon as they are certain.

    Audits of equal cost that end in the same top never are prefixes of each other, since one more insertion costs
    more, so the least audit stays the least whatever follows.
    """

    def __init__(self, graph: Graph):
        self.graph = graph
        self.tops: dict[int, tuple[int, str]] = {}
        self.waiting: list[tuple[str, str]] = []
        self.audit: list[str] = []
        self.n_out = self.n_paired = self.since = 0
        self._settle({graph.root: (0, "")})

    def _settle(self, tops: dict[int, tuple[int, str]]) -> None:
        """Insertions before the next message."""
        todo = list(tops)
        while todo:
            top = todo.pop()
            cost, audit = tops[top]
            for symbol in ROLES:
                to = self.graph.move(top, symbol)
                if to is not None:
                    new = (cost + INSERT, audit + "I")
                    if to not in tops or new < tops[to]:
                        tops[to] = new
                        todo.append(to)
        self.tops = tops

    def read(self, role: str, text: str, doomed: bool, truncated: bool) -> list[tuple[int, str, str, str]]:
        tops: dict[int, tuple[int, str]] = {}

        def offer(top: int | None, cost: int, audit: str) -> None:
            if top is not None and (top not in tops or (cost, audit) < tops[top]):
                tops[top] = (cost, audit)

        initial, extra = role[:1], TRUNCATED if truncated else 0
        for top, (cost, audit) in self.tops.items():
            offer(top, cost + DELETE, audit + "D")
            if not doomed:
                if initial:
                    offer(self.graph.move(top, initial), cost + KEEP + extra, audit + "K")
                for symbol in ROLES:
                    offer(self.graph.move(top, symbol), cost + REROLE + extra, audit + "R")
        self._settle(tops)
        self.waiting.append((role, text))
        self.since += 1
        if self.since < COMMIT_EVERY:
            return []
        self.since = 0
        shared = os.path.commonprefix([audit for _, audit in self.tops.values()])
        self.tops = {top: (cost, audit[len(shared):]) for top, (cost, audit) in self.tops.items()}
        return self._apply(shared)

    def _apply(self, edits: str) -> list[tuple[int, str, str, str]]:
        out, at = [], 0
        for edit in edits:
            role, text = ("", "")
            if edit != "I":
                role, text = self.waiting[at]
                at += 1
            if edit == "D":
                continue
            paired = edit != "K" or role[:1] in ROLES
            if edit != "K":
                role = list(ROLES.values())[self.n_paired % 2]
            self.n_paired += paired
            out.append((self.n_out, edit, role, text))
            self.n_out += 1
        del self.waiting[:at]
        self.audit.append(edits)
        return out

    def end(self) -> tuple[int, str, list[tuple[int, str, str, str]]]:
        cost, edits = min(best for top, best in self.tops.items() if self.graph.move(top, END) is not None)
        out = self._apply(edits)
        return cost, "".join(self.audit), out


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
LEGAL = {"su", "ua", "au"}


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    graph, names, rows, size = Graph(Table(GRAMMAR)), None, [], 0
    job = conv = None

    def close() -> None:
        nonlocal job
        if job is not None:
            cost, audit, out = job.repair.end()
            rows.extend((conv, *o, None) for o in out)
            rows.append((conv, None, None, None, None, job.summary(cost, audit)))
            job = None

    def flush() -> pa.RecordBatch:
        nonlocal rows, size
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
        rows, size = [], 0
        return batch

    for batch in batches:
        if names is None:
            names = ["conv_id", "seq", "edit", "role", "text", "summary"]
            counts = [pa.field(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
            types = [batch.schema.field("conv_id").type, pa.int64(), pa.string(), pa.string(), pa.string(),
                     pa.struct([*counts, pa.field("audit", pa.string())])]
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped", "fault")]
        for conv_id, turn, role, text, dropped, fault in zip(*columns):
            if job is None or conv_id != conv:
                close()
                job, conv = _Job(graph), conv_id
            if not dropped:
                done = job.read(turn, role, text, fault)
                rows.extend((conv, *o, None) for o in done)
                size += len(text)
            if len(rows) >= FLUSH_ROWS or size >= FLUSH_CHARS and rows:
                yield flush()
    close()
    if rows:
        yield flush()


class _Job:
    """Repair and counts of the conversation being read."""

    def __init__(self, graph: Graph):
        self.repair = Repair(graph)
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.first = self.last = None
        self.n_turns = self.illegal = 0
        self.initial: str | None = None

    def read(self, turn, role: str, text: str, fault: str | None):
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.n_turns += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        return self.repair.read(role, text, fault in ("blank", "duplicate"), fault == "truncated")

    def summary(self, cost: int, audit: str) -> dict:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.n_turns
        return {"gaps": gaps, **self.counts, "illegal": self.illegal, "cost": cost, "audit": audit}


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, dropped``: rows lost, emptied, cut, repeated or given to the user by a fixed rule.

    Null roles and texts become one space. A lost row stays as ``dropped``, so that its conversation stays known.
    """
    rows = narrow(conversations, "conv_id", "turn", "role", "text")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.withColumn("_k", F.crc32(key.cast("binary")) % DAMAGES)
    k, text = F.col("_k"), F.coalesce("text", F.lit(" "))
    copies = F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate(text, SENTENCE_END, "")).otherwise(text).alias("text"),
        (k == 0).alias("dropped"), F.explode(copies).alias("_copy")).drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """Repaired messages of conversations: ``conv_id, seq, edit, role, text, summary``.

    ``rows`` has ``conv_id, turn, role, text`` and, if wanted, ``dropped`` for rows that only make their conversation known.
    Messages are read by turn (nulls first, then role and text). A message is blank without a character other than white
    space, else duplicate when its role and text came before, else truncated when it doesn't end a sentence. Blank and
    duplicate ones are deleted. Every conversation ends with one row that has a ``summary`` of counts, cost and audit and no
    ``seq``; it follows the messages in the same partition. Null roles and texts count as one space; null conversation
    ids form one conversation; a message whose role has no initial of the grammar is given another role or deleted.
    An empty table gives no rows, further columns are ignored.
    """
    dropped = F.coalesce(F.col("dropped"), F.lit(False)) if "dropped" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"))
    # One shuffle: the window over copies of a message and the order of turns keep the hash partitions.
    dealt = rows.repartition("conv_id")
    order = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    dealt = dealt.withColumn("_nth", F.row_number().over(order))
    rest = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(F.length(rest) == 0, "blank").when(F.col("_nth") > 1, "duplicate").when(
        ~F.contains(F.lit(SENTENCE_END), F.right(rest, F.lit(1))), "truncated")
    dealt = dealt.withColumn("fault", fault).drop("_nth").sortWithinPartitions(
        F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text")
    kind = dict(rows.dtypes)["conv_id"]
    return dealt.mapInArrow(
        _repaired, f"conv_id {kind}, seq long, edit string, role string, text string, summary struct<{_fields(SUMMARY)}>")


def _fields(ddl: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ") for f in ddl.split(", ")))


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    running, started = hashlib.sha256(), False
    for batch in batches:
        done, hashes = [], []
        seqs, roles, texts = (batch.column(c).to_pylist() for c in ("seq", "role", "text"))
        for i, (seq, role, text) in enumerate(zip(seqs, roles, texts)):
            if seq is None:
                done.append(i)
                hashes.append(running.hexdigest())
                running, started = hashlib.sha256(), False
                continue
            running.update((("\n" if started else "") + role + ":" + text).encode())
            started = True
        if done:
            kept = batch.take(pa.array(done))
            summary = kept.column("summary")
            yield pa.RecordBatch.from_arrays(
                [kept.column("conv_id"), *summary.flatten(), pa.array(hashes)],
                names=["conv_id", *[f.name for f in summary.type], "repaired_sha256"])


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``: counts, cost, audit and the hash of ``role:text`` lines.

    Reads the partitions of ``repair`` in their order, so the operator must be its direct input.
    """
    kind = dict(repaired.dtypes)["conv_id"]
    return repaired.mapInArrow(_digests, f"conv_id {kind}, {SUMMARY}, repaired_sha256 string")
