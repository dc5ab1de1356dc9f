"""Conversation repair against enumeration of all edits and against a plain automaton."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import pytest

from mailsift.llm import glr_repair as G

COLUMNS = "conv_id long, turn long, role string, text string, seq long, edit string, summary string, dropped boolean"
WS = r"[^\x20\x09-\x0D]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        marks = re.findall(WS, text)
        out.append("blank" if not marks else "duplicate" if (role, text) in seen else
                   "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def automaton(rows, faulty):
    """Least (cost, audit, roles) by states of the role order: nothing, system, user, assistant."""
    def settle(best):
        for _ in range(3):
            for (state, (cost, audit, lines)) in list(best.items()):
                for c in "ua":
                    to = STEP.get((state, c))
                    if to is not None:
                        new = (cost + 2, audit + "I", [*lines, (G.ROLES[c], "")])
                        best[to] = min(best.get(to, new), new)
        return best
    best = settle({0: (0, "", [])})
    for (_, _, role, text), fault in zip(rows, faulty):
        new = {}

        def put(to, value):
            if to is not None:
                new[to] = min(new.get(to, value), value)
        for state, (cost, audit, lines) in best.items():
            put(state, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                put(STEP.get((state, role[:1])), (cost + more, audit + "K", [*lines, (role, text)]))
                for c in "ua":
                    put(STEP.get((state, c)), (cost + 2 + more, audit + "R", [*lines, (G.ROLES[c], text)]))
        best = settle(new)
    return min(best[s] for s in (0, 3) if s in best)


def enumerated(rows, faulty):
    """The same by trying every edit of every message with at most three insertions."""
    found = []
    def walk(i, initials, cost, audit, inserts):
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            found.append((cost, audit))
        if inserts < 3:
            for c in "ua":
                walk(i, initials + c, cost + 2, audit + "I", inserts + 1)
        if i == len(rows):
            return
        walk(i + 1, initials, cost + 3, audit + "D", inserts)
        if faulty[i] not in ("blank", "duplicate"):
            more = faulty[i] == "truncated"
            walk(i + 1, initials + rows[i][2][:1], cost + more, audit + "K", inserts)
            for c in "ua":
                walk(i + 1, initials + c, cost + 2 + more, audit + "R", inserts)
    walk(0, "", 0, "", 0)
    return min(found)


def by_turn(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))


def expected(rows):
    convs = collections.defaultdict(list)
    for r in rows:
        convs[r[0]]
    for r in damaged(rows):
        convs[r[0]].append(r)
    out = []
    for conv, own in convs.items():
        own = by_turn(own)
        f = faults(own)
        turns = [t for _, t, _, _ in own if t is not None]
        cost, audit, lines = automaton(own, f)
        text = "\n".join(f"{role}:{t}" for role, t in lines)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, f.count("blank"), f.count("duplicate"),
                    f.count("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return collections.Counter(out)


def sample(n, seed):
    rng = random.Random(seed)
    texts = ["Hello.", "What?", "Fine!", "cut off", "", " \t\n", "é.", "ok. \n", None, "x" * 3000 + "."]
    out = []
    for conv in range(n):
        turn = rng.choice([0, 0, 3])
        for _ in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant"] * 5 + ["system", "tool", "", None])
            out.append((rng.choice([conv] * 30 + [None]), rng.choice([turn] * 20 + [None]), role,
                        rng.choice(texts) if rng.random() < .4 else f"text {rng.random()}."))
            turn += rng.choice([1, 1, 1, 1, 2, 0])
    # One very long conversation, with stretches that are out of order.
    for turn in range(1500):
        role = ["user", "assistant"][turn % 2] if rng.random() < .9 else rng.choice(["user", "assistant", "system"])
        out.append((10 ** 6, turn, role, f"turn {turn}" + rng.choice([".", ".", ""])))
    return out


def queried(spark, rows, schema="conv_id long, turn long, role string, text string"):
    df = spark.createDataFrame(rows, schema)
    return collections.Counter(map(tuple, G.digests(G.repair(G.damage(df))).collect()))


def test_automaton_equals_enumeration():
    rng = random.Random(3)
    for _ in range(150):
        rows = [(0, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b.", "c", "", "d."]))
                for i in range(rng.randrange(0, 5))]
        assert automaton(rows, faults(rows))[:2] == enumerated(rows, faults(rows))


def test_repair_equals_brute_force(spark):
    rows = sample(300, 1)
    assert queried(spark, rows) == expected(rows)


def test_clashing_columns_and_repeated_rows(spark):
    rows = [(1, 0, "user", "a."), (1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 5, None, None), (3, None, "system", "s.")]
    wide = [(*r, 7, "K", "s", False) for r in rows]
    assert queried(spark, wide, COLUMNS) == expected(rows)


def test_empty(spark):
    assert queried(spark, []) == collections.Counter()


def test_messages_and_dropped_rows(spark):
    rows = [(1, 0, "system", "Be kind.", None), (1, 1, "assistant", "Hi.", None), (2, 0, "user", "gone.", True)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, dropped boolean")
    got = G.repair(df).collect()
    assert [(r["seq"], r["edit"], r["role"], r["text"]) for r in got if r["conv_id"] == 1 and r["seq"] is not None] == [
        (0, "K", "system", "Be kind."), (1, "I", "user", ""), (2, "K", "assistant", "Hi.")]
    ends = {r["conv_id"]: r["summary"] for r in got if r["seq"] is None}
    assert ends[1]["cost"] == 2 and ends[1]["audit"] == "KIK" and ends[2]["audit"] == "" and ends[2]["cost"] == 0


def test_another_grammar_is_refused_when_ambiguous():
    with pytest.raises(ValueError):
        G.Table([("S", "T"), ("T", "u"), ("T", "P"), ("P", "u")])


def test_given_conversations(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()]
    assert collections.Counter(map(tuple, G.digests(G.repair(G.damage(df))).collect())) == expected(rows)
