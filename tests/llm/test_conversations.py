"""Repair and prefix trie of conversations, against plain versions."""

import binascii
import hashlib
import itertools
import random
import re

import pytest

from concordat.llm import conversation_repair as repair
from concordat.llm import conversation_trie as trie
from concordat.llm.common import joined_sha256
from concordat.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string, key string, copies string, audit string"


def given(spark, folder):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]


def in_order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    return sorted(rows, key=key)


# repair

_NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
_ON = {0: 2, 1: 2, 2: 3, 3: 2}


def cheapest(rows):
    """Cost and least audit of (kind, gone, cut), by whole strings from the end."""
    best = {0: (0, ""), 1: (6, "II"), 2: (3, "I"), 3: (0, "")}
    for kind, gone, cut in reversed(rows):
        step = {}
        for s in range(4):
            ways = [(4 + best[s][0], "D" + best[s][1])]
            if not gone:
                late = 3 if cut else 0
                if (s, kind) in _NEXT:
                    ways.append((late + best[_NEXT[s, kind]][0], "K" + best[_NEXT[s, kind]][1]))
                ways.append((3 + late + best[_ON[s]][0], "R" + best[_ON[s]][1]))
            step[s] = min(ways)
        best = {s: min((3 * n + step[to][0], "I" * n + step[to][1]) for n, to in enumerate([s, _ON[s], _ON[_ON[s]], _ON[_ON[_ON[s]]]])) for s in range(4)}
    return best[0]


def plainly_repaired(given_rows):
    out = {}
    for conv_id in {r[0] for r in given_rows}:
        rows = []
        for c, turn, role, text in (r for r in given_rows if r[0] == conv_id):
            fault = binascii.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if fault:
                text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
                rows += [(c, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
        rows = in_order(rows)
        turns = {r[1] for r in rows if r[1] is not None}
        counts, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, _, role, text in rows:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            first = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if first:
                counts[first] += 1
            symbols.append((role[:1], first in ("blank", "duplicate"), first == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(symbols, symbols[1:]))
        cost, audit = cheapest(symbols)
        state, lines, at = 0, [], iter(rows)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)[2:]
            if letter != "D":
                state = _NEXT[state, role[:1]] if letter == "K" else _ON[state]
                lines.append((role if letter == "K" else {2: "user", 3: "assistant"}[state]) + ":" + text)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv_id] = (gaps, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, rows):
    frame = repair.damage(rows)
    plans = frame.sparkSession.createDataFrame(repair.plan_repairs(frame).collect(), repair.SOLVED)
    lines = {}
    for r in sorted(repair.repaired_turns(frame, plans).collect(), key=lambda r: r["place"]):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    return {p["conv_id"]: (*p[1:], hashlib.sha256("\n".join(lines.get(p["conv_id"], [])).encode()).hexdigest()) for p in plans.collect()}


def test_runs_against_strings():
    rng = random.Random(1)
    for _ in range(3000):
        rows = [(rng.choice("suax"), False, rng.random() < 0.3) if rng.random() < 0.8 else ("x", True, False) for _ in range(rng.randrange(10))]
        rows = [r for r in rows for _ in range(rng.choice([1, 1, 2, 9]))]
        assert repair.solve([(s, len(list(g))) for s, g in itertools.groupby(rows)]) == cheapest(rows)


def test_every_edit():
    """The plain version itself, against all edits of short conversations."""
    rng = random.Random(2)
    for _ in range(30):
        rows = [(rng.choice("suax"), rng.random() < 0.2, False) for _ in range(rng.randrange(4))]
        found = []
        for edits in itertools.product(["D", "K", "Ru", "Ra"], repeat=len(rows)):
            for extra in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                roles, audit, cost = extra[0], "I" * len(extra[0]), 3 * sum(map(len, extra))
                for (kind, gone, _), edit, more in zip(rows, edits, extra[1:]):
                    cost += 4 if edit == "D" else 99 if gone else 3 * (edit[0] == "R")
                    roles += ("" if edit == "D" else kind if edit == "K" else edit[1]) + more
                    audit += edit[0] + "I" * len(more)
                if re.fullmatch("(s?(ua)+)?", roles):
                    found.append((cost, audit))
        assert min(found) == cheapest(rows)


def test_long_runs():
    u, a, gone = ("u", False, False), ("a", False, True), ("x", True, False)
    cost, audit = repair.solve([(u, 1_000_000), (gone, 12_345), (a, 70_001)])
    assert len(audit) - audit.count("I") == 1_082_346 and cost == 3 * (audit.count("R") + audit.count("I")) + 4 * audit.count("D") + 3 * sum(e != "D" for e in audit.replace("I", "")[-70_001:])


def odd_conversations():
    rng = random.Random(7)
    rows = [(1, None, "user", "Hi."), (1, None, "user", "Hi."), (1, 3, None, None), (1, -2, "assistant", "Ha!"), (None, 1, "user", "x."), (None, None, "system", ""), (2, 1, "", "no role."),
            (2, 1, "", "no role."), (2, 2, "User", "Big U."), (3, 1, "user", "\t\n "), (4, 1, "assistant", "end.  "), (5, 5, "user", "a. " * 50_000)]
    words = ["Yes.", "No", "  ", "Why?", "So it is!", "yes."]
    rows += [(10 + rng.randrange(40), rng.choice([None, *range(9)]), rng.choice(["user", "assistant", "system", "tool", "user"]), rng.choice(words)) for _ in range(300)]
    rows += [(99, i, "user" if i % 2 else "assistant", f"{i % 700}.") for i in range(1500)]
    return [(*r, "k", "c", "a") for r in rows]


def test_repair_of_odd_conversations(spark):
    rows = odd_conversations()
    want = plainly_repaired([r[:4] for r in rows])
    assert repaired(spark, spark.createDataFrame(rows, TURN)) == want
    assert repaired(spark, spark.createDataFrame(rows[::-1], TURN).repartition(7)) == want
    assert repaired(spark, spark.createDataFrame([], TURN)) == {}


def test_repair_query(spark):
    got = {r["conv_id"]: r for r in QUERIES["op11_conversation_repair"](spark, FOLDER).collect()}
    columns = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {i: tuple(r[c] for c in columns) for i, r in got.items()} == plainly_repaired(given(spark, FOLDER))


def test_joined_digest(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k long, t string").repartition("k").sortWithinPartitions("k", "t")
    got = {r["k"]: r["d"] for r in joined_sha256(rows, ["k"], "t", ",", "d").collect()}
    assert got == {k: hashlib.sha256(t).hexdigest() for k, t in ((1, b"a,b"), (None, b"c"))}


# prefix trie


def plain_trie(given_rows):
    own = {}
    for c in {r[0] for r in given_rows if r[0] is not None}:
        own[c] = [r[2:] for r in in_order([(i, t, role or "", text or "") for i, t, role, text in given_rows if i == c])]
    whole = {}
    for c, turns in own.items():
        h = binascii.crc32(str(c).encode()) % 4
        whole[c] = tuple(own.get(c - (c % 20 if c >= 0 else -(-c % 20)), [])[:h] + turns[h:])
    nodes = {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    below = {n: [m for m in nodes if m[: len(n)] == n] for n in nodes} if len(nodes) < 3000 else None
    children, leaves, saved = {n: 0 for n in nodes}, {n: 0 for n in nodes}, {n: 0 for n in nodes}
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    if below is not None:
        for n, own_below in below.items():
            leaves[n] = sum(not children[m] for m in own_below)
            saved[n] = sum((len(nodes[m]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", m[-1][1])) for m in own_below if m)
    ends = {n: hashlib.sha256(",".join(str(c) for c in sorted(m) if whole[c] == n).encode()).hexdigest() for n, m in nodes.items()}
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], ends[n]) for n, m in nodes.items())


def found_trie(frame):
    return sorted(tuple(r) for r in frame.collect())


def trie_of(frame):
    import pyspark.sql.functions as F

    return trie.trie(*trie.rebuilt(trie.turns_of(frame), 20, lambda c: F.crc32(c.cast("string")) % 4))


def test_trie_of_odd_conversations(spark):
    rng = random.Random(3)
    rows = [(None, 1, "user", "x"), (-7, 1, "user", "neg"), (-20, 1, "user", "base"), (-20, 2, None, None), (0, None, "user", "first"), (0, None, None, "x y"), (1, 5, "user", "first"), (500, -3, "user", " ")]
    for c in range(20, 70):
        rows += [(c, t if rng.random() < 0.9 else None, rng.choice(["user", "assistant"]), rng.choice(["a", "b c", "d  e f"])) for t in range(rng.randrange(6))]
    for c in range(100, 106):  # deep ones with a long common start
        rows += [(c, t, "user" if t % 2 else "assistant", f"{t if t < 21 + c % 3 * 6 else c} w") for t in range(45)]
    rows += [(200, t, "user", "same") for t in (1, 1, 1, 2)]
    frame = spark.createDataFrame([(*r, "k", "c", "a") for r in rows], TURN)
    assert found_trie(trie_of(frame)) == plain_trie(rows)
    few = [r for r in rows if r[0] in (-7, 24)]
    assert found_trie(trie_of(frame.where("conv_id in (-7, 24)"))) == plain_trie(few)
    assert found_trie(trie_of(frame.where("conv_id = 999"))) == [] and found_trie(trie_of(frame.where("conv_id is null"))) == []


def test_numbers_in_blocks(spark):
    """Long conversations, and turns without number, are numbered in blocks."""
    rows = [(1, None if t % 3 == 0 else t * 7, "user", f"{t}") for t in range(5000)]
    got = trie.numbered(trie.turns_of(spark.createDataFrame([(*r, "k", "c", "a") for r in rows], TURN))).collect()
    order = {hashlib.md5(f"{len(r[2])}:{r[2]}{r[3]}".encode()).hexdigest(): i + 1 for i, r in enumerate(in_order(rows))}
    assert {r["said"]: r["place"] for r in got} == order


def test_trie_query(spark):
    assert found_trie(QUERIES["op12_conversation_trie"](spark, FOLDER)) == plain_trie(given(spark, FOLDER))
