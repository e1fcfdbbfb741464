"""Repair of conversations: the cheapest edits that give turns an order of roles that can be trained on.

A conversation's rows are kept, given another role, or deleted, and empty turns are put in, so that the
roles read ``(s?(ua)+)?``: nothing, or user and assistant in turn, after at most one system turn.  Only
what a row means for this is looked at: the kind of its role, and its first fault (blank, duplicate,
truncated).  That makes one symbol a row, and equal neighbours a run.

Each symbol is a transition between four states (nothing yet, after system, after user, after
assistant) over the min-plus numbers.  Costs to the end go backwards over the runs; a run of length n
takes the cached powers 1, 2, 4, ... of its transition that add up to n.  The edits are then unrolled
forwards, block by block, taking at each place the letter that is least in ASCII among those that
keep the cost; a letter leads to one state only, so this is the least audit of all cheapest ones.

What goes where.  Symbols are light (no text) and reach the task that solves a conversation as a sorted
stream; what it holds are the runs and the audit, which the result has in one value anyhow.  Equal
rows of a turn are counted before they move, and duplicates are found by aggregates, not in a group.
Texts move once, sorted, behind their conversation's audit, and are rewritten as they pass by: a
conversation of any length takes the memory of a batch.

Order: by turn, nulls first; rows of one turn by the MD5 of role and text, so equal rows are neighbours.
Nulls in role or text count as one space, also in the place of a null conv_id or turn wherever those are
written out; rows without conv_id are one conversation.  A role that starts with none of s, u, a (an empty
one too) cannot be kept.  Roles are told by their first character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concordat.session import settle

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = ("", "", "user", "assistant")  # of a turn that leads to the state
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.  The next state of an inserted or renamed turn:
ONWARD = (2, 2, 3, 2)
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END = (0, 2 * INSERT, INSERT, 0)
SPACE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60

Vector = tuple[int, ...]
#: (kind of role: s, u, a or x; whether it must go; whether it is truncated)
Symbol = tuple[str, bool, bool]


def _edits(symbol: Symbol, state: int) -> list[tuple[str, int, int]]:
    """What can be done with a row: letter, cost and next state, least letter first."""
    kind, gone, cut = symbol
    out = [("D", DELETE, state)]
    if not gone:
        late = TRUNCATED if cut else 0
        if (state, kind) in _KEPT:
            out.append(("K", KEEP + late, _KEPT[state, kind]))
        out.append(("R", REROLE + late, ONWARD[state]))
    return out


@lru_cache(maxsize=1 << 12)
def _power(symbol: Symbol, p: int) -> tuple[Vector, ...]:
    """The min-plus transition of 2^p equal rows."""
    if p:
        half = _power(symbol, p - 1)
        return tuple(tuple(min(row[k] + half[k][j] for k in range(4)) for j in range(4)) for row in half)
    out = []
    for state in range(4):
        costs, at, paid = [_NEVER] * 4, state, 0
        for _ in range(3):  # a third inserted turn only repeats a state
            for _, cost, to in _edits(symbol, at):
                costs[to] = min(costs[to], paid + cost)
            at, paid = ONWARD[at], paid + INSERT
        out.append(tuple(costs))
    return tuple(out)


@lru_cache(maxsize=1 << 16)
def _before(symbol: Symbol, p: int, after: Vector) -> Vector:
    """Costs to the end before 2^p equal rows, from those after them."""
    return tuple(min(row[j] + after[j] for j in range(4)) for row in _power(symbol, p))


def _level(costs: Vector) -> tuple[Vector, int]:
    least = min(costs)
    return tuple(c - least for c in costs), least


def _row_letters(symbol: Symbol, state: int, after: Vector) -> tuple[str, int]:
    go, out = _before(symbol, 0, after), ""
    while True:
        for letter, cost, to in _edits(symbol, state):
            if letter > "I" and INSERT + go[ONWARD[state]] == go[state]:
                break
            if cost + after[to] == go[state]:
                return out + letter, to
        out, state = out + "I", ONWARD[state]


def _letters(symbol: Symbol, p: int, state: int, after: Vector) -> tuple[str, int]:
    """The edits of 2^p equal rows from a state on, and the state they lead to."""
    if not p:
        return _row_letters(symbol, state, after)
    unroll = _known if p <= 12 else _letters
    left, state = unroll(symbol, p - 1, state, _level(_before(symbol, p - 1, after))[0])
    right, state = unroll(symbol, p - 1, state, after)
    return left + right, state


_known = lru_cache(maxsize=1 << 12)(_letters)


def solve(runs: list[tuple[Symbol, int]]) -> tuple[int, str]:
    """Cost and audit of a conversation given as runs of symbols."""
    blocks = [(symbol, p) for symbol, n in runs for p in range(n.bit_length()) if n >> p & 1]
    costs, paid, afters = END, 0, []
    for symbol, p in reversed(blocks):
        afters.append(costs)
        costs, more = _level(_before(symbol, p, costs))
        paid += more
    state, out = 0, []
    for (symbol, p), after in zip(blocks, reversed(afters)):
        letters, state = _known(symbol, p, state, after) if p <= 12 else _letters(symbol, p, state, after)
        out.append(letters)
    out.append("I" * (END[state] // INSERT))
    return paid + costs[0], "".join(out)


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with the faults that their ids and turns call for, as rows with a number of copies (0: dropped)."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(name) % 20
    return conversations.select(
        "conv_id", "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _key(role: Column, text: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))


def _light(rows: DataFrame) -> DataFrame:
    """A row for each conversation, turn, role and text: symbol, copies, and whether its first copy is no duplicate."""
    shown, initial = F.rtrim(F.col("text"), F.lit(SPACE)), F.left("role", F.lit(1))
    single = rows.select(
        "conv_id", "turn", "copies", _key(F.col("role"), F.col("text")).alias("key"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("kind"),
        (shown == "").alias("blank"), (~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    counted = settle(single.groupBy("conv_id", "turn", "key", "kind", "blank", "cut").agg(F.sum("copies").alias("copies")), "symbols")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.where("copies > 0").groupBy(F.col("conv_id").alias("of"), F.col("key").alias("said")).agg(F.min(place).alias("first"), F.count("*").alias("turns"))
    both = counted.join(firsts.where("turns > 1"), F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("key") == F.col("said")), "left")
    return both.select(*counted.columns, (F.col("first").isNull() | (place == F.col("first"))).alias("fresh"))


SOLVED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}


class _Conversation:
    """What is known of a conversation while its rows pass by in order."""

    def __init__(self):
        self.runs, self.last, self.turns, self.first_turn, self.last_turn = [], "", 0, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def _run(self, symbol: Symbol, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = (symbol, self.runs[-1][1] + n)
        elif n:
            self.runs.append((symbol, n))

    def add(self, turn: int | None, kind: str, blank: bool, cut: bool, copies: int, fresh: bool) -> None:
        if not copies:
            return
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        self.illegal += copies - 1 + (self.last != "" and self.last + kind not in _LEGAL)
        self.last = kind
        sound = int(fresh and not blank)
        self.blank += copies if blank else 0
        self.duplicate += 0 if blank else copies - sound
        self.truncated += sound and cut
        self._run((kind, False, cut), sound)
        self._run(("x", True, False), copies - sound)

    def row(self, conv_id: int | None) -> tuple:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, *solve(self.runs))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in SOLVED.split(", ")]
    types = [pa.string() if n == "audit" else pa.int64() for n in names]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    conv_id, now = None, None
    for some in batches:
        done = []
        for one, *rest in zip(*(c.to_pylist() for c in some.columns)):
            if now is None or one != conv_id:
                if now is not None:
                    done.append(now.row(conv_id))
                conv_id, now = one, _Conversation()
            now.add(*rest)
        yield batch(done)
    if now is not None:
        yield batch([now.row(conv_id)])


def plan_repairs(rows: DataFrame) -> DataFrame:
    """Counts of faults, cost and audit of every conversation in rows (conv_id, turn, role, text, copies).

    A conversation of which no row is left has zeros and an empty audit.
    """
    light = _light(rows).select("conv_id", "key", "turn", "kind", "blank", "cut", "copies", "fresh")
    ordered = light.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "key").drop("key")
    return ordered.mapInArrow(_solve, SOLVED)


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    names = [f.split()[0] for f in REPAIRED.split(", ")]
    conv_id, audit, last, at, place, state = None, "", 0, 0, 0, 0  # last: where only inserted turns follow
    for some in batches:
        out = []

        def inserted() -> None:
            nonlocal at, place, state
            while at < len(audit) and audit[at] == "I":
                state = ONWARD[state]
                out.append((conv_id, place, "I", ROLES[state], ""))
                at, place = at + 1, place + 1

        for one, edits, role, text, copies in zip(*(some.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies"))):
            if edits is not None:
                conv_id, audit, last, at, place, state = one, edits, len(edits.rstrip("I")), 0, 0, 0
                continue
            for _ in range(copies):
                inserted()
                letter = audit[at]
                at += 1
                if letter != "D":
                    state = ONWARD[state] if letter == "R" else _KEPT[state, role[:1]]
                    out.append((conv_id, place, letter, ROLES[state] if letter == "R" else role, text))
                    place += 1
                if at == last:
                    inserted()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The turns of the repaired conversations (conv_id, place, edit, role, text), each conversation's in their order in one partition."""
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (("turn", "long"), ("key", "binary"), ("role", "string"), ("text", "string"), ("copies", "long"))]
    audits = plans.select("conv_id", F.lit(0).alias("part"), "audit", *nothing)
    turns = rows.where("copies > 0").select("conv_id", F.lit(1).alias("part"), F.lit(None).cast("string").alias("audit"), "turn", _key(F.col("role"), F.col("text")).alias("key"), "role", "text", "copies")
    ordered = audits.unionByName(turns).repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "key")
    return ordered.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_rewrite, REPAIRED)
