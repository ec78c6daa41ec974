"""Conversation repair: the cheapest edits that make the turns alternate, found by iterative-deepening A*.

A repaired conversation is empty, or an optional system turn followed by pairs
of a user and an assistant turn.  Turns are kept (0), given the role that is
due (1) or deleted (2), empty turns are inserted (5); a blank turn and one
that repeats an earlier turn must go, a truncated one costs 5 unless deleted.

Texts travel once.  The search sees one code a turn: thin rows get a global
order by a range sort, blocks of consecutive turns of a conversation are
searched on their own, for each state before and after the block, and a small
tree of min-plus steps picks the states between blocks, so a conversation of
any length is searched by many tasks.  The last pass streams each conversation
in order, with the script of edits ahead of the turns it belongs to.
"""

from __future__ import annotations

import functools
import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetlake.llm.common import cut, ready

#: Costs of the edits, and what a truncated turn costs unless it is deleted.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 2, 5, 0, 1, 5
#: A block is at most 2^7 turns; up to 2^10 blocks are joined at a step of the tree.
BLOCK_BITS, FAN_BITS = 7, 10

_SPACE = r"\x20\x09-\x0D"
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
_NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_DUE = ("u", "u", "a", "u")
_ENDS = (0, 3)
#: States that can follow a state.
_LATER = ({0, 1, 2, 3}, {1, 2, 3}, {2, 3}, {2, 3})
_FULL = {"u": "user", "a": "assistant"}
_NEVER = 1 << 60


# -- search --------------------------------------------------------------------


class Search:
    """Iterative-deepening A* over one block of turns.

    ``roles`` holds the initial of each turn, ``kinds`` its kind: ``-`` must go,
    ``t`` truncated, ``k`` sound.  ``goals`` are the states that end the block;
    only with ``tail`` may turns be inserted after the last one.
    """

    def __init__(self, roles: str, kinds: str, goals: tuple[int, ...], tail: bool):
        self.roles, self.kinds, self.goals, self.tail, self.n = roles, kinds, goals, tail, len(roles)
        # what the turns still to come cost at least, whatever the state
        self.rest = [0] * (self.n + 1)
        for i in range(self.n - 1, -1, -1):
            least = DELETE if kinds[i] == "-" else min(DELETE, TRUNCATED * (kinds[i] == "t") + (KEEP if roles[i] in "sua" else REROLE))
            self.rest[i] = self.rest[i + 1] + least
        # to end before the first user turn all turns but a system turn have to go
        if max(goals) < 2:
            self.rest = [max(r, DELETE * (self.n - i - max(goals))) for i, r in enumerate(self.rest)]
        # failed states: a lower bound of what is left, raised by each failure
        self.need: dict[tuple[int, int], int] = {}
        self.path: list[str] = []

    def edits(self, i: int, state: int) -> Iterator[tuple[str, int, int, int]]:
        """(letter of the script, cost, next turn, next state), in ASCII order of the edits D, I, K, R."""
        due = _DUE[state]
        if i < self.n:
            yield "D", DELETE, i + 1, state
        if i < self.n or self.tail:
            yield due, INSERT, i, _NEXT[state][due]
        if i < self.n and self.kinds[i] != "-":
            more = TRUNCATED * (self.kinds[i] == "t")
            if self.roles[i] in _NEXT[state]:
                yield "K", KEEP + more, i + 1, _NEXT[state][self.roles[i]]
            yield due.upper(), REROLE + more, i + 1, _NEXT[state][due]

    def left(self, i: int, state: int) -> int:
        return self.need.get((i, state), self.rest[i])

    def found(self, i: int, state: int, budget: int) -> bool:
        """Depth first within the budget; the path holds the first accepting script."""
        if i == self.n and state in self.goals:
            return True
        least: int | None = None
        for letter, cost, j, after in self.edits(i, state):
            if _LATER[after].isdisjoint(self.goals):
                continue
            if cost + self.left(j, after) <= budget:
                self.path.append(letter)
                if self.found(j, after, budget - cost):
                    return True
                self.path.pop()
            needs = cost + self.left(j, after)
            least = needs if least is None else min(least, needs)
        # no way on within the budget: this state needs more than it, and at least what its cheapest edit needs
        self.need[i, state] = _NEVER if least is None else max(budget + 1, least)
        return False

    def run(self, state: int) -> tuple[int, str] | None:
        """(cost, script) of the cheapest edits, the ASCII-least of them; None where the goals cannot be reached."""
        bound, most = self.left(0, state), DELETE * self.n + 4 * INSERT
        while bound <= most and not _LATER[state].isdisjoint(self.goals):
            if self.found(0, state, bound):
                return bound, "".join(self.path)
            bound = self.left(0, state)
        return None


@functools.lru_cache(maxsize=1 << 15)
def cheapest(roles: str, kinds: str, entry: int, goals: tuple[int, ...], tail: bool) -> tuple[int, str] | None:
    """``Search.run``; conversations that look alike, as most short ones do, are searched once a task."""
    return Search(roles, kinds, goals, tail).run(entry)


def audit(script: str) -> str:
    """The edits' initials: u and a are insertions, U and A new roles."""
    return script.translate(str.maketrans("uaUA", "IIRR"))


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's cheapest scripts by entry and exit state (16 of them; one for a conversation of one block)."""
    for batch in batches:
        roles, kinds, first, last = (batch.column(c).to_pylist() for c in ("roles", "kinds", "is_first", "is_last"))
        costs, scripts = [], []
        for r, k, begins, ends in zip(roles, kinds, first, last, strict=True):
            cost, script = [None] * 16, [None] * 16
            for entry in (0,) if begins else range(4):
                for exit_ in (0,) if ends else range(4):
                    if (got := cheapest(r, k, entry, _ENDS if ends else (exit_,), ends)) is not None:
                        cost[4 * entry + exit_], script[4 * entry + exit_] = got
            costs.append(cost), scripts.append(script)
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv"), batch.column("block"), pa.array(costs, pa.list_(pa.int64())), pa.array(scripts, pa.list_(pa.string()))],
            ["conv", "block", "costs", "scripts"])


# -- states between blocks -------------------------------------------------------

_FAR = np.int64(1) << 60


def _ways(costs: np.ndarray, ranks: np.ndarray, entry: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cost and rank of every exit state, states before each step) of the cheapest and then ASCII-least way from ``entry``."""
    n = len(costs)
    cost, rank = np.full(4, _FAR), np.zeros(4, np.int64)
    cost[entry] = 0
    back = np.zeros((n, 4), np.int8)
    for i in range(n):
        total = cost[:, None] + costs[i].reshape(4, 4)
        # scripts up to here never are the beginning of one another: their order decides, then that of this block
        order = rank[:, None] * 4 + ranks[i].reshape(4, 4)
        best = np.lexsort((order, total), axis=0)[0]
        back[i] = best
        cost = np.minimum(total[best, range(4)], _FAR)
        rank = np.argsort(np.argsort(order[best, range(4)], kind="stable"), kind="stable")
    return cost, rank, back


def _matrices(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """costs and ranks of the blocks, both 16 wide."""
    costs = np.array([[_FAR if c is None else c for c in row] for row in table.column("costs").to_pylist()], np.int64).reshape(-1, 16)
    return costs, np.array(table.column("ranks").to_pylist(), np.int64).reshape(-1, 16)


def _joined(table: pa.Table) -> pa.Table:
    """One node for the blocks of a group, with cost and rank of each exit by entry."""
    table = table.sort_by("block")
    costs, ranks = _matrices(table)
    ways = [_ways(costs, ranks, e) for e in range(4)]
    cost = np.concatenate([w[0] for w in ways])
    return pa.table({
        "conv": table.column("conv")[:1], "block": pa.array([table.column("node")[0].as_py()], pa.int64()),
        "costs": pa.array([[None if c >= _FAR else int(c) for c in cost]], pa.list_(pa.int64())),
        "ranks": pa.array([np.concatenate([w[1] for w in ways]).tolist()], pa.list_(pa.int64()))})


def _chosen(table: pa.Table) -> pa.Table:
    """Entry and exit state of each block of a group whose own entry and exit are known."""
    table = table.sort_by("block")
    costs, ranks = _matrices(table)
    state = table.column("exit")[0].as_py()
    _, _, back = _ways(costs, ranks, table.column("entry")[0].as_py())
    entries, exits = [], []
    for i in range(table.num_rows - 1, -1, -1):
        exits.append(state)
        state = int(back[i][state])
        entries.append(state)
    return pa.table({"conv": table.column("conv"), "block": table.column("block"),
                     "entry": pa.array(entries[::-1], pa.int32()), "exit": pa.array(exits[::-1], pa.int32())})


def _states(blocks: DataFrame, conv_type: str) -> DataFrame:
    """(conv, block, entry, exit) of every block of conversations with several blocks; entry and exit of the whole are 0."""
    # the rank of a script among those of its entry state
    level = cut(blocks.select("conv", "block", "costs", F.transform(
        F.sequence(F.lit(0), F.lit(15)), lambda i: F.size(F.filter(
            F.slice("scripts", F.floor(i / 4).cast("int") * 4 + 1, 4),
            lambda s: F.translate(s, "uaUA", "IIRR") < F.translate(F.element_at("scripts", i + 1), "uaUA", "IIRR"))).cast("long")).alias("ranks")))
    levels = [level]
    node = F.shiftright("block", FAN_BITS)
    while not levels[-1].groupBy("conv").count().where(F.col("count") > 1 << FAN_BITS).isEmpty():
        levels.append(cut(levels[-1].withColumn("node", node).groupBy("conv", "node").applyInArrow(
            _joined, f"conv {conv_type}, block long, costs array<long>, ranks array<long>")))
    schema = f"conv {conv_type}, block long, entry int, exit int"
    whole = levels.pop().withColumn("entry", F.lit(0)).withColumn("exit", F.lit(0))
    chosen = whole.groupBy("conv").applyInArrow(_chosen, schema)
    while levels:
        above = cut(chosen).select(F.col("conv").alias("conv_"), F.col("block").alias("node"), "entry", "exit")
        below = levels.pop().withColumn("node", node).join(above, ["node"]).where(F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_")
        chosen = below.groupBy("conv", "node").applyInArrow(_chosen, schema)
    return chosen


# -- conversations ---------------------------------------------------------------


def damaged(convs: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with a fifth part of the turns dropped, emptied, cut short, repeated or given to the user.

    What befalls a turn follows from crc32 of ``conv_id:turn``; nulls read as one space.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.pmod(F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")), F.lit(20))
    rows = convs.select("conv_id", F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"),
                        fate.alias("fate")).where("fate <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(0), (F.col("fate") == 3).cast("int"))).alias("again")).drop("again")


def _thin(rows: DataFrame) -> DataFrame:
    """conv, turn, digest of role and text, initial of the role and kind of the turn."""
    initial = F.substring("role", 1, 1)
    kind = (F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "b").when(F.col("text").rlike(f"[.!?][{_SPACE}]*\\z"), "k").otherwise("t"))
    return rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _digest().alias("digest"),
                       F.when(initial.isin("s", "u", "a"), initial).otherwise("o").alias("role"), kind.alias("kind"))


def _digest():
    return F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))


def _scripts(rows: DataFrame) -> DataFrame:
    """One row a block: conv, turn and digest of its first row, block, script, cost, and counts of the faults."""
    conv_type = rows.schema["conv_id"].dataType.simpleString()
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("digest")]
    thin = cut(_thin(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id()))
    # a turn repeats an earlier one unless it is the first of its role and text; positions are unique
    first = thin.groupBy("conv", "digest").agg(F.min("pos").alias("pos")).select("pos", F.lit("1").alias("first"))
    faults = thin.join(first, "pos", "left").withColumn(
        "kind", F.when((F.col("kind") != "b") & F.col("first").isNull(), "d").otherwise(F.col("kind")))
    block = F.shiftright("pos", BLOCK_BITS)
    letters = lambda field: F.array_join(F.transform("turns", lambda t: t[field]), "")
    blocks = faults.groupBy("conv", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn", "digest", "role", "kind"))).alias("turns"),
        *[F.count_if(F.col("kind") == k).alias(n) for k, n in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))])
    blocks = cut(blocks.select("conv", "block", F.col("turns")[0]["turn"].alias("turn"), F.col("turns")[0]["digest"].alias("digest"),
                               "blank", "duplicate", "truncated", letters("role").alias("roles"),
                               F.translate(letters("kind"), "bd", "--").alias("kinds")))
    ends = blocks.groupBy(F.col("conv").alias("conv_")).agg(F.min("block").alias("low"), F.max("block").alias("high"))
    framed = blocks.join(ends, F.col("conv").eqNullSafe(F.col("conv_")))
    searched = cut(framed.select(
        "conv", "block", "roles", "kinds", (F.col("block") == F.col("low")).alias("is_first"), (F.col("block") == F.col("high")).alias("is_last")
    ).mapInArrow(_searched, f"conv {conv_type}, block long, costs array<long>, scripts array<string>"))
    several = ends.where("low < high").select("conv_")
    states = _states(searched.join(several, F.col("conv").eqNullSafe(F.col("conv_")), "left_semi"), conv_type)
    states = states.withColumn("at", F.col("entry") * 4 + F.col("exit") + 1).select(F.col("conv").alias("conv_"), F.col("block").alias("block_"), "at")
    picked = searched.join(states, (F.col("block") == F.col("block_")) & F.col("conv").eqNullSafe(F.col("conv_")), "left")
    at = F.coalesce("at", F.lit(1))
    picked = picked.select(F.col("conv").alias("conv_"), F.col("block").alias("block_"), F.element_at("costs", at).alias("cost"),
                           F.element_at("scripts", at).alias("script"))
    return blocks.drop("roles", "kinds").join(
        picked, (F.col("block") == F.col("block_")) & F.col("conv").eqNullSafe(F.col("conv_"))).drop("conv_", "block_")


class _Conversation:
    """One conversation, streamed: its script comes in pieces ahead of its turns."""

    def __init__(self, conv):
        self.conv, self.script, self.audit = conv, deque(), []
        self.counts = [0, 0, 0, 0]
        self.illegal, self.initial = 0, None
        self.low = self.high = self.turn = None
        self.turns = 0
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str) -> tuple:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1
        return (self.conv, self.lines - 1, role, text)

    def piece(self, script: str, counts: tuple) -> None:
        self.script.extend(script)
        self.audit.append(audit(script))
        self.counts = [a + b for a, b in zip(self.counts, counts, strict=True)]

    def inserted(self) -> Iterator[tuple]:
        while self.script and self.script[0] in _FULL:
            yield self.line(_FULL[self.script.popleft()], "")

    def row(self, turn: int | None, role: str, text: str) -> Iterator[tuple]:
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        yield from self.inserted()
        edit = self.script.popleft()
        if edit != "D":
            yield self.line(role if edit == "K" else _FULL[edit.lower()], text)

    def summary(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts[:3], self.illegal, self.counts[3], "".join(self.audit), self.hash.hexdigest())


def _streamed(rows_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        schema = None

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
                out.clear()

        def close() -> None:
            lines = list(now.inserted())
            out.extend(lines if rows_out else [now.summary()])

        for batch in batches:
            if schema is None:
                conv = pa.field("conv_id", batch.schema.field("conv").type)
                long, text = pa.int64(), pa.string()
                schema = pa.schema([conv, ("place", long), ("role", text), ("text", text)] if rows_out else
                                   [conv, *((n, long) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                                    ("audit", text), ("repaired_sha256", text)])
            for conv, turn, kind, role, body, counts in zip(
                    *(batch.column(c).to_pylist() for c in ("conv", "turn", "what", "role", "text", "counts")), strict=True):
                if now is None or now.conv != conv:
                    if now is not None:
                        close()
                    now = _Conversation(conv)
                if kind == 1:
                    now.piece(body, counts)
                elif kind == 2:
                    for line in now.row(turn, role, body):
                        if rows_out:
                            out.append(line)
                if len(out) >= 2000:
                    yield from flush()
            yield from flush()
        if now is not None:
            close()
            yield from flush()

    return run


def _in_order(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """All rows of a conversation together and in order: a mark for the conversation, pieces of its script, its turns."""
    counts = F.array(*[F.col(c) for c in ("blank", "duplicate", "truncated", "cost")])
    none = F.lit(None).cast("array<long>")
    marks = convs.select(F.col("conv_id").alias("conv")).distinct().select(
        "conv", F.lit(None).cast("long").alias("turn"), F.lit(b"").alias("digest"), F.lit(0).alias("what"), F.lit(0).cast("long").alias("block"),
        F.lit("").alias("role"), F.lit("").alias("text"), none.alias("counts"))
    pieces = _scripts(rows).select("conv", "turn", "digest", F.lit(1).alias("what"), "block", F.lit("").alias("role"),
                                   F.col("script").alias("text"), counts.alias("counts"))
    turns = rows.select(F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), _digest().alias("digest"), F.lit(2).alias("what"),
                        F.lit(0).cast("long").alias("block"), "role", "text", none.alias("counts"))
    every = marks.unionByName(pieces).unionByName(turns)
    return every.repartition("conv").sortWithinPartitions(
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest", "what", "block")


def repaired(rows: DataFrame, convs: DataFrame | None = None) -> DataFrame:
    """What is wrong with each conversation, and the cheapest repair.

    ``rows`` holds conv_id, turn, role, text (null role or text: one space);
    ``convs``, if given, lists by conv_id the conversations to report, those
    without rows too: zeros, an empty audit, the hash of an empty string.  Turns
    are taken by number, nulls first; turns of equal number by a digest of role
    and text.  A null conv_id is a conversation of its own.  A role that is
    empty or starts with none of s, u, a (case counts) fits nowhere.  Repeated
    rows are duplicates; an empty table gives no rows; other columns are ignored.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.
    """
    return _run(rows, convs, False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place, role, text of the repaired conversations (see :func:`repaired`)."""
    return _run(rows, None, True)


def _run(rows: DataFrame, convs: DataFrame | None, rows_out: bool) -> DataFrame:
    ready(rows.sparkSession)
    clean = rows.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    conv_type = clean.schema["conv_id"].dataType.simpleString()
    schema = (f"conv_id {conv_type}, place long, role string, text string" if rows_out else
              f"conv_id {conv_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
              "repaired_sha256 string")
    return _in_order(clean, clean if convs is None else convs).select(
        "conv", "turn", "what", "role", "text", "counts").mapInArrow(_streamed(rows_out), schema)
