"""Search against all scripts, blocks against whole conversations, odd rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sheetlake.llm import conversation_repair as R

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def by_table(roles: str, kinds: str) -> tuple[int, str]:
    """The cheapest and then least audit, kept for each number of turns and last role."""
    def grow(best, more):
        for key, value in more:
            if key not in best or value < best[key]:
                best[key] = value

    def inserted(best):
        out = dict(best)
        for _ in range(3):
            grow(out, [(NEXT[last, r], (cost + 5, text + "I")) for last, (cost, text) in list(out.items()) for r in "ua" if (last, r) in NEXT])
        return out

    best = {"": (0, "")}
    for role, kind in zip(roles, kinds, strict=True):
        now: dict = {}
        more = 5 * (kind == "t")
        for last, (cost, text) in inserted(best).items():
            grow(now, [(last, (cost + 2, text + "D"))])
            if kind != "-":
                grow(now, [(NEXT[last, r], (cost + more + c, text + e)) for r, c, e in ((role, 0, "K"), ("u", 1, "R"), ("a", 1, "R")) if (last, r) in NEXT])
        best = now
    return min(v for last, v in inserted(best).items() if last in ("", "a"))


def test_search_finds_the_cheapest_and_least():
    for n in range(5):
        for roles in itertools.product("suao", repeat=n):
            for kinds in itertools.product("-tk", repeat=n):
                cost, script = R.Search("".join(roles), "".join(kinds), (0, 3), True).run(0)
                assert (cost, R.audit(script)) == by_table("".join(roles), "".join(kinds))
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(5, 60)
        roles, kinds = "".join(rng.choices("suao", (1, 5, 5, 1), k=n)), "".join(rng.choices("-tk", (1, 1, 6), k=n))
        cost, script = R.Search(roles, kinds, (0, 3), True).run(0)
        assert (cost, R.audit(script)) == by_table(roles, kinds)


def test_states_that_cannot_be_reached():
    assert R.Search("ua", "kk", (1,), False).run(0) is None and R.Search("ua", "kk", (0,), False).run(3) is None
    assert R.Search("", "", (0, 3), True).run(0) == (0, "")


def brute(rows: list[tuple]) -> dict:
    """Every conversation in plain Python: (conv_id, turn, role, text) with nulls."""
    convs: dict = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate:
            text = "" if fate == 1 else text.translate(str.maketrans("", "", ".!?")) if fate == 2 else text
            convs[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    out = {}
    for conv, all_turns in convs.items():
        all_turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}:{r[2]}".encode()).digest()))
        seen, kinds = set(), ""
        for _, role, text in all_turns:
            words = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            kinds += "b" if not words else "d" if (role, text) in seen else "k" if words[-1] in ".!?" else "t"
            seen.add((role, text))
        roles = "".join(r[:1] if r[:1] in ("s", "u", "a") else "o" for _, r, _ in all_turns)
        cost, text = by_table(roles, kinds.replace("b", "-").replace("d", "-"))
        lines, last, at = [], "", 0
        for edit in text:
            due = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            if edit == "I":
                lines.append(due + ":")
                last = due[0]
                continue
            _, role, body = all_turns[at]
            at += 1
            if edit != "D":
                role = role if edit == "K" else due
                lines.append(f"{role}:{body}")
                last = role[0]
        turns = [t for t, _, _ in all_turns if t is not None]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in "bdt"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(all_turns)), cost, text,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed: int = 5) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "User"])
            text = rng.choice(["Yes.", "No!", "Why?", "cut off", "", " \t", None, f"Text {rng.random()}.", "ünï \U0001f600.  "])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
    rows += [(99, 0, "user", "Hello."), (99, 0, "user", "Hello."), (99, 1, "assistant", "Yes. "), (100, None, None, None)]
    # one long conversation: several blocks, and with small fans several levels of them
    rows += [(7_000, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Same.", f"One {t}.", f"two {t}", ""])) for t in range(900)]
    return rows


@pytest.mark.parametrize("block,fan", [(7, 10), (3, 2)])
def test_whole_tables_against_plain_python(spark, monkeypatch, block, fan):
    monkeypatch.setattr(R, "BLOCK_BITS", block)
    monkeypatch.setattr(R, "FAN_BITS", fan)
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("kind", F.lit("clash")).withColumn(
        "block", F.lit(1)).repartition(4)
    got = {r[0]: tuple(r)[1:] for r in R.repaired(R.damaged(frame), frame).collect()}
    assert got == brute(rows)


def test_repaired_turns_alternate(spark):
    rows = conversations(8)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = R.repaired_turns(frame).orderBy("conv_id", "place").collect()
    of: dict = {}
    for r in turns:
        assert r.place == len(of.setdefault(r.conv_id, []))
        of[r.conv_id].append(r.role[:1])
    assert of and all("".join(x).removeprefix("s") == "ua" * (len("".join(x).removeprefix("s")) // 2) for x in of.values())


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert R.repaired(R.damaged(none), none).isEmpty() and R.repaired_turns(none).isEmpty()
