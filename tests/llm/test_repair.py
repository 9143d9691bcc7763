"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from sluice.llm import repair

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
SCHEMA = "conv_id long, turn long, role string, text string, kind string, k int, part int"


def by_force(rows):
    """The contract's columns of one conversation: for each state the least (cost, letters, repair)."""
    live = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        live += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    live.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    best = {"": (0, "", ())}

    def inserted(best):
        for _ in range(4):
            for q, (c, e, t) in list(best.items()):
                for role in ("user", "assistant"):
                    to = STEPS.get((q, role[0]))
                    if to:
                        best[to] = min(best.get(to, (10**9,)), (c + 3, e + "I", (*t, role + ":")))
        return best

    for _, role, text in live:
        stripped = text.strip(" \t\n\v\f\r")
        fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            faults[fault] += 1
        after = {}
        for q, (c, e, t) in inserted(best).items():
            ways = [("D", q, 4, t)]
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                for letter, r, cost in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if to := STEPS.get((q, r[:1])):
                        ways.append((letter, to, cost + extra, (*t, f"{r}:{text}")))
            for letter, to, cost, turns in ways:
                after[to] = min(after.get(to, (10**9,)), (c + cost, e + letter, turns))
        best = after
    best = inserted(best)
    cost, audit, turns = min(best.get(q, (10**9,)) for q in ("", "a"))
    held = [t for t, _, _ in live if t is not None]
    gaps = max(held) - min(held) + 1 - len(set(held)) if held else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(live, live[1:]))
    return (gaps, *faults.values(), illegal, cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.choice((1, 2, 5, 9, 30))):
            role = rng.choice(("system", "user", "assistant", "user", "assistant", "tool", "", None))
            text = rng.choice(("Yes.", "No!", "so it is", " \t ", "", None, "one more?\n", f"t{rng.randint(0, 9)}.", "ürgend é。", "long " * 400))
            rows.append((conv, rng.choice((turn, turn, turn, turn + 3, None)), role, text))
    return rows + rows[:7]


def check(spark, rows, parts=None):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in repair.repairs(repair.damaged(df if parts is None else df.repartition(parts))).collect()}
    want = {c: by_force([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    assert got == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_repairs_as_by_force(spark, seed):
    check(spark, conversations(seed, 60))


@pytest.mark.parametrize("turns", [1, 3, 7])
def test_long_conversations_lie_over_many_pieces(spark, monkeypatch, turns):
    """One conversation holds nearly all turns; pieces of a few turns, over several partitions."""
    monkeypatch.setattr(repair, "TURNS", turns)
    rng = random.Random(turns)
    rows = [(5, t // 2 if t % 9 else None, rng.choice(("system", "user", "assistant", "user", "assistant")), rng.choice(("a.", "b", "c!", f"{t}.", f"{t}"))) for t in range(300)]
    check(spark, rows + conversations(turns, 12), 5)


def test_equal_turns_and_no_turns(spark):
    """A third of a table may be one repeated row; conversations may lose all their turns."""
    dropped = [(c, 0, "user", "Hello.") for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    check(spark, [(1, 4, "user", "Same.")] * 500 + dropped, 4)
    got = repair.repairs(repair.damaged(spark.createDataFrame(dropped[:1], "conv_id long, turn long, role string, text string"))).collect()
    assert [tuple(r)[1:] for r in got] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_an_empty_table(spark):
    assert repair.repairs(repair.damaged(spark.createDataFrame([], SCHEMA))).collect() == []


def test_blocks_agree_with_single_symbols():
    """Every block of the table is what its symbols do one after the other, for every vector."""
    block, single = repair.BlockTables(3), repair.BlockTables(1)
    rng = np.random.default_rng(0)
    for n in range(12):
        symbols = rng.integers(0, len(repair.SYMBOLS), n)
        for v in range(len(block.vectors)):
            assert block.before(symbols, v) == single.before(symbols, v)
            assert [x[v] for x in block.map(symbols)] == list(single.before(symbols, v))
            assert block.trace(symbols, v, 0) == single.trace(symbols, v, 0)
