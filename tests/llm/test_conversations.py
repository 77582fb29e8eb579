"""Conversation repair against exhaustive search."""

import hashlib
import itertools
import random
import zlib
from functools import cache

import pyarrow as pa
import pytest

from bitloom.llm.common import runs
from bitloom.llm.conversations import FINISH, START, Survivors, digests, moves, repair, repaired

SPACE = " \t\n\x0b\f\r"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}


def cheapest(rows):
    """(cost, audit, lines) for rows (role, text, dead, cut): every edit is tried at every place, from the back."""
    @cache
    def best(k, state, inserts):
        ways = [(0, "", ())] if k == len(rows) and state in ("", "a") else []

        def add(cost, letter, line, rest):
            if rest:
                ways.append((cost + rest[0], letter + rest[1], (() if line is None else (line,)) + rest[2]))

        for new in ("user", "assistant") if inserts else ():
            if after := NEXT.get((state, new[0])):
                add(3, "I", f"{new}:", best(k, after, inserts - 1))
        if k < len(rows):
            role, text, dead, cut = rows[k]
            add(4, "D", None, best(k + 1, state, 2))
            for new in () if dead else {role, "user", "assistant"}:
                if after := NEXT.get((state, new[:1])):
                    add((0 if new == role else 3) + 3 * cut, "K" if new == role else "R", f"{new}:{text}", best(k + 1, after, 2))
        return min(ways, default=None)

    return best(0, "", 2)


def report(rows):
    """The row of one conversation from (turn, role, text) after damage."""
    rows = sorted(((t, r, x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faulty, faults = set(), [], [0, 0, 0]
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        fault = 0 if not body else 1 if (role, text) in seen else 2 if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        faulty.append((role, text, fault in (0, 1), fault == 2))
    turns = {t for t, _, _ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = cheapest(tuple(faulty)) if faulty else (0, "", ())
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *faults, illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(conv, turn, role, text):
    def filled(x):
        return " " if x is None else x

    role, text = filled(role), filled(text)
    kind = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20
    if kind == 1:
        text = ""
    if kind == 2:
        text = "".join(c for c in text if c not in ".!?")
    return [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


SCHEMA = "conv_id long, turn long, role string, text string, key string, part string, kind string, copies string"
REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def draw(rng, conv, turns):
    return [(conv, rng.choice([k, k, k, rng.randrange(9), None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]),
             rng.choice(["Yes.", "No!", "so", f"Line {k}?", f"Cut {k}", "", " \n", None, "Ünd é. "])) for k in range(turns)]


def test_reports(spark):
    rng = random.Random(5)
    rows = [r for c in range(150) for r in draw(rng, c, rng.randrange(1, 6))] + draw(rng, None, 4)
    rows += [(900, 0, "user", "x" * 200_000), (900, 1, "assistant", "y" * 200_000 + ".")] + rows[:6]
    found = repaired(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)).collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).extend(damaged(*r))
    want = {c: report(g) for c, g in groups.items()}
    assert {r["conv_id"]: tuple(r[n] for n in REPORT) for r in found} == want and len(found) == len(want)
    assert repaired(spark.createDataFrame([], SCHEMA)).isEmpty()


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_blocks_join_up(spark, block):
    """A conversation decoded in blocks has the edits of one decoded in one go, ties included."""
    rng = random.Random(block)
    rows = [(1, k, rng.choice(["user", "user", "assistant", "tool"]), f"{k}{rng.choice(['.', ''])}") for k in range(150)]
    rows += [(2, k, "user", f"{k}.") for k in range(100)] + [(3, k % 7, "system", f"{k % 9}!") for k in range(60)]
    rows += [(4, k, r, "same.") for k, r in enumerate(["user", "assistant"] * 40)]
    edits, faults = repair(spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA), block=block)
    got = {r["key"]: (r["cost"], r["audit"]) for r in digests(edits).collect()}
    for conv in (1, 2, 3, 4):
        seen, faulty = set(), []
        for _, _, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1:]):
            faulty.append((role, text, (role, text) in seen, text[-1] not in ".!?"))
            seen.add((role, text))
        assert got[f"={conv}"] == cheapest(tuple(faulty))[:2]
    assert faults.count() == 4


def test_decoder_agrees_with_exhaustive_search():
    rng = random.Random(11)
    for _ in range(400):
        rows = tuple((rng.choice(["user", "assistant", "system", "tool"]), str(k), False, rng.random() < 0.4) for k in range(rng.randrange(1, 6)))
        path, settled = Survivors(START), []
        for k, (role, _, _, cut) in enumerate(rows):
            settled += path.step(k, moves(role[:1], cut))
        settled += path.step(None, FINISH)
        cost, audit, _ = cheapest(rows)
        assert (path.spent, "".join(item[2] for item in settled)) == (cost, audit)


def test_groups_that_cross_batches():
    """Groups that begin in one Arrow batch and end inside a later one are handed out whole."""
    keys = [k for k, n in enumerate([3, 1, 9, 2, 4, 1, 7]) for _ in range(n)]
    for size in range(1, len(keys) + 1):
        batches = pa.table({"key": keys, "x": range(len(keys))}).to_batches(max_chunksize=size)
        got = [(set(k.to_pylist()), x.to_pylist()) for k, x in runs(batches, 1)]
        assert got == [({k}, [x for x, name in enumerate(keys) if name == k]) for k in range(7)]


def test_conversations_that_cross_batches(spark):
    rng = random.Random(3)
    rows = [r for c in range(3000) for r in draw(rng, c, 3)] + [(-1, t, "user", "a.") for t in (0, 2**63 - 1)]
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).extend(damaged(*r))
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    assert {r["conv_id"]: tuple(r[n] for n in REPORT) for r in repaired(table).collect()} == {c: report(g) for c, g in groups.items()}


def test_settled_edits_are_released():
    """A long orderly conversation leaves no tree behind."""
    path, settled = Survivors(), 0
    for k in range(20_000):
        settled += len(path.step(k, moves("ua"[k % 2], k % 5 == 0)))
        assert k + 1 - settled < 10
