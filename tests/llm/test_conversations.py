"""Conversation repair against plain enumeration and a plain shortest path over states."""

import hashlib
import random
import zlib

import pytest

from slicelake.llm import conversations, queries
from slicelake.llm.common import SPACES, table

SF = "/root/testdata/sf0.001"
STEPS = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
FULL = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) row by row: for each state the least way to be in it, insertions between rows."""
    best = {0: (0, "", ())}

    def insert(best):
        for _ in range(2):
            for p, (cost, audit, out) in list(best.items()):
                for x in "ua":
                    if (x, p) in STEPS:
                        new = (cost + 5, audit + "I", (*out, (FULL[x], "")))
                        q = STEPS[x, p]
                        best[q] = min(best.get(q, new), new, key=lambda c: c[:2])
        return best

    for (_, role, text), mark in zip(rows, marks):
        after = {}
        for p, (cost, audit, out) in insert(best).items():
            new = [(p, (cost + 2, audit + "D", out))]
            if mark not in ("blank", "duplicate"):
                more = 5 * (mark == "truncated")
                if (role[:1], p) in STEPS:
                    new.append((STEPS[role[:1], p], (cost + more, audit + "K", (*out, (role, text)))))
                new += [(STEPS[x, p], (cost + 1 + more, audit + "R", (*out, (FULL[x], text)))) for x in "ua" if (x, p) in STEPS]
            for q, cell in new:
                after[q] = min(after.get(q, cell), cell, key=lambda c: c[:2])
        best = after
    best = insert(best)
    return min((best[q] for q in (0, 3) if q in best), key=lambda c: c[:2])


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    marks = faults(rows)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit, out = cheapest(rows, marks)
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (
        gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost, audit,
        hashlib.sha256(text.encode()).hexdigest(),
    ), out


NAMES = [*conversations.FAULTS, "cost", "audit", "repaired_sha256"]


def made(seed, count, most):
    random.seed(seed)
    rows = []
    for conv in [None, *range(count)]:
        for turn in range(random.randrange(1, most)):
            rows.append((
                conv, random.choice([turn, turn, turn, None, 3]), random.choice(["user", "assistant", "system", "tool", "", None]),
                random.choice(["a.", "b!", "c", "", " \n", None, f"word {turn}?", f"word {turn}", "é。", "é."]), "x", "y",
            ))
    return rows


SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, audit string"


@pytest.mark.parametrize("long", [conversations.LONG, 12])
def test_repair_equals_the_plain_shortest_path(spark, long):
    rows = made(11, 60, 45)
    frame = spark.createDataFrame(rows, SCHEMA)
    groups = {}
    for conv, turn, role, text, *_ in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    want = {c: expected(r) for c, r in groups.items()}
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in conversations.repair(frame, long=long).collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    repaired = {}
    for r in conversations.repaired_rows(frame, long=long).orderBy("conv_id", "place").collect():
        assert r["place"] == len(repaired.setdefault(r["conv_id"], []))
        repaired[r["conv_id"]].append((r["role"], r["text"]))
    assert repaired == {c: list(out) for c, (_, out) in want.items() if out}


def test_charts_of_all_short_sequences():
    """Every sequence of up to three kinds of rows, against the shortest path."""
    kinds = [("user", "x.", ""), ("assistant", "x.", ""), ("system", "x.", ""), ("tool", "x", "truncated"), ("user", "x", "truncated"), ("user", "", "blank")]
    from itertools import product

    for n in (1, 2, 3):
        for rows in product(kinds, repeat=n):
            block = bytes(conversations.kind_of(r[:1], m == "blank", m == "truncated") for r, _, m in rows)
            known = conversations.parse_blocks([block])
            want = cheapest([(0, r, t) for r, t, _ in rows], [m for *_, m in rows])
            assert conversations.parse(block, known) == want[:2], rows


def test_defined_cases(spark):
    frame = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert conversations.repair(frame).count() == 0 and conversations.repaired_rows(frame).count() == 0
    gone = spark.createDataFrame([(1, 1, "user", "a.", False), (2, 1, "user", "a." * 200_000, True)], "conv_id bigint, turn bigint, role string, text string, present boolean")
    got = {r["conv_id"]: r for r in conversations.repair(gone, present="present").collect()}
    assert [got[1][n] for n in NAMES] == [0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()]
    assert got[2]["audit"] == "D" and got[2]["cost"] == 2


def test_query_equals_brute_force(spark):
    groups = {}
    for r in table(spark, SF, "conversations").collect():
        conv, turn, role, text = (" " if x is None else x for x in (r["conv_id"], r["turn"], r["role"], r["text"]))
        code = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        some = groups.setdefault(r["conv_id"], [])
        role = "user" if code == 4 else role
        text = "" if code == 1 else text.translate({ord(c): None for c in ".!?"}) if code == 2 else text
        some += [(r["turn"], role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    got = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in queries.op11(spark, SF).collect()}
    assert got == {c: expected(rows)[0] for c, rows in groups.items()}
