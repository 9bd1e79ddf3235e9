import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
import xxhash

from seqlab.llm import repair as R


def least(rows):
    """Brute force: (cost, audit) by a table over (row, state) of least (cost, audit); rows: [(initial, fault)]"""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}

    def inserted(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                for x in "ua":
                    t = step.get((s, x))
                    if t is not None and (t not in best or (c + 5, a + "I") < best[t]):
                        best[t] = (c + 5, a + "I")
        return best

    best = inserted({0: (0, "")})
    for initial, fault in rows:
        new = {}
        for s, (c, a) in best.items():
            options = [(s, c + 2, a + "D")]
            if fault not in (1, 2):
                extra = 5 if fault == 3 else 0
                options += [(step.get((s, initial)), c + extra, a + "K")]
                options += [(step.get((s, x)), c + extra + 1, a + "R") for x in "ua"]
            for t, cost, audit in options:
                if t is not None and (t not in new or (cost, audit) < new[t]):
                    new[t] = (cost, audit)
        best = inserted(new)
    return min(best[s] for s in (0, 3) if s in best)


def signed(text):
    h = xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def expected(rows):
    """The contract in plain Python; rows: [(conv_id, turn, role, text)]"""
    out, convs = [], {r[0] for r in rows}
    after = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        after += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    for conv in convs:
        mine = sorted([r for r in after if r[0] == conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], signed(r[3])))
        seen, faults = set(), []
        for _, _, role, text in mine:
            bare = text.strip(" \t\n\x0b\f\r")
            faults.append(1 if not bare else 2 if (role, text) in seen else 0 if bare[-1] in ".!?" else 3)
            seen.add((role, text))
        cost, audit = least([(r[2][:1], f) for r, f in zip(mine, faults)])
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        fixed, left, text = "", iter(mine), []
        for e in audit:
            need = "a" if fixed.endswith("u") else "u"
            row = ({"u": "user", "a": "assistant"}[need], "") if e == "I" else next(left)[2:]
            if e != "D":
                row = ({"u": "user", "a": "assistant"}[need], row[1]) if e == "R" else row
                fixed += row[0][:1]
                text.append(":".join(row))
        assert re.fullmatch("(s?(ua)+)?", fixed), (audit, fixed)
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count(1), faults.count(2), faults.count(3),
                    sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                    hashlib.sha256("\n".join(text).encode()).hexdigest()))
    return Counter(out)


COLS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def check(df):
    got = R.op12_conversation_repair(df)
    assert got.columns == COLS
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in df.collect()]
    assert Counter(map(tuple, got.collect())) == expected(rows)


def test_given_table(spark):
    check(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet"))


def test_odd_rows(spark):
    names = "conv_id long, turn long, role string, text string, kind int, audit string, h1 long"
    rows = [(c, t, role, text, 1, "x", 2) for c in (1, 2, None) for t in (None, 0, 3, 9)
            for role, text in ((None, None), ("user", ""), ("", "No initial."), ("system", "Rule."), ("usher", "Begins with u.\x00"))]
    rows += [(5, 1, "user", "Same row."), (5, 1, "user", "Same row."), (6, None, "user", "Only null turns."), (7, 0, "tool", "Cut off"),
             (8, 1, "user", "é ?"), (9, 0, "assistant", "w " * 300_000 + ".")]
    rows = [r + (1, "x", 2) if len(r) == 4 else r for r in rows]
    df = spark.createDataFrame(rows, names)
    check(df)
    check(df.where("false"))
    # a conversation whose only row the damage drops
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert tuple(R.op12_conversation_repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")).first()) == (
        gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("n", [0, 1, 2, 5, 9, 40])
def test_search_is_cheapest_and_least(n):
    rng = random.Random(n)
    for _ in range(60):
        rows = [(rng.choice("suasua x"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
        initials, faults = "".join(r[0] for r in rows), [r[1] for r in rows]
        assert R.search(initials, faults, 0, R.ACCEPTING, True) == least(rows)
        for piece in (1, 2, 3, 7):  # the same from pieces
            assert R.cheapest(initials, faults, piece) == least(rows), (rows, piece)


def test_long_conversation(spark):
    rng = random.Random(7)
    rows = [(rng.choice("uuaas"), rng.choice([0, 0, 0, 0, 0, 1, 2, 3])) for _ in range(3000)]
    assert R.cheapest("".join(r[0] for r in rows), [r[1] for r in rows]) == least(rows)
    df = spark.range(4000).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'assistant', 'user') as role", "concat('Text ', id, '.') as text")
    check(df)


def test_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "There."), (1, 2, "system", " "), (2, 5, "system", "Alone.")],
                               "conv_id long, turn long, role string, text string")
    got = sorted(map(tuple, R.repaired_conversations(df).collect()))
    assert got == [(1, 0, "user", "Hi."), (1, 1, "assistant", "There.")]
