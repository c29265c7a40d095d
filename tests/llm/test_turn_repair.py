import hashlib
import itertools
import random
import re
import zlib

import pytest

from spokeflow.llm import registry, turn_repair
from tests import oracle

WHITE = " \t\n\x0b\x0c\r"


def harmed(rows):
    """The rows after damage, and every conversation that was there."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        elif fault == 2:
            text = re.sub("[.!?]", "", text)
        elif fault == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    return out, {r[0] for r in rows}


def judged(rows):
    """[(role, text, gone, unfinished)] of a conversation's rows in order, and its counts."""
    seen, out, counts = set(), [], [0, 0, 0]
    for _, _, role, text in rows:
        bare = text.strip(WHITE)
        fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        out.append((role, text, fault in (0, 1), fault == 2))
    turns = [t for _, t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    roles = [r[:1] for _, _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:]))
    return out, (gaps, *counts, illegal)


def tried(turns):
    """Every sequence of edits, with up to two insertions anywhere: least (cost, audit) and what it leaves."""
    best = None
    new = [("I", "user", "", 5), ("I", "assistant", "", 5)]
    between = [list(p) for n in range(3) for p in itertools.product(new, repeat=n)]
    ways = []
    for role, text, gone, unfinished in turns:
        more = 5 * unfinished
        own = [("D", None, None, 2)]
        if not gone:
            own += [("K", role, text, more), ("R", "user", text, 1 + more), ("R", "assistant", text, 1 + more)]
        ways += [between, [[o] for o in own]]
    for chosen in itertools.product(*ways, between):
        edits = [e for part in chosen for e in part]
        left = [e for e in edits if e[0] != "D"]
        if re.fullmatch("(s?(ua)+)?", "".join(e[1][:1] or "-" for e in left)):
            found = (sum(e[3] for e in edits), "".join(e[0] for e in edits), "\n".join(f"{e[1]}:{e[2]}" for e in left))
            best = found if best is None else min(best, found)
    return best


def stepped(turns):
    """The same by a table of states, turn after turn."""
    now = {"-": (0, "", ())}
    after = {"-": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def better(into, state, value):
        if state not in into or value < into[state]:
            into[state] = value

    def inserted(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a, t) in list(out.items()):
                better(out, after[s], (c + 5, a + "I", (*t, f"{name[after[s]]}:")))
        return out

    for role, text, gone, unfinished in turns:
        new = {}
        for s, (c, a, t) in inserted(now).items():
            better(new, s, (c + 2, a + "D", t))
            if not gone:
                more = 5 * unfinished
                better(new, after[s], (c + 1 + more, a + "R", (*t, f"{name[after[s]]}:{text}")))
                if role[:1] == after[s] or role[:1] == "s" and s == "-":
                    better(new, role[:1], (c + more, a + "K", (*t, f"{role}:{text}")))
        now = new
    end = inserted(now)
    cost, audit, left = min(end[s] for s in ("-", "a") if s in end)
    return cost, audit, "\n".join(left)


def brute(rows, solve):
    left, names = harmed(rows)
    out = []
    for conv in names:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        turns, counts = judged(own)
        cost, audit, text = solve(turns)
        out.append((conv, *counts, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def reported(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, head int, seq int").repartition(3)
    return sorted((tuple(r) for r in turn_repair.report(turn_repair.damaged(df), stands=turn_repair.F.col("stands"), **more).collect()), key=repr)


def conversations(r, count, longest, roles):
    texts = ["a.", "a.", "b", "c!", " \t", "", "d?\n", "é", "x" * 300 + ".", None, ".", "\x1c"]
    return [(c, t, r.choice(roles), r.choice(texts)) for c in range(count) for t in sorted(r.sample(range(longest * 2), r.randint(1, longest)))]


ROLES = ["user", "assistant", "system", "tool", "s", "", None, "User", "usher"]


def test_against_all_edits(spark):
    r = random.Random(5)
    rows = conversations(r, 60, 3, ROLES) + [(None, 0, "user", "hi."), (None, None, "user", "x."), (1000, None, None, None), (1001, 5, "user", "one.")]
    assert reported(spark, rows) == brute(rows, tried)


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_against_a_table_of_states(spark, piece):
    r = random.Random(piece)
    rows = conversations(r, 80, 9, ROLES) + conversations(r, 30, 12, ["user", "assistant"])
    rows += [(5000, t, ["user", "assistant"][t % 2 ^ (t > 200)] if t % 7 else "system", f"turn {t % 150}{'.' * (t % 5 > 0)}") for t in range(400)]
    rows += [(6000, 3, "user", "the same.")] * 150
    assert reported(spark, rows, piece=piece) == brute(rows, stepped)


def test_the_two_plain_versions_agree():
    r = random.Random(9)
    for _ in range(200):
        turns, _ = judged([(1, t, r.choice(["user", "assistant", "system", "x"]), r.choice(["a.", "b", "", "c."])) for t in range(r.randint(0, 3))])
        assert tried(turns) == stepped(turns)


def test_repaired_turns(spark):
    df = spark.createDataFrame([(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "user", "a."), (2, 0, "user", "cut")], "conv_id long, turn long, role string, text string")
    found, turns = turn_repair.repair(df)
    assert {(r.conv_id, r.cost, r.audit) for r in found.collect()} == {(1, 1, "KKR"), (2, 2, "D")}
    kept = [t for r in turns.orderBy("head", "seq").collect() for t in r.turns]
    assert [tuple(t) for t in kept] == [("K", "system", "s."), ("K", "user", "q?"), ("R", "assistant", "a.")]


def test_long_texts_and_empty_tables(spark):
    rows = [(1, 0, "user", "long " * 200_000 + "."), (1, 1, "assistant", "é" * 500_000 + "!")]
    assert reported(spark, rows) == brute(rows, stepped)
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.report(turn_repair.damaged(df), stands=turn_repair.F.col("stands")).count() == 0


def test_query_over_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted((tuple(r) for r in registry.queries()["op13_turn_repair"](spark, sf).collect()), key=repr)
    assert got == brute(rows, stepped)


def test_query_equals_its_sql(spark):
    oracle.same(registry.queries()["op13_turn_repair"](spark, oracle.SF), oracle.connection(), registry.oracle_sql()["op13_turn_repair"])
