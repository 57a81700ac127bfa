"""Conversation repair against a plain search for the cheapest edits, and against every edit sequence of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from codestrata.llm import conversations as cv

KEYS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
SHOWN = re.compile(r"[^\x20\x09-\x0D]")
STATES = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = SHOWN.findall(text)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def insertions(ways):
    """(cost, audit, rows) of each state, with whole strings."""
    for _ in range(4):
        for state, (cost, audit, rows) in list(ways.items()):
            for role in "ua":
                to = STATES[state].get(role)
                if to and (to not in ways or (cost + 2, audit + "I") < ways[to][:2]):
                    ways[to] = (cost + 2, audit + "I", rows + [("user" if role == "u" else "assistant", "")])
    return ways


def plain(rows):
    """The report of rows in order: (turn, role, text)."""
    found = faults(rows)
    ways = insertions({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, found, strict=True):
        after = {}
        for state, (cost, audit, done) in ways.items():
            edits = [("D", state, 3, [])]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                edits += [("K", STATES[state].get(role[:1]), more, [(role, text)])]
                edits += [("R", STATES[state].get(r), 2 + more, [("user" if r == "u" else "assistant", text)]) for r in "ua"]
            for edit, to, price, new in edits:
                if to is not None and (to not in after or (cost + price, audit + edit) < after[to][:2]):
                    after[to] = (cost + price, audit + edit, done + new)
        ways = insertions(after)
    cost, audit, done = min(ways[s] for s in ("", "a") if s in ways)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    told = "\n".join(f"{r}:{t}" for r, t in done)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *[found.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(told.encode()).hexdigest())


def every(rows):
    """The cheapest (cost, audit) of all edit sequences, by trying them."""
    found, best = faults(rows), None
    options = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in found]
    gaps = [p for n in range(3) for p in itertools.product("ua", repeat=n)]
    for edits in itertools.product(*options):
        for between in itertools.product(gaps, repeat=len(rows) + 1):
            told, audit, cost = "".join(between[0]), "I" * len(between[0]), 2 * len(between[0])
            for (_, role, _), fault, edit, more in zip(rows, found, edits, between[1:], strict=True):
                told += {"D": "", "K": role[:1] or "x"}.get(edit, edit[-1]) + "".join(more)
                audit += edit[0] + "I" * len(more)
                cost += {"D": 3, "K": 0}.get(edit, 2) + (edit != "D" and fault == "truncated") + 2 * len(more)
            if re.fullmatch("(s?(ua)+)?", told) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def in_order(rows):
    space = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(space, key=lambda x: (x[0] is not None, x[0] or 0, key(*x[1:])))


def check(spark, talks, parts=None):
    df = spark.createDataFrame([(c, *r, 1, "x") for c, rows in talks.items() for r in rows], "conv_id long, turn long, role string, text string, audit int, place string")
    found = {r.conv_id: tuple(r[k] for k in KEYS) for r in cv.report(df).collect()}
    assert found == {c: plain(in_order(rows)) for c, rows in talks.items()}


def random_talk(rng, n):
    roles, texts = ["user", "assistant", "system", "tool", None, "", "u"], ["Fine.", "so", "", " \n", None, "What? ", "x!", "é"]
    return [(rng.choice([None, i, i, i + rng.randrange(3)]), rng.choice(roles[: rng.choice([2, 3, 7])]), rng.choice(texts) if rng.random() < 0.5 else f"text {rng.randrange(40)}.") for i in range(n)]


def test_plain_version_is_the_least_of_all():
    rng = random.Random(3)
    for _ in range(60):
        rows = in_order(random_talk(rng, rng.randrange(4)))
        assert plain(rows)[5:7] == every(rows)


@pytest.mark.parametrize("piece", [64 << 20, 400])
def test_equals_plain_version(spark, monkeypatch, piece):
    """Also where conversations are cut into many ranges."""
    monkeypatch.setattr(cv, "PIECE", piece)
    rng = random.Random(11)
    talks = {i: random_talk(rng, rng.randrange(1, 9)) for i in range(40)} | {100: random_talk(rng, 120), None: random_talk(rng, 60), 101: [(3, "user", "Same.")] * 30}
    check(spark, talks)


def test_long_neutral_stretches(spark, monkeypatch):
    """Rows of other roles leave several ways open for long."""
    monkeypatch.setattr(cv, "PIECE", 300)
    check(spark, {1: [(i, "tool", f"t{i}.") for i in range(90)], 2: [(i, "system", f"t{i}") for i in range(91)], 3: [(i, "user" if i % 2 else "tool", f"{i}?") for i in range(77)]})


def test_planted_damage(spark):
    rng = random.Random(5)
    talks = {i: [(t, "system" if t == 0 and i % 3 == 0 else "user" if t % 2 else "assistant", f"Line {rng.randrange(5)}. So?") for t in range(rng.randrange(1, 7))] for i in range(150)}
    talks |= {None: [(None, None, None), (1, "user", "a.")], 7000: [(None, "user", "Hm.")]}
    rows = [(c, *r) for c, own in talks.items() for r in own]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    wanted = {}
    for conv, own in talks.items():
        after = []
        for turn, role, text in own:
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = ("user" if kind == 4 else " " if role is None else role), ("" if kind == 1 else " " if text is None else text)
            after += [(turn, role, re.sub("[.!?]", "", text) if kind == 2 else text)] * {0: 0, 3: 2}.get(kind, 1)
        wanted[conv] = plain(in_order(after))
    found = {r.conv_id: tuple(r[k] for k in KEYS) for r in cv.report(*cv.damaged(df)).collect()}
    assert found == wanted


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cv.report(empty).collect() == []
    one = spark.createDataFrame([(1, 1, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r[k] for k in KEYS) for r in cv.report(one, F.lit(0)).collect()] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_rows(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = cv.repaired(df, cv.audit_conversations(df)).orderBy("place").collect()
    # A delete and an insert cost more than a role that is changed.
    assert [tuple(r) for r in found] == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Again.")]
