"""Conversation repair: the cheapest edits that make a conversation's roles a system turn, if any, and pairs of user and assistant.

Edits come from a forward Viterbi pass over four grammar states that carries the least (cost, audit string) of each.  A
conversation isn't bound to a task: rows are dealt by ranges of (conversation, turn), a task solves the fragments in its
range from each state that they may begin in, and fragments are joined by costs and audit strings alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, pieces

#: States: nothing yet, after a system turn, after a user's, after an assistant's; those a conversation may end in.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (EMPTY, ASSISTANT)
#: Where a role (by its initial) leads from each state.
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
#: Costs of edits, and what a truncated row that stays adds.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Faults of a row; the first two must go.
BLANK, COPY, OPEN, FINE = "blank", "duplicate", "truncated", ""
#: Bytes of conversations for a range.
PIECE = 64 << 20

_REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_FRAGMENT = "edge boolean, least long, most long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, first_turn long, first_digest string, ways array<struct<start:int,end:int,cost:long,audit:string>>"


def _closed(found: dict[int, tuple]) -> tuple:
    """Each state's least (cost, rank of its audit up to the last row, state then, inserts since): up to three inserts lead anywhere."""
    for _ in range(3):
        for state, (cost, rank, base, inserts) in list(found.items()):
            for role in ROLES:
                to = NEXT[state].get(role)
                way = (cost + INSERT, rank, base, inserts + "I")
                if to is not None and (to not in found or way < found[to]):
                    found[to] = way
    least = min(x[0] for x in found.values())
    return tuple((found[s][0] - least, *found[s][1:]) if s in found else None for s in range(4)), least


@lru_cache(maxsize=1 << 16)
def _step(layer: tuple, initial: str, fault: str) -> tuple:
    """The layer after a row, what it costs, and for each state the one before with the edits since.

    Audits up to a row end in that row's edit, so none is the beginning of another, and ranks order them whatever
    follows: a layer needs no more than ranks to compare audit strings, and there are few distinct layers.
    """
    best: dict[int, tuple] = {}
    for state, way in enumerate(layer):
        if way is None:
            continue
        cost, rank, base, inserts = way
        edits = [("D", state, DELETE)]
        if fault not in (BLANK, COPY):
            more = TRUNCATED if fault == OPEN else 0
            edits += [("K", NEXT[state].get(initial), KEEP + more)] + [("R", NEXT[state].get(r), REROLE + more) for r in ROLES]
        for edit, to, price in edits:
            if to is not None and (to not in best or (cost + price, rank, inserts + edit) < best[to][:3]):
                best[to] = (cost + price, rank, inserts + edit, base)
    order = sorted({x[1:3] for x in best.values()})
    ranked = {s: (x[0], order.index(x[1:3]), s, "") for s, x in best.items()}
    return (*_closed(ranked), tuple((best[s][3], best[s][2]) if s in best else None for s in range(4)))


class _Run:
    """A fragment's pass from one state; None is a conversation's beginning."""

    def __init__(self, start: int | None):
        self.start, self.cost, self.back = start, 0, []
        self.layer = _closed({EMPTY: (0, 0, EMPTY, "")})[0] if start is None else tuple((0, 0, s, "") if s == start else None for s in range(4))

    def take(self, initial: str, fault: str) -> None:
        self.layer, more, back = _step(self.layer, initial, fault)
        self.cost += more
        self.back.append(back)

    def way(self, end: int) -> tuple | None:
        """(start, end, cost, audit) of the least way to a state."""
        if self.layer[end] is None:
            return None
        cost, _, state, inserts = self.layer[end]
        told = [inserts]
        for back in reversed(self.back):
            state, edits = back[state]
            told.append(edits)
        return (-1 if self.start is None else self.start, end, self.cost + cost, "".join(reversed(told)))


class _Fragment:
    """The rows of one conversation in one range, in order."""

    def __init__(self, conv, turn, digest, edge: bool):
        self.conv, self.edge, self.first = conv, edge, (turn, digest)
        self.runs = [_Run(s) for s in range(4)] if edge else [_Run(None)]
        self.turns, self.least, self.most = 0, None, None
        self.faults = {BLANK: 0, COPY: 0, OPEN: 0}
        self.illegal, self.head, self.tail = 0, None, None

    def take(self, turn: int | None, initial: str, fault: str) -> None:
        if turn is not None and turn != self.most:
            self.turns, self.most = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        if fault:
            self.faults[fault] += 1
        self.illegal += self.tail is not None and self.tail + initial not in LEGAL
        self.head, self.tail = self.head or initial, initial
        for run in self.runs:
            run.take(initial, fault)

    def told(self, last: bool) -> dict:
        edge = self.edge or last
        ways = [w for run in self.runs for end in range(4) if (w := run.way(end))] if edge else [min((w for end in ENDS if (w := self.runs[0].way(end))), key=lambda w: w[2:])]
        return {
            "conv_id": self.conv, "edge": edge, "least": self.least, "most": self.most, "turns": self.turns, "blank": self.faults[BLANK], "duplicate": self.faults[COPY], "truncated": self.faults[OPEN], "illegal": self.illegal,
            "head": self.head, "tail": self.tail, "first_turn": self.first[0], "first_digest": self.first[1], "ways": [dict(zip(("start", "end", "cost", "audit"), w, strict=True)) for w in ways],
        }


def _plain(values: pd.Series) -> list:
    """Whole numbers with None for nulls: a nullable integer column comes as floats or as objects."""
    return [None if v is None or v is pd.NA or v != v else int(v) for v in values]


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    open_one: _Fragment | None = None
    first = True
    for pdf in batches:
        done = []
        for conv, turn, digest, initial, fault, later, copies in zip(_plain(pdf["conv_id"]), _plain(pdf["turn"]), pdf["digest"], pdf["initial"], pdf["fault"], pdf["later"], pdf["copies"], strict=True):
            if open_one is None or open_one.conv != conv:
                if open_one is not None:
                    done.append(open_one.told(False))
                open_one, first = _Fragment(conv, turn, digest, first), False
            for copy in range(int(copies)):
                open_one.take(turn, initial, fault if fault == BLANK else COPY if later or copy else fault)
        if done:
            yield _frame(done)
    if open_one is not None:
        yield _frame([open_one.told(True)])


def _frame(rows: list[dict]) -> pd.DataFrame:
    pdf = pd.DataFrame(rows)
    for c in ("conv_id", "least", "most", "first_turn"):
        pdf[c] = pdf[c].astype("Int64")
    return pdf


def _join(pdf: pd.DataFrame) -> pd.DataFrame:
    """A conversation's fragments as one: ways follow each other from state to state."""
    turn, least, most = (_plain(pdf[c]) for c in ("first_turn", "least", "most"))
    order = sorted(range(len(pdf)), key=lambda i: (turn[i] is not None, turn[i] or 0, pdf["first_digest"].iloc[i] or ""))
    at = {s: way for s, way in ((EMPTY, (0, "")), (USER, (INSERT, "I")), (ASSISTANT, (2 * INSERT, "II")))}
    illegal, turns, tail, end_turn = 0, 0, None, None
    for i in order:
        row, reached = pdf.iloc[i], {}
        for w in row["ways"]:
            before = (0, "") if w["start"] < 0 else at.get(w["start"])
            if before is not None:
                way = (before[0] + w["cost"], before[1] + w["audit"])
                reached[w["end"]] = min(way, reached.get(w["end"], way))
        at = reached
        illegal += row["illegal"] + (tail is not None and row["head"] is not None and tail + row["head"] not in LEGAL)
        turns += row["turns"] - (end_turn is not None and end_turn == least[i])
        tail, end_turn = row["tail"] or tail, most[i] if most[i] is not None else end_turn
    cost, audit = min(at[s] for s in ENDS if s in at)
    whole = [x for x in least + most if x is not None]
    gaps = max(whole) - min(whole) + 1 - turns if whole else 0
    told = {"conv_id": pdf["conv_id"].iloc[:1].astype("Int64"), "gaps": gaps, **{c: pdf[c].sum() for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit}
    return pd.DataFrame({k: v if k == "conv_id" else [v] for k, v in told.items()})


def _lines(df: DataFrame, copies: Column) -> DataFrame:
    """Rows with their fault as far as a row alone tells it, and a digest of role and text; a null role or text is one space."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    own = df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.cast("long").alias("copies"))
    shown, ended = F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*\z"))
    fault = F.when(~shown, BLANK).when(~ended, OPEN).otherwise(FINE)
    return own.select("*", fault.alias("fault"), F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest"), F.substring("role", 1, 1).alias("initial"))


def audit_conversations(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation of (conv_id, turn, role, text).

    ``copies`` says how often a row is there, adjacently (once, if not given); with 0 it is gone, but its conversation is
    known.  Rows go by turn, nulls first; different rows of one turn go by a digest of role and text, so reruns agree.

    Audits name the edits in order: Keep, Rerole, Delete, Insert.  Nulls: a null role or text is one space, so such a
    text is blank; a null turn is no turn; null ids are one conversation.  Repeated rows are duplicates.  A conversation
    without rows has zeros and an empty audit; an empty table gives no rows.  Other columns aren't read.
    """
    lines = _lines(df, F.lit(1) if copies is None else copies)
    gone = F.col("copies") <= 0
    blank = lambda c: F.when(gone, None).otherwise(F.col(c))
    # Equal rows of a turn become one with a count before anything is dealt; rows that are gone are one for a conversation.
    rows = lines.groupBy("conv_id", blank("turn").alias("turn"), blank("digest").alias("digest"), blank("initial").alias("initial"), blank("fault").alias("fault")).agg(F.sum(F.greatest("copies", F.lit(0))).alias("copies"))
    known = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    firsts = rows.filter("copies > 0").groupBy("conv_id", "digest").agg(F.count("*").alias("n"), F.min(known).alias("first")).filter("n > 1").select(F.col("conv_id").alias("_conv"), F.col("digest").alias("_digest"), "first.turn", F.lit(True).alias("again")).withColumnRenamed("turn", "_turn")
    told = rows.join(firsts, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("digest") == F.col("_digest")), "left")
    later = F.coalesce(F.col("again"), F.lit(False)) & ~F.col("turn").eqNullSafe(F.col("_turn"))
    order = ["conv_id", "turn", "digest"]
    dealt = told.select(*order, "initial", "fault", later.alias("later"), "copies").repartitionByRange(pieces(df, PIECE, "text"), *order).sortWithinPartitions(*order)
    found = cut(dealt.mapInPandas(_solve, f"conv_id long, {_FRAGMENT}"))
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0))
    inside = found.filter("NOT edge").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("ways")[0]["cost"].alias("cost"), F.col("ways")[0]["audit"].alias("audit"))
    # Two fragments of a range at most, the first and the last, may go on in another one.
    return inside.unionByName(found.filter("edge").groupBy("conv_id").applyInPandas(_join, f"conv_id long, {_REPORT}"))


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    audit, at, state, place, conv = "", 0, EMPTY, 0, None

    def inserted(out: list) -> None:
        nonlocal at, state, place
        while at < len(audit) and audit[at] == "I":
            role = "a" if state == USER else "u"
            out.append((conv, place, "I", ROLES[role], ""))
            at, place, state = at + 1, place + 1, NEXT[state][role]

    for pdf in batches:
        out: list[tuple] = []
        for own, plan, role, text, copies in zip(_plain(pdf["conv_id"]), pdf["audit"], pdf["role"], pdf["text"], pdf["copies"], strict=True):
            if plan is not None:
                audit, at, state, place, conv = plan, 0, EMPTY, 0, own
                inserted(out)
                continue
            for _ in range(int(copies)):
                edit, at = audit[at], at + 1
                if edit != "D":
                    initial = role[:1] if edit == "K" else "a" if state == USER else "u"
                    out.append((conv, place, edit, role if edit == "K" else ROLES[initial], text))
                    place, state = place + 1, NEXT[state][initial]
                inserted(out)
        frame = pd.DataFrame(out, columns=["conv_id", "place", "edit", "role", "text"])
        yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))


def repaired(df: DataFrame, audits: DataFrame, copies: Column | None = None) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows that stay or are inserted, in order within a conversation.

    ``audits`` is what ``audit_conversations`` gave for the same rows.  Audits come before the rows that they are for, so
    a task streams through rows and holds one audit at a time; conversations lie in one task each, in order of place.
    """
    lines = _lines(df, F.lit(1) if copies is None else copies).filter("copies > 0")
    rows = lines.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "digest", "role", "text", "copies")
    plans = audits.select("conv_id", "audit", F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit(0).cast("long"))
    order = [F.col("conv_id"), F.col("audit").isNull(), F.col("turn"), F.col("digest")]
    both = rows.union(plans).repartition(pieces(df, PIECE, "text"), "conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "audit", "role", "text", "copies").mapInPandas(_repair, "conv_id long, place long, edit string, role string, text string")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    conv, state, any_row = None, None, False
    for pdf in batches:
        out = []
        for own, place, role, text in zip(_plain(pdf["conv_id"]), pdf["place"], pdf["role"], pdf["text"], strict=True):
            if place == 0:
                if any_row:
                    out.append((conv, state.hexdigest()))
                conv, state, any_row = own, hashlib.sha256(), True
            else:
                state.update(b"\n")
            state.update(f"{role}:{text}".encode())
        frame = pd.DataFrame(out, columns=["conv_id", "repaired_sha256"])
        yield frame.assign(conv_id=frame["conv_id"].astype("Int64"))
    if any_row:
        yield pd.DataFrame({"conv_id": pd.array([conv], "Int64"), "repaired_sha256": [state.hexdigest()]})


def repaired_digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of what ``repaired`` gave: SHA-256 of the lines ``role:text``, row after row."""
    return rows.select("conv_id", "place", "role", "text").mapInPandas(_digests, "conv_id long, repaired_sha256 string")


def report(df: DataFrame, copies: Column | None = None) -> DataFrame:
    """``audit_conversations`` with the digest of the repaired conversation; that of an empty one is of no bytes."""
    audits = cut(audit_conversations(df, copies))
    digests = repaired_digests(repaired(df, audits, copies)).withColumnRenamed("conv_id", "_conv")
    return audits.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv").withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)))


def damaged(df: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with planted damage, and how often each row is there: a checksum of ``conv_id:turn`` modulo 20 decides.

    0 drops a row, 1 empties its text, 2 takes its sentence ends away, 3 doubles it, 4 makes it a user's; nulls are one space.
    """
    conv, turn, role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text"))
    kind = (F.crc32(F.encode(F.concat(conv, F.lit(":"), turn), "utf-8")) % 20).alias("kind")
    rows = df.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind)
    told = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"), "kind")
    return told, F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
