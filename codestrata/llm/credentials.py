"""Secrets: patterns propose spans, and the cost of guessing a value tells which values of credential contexts are secrets.

The cost is that of the cheapest way to put a value together from words, dates, repeats, keyboard walks, sequences and
single characters, found by dynamic programming over its places.  Words are ranked by the corpus itself.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in output order.  The first three are the base kinds.
KINDS = ("assign", "access", "hex", "value")
BASE = KINDS[:3]
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
#: Runs are taken whole, so a least length asks for the same matches as a run that is dropped if it is shorter.
_ACCESS, _HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
_NAMES = r"pass(?:word|phrase|wd|code|wort)?|pwd|kennwort|contrase[ñÑn]a|mot\x20de\x20passe|pin|secret|token|credentials?|(?:api|access|private|secret|client|auth|signing|encryption)[_-]?(?:key|secret|token)"
#: Contexts of values: a name with a sign or a verb, a scheme of an authorization header, the second part of a URL's user.
CONTEXTS = tuple(
    re.compile(p, re.IGNORECASE | re.ASCII)
    for p in (
        rf"(?:(?<=[_-])|\b)(?:{_NAMES})[\"'`]?(?:\x20{{0,3}}(?:[:=]>?|->)|\x20(?:is|was|ist|es|est))\x20{{0,3}}[\"'`]?([^\s\"'`<>,;]+)",
        r"\b(?:bearer|basic)\x20+([A-Za-z0-9+/_.=~-]+)",
        r"://[^\s/:@]*:([^\s/@]+)@",
    )
)
#: Each match of the base pattern of assignments or of a context has one of these in small letters.
_SIGNS = ("pass", "pwd", "kennwort", "contrase", "pin", "secret", "token", "credential", "key", "bearer", "basic", "://")
#: The least length of a value, and the least cost (log10 of guesses) of one that is a secret without a base pattern.
LEAST_LENGTH, LEAST = 6, 10.0
#: The dictionary: so many words, of 3 to LONGEST letters, each in so many documents at least.
WORDS, LONGEST, LEAST_DOCS = 20_000, 20, 5
#: Longest unit of a repeat.
UNIT = 16

#: Rows of keys, and letters that digits and signs stand for.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SHIFTED = dict(zip("~!@#$%^&*()_+{}|:\"<>?", "`1234567890-=[]\\;',./", strict=True))
LEET = {"4": "a", "@": "a", "8": "b", "3": "e", "6": "g", "1": "i", "!": "i", "0": "o", "5": "s", "$": "s", "7": "t", "2": "z"}
#: Words that come before those of the corpus.
COMMON = "password qwerty letmein welcome admin changeme secret default guest master root login user test hello dragon monkey sunshine football iloveyou".split()

#: Guesses (log10) of a character by its class, of another segment, of a year, of a day of a year, of a separator.
_DIGIT, _LETTER, _OTHER, _SEGMENT, _YEAR, _DAY, _BETWEEN = 1.0, math.log10(26), math.log10(33), math.log10(2), math.log10(150), math.log10(365), math.log10(4)
#: Guesses of where a walk begins, and of each turn of it or step of a sequence.
_START, _TURN = math.log10(47), math.log10(6)

_AT = {key: (x, y) for y, row in enumerate(ROWS) for x, key in enumerate(row)}
#: A row's keys lie half a key to the right of those above, so a key has six neighbours.
_STEPS = ((-1, 0), (1, 0), (0, -1), (1, -1), (0, 1), (-1, 1))
_DATES = (
    (re.compile(r"(?=((?:19|20)\d\d([-/._ ])(?:0?[1-9]|1[0-2])\2(?:0?[1-9]|[12]\d|3[01])))"), _YEAR + _DAY + _BETWEEN),
    (re.compile(r"(?=((?:0?[1-9]|[12]\d|3[01])([-/._ ])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d))"), _YEAR + _DAY + _BETWEEN),
    (re.compile(r"(?=((?:19|20)\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])))"), _YEAR + _DAY),
    (re.compile(r"(?=((?:0[1-9]|[12]\d|3[01])(?:0[1-9]|1[0-2])(?:19|20)\d\d))"), _YEAR + _DAY),
    (re.compile(r"(?=((?:19|20)\d\d))"), _YEAR),
)


def _character(c: str) -> float:
    return _DIGIT if c.isdigit() else _LETTER if c.isalpha() else _OTHER


def _words(value: str, ranks: Mapping[str, int]) -> Iterator[tuple[int, int, float, str]]:
    """Words as they are, backwards, or with digits for letters; capitals and such digits cost a guess of two each, all capitals one."""
    low = value.lower() if len(value.lower()) == len(value) else value
    told = "".join(LEET.get(c, c) for c in low)
    for i in range(len(value)):
        for j in range(i + 3, min(i + LONGEST, len(value)) + 1):
            word = told[i:j]
            rank, back = ranks.get(low[i:j]) or ranks.get(word), ranks.get(word[::-1])
            if not (rank or back) or word.isdigit():
                continue
            shown = value[i:j]
            capitals = sum(c.isupper() for c in shown)
            signs = sum(a != b for a, b in zip(low[i:j], word, strict=True))
            spelt = (_SEGMENT if capitals in (1, len(shown)) and shown[0].isupper() else capitals * _SEGMENT) + signs * _SEGMENT
            yield i, j, min(math.log10(r + 1) + extra for r, extra in ((rank, 0.0), (back, _SEGMENT)) if r) + spelt, "word"


def _dates(value: str) -> Iterator[tuple[int, int, float, str]]:
    for pattern, cost in _DATES:
        for m in pattern.finditer(value):
            yield m.start(1), m.end(1), cost, "date"


def _runs(value: str) -> Iterator[tuple[int, int, float, str]]:
    """Keyboard walks and sequences of codes, each as long as it goes: three characters or more."""
    keys = [SHIFTED.get(c, c.lower()) for c in value]
    place = [_AT.get(k) for k in keys]
    steps = [None if a is None or b is None or (d := (b[0] - a[0], b[1] - a[1])) not in _STEPS else d for a, b in zip(place, place[1:], strict=False)]
    ups = [ord(b) - ord(a) if a.isalnum() and b.isalnum() and abs(ord(b) - ord(a)) == 1 else None for a, b in zip(value, value[1:], strict=False)]
    for way, name in ((steps, "walk"), (ups, "sequence")):
        i = 0
        while i < len(way):
            j = i
            while j < len(way) and way[j] is not None and (name == "walk" or way[j] == way[i]):
                j += 1
            if j - i >= 2:
                turns = sum(a != b for a, b in zip(way[i : j - 1], way[i + 1 : j], strict=True))
                yield i, j + 1, _START + math.log10(j + 1 - i) + (turns + 1) * _TURN if name == "walk" else _START + math.log10(j + 1 - i), name
            i = max(j, i + 1)


def _repeats(value: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, length of the unit) of units that follow each other at least twice (single characters: three times), as often as they do."""
    n = len(value)
    for unit in range(1, min(UNIT, n // 2) + 1):
        i = 0
        while i + unit < n:
            j = i
            while j + unit < n and value[j] == value[j + unit]:
                j += 1
            times = (j - i) // unit + 1
            if times >= (3 if unit == 1 else 2):
                yield i, i + times * unit, unit
            i = j + 1


def guess_cost(value: str, ranks: Mapping[str, int], repeats: bool = True) -> tuple[float, str]:
    """(log10 of guesses, segments) of the cheapest way to put ``value`` together; work grows with its length.

    Each segment but the first costs a guess of two for where it begins; characters next to each other that nothing
    explains are one segment of brute force.  An empty value costs nothing.  Ties go to the segment that is found first.
    """
    n = len(value)
    ending: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i, j, cost, name in (*_words(value, ranks), *_dates(value), *_runs(value)):
        ending[j].append((i, cost, name))
    if repeats:
        units: dict[str, float] = {}
        for i, j, unit in _repeats(value):
            own = value[i : i + unit]
            if own not in units:
                units[own] = guess_cost(own, ranks, False)[0]
            ending[j].append((i, units[own] + math.log10((j - i) // unit), "repeat"))
    # Two states of a place: its last segment is done, or is one of brute force that may go on.
    done: list[tuple[float, int, str, bool]] = [(0.0, 0, "", False)]
    brute: list[tuple[float, int, bool]] = [(math.inf, 0, False)]
    for j in range(1, n + 1):
        price = _character(value[j - 1])
        opened = (done[j - 1][0] + (_SEGMENT if j > 1 else 0.0) + price, j - 1, False)
        brute.append(min(opened, (brute[j - 1][0] + price, j - 1, True), key=lambda x: x[0]))
        best = (math.inf, 0, "", False)
        for i, cost, name in ending[j]:
            for before, from_brute in ((done[i][0], False), (brute[i][0], True)):
                way = before + cost + (_SEGMENT if i else 0.0)
                if way < best[0]:
                    best = (way, i, name, from_brute)
        done.append(best)
    told, j, in_brute = [], n, brute[n][0] < done[n][0]
    cost = min(brute[n][0], done[n][0])
    while j > 0:
        if in_brute:
            end = j
            while brute[j][2]:
                j = brute[j][1]
            j = brute[j][1]
            told.append(f"brute {end - j}")
            in_brute = False
        else:
            _, i, name, in_brute = done[j]
            told.append(f"{name} {j - i}")
            j = i
    return cost, "+".join(reversed(told))


def _signed(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _SIGNS)


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, start and end of the value) of the base kinds; a match that is too short is passed by as a whole."""
    found = [(m.start(), 0, m.end(), m.start(1), m.end(1)) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_LENGTH] if _signed(text) else []
    return found + [(m.start(), k, m.end(), m.start(), m.end()) for k, pattern in ((1, _ACCESS), (2, _HEX)) for m in pattern.finditer(text)]


def secrets_of(text: str | None, ranks: Mapping[str, int], least: float = LEAST) -> list[dict]:
    """Spans (s, k, e, kind, guesses, segments) of a text, by start and then kind."""
    if not text:
        return []
    spans, held = base_spans(text), []
    for m in (m for c in CONTEXTS for m in c.finditer(text)) if _signed(text) else ():
        s, e = m.span(1)
        e -= len(m[1]) - len(m[1].rstrip(".!?:)]}"))
        held.append((s, 3, e, s, e))
    spans.sort()
    # Values of contexts that a base span has are told by it; of those that overlap each other the first and longest stays.
    reach, at, last, own = 0, 0, 0, []
    for x in sorted(held, key=lambda x: (x[0], -x[2])):
        while at < len(spans) and spans[at][0] <= x[0]:
            reach, at = max(reach, spans[at][2]), at + 1
        if x[2] - x[0] >= LEAST_LENGTH and x[0] >= max(last, reach) and not (at < len(spans) and spans[at][0] < x[2]):
            own.append(x)
            last = x[2]
    out = []
    for s, k, e, v, w in [*spans, *own]:
        guesses, segments = guess_cost(text[v:w], ranks)
        if k < len(BASE) or guesses >= least:
            out.append({"s": s, "k": k, "e": e, "kind": KINDS[k], "guesses": round(guesses, 2), "segments": segments})
    return sorted(out, key=lambda x: (x["s"], x["k"]))


def dictionary(df: DataFrame, text_col: str = "text", words: int = WORDS) -> dict[str, int]:
    """Ranks of the most usual words, from 1: COMMON, then the words (runs of letters, in small letters) of most documents, ties by word.

    All documents count; ``words`` bounds what comes to the driver and goes to each task.
    """
    own = F.array_distinct(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`").cast("string")), F.lit(rf"(?<!\p{{L}})\p{{L}}{{3,{LONGEST}}}+(?!\p{{L}})"), F.lit(0)))
    counted = df.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_DOCS)
    top = [r.word for r in counted.orderBy(F.desc("n"), "word").limit(words).collect()]
    return {w: i for i, w in reversed(list(enumerate([*COMMON, *top], 1)))}


def find_secrets(df: DataFrame, text_col: str = "text", spans_col: str = "spans", ranks: Mapping[str, int] | None = None) -> DataFrame:
    """Add ``spans_col`` to each row: spans (s, k, e, kind, guesses, segments), by start and then kind.

    s and e count code points, e is exclusive.  Base spans are whole matches and stay however cheap their value is to
    guess; ``value`` spans are values of wider credential contexts that cost LEAST or more.  ``guesses`` is a power of
    ten, ``segments`` the cheapest segmentation.  ``ranks`` are words' ranks; without them the rows' own words are ranked.

    Nulls: a null or empty text has none.  Rows, their other columns and repeated rows stay as they are, whatever their
    names; a column called ``spans_col`` is replaced.  An empty table gives no rows.
    """
    known = df.sparkSession.sparkContext.broadcast(dictionary(df, text_col) if ranks is None else dict(ranks))  # WORDS words at most
    kind = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("e", pa.int32()), ("kind", pa.string()), ("guesses", pa.float64()), ("segments", pa.string())]))

    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([secrets_of(x.as_py(), known.value) for x in column], kind)

    spans = F.arrow_udf(find, "array<struct<s:int,k:int,e:int,kind:string,guesses:double,segments:string>>")
    kept = [F.col(f"`{c}`") for c in df.columns if c != spans_col]
    return df.select(*kept, spans(F.col(f"`{text_col}`").cast("string")).alias(spans_col))
