"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.  DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import spare

#: Kinds in output order.  The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]

#: A run is entered at its start only, and loops are possessive: that keeps matching linear on long runs and free of
#: recursion, and gives the leftmost matches of the plain patterns, since what follows a run decides alone.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])(?=[0-9](?:[\x20-]?[0-9]){11})[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
}
#: Score of a confirmed span without context, and the words that raise it by CONTEXT.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
WORDS = {
    "email": "mail|contact|write to",
    "ip": "\\bip\\b|address|host|server",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "ssn": "ssn|social security|tax id",
}
CONTEXT = 0.3
#: Words that lower a score by CONTEXT: what stands next to numbers of other kinds.
OTHER = {
    "email": "example",
    "ip": "version|release|section|chapter",
    "card": "order|invoice|serial|tracking|isbn",
    "phone": "order|invoice|serial|tracking|isbn",
    "iban": "serial|tracking|licen[cs]e",
    "ssn": "order|invoice|serial|tracking|part no",
}
#: Code points looked at on either side of a span, and the least score of an added (not base) span.
REACH, LEAST = 40, 0.5
#: Code points of a chunk: any stretch of a text is cut out of the chunks it touches, not out of the whole text.
CHUNK = 1024

MARK, PLAIN = "", "�"

_LUHN = """aggregate(sequence(1, length(d)), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN cast(substring(d, length(d) - i + 1, 1) AS int)
    ELSE (2 * cast(substring(d, length(d) - i + 1, 1) AS int)) - IF(cast(substring(d, length(d) - i + 1, 1) AS int) > 4, 9, 0) END) % 10 = 0"""
_MOD97 = """aggregate(sequence(1, length(d)), 0, (a, i) -> CASE WHEN substring(d, i, 1) < 'A' THEN (a * 10 + cast(substring(d, i, 1) AS int)) % 97
    ELSE (a * 100 + ascii(substring(d, i, 1)) - 55) % 97 END) = 1"""
_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"
#: SQL conditions on a proposed span x (s, e, t).
VALID = {
    "email": "true",
    "ip": "forall(split(x.t, '[.]'), p -> coalesce(try_cast(nullif(trim(LEADING '0' FROM p), '') AS int), IF(trim(LEADING '0' FROM p) = '', 0, 256)) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 12 AND 19 AND exists(array({_DIGITS}), d -> {_LUHN})",
    "phone": f"length({_DIGITS}) BETWEEN 9 AND 15",
    "iban": "true",  # proposed with a right checksum only
    "ssn": "true",
}


def _piece(start: str, length: str) -> str:
    """SQL text of ``length`` code points from the 0-based ``start``, which costs no more than that and two chunks."""
    first = f"cast(({start}) div {CHUNK} AS int)"
    last = f"cast((({start}) + greatest({length}, 1) - 1) div {CHUNK} AS int)"
    return f"substring(array_join(slice(_chunks, {first} + 1, {last} - {first} + 1), ''), cast(({start}) % {CHUNK} AS int) + 1, {length})"


def _running(values: str) -> str:
    """SQL array of the sums of all values before each one: block sums first, so that copies grow with n * sqrt(n)."""
    inner = "(a, x) -> named_struct('p', a.p + x, 'l', concat(a.l, array(a.p)))"
    empty = "cast(array() AS array<int>)"
    return f"""flatten(aggregate(sequence(0, cast(ceil(size({values}) / greatest(1, floor(sqrt(size({values}))))) AS int)),
        named_struct('p', 0, 'l', cast(array() AS array<array<int>>)),
        (s, b) -> named_struct('p', s.p + aggregate(slice({values}, cast(b * greatest(1, floor(sqrt(size({values})))) AS int) + 1, cast(greatest(1, floor(sqrt(size({values})))) AS int)), 0, (a, x) -> a + x),
            'l', concat(s.l, array(aggregate(slice({values}, cast(b * greatest(1, floor(sqrt(size({values})))) AS int) + 1, cast(greatest(1, floor(sqrt(size({values})))) AS int)),
                named_struct('p', s.p, 'l', {empty}), {inner}, a -> a.l)))),
        s -> s.l))"""


def _parts(pattern: str, shown: str) -> Column:
    """Lengths of a text's parts between marks put at (or around) matches."""
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"transform(split(regexp_replace(_text, '{quoted}', '{shown}'), '{MARK}'), x -> char_length(x))")


def _spans(kind: str) -> Column:
    """Proposed spans (s, e, t): every second part is a match, and sums of lengths tell where it is."""
    at = f"_at_{kind}"
    spans = f"transform(filter(sequence(0, size({at}) - 1), i -> i % 2 = 1), i -> named_struct('s', {at}[i], 'e', {at}[i] + _n_{kind}[i]))"
    return F.expr(f"transform({spans}, x -> named_struct('s', x.s, 'e', x.e, 't', {_piece('x.s', 'x.e - x.s')}))")


def _ibans() -> Column:
    """Spans with a right checksum: of what begins at a place, the longest such part that ends where a run of its characters does.

    The pattern takes tokens after a number for a part of it, and a number that follows for one as well, so it is tried
    at each place on its own.  Spans that overlap an earlier one go.
    """
    pattern = PATTERNS["iban"].replace("\\", "\\\\")
    right = f"exists(transform(array(replace(substring(t, 1, i), ' ', '')), c -> concat(substring(c, 5), substring(c, 1, 4))), d -> length(d) >= 15 AND {_MOD97})"
    ends = f"filter(reverse(sequence(15, length(t))), i -> substring(t, i, 1) <> ' ' AND substring(t, i + 1, 1) IN ('', ' ') AND {right})"
    starts = "slice(_at_iban, 2, greatest(size(_at_iban) - 1, 0))"
    found = f"""transform({starts}, s -> named_struct('s', s, 't', regexp_extract({_piece('s', '68')}, '{pattern}', 0)))"""
    cut = f"filter(transform({found}, x -> named_struct('s', x.s, 'n', get(transform(array(x.t), t -> get({ends}, 0)), 0), 't', x.t)), x -> x.n IS NOT NULL)"
    kind = "array<struct<s:int,e:int,t:string>>"
    # In blocks of 64, so that what was found isn't copied for each span.
    return F.expr(
        f"""get(transform(array({cut}), l -> flatten(aggregate(sequence(0, cast(size(l) / 64 AS int)), named_struct('p', 0, 'a', cast(array() AS array<{kind}>)),
        (acc, b) -> get(transform(array(aggregate(slice(l, b * 64 + 1, 64), named_struct('p', acc.p, 'a', cast(array() AS {kind})),
            (own, x) -> IF(x.s < own.p, own, named_struct('p', x.s + x.n, 'a', concat(own.a, array(named_struct('s', x.s, 'e', x.s + x.n, 't', substring(x.t, 1, x.n)))))))),
            own -> named_struct('p', own.p, 'a', concat(acc.a, array(own.a)))), 0),
        acc -> acc.a))), 0)"""
    )


def _scored(kind: str) -> Column:
    """Confirmed spans with their scores; words nearby raise or lower a score, and an added span needs LEAST."""
    near = f"lower(concat({_piece(f'greatest(x.s - {REACH}, 0)', f'least(x.s, {REACH})')}, ' ', {_piece('x.e', str(REACH))}))"
    told, other = (words[kind].replace("\\", "\\\\") for words in (WORDS, OTHER))
    least = "" if kind in BASE else f", y -> y.score >= {LEAST}D"
    score = f"greatest(0D, least(1D, {SCORES[kind]}D + IF(rlike(near, '{told}'), {CONTEXT}D, 0D) - IF(rlike(near, '{other}'), {CONTEXT}D, 0D)))"
    scored = f"""transform(filter(_{kind}, x -> {VALID[kind]}), x -> named_struct('s', x.s, 'k', {KINDS.index(kind)}, 'e', x.e, 'kind', '{kind}',
        'score', get(transform(array({near}), near -> round({score}, 4)), 0)))"""
    return F.expr(f"filter({scored}{least})" if least else scored)


def find_pii(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """Add ``spans_col`` to each row: confirmed spans (s, k, e, kind, score), by start and then kind.

    s and e count code points, e is exclusive.  Spans of one kind don't overlap; those of two kinds may.  Positions are
    running sums over the parts between matches and texts are cut from chunks, so the work grows with a text's length
    and (with a small factor) its spans, however many there are.

    Nulls: a null or empty text has none.  Rows, their other columns and repeated rows stay as they are, whatever
    their names; a column called ``spans_col`` is replaced.  An empty table gives no rows.
    """
    kept = [c for c in df.columns if c != spans_col]
    # All other columns go through in one struct, so none can clash with a working column.
    rows = df.select((F.struct(*[F.col(f"`{c}`") for c in kept]) if kept else F.lit(0)).alias("_row"), F.replace(F.coalesce(F.col(text_col), F.lit("")), F.lit(MARK), F.lit(PLAIN)).alias("_text"))
    parted = rows.select("*", F.expr(f"regexp_extract_all(_text, '(?s).{{1,{CHUNK}}}', 0)").alias("_chunks"), *[_parts(f"(?={PATTERNS[k]})" if k == "iban" else PATTERNS[k], MARK if k == "iban" else f"{MARK}$0{MARK}").alias(f"_n_{k}") for k in KINDS])
    placed = parted.select("*", *[F.expr(_running(f"_n_{k}")).alias(f"_at_{k}") for k in KINDS])
    proposed = placed.select("_row", "_chunks", *[(_ibans() if k == "iban" else _spans(k)).alias(f"_{k}") for k in KINDS])
    confirmed = proposed.select("_row", *[_scored(k).alias(f"_{k}") for k in KINDS])
    told = F.array_sort(F.concat(*[f"_{k}" for k in KINDS])).alias(spans_col)
    return confirmed.select(*[F.col("_row").getField(c).alias(c) for c in kept], told)


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scores(spans: Column) -> Column:
    """The score of each span, in the order of ``digest``."""
    return F.transform(spans, lambda x: x["score"])


def redacted(text: str, spans: str) -> Column:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in angle brackets.

    Runs are marked by the greatest end before each span; what lies between runs is cut from chunks of the text.
    ``text`` and ``spans`` are column names.
    """
    chunks = f"regexp_extract_all(`{text}`, '(?s).{{1,{CHUNK}}}', 0)"
    piece = _piece("x.p", "x.s - x.p").replace("_chunks", "c")
    kind = "array<struct<p:int,s:int,kind:string>>"
    # Gaps (from p to s) with the kind that follows, in blocks of 64; the last one reaches to the end.
    gaps = f"""aggregate(sequence(0, cast(size(l) / 64 AS int)), named_struct('p', 0, 'a', cast(array() AS array<{kind}>)),
        (acc, b) -> get(transform(array(aggregate(slice(l, b * 64 + 1, 64), named_struct('p', acc.p, 'a', cast(array() AS {kind})),
            (own, x) -> named_struct('p', greatest(own.p, x.e), 'a', IF(x.s < own.p, own.a, concat(own.a, array(named_struct('p', own.p, 's', x.s, 'kind', concat('<', upper(x.kind), '>')))))))),
            own -> named_struct('p', own.p, 'a', concat(acc.a, array(own.a)))), 0),
        acc -> concat(flatten(acc.a), array(named_struct('p', acc.p, 's', char_length(`{text}`), 'kind', ''))))"""
    made = f"get(transform(array({chunks}), c -> array_join(transform(get(transform(array(`{spans}`), l -> {gaps}), 0), x -> concat(IF(x.s > x.p, {piece}, ''), x.kind)), '')), 0)"
    return F.expr(f"IF(size(`{spans}`) = 0, `{text}`, {made})")


def redact(df: DataFrame) -> DataFrame:
    """``df`` with personal data replaced in ``text``; ``n_chars``, where there is one, is counted again.

    A null text stays null, an empty one empty; other columns stay as they are, whatever their names, and so do
    repeated rows.  An empty table gives no rows.
    """
    (spans,) = spare(df, "spans")
    columns = [F.col(f"`{c}`") for c in df.columns]
    found = find_pii(df, spans_col=spans).select(*[redacted("text", spans).alias("text") if c == "text" else F.col(f"`{c}`") for c in df.columns])
    return found.select(*[F.coalesce(F.char_length("text").cast("long"), own).alias(c) if c == "n_chars" else own for c, own in zip(df.columns, columns, strict=True)])
