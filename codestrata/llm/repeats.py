"""Removal of repeated byte windows by a depth-limited radix sort over all documents.

The windows of LENGTH bytes are put in order digit by digit, the most significant first, and a group leaves the sort
as soon as it is settled, so almost all windows are done after the first digits.

1. The first digit of a window is its least GRAM-byte piece by hash, with the piece's place in the window: equal
   windows agree in it.  Neighbouring windows share that piece, so one record stands for a run of windows.
2. The second digit is the run's whole stretch of text.  Runs equal in both digits are equal windows throughout: all
   but those of the least document are repeats.  A piece met in one document only, or with one stretch only, is done.
3. What is left (pieces that several stretches share, by chance or at the ends of repeated passages) is sorted by the
   piece and the 15 bytes after it, and by the piece and the 15 before it: one of these lies in any window. A side
   met in one document only is done.
4. Windows that have only sides left that are shared are sorted one by one to the full depth.

Each pass deals packed arrays to buckets by the digit; equal records are joined where they are made, before they are
dealt.  Digits are hashes: 64 bits of a stretch beside 32 of its piece, and 80 of a window.  Bytes aren't compared again:
among a million different stretches around one common piece two agree by chance with a probability of 3e-8.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import pieces

LENGTH, GRAM = 50, 20
#: A window has half of what surrounds its piece on one side at least: the piece and that many bytes.
SIDE = (LENGTH + GRAM) // 2
RIGHT, LEFT = 1, 2
#: Bytes of text worked on at once, and records after which a task passes on what it has.
AT_ONCE, RECORDS = 1 << 19, 2_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_PLACE = np.uint64((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Stretches:
    """Hashes of any stretch of a text of at least 8 bytes: sums of mixed 8-byte pieces times powers of an odd number."""

    def __init__(self, data: bytes):
        self.n = max(len(data) - 7, 0)
        self.eight = _mix(np.ndarray((self.n,), "<u8", data, strides=(1,)).copy())
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.eight * _powers(_ODD, self.n), dtype=np.uint64)])
        self.back = _powers(_INVERSE, self.n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end - 7] - self.sums[start]) * self.back[start] + (end - start).astype(np.uint64))


def runs(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece hash, stretch hash, document, first window's place in it, number of windows, piece's place after that) of each run.

    Documents are ``data[start:end]``.
    """
    long = np.flatnonzero(ends - starts >= LENGTH)
    if not len(long):
        return *(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, np.int64) for _ in range(4))
    text = Stretches(data)
    eight = text.eight
    n = len(data) - GRAM + 1
    gram = _mix(eight[:n] + _ODD * eight[8 : 8 + n] + _INVERSE * eight[GRAM - 8 : GRAM - 8 + n])
    least = (gram & ~_PLACE) | np.arange(n, dtype=np.uint64)
    width, have = LENGTH - GRAM + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: have - width], least[width - have :])
    at = (least & _PLACE).astype(np.int64)
    first = np.zeros(len(at) + 1, np.int64)
    np.add.at(first, starts[long], 1)
    np.add.at(first, ends[long] - LENGTH + 1, -1)
    window = np.flatnonzero(np.cumsum(first[:-1]))
    piece = at[window]
    begins = np.zeros(len(at), bool)
    begins[starts[long]] = True
    new = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]) | begins[window])
    low = window[new]
    count = np.diff(np.append(new, len(window)))
    piece = piece[new]
    stretch = _mix(text.of(low, low + count - 1 + LENGTH) + (piece - low).astype(np.uint64))
    doc = long[np.searchsorted(starts[long], low, side="right") - 1]
    return gram[piece], stretch, doc, low - starts[doc], count, piece - low


def _groups(*columns: np.ndarray) -> np.ndarray:
    """True at the first of each group of equal rows in sorted columns."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _least(order: np.ndarray, new: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row the least id of its group (ids are sorted within groups)."""
    out = np.empty(len(order), np.int64)
    where = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    out[order] = ids[order][where]
    return out


def _deal(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, rows in their order) for each bucket that has rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(_groups(bucket[order]))
    for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
        yield int(bucket[order[a]]), order[a:b]


_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int8()), ("count", pa.int32()), *((c, pa.binary()) for c in ("key", "low", "id", "tag", "at", "n"))])
_TYPE = "bucket int, kind byte, count int, key binary, low binary, id binary, tag binary, at binary, n binary"
#: Kinds of records: to be sorted, settled as repeated, or to be sorted by single windows.
SORT, REPEATED, SINGLE = 0, 1, 2


def _planes(values: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte: planes of zeros vanish when shuffles are compressed."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, count).T.copy().view("<u4")[:, 0].astype(np.int64)


def _steps(values: np.ndarray) -> bytes:
    """Long numbers as steps from one to the next, as wide as the longest step asks for."""
    step = np.diff(values, prepend=np.int64(0))
    step = ((step << 1) ^ (step >> 63)).view(np.uint64)
    width = next(w for w in (1, 2, 4, 8) if not len(step) or int(step[1:].max(initial=0)) < 1 << 8 * w)
    return step[:1].astype("<u8").tobytes() + step[1:].astype(f"<u{width}").tobytes()


def _from_steps(data: bytes, count: int) -> np.ndarray:
    width = (len(data) - 8) // max(count - 1, 1)
    step = np.concatenate([np.frombuffer(data[:8], "<u8"), np.frombuffer(data[8:], f"<u{width}").astype(np.uint64) if count > 1 else np.zeros(0, np.uint64)])
    return np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64))


class Records:
    """Runs of windows: hash digits, document id and tag, place of the first window, number of windows."""

    def __init__(self, key, low, ids, tags, at, n, kind):
        self.all = (key.astype(np.uint64), low.astype(np.uint64), ids.astype(np.int64), tags.astype(np.int64), at.astype(np.int64), n.astype(np.int64), np.asarray(kind, np.int8))
        self.key, self.low, self.ids, self.tags, self.at, self.n, self.kind = self.all

    def __len__(self) -> int:
        return len(self.ids)

    def __getitem__(self, rows) -> Records:
        return Records(*(c[rows] for c in self.all))

    @staticmethod
    def joined(parts: list[Records]) -> Records:
        if not parts:
            return Records(*(np.zeros(0, np.int64) for _ in range(7)))
        return Records(*(np.concatenate(c) for c in zip(*(p.all for p in parts), strict=True)))

    @staticmethod
    def read(table: pa.Table) -> Records:
        parts = []
        for r in table.to_pylist():
            n = r["count"]
            if r["kind"] == SORT:
                key = np.frombuffer(r["key"], "<u8")
                low = np.frombuffer(r["low"], f"<u{len(r['low']) // n}")
            else:
                key = low = np.zeros(n, np.uint64)
            tags = np.frombuffer(r["tag"], "<i8") if r["tag"] else np.zeros(n, np.int64)
            parts.append(Records(key, low, _from_steps(r["id"], n), tags, _from_planes(r["at"], n), _from_planes(r["n"], n), np.full(n, r["kind"])))
        return Records.joined(parts)

    def told(self, bucket: int, low_bytes: int) -> list[dict]:
        """A row for each kind; only records still to be sorted keep their digits."""
        rows = []
        for kind in (SORT, REPEATED, SINGLE):
            own = self[self.kind == kind]
            if len(own):
                digits = kind == SORT
                rows.append(
                    {
                        "bucket": bucket, "kind": kind, "count": len(own), "key": own.key.astype("<u8").tobytes() if digits else b"", "low": own.low.astype(f"<u{low_bytes}").tobytes() if digits else b"",
                        "id": _steps(own.ids), "tag": own.tags.astype("<i8").tobytes() if own.tags.any() else b"", "at": _planes(own.at), "n": _planes(own.n),
                    }
                )
        return rows

    def merged(self) -> Records:
        """Settled records in order, with those that follow or overlap each other in one."""
        own = self[np.lexsort((self.at, self.tags, self.ids))]
        if not len(own):
            return own
        new = _groups(own.ids, own.tags)
        group = np.cumsum(new)
        # Ends reach over a document's records only: a step between documents is longer than any text.
        ends = np.maximum.accumulate(own.at + own.n + (group << 32)) - (group << 32)
        new[1:] |= own.at[1:] > ends[:-1]
        first = np.flatnonzero(new)
        out = own[first]
        return Records(out.key, out.low, out.ids, out.tags, out.at, ends[np.append(first[1:], len(own)) - 1] - out.at, out.kind)


def group_of(ids: np.ndarray, groups: int) -> np.ndarray:
    """XXH64 of long numbers (seed 42, as in Spark SQL) modulo the number of groups."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turn = lambda x, k: (x << np.uint64(k)) | (x >> np.uint64(64 - k))
    x = ids.astype(np.int64).view(np.uint64)
    h = (p5 + np.uint64(42 + 8)) ^ (turn(x * p2, 31) * p1)
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return (h ^ (h >> np.uint64(32))).view(np.int64) % groups


def _settle(key: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """True for records that are equal to one of a smaller document."""
    order = np.lexsort((ids, low, key))
    return ids > _least(order, _groups(key[order], low[order]), ids)


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", piece_bytes: int = 4 << 20, with_text: bool = False) -> DataFrame:
    """Remove each byte covered by a window of LENGTH bytes that also starts in a document with a smaller id.

    Windows are those of the UTF-8 texts as given, they may overlap and never cross documents.  Texts are read twice
    and shuffled once; what is dealt besides is about 20 bytes for each run of some 16 windows.  Buckets and
    document groups grow in number with the input, so memory for each doesn't.

    Nulls: a null text is empty.  A null id counts as larger than all others.  Repeated rows (equal id and text)
    keep what one of them would; documents with the same id don't count against each other.  Texts shorter than a
    window lose nothing.  An empty table gives no rows.  Other columns are ignored.

    Returns id_col, n_bytes, n_removed, n_spans, kept_sha256, and kept (binary) if ``with_text``.
    """
    groups = pieces(df, piece_bytes, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own = df.select(F.col(id_col).cast("long").alias("given"), F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), text.alias("text"))
    # Rows are known by their ids; where some share an id, a hash of the text tells them apart.
    shared = not own.groupBy("id").count().filter("count > 1").isEmpty()
    own = own.withColumn("tag", F.xxhash64("text") if shared else F.lit(0).cast("long")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("text", F.col("text").cast("binary"))

    def table_of(rows: list[dict]) -> pa.Table:
        return pa.Table.from_pylist(rows, _SCHEMA)

    def to_groups(found: Records) -> pa.Table:
        return table_of([r for g, rows in _deal(group_of(found.ids, groups)) for r in found[rows].told(g, 1)])

    def first_digits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Records] = []

        def release() -> Iterator[pa.RecordBatch]:
            found = Records.joined(held)
            held.clear()
            repeated = _settle(found.key, found.low, found.ids)
            done, rest = found[repeated], found[~repeated]
            done.kind[:] = REPEATED
            done.n[:] &= 255
            done = done.merged()
            out = [r for g, rows in _deal(group_of(done.ids, groups)) for r in done[rows].told(g, 1)]
            out += [r for b, rows in _deal(((rest.key >> np.uint64(32)) % np.uint64(groups)).astype(np.int64)) for r in rest[rows].told(b, 4)]
            for i in range(0, len(out), 64):
                yield from table_of(out[i : i + 64]).to_batches()

        for batch in batches:
            ids, tags = batch.column("id").to_numpy(), batch.column("tag").to_numpy()
            texts = batch.column("text").to_pylist()
            begin = 0
            while begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (size == 0 or size + len(texts[end]) <= AT_ONCE):
                    size += len(texts[end])
                    end += 1
                length = np.fromiter(map(len, texts[begin:end]), np.int64, end - begin)
                ends = np.cumsum(length)
                gram, stretch, doc, at, n, off = runs(b"".join(texts[begin:end]), ends - length, ends)
                # Half of the piece's hash and all 64 bits of the stretch's, which covers the piece and its place too.
                key = (gram & ~np.uint64(0xFFFFFFFF)) | (stretch >> np.uint64(32))
                held.append(Records(key, stretch & np.uint64(0xFFFFFFFF), ids[begin + doc], tags[begin + doc], at, n | off << 8, np.full(len(at), SORT)))
                begin = end
                if sum(map(len, held)) > RECORDS:
                    yield from release()
        if held:
            yield from release()

    def second_digits(table: pa.Table) -> pa.Table:
        every = Records.read(table)
        done, found = every[every.kind == REPEATED], every[every.kind == SORT]
        if len(found):
            piece = found.key >> np.uint64(32)
            order = np.lexsort((found.ids, found.low, found.key))
            equal = _groups(found.key[order], found.low[order])
            repeated = found.ids > _least(order, equal, found.ids)
            edges = np.flatnonzero(_groups(piece[order]))
            several = np.add.reduceat(equal, edges, dtype=np.int64) > 1
            by_piece = found.ids[np.lexsort((found.ids, piece))]
            several &= by_piece[edges] < by_piece[np.append(edges[1:], len(piece)) - 1]
            shared = np.empty(len(found), bool)
            shared[order] = np.repeat(several, np.diff(np.append(edges, len(piece))))
            found.kind[:] = np.where(repeated, REPEATED, np.where(shared, SINGLE, SORT))
            found.n[repeated] &= 255
        told = Records.joined([done, found[found.kind != SORT]])
        return to_groups(told[np.lexsort((told.at, told.ids))])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("given", "id", "tag", "text")), strict=True))
            bucket = batch.column("bucket").to_numpy()
            out = [(g, squeeze.compress(pickle.dumps([rows[i] for i in some], 5))) for g, some in _deal(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["bucket", "data"])

    def unpacked(docs: pa.Table) -> Iterator[tuple]:
        loose = zstandard.ZstdDecompressor()
        for data in docs["data"]:
            yield from pickle.loads(loose.decompress(data.as_py()))

    def by_document(docs: pa.Table, found: Records) -> Iterator[tuple[Records, np.ndarray, np.ndarray, Stretches]]:
        """Records of some documents at a time, the place and length of each one's text, and the hashes of these texts."""
        found = found[np.lexsort((found.at, found.tags, found.ids))]
        if not len(found):
            return
        bounds = np.append(np.flatnonzero(_groups(found.ids, found.tags)), len(found))
        named = {(int(found.ids[i]), int(found.tags[i])): k for k, i in enumerate(bounds[:-1])}
        held: dict[int, bytes] = {}

        def batch() -> tuple[Records, np.ndarray, np.ndarray, Stretches]:
            numbers = sorted(held)
            texts = [held[k] for k in numbers]
            held.clear()
            rows = np.concatenate([np.arange(bounds[k], bounds[k + 1]) for k in numbers])
            sizes = [bounds[k + 1] - bounds[k] for k in numbers]
            return found[rows], np.repeat(np.cumsum([0, *map(len, texts)]), [*sizes, 0]), np.repeat([len(t) for t in texts], sizes), Stretches(b"".join(texts))

        size = 0
        for _, i, tag, text in unpacked(docs):
            if (k := named.get((i, tag))) is not None and k not in held:
                held[k] = text
                size += len(text)
                if size > AT_ONCE:
                    yield batch()
                    size = 0
        if held:
            yield batch()

    def sides(docs: pa.Table, table: pa.Table) -> pa.Table:
        every = Records.read(table)
        parts = [every[every.kind == REPEATED].merged()]
        for found, base, length, text in by_document(docs, every[every.kind == SINGLE]):
            piece = found.at + (found.n >> 8)
            for side, start in ((RIGHT, piece), (LEFT, piece + GRAM - SIDE)):
                own = np.flatnonzero((start >= 0) & (start + SIDE <= length))
                at = (base + start)[own]
                some = found[own]
                parts.append(Records(text.of(at, at + SIDE) ^ np.uint64(side), some.low, some.ids, some.tags, some.at, some.n | side << 16, np.full(len(own), SORT)))
        found = Records.joined(parts)
        bucket = np.where(found.kind == SORT, (found.key % np.uint64(groups)).astype(np.int64), group_of(found.ids, groups))
        return table_of([r for b, rows in _deal(bucket) for r in found[rows].told(b, 1)])

    def shared_sides(table: pa.Table) -> pa.Table:
        every = Records.read(table)
        done, found = every[every.kind == REPEATED], every[every.kind == SORT]
        if len(found):
            order = np.lexsort((found.ids, found.key))
            edges = np.flatnonzero(_groups(found.key[order]))
            many = np.diff(np.append(edges, len(found)))
            shared = found.ids[order][edges] < found.ids[order][edges + many - 1]
            found = found[order[np.repeat(shared, many)]]
            found.kind[:] = SINGLE
        told = Records.joined([done, found])
        return to_groups(told[np.lexsort((told.at, told.ids))])

    def windows(docs: pa.Table, table: pa.Table) -> pa.Table:
        every = Records.read(table)
        parts = [every[every.kind == REPEATED].merged()]
        for found, base, _, text in by_document(docs, every[every.kind == SINGLE]):
            first = np.flatnonzero(_groups(found.ids, found.tags, found.at))
            side = np.bitwise_or.reduceat(found.n >> 16, first)
            found, base = found[first], base[first]
            many, piece = found.n & 255, found.n >> 8 & 255
            step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            before = np.repeat(piece, many) - step  # bytes of the window before its piece
            side = np.repeat(side, many)
            fits = ((side & LEFT > 0) | (before < SIDE - GRAM)) & ((side & RIGHT > 0) | (LENGTH - GRAM - before < SIDE - GRAM))
            row = np.repeat(np.arange(len(found)), many)[fits]
            place = found.at[row] + step[fits]
            start = base[row] + place
            more = _mix(text.eight[start] ^ (_ODD * text.eight[start + LENGTH // 2]) ^ (_INVERSE * text.eight[start + LENGTH - 8])) & np.uint64(0xFFFF)
            one = Records(text.of(start, start + LENGTH), more, found.ids[row], found.tags[row], place, np.ones(len(place), np.int64), np.full(len(place), SORT))
            repeated = _settle(one.key, one.low, one.ids)
            one.kind[repeated] = REPEATED
            parts.extend([one[~repeated], one[repeated].merged()])
        found = Records.joined(parts)
        bucket = np.where(found.kind == SORT, (found.key % np.uint64(groups)).astype(np.int64), group_of(found.ids, groups))
        return table_of([r for b, rows in _deal(bucket) for r in found[rows].told(b, 2)])

    def last_digits(table: pa.Table) -> pa.Table:
        every = Records.read(table)
        found = every[every.kind == SORT]
        found = found[_settle(found.key, found.low, found.ids)]
        found.kind[:] = REPEATED
        return to_groups(Records.joined([every[every.kind == REPEATED], found]).merged())

    kept_type = [("kept", pa.binary())] * with_text
    result = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *kept_type])

    def cover(docs: pa.Table, table: pa.Table) -> pa.Table:
        gone = Records.read(table).merged()
        bounds = np.append(np.flatnonzero(_groups(gone.ids, gone.tags)), len(gone)) if len(gone) else np.zeros(1, np.int64)
        named = {(int(gone.ids[i]), int(gone.tags[i])): (i, j) for i, j in zip(bounds[:-1], bounds[1:], strict=True)}
        out = []
        for given, i, tag, text in unpacked(docs):
            kept, spans = text, 0
            if (i, tag) in named:
                a, b = named[i, tag]
                depth = np.zeros(len(text) + 1, np.int64)
                np.add.at(depth, gone.at[a:b], 1)
                np.add.at(depth, gone.at[a:b] + gone.n[a:b] - 1 + LENGTH, -1)
                lost = np.cumsum(depth[:-1]) > 0
                spans = int(lost[0]) + int((lost[1:] & ~lost[:-1]).sum())
                kept = np.frombuffer(text, np.uint8)[~lost].tobytes()
            out.append({"id": given, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": spans, "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept})
        return pa.Table.from_pylist(out, result)

    dealt = own.select("id", "tag", "text").mapInArrow(first_digits, _TYPE)
    sorted_ = dealt.groupBy("bucket").applyInArrow(second_digits, _TYPE)
    docs = own.mapInArrow(packed, "bucket int, data binary")
    fresh = lambda frame: frame.select(*[F.col(c).alias(c) for c in frame.columns])
    sided = fresh(docs).groupBy("bucket").cogroup(fresh(sorted_).groupBy("bucket")).applyInArrow(sides, _TYPE)
    open_ = sided.groupBy("bucket").applyInArrow(shared_sides, _TYPE)
    single = fresh(docs).groupBy("bucket").cogroup(fresh(open_).groupBy("bucket")).applyInArrow(windows, _TYPE)
    settled = single.groupBy("bucket").applyInArrow(last_digits, _TYPE)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return fresh(docs).groupBy("bucket").cogroup(fresh(settled).groupBy("bucket")).applyInArrow(cover, schema).withColumnRenamed("id", id_col)
