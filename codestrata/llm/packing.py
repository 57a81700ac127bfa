"""Packing by power-of-two decomposition."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.llm.common import cut

#: Words remembered by a worker; both caches are emptied when full, which bounds memory and changes no result.
REMEMBERED = 400_000

_SIMPLE = [chr(i) for i in range(0x250)]  # no code point below U+0300 is changed by NFC
_LETTERS = "".join(c for c in _SIMPLE if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _SIMPLE if unicodedata.category(c)[0] == "N")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\t-\r \x85\xa0{_LETTERS}{_NUMBERS}]+")
_OTHER = re.compile("[^\x00-ɏ]")


class WordTokenizer(dict):
    """Ids of white-space-free chunks, as little-endian 32-bit bytes.

    The tokenizer's words never reach across white space, so a text's ids are those of its chunks in a row, and
    chunks repeat.  A chunk of simple characters is split here and only new words go to the model; any other chunk,
    and one that may hold a special token, goes to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.words: dict[str, bytes] = {}
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # the byte-level alphabet
        others = [b for b in range(256) if b not in plain]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}

    def __missing__(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        small = text.lower()  # some simple capitals have small letters that aren't simple
        if "<|" in text or _OTHER.search(text) or _OTHER.search(small):
            ids = b"".join(i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            words = self.words
            ids = b"".join([words.get(w) or self.word(w) for w in _PIECES.findall(small)])
        if len(self) >= REMEMBERED:
            self.clear()
        self[chunk] = ids
        return ids

    def word(self, word: str) -> bytes:
        spelt = word if word.isalpha() and word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(spelt)])
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[word] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").encode().split()))


def binary_pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole ``longest`` ones, then the binary digits of the rest."""
    whole = n // longest
    out = [(i * longest, longest) for i in range(whole)]
    at = whole * longest
    while at < n:
        length = 1 << ((n - at).bit_length() - 1)
        out.append((at, length))
        at += length
    return out


def pack(df: DataFrame, tokenizer: str, *, longest: int = 2048, end: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Cut each document's ids into pieces whose lengths are powers of two, at most ``longest``, and bucket equal lengths.

    A piece is a sequence of its own: it is never padded, and no sequence crosses documents.  ``bucket`` is the length's
    logarithm; the sequences of a bucket have consecutive numbers, shorter buckets first, so any stretch of
    sequence_id inside a bucket is a batch without padding.  ``end`` is put after each document.  ``tokenizer`` is the
    path of a tokenizers file that every executor has.  Documents are cut where they are read; nothing is shuffled but
    one count for each task and bucket, and memory is bounded by a batch of texts and the word caches.

    Nulls: a null text is an empty one, that is one piece with ``end`` alone; a null id is kept.  Repeated rows are
    packed each.  An empty table gives no rows.  sequence_id is gapless from 0; other columns are ignored.

    Returns id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, and ids if asked for.
    """
    schema = "id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int, task int, place long" + ", ids array<int>" * with_ids
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "bucket", "task", "place"] + ["ids"] * with_ids

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer(tokenizer)
        last = end.to_bytes(4, "little")
        task = TaskContext.get().partitionId()
        seen = [0] * 64

        def table(columns: list[list], ids: list) -> pa.RecordBatch:
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] + [pa.array(ids, pa.list_(pa.int32()))] * with_ids
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            columns, ids = [[] for _ in range(8)], []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                data = memoryview(words.ids(text.as_py()) + last)
                n, doc = len(data) // 4, doc.as_py()
                for start, length in binary_pieces(n, longest):
                    piece = data[4 * start : 4 * (start + length)]
                    bucket = length.bit_length() - 1
                    for column, value in zip(columns, (doc, start, length, zlib.crc32(piece), n, bucket, task, seen[bucket]), strict=True):
                        column.append(value)
                    seen[bucket] += 1
                    if with_ids:
                        ids.append(piece.cast("i").tolist())
                if len(columns[0]) >= 50_000 or with_ids and len(ids) >= 1000:
                    yield table(columns, ids)
                    columns, ids = [[] for _ in range(8)], []
            yield table(columns, ids)

    # Numbers within a task are made once and written out, so a lost executor doesn't change them.
    pieces = cut(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut_up, schema))
    own = pieces.groupBy("bucket", "task").agg(F.count("*").alias("n"))
    # A row for each task and bucket, of which there are at most 64: some bytes for each piece of input that a task reads.
    before = F.coalesce(F.sum("n").over(W.orderBy("bucket", "task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = pieces.join(own.select("bucket", "task", before.alias("first")), ["bucket", "task"])
    return numbered.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("place")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", *["ids"] * with_ids)
