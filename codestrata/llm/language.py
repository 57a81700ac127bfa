"""Language identification with a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from codestrata.llm.common import quoted, spare

#: Hashed feature slots.
SLOTS = 1 << 17
#: Characters of text worked on at once: bounds a worker's memory.
AT_ONCE = 2_000_000
NONE = "und"

_WORD = re.compile(r"[^\W\d_]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in small letters; numbers of other scripts, fractions and the like are none."""
    found = _WORD.findall((text or "").lower())
    if "".join(found).isalpha() or not found:
        return found
    return [w for x in found for w in (x,) * x.isalpha() or "".join(c if c.isalpha() else " " for c in x).split()]


def _slot(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(32))) & np.uint64(SLOTS - 1)).astype(np.int64)


def features(words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(slot, word) pairs: 1- to 3-grams of ^word$, affixes of 3 and 4 letters, and the word itself."""
    code = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(length)
    owner = np.repeat(np.arange(len(words)), length)
    place = np.arange(len(code))
    left = end[owner] - place  # characters from here to the word's end
    first = place == (end - length)[owner]
    slots, owners = [], []
    value = np.zeros(len(code), np.uint64)
    for n in range(1, 6):
        value = value[: len(code) - n + 1] * _ODD + code[n - 1 :] + np.uint64(n)
        fits = left[: len(value)] >= n
        if n > 3:
            fits &= first[: len(value)] | (left[: len(value)] == n)
        slots.append(_slot(value[fits]))
        owners.append(owner[: len(value)][fits])
    whole = np.fromiter((xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    return np.concatenate([*slots, _slot(whole)]), np.concatenate([*owners, np.arange(len(words))])


@dataclass
class Field:
    """Weights of features, lexicon membership, transitions and starts for each label."""

    labels: list[str]
    weights: np.ndarray
    lexicon: dict[str, int]
    listed: np.ndarray  # a row for each lexicon word and a last one of zeros, a column for each label
    member: np.ndarray
    moves: np.ndarray
    starts: np.ndarray

    def membership(self, words: Sequence[str]) -> np.ndarray:
        return self.listed[np.fromiter((self.lexicon.get(w, -1) for w in words), np.int64, len(words))]

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """One row of label scores for each distinct word."""
        slots, owners = features(words)
        total = np.stack([np.bincount(owners, self.weights[slots, k], len(words)) for k in range(len(self.labels))], axis=1)
        return total + self.membership(words) @ self.member

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Label probabilities of each word by forward-backward; ``first`` marks the words that begin a sequence."""
        return forward_backward(scores, first, self.moves, self.starts)[0]


def forward_backward(scores: np.ndarray, first: np.ndarray, moves: np.ndarray, starts: np.ndarray, run: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, forward and backward values) of many sequences laid end to end.

    The row of words is cut into runs worked on side by side: a run's steps multiply up to one matrix, the matrices
    carry the forward and backward values over the runs, and a second sweep fills in the words.  This is exact: a
    sequence's first word forgets what came before it.
    """
    n, k = scores.shape
    runs = -(-n // run)
    lit = np.exp(scores - scores.max(axis=1, keepdims=True))
    lit = np.concatenate([lit, np.ones((runs * run - n, k))]).reshape(runs, run, k).transpose(1, 0, 2).copy()
    new = np.concatenate([first, np.ones(runs * run - n, bool)]).reshape(runs, run).T.copy()
    step, begin = np.exp(moves - moves.max()), np.exp(starts - starts.max())
    product = np.broadcast_to(np.eye(k), (runs, k, k)).copy()
    for i in range(run):
        on = np.where(new[i][:, None, None], product.sum(axis=2, keepdims=True) * begin, product @ step) * lit[i][:, None, :]
        product = on / on.max(axis=(1, 2), keepdims=True)
    into, back = np.empty((runs, k)), np.empty((runs, k))
    value = np.ones(k) / k
    for r in range(runs):
        into[r] = value
        value = value @ product[r]
        value /= value.sum()
    value = np.ones(k)
    for r in range(runs - 1, -1, -1):
        back[r] = value
        value = product[r] @ value
        value /= value.max()
    forward, backward = np.empty((run, runs, k)), np.empty((run, runs, k))
    value = into
    for i in range(run):
        value = np.where(new[i][:, None], value.sum(axis=1, keepdims=True) * begin, value @ step) * lit[i]
        value = value / value.sum(axis=1, keepdims=True)
        forward[i] = value
    value = back
    for i in range(run - 1, -1, -1):
        backward[i] = value
        ahead = value * lit[i]
        value = np.where(new[i][:, None], (ahead * begin).sum(axis=1, keepdims=True), ahead @ step.T)
        value = value / value.max(axis=1, keepdims=True)
    flat = lambda x: x.transpose(1, 0, 2).reshape(runs * run, k)[:n]
    forward, backward = flat(forward), flat(backward)
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), forward, backward


def train(rows: Sequence[tuple[str, str]], *, epochs: int = 4, lexicon_words: int = 2000, sequence: int = 100, batch: int = 64, rate: float = 0.2, seed: int = 7) -> Field:
    """Fit a field to (text, label) rows by AdaGrad on the log-likelihood, over whole rows.

    Stretches of 3 to 40 words of differently labelled texts are put in a row at random, so transitions are learned
    from code-switched sequences.
    """
    rows = [(words_of(t), label) for t, label in sorted(rows)]
    labels = sorted({label for w, label in rows if w})
    k = len(labels)
    counts = {label: Counter() for label in labels}
    for words, label in rows:
        if words:
            counts[label].update(words)
    frequent = [(w, i) for i, label in enumerate(labels) for w, _ in sorted(counts[label].items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]]
    lexicon: dict[str, int] = {}
    for w, _ in frequent:
        lexicon.setdefault(w, len(lexicon))
    listed = np.zeros((len(lexicon) + 1, k))
    for w, i in frequent:
        listed[lexicon[w], i] = 1
    field = Field(labels, np.zeros((SLOTS, max(k, 1))), lexicon, listed, np.zeros((k, k)), np.zeros((k, k)), np.zeros(k))
    if k < 2:
        return field
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    stretches = []
    for words, label in rows:
        codes = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
        cuts, at = [], 0
        while at < len(codes):
            size = int(rng.integers(3, 41))
            cuts.append((at, size))
            at += size
        stretches += [(labels.index(label), codes[at : at + size]) for at, size in cuts]
    known = list(vocabulary)
    slots, owners = features(known)
    by_word = np.searchsorted(owners[np.argsort(owners, kind="stable")], np.arange(len(known) + 1))
    slots = slots[np.argsort(owners, kind="stable")]
    member = field.membership(known)
    squares = [np.full(p.shape, 1e-6) for p in (field.weights, field.member, field.moves, field.starts)]
    for _ in range(epochs):
        order = rng.permutation(len(stretches))
        word = np.fromiter(chain.from_iterable(stretches[i][1] for i in order), np.int64)
        label = np.repeat([stretches[i][0] for i in order], [len(stretches[i][1]) for i in order])
        for at in range(0, len(word), batch * sequence):
            w, y = word[at : at + batch * sequence], label[at : at + batch * sequence]
            some, place = np.unique(w, return_inverse=True)
            spans = [np.arange(by_word[i], by_word[i + 1]) for i in some]
            used = slots[np.concatenate(spans)]
            of = np.repeat(np.arange(len(some)), [len(s) for s in spans])
            score = np.stack([np.bincount(of, field.weights[used, j], len(some)) for j in range(k)], axis=1) + member[some] @ field.member
            score = score[place]
            first = np.arange(len(w)) % sequence == 0
            after, forward, backward = forward_backward(score, first, field.moves, field.starts)
            wrong = after.copy()
            wrong[np.arange(len(w)), y] -= 1
            lit = np.exp(score - score.max(axis=1, keepdims=True))
            pair = forward[:-1, :, None] * np.exp(field.moves)[None] * (lit[1:] * backward[1:])[:, None, :]
            pair /= pair.sum(axis=(1, 2), keepdims=True)
            moved = ~first[1:]
            moves = pair[moved].sum(axis=0)
            np.subtract.at(moves, (y[:-1][moved], y[1:][moved]), 1)
            per_word = np.stack([np.bincount(place, wrong[:, j], len(some)) for j in range(k)], axis=1)
            hit, where = np.unique(used, return_inverse=True)
            slope = np.stack([np.bincount(where, per_word[of, j], len(hit)) for j in range(k)], axis=1) + 1e-4 * field.weights[hit]
            squares[0][hit] += slope**2
            field.weights[hit] -= rate * slope / np.sqrt(squares[0][hit])
            for i, (p, slope) in enumerate(((field.member, member[some].T @ per_word), (field.moves, moves), (field.starts, wrong[first].sum(axis=0))), 1):
                squares[i] += slope**2
                p -= rate * slope / np.sqrt(squares[i])
    field.weights = field.weights.astype(np.float32)
    return field


def held_out(id_column: str = "doc_id") -> Column:
    """True where the CRC-32 of the id as text leaves no remainder by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(df: DataFrame, *, rows_per_label: int = 400, chars_per_label: int = 1_000_000) -> list[tuple[str, str]]:
    """At most ``rows_per_label`` (text, lang) rows of each label, the first in order of a hash of id and text, whole texts.

    Only rows that aren't held out.  Both parameters are the sample's bound: rows are taken as long as their characters
    sum up to ``chars_per_label`` at most, and a row that is longer than that by itself isn't learned from.  Ids are
    ranked in two levels, so the rows of a frequent label meet in no one task.
    """
    pick = F.xxhash64("doc_id", "text").alias("_pick")
    labelled = df.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") <= chars_per_label))
    own = labelled.groupBy(pick, "lang").agg(F.first(F.char_length("text")).alias("_size"))
    few = own.withColumn("_turn", F.row_number().over(W.partitionBy("lang", F.pmod("_pick", F.lit(64))).orderBy("_pick"))).filter(F.col("_turn") <= rows_per_label)
    few = few.withColumn("_turn", F.row_number().over(W.partitionBy("lang").orderBy("_pick"))).filter(F.col("_turn") <= rows_per_label)
    run = F.sum("_size").over(W.partitionBy("lang").orderBy("_turn").rowsBetween(W.unboundedPreceding, 0))
    # At most rows_per_label ids for each label: small enough to broadcast.
    chosen = F.broadcast(few.withColumn("_run", run).filter(F.col("_run") <= chars_per_label).select("_pick", "lang"))
    texts = labelled.select(pick, "lang", "text").join(chosen, ["_pick", "lang"], "left_semi").dropDuplicates(["_pick", "lang"])
    return [(r.text, r.lang) for r in texts.select("text", "lang").toLocalIterator()]


def annotate(df: DataFrame, field: Field, *, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``df`` with the columns ``names``, label and score (columns of these names are replaced): whole texts are labelled where they are.

    The label with the most letters by word posteriors wins, and its share is the score.

    Nulls: a null text, or one without a letter, is ``und`` with score 0; so is any text if no label was learned.
    Repeated rows are labelled each; an empty table gives no rows.
    """

    def label(texts: list[str]) -> tuple[list[str], list[float]]:
        words = [words_of(t) for t in texts]
        length = np.fromiter(map(len, words), np.int64, len(words))
        if not length.sum() or not field.labels:
            return [NONE] * len(texts), [0.0] * len(texts)
        codes: dict[str, int] = {}
        flat = np.fromiter((codes.setdefault(w, len(codes)) for w in chain.from_iterable(words)), np.int64, int(length.sum()))
        known = list(codes)
        first = np.zeros(len(flat), bool)
        some = length > 0
        starts = (np.cumsum(length) - length)[some]
        first[starts] = True
        after = field.posteriors(field.scores(known)[flat], first) * np.fromiter(map(len, known), np.float64, len(known))[flat][:, None]
        share = np.add.reduceat(after, starts, axis=0)
        share /= share.sum(axis=1, keepdims=True)
        best, sure = np.full(len(texts), NONE, object), np.zeros(len(texts))
        best[some] = np.array(field.labels, object)[share.argmax(axis=1)]
        sure[some] = np.minimum(share.max(axis=1), 1.0)
        return best.tolist(), sure.tolist()

    columns = [c for c in df.columns if c not in names]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_col).to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (size == 0 or size < AT_ONCE):
                    size += len(texts[end] or "") + 1
                    end += 1
                told, sure = label(texts[at:end])
                part = batch.slice(at, end - at)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(told, pa.string()), pa.array(sure, pa.float64())], names=["row", "label", "sure"])
                at = end

    # One struct holds the columns, so none of their names is in the way.
    own = df.select(F.struct(*map(quoted, columns)).alias("row"))
    told = own.mapInArrow(walk, StructType([*own.schema.fields, StructField("label", StringType()), StructField("sure", DoubleType())]))
    return told.select(*[F.col("row").getField(c).alias(c) for c in columns], F.col("label").alias(names[0]), F.col("sure").alias(names[1]))


def identify(df: DataFrame, **options) -> DataFrame:
    """Learn from the labelled rows of ``df`` that aren't held out, and label all its rows: (doc_id, lang_pred, score)."""
    field = train(sample(df, **options))
    return annotate(df.select("doc_id", "text"), field).select("doc_id", "lang_pred", "score")


def known_language(df: DataFrame, least: float = 0.5, **options) -> DataFrame:
    """The rows of ``df`` in a learned language, one that has at least the share ``least`` of a text's letters.

    All columns stay as they are, whatever their names.  Null texts and texts without a letter go; repeated rows are
    judged each; an empty table gives no rows, and one without labelled rows none either, as no language is known.
    """
    language, score = spare(df, "lang_pred", "score")
    found = annotate(df, train(sample(df, **options)), names=(language, score))
    return found.filter((F.col(language) != NONE) & (F.col(score) >= least)).select(*map(quoted, df.columns))
