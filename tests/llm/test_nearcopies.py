"""Near copies against all pairs in plain Python."""

import itertools
import random

import numpy as np

import corpus_pipeline
from codestrata.llm import nearcopies

from .test_texts import odd

WORDS = [f"w{i}" for i in range(500)]


def plain_shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(1, len(words))))}


def plain_least(texts):
    """The least id of each text's component, by the Jaccard similarity of all pairs."""
    sets, least = {i: plain_shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i, j in itertools.combinations(sorted(texts), 2):
        if sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
            a, b = sorted((least[i], least[j]))
            least = {k: a if v == b else v for k, v in least.items()}
    return least


def changed(rng, text, n):
    words = text.split()
    for at in rng.sample(range(len(words)), n):
        words[at] = rng.choice(WORDS)
    return " ".join(words)


def corpus():
    rng, texts = random.Random(3), ["", " ", "one two", "One Two", "one two three four five six"]
    for _ in range(40):
        own = " ".join(rng.choices(WORDS, k=rng.choice([12, 60, 100, 200])))
        texts += [own, changed(rng, own, 1), changed(rng, own, 2), own + " end", own.upper()]
    for size in (80, 100):  # clouds: chains of near copies, and texts that share a long passage only
        own = " ".join(rng.choices(WORDS, k=size))
        for _ in range(60):
            texts.append(changed(rng, own, 1))
            texts.append(own + " " + " ".join(rng.choices(WORDS, k=rng.randrange(5, 60))))
    return dict(enumerate(texts))


def test_near_copies_are_those_of_all_pairs(spark):
    texts = corpus()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    wanted = plain_least(texts)
    assert {r.doc_id: r.component_id for r in nearcopies.components(df).collect()} == wanted
    kept = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(wanted.values()))


def test_near_copies_of_a_large_group_are_not_paired_off(spark, monkeypatch):
    """Texts that share a long passage but aren't near copies, and some that are: pairs don't grow with the square of the group."""
    asked, verified = [], nearcopies._verified

    def counted(pairs, sets):
        pairs = pairs.localCheckpoint()
        asked.append(pairs.count())
        return verified(pairs, sets)

    monkeypatch.setattr(nearcopies, "_verified", counted)
    rng, passage = random.Random(7), random.Random(8).choices(WORDS, k=150)
    texts = [" ".join(passage + rng.choices(WORDS, k=24)) for _ in range(380)]
    texts += [changed(rng, text, 1) for text in texts[:20]] + [" ".join(rng.choices(WORDS, k=60)) for _ in range(20)]
    texts = dict(enumerate(texts))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in nearcopies.components(df).collect()} == plain_least(texts)
    assert sum(asked) < len(texts)


def test_near_copies_edges(spark):
    rows = sorted((r.doc_id or 0, r.component_id) for r in nearcopies.components(odd(spark)).collect())
    assert rows == [(0, 6), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (6, 6), (7, 7), (8, 1)]
    assert nearcopies.one_of_each(odd(spark)).columns == odd(spark).columns
    assert nearcopies.components(odd(spark).limit(0)).count() == 0


def at_least_alike(rng, n):
    """Two sets of some n shingles at the least similarity of 0.8: equally many of their own, or one within the other."""
    same, own = 8 * (n // 9), n // 9
    x, y = (0, 2 * own) if rng.random() < 0.3 else (own, own)
    all_ = rng.integers(0, 1 << 63, same + x + y, np.uint64) * np.uint64(2) + np.uint64(1)
    return np.sort(np.concatenate([all_[:same], all_[same : same + x]])), np.sort(np.concatenate([all_[:same], all_[same + x :]]))


def test_near_copies_meet_in_balls_of_simhash_words():
    rng = np.random.default_rng(5)
    for rows in (1000, 1 << 22):
        width, words = nearcopies.shape(rows)
        table = nearcopies.votes(width, words)
        pairs = [at_least_alike(rng, n) for n in (9, 18, 45, 180, 900, 4500) for _ in range(40)]
        (one, codes), (other, theirs) = (nearcopies.balls([p[i] for p in pairs], table, width) for i in (0, 1))
        a, b = nearcopies.variants(codes), nearcopies.variants(theirs)
        assert a.shape == (len(pairs), words, 8) and (np.bitwise_count(a[:, :, :1] ^ a) <= 3).all()
        assert all(len(set(x.ravel())) == x.size for x in a)
        meet = [np.intersect1d(x, y).size for x, y in zip(a, b, strict=True)]
        assert min(meet) > 0
        unlike = [np.intersect1d(x, y).size for x, y in zip(a, b[::-1], strict=True)]
        assert sum(unlike) < 5
        apart = np.bitwise_count((one ^ other).view(np.uint64))
        assert apart.sum(axis=1).max() <= nearcopies.APART
    assert nearcopies.shape(10) == nearcopies.shape(200_000) and nearcopies.shape(1 << 24)[0] > 24


def test_meetings_are_the_same_however_rows_are_batched():
    rng = np.random.default_rng(6)
    rows = []
    for v, size in enumerate([1, 2, 3, 32, 33, 1, 200, 5, 2, 40]):
        middle = rng.integers(-(1 << 63), 1 << 63, 4)
        rows += [(v, int(k), *(middle ^ (1 << int(rng.integers(0, 60))))) for k in rng.integers(0, 1 << 40, size)]
        rows += [(v, -1, *rng.integers(-(1 << 63), 1 << 63, 4))] if size == 5 else []
    rows = np.array(rows).T
    for each in (1, 7, 64, 1000):
        found = np.concatenate([*nearcopies.meetings(rows[:, i : i + each] for i in range(0, rows.shape[1], each))], axis=1)
        told = {(v, key) for v, key, _, _ in found.T.tolist()}
        assert told == {(v, key) for v, key, *_ in rows.T.tolist() if v not in (0, 5) and key != -1} and found.shape[1] == len(told)
        for v, size in ((1, 2), (2, 3), (3, 32), (7, 5)):
            own = found[:, found[0] == v]
            assert set(own[2]) == {own[1].min()} and set(own[3]) == {size}
        for v in (4, 6, 9):
            own = found[:, found[0] == v]
            assert len(set(own[2])) == 1 and own[2, 0] in own[1] and (own[3] > nearcopies.CROWD).all()
