"""SimHash, language, fingerprints, repeated windows and packing against plain Python."""

import hashlib
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from codestrata.llm import components, language, simhash, weighted
from codestrata.llm.components import connected_components
from codestrata.llm.packing import binary_pieces, pack
from codestrata.llm.queries import op2_simhash, op4_language, op8_fingerprint, op9_repeats, op10_pack
from codestrata.llm.repeats import LENGTH, remove_repeats
from codestrata.llm.simhash import near_duplicates, one_of_each

DATA = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, id long, uid string, bucket int, lang_pred string"
LONG = "a very long text of many words " * 4000
ODD = [
    (1, None, "en", "s", 1, "x", 1, "y"), (2, "", None, "s", 1, "x", 1, "y"), (3, LONG, "en", "s", 1, "x", 1, "y"), (3, LONG, "en", "s", 1, "x", 1, "y"), (4, LONG + "end", "en", None, 1, "x", 1, "y"),
    (None, "a text without an id but with more than fifty bytes in it, as it is", "de", "s", None, None, None, None), (6, "a text without an id but with more than fifty bytes in it, as it is", "de", "s", 1, "x", 1, "y"),
    (7, "é\U0001f600 ½ 12 <|endoftext|> ΑΣ", "de", "s", 1, "x", 1, "y"), (8, " \t\n", "en", "s", 1, "x", 1, "y"),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Least id reachable for each id of {id: fingerprint}."""
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 3 and find(a) != find(b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in fps}


def test_simhash(spark, docs):
    fps = {i: plain_fingerprint(t) for i, t in docs.items()}
    least = plain_components(fps)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op2_simhash(spark, DATA).collect()} == {i: (f"{fps[i]:016x}", least[i]) for i in fps}


@pytest.mark.parametrize("paired", [2, 32])
def test_links_of_a_dense_cloud(spark, paired, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRED", paired)
    rng = np.random.default_rng(5)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 300)}
    for center in list(fps)[:3]:
        for _ in range(120):
            x = center
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    signed = {x: simhash._signed(x) for x in fps}
    df = spark.createDataFrame([(x,) for x in signed.values()], "fp long")
    roots = {r.node: r.root for r in connected_components(simhash.links(df)).collect()}
    found = {x: roots.get(s, s) for x, s in signed.items()}
    wanted = plain_components({x: x for x in fps})
    assert len(set(zip(found.values(), wanted.values(), strict=True))) == len(set(found.values())) == len(set(wanted.values()))


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_components_of_a_path(spark, at_once, monkeypatch):
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (7, 7)], "a long, b long")
    assert {r.node: r.root for r in connected_components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100}
    assert connected_components(edges.limit(0)).count() == 0


def test_simhash_edges(spark):
    rows = sorted((r.doc_id or 0, r.component_id) for r in near_duplicates(odd(spark)).collect())
    assert rows == [(0, 6), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (6, 6), (7, 7), (8, 1)]
    assert sorted(r.doc_id for r in one_of_each(odd(spark)).collect()) == [1, 3, 6, 7]
    assert one_of_each(odd(spark)).columns == odd(spark).columns
    assert near_duplicates(odd(spark).limit(0)).count() == 0


def plain_posteriors(scores, moves, starts):
    """Marginals by listing all label sequences."""
    n, k = scores.shape
    total = np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = np.exp(starts[path[0]] + sum(scores[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
        for i, y in enumerate(path):
            total[i, y] += weight
    return total / total.sum(axis=1, keepdims=True)


def test_forward_backward():
    rng = np.random.default_rng(1)
    lengths = [1, 5, 2, 6, 1]
    scores, moves, starts = rng.normal(size=(15, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    first = np.zeros(15, bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    wanted = np.concatenate([plain_posteriors(scores[a : a + n], moves, starts) for a, n in zip(np.cumsum([0, *lengths[:-1]]), lengths, strict=True)])
    for run in (4, 128):
        assert np.allclose(language.forward_backward(scores, first, moves, starts, run)[0], wanted)


def test_language(spark):
    rows = op4_language(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    unseen = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in unseen) >= 0.97 * len(unseen) and len(unseen) > 20
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_learns_nothing_from_held_out_rows(spark):
    texts = language.sample(spark.read.parquet(f"{DATA}/documents.parquet").withColumn("lang", F.when(language.held_out(), "wrong").otherwise(F.col("lang"))))
    assert texts and "wrong" not in {label for _, label in texts}


def test_language_of_switched_text(spark):
    field = language.train(language.sample(spark.read.parquet(f"{DATA}/documents.parquet")))
    words = "the and of with der und nicht sich les dans pour avec".split()
    first = np.zeros(len(words), bool)
    first[0] = True
    found = [field.labels[i] for i in field.posteriors(field.scores(words), first).argmax(axis=1)]
    assert found == ["en"] * 4 + ["de"] * 4 + ["fr"] * 4


def test_language_edges(spark):
    df = odd(spark)
    rows = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(df).collect()}
    assert rows[1] == rows[2] == rows[8] == ("und", 0.0)
    assert {r.doc_id for r in language.known_language(df).collect()}.isdisjoint({1, 2, 8})
    assert language.known_language(df).columns == df.columns
    assert language.identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def jaccard(a, b):
    a, b = Counter(a.lower().split()), Counter(b.lower().split())
    most = sum(max(a[w], b[w]) for w in a | b)
    return sum(min(a[w], b[w]) for w in a | b) / most if most else 1.0


def test_fingerprints(spark, docs):
    rows = sorted(op8_fingerprint(spark, DATA).collect(), key=lambda r: -r.doc_id)
    off = []
    for r, after in zip(rows, [*rows[1:], rows[0]], strict=True):
        text, following = docs[r.doc_id], docs[after.doc_id]
        n = len(text) // 3
        changed = text[: len(text) - n] + following[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        off += [r.near_edited - jaccard(text, changed), r.near_next - jaccard(text, following)]
        same = [r.fingerprint[i : i + 4] == after.fingerprint[i : i + 4] for i in range(0, len(r.fingerprint), 4)]
        assert r.near_next == sum(same) / len(same)
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.08
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r.doc_id], r.fingerprint) == r.fingerprint


def test_fingerprints_in_many_ranges_agree(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(map(str, weighted.fingerprint_pairs(df, piece_bytes=1 << 14).collect())) == sorted(map(str, weighted.fingerprint_pairs(df).collect()))


def test_weighted_likeness_is_the_generalised_jaccard_similarity():
    texts = ["x " * 10 + "y " * 5, "x " * 5 + "y " * 10]
    many = [" ".join(f"{w}{i}" for w in t.split()) for i in range(60) for t in texts]
    found = weighted.signatures(many)
    assert abs((found[::2] == found[1::2]).mean() - 0.5) < 0.03


def test_fingerprint_edges(spark):
    rows = weighted.fingerprint_pairs(odd(spark)).collect()
    assert len(rows) == len(ODD) and [r.n_chars for r in rows if r.doc_id == 1] == [0]
    empty = {r.fingerprint for r in rows if r.doc_id in (1, 2, 8)}
    assert len(empty) == 1
    single = weighted.fingerprint_pairs(odd(spark).filter("doc_id = 6")).collect()
    assert [r.near_next for r in single] == [1.0]
    assert weighted.fingerprint_pairs(odd(spark).limit(0)).count() == 0


def plain_repeats(rows):
    first, out = {}, []
    for key, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - LENGTH + 1):
            w = data[p : p + LENGTH]
            first[w] = min(first.get(w, key), key)
    for key, text in rows:
        data = (text or "").encode()
        gone, end = bytearray(len(data)), 0
        for p in range(len(data) - LENGTH + 1):
            if first[data[p : p + LENGTH]] < key:
                s = max(p, end)
                gone[s : p + LENGTH] = b"\1" * (p + LENGTH - s)
                end = p + LENGTH
        kept = bytes(x for x, g in zip(data, gone, strict=True) if not g)
        out.append((len(data), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_repeats(spark, docs):
    wanted = plain_repeats(sorted(docs.items()))
    assert sum(w[1] for w in wanted) > 0
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op9_repeats(spark, DATA).collect()) == wanted


def test_repeats_of_monotonous_texts(spark):
    rng = np.random.default_rng(3)
    texts = ["ab" * 40, "b" * 49, "b" * 200, "ab" * 24 + "a", "b" * 51 + "c", "x" + "ab" * 60 + "y"] + ["".join(rng.choice(list("ab"), 300)) for _ in range(4)]
    texts += [texts[-1][100:180] + texts[-2][20:95] + "é" * 30, "é" * 40, texts[2]]
    rows = list(enumerate(texts))
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found) == plain_repeats(rows)


def test_repeats_edges(spark):
    found = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(odd(spark)).collect())
    assert found == plain_repeats([(2**63 - 1 if r[0] is None else r[0], r[1]) for r in ODD])
    assert remove_repeats(odd(spark).limit(0)).count() == 0


def plain_packed(docs):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = {}
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out[i] = (len(ids), ids)
    return out


def test_pack(spark, docs):
    wanted = plain_packed(docs.items())
    rows = op10_pack(spark, DATA).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in rows:
        n, ids = wanted[r.doc_id]
        assert r.doc_tokens == n and r.offset == 0 and r.length in {1 << i for i in range(12)}
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        got.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, (n, _) in wanted.items():
        at = 0
        for start, length in sorted(got[i]):
            assert start == at
            at += length
        assert at == n


def test_binary_pieces():
    assert binary_pieces(2048 * 2 + 5, 2048) == [(0, 2048), (2048, 2048), (4096, 4), (4100, 1)]
    assert binary_pieces(1, 2048) == [(0, 1)]


def test_pack_edges(spark):
    rows = pack(odd(spark), TOKENIZER, with_ids=True).collect()
    wanted = plain_packed([(r[0], r[1]) for r in ODD])
    for i in {r[0] for r in ODD} - {3}:
        assert [x for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start) for x in r.ids] == wanted[i][1].tolist()
    assert sum(r.doc_id == 3 and r.start == 0 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id == 1] == [1]
    assert pack(odd(spark).limit(0), TOKENIZER).count() == 0


def test_pack_every_code_point(spark):
    """Capitals, marks and letters in and beyond the simple range, alone and in words."""
    points = [chr(i) for i in [*range(0x21, 0x700), *range(0x1E00, 0x2100), 0xFB01, 0x1F600] if not 0xD800 <= i < 0xE000]
    rows = [(i, f"{c} a{c} {c}b A{c}B 1{c}") for i, c in enumerate(points)] + [(9000, "\u018fli QARABA\u011e \u018f\u014a\u0186")]
    wanted = plain_packed(rows)
    got = {}
    for r in pack(spark.createDataFrame(rows, "doc_id long, text string"), TOKENIZER, with_ids=True).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.ids))
    assert {i: [x for _, ids in sorted(p) for x in ids] for i, p in got.items()} == {i: ids.tolist() for i, (_, ids) in wanted.items()}


def test_pack_numbers_sequences_by_bucket(spark):
    rows = sorted(op10_pack(spark, DATA).collect(), key=lambda r: r.sequence_id)
    assert [r.sequence_id for r in rows] == list(range(len(rows)))
    assert [r.bucket for r in rows] == sorted(r.bucket for r in rows) and all(r.length == 1 << r.bucket for r in rows)


def test_language_of_many_labels():
    rows = [(" ".join(f"{chr(97 + i % 26)}{chr(97 + i // 26)}word{j}" for j in range(8)), f"l{i}") for i in range(70)]
    field = language.train(rows, epochs=2)
    assert len(field.labels) == 70 and field.membership(language.words_of(rows[69][0])[:1])[0].argmax() == field.labels.index("l69")


def test_language_learns_from_whole_rows_within_its_bound(spark):
    rows = [(i, "wort " * 2000 + f"ende{i}", "de") for i in range(40)] + [(100 + i, f"one two {i}", "en") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taken = language.sample(df, rows_per_label=10, chars_per_label=50_000)
    assert 3 <= sum(lang == "de" for _, lang in taken) <= 5 and sum(lang == "en" for _, lang in taken) == 10
    assert all("ende" in t for t, lang in taken if lang == "de")


def test_one_of_each_is_the_same_for_rows_that_share_an_id(spark):
    rows = [(1, "a b c d"), (1, "e f g h"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in one_of_each(df).collect()) == [(1, "a b c d"), (1, "e f g h")]
