"""Sharding, personal data and mixing against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from codestrata.llm.mixing import mix_sources, mixed_documents
from codestrata.llm.pii import digest, find_pii, redact
from codestrata.llm.queries import op5_shard, op6_pii, op7_mix
from codestrata.llm.sharding import shard_by_splitters

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, _key int, spans string"
ODD = [
    (1, None, "en", "a", None, "x", 1, "s"),
    (2, "", "en", "a", 0, "x", 1, "s"),
    (3, "a@b.co " * 300 + "x" * 50000, None, None, 1, None, None, None),
    (3, "a@b.co " * 300 + "x" * 50000, None, None, 1, None, None, None),
    (None, "one two", "en", "b", 7, "x", 1, "s"),
    (5, "é\U0001f600 +49 30 123456789, 1.2.3.4.5, 4111 1111 1111 1111", "de", "b", 1, "x", 1, "s"),
    *((10 + i, "same text of many", "en", "hot", 17, "x", 1, "s") for i in range(60)),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def docs(spark):
    return [r.asDict() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(d[::2]) % 10 == -sum(sum(divmod(2 * x, 10)) for x in d[1::2]) % 10:
            out.append((m.start(), 2, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def test_pii_base_spans_match_plain_patterns(spark):
    wanted = {d["doc_id"]: base_spans(d["text"] or "") for d in docs(spark)}
    assert sum(map(len, wanted.values())) > 0
    for r in op6_pii(spark, DATA).collect():
        spans = wanted[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in spans).encode()).hexdigest()
        kinds = Counter(k for _, _, k, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(kinds[k] for k in ("email", "ip", "card", "phone"))


HARD = [
    "a@b.c_d@e.f x@y z@@w.com a.b@c..d q@r.s.", "1.2.3.4.5.6.7.8.9 256.1.1.1 0001.02.3.255 1..2.3.4", "4111-1111 1111-1111 4111  1111 1111 1111 411111111111111111111",
    "+1 (555) 010-9999. +49-30-1234 +1.2", "7 " * 9000, "9" * 30000, "a." * 20000 + "@", "x@" + "y." * 20000, "+1" + " " * 20000 + "2 345 678 901", "a@b.co 1.1.1.1", "٣٤٥ a@b.cö",
]


def test_pii_hard_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(HARD)], "doc_id long, text string")
    for r in find_pii(df).select("doc_id", digest(F.expr("filter(spans, x -> x.k < 4)")).alias("d")).collect():
        assert r.d == ",".join(f"{k}:{s}:{e}" for s, _, k, e in base_spans(HARD[r.doc_id])), HARD[r.doc_id][:40]


def test_pii_checksums_and_context(spark):
    texts = ["IBAN GB82 WEST 1234 5698 7654 32 ok", "GB83WEST12345698765432", "my ssn is 123-45-6789", "part 123-45-6789"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.d for r in find_pii(df).select("doc_id", digest(F.col("spans")).alias("d")).collect()}
    assert got == {0: "iban:5:32", 1: "", 2: "ssn:10:21", 3: ""}


def test_pii_ibans_among_capitals_and_digits(spark):
    texts = {"DE89 3704 0044 0532 0130 00 BIC COBADEFF": "iban:0:27", "DE89370400440532013000 EUR 500": "iban:0:22", "to DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32.": "iban:3:30,iban:31:58", "REF 1234 AB12 DE89370400440532013000": "iban:14:36", "DE88 3704 0044 0532 0130 00 BIC": "", "NO93 8601 1117 947": "iban:0:18", "xDE89370400440532013000": "", "é\U0001f600 DE89370400440532013000\nEUR": "iban:3:25"}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.d for r in find_pii(df).select("doc_id", digest(F.expr("filter(spans, x -> x.kind = 'iban')")).alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())
    clean = {r.text for r in redact(df.filter("doc_id < 2")).collect()}
    assert clean == {"<IBAN> BIC COBADEFF", "<IBAN> EUR 500"}


def test_pii_edges(spark):
    rows = find_pii(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert {r.doc_id: len(r.spans) for r in rows if r.doc_id in (1, 2, 3)} == {1: 0, 2: 0, 3: 300}
    assert find_pii(odd(spark).limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in redact(odd(spark)).collect()}
    assert clean[5] == "é\U0001f600 <PHONE>, <IP>.5, <CARD>"
    assert clean[1] is None and clean[2] == "" and clean[3].startswith("<EMAIL> <EMAIL>")
    assert redact(odd(spark)).columns == odd(spark).columns


def sharded(df):
    return [r.asDict() for r in df.collect()]


def test_shards(spark):
    sizes = {d["doc_id"]: len((d["text"] or "").encode()) + 8 for d in docs(spark)}
    rows = sharded(op5_shard(spark, DATA))
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    assert all(r["text_crc32"] == zlib.crc32(d["text"].encode()) for d in docs(spark) for r in rows if r["doc_id"] == d["doc_id"])
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r)
    total, largest = sum(sizes.values()), max(sizes.values())
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - total / 24) <= total / 24 / 16 + largest


@pytest.mark.parametrize("samples", [10, 500])
def test_shards_do_not_depend_on_the_sample(spark, samples):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    assert sorted(map(str, sharded(shard_by_splitters(df, samples=samples, together=4)))) == sorted(map(str, sharded(shard_by_splitters(df, together=4))))


def test_shards_edges(spark):
    df = odd(spark)
    rows = sharded(shard_by_splitters(df, 4))
    assert len(rows) == len(ODD) and {r["law"] for r in rows} == {"bytes"}
    assert [r["size"] for r in rows if r["doc_id"] == 1] == [8]
    hot = [(i, "x" * 100, None) for i in range(500)]
    even = Counter(r["shard"] for r in sharded(shard_by_splitters(spark.createDataFrame(hot, "doc_id long, text string, size int"), 5)))
    assert set(even.values()) == {100}
    assert shard_by_splitters(df.limit(0)).count() == 0


def targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        level = rest / sum(weight[s] for s in names if s not in full)
        more = {s for s in names if s not in full and level * weight[s] > cap * sizes[s]}
        if not more:
            return {s: cap * sizes[s] if s in full else level * weight[s] for s in names}
        full |= more


def check_mix(rows, source_of):
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[source_of[r["doc_id"]]] += r["size"]
        taken[source_of[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    wanted = targets(sizes)
    for r in rows:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(wanted[s])
    for s, t in wanted.items():
        assert abs(taken[s] - t) <= 1


def test_mix(spark):
    all_docs = docs(spark)
    rows = sharded(op7_mix(spark, DATA))
    assert {r["doc_id"]: r["size"] for r in rows} == {d["doc_id"]: len((d["text"] or "").encode().split()) for d in all_docs}
    check_mix(rows, {d["doc_id"]: d["source"] for d in all_docs})
    assert sorted(map(str, rows)) == sorted(map(str, sharded(op7_mix(spark, DATA))))


def test_mix_with_a_hot_and_a_tiny_source(spark):
    data = [(i, " ".join("w" * (1 + i % 7)), "z") for i in range(300)] + [(1000, "a b", "a"), (1001, "c", None), (1002, None, "empty")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    rows = sharded(mix_sources(df, bands=8))
    check_mix(rows, {d: s for d, _, s in data})
    assert sum(r["taken"] > 0 for r in rows) > 1
    copies = Counter(r.doc_id for r in mixed_documents(df, bands=8).collect())
    assert {d: n for d, n in copies.items()} == {r["doc_id"]: -(-r["taken"] // r["size"]) for r in rows if r["taken"]}


def test_mix_edges(spark):
    assert len(sharded(mix_sources(odd(spark)))) == len(ODD)
    assert mix_sources(odd(spark).limit(0)).count() == 0
    assert mixed_documents(odd(spark)).columns == odd(spark).columns


def test_pii_many_spans_in_a_long_text(spark):
    text = "x 10.0.0.1 write a@b.co " * 3000 + "é" * 3000 + " a@b.co"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = find_pii(df).first().spans
    assert len(spans) == 6001 and all(text[x.s : x.e] == ("a@b.co" if x.kind == "email" else "10.0.0.1") for x in spans)
    assert redact(df).first().text == text.replace("10.0.0.1", "<IP>").replace("a@b.co", "<EMAIL>")


def test_pii_context_moves_scores(spark):
    rows = [(1, "call +1 555 010 9999"), (2, "order +1 555 010 9999"), (3, "so +1 555 010 9999")]
    got = {r.doc_id: r.spans[0].score for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] > got[3] > got[2]
