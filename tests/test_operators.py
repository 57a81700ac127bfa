"""Operators on small inputs with results worked out by hand or by plain Python."""

import difflib
import hashlib
import itertools
import math
import random
import sqlite3

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codestrata.functions import ids, stats, text
from codestrata.operators import aggregates, joins, mining, ranking, search
from codestrata.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("value", ["", "a", "a\nb", "a\n", "\n", "a\r\nb\x0bc\x0cd\x1ce\x85f g ", "a\n\n"])
def test_lines_are_those_of_python(spark, value):
    assert one(spark, text.lines(F.lit(value))) == value.splitlines()


def test_text_rules(spark):
    assert one(spark, text.first_line(F.lit("  \n fix: x \nmore"))) == "fix: x "
    assert one(spark, text.first_line(F.lit(" \n "))) is None
    assert one(spark, text.squeezed(F.lit("f( 'a',\n 1, )"))) == 'f("a",1)'
    assert one(spark, text.reappearing(F.lit("x = 1,\n\n  y = 'a'\nz"), F.lit('x=1\ny = "a"'))) == 2
    assert one(spark, text.tokens(F.lit("Éa_b-c1 日本"))) == ["ea", "b", "c1", "日本"]
    assert one(spark, text.issue_numbers(F.lit("fixes #12, `#3` and #4 #12"))) == [4, 12]
    assert one(spark, text.sentences(F.lit("One sentence here. Two!\n- third one here <!-- no. -->"))) == ["One sentence here.", "third one here"]


def test_statistics(spark):
    low, high = one(spark, F.struct(*[c.alias(n) for c, n in zip(stats.wilson(F.lit(8), F.lit(10)), "ab", strict=True)]))
    assert (round(low, 4), round(high, 4)) == (0.4902, 0.9433)
    for wins, losses in ((3, 9), (0, 4), (5, 5)):
        tail = 2 * sum(math.comb(wins + losses, i) for i in range(min(wins, losses) + 1)) / 2 ** (wins + losses)
        assert one(spark, stats.sign_test(F.lit(wins), F.lit(losses))) == pytest.approx(min(1, tail))
    assert one(spark, stats.kappa(F.lit(1.0), F.lit(1.0))) is None


def test_hash_shards(spark):
    rows = spark.range(50).select(F.col("id").cast("string").alias("i"), ids.shard_of(F.col("id").cast("string"), 7).alias("s")).collect()
    assert all(r.s == int(hashlib.sha256(r.i.encode()).hexdigest(), 16) % 7 for r in rows)


def test_dense_counts_reject_unknown_values(spark):
    df = spark.createDataFrame([("a",), ("a",)], "v string")
    assert {r.value: r.n for r in aggregates.dense_counts(df, "v", ["a", "b"]).collect()} == {"a": 2, "b": 0}
    with pytest.raises(PySparkException):
        aggregates.dense_counts(df, "v", ["b"]).collect()


def test_agreement(spark):
    pairs = spark.createDataFrame([("y", "y")] * 20 + [("y", "n")] * 5 + [("n", "y")] * 10 + [("n", "n")] * 15, "a string, b string")
    assert aggregates.agreement(pairs, "a", "b").first().kappa == pytest.approx(0.4)
    same = spark.createDataFrame([("y", "y")] * 3, "a string, b string")
    assert aggregates.agreement(same, "a", "b").first().kappa is None


def test_class_scores(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("c", "a")], "t string, g string")
    rows = {r.label: (r.precision, r.recall, r.f1) for r in aggregates.class_scores(df, "t", "g").collect()}
    assert rows["a"] == (1 / 3, 0.5, 0.4) and rows["b"] == (0.0, 0.0, 0.0) and rows["c"] == (None, 0.0, 0.0)


def test_first_rule_wins(spark):
    df = spark.createDataFrame([(1, "r", "src/a"), (2, "r", "doc"), (3, "q", "src")], "i int, repo string, path string")
    rules = spark.createDataFrame([("r", 2, "", "B"), ("r", 1, "src/", "A")], "repo string, o int, prefix string, lic string")
    out = joins.first_rule(df, rules, ["repo"], F.col("path").startswith(F.col("prefix")), "i", "o", "lic")
    assert {r.i: r.lic for r in out.collect()} == {1: "A", 2: "B", 3: None}


def test_attach(spark):
    left = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, m string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (4, "x")], "k int, m string")
    assert {r.k: r.status for r in joins.attach(left, right, "k", "m").collect()} == {1: "attached", 2: "stale", 3: "missing", 4: "orphan"}


def test_ranking(spark):
    counts = spark.createDataFrame([("a", 41), ("b", 33), ("c", 26)], "k string, n long")
    assert {r.k: r.seats for r in ranking.largest_remainder(counts, "k", "n", 10).collect()} == {"a": 4, "b": 3, "c": 3}
    df = spark.range(10).withColumn("g", F.lit(1))
    assert sorted(r.id for r in ranking.spread(df, ["g"], F.col("id"), 4).collect()) == [0, 3, 6, 9]
    assert [r.id for r in ranking.top_share(df, 25, F.desc("id")).collect()] == [9, 8, 7]
    picks = [sorted(r.id for r in ranking.hash_sample(df.repartition(n), ["g"], "id", 3, "s").collect()) for n in (1, 4)]
    assert picks[0] == picks[1]


SOURCE = '''import os
@deco
def outer(a, b=(1, 2)) -> int:
    """Doc."""
    def inner(x):
        return x  # note
    return os.path.join(a, inner("s"))

class C:
    async def m(self): return 1
'''


def test_functions_of_a_source():
    found = [(f["name"], f["signature"], f["start_line"], f["end_line"]) for f in mining.functions_of(SOURCE)]
    assert found == [("outer", "def outer(a, b=(1, 2)) -> int:", 2, 7), ("inner", "def inner(x):", 5, 6), ("m", "async def m(self):", 10, 10)]
    assert [f["name"] for f in mining.functions_of("def ok():\n    pass\n\ndef broken(:\n    pass\n\ndef fine():\n    pass\n")] == ["ok", "fine"]
    assert mining.functions_of(None) == []


def test_normal_form_ignores_names_and_literals():
    one_, other = "def f(a):\n    '''doc'''\n    b = a + 1\n    return g(b, 'x')\n", "def f(q):\n    z = q + 22  # other\n    return g(z, 'yy')\n"
    assert mining.plain_body(one_) == mining.plain_body(other) == ["def f ( VAR ) :", "VAR = VAR + NUM", "return g ( VAR , STR )"]
    assert mining.plain_body(one_) != mining.plain_body(one_.replace("g(", "h("))
    assert mining.plain_body("") == mining.plain_body(None) == mining.plain_body("# only this\n") == []


def test_diff_lines():
    diff = "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -2,2 +2 @@\n--- a/trick\n-b\n+++ c\n@@ -9 +8,0 @@\n-z\ndiff --git a/n.py b/n.py\n--- /dev/null\n+++ b/n.py\n@@ -0,0 +1 @@\n+new\n"
    assert [(x["old_path"], x["new_path"], x["kind"], x["line"], x["text"], x["hunk"]) for x in mining.diff_lines(diff)] == [
        ("x.py", "x.py", "deleted", 2, "-- a/trick", 0), ("x.py", "x.py", "deleted", 3, "b", 0), ("x.py", "x.py", "added", 2, "++ c", 0), ("x.py", "x.py", "deleted", 9, "z", 1), (None, "n.py", "added", 1, "new", 0)
    ]


def plain_moves(deleted, added):
    pairs = []
    for (i, x), (j, y) in itertools.product(deleted.items(), added.items()):
        if x and y and (max(len(x), len(y)) - min(len(x), len(y))) * 5 <= max(len(x), len(y)):
            ratio = difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
            if ratio >= 0.9:
                pairs.append((-ratio, i, j))
    out, gone, taken = set(), set(), set()
    for _, i, j in sorted(pairs):
        if i not in gone and j not in taken:
            out.add((i, j))
            gone.add(i)
            taken.add(j)
    return out


def test_moves(spark):
    rng = random.Random(4)
    bodies = [[f"line {rng.randrange(40)}" for _ in range(n)] for n in (1, 3, 10, 11, 12, 20, 24, 25)]
    deleted = {f"d{i}": b for i, b in enumerate(bodies)}
    added = {f"a{i}": b[: len(b) - (i % 3)] + ["new"] * (i % 2) for i, b in enumerate(bodies + bodies[:3])}
    added["empty"] = []
    frame = lambda x: spark.createDataFrame([("c", k, v) for k, v in x.items()], "commit string, id string, lines array<string>")
    found = {(r.deleted_id, r.added_id) for r in mining.greedy_matches(mining.move_candidates(frame(deleted), frame(added).repartition(3))).collect()}
    assert found == plain_moves(deleted, added) and found


def test_bm25_is_that_of_sqlite(spark):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "x1"]
    rows = [(i, rng.choice(words), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(80)]
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(repo, body)")
    except sqlite3.OperationalError:
        pytest.skip("this SQLite has no full-text index")
    db.executemany("INSERT INTO t(rowid, repo, body) VALUES (?, ?, ?)", rows)
    df = spark.createDataFrame(rows, "id int, repo string, body string")
    for asked, match in (("gamma", '"gamma"'), ("alpha*", '"alpha"*'), ("beta-gamma x1", '"beta gamma" AND "x1"')):
        wanted = dict(db.execute("SELECT rowid, bm25(t, 10.0, 2.0) FROM t WHERE t MATCH ?", (match,)).fetchall())
        found = {r.id: r.score for r in search.bm25(df, "id", asked).collect()}
        assert found.keys() == wanted.keys() and wanted
        assert all(found[i] == pytest.approx(wanted[i], abs=1e-9) for i in wanted)


def test_vectors(spark):
    df = spark.createDataFrame([(2, [1.0, 0.0]), (1, [1.0, 0.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert [r.id for r in search.vector_topk(df, "id", "v", [2.0, 1.0], 2).collect()] == [1, 2]
    assert one(spark, search.normalised(F.array(F.lit(3.0), F.lit(4.0)))) == [0.6, 0.8]
    assert search.compile_query('a-b* "--" x') == [(["a", "b"], True), (["x"], False)]


def test_files(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": "a b"}\n\n{"x": "c"}\n')
    assert sorted(r.x for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x string").collect() if r.x) == ["a b", "c"]
    (tmp_path / "r.csv").write_text("repo,n\na,1\na,2\n")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(tmp_path / "r.csv"), "repo string, n int", unique="repo")
    assert files.file_hashes(spark, str(tmp_path / "r.csv")).first().sha256 == hashlib.sha256(b"repo,n\na,1\na,2\n").hexdigest()


def test_uuid5(spark):
    import uuid

    assert one(spark, ids.uuid5(str(uuid.NAMESPACE_URL), F.lit("a/ü"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "a/ü"))


def test_partitions(spark):
    from codestrata.operators.partitions import partition_accuracy, set_partitions

    assert len(list(set_partitions("ABCDEFG", (3, 4)))) == 651
    df = spark.createDataFrame([("A", "A"), ("A", "B"), ("C", "D"), ("U", "A")], "t string, g string")
    best = partition_accuracy(df, list("ABCD"), (2,), "t", "g").orderBy(F.desc("hits"), "partition").first()
    assert (best.partition, best.hits, best.n) == ("A+B|C+D", 3, 4)


def test_log_and_shards(spark):
    from codestrata.operators.history import commit_pairs, parse_log, size_bounded_shards

    raw = "\x00".join(["a\x1fr\x1f5\x1fme\x1fone\x1ftwo", "b\x1fa r\x1f6\x1fme\x1fmerge", "c\x1f\x1f7\x1fme\x1froot", "a\x1fq\x1f5\x1fme\x1fagain", ""])
    entries = spark.createDataFrame([(raw,)], "raw string").select(F.explode(parse_log(F.col("raw"))).alias("x")).select("x.*")
    assert [(r.sha, r.parents, r.message) for r in entries.orderBy("position").collect()][:2] == [("a", ["r"], "one\x1ftwo"), ("b", ["a", "r"], "merge")]
    assert [(r.sha, r.parent) for r in commit_pairs(entries).collect()] == [("a", "r")]
    df = spark.createDataFrame([("k", i, n) for i, n in enumerate([4, 4, 4, 8, 1])], "k string, i int, n int")
    assert [r.shard for r in size_bounded_shards(df, "k", "i", F.col("n"), 8).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    with pytest.raises(Exception, match="larger than a shard may be"):
        size_bounded_shards(df, "k", "i", F.col("n"), 7).collect()


def test_token_similarity_of_all_neighbours(spark):
    from codestrata.plans.history import rpl_token_similarity

    data = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    wanted = {i: round(difflib.SequenceMatcher(None, t.split(), texts[i + 1].split()).ratio(), 6) for i, t in texts.items() if i + 1 in texts}
    assert max(map(len, texts.values())) >= 2000
    assert {r.doc_id: r.similarity for r in rpl_token_similarity(spark, data).collect()} == pytest.approx(wanted)


def test_moves_of_a_whole_table(spark, tmp_path):
    from codestrata.plans.moves import mov_greedy

    rng = random.Random(8)
    bodies = [[f"line {rng.randrange(60)}" for _ in range(n)] for n in (1, 3, 10, 11, 12, 20, 24, 40)]
    texts = [b for b in bodies for _ in range(5)] + [b[:-1] + ["new"] for b in bodies for _ in range(3)] + [b[: len(b) - 2] for b in bodies] + [[]]
    rng.shuffle(texts)
    docs = {i * 77: x for i, x in enumerate(texts)}
    spark.createDataFrame([(i, "\n".join(x), "en") for i, x in docs.items()], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.deleted_id, r.added_id) for r in mov_greedy(spark, str(tmp_path)).collect()}
    assert found == plain_moves({i: x for i, x in docs.items() if i % 2 == 0}, {i: x for i, x in docs.items() if i % 2}) and found


def test_sentences_and_references_of_documents_with_code(spark, tmp_path):
    from codestrata.plans.texts import cls_sentences, issue_refs

    rows = [(1, "First sentence. ```\ncode is no sentence.\n``` Second one #3."), (2, "Seen here <!-- not this one #9 --> and `#4` there #5."), (3, "Plain sentence #7.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.sentences for r in cls_sentences(spark, str(tmp_path)).collect()} == {1: ["First sentence.", "Second one #3."], 2: ["Seen here   and `#4` there #5."], 3: ["Plain sentence #7."]}
    assert {r.doc_id: r.issues for r in issue_refs(spark, str(tmp_path)).collect()} == {1: [3], 2: [5, 9], 3: [7]}
