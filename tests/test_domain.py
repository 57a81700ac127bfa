"""Rules, labels, selection, moves and the index, at their edges; queries without SQL against plain Python."""

import difflib
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from codestrata import catalog
from codestrata.functions.refs import merged_references, pull_number, references
from codestrata.functions.stats import sign_test
from codestrata.functions.text import plain
from codestrata.operators import exporting, labels, rules
from codestrata.operators.index import FilterError, Index, best_snippet, check_filters, compile_query, write_index
from codestrata.operators.joins import same_file_comments, with_next
from codestrata.operators.mining import diff_hunks, diff_path, greedy_matches, replacement_of, written_alike
from codestrata.operators.partitions import set_partitions
from codestrata.operators.ranking import ranked, spread, top_share, water_filled
from codestrata.sources.files import work_folder

DATA = "/root/testdata/sf0.001"


def told(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'long' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("fixes #1, #2 and `#3`", [(True, 1), (False, 2)]),
        ("Closes: org/own#4 other/x#5 a/b#6", [(True, 4)]),
        ("resolved https://github.com/Org/Own/issues/7 https://github.com/a/b/pull/8", [(True, 7)]),
        ("GH-9 gh 10 GH#11 fixed GH-12", [(True, 12), (False, 9), (False, 10), (False, 11)]),
        ("##1 x#2 /#3 -#4 #5a #6", [(False, 6)]),
        ("#1 fixes #1", [(True, 1)]),
        ("#42 the own one", []),
        ("```\n#1\n``` #2", [(False, 2)]),
        (None, []),
        ("", []),
    ],
)
def test_references(spark, text, wanted):
    found = told(spark, references(F.col("t"), F.lit("org/own"), F.array(F.lit(42).cast("bigint"))), t=text or "") if text is not None else told(spark, references(F.lit(None).cast("string"), F.lit("org/own")), t="")
    assert [(r.closing, r.number) for r in found] == wanted


def test_merged_references_and_pull_numbers(spark):
    one, other = (references(F.lit(t), F.lit("")) for t in ("#3 fixes #9", "fixes #3 #1"))
    assert [(r.closing, r.number) for r in told(spark, merged_references(one, other), t="")] == [(True, 3), (True, 9), (False, 1)]
    for text, number in (("Merge pull request #5 from a (#6)", 5), ("Do it (#6) ", 6), ("Do it (#6) now", None), ("x\nDo (#6)", None), ("", None)):
        assert told(spark, pull_number(F.col("t")), t=text) == number


@pytest.mark.parametrize(
    ("path", "wanted"),
    [
        ("a/venv/core.py", None), ("a/venv/Bin/x.py", ("venv", "venv", "a/venv")), ("lib/python3.9/vendor/x.py", ("venv", "lib/python3.9", "lib/python3.9")), ("vendor/site-packages/x.py", ("site-packages", "site-packages", "vendor/site-packages")),
        ("x/_vendored/y.py", ("vendor", "_vendored", "x/_vendored")), ("api_pb2.py", ("protobuf", "api_pb2.py", "api_pb2.py")), ("_pb2.py", None), ("vendor.py", None), ("", None), ("//", None),
    ],
)
def test_generated_paths(spark, path, wanted):
    found = told(spark, rules.generated_path(F.col("p")), p=path)
    assert (found and tuple(found)) == wanted


def test_places(spark):
    hunks = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(h, ("old_start", "old_count", "new_start", "new_count"), strict=True)]) for h in ((10, 5, 20, 3), (14, 1, 40, 0), (16, 2, 50, 4))])
    assert tuple(told(spark, rules.child_range(hunks, F.lit(12), F.lit(16)), t="")) == (20, 53)
    assert told(spark, rules.child_range(hunks, F.lit(1), F.lit(9)), t="") is None
    assert told(spark, rules.same_position(hunks, F.lit(12), F.lit(13), F.lit(22), F.lit(30)), t="") is True
    assert told(spark, rules.same_position(hunks, F.lit(1), F.lit(9), F.lit(1), F.lit(99)), t="") is False
    site = lambda start, count: told(spark, rules.at_site(F.lit(start), F.lit(count), F.lit(10), F.lit(20)), t="")
    # A hunk that only adds lies between two lines: one line of context on either side still counts.
    assert [site(7, 1), site(8, 1), site(7, 0), site(8, 0), site(9, 0), site(21, 0), site(22, 0), site(22, 1), site(23, 1)] == [False, True, False, True, True, True, False, True, False]


def test_mentions_and_reasons(spark):
    seen = lambda s, name: told(spark, rules.mentioned(F.col("s"), F.col("n")), s=s, n=name)
    assert seen("drop old_fn now", "old_fn") and not seen("drop old_fns", "old_fn") and not seen("update docs", "update") and seen("call update() less", "update") and seen("the `update` path", "update") and seen("parseAll is gone", "parseAll")
    reason = lambda s: told(spark, rules.reason_of(F.col("s")), s=s)
    assert [reason(s) for s in ("Fix a security hole", "use x instead", "never used", "drops support for it", "a CRASH", "faster", "tidy", "nothing", "")] == ["SEC", "LIB", "DEAD", "FEAT", "BUG", "PERF", "DESIGN", "UNK", "UNK"]
    assert told(spark, rules.target_name(F.col("n")), n="__init__") is None and told(spark, rules.target_name(F.col("n")), n="_get_") is None


def test_format_evidence(spark):
    e = told(spark, rules.format_evidence(F.lit("Run Black, black"), F.lit("a = 'x'\n\nb = f(\n  1,\n)"), F.lit('a = "x"\nb = f(1)')), t="")
    assert (e.keywords, e.reappeared_lines, e.deleted_lines) == (["black"], 4, 4)
    assert told(spark, rules.format_evidence(F.lit("blacken"), F.lit("a"), F.lit("a")), t="") is None
    assert told(spark, rules.format_evidence(F.lit("black"), F.lit(" \n"), F.lit("a")), t="") is None


def test_decisions_on_ties(spark):
    scores = F.create_map(*[x for k, v in (("BUG", 0.5), ("SEC", 0.5), ("DEAD", 0.5)) for x in (F.lit(k), F.lit(v))])
    pick = lambda *backed: told(spark, rules.decided(scores, F.array(*[F.lit(b) for b in backed]) if backed else F.array().cast("array<string>")), t="")
    assert pick() == "SEC" and pick("DEAD") == "DEAD" and pick("BUG", "DEAD") == "DEAD"
    assert told(spark, rules.decided(F.create_map(F.lit("BUG"), F.lit(0.0)), F.array(F.lit("BUG"))), t="") == "UNK"


def test_verdicts_at_the_limits(spark):
    at = lambda a, b: told(spark, labels.verdict(F.lit(a), F.lit(b)), t="")
    assert [at(120, 200), at(119, 200), at(80, 200), at(79, 200), at(0, 0)] == ["PROCEED", "TIGHTEN", "TIGHTEN", "PIVOT", "UNDECIDABLE"]
    tag = lambda note: told(spark, labels.has_tag(F.col("n"), "no-context"), n=note)
    assert tag("no-contextで") and tag("x no-context, y") and not tag("no-contexts") and not tag("x-no-context") and not tag("")


@pytest.mark.parametrize(("wins", "losses"), [(0, 0), (5, 0), (3, 9), (400, 500), (400, 700), (600, 600), (5000, 5300), (0, 2000)])
def test_sign_test_of_any_size(spark, wins, losses):
    n, k = wins + losses, min(wins, losses)
    exact = min(1.0, float(2 * sum(math.comb(n, i) for i in range(k + 1)) * 10**400 // 2**n) / 1e308 / 1e92 if n > 1000 and 2 * sum(math.comb(n, i) for i in range(k + 1)) * 10**400 // 2**n < 10**308 else 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    assert told(spark, sign_test(F.col("w"), F.col("l")), w=wins, l=losses) == pytest.approx(exact, rel=1e-6, abs=1e-290)


def test_partitions():
    every = set_partitions(list("abcdefg"), (3, 4))
    assert len(every) == 651 == len({str(p) for p in every})
    assert set_partitions(["a", "b"], (1, 2)) == [[["a", "b"]], [["a"], ["b"]]] and set_partitions([], (1,)) == []


def test_spread_and_shares(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 1)], "k string, i int")
    picked = lambda k: [(r.k, r.i) for r in spread(df, ["k"], F.col("i"), k).orderBy("k", "i").collect()]
    assert picked(1) == [("a", 3), ("b", 1)] and picked(3) == [("a", 0), ("a", 3), ("a", 6), ("b", 1)] and picked(0) == []
    assert sorted(r.place for r in ranked(df, F.desc("i"), "k").collect()) == list(range(8))
    assert [r.i for r in top_share(df, 30, F.desc("i"), F.asc("k")).orderBy(F.desc("i")).collect()] == [6, 5, 4]
    counts = spark.createDataFrame([("a", 2), ("b", 50), ("c", 9)], "k string, n long")
    assert {r.k: r.seats for r in water_filled(counts, "k", "n", 20).collect()} == {"a": 2, "b": 9, "c": 9}
    assert {r.k: r.seats for r in water_filled(counts, "k", "n", 100).collect()} == {"a": 2, "b": 50, "c": 9}


def test_next_rows(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in (-1, 0, 1, 999, 1000, 1001, 5000)], "i long, t string")
    assert {r.i: r.n for r in with_next(df, "i", "t", "n").collect()} == {-1: "t0", 0: "t1", 1: None, 999: "t1000", 1000: "t1001", 1001: None, 5000: None}


def test_comments_of_a_file(spark):
    df = spark.createDataFrame([(1, 3, "a"), (1, 2, "a"), (1, 1, "b"), (2, 5, "b"), (2, 4, "c")], "k int, i int, p string")
    assert {r.k: r.comments for r in same_file_comments(df, "k", "p", F.lit("a"), "i", 2).collect()} == {1: [2, 3], 2: [4, 5]}


def test_diff_paths_and_hunks():
    assert [diff_path(x) for x in ("a/x.py", "/dev/null", '"b/n\\303\\251w \\"q\\".py"', "a/b c.py\t")] == ["x.py", None, 'néw "q".py', "b c.py"]
    found = diff_hunks("--- a/x\n+++ b/x\n@@ -1,2 +1 @@\n--- y\n-z\n+++ w\n@@ -9,0 +9,2 @@\n+p\n+q")
    assert [(h["old_start"], h["old_count"], h["new_start"], h["new_count"], h["added_body"]) for h in found] == [(1, 2, 1, 1, "++ w"), (9, 0, 9, 2, "p\nq")]
    assert diff_hunks(None) == []


def test_replacements():
    hunk = lambda start, count, new, body: {"old_start": start, "old_count": count, "new_start": new, "added_body": body}
    of = lambda hunks, child=None: tuple(replacement_of("f", "def f(a):\n    return a", 10, 12, hunks, child).values())
    whole = "def f(b):\n    return b\nx = 1"
    assert of(None) == (None, None, 0.0) and of([]) == (None, "NONE", 0.0) and of([hunk(1, 1, 1, "x = 1")]) == (None, None, 0.0)
    assert of([hunk(14, 1, 14, whole)]) == ("def f(b):\n    return b", "SAME_LOCATION", 0.9)
    assert of([hunk(15, 1, 15, whole)])[2] == 0.7 and of([hunk(None, None, None, whole)])[2] == 0.7
    assert of([hunk(10, 1, 10, "def f(b):\n    c = b")]) == (None, "SAME_LOCATION", 0.9)
    assert of([hunk(10, 1, 1, "def f(b):\n    c = b")], "def f(b):\n    c = b\n    return c")[0].endswith("return c")


def test_ties_of_moves_go_to_the_likest_as_written(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "commit string, id int, raw_lines array<string>")
    deleted, added = rows(("c", 1, ["x = 1", "y"])), rows(("c", 5, ["q = 7", "z"]), ("c", 6, ["x = 1", "z"]))
    pairs = spark.createDataFrame([("c", 1, 5, 1.0), ("c", 1, 6, 1.0)], "commit string, deleted_id int, added_id int, similarity double")
    assert [r.added_id for r in greedy_matches(pairs).collect()] == [5]
    assert [r.added_id for r in greedy_matches(written_alike(pairs, deleted, added)).collect()] == [6]


def test_moves_against_plain_python(spark):
    """All of the fixtures' documents: the greedy order over all pairs of a language."""
    docs = [(r.lang or "", r.doc_id, [x for line in (r.text or "").splitlines() if (x := line.strip())]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    pairs = []
    for lang, i, a in docs:
        for other, j, b in docs:
            if lang == other and i % 2 == 0 and j % 2 == 1 and a and b:
                m = difflib.SequenceMatcher(None, a, b, autojunk=False)
                if m.real_quick_ratio() >= 0.9 and (m.ratio() >= 0.9) and abs(len(a) - len(b)) * 5 <= max(len(a), len(b)):
                    pairs.append((-m.ratio(), i, j, lang))
    gone, taken, wanted = set(), set(), []
    for s, i, j, lang in sorted(pairs):
        if i not in gone and j not in taken:
            gone.add(i)
            taken.add(j)
            wanted.append((lang, i, j, round(-s, 6)))
    found = [(r.commit, r.deleted_id, r.added_id, round(r.similarity, 6)) for r in catalog.queries()["mov_greedy"](spark, DATA).collect()]
    assert sorted(found) == sorted(wanted) and wanted
    status = {r.id: (r.filter_status, r.destination) for r in catalog.queries()["mov_partition"](spark, DATA).collect()}
    assert status == {i: ("NOISE_MOVE", dict((w[1], w[2]) for w in wanted)[i]) if i in gone else ("KEPT", None) for _, i, _ in docs if i % 2 == 0}
    assert {r.commit: r.moved for r in catalog.queries()["mov_sides"](spark, DATA).collect() if r.moved} == {lang: sum(w[0] == lang for w in wanted) for lang in {w[0] for w in wanted}}


def fold(text):
    return "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if not unicodedata.combining(c))


def test_folding(spark):
    for word in ("Čeština ő ŵ ñ", "Ελλάδα", "Йод ё"):
        assert told(spark, plain(F.col("t")), t=word) == fold(word)


def test_index_edges(spark):
    rows = [(1, "Árvíz tűrő", "old_fn here", "r1", 2015), (2, None, "old fn", "r2", None), (3, "tűr", "", None, 2016), (4, "", "old_fns", "r1", 2016)]
    df = spark.createDataFrame(rows, "id long, title string, body string, repo string, year int")
    folder = f"{work_folder(spark)}/index-test"
    write_index(df, folder, key="id", columns=("title", "body"), facets=("repo", "year"), files=3)
    index = Index(spark, folder)
    docs = lambda text, **o: [r.doc for r in index.page(text, 10, weights=(10.0, 1.0), **o).orderBy("rank").collect()]
    assert docs("old_fn") == [2, 1] and docs("arviz") == [1] and docs("tur*") == [3, 1] and sorted(docs("old_fn*")) == [1, 2, 4] and docs("nothing") == []
    assert docs("old_fn", facets=[("repo", "r1")]) == [1] and docs("tur*", years=(2016, 2020)) == [3] and docs("tur*", years=(2017, 2016)) == []
    assert sorted(docs("", facets=[("repo", "r1")])) == [1, 4]
    assert index.capped_count("old*", 2).first() == (2, True)
    assert compile_query(' "a_b c* ** (x)') == [(["a", "b"], False), (["c"], True), (["x"], False)]
    check_filters({"kind": ["A"]}, {"kind": None})
    with pytest.raises(FilterError):
        check_filters({"kind": ["A"]}, {"kind": "B"})


def test_snippets(spark):
    text = " ".join(f"w{i}" for i in range(40)) + " Target, " + " ".join(f"v{i}" for i in range(40))
    cut = told(spark, best_snippet([F.lit("nothing"), F.col("t")], compile_query("target")), t=text)
    assert cut.startswith("…") and cut.endswith("…") and "\x02Target,\x03" in cut and len(cut.split()) == 16
    assert told(spark, best_snippet([F.col("t")], compile_query("target")), t="a target") == "a \x02target\x03"
    assert told(spark, best_snippet([F.col("t")], compile_query("absent")), t="a target") is None
    shown = catalog.queries()["index_snippets"](spark, DATA).collect()
    assert shown and all(re.search("\x02[^\x03]*(?i:unused|helper)[^\x03]*\x03", r.snippet) for r in shown)


def test_queries_without_sql_give_rows(spark):
    shards = catalog.queries()["export_size_shards"](spark, DATA).collect()
    sizes = {}
    for r in shards:
        sizes[r.repo, r.shard] = sizes.get((r.repo, r.shard), 0) + r.n_bytes
    assert max(sizes.values()) <= 1_000_000 and {s for _, s in sizes} >= {0}
    unit = catalog.queries()["search_embed"](spark, DATA).collect()
    assert all(math.isclose(math.hypot(*r.vector), 1, abs_tol=1e-9) for r in unit if any(r.vector)) and len(unit) == 200
    right = [r.right for r in catalog.queries()["cls_tfidf_lr"](spark, DATA).collect()]
    assert sum(right) > 0.75 * len(right)  # four languages, learned from some thirty rows
    assert all("\x02" in r.snippet for r in catalog.queries()["search_snippet"](spark, DATA).collect())


def test_errors_of_exports(spark):
    df = spark.createDataFrame([("a/b", 1), ("a/b", 2)], "repo string, n int")
    with pytest.raises(Exception, match="is repeated"):
        exporting.unique(df, "repo", "a repository").collect()
    with pytest.raises(Exception, match="no license for"):
        exporting.required(df, spark.createDataFrame([("c/d", "mit")], "repo string, license string"), "repo", ("license",), "license").collect()
    with pytest.raises(Exception, match="no repository"):
        df.select(exporting.shard_name(F.lit("x"), F.lit(1), F.lit(2), "")).collect()
    assert exporting.same_rows(df, df.union(df.limit(1))).first() == (0, 1)
    names = [c for c in df.columns]
    assert df.select(exporting.fingerprint(df)).first() == df.select(*reversed(names)).select(exporting.fingerprint(df.select(*reversed(names)))).first()
    root = f"{work_folder(spark)}/publish-test"
    exporting.publish({"x": df}, root)
    with pytest.raises(Exception, match="broken"):
        exporting.publish({"x": df.limit(1), "y": df.select(F.raise_error(F.lit("broken")).alias("z"))}, root)
    assert exporting.published(spark, root, "x").count() == 2


def test_git_repositories(spark, tmp_path):
    import subprocess

    from codestrata.sources.git import deleted_functions, git_file, walk

    def git(*words):
        subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=me", "-c", "user.email=me@example.com", *words], check=True, capture_output=True)

    def commit(message, **files):
        for name, text in files.items():
            (tmp_path / f"{name}.py").write_text(text)
        git("add", "-A")
        git("commit", "-q", "-m", message)

    git("init", "-q", "-b", "main")
    commit("one", a="def f():\n    return 1\n\n\ndef g(x):\n    y = x\n    z = y\n    return z\n")
    commit("two\x1f and more", a="def g(x):\n    y = x\n    return y\n", b="k = 1\n")
    git("checkout", "-q", "-b", "side")
    commit("three", b="k = 2\n")
    git("checkout", "-q", "main")
    git("merge", "-q", "--no-ff", "-m", "four", "side")
    repositories = spark.createDataFrame([("me/it", str(tmp_path), "main")], "repo string, path string, ref string")
    pairs = walk(repositories).orderBy("position").collect()
    assert len(pairs) == 2 and pairs[0].sha == pairs[1].parent  # neither the root nor the merge
    found = sorted((r.path, r.name, r.deletion_kind, r.deleted_body) for r in deleted_functions(repositories).collect())
    assert found == [("a.py", "f", "FULL_FUNCTION", "def f():\n    return 1"), ("a.py", "g", "PARTIAL", "    z = y\n    return z")]
    assert walk(repositories, since=1 << 40).count() == 0
    read = spark.createDataFrame([("b.py",), ("none.py",)], "n string").select(git_file(F.lit(str(tmp_path)), F.lit("main"), F.col("n")).alias("t")).collect()
    assert [r.t for r in read] == ["k = 2\n", None]
    with pytest.raises(Exception, match="git log failed"):
        walk(repositories.withColumn("ref", F.lit("nowhere"))).collect()
