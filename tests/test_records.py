"""Stored vectors, raw lines, dates, samples and checks of labels on small inputs."""

import collections
import datetime
import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from codestrata.operators import labels as L
from codestrata.operators import records, vectors
from codestrata.operators.partitions import set_partitions, supported_partitions
from codestrata.operators.ranking import weighted_reservoir
from codestrata.plans.records import src_numbered

ROWS = [(1, "a/x", "the cat"), (2, "a/x", None), (3, "b/y", "a dog"), (4, None, "no name"), (5, "b/y", "a dog")]
KIND = "doc_id long, repo string, text string"


def files_of(folder):
    return {os.path.join(at, x): os.stat(os.path.join(at, x)).st_mtime_ns for at, _, names in os.walk(f"{folder}/parts") for x in names if x.endswith(".parquet")}


def made(spark, folder, rows, encoder=vectors.Encoder()):
    df = spark.createDataFrame(rows, KIND)
    told = vectors.write_vectors(df, folder, key="doc_id", repo="repo", text="text", encoder=encoder)
    return {r.repo: (r.n, r.fresh) for r in told.collect()}


def test_only_stale_parts_are_made_anew(spark, tmp_path):
    folder = f"{tmp_path}/v"
    assert made(spark, folder, ROWS) == {"a/x": (2, True), "b/y": (2, True), "": (1, True)}
    before = files_of(folder)
    assert made(spark, folder, ROWS[::-1]) == {"a/x": (2, False), "b/y": (2, False), "": (1, False)}
    assert files_of(folder) == before
    changed = [(1, "a/x", "the cats"), *ROWS[1:]]
    assert made(spark, folder, changed) == {"a/x": (2, True), "b/y": (2, False), "": (1, False)}
    after = files_of(folder)
    assert {x for x in before if x in after and before[x] == after[x]} and set(after) != set(before)
    # A row less of two equal ones, a repository that is gone, another encoder.
    assert made(spark, folder, changed[:4])["b/y"] == (1, True)
    assert made(spark, folder, changed[:2]) == {"a/x": (2, False)} and len(files_of(folder)) == 1
    assert made(spark, folder, changed[:2], vectors.Encoder(width=8)) == {"a/x": (2, True)}
    merged = vectors.merged_vectors(spark, folder).collect()
    assert {(r.repo, r.code, r.key, len(r.vector)) for r in merged} == {("a/x", 0, 1, 8), ("a/x", 0, 2, 8)}


def test_merge_refuses_parts_that_do_not_fit(spark, tmp_path):
    folder = f"{tmp_path}/v"
    made(spark, folder, ROWS)
    assert {(r.repo, r.code) for r in vectors.merged_vectors(spark, folder).collect()} == {("", 0), ("a/x", 1), ("b/y", 2)}
    os.remove(next(x for x in files_of(folder)))
    with pytest.raises(vectors.StaleError):
        vectors.merged_vectors(spark, folder)


def test_vectors_have_unit_length(spark):
    df = spark.createDataFrame([("The cat, the CAT",), ("the cat the cat",), ("",), (None,), ("x " * 300 + "y",), ("x " * 256,)], "t string")
    found = [r.v for r in df.select(vectors.encoded(F.col("t")).alias("v")).collect()]
    assert found[0] == found[1] and found[2] == found[3] == [0.0] * 64 and found[4] == found[5]
    assert sum(x * x for x in found[0]) == pytest.approx(1)


def line(**fields):
    return json.dumps(fields)


def test_status_scan_refuses_look_alikes(spark):
    text = 'x "filter_status": "KEPT" \\"filter_status\\": "KEPT"'
    lines = {
        line(repo="a/b", body=text, filter_status="NOISE_MOVE"): ("a/b", "NOISE_MOVE"),
        line(repo="a/b", filter_status="KEPT"): ("a/b", "KEPT"),
        line(id=1, repo="a/b", filter_status="KEPT"): None,
        '{"repo": "a/b", "filter_status": "KEPT", "more": {"filter_status": "NOISE_OLD"}}': None,
        line(repo='a"b', filter_status="KEPT"): None,
        line(repo="a/b", filter_status="kept"): None,
        "": None,
    }
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    found = {r.value: r.s and tuple(r.s) for r in df.select("value", records.scan_status(F.col("value")).alias("s")).collect()}
    assert found == lines
    kept = records.kept_records(df.filter("value <> ''"), "repo string, filter_status string").collect()
    assert sorted(r.repo for r in kept) == ['a"b', "a/b", "a/b", "a/b"]
    for bad in ("[1]", "7", "{broken"):
        with pytest.raises(Exception, match="no object|Malformed|MALFORMED"):
            records.kept_records(spark.createDataFrame([(bad,)], "value string"), "repo string, filter_status string").collect()


def test_naive_dates_are_errors(spark):
    dates = {"2020-01-02T03:04:05+09:00": None, "2020-01-02T03:04:05Z": None, "2020-01-02T03:04:05-0500": None, "2020-01-02T03:04:05": "naive", "2020-01-02": "naive", "soon": "unreadable", None: "null"}
    df = spark.createDataFrame([(x,) for x in dates], "d string")
    assert {r.d: r.p for r in df.select("d", records.aware_problem(F.col("d")).alias("p")).collect()} == dates
    sound = df.filter(records.aware_problem(F.col("d")).isNull())
    at = {r.d: r.epoch for r in sound.select("d", F.unix_timestamp(records.aware_instant(F.col("d"))).alias("epoch")).collect()}
    assert at["2020-01-02T03:04:05+09:00"] == int(datetime.datetime.fromisoformat("2020-01-02T03:04:05+09:00").timestamp())
    with pytest.raises(PySparkException, match="naive"):
        df.filter("d = '2020-01-02'").select(records.aware_instant(F.col("d"))).collect()


def test_sets_that_overlap_are_an_error(spark):
    one, other = (spark.createDataFrame([(i,) for i in x], "k int") for x in ([1, 2, 3], [3, 4, 2]))
    records.assert_disjoint(one, other.filter("k = 4"), "k")
    with pytest.raises(records.OverlapError, match=r"\[2, 3\]"):
        records.assert_disjoint(one, other, "k")


def test_reservoirs_keep_the_law(spark):
    rows = [("a", i, 9.0 if i < 100 else 1.0) for i in range(1000)] + [("b", 2000 + i, w) for i, w in enumerate([1.0, 0.0, None, -1.0, float("nan"), float("inf"), 2.0])]
    df = spark.createDataFrame(rows, "s string, i long, w double")
    draw = lambda seed, parts, k=200: [(r.s, r.i, r.place) for r in weighted_reservoir(df.repartition(parts), ["s"], "i", F.col("w"), k, seed).orderBy("s", "place").collect()]
    found = draw("x", 1)
    assert found == draw("x", 7) != draw("y", 1)
    assert collections.Counter(s for s, _, _ in found) == {"a": 200, "b": 2} and len({i for _, i, _ in found}) == 202
    assert {i for s, i, _ in found if s == "b"} == {2000, 2006}
    assert draw("x", 3, 50) == [x for x in found if x[2] <= 50]
    # Half of all weight is that of the first hundred: the first draw takes one of them about every other time.
    firsts = [draw(str(seed), 1, 1)[0][1] < 100 for seed in range(24)]
    assert 5 <= sum(firsts) <= 19
    heavy = sum(i < 100 for s, i, _ in found if s == "a")
    assert 60 <= heavy <= 98


def test_rulings_compare_all_fields(spark):
    one = {"rater": "ann", "reason": "BUG", "grade": "EXPLICIT", "evidence_text": "t", "evidence_source": "pr", "evidence_locator": "pr:#1", "confidence": 1.0}
    kind = "struct<rater:string,reason:string,grade:string,evidence_text:string,evidence_source:string,evidence_locator:string,confidence:double>"
    cases = []
    for field in (None, *L.TAKEN_OVER):
        other = {**one, "rater": "bob"}
        if field:
            other[field] = 0.5 if field == "confidence" else "other"
        cases.append(([one, other], one, "ann" if field else None))
    df = spark.createDataFrame([(i, labels, final) for i, (labels, final, _) in enumerate(cases)], f"i int, labels array<{kind}>, final {kind}")
    found = {r.i: r.c for r in df.select("i", L.chosen_rater(F.col("labels"), F.col("final")).alias("c")).collect()}
    assert found == {i: c for i, (_, _, c) in enumerate(cases)}


def test_every_block_needs_a_case(spark):
    df = spark.createDataFrame([("A",), ("C",), ("U",)], "t string")
    found = {r.partition: r.supported for r in supported_partitions(df, "ABCD", (2, 3), "t").collect()}
    assert found == {"|".join("+".join(b) for b in p): all({"A", "C"} & set(b) for b in p) for p in set_partitions("ABCD", (2, 3))}


def test_lines_are_numbered_however_files_are_split(spark, tmp_path):
    from codestrata.sources import files

    for name, n in (("a.jsonl", 500), ("b.jsonl", 1), ("c.jsonl", 0), ("d.jsonl", 77)):
        (tmp_path / name).write_text("".join(f'{{"x": "{name} {i} \u2028"}}\n' + "\n" * (i % 3 == 0) for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        lines = [(os.path.basename(r.file), r.line, r.value) for r in files.numbered_lines(spark, str(tmp_path)).collect()]
        wanted = [(x.name, i, t) for x in tmp_path.iterdir() for i, t in enumerate(x.read_text().split("\n")[:-1], 1)]
        assert sorted(lines) == sorted(wanted)
        assert files.numbered_objects(spark, str(tmp_path), "x string").count() == 578
        (tmp_path / "e.jsonl").write_text('{"x": 1}\n\n[1]\n')
        with pytest.raises(Exception, match="e.jsonl:3 is no object"):
            files.numbered_objects(spark, str(tmp_path), "x string").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_numbered_records_lie_by_number_whatever_the_tables_order(spark, tmp_path):
    """The writer must not sort anew: rows come from several files, the greatest numbers first."""
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"), F.when(F.col("id") % 3 > 0, F.concat(F.lit("s"), (F.col("id") % 3).cast("string"))).alias("source"))
    docs.repartitionByRange(6, F.desc("doc_id")).sortWithinPartitions(F.desc("doc_id")).write.parquet(f"{tmp_path}/documents.parquet")
    found = src_numbered(spark, str(tmp_path)).collect()
    assert len(found) == 600
    assert all(r.line == 2 * (r.doc_id // 3) + 1 and r.repo == (f"s{r.doc_id % 3}" if r.doc_id % 3 else "") for r in found)
