"""Label files: agreement of raters, settled labels, constraints, recovery of reasons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codestrata.operators import labels as L
from codestrata.plans.registry import query
from codestrata.sources.adapters import REASONS, table
from codestrata.sources.domain import COMMITS_SQL, RATINGS_SQL, ratings

#: A third rater settles every fourth record by taking over a label, one in five is settled by talk, and some rulings are wrong.
_FINAL = """finals AS (SELECT a.record_id, CASE WHEN a.record_id % 4 = 0 THEN 'THIRD_PARTY' WHEN a.record_id % 5 = 0 THEN 'DISCUSSED' END AS method, CASE WHEN a.record_id % 4 = 0 THEN CASE WHEN a.record_id % 8 = 0 THEN a.reason ELSE b.reason END WHEN a.record_id % 5 = 0 THEN 'FEAT' END AS reason,
  CASE WHEN a.record_id % 4 = 0 THEN CASE WHEN a.record_id % 8 = 0 OR a.record_id % 12 = 0 THEN a.grade ELSE b.grade END WHEN a.record_id % 5 = 0 THEN 'EXPLICIT' END AS grade, CASE WHEN a.record_id % 4 = 0 THEN CASE WHEN a.record_id % 8 = 0 THEN a.confidence ELSE b.confidence END WHEN a.record_id % 5 = 0 THEN 0.9::DOUBLE END AS confidence
  FROM ratings a JOIN ratings b ON a.record_id = b.record_id AND a.rater = 'ann' AND b.rater = 'bob')"""
_PAIRED = """paired AS (SELECT a.record_id, a.reason AS ra, b.reason AS rb, a.grade AS ga, b.grade AS gb, a.confidence AS ca, b.confidence AS cb, a.note AS na, b.note AS nb, a.anchored OR b.anchored AS anchored, f.method, f.reason AS rf, f.grade AS gf, f.confidence AS cf
  FROM ratings a JOIN ratings b ON a.record_id = b.record_id AND a.rater = 'ann' AND b.rater = 'bob' JOIN finals f ON a.record_id = f.record_id)"""
_VIEWS = (RATINGS_SQL, _FINAL, _PAIRED)


def _merged(spark, d):
    """Records with their labels and the final one of people, as _FINAL has it."""
    own = L.gathered(ratings(spark, d))
    a, b, i = F.get("labels", F.lit(0)), F.get("labels", F.lit(1)), F.col("record_id")
    third, talk = i % 4 == 0, i % 5 == 0
    pick = lambda f, test: F.when(third, F.when(test, a[f]).otherwise(b[f]))
    final = F.struct(
        F.when(third, "THIRD_PARTY").when(talk, "DISCUSSED").alias("method"), pick("reason", i % 8 == 0).when(talk, "FEAT").alias("reason"), pick("grade", (i % 8 == 0) | (i % 12 == 0)).when(talk, "EXPLICIT").alias("grade"),
        pick("confidence", i % 8 == 0).when(talk, F.lit(0.9)).alias("confidence"),
    )
    return own.withColumn("final", final)


_SAME = "ra = rb AND ga = gb"


@query(f"SELECT record_id, ra AS reason, ga AS grade, ca AS confidence, 'ann before bob' AS note FROM paired WHERE {_SAME}", _VIEWS)
def lbl_final(spark, d):
    """Labels that settle themselves: both raters give one reason and one grade, and the first one's evidence is kept."""
    found = _merged(spark, d).select("record_id", L.agreed_label(F.col("labels")).alias("f"))
    return found.filter("f IS NOT NULL").select("record_id", "f.reason", "f.grade", "f.confidence", "f.note")


@query("SELECT record_id, CASE WHEN ra <> rb AND ga <> gb THEN 'both' WHEN ra <> rb THEN 'reason' ELSE 'grade' END AS differs FROM paired WHERE ra <> rb OR ga <> gb", _VIEWS)
def lbl_disagreements(spark, d):
    reason, grade = L.all_same(F.col("labels"), "reason"), L.all_same(F.col("labels"), "grade")
    return _merged(spark, d).filter(~(reason & grade)).select("record_id", F.when(~reason & ~grade, "both").when(~reason, "reason").otherwise("grade").alias("differs"))


#: What labels have in this view.
_RULED = ("reason", "grade", "confidence")
_MEETS = "r{0} IS NOT DISTINCT FROM rf AND g{0} IS NOT DISTINCT FROM gf AND c{0} IS NOT DISTINCT FROM cf"
_CHOSEN = f"CASE WHEN ({_MEETS.format('a')}) AND NOT ({_MEETS.format('b')}) THEN 'ann' WHEN ({_MEETS.format('b')}) AND NOT ({_MEETS.format('a')}) THEN 'bob' END"


@query(f"SELECT record_id, {_CHOSEN} AS chosen, {_CHOSEN} IS NOT NULL AS valid FROM paired WHERE method = 'THIRD_PARTY'", _VIEWS)
def lbl_rulings(spark, d):
    """Whose label a third rater took over; a ruling that mixes two labels, or is both's, is not valid."""
    own = _merged(spark, d).filter("final.method = 'THIRD_PARTY'").withColumn("chosen", L.chosen_rater(F.col("labels"), F.col("final"), _RULED))
    return own.select("record_id", "chosen", F.col("chosen").isNotNull().alias("valid"))


@query("SELECT problem, count(*) AS n FROM (SELECT CASE WHEN method IS NULL AND (ra <> rb OR ga <> gb) THEN 'open' WHEN method = 'THIRD_PARTY' AND " + _CHOSEN + " IS NULL THEN 'no rater' WHEN method = 'DISCUSSED' AND ra = rb AND ga = gb THEN 'was agreed' END AS problem FROM paired) WHERE problem IS NOT NULL GROUP BY 1", _VIEWS)
def lbl_adjudication_problems(spark, d):
    same = L.all_same(F.col("labels"), "reason") & L.all_same(F.col("labels"), "grade")
    how = F.col("final.method")
    problem = F.when(how.isNull() & ~same, "open").when((how == "THIRD_PARTY") & L.chosen_rater(F.col("labels"), F.col("final"), _RULED).isNull(), "no rater").when((how == "DISCUSSED") & same, "was agreed")
    return _merged(spark, d).select(problem.alias("problem")).filter("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n"))


_TAG = lambda note, tag: f"regexp_matches(coalesce({note}, ''), '(?:^|[^A-Za-z0-9_-]){tag}(?:[^A-Za-z0-9_-]|$)')"
_ANY = lambda note: " OR ".join(_TAG(note, t) for t in (*L.CAUSES, L.FILTER_MISS))
_REASONS = ", ".join(f"'{r}'" for r in REASONS)


@query(
    f"""SELECT record_id, rater, unnest(list_filter([CASE WHEN reason NOT IN ({_REASONS}) THEN 'reason' END, CASE WHEN grade NOT IN ('EXPLICIT', 'INFERRED', 'UNKNOWN') THEN 'grade' END, CASE WHEN reason IN ({_REASONS}) AND (reason = 'UNK') <> (grade = 'UNKNOWN') THEN 'unknown' END,
    CASE WHEN grade = 'INFERRED' AND (confidence IS NULL OR NOT confidence BETWEEN 0 AND 1) THEN 'confidence' END, CASE WHEN grade = 'UNKNOWN' AND NOT ({_ANY('note')}) THEN 'cause' END], lambda x: x IS NOT NULL)) AS problem FROM ratings""",
    (RATINGS_SQL,),
)
def lbl_label_problems(spark, d):
    """Constraints of single labels: known values, unknown reason and grade together, confidences, causes of unknown ones."""
    found = L.label_problems(F.col("reason"), F.col("grade"), F.col("confidence"), F.col("note"))
    return ratings(spark, d).select("record_id", "rater", F.explode(found).alias("problem"))


@query(
    """, rows AS (SELECT record_id, rater FROM ratings UNION ALL SELECT record_id, rater FROM ratings WHERE record_id % 10 = 0 UNION ALL SELECT record_id + 1000000, 'eve' FROM ratings WHERE record_id % 50 = 0 AND rater = 'ann')
    SELECT record_id, rater, CASE WHEN rater NOT IN ('ann', 'bob') THEN 'rater' WHEN record_id NOT IN (SELECT doc_id FROM labels) THEN 'record' ELSE 'twice' END AS problem FROM rows GROUP BY ALL HAVING count(*) > 1 OR rater NOT IN ('ann', 'bob') OR record_id NOT IN (SELECT doc_id FROM labels)""",
    (RATINGS_SQL,),
)
def lbl_file_problems(spark, d):
    """Rows of unknown raters or records, and those given twice."""
    own = ratings(spark, d).select("record_id", "rater")
    rows = own.union(own.filter("record_id % 10 = 0")).union(own.filter("record_id % 50 = 0 AND rater = 'ann'").select(F.col("record_id") + 1_000_000, F.lit("eve")))
    known = table(spark, d, "labels").select(F.col("doc_id").alias("record_id"), F.lit(True).alias("known")).distinct()
    counted = rows.groupBy("record_id", "rater").agg(F.count("*").alias("n")).join(known, "record_id", "left")
    problem = F.when(~F.col("rater").isin("ann", "bob"), "rater").when(F.col("known").isNull(), "record").when(F.col("n") > 1, "twice")
    return counted.select("record_id", "rater", problem.alias("problem")).filter("problem IS NOT NULL")


_RESOLVED = """settled AS (SELECT record_id, CASE WHEN method IS NOT NULL THEN rf WHEN ra = rb THEN ra END AS reason, CASE WHEN method IS NOT NULL THEN gf WHEN ga = gb THEN ga END AS grade, CASE WHEN method IS NOT NULL THEN cf WHEN ga = gb AND ca IS NOT NULL AND cb IS NOT NULL THEN least(ca, cb) END AS confidence FROM paired)"""


def _settled(spark, d):
    return _merged(spark, d).withColumn("r", L.resolved(F.col("labels"), F.col("final"))).select("record_id", "r.reason", "r.grade", "r.confidence")


@query("SELECT * FROM settled", (*_VIEWS, _RESOLVED))
def lbl_resolved(spark, d):
    """Reason, grade and confidence as settled by people, or where raters agree."""
    return _settled(spark, d)


_VERDICT = "CASE WHEN {1} <= 0 THEN 'UNDECIDABLE' WHEN {0} * 5 >= {1} * 3 THEN 'PROCEED' WHEN {0} * 5 >= {1} * 2 THEN 'TIGHTEN' ELSE 'PIVOT' END"
_TIERS = "count(*) FILTER (grade IS NOT NULL) AS resolved, count(*) FILTER (grade IS NULL) AS unresolved, count(*) FILTER (grade = 'EXPLICIT') AS explicit_only, count(*) FILTER (grade = 'EXPLICIT' OR grade = 'INFERRED' AND confidence >= 0.5) AS inferred_min, count(*) FILTER (grade = 'EXPLICIT' OR grade = 'INFERRED' AND confidence >= 0.8) AS inferred_strong"
_DECISION = "[" + ", ".join(_VERDICT.format(t, "resolved") for t in L.TIERS) + "] AS verdicts"
_DECIDED = "CASE WHEN list_contains(verdicts, 'UNDECIDABLE') THEN 'UNDECIDABLE' WHEN len(list_distinct(verdicts)) = 1 THEN verdicts[1] ELSE 'SPLIT' END AS decision"


@query(f", t AS (SELECT 'all' AS name, {_TIERS} FROM settled), v AS (SELECT *, {_DECISION} FROM t) SELECT *, {_DECIDED} FROM v", (*_VIEWS, _RESOLVED))
def lbl_recovery(spark, d):
    """Recovered reasons by three tiers with the gate's verdict on each."""
    return L.recovery(_settled(spark, d).withColumn("name", F.lit("all")), ["name"])


@query(f", t AS (SELECT d.source AS repo, {_TIERS} FROM settled s JOIN documents d ON s.record_id = d.doc_id GROUP BY 1), v AS (SELECT *, {_DECISION} FROM t) SELECT *, {_DECIDED} FROM v", (*_VIEWS, _RESOLVED))
def lbl_recovery_by_repo(spark, d):
    repos = table(spark, d, "documents").select(F.col("doc_id").alias("record_id"), F.col("source").alias("repo"))
    return L.recovery(_settled(spark, d).join(repos, "record_id"), ["repo"])


_RANKS = "{'UNKNOWN': 1, 'INFERRED': 2, 'EXPLICIT': 3}"
_RANK = lambda g: f"CASE {g} WHEN 'UNKNOWN' THEN 1 WHEN 'INFERRED' THEN 2 WHEN 'EXPLICIT' THEN 3 END"
_BOUNDS = f"""bounds AS (SELECT record_id, CASE WHEN {_RANK('ga')} <= {_RANK('gb')} THEN ga ELSE gb END AS low, CASE WHEN ca IS NOT NULL AND cb IS NOT NULL THEN least(ca, cb) END AS low_confidence, CASE WHEN {_RANK('ga')} >= {_RANK('gb')} THEN ga ELSE gb END AS high,
  CASE WHEN ga = gb THEN greatest(ca, cb) WHEN {_RANK('ga')} > {_RANK('gb')} THEN ca ELSE cb END AS high_confidence FROM paired)"""


@query(", x AS (SELECT *, CASE WHEN low = high THEN low[1:1] || '-' || low[1:1] || ' confidence' ELSE high[1:1] || '-' || low[1:1] END AS kind FROM bounds) SELECT * FROM x", (*_VIEWS, _BOUNDS))
def lbl_bounds(spark, d):
    """The weakest and the strongest reading of each record, and how its labels differ."""
    return _merged(spark, d).withColumn("b", L.bounds(F.col("labels"))).filter("b IS NOT NULL").select("record_id", "b.*")


_COUNTS = lambda side, least: f"count(*) FILTER ({side} = 'EXPLICIT' OR {side} = 'INFERRED' AND {side}_confidence >= {least})" if least else f"count(*) FILTER ({side} = 'EXPLICIT')"


@query(", t AS (SELECT count(*) AS resolved, " + ", ".join(f"{_COUNTS(s, v)} AS {s}_{k}" for k, v in L.TIERS.items() for s in ("low", "high")) + " FROM bounds) " + " UNION ALL ".join(f"SELECT '{k}' AS tier, low_{k} AS low, high_{k} AS high, {_VERDICT.format('low_' + k, 'resolved')} = {_VERDICT.format('high_' + k, 'resolved')} AS same_verdict FROM t" for k in L.TIERS), (*_VIEWS, _BOUNDS))
def lbl_recovery_bounds(spark, d):
    """Recovery by tier if the weaker, and if the stronger label counts."""
    own = _merged(spark, d).withColumn("b", L.bounds(F.col("labels"))).filter("b IS NOT NULL").select("b.*")
    count = lambda s, least: F.count_if(L.recovered(F.col(s), F.col(f"{s}_confidence"), least))
    one = own.agg(F.count("*").alias("n"), *[count(s, least).alias(f"{s}_{k}") for k, least in L.TIERS.items() for s in ("low", "high")])
    rows = F.array(*[F.struct(F.lit(k).alias("tier"), F.col(f"low_{k}").alias("low"), F.col(f"high_{k}").alias("high"), (L.verdict(F.col(f"low_{k}"), F.col("n")) == L.verdict(F.col(f"high_{k}"), F.col("n"))).alias("same_verdict")) for k in L.TIERS])
    return one.select(F.explode(rows).alias("r")).select("r.*")


@query(f"SELECT record_id, CASE WHEN method = 'THIRD_PARTY' THEN CASE {_CHOSEN} WHEN 'ann' THEN {_TAG('na', 'filter-miss')} WHEN 'bob' THEN {_TAG('nb', 'filter-miss')} ELSE false END ELSE {_TAG('na', 'filter-miss')} AND {_TAG('nb', 'filter-miss')} END AS gone FROM paired WHERE method IS NOT NULL", _VIEWS)
def lbl_not_meaningful(spark, d):
    """Records that people settled to be none: the tag counts as a whole word only."""
    own = _merged(spark, d).filter("final.method IS NOT NULL")
    return own.select("record_id", F.coalesce(L.not_meaningful(F.col("labels"), F.col("final"), _RULED), F.lit(False)).alias("gone"))


@query(
    f""", x AS (SELECT unnest(CASE WHEN {' OR '.join(_TAG('note', t) for t in L.CAUSES)} THEN list_filter([{', '.join(f"CASE WHEN {_TAG('note', t)} THEN '{t}' END" for t in L.CAUSES)}], lambda t: t IS NOT NULL) WHEN {_TAG('note', L.FILTER_MISS)} THEN ['filter-miss'] ELSE ['none'] END) AS tag FROM ratings WHERE grade = 'UNKNOWN')
    SELECT tag, count(*) AS n FROM x GROUP BY 1""",
    (RATINGS_SQL,),
)
def lbl_unknown_causes(spark, d):
    return ratings(spark, d).filter("grade = 'UNKNOWN'").select(F.explode(L.unknown_causes(F.col("note"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query(", old AS (SELECT record_id, reason, 0 AS turn FROM ratings WHERE rater = 'ann'), new AS (SELECT record_id, reason, 1 AS turn FROM ratings WHERE rater = 'bob' AND record_id % 3 = 0) SELECT record_id, reason, turn FROM old WHERE record_id NOT IN (SELECT record_id FROM new) UNION ALL SELECT * FROM new", (RATINGS_SQL,))
def lbl_upsert(spark, d):
    """New rulings replace old ones of their records."""
    own = ratings(spark, d)
    old, new = own.filter("rater = 'ann'").select("record_id", "reason", F.lit(0).alias("turn")), own.filter("rater = 'bob' AND record_id % 3 = 0").select("record_id", "reason", F.lit(1).alias("turn"))
    return old.join(new, "record_id", "left_anti").union(new)


_KAPPA = "CASE WHEN abs(1 - expected) > 1e-12 THEN (observed - expected) / (1 - expected) END"
_PAIRS = lambda a, b: f"p AS (SELECT {a} AS a, {b} AS b FROM paired WHERE NOT anchored), t AS (SELECT count(*) AS total, count(*) FILTER (a = b) AS agreed FROM p), c AS (SELECT sum(x.n * y.n) AS products FROM (SELECT a, count(*) AS n FROM p GROUP BY 1) x JOIN (SELECT b, count(*) AS n FROM p GROUP BY 1) y ON x.a = y.b), k AS (SELECT total, agreed, agreed / total AS observed, products / (total * total) AS expected FROM t, c)"
_WILSON = "greatest(0, (agreed / total + {z2} / (2 * total) - {z} * sqrt(agreed / total * (1 - agreed / total) / total + {z2} / (4.0 * total * total))) / (1 + {z2} / total)) AS low, least(1, (agreed / total + {z2} / (2 * total) + {z} * sqrt(agreed / total * (1 - agreed / total) / total + {z2} / (4.0 * total * total))) / (1 + {z2} / total)) AS high".format(z=1.959964, z2=1.959964**2)


@query(f", {_PAIRS('ra', 'rb')} SELECT 'ann' AS first, 'bob' AS second, total, agreed, observed, expected, {_KAPPA} AS kappa, {_WILSON} FROM k", _VIEWS)
def agg_pair_kappa(spark, d):
    """Agreement of each pair of raters on reasons; labels of raters who were led don't count."""
    return L.agreement(L.pairs_of(_merged(spark, d), "reason"))


@query(f", {_PAIRS('ra', 'rb')} SELECT unnest([{_REASONS}]) AS class, unnest([" + ", ".join(f"(SELECT count(*) FILTER (a = b) FROM p WHERE a = '{r}' OR b = '{r}')" for r in REASONS) + "]) AS agreed, unnest([" + ", ".join(f"(SELECT count(*) FROM p WHERE a = '{r}' OR b = '{r}')" for r in REASONS) + "]) AS appeared", _VIEWS)
def agg_class_agreement(spark, d):
    """For each class, pairs in which it appears and those that agree on it; zero where it doesn't."""
    pairs = L.pairs_of(_merged(spark, d), "reason").groupBy("a", "b").agg(F.count("*").alias("n"))
    seen = pairs.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("class"), "n", (F.col("a") == F.col("b")).alias("same"))
    counts = seen.groupBy("class").agg(F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("agreed"), F.sum("n").alias("appeared"))
    every = spark.createDataFrame([(r,) for r in REASONS], "class string")
    return every.join(counts, "class", "left").select("class", F.coalesce("agreed", F.lit(0)).alias("agreed"), F.coalesce("appeared", F.lit(0)).alias("appeared"))


@query(f", {_PAIRS('ra', 'rb')}, q AS (SELECT least(a, b) AS one, greatest(a, b) AS other, count(*) AS n FROM p WHERE a <> b GROUP BY ALL) SELECT one, other, n FROM q ORDER BY n DESC, one, other LIMIT 3", _VIEWS)
def agg_confusions(spark, d):
    """The three pairs of reasons that raters mix up most, whoever gave which."""
    pairs = L.pairs_of(_merged(spark, d), "reason").filter("a <> b").select(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other"))
    return pairs.groupBy("one", "other").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "one", "other").limit(3)


@query(
    f", {_PAIRS('ra', 'rb')}, {_PAIRS('ga', 'gb').replace('p AS', 'p2 AS').replace('FROM p)', 'FROM p2)').replace('FROM p GROUP', 'FROM p2 GROUP').replace(' t AS', ' t2 AS').replace(' c AS', ' c2 AS').replace(' k AS', ' k2 AS').replace('FROM t, c)', 'FROM t2, c2)')},"
    f" z AS (SELECT 'reason' AS field, {_KAPPA} AS kappa FROM k UNION ALL SELECT 'grade', {_KAPPA} FROM k2) SELECT field, kappa, kappa < 0.6 - 1e-9 AS warned, (SELECT avg(kappa) FROM z) AS mean FROM z",
    _VIEWS,
)
def agg_kappa_warnings(spark, d):
    """Kappas by field with their mean (undefined ones left out), and which are a risk."""
    merged = _merged(spark, d)
    every = [L.agreement(L.pairs_of(merged, f)).select(F.lit(f).alias("field"), "kappa") for f in ("reason", "grade")]
    both = every[0].union(every[1])
    return both.select("field", "kappa", (F.col("kappa") < L.KAPPA_RISK - L.TOLERANCE).alias("warned"), F.avg("kappa").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("mean"))


@query(f", {_PAIRS('ra', 'rb').replace('NOT anchored', 'NOT anchored AND record_id % 3 = 2')} SELECT total, observed AS h, least(0.8, observed) AS threshold FROM k", _VIEWS)
def agg_human_agreement(spark, d):
    """Agreement of people on the test split, and the accuracy that may be asked for."""
    found = L.agreement(L.pairs_of(_merged(spark, d).filter("record_id % 3 = 2"), "reason"))
    return found.select("total", F.col("observed").alias("h"), F.least(F.lit(L.ACCURACY), F.col("observed")).alias("threshold"))


@query(f"SELECT coalesce({_CHOSEN}, 'none') AS chosen, count(*) AS n FROM paired WHERE method = 'THIRD_PARTY' GROUP BY 1", _VIEWS)
def agg_third_party(spark, d):
    own = _merged(spark, d).filter("final.method = 'THIRD_PARTY'")
    return own.groupBy(F.coalesce(L.chosen_rater(F.col("labels"), F.col("final"), _RULED), F.lit("none")).alias("chosen")).agg(F.count("*").alias("n"))


@query(f"SELECT ra AS reason, count(*) AS n FROM paired WHERE {_SAME} GROUP BY 1", _VIEWS)
def agg_reasons_of_merged(spark, d):
    found = _merged(spark, d).select(L.agreed_label(F.col("labels")).alias("f")).filter("f IS NOT NULL")
    return found.groupBy(F.col("f.reason").alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT record_id, CASE WHEN ra = rb OR ra = rf THEN ra WHEN rb = rf THEN rb ELSE 'UNK' END AS label FROM paired WHERE rf IS NOT NULL", _VIEWS)
def agg_vote(spark, d):
    """The reason that more than half of three votes have."""
    own = _merged(spark, d).filter("final.reason IS NOT NULL")
    return own.select("record_id", L.majority(F.concat(F.transform("labels", lambda x: x["reason"]), F.array("final.reason"))).alias("label"))


@query(
    ", x AS (SELECT count(*) FILTER (grade = 'EXPLICIT') AS x1, count(*) FILTER (grade IS NOT NULL) AS n1, count(*) FILTER (reason = 'BUG') AS x2, count(*) FILTER (reason IS NOT NULL) AS n2 FROM settled) SELECT x1 / n1 AS p, x2 / n2 AS a, (x1 / n1) * (x2 / n2) * exp(-1.959964 * sqrt((1 - x1 / n1) / (n1 * (x1 / n1)) + (1 - x2 / n2) / (n2 * (x2 / n2)))) AS low,"
    " (x1 / n1) * (x2 / n2) * exp(1.959964 * sqrt((1 - x1 / n1) / (n1 * (x1 / n1)) + (1 - x2 / n2) / (n2 * (x2 / n2)))) AS high, greatest(0, x1 / n1 + x2 / n2 - 1) AS least_joint, least(x1 / n1, x2 / n2) AS most_joint FROM x",
    (*_VIEWS, _RESOLVED),
)
def agg_product_chain(spark, d):
    """Two shares, the interval of their product, and the bounds of their joint share if they depend on each other."""
    one = _settled(spark, d).agg(F.count_if(F.col("grade") == "EXPLICIT").alias("x1"), F.count("grade").alias("n1"), F.count_if(F.col("reason") == "BUG").alias("x2"), F.count("reason").alias("n2"))
    p, a = F.col("x1") / F.col("n1"), F.col("x2") / F.col("n2")
    told = one.select(p.alias("p"), a.alias("a"), L.product_interval(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2")).alias("i"), F.greatest(F.lit(0.0), p + a - 1).alias("least_joint"), F.least(p, a).alias("most_joint"))
    return told.select("p", "a", "i.low", "i.high", "least_joint", "most_joint")


@query(", g AS (SELECT reason, grade, count(*) AS n FROM settled WHERE reason IS NOT NULL AND grade IS NOT NULL GROUP BY ALL) SELECT r.reason, q.grade, coalesce(n, 0) AS n FROM (SELECT unnest([" + _REASONS + "]) AS reason) r CROSS JOIN (SELECT unnest(['EXPLICIT', 'INFERRED', 'UNKNOWN']) AS grade) q LEFT JOIN g ON r.reason = g.reason AND q.grade = g.grade", (*_VIEWS, _RESOLVED))
def agg_gate_crosstab(spark, d):
    """Reasons by grades of settled records, with zeros."""
    counts = _settled(spark, d).filter("reason IS NOT NULL AND grade IS NOT NULL").groupBy("reason", "grade").agg(F.count("*").alias("n"))
    grid = spark.createDataFrame([(r, g) for r in REASONS for g in ("EXPLICIT", "INFERRED", "UNKNOWN")], "reason string, grade string")
    return grid.join(counts, ["reason", "grade"], "left").select("reason", "grade", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    ", m AS (SELECT *, CASE WHEN ra IN ('SEC', 'BUG') THEN 'SEC+BUG' ELSE ra END AS ma, CASE WHEN rb IN ('SEC', 'BUG') THEN 'SEC+BUG' ELSE rb END AS mb FROM paired WHERE ra <> 'ODD') SELECT ma AS block, count(*) AS n, count(*) FILTER (ma = mb) AS hits, count(*) FILTER (ma = mb OR rb = 'UNK') AS lenient FROM m GROUP BY 1",
    _VIEWS,
)
def lbl_grouped(spark, d):
    """Labels by the blocks of a coarser grouping; every label needs a block."""
    blocks = {r: "SEC+BUG" if r in ("SEC", "BUG") else r for r in REASONS}
    listed = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])
    at = lambda c: F.coalesce(F.try_element_at(listed, c), F.raise_error(F.concat(F.lit("no block for "), c)))
    pairs = _merged(spark, d).select(F.get("labels", F.lit(0))["reason"].alias("a"), F.get("labels", F.lit(1))["reason"].alias("b")).filter("a <> 'ODD'")
    told = pairs.select(at(F.col("a")).alias("block"), at(F.col("b")).alias("other"), "b")
    return told.groupBy("block").agg(F.count("*").alias("n"), F.count_if(F.col("block") == F.col("other")).alias("hits"), F.count_if((F.col("block") == F.col("other")) | (F.col("b") == "UNK")).alias("lenient"))


@query("SELECT j.item_id, 'judge file holds ' || string_agg(c, ',' ORDER BY c) AS problem FROM (SELECT item_id, unnest(['filter_status', 'filter_evidence']) AS c FROM benchmark WHERE item_id % 5 = 0) j GROUP BY 1")
def lbl_leaks(spark, d):
    """Rows of a judge's file that show what they must hide."""
    hidden = F.array(F.lit("filter_evidence"), F.lit("filter_status"))
    given = table(spark, d, "benchmark").select("item_id", F.when(F.col("item_id") % 5 == 0, F.array(F.lit("filter_status"), F.lit("text"), F.lit("filter_evidence"))).otherwise(F.array(F.lit("text"))).alias("keys"))
    seen = F.array_sort(F.array_intersect("keys", hidden))
    return given.filter(F.size(seen) > 0).select("item_id", F.concat(F.lit("judge file holds "), F.array_join(seen, ",")).alias("problem"))
