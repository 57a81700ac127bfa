"""Rules over single records: noise by format and place, hunks, reasons in sentences, evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from codestrata.functions.refs import BEGUN, CLOSING
from codestrata.functions.text import bind, raw_lines, reappearing, sentences

#: Words of a subject that say a commit formats, and the share of lines that must reappear.
FORMAT_WORDS = r"(?iU)\b(black|ruff|yapf|isort|reformat\w*|formatting|style|lint\w*|re-?wrap|pep ?8|flake8)\b"
REAPPEARING = 0.9
#: Directories whose code isn't a project's own, in the order in which they count.
SITE_PACKAGES = ("site-packages", "dist-packages")
VENV_LAYOUT = ("bin", "scripts", "lib", "lib64", "include")
VENV_LIB = ("lib", "lib64")
VENDOR = ("vendor", "vendored", "_vendor", "_vendored")
#: Lines that a hunk may be away from the place of a deletion.
SITE_TOLERANCE = 2

#: What a message says of the reason of a deletion; the first label with a match wins.
REASON_RULES = {
    "SEC": (r"\bcve\b", r"\bcve-\d", r"\bsecurit", r"\bvulnerab", r"\binjection\b", r"\bxss\b", r"\bcsrf\b", r"\bsaniti[sz]", r"\bexploit", r"\bmalicious\b"),
    "LIB": (r"\buse\b[^\n]{0,60}\binstead\b", r"\bswitch(?:ed|ing)?\s+to\b", r"\bmigrat\w*\s+to\b", r"\breplace\w*\s+(?:\w+\s+)?with\b", r"\bstd(?:lib|.library)\b", r"\bbuilt-?in\b", r"\bin\s+favou?r\s+of\b", r"\bvendor\w*\b"),
    "DEAD": (r"\bunused\b", r"\bdead\s+code\b", r"\bno\s+longer\s+used\b", r"\bnot\s+used\b", r"\bnever\s+used\b", r"\bunreachable\b", r"\bobsolete\b", r"\bleftover\b"),
    "FEAT": (r"\bdeprecat", r"\b(?:remove|drop|end)\w*\s+support\b", r"\bno\s+longer\s+support", r"\bunsupported\b", r"\bsunset\b", r"\bretire[sd]?\b"),
    "BUG": (r"\bfix(?:e[sd])?\b", r"\bbug(?:fix)?\b", r"\bcrash", r"\bregression\b", r"\bbroken\b", r"\bincorrect\w*\b", r"\bwrong\b", r"\btraceback\b", r"\bexception\b"),
    "PERF": (r"\bperf(?:ormance)?\b", r"\bslow(?:er|ness)?\b", r"\bspeed\s*-?\s*up\b", r"\bfaster\b", r"\boptimi[sz]", r"\bbenchmark", r"\blatency\b", r"\bmemory\s+leak\b", r"\boverhead\b"),
    "DESIGN": (r"\brefactor", r"\brestructur", r"\breorgani[sz]", r"\bsimplif", r"\bclean(?:\s*-?\s*up|up)?\b", r"\bconsolidat", r"\brework\w*\b", r"\bextract\w*\s+(?:in)?to\b", r"\btidy\b"),
}
#: Names shorter than this, and those of every class, point at no function.
LEAST_NAME = 4
CLOSING_REFERENCE = rf"{BEGUN}(?iU)\b{CLOSING}\s*:?\s*(?:#\d+|GH-\d+|[\w.-]+/[\w.-]+#\d+|https?://github\.com/\S+)"
INLINE_CODE = r"`[^`\n]*`"
#: Code points of added code that a model sees.
ADDED_SHOWN = 5000


def begun(patterns: tuple[str, ...]) -> str:
    """A test of the first letter, to go before patterns that all begin with a word: most places in a text fail it at once."""
    firsts = set()
    for p in patterns:
        found = re.match(r"\\b(?:\(\?:([a-z|]+)\)|([a-z]))", p)
        firsts |= {w[0] for w in (found[1] or found[2]).split("|")}
    also = {"\u017f" for x in firsts if x == "s"} | {"\u212a" for x in firsts if x == "k"}  # these fold to s and k
    return "(?=[" + "".join(sorted(firsts | {x.upper() for x in firsts} | also)) + "])"


def format_words(subject: Column) -> Column:
    """Words of a message's first line that say it formats, small letters, each once, in order."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(subject, F.lit("")), F.lit(FORMAT_WORDS), F.lit(1)), F.lower))


def format_evidence(subject: Column, deleted: Column, added: Column) -> Column:
    """(keywords, reappear_ratio, reappeared_lines, deleted_lines) of a commit that only formats; null for any other."""
    own, met = F.size(raw_lines(deleted)), reappearing(deleted, added)
    told = F.struct(format_words(subject).alias("keywords"), F.round(met / own, 4).alias("reappear_ratio"), met.alias("reappeared_lines"), own.alias("deleted_lines"))
    return F.when((F.size(format_words(subject)) > 0) & (own > 0) & (met >= REAPPEARING * own), told)


def generated_path(path: Column) -> Column:
    """(path_category, matched_segment, matched_prefix) of a path that isn't a project's own code; null for any other.

    Directories are compared in small letters.  Categories count in order, and in each the first directory.
    """
    parts = F.filter(F.split(F.coalesce(path, F.lit("")), "/"), lambda x: x != "")

    def of(every: Column) -> Column:
        dirs = F.slice(every, 1, F.greatest(F.size(every) - 1, F.lit(0)))
        small = F.transform(dirs, F.lower)
        at = lambda i: F.coalesce(F.get(small, i), F.lit(""))
        found = lambda test: F.get(F.filter(F.transform(small, lambda x, i: F.when(test(x, i), i).otherwise(-1)), lambda i: i >= 0), F.lit(0))
        python = lambda i: at(i).isin(*VENV_LIB) & at(i + 1).rlike(r"^python\d+\.\d+$")
        site = found(lambda x, i: x.isin(*SITE_PACKAGES))
        venv = found(lambda x, i: (x == ".venv") | (x == "venv") & at(i + 1).isin(*VENV_LAYOUT) | python(i))
        vendor = found(lambda x, i: x.isin(*VENDOR))
        name = F.element_at(every, -1)
        told = lambda category, start, end: F.struct(F.lit(category).alias("path_category"), F.array_join(F.slice(every, start + 1, end - start + 1), "/").alias("matched_segment"), F.array_join(F.slice(every, 1, end + 1), "/").alias("matched_prefix"))
        last = F.when((at(venv) != ".venv") & ~((at(venv) == "venv") & at(venv + 1).isin(*VENV_LAYOUT)), venv + 1).otherwise(venv)
        return F.when(site.isNotNull(), told("site-packages", site, site)).when(venv.isNotNull(), told("venv", venv, last)).when(vendor.isNotNull(), told("vendor", vendor, vendor)).when(name.rlike(r"^.+_pb2(_grpc)?\.py$"), told("protobuf", F.size(every) - 1, F.size(every) - 1))

    return bind(parts, lambda every: F.when(F.size(every) > 0, of(every)))


def in_tests(path: Column) -> Column:
    return F.array_contains(F.split(F.coalesce(path, F.lit("")), "/"), "tests")


def child_range(hunks: Column, start: Column, end: Column) -> Column:
    """(low, high): the lines of the new file that stand where a span of the old one was; null where nothing does."""
    met = F.filter(hunks, lambda h: (h["new_count"] > 0) & (h["old_start"] <= end) & (start <= h["old_start"] + h["old_count"] - 1))
    low, high = F.array_min(F.transform(met, lambda h: h["new_start"])), F.array_max(F.transform(met, lambda h: h["new_start"] + h["new_count"] - 1))
    return F.when(F.size(met) > 0, F.struct(low.alias("low"), high.alias("high")))


def same_position(hunks: Column, start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether a function of the new file stands where a deleted one was."""
    return bind(child_range(hunks, start, end), lambda r: F.coalesce((other_start <= r["high"]) & (r["low"] <= other_end), F.lit(False)))


def at_site(old_start: Column, old_count: Column, start: Column, end: Column) -> Column:
    """Whether a hunk is within SITE_TOLERANCE lines of a deletion; one that only adds lies between two lines."""
    count = F.coalesce(old_count, F.lit(0))
    first = old_start + F.when(count == 0, 1).otherwise(0)
    return F.coalesce((first <= end + SITE_TOLERANCE) & (start - SITE_TOLERANCE <= first + count - 1), F.lit(False))


def reason_of(text: Column) -> Column:
    """The first label with a rule that matches, UNK without any."""
    out = None
    for label, patterns in REASON_RULES.items():
        hit = text.rlike(begun(patterns) + "(?iU)(?:" + "|".join(patterns) + ")")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("UNK")


def reason_keywords(text: Column, label: Column) -> Column:
    """First match of each rule of a label, in the rules' order."""
    out = None
    for name, patterns in REASON_RULES.items():
        found = F.filter(F.array(*[F.regexp_extract(text, begun((p,)) + "(?iU)(" + p + ")", 1) for p in patterns]), lambda x: x != "")
        out = F.when(label == name, found) if out is None else out.when(label == name, found)
    return out.otherwise(F.array().cast("array<string>"))


def _placed(found: Column, source: str, locator: Column, judged: bool) -> Column:
    return F.transform(found, lambda x: F.struct((x["text"] if judged else x).alias("text"), F.lit(source).alias("source"), locator.alias("locator"), *[x[c].alias(c) for c in ("label", "names_target") if judged]))


def passages(message: Column, pull: Column, title: Column, body: Column, comments: Column, *, split=sentences, judged: bool = False) -> Column:
    """(text, source, locator) of each sentence: of the message, the pull request's title and body, and its comments.

    ``comments`` is an array of (comment_id, body).  ``split`` gives the sentences of a text; where texts come again and
    again they are given by their sentences, and ``split`` is the identity.  With ``judged`` these are structs by
    ``judged_sentence``, whose label and names_target come last.
    """
    told = lambda text, source, locator: _placed(split(text), source, locator, judged)
    none = F.array().cast("array<struct<text:string,source:string,locator:string" + ",label:string,names_target:boolean" * judged + ">>")
    name = F.concat(F.lit("pr:#"), pull.cast("string"))
    asked = lambda text, part: F.when(pull.isNotNull() & text.isNotNull(), told(text, "pr", F.concat(name, F.lit(part)))).otherwise(none)
    reviews = F.flatten(F.transform(F.coalesce(comments, F.array().cast("array<struct<comment_id:bigint,body:string>>")) if split is sentences else comments, lambda c: told(c["body"], "review", F.coalesce(F.concat(F.lit("review:comment_"), c["comment_id"].cast("string")), F.lit("review:unknown")))))
    return F.concat(told(message, "commit", F.lit("commit:message")), asked(title, "#title"), asked(body, "#body"), reviews)


def issue_passages(numbers: Column, titles: Column, bodies: Column, *, split=sentences, judged: bool = False) -> Column:
    """Sentences of issues; a list whose length isn't that of the numbers is left out, as its places can't be told."""
    none = F.array().cast("array<struct<text:string,source:string,locator:string" + ",label:string,names_target:boolean" * judged + ">>")

    def of(texts: Column, part: str) -> Column:
        each = F.transform(F.arrays_zip(numbers.alias("n"), texts.alias("t")), lambda x: _placed(split(x["t"]), "issue", F.concat(F.lit("issue:#"), x["n"].cast("string"), F.lit(part)), judged))
        return F.when(F.size(numbers) == F.size(texts), F.flatten(each)).otherwise(none)

    return F.concat(of(titles, "#title"), of(bodies, "#body"))


def target_name(name: Column) -> Column:
    """The function's name if it can point at it: not that of every class, and not too short."""
    own = F.trim(F.coalesce(name, F.lit("")))
    return F.when(~(F.startswith(own, F.lit("__")) & F.endswith(own, F.lit("__"))) & (F.char_length(F.regexp_replace(own, "^_+|_+$", "")) >= LEAST_NAME), own)


def identifier_like(name: Column) -> Column:
    """Whether a name can't be a plain word: an underscore inside, a capital after the first letter, or a digit."""
    core = F.regexp_replace(name, "^_+|_+$", "")
    return F.contains(core, F.lit("_")) | F.substring(core, 2, 1 << 30).rlike(r"\p{Lu}") | core.rlike(r"\p{Nd}")


def mentioned(sentence: Column, name: Column) -> Column:
    """Whether a sentence names a function: as a word, or for plain words in code or with a bracket behind it."""
    word = F.concat(F.lit(r"(?U)(?<!\w)\Q"), name, F.lit(r"\E(?!\w)"))
    called = F.concat(F.lit(r"(?U)(?<!\w)\Q"), name, F.lit(r"\E\("))
    in_code = F.exists(F.regexp_extract_all(sentence, F.lit(f"({INLINE_CODE})"), F.lit(1)), lambda c: F.regexp_like(c, word))
    told = F.when(identifier_like(name), F.regexp_like(sentence, word)).otherwise(in_code | F.regexp_like(sentence, called))
    return F.coalesce(F.contains(sentence, name) & told, F.lit(False))  # most sentences don't have the name at all


def judged_sentence(text: Column, name: Column) -> Column:
    """(text, label, names_target) of a sentence; code and closing references say no reason."""
    bare = F.regexp_replace(F.regexp_replace(text, CLOSING_REFERENCE, " "), INLINE_CODE, " ")
    return F.struct(text.alias("text"), bind(bare, reason_of).alias("label"), mentioned(text, name).alias("names_target"))


def reason_sentences(found: Column, name: Column) -> Column:
    """Passages that say a reason: (text, source, locator, label, names_target)."""
    judged = lambda p: bind(judged_sentence(p["text"], name), lambda x: F.struct(x["text"].alias("text"), p["source"].alias("source"), p["locator"].alias("locator"), x["label"].alias("label"), x["names_target"].alias("names_target")))
    return with_reason(F.transform(found, judged))


def with_reason(judged: Column) -> Column:
    """The judged passages that say a reason."""
    return F.filter(judged, lambda x: x["label"] != "UNK")


def shape_tokens(**flags: Column) -> Column:
    """Words of which context there is, such as ``zzhaspr`` or ``zznopr``."""
    return F.concat_ws(" ", *[F.concat(F.lit("zz"), F.when(F.coalesce(c, F.lit(False)), "has").otherwise("no"), F.lit(name)) for name, c in flags.items()])


def feature_text(found: Column, name: Column, path: Column, shape: Column, added: Column) -> Column:
    """What a model reads of a record: sentences, names, shape and the beginning of the added code, a line each."""
    stem = F.regexp_replace(F.element_at(F.split(F.coalesce(path, F.lit("")), "/"), -1), r"(?<=.)\.[^.]*$", "")
    parts = F.concat(F.transform(found, lambda p: p["text"]), F.array(F.coalesce(name, F.lit("")), stem, shape, F.substring(F.coalesce(added, F.lit("")), 1, ADDED_SHOWN)))
    return F.array_join(F.filter(parts, lambda x: x != ""), "\n")


def usable_replacement(code: Column, confidence: Column) -> Column:
    """Confidence of a replacement that can serve as evidence: finite, at least 0.5, at most 0.9 of it."""
    sure = confidence.isNotNull() & ~F.isnan(confidence) & (F.abs(confidence) < float("inf")) & (confidence >= 0.5)
    return F.when((F.coalesce(code, F.lit("")) != "") & sure, F.least(F.lit(0.9), confidence))


def decided(scores: Column, backed: Column) -> Column:
    """The label with the greatest score, on a tie one that a sentence backs, then the first by rule; UNK without a positive score.

    ``scores`` is a map from labels to scores, ``backed`` the labels of sentences.
    """
    entries = F.array(*[F.struct(F.coalesce(F.try_element_at(scores, F.lit(k)), F.lit(0.0)).alias("score"), F.array_contains(backed, k).cast("int").alias("backed"), F.lit(-i).alias("rank"), F.lit(k).alias("label")) for i, k in enumerate(REASON_RULES)])
    return bind(F.array_max(entries), lambda best: F.when(best["score"] > 0, best["label"]).otherwise("UNK"))


def graded(label: Column, found: Column, replacement: Column, told: Column) -> Column:
    """(grade, confidence, evidence): a sentence that names the target, a sentence, the replacement, a model's word, the score alone."""
    own = F.filter(found, lambda x: x["label"] == label)
    named, first = F.get(F.filter(own, lambda x: x["names_target"]), F.lit(0)), F.get(own, F.lit(0))
    answer = lambda grade, sure, text: F.struct(F.lit(grade).alias("grade"), sure.cast("double").alias("confidence"), text.alias("evidence"))
    none = F.lit(None).cast("string")
    return (
        F.when(label == "UNK", answer("UNKNOWN", F.lit(None), none))
        .when(named.isNotNull(), answer("EXPLICIT", F.lit(1.0), named["text"]))
        .when(first.isNotNull(), answer("INFERRED", F.lit(0.6), first["text"]))
        .when(replacement.isNotNull(), answer("INFERRED", replacement, none))
        .when(told == label, answer("INFERRED", F.lit(0.5), none))
        .otherwise(answer("INFERRED", F.lit(0.5), none))
    )
