"""Neighbours, pages and the pipeline."""

import html
import math
import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codestrata.llm import neighbours
from codestrata.llm.neighbours import search
from codestrata.llm.pages import extract_main_text
from codestrata.llm.queries import op1_neighbours, op3_main_text

from .test_native import base_spans, check_mix
from .test_nearcopies import plain_least

DATA = "/root/testdata/sf0.001"


def exact(vectors, asked, k=10):
    out = {}
    for q in asked:
        near = sorted((math.dist(vectors[q], v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))
        out[q] = near[:k]
    return out


def test_neighbours(spark):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()}
    wanted = exact(vectors, [i for i in vectors if i % 20 == 0])
    found = {}
    for r in search(spark.read.parquet(f"{DATA}/embeddings.parquet"), F.col("vec_id") % 20 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, near in wanted.items():
        got = sorted(found[q])
        assert [r for r, _, _ in got] == list(range(1, 11))
        assert all(s == pytest.approx(math.dist(vectors[q], vectors[i]), abs=1e-12) for _, i, s in got)
        hits += len({i for _, i in near} & {i for _, i, _ in got})
    assert hits >= 0.9 * 10 * len(wanted)
    assert {r.query_id for r in op1_neighbours(spark, DATA).collect()} == {i for i in vectors if i % 100 == 0}


def visited(vectors, asked, target, probes, tables=10, seed=11):
    """The share of rows that each query meets in the tables."""
    ids = sorted(vectors)
    x = neighbours.unit(np.array([vectors[i] for i in ids], float))
    axes, own = neighbours.shape(x.shape[1], len(x), target), np.isin(ids, asked)
    met = np.zeros((own.sum(), len(x)), bool)
    for t in range(tables):
        homes, seen = neighbours.buckets(x, t, axes, 1, seed)[:, 0], neighbours.buckets(x[own], t, axes, probes, seed)
        met |= (seen[:, :, None] == homes).any(axis=1)
    return met.mean()


@pytest.mark.parametrize(("rows", "target"), [(5_000, 512), (5_000, 8), (20_000, 16)])
def test_hashes_and_probes_against_brute_force(spark, rows, target):
    """Clustered vectors, one hash of all signed axes or two: few rows are visited, and nine of ten neighbours are found."""
    rng = np.random.default_rng(rows + target)
    x = rng.normal(size=(rows // 20, 32))[rng.integers(0, rows // 20, rows)] + 0.2 * rng.normal(size=(rows, 32))
    assert len(neighbours.shape(32, rows, target)) == (1 if target == 512 else 2)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    found = {}
    for r in search(df, F.col("vec_id") % 100 == 0, target=target).collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    asked = np.arange(0, rows, 100)
    near = [np.argsort(np.where(np.arange(rows) == q, np.inf, ((x - x[q]) ** 2).sum(axis=1)), kind="stable")[:10] for q in asked]
    assert np.mean([len(set(n.tolist()) & set(found[q])) for q, n in zip(asked.tolist(), near, strict=True)]) >= 9
    # One hash of 64 axes in each of ten tables, or two.
    assert visited(dict(enumerate(x.tolist())), asked, target, 1) <= (0.2 if target == 512 else 0.1)


def test_shapes():
    assert [neighbours.shape(64, n, 512) for n in (0, 500, 60_000, 500_000, 10**9)] == [[128], [128], [128], [128, 8], [128, 128, 128]]
    assert neighbours.shape(3, 10, 512) == [8] and neighbours.shape(1, 10, 512) == [2]


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0, 0.0], "x"), (1, [1.0, 0.0, 0.0], "x"), (2, [1.0, 0.1, 0.0], "x"), (3, [0.0, 0.0, 0.0], "x"), (4, [nan, 1.0, 0.0], "x"), (5, [None, 1.0, 0.0], "x"), (6, None, "x"), (7, [inf, 0.0, 0.0], "x"), (8, [-5.0, 3.0, 1.0], None), (8, [-5.0, 3.0, 1.0], None), (9, [1.0, 2.0], "x"), (10, [], "x"), (None, [1.0, 1.0, 1.0], "x")]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, id string")
    rows = sorted((r.query_id, r.rank, r.vec_id) for r in search(df, F.lit(True), k=3).collect())
    assert [r for r in rows if r[0] < 3] == [(0, 1, 1), (0, 2, 2), (0, 3, 8), (1, 1, 0), (1, 2, 2), (1, 3, 8), (2, 1, 0), (2, 2, 1), (2, 3, 8)]
    assert [r for r in rows if r[0] == 8] == [(8, 1, 2), (8, 2, 0), (8, 3, 1)]
    assert {r[0] for r in rows} == {0, 1, 2, 8}
    assert search(df.limit(0), F.lit(True)).count() == 0


def test_neighbours_in_a_crowded_bucket(spark):
    rng = np.random.default_rng(2)
    vectors = {i: ([1.0, 0.0, 0.0, 0.0] if i % 3 == 0 else rng.normal(size=4).tolist()) for i in range(600)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    found = {}
    for r in search(df, F.col("vec_id") % 50 == 0, block=16).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    wanted = exact(vectors, range(0, 600, 50))
    assert sum(len({i for _, i in wanted[q]} & {i for _, i in found[q]}) for q in wanted) >= 0.95 * 120
    assert [i for _, i in sorted(found[0])] == list(range(3, 33, 3))


def test_neighbours_behind_many_copies_of_a_row(spark):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(size=4).tolist() for i in range(40)}
    near = exact(vectors, [0])[0][0][1]
    rows = [(i, v) for i, v in vectors.items() for _ in range(30 if i == near else 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = sorted((r.rank, r.vec_id) for r in search(df, F.col("vec_id") == 0, probes=8).collect())
    assert found == list(enumerate((i for _, i in exact(vectors, [0])[0]), 1))


def test_hadamard_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 6))
    assert np.allclose(np.linalg.norm(neighbours.signed_axes(x, 0, 0, 1, 16)[:, ::2], axis=1), np.linalg.norm(x, axis=1))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head &amp; tail</h1><p><b>One&nbsp;two<br>three<p>Four <i>fi</i>ve &lt;p&gt; &copy;</p><!-- no --><aside>side</aside><form>name <input></form>
<ul><li>a<li>b</ul><div class="ad">buy</div>loose <span>text</span><section id="comments"><p>first!</p></section></article><div id="sidebar">x</div><footer>end</footer></body></html>"""


def extracted(spark, pages):
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    rows = sorted(extract_main_text(df).collect(), key=lambda r: r.page_id)
    assert all(r.n_chars == len(r.text) for r in rows)
    return [r.text.split("\n\n") if r.text else [] for r in rows]


def test_page(spark):
    pages = {
        PAGE: ["Head & tail", "One two three", "Four five <p> ©", "a", "b", "loose text"],
        "plain &amp; <b>bold</b> text<nav>x</nav>": ["plain & bold text"],
        "<nav>menu <article><p>kept</article>": ["kept"],
        "<div id=x><p>The whole story of the day, told in full</p></div><div class=cards><article>teaser</article></div>": ["The whole story of the day, told in full", "teaser"],
        "<aside><article>related</article></aside><div class=sidebar><article>more</article></div><p>Text": ["Text"],
        '<h1 class="header">Title</h1><section class="reply-letters">Letters</section><div class="share-price-table">12.5</div>': ["Title", "Letters", "12.5"],
        "<div class=ad>all there is</div>": ["all there is"],
        "<div>" * 20000 + "deep" + "</div>" * 20000: ["deep"],
        "<script>x": [],
        "": [],
    }
    assert extracted(spark, [(f"http://h{i}.example/", h) for i, h in enumerate(pages)]) == list(pages.values())
    assert extracted(spark, [(None, None), ("http://x.example", None)]) == [[], []]


def test_pages_with_missing_ends(spark):
    """Nothing is lost where end tags are missing, where a form is around the page, and where an article lies in a box with a name."""
    story = "The article has a good many words, more than all the rest of its page taken together, so it is what the page is about."
    pages = {
        f"<html><head><title>T</title><meta charset=x><body><p>{story}</p></body>": story,
        f"<html><head><title>T<body><div><p>{story}</div>": story,
        f"<body><form action=x><h1>Title</h1><p>{story}</p><input name=q></form></body>": f"Title\n\n{story}",
        f"<body><nav><a href=a>Home</a><div><p>{story}</p></div>": f"Home\n\n{story}",
        f"<body><nav><a href=a>Home</a></nav><div><p>{story}</p></div>": story,
        f"<body><div class='post sponsored'><p>{story}</p></div><p>After.</p>": f"{story}\n\nAfter.",
        f"<body><p>{story}</p><div class=comments-area><p>{story} So true! {story}</p></div>": story,
        f"<body><p>{story}</p><ol class='comment-list'><li>First!</ol><div id=cookie-consent>We use them</div><div class=site-footer>All rights</div>": story,
        f"<body><article><p>{story}</p><table class=menu><tr><td>Soup<td>Cake</table></article>": f"{story}\n\nSoup\n\nCake",
        f"<body><p>{story}<!-- not closed <b>bold</b> a < b &amp; c &lt;</p>": f"{story}bold a < b & c <",
        f"<body><p title='a > b' data-x=\"<p>\">{story}</p><p class='x>And more</p>": f"{story}\n\nAnd more",
    }
    assert extracted(spark, [(f"http://h{i}.example/", h) for i, h in enumerate(pages)]) == [x.split("\n\n") for x in pages.values()]


@pytest.mark.parametrize("part", ["<a ", "<!--", "<!-- x>", "<a '\">", "<script>", "</", "<p class='", "&", "<div>", "<![CDATA["])
def test_hostile_pages_take_linear_time(part):
    from codestrata.llm.pages import parsed

    began = time.process_time()
    parsed(part * 60_000)
    assert time.process_time() - began < 4


def test_differing_menus_and_comments_go_by_the_tree(spark):
    """No tag and no name tells these: menus that differ from page to page and standing remarks, whose parts a site's pages share."""
    rng, pages, stories = random.Random(4), [], []
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    for i in range(30):
        story = " ".join(word() for _ in range(60))
        links = "".join(f"<li><a>{x}</a></li>" for x in [*rng.sample(["News", "Shop", "Team", "Jobs", "Press", "Help"], 4)])
        pages.append(("http://site.example/", f"<body><div class=x1><ul>{links}</ul></div><div class=x2><p>{story}</p></div><div class=x3><p>Sign in to write</p><p>No remarks yet</p></div></body>"))
        stories.append(story)
    assert extracted(spark, pages) == [[x] for x in stories]


def test_pages(spark):
    """The fixtures' pages have one article each, read here by patterns alone."""
    rows = op3_main_text(spark, DATA).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", pages[r.page_id]).group(1).replace("<br>", " ")
        lines = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1)>", "\n", body)).split("\n")
        assert r.text == "\n\n".join(t for line in lines if (t := " ".join(html.unescape(line).split())))


class Tree(HTMLParser):
    """A well-formed page as (path, text) leaves and the child lists of each path."""

    def __init__(self, page):
        super().__init__()
        self.stack, self.leaves, self.styles = [("", [])], [], {}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        name = f"{self.stack[-1][0]}/{tag}.{dict(attrs).get('class', '')}"
        self.stack[-1][1].append(tag)
        self.stack.append((name, []))

    def handle_endtag(self, tag):
        name, children = self.stack.pop()
        self.styles.setdefault(name, set()).add(" ".join(children))

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][1].append("#")
            self.leaves.append((self.stack[-1][0], data.strip()))


def plain_main(pages):
    """What a site's style tree leaves of its pages, by the docstring of low_importance, without weakened boxes and articles."""
    trees = [Tree(p) for p in pages]
    m = len(trees)
    on = Counter(x for t in trees for x in set(t.leaves))
    own = {x: 1 - (1 - 1 / m) * math.log(k, m) for x, k in on.items()}

    def node(path):
        styles = Counter(tuple(sorted(t.styles[path])) for t in trees if path in t.styles)
        total = sum(styles.values())
        shown = -sum(k / total * math.log(k / total, m) for k in styles.values())
        below = [(len(x[1]) * on[x], own[x]) for x in on if x[0] == path or x[0].startswith(path + "/")]
        content = sum(w * v for w, v in below) / sum(w for w, _ in below)
        return (1 - 0.9 ** len(styles)) * min(1, shown) + 0.9 ** len(styles) * content

    def stays(x):
        path, up = x[0], x[0].rpartition("/")[0]
        branch = min(node(path), node(up) if up else 1)
        share = (len(x[1]) + 20) / (len(x[1]) + 60)
        return share * own[x] + (1 - share) * branch >= 0.5

    return [[x[1] for x in t.leaves if stays(x)] for t in trees]


def test_style_tree_against_a_plain_one(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choices(["ash", "birch", "cedar", "elm", "fir", "hazel", "oak", "pine", "rowan", "yew"], k=n))
    sites = {}
    for host, m in (("a", 14), ("b", 5), ("c", 3), ("d", 2)):
        menu = [words(2) + str(i) for i in range(6)]
        pages = []
        for i in range(m):
            links = "".join(f"<li>{x}</li>" for x in [*menu, f"page {i}"])
            story = "".join(f"<p>{words(rng.randrange(3, 30))} {i}</p>" for _ in range(rng.randrange(1, 6)))
            shared = "<p>Subscribe to our letter for more of this</p>" if i % 2 else ""
            pages.append(f"<body><div><ul>{links}</ul></div><div><h2>{words(3)} {i}</h2>{story}{shared}</div><div><p>All rights reserved {host}</p><p>{words(1)}</p></div></body>")
        sites[host] = pages
    found = extracted(spark, [(f"http://{h}.example/{i}", p) for h, pages in sites.items() for i, p in enumerate(pages)])
    wanted = [x for pages in sites.values() for x in plain_main(pages)]
    assert found == wanted
    every = [x for pages in sites.values() for p in pages for x in Tree(p).leaves]
    kept = sum(map(len, found))
    assert 0.3 < kept / len(every) < 0.8  # the tree removes a good part of the leaves
    assert all("All rights" not in x and "page" not in x for page in found[:14] for x in page)


def test_style_tree_removes_what_a_site_repeats(spark):
    page = "<body><div><p>Welcome to our site</p></div><div><p>Story {0} of the day {0}</p><p>More on {0}</p></div><div><p>All rights reserved</p></div></body>"
    data = [(i, f"http://a.example/{i}", page.format(i), "x") for i in range(30)] + [(100, "http://b.example/1", page.format(7), "x"), (101, None, page.format(8), "x"), (102, "http://a.example/x", None, "x")]
    df = spark.createDataFrame(data, "page_id long, url string, html string, uid string")
    found = {r.page_id: r.text for r in extract_main_text(df).collect()}
    assert all(found[i] == f"Story {i} of the day {i}\n\nMore on {i}" for i in range(30))
    assert found[100].startswith("Welcome") and found[101].endswith("reserved") and found[102] == ""
    copies = spark.createDataFrame([(i, f"http://c.example/{i}", page.format(1), "x") for i in range(30)], df.schema)
    assert {r.text.split("\n")[0] for r in extract_main_text(copies).collect()} == {"Welcome to our site"}
    assert extract_main_text(df.limit(0)).count() == 0


def test_pipeline(spark):
    """Each stage against a plain version, on what the one before left."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10_000, None, "en", "src0", 0), (10_001, "12 34", "en", "src0", 5), (10_002, "write to a@b.co or +1 (555) 010-9999 the and of", "en", "src1", 9)], docs.schema)
    docs = docs.union(extra)
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language"](spark, docs, DATA)
    rows = known.collect()
    assert known.columns == docs.columns and {r.doc_id for r in docs.collect()} - {r.doc_id for r in rows} == {10_000, 10_001}
    single = stages["near_duplicates"](spark, known, DATA).collect()
    least = plain_least({r.doc_id: r.text for r in rows})
    assert sorted(r.doc_id for r in single) == sorted(set(least.values()))
    df = spark.createDataFrame(single, docs.schema)
    clean = stages["personal_data"](spark, df, DATA).collect()
    before = {r.doc_id: r.text for r in single}
    assert len(clean) == len(single) and all(not base_spans(r.text) for r in clean)
    assert all(r.text == before[r.doc_id] for r in clean if not base_spans(before[r.doc_id]) and "<" not in r.text)
    df = spark.createDataFrame(clean, docs.schema)
    mixed = stages["mix"](spark, df, DATA).collect()
    words = lambda t: len((t or "").encode().split())
    taken = Counter()
    for r in mixed:
        taken[r.doc_id] += words(r.text)
    sizes = Counter()
    for r in clean:
        sizes[r.source] += words(r.text)
    check_mix([{"doc_id": r.doc_id, "size": words(r.text), "taken": taken[r.doc_id], "source_size": sizes[r.source], "target": t} for r in clean for t in [_target(sizes, r.source)]], {r.doc_id: r.source for r in clean})
    out = stages["pack"](spark, spark.createDataFrame(mixed, docs.schema), DATA).collect()
    assert sum(r.start == 0 for r in out) == len(mixed)


def _target(sizes, source):
    from .test_native import targets

    return targets(sizes)[source]


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, DATA).count() > 200


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string, spans string, _text string, _email string, mark string, root string, _size long, _source string, _mix_id string, _id string"


def test_stages_keep_clashing_columns_and_bear_empty_tables(spark):
    rows = [(i, f"the story of {i} and the others {w}", "en" if i % 2 else "de", "s", 9, "7.5", "mine", "a@b.co", "t", "e", "m", "r", i, "x", "y", "z") for i, w in enumerate(["one"] * 5 + ["two a@b.co"] * 5)]
    df = spark.createDataFrame(rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.limit(0), DATA).count() == 0
        out = stage(spark, df, DATA)
        if name != "pack":
            assert out.columns == df.columns, name
            told = {r.doc_id: r for r in out.collect()}
            assert told, name
            before = {r[0]: r for r in rows}
            assert all(tuple(r)[5:] == before[i][5:] for i, r in told.items()), name


def test_neighbours_of_huge_and_tiny_vectors(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=6) * 10.0 ** e).tolist()) for i, e in enumerate([200] * 8 + [-200] * 8 + [0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in search(df, F.lit(True), k=5).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(24)) and all(len(v) == 5 for v in found.values())
    far = lambda a, b: math.hypot(*(x - y for x, y in zip(a, b, strict=True)))
    vectors = dict(rows)
    for q, near in found.items():
        wanted = sorted((far(vectors[q], v), i) for i, v in vectors.items() if i != q)[:5]
        assert [s for _, _, s in sorted(near)] == pytest.approx([d for d, _ in wanted], rel=1e-9)
