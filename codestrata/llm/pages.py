"""Main text of web pages by site style trees.

The pages of a host are merged to one tree: nodes are tags with their classes below their parents, and each has the
styles (sequences of children) and contents that the pages show there.  Entropy says how much of a node is a page's own.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Collection, Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codestrata.llm.common import cut, scratch

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: An open one ends where another of its kind begins.
ENDS_ITSELF = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: What a head may hold: any other tag begins the body, whether the head's end tag is there or not.
HEAD = frozenset("base basefont bgsound head link meta noscript script style template title".split())
#: Everything up to the end tag is text of these, and no main text.
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
#: What HTML itself calls something else than main text.
NOISE_TAGS = frozenset("aside button canvas dialog embed footer form head iframe input menu nav noscript object script select style svg template textarea title".split())
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Of those, branches that a page may lie in as a whole, as in a form around it or in a menu without an end tag.
AROUND = frozenset("aside footer form header menu nav".split())
#: Branches that can't hold an article: one that begins inside shows that its end tag is missing.
SHUT = frozenset("head menu nav noscript select".split())
#: Words of a class or an id that say what a box is likely to be: readers' comments, adverts and notices, and (outside of
#: articles) a page's frame.  A name counts if all of its words are such or say nothing.
COMMENTS = frozenset("comment comments disqus".split())
NOTICES = frozenset("ad ads advert advertisement advertising consent cookie cookies gdpr newsletter popup promo promoted promotion share sharing social sponsor sponsored subscribe".split())
FRAME = frozenset("banner breadcrumb breadcrumbs footer masthead menu nav navbar navigation sidebar toolbar".split())
SAYS_NOTHING = frozenset("area bar block bottom box container global inner left list main notice outer page primary right secondary section site top wrap wrapper".split())
BOXES = frozenset("center div dl figure ol section table ul".split())
_WORDS = re.compile(r"[a-z]+")
_NAMES = re.compile(r"[a-z]+(?:[-_]+[a-z]+)*")
#: A tag with its attributes, quoted values whole; possessive, so a tag that doesn't end costs one look at what follows.
_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]++))", re.IGNORECASE)

#: The base of a node's share that its content has: with l styles it is GAMMA to the power of l, the rest is presentation's.
GAMMA = 0.9
#: The least importance that stays, and what is left of the lack of it in an article.
LEAST, TRUSTED = 0.5, 0.4


#: What a box's name leaves of its leaves' importance.
PRIOR = 0.4
#: Branches are told apart down to this depth, as browsers do; what lies deeper belongs to the node there.
DEPTH = 512


@lru_cache(maxsize=4096)
def kind_of(named: str, trusted: bool) -> str:
    """ "comments" or "name" where one of a box's names says what it is, else nothing."""
    for name in _NAMES.findall(named):
        words = set(_WORDS.findall(name)) - SAYS_NOTHING
        if words and words <= COMMENTS | NOTICES | (frozenset() if trusted else FRAME):
            return "name" if words.isdisjoint(COMMENTS) else "comments"
    return ""


class Leaf(NamedTuple):
    """A block of text: its branch from the root down, what its box's name leaves of its importance, whether it is an article's, and the text."""

    chain: tuple[int, ...]
    prior: float
    trusted: bool
    text: str


class _Node(NamedTuple):
    """An open branch: its nodes, the boxes around it that are set apart (by tag or by name) and its own (or -1), and its children so far."""

    tag: str
    chain: tuple[int, ...]
    noise: bool
    apart: tuple[int, ...]
    box: int
    trusted: bool
    children: list[str]


def pieces_of(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, text) of what a page consists of: "text", "start" (with its attributes) and "end".

    Time grows with the page whatever is broken in it: a search that fails shows that nothing further is to be found.
    A tag that doesn't end up to the page's end is dropped with what follows; one with an open quote ends at the next
    sign; a comment that isn't closed ends at the next sign as well, so no text is lost in it.
    """
    at, n, closing = 0, len(html), True
    while at < n:
        left = html.find("<", at)
        if left < 0:
            left = n
        if left > at:
            yield "text", "", unescape(html[at:left])
        if left == n:
            return
        after = html[left + 1 : left + 2]
        if after in ("!", "?"):
            end = 0
            if html.startswith("<!--", left) and not html.startswith((">", "->"), left + 4) and closing:
                end = html.find("-->", left + 4) + 3
                closing = end > 2
            end = end if end > 2 else html.find(">", left) + 1
            if not end:
                return
            at = end
        elif after.isascii() and after.isalpha() or after == "/" and html[left + 2 : left + 3].isascii() and html[left + 2 : left + 3].isalpha():
            m = _TAG.match(html, left)
            if m is None:
                end = html.find(">", left) + 1
                if not end:
                    return
                name, more = re.match(r"</?([a-zA-Z][^\s/>]*)", html[left:end])[1], ""
            else:
                end, name, more = m.end(), m[1], m[2]
            name = name.lower()
            yield "end" if after == "/" else "start", name, more
            if after != "/" and name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE).search(html, end)
                if close is None and name != "title":
                    return
                end = close.start() if close else end
            at = end
        else:
            yield "text", "", "<"
            at = left + 1


class _Page:
    """Collects a page's leaves in order, and the presentations (sequences of children) of each branch."""

    def __init__(self):
        self.open = [_Node("", (), False, (), -1, False, [])]
        self.count: Counter[str] = Counter()
        self.leaves: list[tuple[Leaf, tuple[int, ...]]] = []
        self.apart: list[str] = []  # what sets each such box apart: "tag", "name" or "comments"
        self.whole: set[int] = set()  # boxes that a page may lie in: forms, boxes by name, and those without an end tag
        self.styles: dict[int, set[int]] = {}
        self.text: list[str] = []

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            self.text = []
            if text:
                node = self.open[-1]
                self.leaves.append((Leaf(node.chain, 1.0, node.trusted, text), node.apart))
                node.children.append("#")

    def close_to(self, depth: int, ended: bool = False) -> None:
        for i, x in enumerate(self.open[depth:]):
            self.count[x.tag] -= 1
            if x.box >= 0 and (x.tag == "form" or not (ended and i == 0)):
                self.whole.add(x.box)
            if x.tag in BLOCK and not x.noise:
                self.styles.setdefault(x.chain[-1], set()).add(xxhash.xxh64_intdigest(" ".join(x.children)) >> 1)
            elif x.children:
                self.open[depth - 1].children.extend(x.children)
        del self.open[depth:]

    def last(self, tags: Collection[str], stop: Collection[str] = ()) -> int:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                return i
            if self.open[i].tag in stop:
                break
        return 0

    def start(self, tag: str, more: str) -> None:
        if self.count["head"] and tag not in HEAD:
            self.flush()
            self.close_to(self.last(("head",)))
        if tag in BLOCK:
            self.flush()
            if self.count["p"]:
                self.close_to(self.last(("p",)))
        elif tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        own = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(more)} if more else {}
        part = tag in ("article", "main") or own.get("role") in ("article", "main") or "articlebody" in own.get("itemprop", "")
        if part and any(self.count[t] for t in SHUT) and (at := next((i for i, x in enumerate(self.open) if x.tag in SHUT), 0)):
            self.close_to(at)
        if any(self.count[t] for t in ENDS_ITSELF.get(tag, ())):
            at = self.last(ENDS_ITSELF[tag], ("ul", "ol", "dl", "table", "select", "div", "section", "article"))
            if at:
                self.close_to(at)
        above = self.open[-1]
        named = f"{own.get('class', '')} {own.get('id', '')}" if own else ""
        noise, apart, role = above.noise, above.apart, own.get("role")
        if tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and not above.trusted:
            around = tag in AROUND or tag not in NOISE_TAGS
            noise = noise or not around
            kind = "tag" if around else ""
        else:
            kind = kind_of(named, above.trusted) if tag in BOXES else ""
        box = -1
        if kind:
            box = len(self.apart)
            self.apart.append(kind)
            apart = (*apart, box)
            if kind == "name":
                self.whole.add(box)
        chain = above.chain
        if tag in BLOCK:
            chain = (*chain, xxhash.xxh64_intdigest(f"{chain[-1] if chain else 0} {tag} {' '.join(sorted(set(_WORDS.findall(named))))}") >> 1) if len(chain) < DEPTH else chain
            above.children.append(tag)
        self.open.append(_Node(tag, chain, noise, apart, box, above.trusted or part and not noise, []))
        self.count[tag] += 1

    def end(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if self.count[tag] > 0:
            self.close_to(self.last((tag,)), True)

    def judged(self) -> list[Leaf]:
        """Leaves outside of what HTML sets apart, each with what the names around it leave of its importance.

        A form, a box without an end tag or one by name that has more than half of a page's text is what the page is
        about: a form around the page, a menu whose end is missing, an article in a sponsored box.  Readers' comments
        are the longer part of many pages, so they count only where nothing else is left.
        """
        size: Counter[int] = Counter()
        for leaf, apart in self.leaves:
            size.update(dict.fromkeys(apart, len(leaf.text)))
        half = sum(len(leaf.text) for leaf, _ in self.leaves) / 2
        told = lambda apart, *kinds: any(self.apart[i] in kinds and (self.apart[i] == "comments" or size[i] <= half or i not in self.whole) for i in apart)
        own = [(leaf, apart) for leaf, apart in self.leaves if not told(apart, "tag")]
        named = [leaf._replace(prior=PRIOR) if told(apart, "name", "comments") else leaf for leaf, apart in own]
        return named if any(x.prior == 1 for x in named) else [leaf for leaf, _ in own]


def parsed(html: str | None) -> tuple[list[Leaf], dict[int, set[int]]]:
    """The leaves of a page outside of what HTML itself sets apart, and the styles of its branches."""
    page = _Page()
    for kind, name, text in pieces_of(html or ""):
        if kind == "start":
            page.start(name, text)
        elif kind == "end":
            page.end(name)
        elif not page.open[-1].noise:
            page.text.append(text)
    page.flush()
    page.close_to(1)
    return page.judged(), page.styles


def hopeless(leaf: Leaf) -> bool:
    """Whether a leaf goes however important its tree finds it: that is 1 at most, and its box's name leaves PRIOR of it."""
    return leaf.prior < LEAST


def place_of(leaf: Leaf) -> int:
    """Number of a leaf's branch, with what is known of it besides its tags."""
    return xxhash.xxh64_intdigest(f"{leaf.chain[-1] if leaf.chain else 0} {leaf.trusted} {leaf.prior}") >> 1


def host_of(url: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def low_importance(nodes: DataFrame, salts: int = 16) -> DataFrame:
    """(host, place, content) of the leaves of each host's style tree that have too little importance.

    ``nodes`` has a row for each branch of a page: host, body, path (its last node), chain (its nodes from the root),
    style, place, trusted, prior, contents and lengths.  A host's pages with the same body count once, so mirrors of a
    page make nothing common.  With m bodies:

    * a leaf's content that is on k of them has the importance 1 - (1 - 1/m) log_m k: 1 if it is one page's own, 1/m if
      all have it, so what two pages share is no noise yet, and what three share is;
    * a node's presentation has the entropy, to base m, of its styles; with l styles, the node has the importance
      (1 - GAMMA^l) presentation + GAMMA^l content, where content is the mean over all leaves below it, by length;
    * a leaf has its own importance and that of its branch (the lesser one of the last two nodes): the shorter it is, the
      more the branch decides, so a menu's one link of its own goes with the menu and a paragraph stays by itself.

    In an article only TRUSTED of what leaves lack counts.  The name of its box leaves ``prior`` of a leaf's importance.  Leaves with less than LEAST go.
    """
    once = nodes.groupBy("host", "body", "path", "place").agg(*[F.first(c).alias(c) for c in ("chain", "style", "trusted", "prior", "contents", "lengths")])
    pages = nodes.select("host", "body").distinct().groupBy("host").agg(F.count("*").cast("double").alias("m"))
    styles = once.groupBy("host", "path", "style").agg(F.count_distinct("body").alias("k"))
    entropy = styles.groupBy("host", "path").agg(F.sum("k").alias("s"), F.sum(F.col("k") * F.log("k")).alias("e"), F.count("*").alias("l"))
    # A row for each host and branch; few, but a host with most pages has most rows of what it is joined with.
    shown = entropy.join(pages, "host").select("host", "path", "m", "l", F.when(F.col("m") > 1, F.least(F.lit(1.0), (F.log("s") - F.col("e") / F.col("s")) / F.log("m"))).otherwise(1.0).alias("shown"))
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    leaves = once.select("host", "path", "place", "chain", "trusted", "prior", F.explode(F.array_distinct(F.arrays_zip(F.col("contents").alias("content"), F.col("lengths").alias("length")))).alias("x"))
    leaves = leaves.groupBy("host", "path", "place", F.col("x.content").alias("content")).agg(F.count("*").alias("k"), F.first("x.length").alias("length"), *[F.first(c).alias(c) for c in ("chain", "trusted", "prior")])
    leaves = cut(leaves.withColumn("salt", F.pmod(F.xxhash64("content"), F.lit(salts)).cast("int")).join(salted(shown.select("host", "path", "m")), ["host", "path", "salt"]).withColumn("own", F.when(F.col("m") > 1, 1 - (1 - 1 / F.col("m")) * F.log("k") / F.log("m")).otherwise(1.0)))
    weight = F.col("length") * F.col("k")
    sums = leaves.groupBy("host", "path").agg(F.first("chain").alias("chain"), F.sum(weight * F.col("own")).alias("a"), F.sum(weight).alias("b"))
    below = sums.select("host", F.explode("chain").alias("path"), "a", "b").groupBy("host", "path").agg((F.sum("a") / F.sum("b")).alias("content"))
    part = F.pow(F.lit(GAMMA), F.col("l"))
    nodes_of = shown.join(below, ["host", "path"]).select("host", "path", ((1 - part) * F.col("shown") + part * F.col("content")).alias("node"))
    above = sums.select("host", "path", F.get("chain", F.size("chain") - 2).alias("up"))
    up = nodes_of.select("host", F.col("path").alias("up"), F.col("node").alias("over"))
    branch = above.join(nodes_of, ["host", "path"]).join(up, ["host", "up"], "left").select("host", "path", F.least("node", F.coalesce("over", "node")).alias("branch"))
    share = (F.col("length") + 20) / (F.col("length") + 60)
    judged = lambda importance: F.col("prior") * F.when(F.col("trusted"), 1 - (1 - importance) * TRUSTED).otherwise(importance)
    # What stays even in a branch of no importance needs no look at it, and neither does what goes in any.
    doubtful = leaves.filter((judged(share * F.col("own")) < LEAST) & (judged(F.lit(1.0)) >= LEAST)).select("host", "path", "place", "content", "salt", "length", "own", "trusted", "prior")
    weighed = doubtful.join(salted(branch), ["host", "path", "salt"])
    return weighed.filter(judged(share * F.col("own") + (1 - share) * F.col("branch")) < LEAST).select("host", "place", "content")


def extract_main_text(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The main text of each page: its blocks, white space made single, joined by two line feeds.

    Pages are parsed twice, and only hashes of blocks are kept in between and gathered by host: counts of (host, branch,
    content) are partly summed before they are dealt, so a host with most pages is no hot spot.  Leaves of low importance
    go back to their pages by page, not by host; those that no tree could keep, as their box's name leaves them too little,
    count in the tree but need no way back.  What HTML itself sets apart (nav, aside, footer, form, script and the
    like, a header outside of articles, and their roles) goes at once.

    Nulls: a null or empty page has the text "".  A page without a host is a site of its own.  Repeated rows give one
    row each; an empty table gives none; other columns are ignored, whatever their names.

    Returns id_col, url_col, text, n_chars.
    """
    own = df.select(F.col(id_col).alias("page"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("uid", F.xxhash64("page", "url", "html"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uid", pa.int64()), ("host", pa.string()), ("body", pa.int64()), ("path", pa.int64()), ("chain", pa.list_(pa.int64())), ("style", pa.int64()), ("place", pa.int64()), ("trusted", pa.bool_()), ("prior", pa.float64()), ("contents", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32()))])
        for batch in batches:
            out = []
            for uid, host, html in zip(*(batch.column(c).to_pylist() for c in ("uid", "host", "html")), strict=True):
                leaves, styles = parsed(html)
                told = [xxhash.xxh64_intdigest(x.text) >> 1 for x in leaves]
                body = xxhash.xxh64_intdigest(" ".join(map(str, told))) >> 1
                shown = {p: xxhash.xxh64_intdigest(" ".join(map(str, sorted(s)))) >> 1 for p, s in styles.items()}
                by_place: dict[int, dict] = {}
                for leaf, content in zip(leaves, told, strict=True):
                    path = leaf.chain[-1] if leaf.chain else 0
                    row = by_place.setdefault(place_of(leaf), {"path": path, "chain": leaf.chain or (0,), "trusted": leaf.trusted, "prior": leaf.prior, "contents": [], "lengths": []})
                    row["contents"].append(content)
                    row["lengths"].append(len(leaf.text))
                    # Inner nodes of the branch have a row too, for their style alone.
                    for depth, node in enumerate(leaf.chain[:-1], 1):
                        by_place.setdefault(-node, {"path": node, "chain": leaf.chain[:depth], "trusted": False, "prior": 1.0, "contents": [], "lengths": []})
                out += [{"uid": uid, "host": host, "body": body, "place": place, "style": shown.get(row["path"], 0), **row} for place, row in by_place.items()]
            yield from pa.Table.from_pylist(out, schema).to_batches()

    site = F.coalesce(host_of(F.col("url")), F.concat(F.lit(" "), F.col("uid").cast("string")))
    found = own.select("uid", site.alias("host"), "html").mapInArrow(hashes, "uid long, host string, body long, path long, chain array<long>, style long, place long, trusted boolean, prior double, contents array<long>, lengths array<int>")
    nodes = cut(found)
    common = low_importance(nodes)
    leaf = nodes.select("uid", "host", "place", F.explode(F.array_distinct("contents")).alias("content"))
    gone = leaf.join(common, ["host", "place", "content"]).groupBy("uid").agg(F.collect_set(F.struct("place", "content")).alias("gone"))
    # Written out so that its size is known: the join below broadcasts it under Spark's threshold and shuffles beyond.
    gone = scratch(gone, "style")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("place", pa.int64()), ("content", pa.int64()), ("text", pa.string())]))
        for batch in batches:
            blocks = [[{"place": place_of(x), "content": xxhash.xxh64_intdigest(x.text) >> 1, "text": x.text} for x in parsed(html)[0] if not hopeless(x)] for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page"), batch.column("url"), batch.column("uid"), pa.array(blocks, kind)], names=["page", "url", "uid", "blocks"])

    page_type = dict(own.dtypes)["page"]
    told = own.mapInArrow(texts, f"page {page_type}, url string, uid long, blocks array<struct<place:long,content:long,text:string>>")
    kept = F.expr("transform(filter(blocks, b -> gone IS NULL OR NOT array_contains(gone, struct(b.place AS place, b.content AS content))), b -> b.text)")
    joined = told.join(gone, "uid", "left").select(F.col("page").alias(id_col), F.col("url").alias(url_col), F.array_join(kept, "\n\n").alias("text"))
    return joined.withColumn("n_chars", F.char_length("text").cast("long"))
