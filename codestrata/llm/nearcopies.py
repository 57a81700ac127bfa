"""Near copies by word shingles: candidates by SimHash ball hashing, verified by exact Jaccard similarity.

Texts at a similarity of 0.8 have a cosine of 8/9 at least and differ in 15 of 100 SimHash bits, a ball that no fingerprint
can emit whole.  So the fingerprint is long and cut into words of 20 bits or more, and of a word's ball each text emits what is
likeliest: all settings of the few bits whose votes are closest.  Both sides of a pair emit, so they meet in the middle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codestrata.llm.common import cut, scratch
from codestrata.llm.components import connected_components, keep_one

#: Words of a shingle, and the least similarity of near copies as a fraction: 4/5.
SHINGLE, LIKE = 5, (4, 5)
#: Hashed places that shingles fall into; each has a vote of its own for every bit of a fingerprint.
PLACES, SEED = 4096, 42
#: Bits of a word that a text emits in all settings, and the chance that a pair at 0.8 meets in no word.
LOOSE, MISS = 3, 5e-6
#: Of the first 256 bits pairs at 0.8 differ in 38.8 +- 5.7, unlike ones in 128 +- 8.
APART = 72
#: Members of a crowded variant differ from its middle in this many of them at most; chance brings others there.
FAR = 104
#: A variant with more members than this is crowded: its members are compared in blocks and not as pairs.
CROWD = 32
#: Members and shingles of a block at most, and texts that all blocks of a cluster are compared with.
BLOCK, BLOCK_ITEMS, PIVOTS = 1024, 4_000_000, 8

_ODD, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _TURN
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Distinct 64-bit hashes of all five-word shingles, ascending; a shorter text is one shingle, a wordless one has none."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and ASCII white space count
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    found = np.full(len(words) - size + 1, size, np.uint64)
    for j in range(size):
        found = _mix(found * _ODD + each[j : j + len(found)])
    return np.unique(found)


def shape(rows: int) -> tuple[int, int]:
    """(width, words) of fingerprints: words widen with the rows, up to 32 bits, so that a variant has about two unlike texts at most.

    The chance that a pair at 0.8 meets in a word of 24 bits is 0.23 and 0.885 times that for each bit more, a little
    less than simulated.
    """
    width = min(32, max(20, 2 + math.ceil(math.log2(rows + 1))))
    return width, math.ceil(math.log(MISS) / math.log(1 - 0.23 * 0.885 ** (width - 24)))


def votes(width: int, words: int) -> np.ndarray:
    """Votes of each place for each bit: whole numbers, so that sums don't depend on their order."""
    return np.clip(np.rint(np.random.default_rng(SEED).standard_normal((PLACES, width * words), np.float32) * 32), -127, 127)


def balls(sets: list[np.ndarray], table: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 256 fingerprint bits of each set as four longs, and for each word its bits and the places of its LOOSE closest votes."""
    counts = np.zeros((len(sets), PLACES), np.float32)
    for i, own in enumerate(sets):
        counts[i] = np.bincount((own >> np.uint64(52)).astype(np.int64), 1.0 - 2.0 * ((own >> np.uint64(51)) & np.uint64(1)), PLACES)
    sums = counts @ table
    told = np.packbits(sums[:, :256] > 0, axis=1, bitorder="little").view("<i8")
    sums = sums.reshape(len(sets), -1, width)
    ones = np.zeros((*sums.shape[:2], 32), bool)
    ones[:, :, :width] = sums > 0
    codes = np.packbits(ones, axis=2, bitorder="little").view("<u4")[:, :, 0].astype(np.int64)
    loose = np.argpartition(np.abs(sums), LOOSE - 1, axis=2)[:, :, :LOOSE]
    for j in range(LOOSE):
        codes |= loose[:, :, j].astype(np.int64) << (32 + 5 * j)
    return told, codes


def variants(codes: np.ndarray) -> np.ndarray:
    """All variants, 2^LOOSE for each of the words of each text; a variant has its word's number above its bits."""
    masks = np.zeros((*codes.shape, 1), np.int64)
    for j in range(LOOSE):
        masks = np.concatenate([masks, masks ^ (1 << (codes[:, :, None] >> (32 + 5 * j) & 31))], axis=2)
    return ((codes & 0xFFFFFFFF) | np.arange(codes.shape[1]) << 32)[:, :, None] ^ masks


def _key(values: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(values.tobytes(), SEED)).view(np.int64))


def _digests(docs: DataFrame, width: int, words: int) -> DataFrame:
    """(id, mark, key, size, bits, codes) of each row of (id, mark, text): key names the set of shingles, so copies share it."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = votes(width, words)
        for whole in batches:
            for low in range(0, whole.num_rows, 128):
                batch = whole.slice(low, 128)
                sets = [shingles(text.as_py()) for text in batch.column(2)]
                bits, codes = balls(sets, table, width)
                some = np.fromiter((len(own) > 0 for own in sets), bool, len(sets))
                ends = np.cumsum([0, *(some * words)]).astype(np.int32)
                arrays = [
                    batch.column(0), batch.column(1), pa.array([_key(own) for own in sets], pa.int64()), pa.array([len(own) for own in sets], pa.int32()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * 4), pa.array(bits.ravel())),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(codes[some].ravel())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "mark", "key", "size", "bits", "codes"])

    return docs.mapInArrow(of, "id long, mark long, key long, size int, bits array<long>, codes array<long>")


def _spread(firsts: DataFrame, words: int) -> DataFrame:
    """(key, b0, b1, b2, b3, v) of each variant of each set, with its first 256 bits."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, 256):
                batch = whole.slice(low, 256)
                found = variants(batch.column(5).flatten().to_numpy().reshape(-1, words))
                each = found[0].size
                arrays = [*(np.repeat(batch.column(i).to_numpy(), each) for i in range(5)), found.ravel()]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["key", "b0", "b1", "b2", "b3", "v"])

    own = firsts.filter("size > 0").select("key", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(4)], "codes")
    return own.mapInArrow(of, "key long, b0 long, b1 long, b2 long, b3 long, v long")


def _differ(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows (v, key, b0, b1, b2, b3)."""
    x = (rows[2:, a] ^ rows[2:, b]).view(np.uint64)
    return np.bitwise_count(x).sum(axis=0, dtype=np.int64)


def _middle(rows: np.ndarray) -> np.ndarray:
    """The one of CROWD rows of a crowded variant that most of them are near to."""
    some = np.arange(CROWD)
    near = _differ(rows, np.repeat(some, CROWD), np.tile(some, CROWD)) <= FAR
    return rows[:, near.reshape(CROWD, CROWD).sum(axis=1).argmax()]


def _crowded(rows: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """(v, key, c, n) of those rows of one crowded variant that are near its middle."""
    both = np.concatenate([middle[:, None], rows], axis=1)
    rows = rows[:, _differ(both, np.arange(1, both.shape[1]), np.zeros(rows.shape[1], np.int64)) <= FAR]
    return np.stack([rows[0], rows[1], np.full(rows.shape[1], middle[1]), np.full(rows.shape[1], CROWD + 1)])


def _small(rows: np.ndarray) -> np.ndarray:
    """(v, key, c, n) of those rows of variants of at most CROWD that are near another of theirs; c is the least of these."""
    near, at = np.zeros(rows.shape[1], bool), np.arange(rows.shape[1])
    for step in range(1, CROWD):
        at = at[at + step < rows.shape[1]]
        at = at[rows[0, at] == rows[0, at + step]]
        if not len(at):
            break
        told = at[_differ(rows, at, at + step) <= APART]
        near[told] = near[told + step] = True
    v, key = rows[:2, near]
    first, place, n = np.unique(v, return_index=True, return_inverse=True, return_counts=True)[1:]
    least = np.minimum.reduceat(key, first) if len(first) else key
    return np.stack([v, key, least[place], n[place]])


def meetings(batches: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """(v, key, c, n) of rows (v, key, b0, b1, b2, b3) sorted by v that share a variant with one near them; CROWD rows at most wait for the next batch."""
    kept, middle = np.zeros((6, 0), np.int64), None
    for rows in batches:
        if middle is not None:
            more = int(np.searchsorted(rows[0], middle[0], "right"))
            yield _crowded(rows[:, :more], middle)
            rows = rows[:, more:]
        rows = np.concatenate([kept, rows], axis=1)
        if not rows.shape[1]:
            continue
        kept, middle = rows[:, :0], None
        starts = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        sizes = np.diff([*starts, rows.shape[1]])
        for start, size in zip(starts[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist(), strict=True):
            own = rows[:, start : start + size]
            middle = _middle(own)
            yield _crowded(own, middle)
        small = np.repeat(sizes <= CROWD, sizes)
        if sizes[-1] <= CROWD:
            kept, middle = rows[:, starts[-1] :].copy(), None
            small[starts[-1] :] = False
        yield _small(rows[:, small])
    yield _small(kept)


def _shared(spread: DataFrame, pieces: int) -> DataFrame:
    """(v, key, c, n) of the texts that meet near ones in a variant."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in meetings(np.stack([b.column(i).to_numpy() for i in (5, 0, 1, 2, 3, 4)]) for b in batches):
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in found], names=["v", "key", "c", "n"])

    return spread.repartition(pieces, "v").sortWithinPartitions("v").mapInArrow(of, "v long, key long, c long, n long")


def _sets(docs: DataFrame) -> DataFrame:
    """(key, items) of each row of (id, text)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1):
                own = shingles(text.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([_key(own)], pa.int64()), pa.array([own.view(np.int64)], pa.list_(pa.int64()))], names=["key", "items"])

    return docs.select("id", "text").mapInArrow(of, "key long, items array<long>")


def _sets_of(keys: DataFrame, docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, items) of some keys, from the text of the least id that has the set.

    Ids are written out, so that their size is known: under Spark's threshold they are broadcast, and texts stay where
    they are.
    """
    ids = scratch(firsts.join(keys, "key").select(F.col("id").alias("_id")).distinct(), "ids")
    found = docs.join(ids, docs["id"].eqNullSafe(ids["_id"])).select("id", "text")
    return _sets(found).join(keys, "key", "left_semi").dropDuplicates(["key"])


def _may(x: str, y: str) -> str:
    """SQL condition that holds for all pairs of near copies (but for a share of 4e-8) and few others."""
    differ = " + ".join(f"bit_count({x}.b{i} ^ {y}.b{i})" for i in range(4))
    return f"least({x}.size, {y}.size) * {LIKE[1]} >= greatest({x}.size, {y}.size) * {LIKE[0]} AND {differ} <= {APART}"


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sets are alike, by the sets themselves."""
    asked = scratch(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), "asked")
    own = cut(sets.join(asked, "key", "left_semi"))
    one, other = own.select(F.col("key").alias("a"), F.col("items").alias("x")), own.select(F.col("key").alias("b"), F.col("items").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return pairs.join(one, "a").join(other, "b").filter(common * (LIKE[0] + LIKE[1]) >= (F.size("x") + F.size("y")) * LIKE[0]).select("a", "b")


def alike(sets: list[np.ndarray], bits: np.ndarray, roots: np.ndarray, asks: np.ndarray) -> np.ndarray:
    """For each set the least position reachable by links among those given; sets with one root need no comparison.

    Only pairs of which one ``asks`` are compared.  Bits tell most unlike pairs; the rest is counted on the whole sets:
    shingles are numbered, and common ones are products of their incidence matrices, some columns at a time.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flags = np.unpackbits(bits.view(np.uint8), axis=1).astype(np.float32)
    ones = flags.sum(axis=1)
    apart = ones[:, None] + ones[None, :] - 2 * (flags @ flags.T)
    may = (apart <= APART) & (np.minimum(size[:, None], size) * LIKE[1] >= np.maximum(size[:, None], size) * LIKE[0])
    may &= (roots[:, None] != roots) & (asks[:, None] | asks)
    used = np.flatnonzero(may.any(axis=1))
    label = np.arange(len(sets))
    if not len(used):
        return label
    number, count = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(len(used)), size[used])
    several = count[number] > 1
    row, column = row[several], (np.cumsum(count > 1) - 1)[number[several]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        seen = np.zeros((len(used), 4096), np.float32)
        seen[row[a:b], column[a:b] - low] = 1
        common += seen @ seen.T
    own = size[used]
    linked = may[np.ix_(used, used)] & (common * (LIKE[0] + LIKE[1]) >= (own[:, None] + own) * LIKE[0])
    x, y = np.nonzero(linked)
    part = np.arange(len(used))
    while True:
        least = part.copy()
        np.minimum.at(least, x, part[y])
        least = np.minimum(least, least[least])
        if (least == part).all():
            break
        part = least
    label[used] = used[part]
    return label


def _block_links(rows: DataFrame) -> DataFrame:
    """Edges (a, b) that connect alike members of each group (cluster, i, j) of (key, root, bits, items, asks).

    A group holds a block, or two, and the cluster's pivots; it emits an edge for each member at most.
    """

    def scan(table: pa.Table) -> pa.Table:
        key = table["key"].to_numpy()
        first = np.unique(key, return_index=True)[1]
        table, key = table.take(first), key[first]
        items = table["items"].combine_chunks()
        bounds = items.offsets.to_numpy()
        flat = items.values.to_numpy()
        sets = [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        bits = table["bits"].combine_chunks().flatten().to_numpy().reshape(-1, 4).copy()
        label = alike(sets, bits, table["root"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False))
        told = np.flatnonzero(label != np.arange(len(key)))
        return pa.table([pa.array(key[told], pa.int64()), pa.array(key[label[told]], pa.int64())], names=["a", "b"])

    return rows.groupBy("cluster", "i", "j").applyInArrow(scan, "a long, b long")


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark_col: str | None = None) -> DataFrame:
    """(id_col, mark, key, root, component_id) of each row; mark is null unless a column is named.

    Rows whose sets of five-word shingles (words as in op2) have a Jaccard similarity of 0.8 or more are linked;
    component_id is the least id reachable.  Texts with the same set count once, so copies cost nothing further.  Every
    link is verified on the whole sets; candidates are pairs that share a variant of a word of their fingerprints.

    Variants of more than CROWD texts are joined to clusters by the texts they share, and clusters are cut into blocks: each
    block is compared within itself and with some pivots, and what isn't in the cluster's largest component after that
    with all other blocks.  This is done inside of tasks, and a block has an edge for each text at most.  In a variant of
    at most CROWD texts all are compared with the least; then those in different components are compared with each other,
    as other links connect nothing new.  These are pairs, but no pair is of one cluster, as blocks have all links there.

    Nulls: null and wordless texts are copies of each other; a row with a null id is linked too and never is the least.
    Repeated rows are kept; an empty table gives no rows; other columns are ignored.
    """
    mark = F.lit(None) if mark_col is None else F.col(mark_col)
    docs = df.select(F.col(id_col).cast("long").alias("id"), mark.cast("long").alias("mark"), F.col(text_col).cast("string").alias("text"))
    width, words = shape(df.count())
    own = cut(_digests(docs, width, words))
    firsts = cut(own.groupBy("key").agg(F.min("id").alias("id"), F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("codes").alias("codes")))
    # Some three million variants in a task: the fewer tasks, the more rows of one text lie together and shrink when written.
    pieces = firsts.count() * (words << LOOSE) // 3_000_000 + 1
    shared = cut(_shared(_spread(firsts, words), pieces))
    told = firsts.select("key", F.struct("key", "size", *[F.get("bits", F.lit(i)).alias(f"b{i}") for i in range(4)]).alias("t"))
    # The sets of all texts that share a variant with a near one, read from the texts once.
    sets = cut(_sets_of(scratch(shared.select("key").distinct(), "keys"), docs, firsts))
    clusters = _clusters(shared.filter(f"n > {CROWD}"), sets, firsts)
    small = cut(_parties(shared.filter(f"n <= {CROWD}"), clusters))
    starred = small.filter("party <> c_party").select(F.col("c").alias("a"), F.col("key").alias("b")).distinct()
    likely = starred.join(told.select(F.col("key").alias("b"), F.col("t").alias("y")), "b").join(told.select(F.col("key").alias("a"), F.col("t").alias("x")), "a").filter(_may("x", "y")).select("a", "b")
    edges = cut(_verified(cut(likely), sets))
    if clusters is not None:
        near = clusters.filter("pivot").select("cluster", *_MEMBER, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"))
        within = clusters.select("cluster", *_MEMBER, F.col("block").alias("i")).union(near)
        edges = cut(edges.union(_block_links(within.select("cluster", "i", F.col("i").alias("j"), *_MEMBER, F.col("key").alias("root"), F.lit(True).alias("asks")))))
    roots = connected_components(edges)
    rest = _verified(_across(small, roots, told), sets)
    if clusters is not None:
        rest = rest.union(_block_links(_outside(clusters, roots)))
    rest = cut(rest)
    if not rest.isEmpty():
        roots = connected_components(edges.union(rest))
    rooted = own.join(roots, own["key"] == roots["node"], "left").select(F.col("id").alias(id_col), "mark", "key", F.coalesce("root", "key").alias("root"))
    least = rooted.groupBy("root").agg(F.min(id_col).alias("component_id"))
    return rooted.join(least, "root").select(id_col, "mark", "key", "root", "component_id")


_MEMBER = ("key", "bits", "items")


def _clusters(crowded: DataFrame, sets: DataFrame, firsts: DataFrame) -> DataFrame | None:
    """(cluster, block, blocks, pivot, key, bits, items) of all members of crowded variants; None without any.

    Blocks grow in number with a cluster's members and with their shingles, so that one fits in a task's memory.
    """
    if crowded.isEmpty():
        return None
    of = connected_components(crowded.filter("key <> c").select(F.col("key").alias("a"), F.col("c").alias("b"))).select(F.col("node").alias("key"), F.col("root").alias("cluster"))
    members = cut(of.join(firsts.select("key", "size", "bits"), "key"))
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.col("size").cast("long")) / BLOCK_ITEMS)).cast("int").alias("blocks"))
    # The pivots are the least by a hash; a heap in each task, and one for each cluster.
    by = F.struct(F.xxhash64("key").alias("h"), "key")
    part = members.groupBy("cluster", F.pmod(F.hash("key"), F.lit(64)).alias("p")).agg(F.min(by).alias("m"))
    pivots = part.groupBy("cluster").agg(F.slice(F.array_sort(F.collect_list("m")), 1, PIVOTS).alias("l")).select(F.explode("l.key").alias("key"), F.lit(True).alias("pivot"))
    placed = members.join(blocks, "cluster").join(pivots, "key", "left")
    return cut(placed.join(sets, "key").select("cluster", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "blocks", F.coalesce("pivot", F.lit(False)).alias("pivot"), *_MEMBER))


def _outside(clusters: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups for the comparison of members outside their cluster's largest component with all other blocks."""
    at = clusters.join(roots, clusters["key"] == roots["node"], "left").select("cluster", "block", "blocks", *_MEMBER, F.coalesce("root", "key").alias("root"))
    size = at.groupBy("cluster", "root").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("m"), F.count("*").alias("parts"))
    at = at.join(size.filter("parts > 1").select("cluster", F.col("m.root").alias("main")), "cluster").withColumn("asks", F.col("root") != F.col("main"))
    # Only blocks with such members meet the others.
    asking = at.filter("asks").select("cluster", F.col("block").alias("i")).distinct()
    asked = at.filter("asks").select("cluster", F.col("block").alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), *_MEMBER, "root", "asks").filter("i <> j")
    others = at.join(asking, "cluster").filter("block <> i").select("cluster", "i", F.col("block").alias("j"), *_MEMBER, "root", F.lit(False).alias("asks"))
    return asked.unionByName(others)


def _parties(small: DataFrame, clusters: DataFrame | None) -> DataFrame:
    """(v, key, c, party, c_party) of the members of variants that have more than one party.

    A text's party is its cluster, or else itself: two of one party need no comparison as a pair.
    """
    own = small.select("v", "key", "c")
    if clusters is None:
        return own.select("*", F.col("key").alias("party"), F.col("c").alias("c_party"))
    at = own.join(clusters.select("key", F.col("cluster").alias("party")), "key", "left").withColumn("party", F.coalesce("party", "key"))
    # A variant has CROWD members at most, and c is the least of them.
    by = Window.partitionBy("v")
    least = F.min(F.struct("key", "party")).over(by)["party"]
    return at.select("*", least.alias("c_party"), F.min("party").over(by).alias("low"), F.max("party").over(by).alias("high")).filter("low <> high").drop("low", "high")


def _across(small: DataFrame, roots: DataFrame, told: DataFrame) -> DataFrame:
    """Pairs (a, b) out of one variant that are in different components and may be alike.

    One side are the members outside of the variant's largest component, the other one all members: two of the largest
    one need no comparison, and neither do two of one party.  Those that were compared with the variant's least text aren't
    asked for again.
    """
    at = cut(small.join(roots, small["key"] == roots["node"], "left").select("v", "key", "c", "party", F.coalesce("root", "key").alias("root")))
    largest = at.groupBy("v", "root").agg(F.count("*").alias("n")).groupBy("v").agg(F.max(F.struct("n", "root")).alias("m"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    # In a variant of two texts the least one has been compared with the other.
    largest = largest.filter("parts > 1 AND n > 2").select("v", F.col("m.root").alias("main"))
    left = cut(at.join(largest, "v").join(told, "key").select("v", "c", "t", "party", "root", "main"))
    x = left.filter("root <> main AND t.key <> c").select("v", F.col("t").alias("x"), F.col("party").alias("x_party"), F.col("root").alias("x_root"))
    y = left.filter("t.key <> c").select("v", F.col("t").alias("y"), F.col("party").alias("y_party"), F.col("root").alias("y_root"))
    return cut(x.join(y, "v").filter(f"x_root <> y_root AND x_party <> y_party AND {_may('x', 'y')}").select(_pair("a", F.least), _pair("b", F.greatest)).distinct())


def _pair(name: str, end) -> Column:
    return end("x.key", "y.key").alias(name)


def one_of_each(df: DataFrame) -> DataFrame:
    """The row with the least id of each component, all columns as they are, whatever their names.

    Null ids come last, and rows that share an id are settled by a hash of the whole row, so reruns agree.  Null and
    wordless texts are one component; an empty table gives no rows.
    """
    return keep_one(df, components)
