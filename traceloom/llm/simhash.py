"""SimHash near-duplicates: fingerprints sharded by a vantage-point tree over Hamming distance, linked within a few bits."""
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import column, components, connected, durable, release, small_batches, texts

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Fingerprints at home in one shard, about; sampled fingerprints that decide the tree, for each shard and at most.
SHARD, LEAST_SHARDS, SAMPLED, MOST_SAMPLED = 8192, 16, 32, 1 << 20
BLOCK = 32
#: One in SHARE texts tells which shingles are frequent, LISTED of them at most; those that HOT of these texts have are dealt
#: over blocks, each of the texts of as many of these; names of texts that are broadcast, at most.
SHARE, LISTED, HOT, NAMED = 16, 1 << 19, 64, 200_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = -(1 << 63)


def fingerprint(text: str, words: int = 3) -> int:
    """Bit i is 1 if set in over half of the XXH64 values (seed 42) of all word shingles, repeats included."""
    parts = text.encode().translate(_LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxh64_intdigest(joined, 42)
    size = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    stops = np.cumsum(size)
    starts = (stops - size)[: len(parts) - words + 1].tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], 42) for a, b in zip(starts, (stops - 1)[words - 1 :].tolist(), strict=True)], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = np.array([fingerprint(x, words) for x in texts(batch)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "k"), pa.array(fp)], ["doc_id", "k", "fp"])


class VantageTree:
    """A vantage-point tree whose leaves are shards, built from a sample.

    A fingerprint's home is inside a vantage point's ball if its distance is at most the median. A query of radius r also
    visits the other side unless the triangle inequality rules it out.
    """

    def __init__(self, sample: np.ndarray, leaf: int):
        self.nodes: list[tuple[int, int, int, int]] = []
        self.leaves = 0
        self.root = self._build(np.unique(sample.astype(np.uint64)), leaf, np.random.default_rng(7))

    def _build(self, points: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        """Index of a node, or ~shard."""
        if len(points) > leaf:
            vantage = points[rng.integers(len(points))]
            far = np.bitwise_count(points ^ vantage)
            median = int(np.median(far))
            inner = far <= median
            if inner.all():
                median -= 1
                inner = far <= median
            if inner.any():
                me = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                self.nodes[me] = (int(vantage), median, self._build(points[inner], leaf, rng), self._build(points[~inner], leaf, rng))
                return me
        self.leaves += 1
        return ~(self.leaves - 1)

    def route(self, points: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, indexes that visit it, whether it is their home)."""
        todo = [(self.root, np.arange(len(points)), np.ones(len(points), bool))]
        while todo:
            node, idx, home = todo.pop()
            if not len(idx):
                continue
            if node < 0:
                yield ~node, idx, home
                continue
            vantage, median, inner, outer = self.nodes[node]
            far = np.bitwise_count(points[idx] ^ np.uint64(vantage)).astype(np.int16)
            near, out = far <= median + radius, far > median - radius
            todo.append((inner, idx[near], (home & (far <= median))[near]))
            todo.append((outer, idx[out], (home & (far > median))[out]))


def _routed(tree: VantageTree, radius: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = column(batch, "fp").to_numpy()
        found = list(tree.route(fp.view(np.uint64), radius))
        idx = np.concatenate([i for _, i, _ in found]) if found else np.zeros(0, np.int64)
        shard = np.concatenate([np.full(len(i), s, np.int32) for s, i, _ in found]) if found else np.zeros(0, np.int32)
        home = np.concatenate([h for _, _, h in found]) if found else np.zeros(0, bool)
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fp[idx]), pa.array(home)], ["shard", "fp", "home"])


def links_within(points: np.ndarray, home: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join all points whose distance to a point at home is at most radius; no pair of a dense ball is listed twice.

    A vantage-point tree over the points at home, walked by all queries at once; at its leaves each query keeps its first
    partner, and partners of the same query are joined among themselves.
    """
    rng = np.random.default_rng(11)
    us: list[np.ndarray] = []
    vs: list[np.ndarray] = []
    todo = [(np.flatnonzero(home), np.arange(len(points)))]
    while todo:
        own, all_ = todo.pop()
        if not len(own) or len(all_) < 2:
            continue
        if len(own) > BLOCK:
            vantage = points[own[rng.integers(len(own))]]
            far = np.bitwise_count(points[own] ^ vantage).astype(np.int16)
            median = np.median(far)
            inner = far <= median
            if inner.all():
                median -= 1
                inner = far <= median
            if inner.any():
                away = np.bitwise_count(points[all_] ^ vantage).astype(np.int16)
                todo.append((own[inner], all_[away <= median + radius]))
                todo.append((own[~inner], all_[away > median - radius]))
                continue
        for at in range(0, len(own), BLOCK):
            part = own[at : at + BLOCK]
            near = np.bitwise_count(points[part][:, None] ^ points[all_][None, :]) <= radius
            first = near.argmax(axis=0)
            hit = near[first, np.arange(len(all_))]
            us.append(all_[hit])
            vs.append(part[first[hit]])
            joined = np.zeros((len(part), len(part)), bool)
            np.logical_or.at(joined, first[hit], near[:, hit].T)
            a, b = np.nonzero(joined)
            us.append(part[a])
            vs.append(part[b])
    u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
    keep = u != v
    return u[keep], v[keep]


def _shard_links(radius: int, table: pa.Table) -> pa.Table:
    fp = table.column("fp").to_numpy()
    home = table.column("home").to_numpy(zero_copy_only=False)
    label = components(len(fp), *links_within(fp.view(np.uint64), home, radius))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pa.table({"a": fp[moved], "b": fp[label[moved]]})


def hamming_links(points: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs (a, b) of fingerprints that join all distinct fp longs reachable by steps of at most `radius` bits.

    The tree is fitted on a bounded sample (MOST_SAMPLED) of distinct fingerprints; all of them are placed in it. Each shard
    holds its own fingerprints and those whose ball crosses its border, and returns a spanning forest of its links.
    """
    distinct = durable(points.select("fp").distinct())
    n = distinct.count()
    shards = max(LEAST_SHARDS, n // SHARD)
    wanted = min(MOST_SAMPLED, shards * SAMPLED)
    share = min(1.0, 1.5 * wanted / max(n, 1))
    bound = int(share * (1 << 31)) - 1
    picked = distinct.where((F.xxhash64(F.lit("tree"), "fp").bitwiseAND(F.lit((1 << 31) - 1))) <= bound).limit(2 * wanted)
    sample = picked.toArrow().column("fp").to_numpy().astype(np.int64).view(np.uint64)
    tree = VantageTree(sample, max(BLOCK, len(sample) // shards))
    routed = distinct.mapInArrow(partial(_routed, tree, radius), "shard int, fp long, home boolean")

    def shard_links(table: pa.Table) -> pa.Table:
        return _shard_links(radius, table)

    return routed.groupBy("shard").applyInArrow(shard_links, "a long, b long")


def hamming_components(points: DataFrame, radius: int = 3) -> DataFrame:
    """(fp, root): of each distinct fp long, the class of fingerprints reachable by steps of at most `radius` bits; without a link none."""
    return connected(hamming_links(points, radius)).select(F.col("node").alias("fp"), "root")


def simhash_groups(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fp (signed long of the 64 bits), component_id, k, chosen of every row of docs.

    Null and empty texts have fingerprint zero and link like others. Rows that share a fingerprint are one class from the
    start. component_id is the least non-null doc_id of the class, null if it has none. k is a hash of the text; chosen marks
    one document of each class: that of the least doc_id and, where rows share it or have none, the least k. Other columns
    are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("k"), F.col("text").alias("text"))
    marked = durable(rows.mapInArrow(partial(_fingerprints, words), "doc_id long, k long, fp long"))
    small_batches(spark)
    roots = durable(hamming_components(marked, radius))
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("best")
    least = marked.groupBy("fp").agg(best).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = least.groupBy("root").agg(F.min("best").alias("best"))
    classes = durable(least.select("fp", "root").join(named, "root").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.k").alias("best_k")))
    chosen = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("k") == F.col("best_k"))
    return marked.join(classes, "fp").select("doc_id", "fp", "component_id", "k", chosen.alias("chosen"))


def jaccard(a: str, b: str, words: int = 5) -> float:
    """Share of common shingles of two texts, ASCII capitals lowered; a text of fewer words is one shingle."""
    sets = []
    for text in (a, b):
        parts = text.encode().translate(_LOWER).split()
        sets.append({b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as fewer bytes, for the exchanges that bring pairs together."""
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([column(batch, "k"), pa.array([squeeze.compress(x.encode()) for x in texts(batch)], pa.binary())], ["k", "z"])


def _verified(least: float, words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        sides = zip(*(column(batch, c).to_pylist() for c in ("z_a", "z_b")), strict=True)
        keep = np.array([jaccard(open_.decompress(x).decode(), open_.decompress(y).decode(), words) >= least for x, y in sides], bool)
        yield pa.RecordBatch.from_arrays([column(batch, c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """Hashes of the different shingles that jaccard compares."""
    parts = text.encode().translate(_LOWER).split()
    if len(parts) < words:
        return np.array([xxh64_intdigest(b" ".join(parts), 5)], np.uint64)
    own = np.fromiter(map(xxh64_intdigest, parts), np.uint64, len(parts))
    n = len(own) - words + 1
    h = own[:n].copy()
    for j in range(1, words):
        h = h * _FACTOR + own[j : j + n]
    h ^= h >> np.uint64(29)
    return np.unique(h * _FACTOR)


def _short(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _shingles(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in texts(batch):
            yield pa.RecordBatch.from_arrays([pa.array(_short(shingle_hashes(x, words)))], ["s"])


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Short hashes of shingles that a sample of the texts repeats, sorted, and how often; the most frequent LISTED of them.

    They only order shingles, so that frequent ones come last: what is missing here costs candidates, never links.
    """
    few = rows.where(F.pmod(F.xxhash64(F.lit("common"), "k"), F.lit(SHARE)) == 0).select("text")
    counts = few.mapInArrow(partial(_shingles, words), "s int").groupBy("s").agg(F.count("*").cast("int").alias("n")).where("n > 1")
    table = counts.orderBy(F.desc("n"), "s").limit(LISTED).toArrow()
    s, n = (table.column(c).to_numpy() for c in ("s", "n"))
    order = np.argsort(s, kind="stable")
    return s[order], n[order]


def prefix(text: str, words: int, least: float, common: tuple[np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """The number of a text's shingles, short hashes of its rarest ones, and how many sampled texts have each of these.

    Two texts as similar as `least` have one of them in common.
    """
    h = shingle_hashes(text, words)
    s = _short(h)
    count = np.zeros(len(h), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], s), len(common[0]) - 1)
        count = np.where(common[0][at] == s, common[1][at], 0)
    order = np.lexsort((h, count))[: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
    return len(h), s[order], count[order]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    stops = pa.array(np.cumsum([0, *map(len, parts)]), pa.int32())
    return pa.ListArray.from_arrays(stops, pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.int32()))


_MARKED = "doc_id long, k long, fp long, n int, rare array<int>, hot array<int>, blocks array<int>"


def _marked(words: int, least: float, often: int, common, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints and prefixes; hot are the places of frequent shingles in the prefix, blocks the blocks of their texts."""
    for batch in batches:
        whole = texts(batch)
        fp = np.array([fingerprint(x) for x in whole], np.uint64).view(np.int64)
        own = [prefix(x, words, least, common.value) for x in whole]
        hot = [np.flatnonzero(count >= often) for _, _, count in own]
        blocks = [-(-count[at] // often) for (_, _, count), at in zip(own, hot, strict=True)]
        yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "k"), pa.array(fp), pa.array([n for n, *_ in own], pa.int32()), _lists([s for _, s, _ in own]), _lists(hot), _lists(blocks)], [x.split()[0] for x in _MARKED.split(", ")])


_SHARED = "s int, p int, k long, n int, hub long, hub_p int, hub_n int, blocks int"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (s, p, k, n) arrive sorted by s, p and k; those whose s another row has are passed on, with the first row of their s."""
    names = ("s", "p", "k", "n")
    held = [np.zeros(0, t) for t in (np.int32, np.int32, np.int64, np.int32)]  # the first row of the last s, if no other came yet
    hub = None  # that row, once another has come

    for batch in batches:
        own = [np.concatenate([h, column(batch, c).to_numpy()]) for h, c in zip(held, names, strict=True)]
        if not len(own[0]):
            continue
        s, p, k, n = own
        new = np.concatenate([[True], s[1:] != s[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(s)), 0))
        lone = new & np.concatenate([new[1:], [True]])
        hubs = [x[first] for x in (k, p, n)]
        if hub is not None:  # the group of the batch before goes on
            run = int(np.argmax(np.append(s != hub[0], True)))
            for x, y in zip(hubs, hub[1:], strict=True):
                x[:run] = y
            lone[:run] = False
        tail = bool(lone[-1])
        if tail:
            held, lone = [x[-1:] for x in own], lone.copy()
            hub = None
        else:
            held = [x[:0] for x in own]
            hub = (s[-1], *(x[-1] for x in hubs))
        keep = np.flatnonzero(~lone)
        yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (*own, *hubs)] + [pa.array(np.ones(len(keep), np.int32))], [x.split()[0] for x in _SHARED.split(", ")])


def shared_shingles(marked: DataFrame) -> DataFrame:
    """(s, p, k, n, hub, hub_p, hub_n, blocks): shingles of the texts' prefixes that other prefixes have too.

    p is a shingle's place in the order from the rarest; the hub of a shingle is the text in which it stands first. An edit puts
    new, rare shingles before the others, so that one is the original, or near it. Frequent shingles, as far as the sample
    knows, go no common way to one task: their hubs are found by a partially aggregated min and are broadcast, LISTED rows
    at most. All others meet by an exchange and pass by in order, one at a time.
    """
    texts_ = marked.select("k", "n", "rare", "hot", "blocks").dropDuplicates(["k"])
    cold = texts_.select("k", "n", "hot", F.posexplode("rare").alias("p", "s")).where(~F.array_contains("hot", F.col("p"))).select("s", "p", "k", "n")
    cold = cold.repartition("s").sortWithinPartitions("s", "p", "k").mapInArrow(_grouped, _SHARED)
    hot = durable(texts_.where("size(hot) > 0").select("k", "n", "rare", F.explode(F.arrays_zip("hot", "blocks")).alias("h")).select(F.get("rare", F.col("h.hot")).alias("s"), F.col("h.hot").alias("p"), "k", "n", F.col("h.blocks").alias("blocks")))
    hubs = hot.groupBy("s").agg(F.min(F.struct("p", "k", "n")).alias("hub")).select("s", F.col("hub.k").alias("hub"), F.col("hub.p").alias("hub_p"), F.col("hub.n").alias("hub_n"))
    return durable(cold.unionByName(hot.join(F.broadcast(hubs), "s").select(*cold.columns)))


def _may_share(least: float) -> Column:
    """Whether a shingle at places pa and pb, the rarest first, may be the first one that two texts as similar as least share."""
    need = F.ceil((F.col("na") + F.col("nb")) * (least / (1 + least)) - 1e-9)
    return (F.col("pa") <= F.col("na") - need) & (F.col("pb") <= F.col("nb") - need) & (F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)


def _pairs(met: DataFrame, least: float) -> DataFrame:
    return met.where((F.col("a") != F.col("b")) & _may_share(least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _star_pairs(shared: DataFrame, least: float) -> DataFrame:
    """(a, b) of text hashes: each text with the hubs of its shingles. Most copies link to one of them."""
    return _pairs(shared.select(F.col("k").alias("a"), F.col("p").alias("pa"), F.col("n").alias("na"), F.col("hub").alias("b"), F.col("hub_p").alias("pb"), F.col("hub_n").alias("nb")), least)


def _prefix_pairs(shared: DataFrame, root: DataFrame, least: float) -> DataFrame:
    """(a, b) of text hashes of different roots that may share `least` of their shingles; no pair of that similarity is missing.

    The first shingle that two such texts share, the rarest first, stands in a part of both that depends on their numbers of
    shingles; texts meet on the shingles of those parts. The class of a shingle's hub holds most texts that have it, and their
    pairs among each other are not wanted, so only texts of other classes look for partners. The partners of a frequent
    shingle are dealt over blocks, to each of which the others come.
    """
    of = lambda c: root.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    rows = shared.join(of("k"), "k", "left").join(of("hub"), "hub", "left").withColumns({"root": F.coalesce("k_root", "k"), "hub_root": F.coalesce("hub_root", "hub")})
    rows = durable(rows.select("s", "p", "k", "n", "root", "hub_root", "blocks"))
    left = rows.where("root <> hub_root").select("s", F.col("p").alias("pa"), F.col("k").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = rows.select("s", F.col("p").alias("pb"), F.col("k").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"))
    return _pairs(left.join(right, ["s", "block"]).where("ra <> rb"), least)


def _links(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, least: float, words: int) -> DataFrame:
    """The pairs of text hashes whose whole texts share `least` of their shingles or more."""
    wanted = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    named = durable(nodes.join(wanted, "k", "left_semi").select("k", F.coalesce("best.doc_id", F.lit(_NO_ID)).alias("d")))
    if named.count() <= NAMED:
        named = F.broadcast(named)
    wanted = rows.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), "k", "text").join(named, ["d", "k"], "left_semi").select("k", "text")
    few = durable(wanted.mapInArrow(_squeezed, "k long, z binary").dropDuplicates(["k"]))
    both = pairs.join(few.select(F.col("k").alias("a"), F.col("z").alias("z_a")), "a").join(few.select(F.col("k").alias("b"), F.col("z").alias("z_b")), "b")
    return both.mapInArrow(partial(_verified, least, words), "a long, b long")


def near_groups(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3, often: int = HOT) -> DataFrame:
    """doc_id, k, chosen of every row of docs: k is a hash of the text, chosen marks one document of each near-duplicate class.

    Two texts link if their fingerprints differ in `radius` bits or fewer, as in simhash_groups, or if the shingles of `words`
    words that they share are `least` of all they have or more; no such pair is left unlinked, directly or by others. The
    texts' rarest shingles bring them together: first each with one text a shingle, then, between the classes so made, all
    that may be as similar. Each pair is decided on the whole texts. Equal texts are one node throughout. often only says
    which shingles are spread over tasks.
    Chosen is the document of the least doc_id, or of the least k where rows share it or have none; null and empty texts are
    alike and link; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), F.col("text").alias("text"))
    common = spark.sparkContext.broadcast(common_shingles(rows, words))
    marked = durable(rows.mapInArrow(partial(_marked, words, least, often, common), _MARKED))
    nodes = durable(marked.groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")).alias("best"), F.min("fp").alias("fp")))
    # one text stands for all of its fingerprint
    named = nodes.groupBy("fp").agg(F.min("k").alias("r"))
    alike = nodes.select("k", "fp").join(named, "fp").select(F.col("k").alias("a"), F.col("r").alias("b")).where("a <> b")
    of = lambda side: named.select(F.col("fp").alias(side), F.col("r").alias(f"r{side}"))
    near = hamming_links(marked, radius).join(of("a"), "a").join(of("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    shared = shared_shingles(marked)
    release(spark)
    stars = durable(_star_pairs(shared, least))
    first = durable(connected(alike.unionByName(near).unionByName(_links(rows, nodes, stars, least, words))))
    release(spark)
    apart = durable(_prefix_pairs(shared, first, least).join(stars, ["a", "b"], "left_anti"))
    release(spark)
    more = _links(rows, nodes, apart, least, words)
    root = lambda side: first.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    more = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    second = connected(more).select(F.col("node").alias("root"), F.col("root").alias("now"))
    classed = nodes.select("k", "best").join(first.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")).join(second, "root", "left")
    classed = durable(classed.select("k", "best", F.coalesce("now", "root").alias("root")))
    winners = classed.join(classed.groupBy("root").agg(F.min("best").alias("winner")), "root").select("k", "winner")
    chosen = F.col("doc_id").eqNullSafe(F.col("winner.doc_id")) & (F.col("k") == F.col("winner.k"))
    return marked.select("doc_id", "k").join(winners, "k").select("doc_id", "k", chosen.alias("chosen"))


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8, radius: int = 3) -> DataFrame:
    """The rows of docs that near_groups chooses, with the columns of docs; rows that repeat a doc_id and its text stay together."""
    lost = near_groups(docs, words, least, radius).where("not chosen").select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("_lost"), F.col("k").alias("_k")).distinct()
    small_batches(docs.sparkSession)
    return docs.join(lost, (F.coalesce(docs["doc_id"].cast("long"), F.lit(_NO_ID)) == lost["_lost"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == lost["_k"]), "left_anti")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1: fingerprint and component of every document."""
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
