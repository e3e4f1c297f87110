"""MinHash near-dedup with tensored banding, verified on full shingle sets.

Two collections of ``m`` hashes, each made of ``t`` minhashes, give ``m * m`` table keys of ``2 * t`` rows: every pair
of one hash from either collection.  Only ``2 * m * t`` minhashes are computed, about the square root of what that
many separate tables need.  With m = 24 and t = 5, a pair at the bound of 0.8 shares no key with probability 1.4e-4.

1. Sets: one scan gives each document its set's size, a 64-bit hash of the set (its node) and the two collections.
   Documents of one set form a class and go on as one node.
2. Candidates: hashes that a single class has are set aside (counted, not joined in pairs); the rest are paired to
   keys, and each class is linked to the smallest node of each key, its hub: a star, linear in the rows of a key.
3. Verification of stars: links are confirmed on full sets by columns, first each node's link to its smallest hub, then
   those links whose ends are still in different components.  A hub's many links are split by adaptive execution.
4. What is left are keys of three classes or more from more than one component: there a class may be linked to another
   than the hub.  All classes of such a key are compared, in tiles, so no task holds a key and no list of pairs is
   built.  Components that meet in so many keys that comparing their union once is less work are compared as that union.
5. Components of the confirmed links, by large-star and small-star rounds staged in the shared folder; nodes with many
   links have their least neighbour broadcast (a bounded number of nodes), so they are never one task's work.

Sets hold 64-bit hashes of shingles.  Defined cases: null text, or text without words, is linked with nothing; so is a
null id, whose component is null and which is kept; fewer words than a shingle are one shingle; rows that repeat an
id are judged each by its text: each takes part by its own set, and a component is named by the smallest id in it;
copies and rows repeated whole are one class; a very long text costs time and memory in proportion to its distinct
shingles; an empty table gives no rows; other columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, Staged, gram_hashes, in_arrow, mix, release_driver, word_hashes

#: Hashes in each collection, and minhashes in each hash.
M, T = 24, 5
#: Shingles that a tile may hold (8 bytes each), and documents in it.
TILE_SHINGLES, TILE_DOCS = 1_500_000, 512
#: Rows that may be broadcast to pick texts (24 bytes each); beyond this the texts are joined by shuffling.
BROADCAST_IDS = 1_000_000
#: A node is broadcast with its least neighbour if it has over 256 links and over 1 / MOST_HUBS of all.
MOST_HUBS = 1 << 14


def shingles(text: str | None, n: int) -> np.ndarray:
    """The sorted set of hashes of a text's word shingles."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"), LOWER)[0]
    return np.unique(gram_hashes(h, min(n, len(h)))) if len(h) else h


class Collections:
    """The two collections of hashes of a set."""

    def __init__(self, m: int, t: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.m, self.t = m, t
        self.a = rng.integers(0, 2**32, 2 * m * t, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, 2 * m * t, dtype=np.uint32)

    def __call__(self, shingle: np.ndarray) -> np.ndarray:
        h = (shingle >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.a), 2**32 - 1, np.uint32)
        for i in range(0, len(h), 1024):
            np.minimum(low, (h[i : i + 1024, None] * self.a + self.b).min(axis=0), out=low)
        rows = low.astype(np.uint64).reshape(2 * self.m, self.t)
        out = np.arange(2 * self.m, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.t):
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
        return out.view(np.int64)


def signatures(docs: DataFrame, words: int = 4, m: int = M, t: int = T) -> DataFrame:
    """doc_id, text_key, n_shingles, node (hash of the set), a and b (the collections); node, a and b are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = Collections(m, t)
        for batch in batches:
            n, node, a, b = [], [], [], []
            for text in batch.column(2):
                s = shingles(text.as_py(), words)
                n.append(len(s))
                if len(s):
                    both = hashes(s)
                    node.append(int.from_bytes(xxhash.xxh3_128_digest(s.tobytes())[:8], "little", signed=True))
                    a.append(both[:m])
                    b.append(both[m:])
                else:
                    node.append(None), a.append(None), b.append(None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(a, pa.list_(pa.int64())), pa.array(b, pa.list_(pa.int64()))],
                names=["doc_id", "text_key", "n_shingles", "node", "a", "b"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    return in_arrow(rows, run, "doc_id long, text_key long, n_shingles long, node long, a array<long>, b array<long>")


def shared_hashes(classes: DataFrame, collection: str) -> DataFrame:
    """node and its hashes of one collection that another class has too."""
    each = classes.select("node", F.posexplode(collection).alias("i", "h")).select("node", F.xxhash64("i", "h").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    return each.join(common, "h", "left_semi").groupBy("node").agg(F.collect_list("h").alias(collection))


def table_keys(near: DataFrame) -> DataFrame:
    """k and the other columns of ``near``: a row for each pair of a hash of ``a`` and one of ``b``."""
    rest = [c for c in near.columns if c not in ("a", "b")]
    rows = near.select(*rest, F.explode("a").alias("x"), "b").select(*rest, "x", F.explode("b").alias("y"))
    return rows.select(F.xxhash64("x", "y").alias("k"), *rest)


def candidate_links(near: DataFrame) -> DataFrame:
    """(u, v): each class with the smallest node of each table key that they share."""
    keys = table_keys(near)
    first = keys.groupBy("k").agg(F.min("node").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("k", "v")
    return keys.join(first, "k").where("node > v").select(F.col("node").alias("u"), "v").distinct()


def spread(rows: DataFrame, table: DataFrame, key: str, many: int) -> DataFrame:
    """``rows`` joined with a table of one row a key, which says in ``heavy`` how many rows the key has.

    Keys of more than ``many`` rows are broadcast, so their rows stay where they are; the others are joined by shuffling.
    """
    more = [c for c in table.columns if c not in (key, "heavy")]
    hubs = F.broadcast(table.where(F.col("heavy") > many).select(F.col(key).alias("__hub"), *[F.col(c).alias(f"__{c}") for c in more]))
    tried = rows.join(hubs, rows[key] == F.col("__hub"), "left")
    at_hub = tried.where(F.col("__hub").isNotNull()).select(*rows.columns, *[F.col(f"__{c}").alias(c) for c in more])
    rest = tried.where(F.col("__hub").isNull()).select(*rows.columns)
    return at_hub.unionByName(rest.join(table.where(F.col("heavy") <= many).select(key, *more), key).select(*rows.columns, *more))


def with_least(rows: DataFrame, key: str, value: str, many: int) -> DataFrame:
    """``rows`` with m, the least ``value`` of their ``key``."""
    return spread(rows, rows.groupBy(key).agg(F.min(value).alias("m"), F.count(F.lit(1)).alias("heavy")), key, many)


def many_of(rows: int) -> int:
    """Rows of a key beyond which it is a hub; there are at most 2 * MOST_HUBS of them, and 32,768 below that size."""
    return max(256, 2 * rows // MOST_HUBS)


def star_round(links: DataFrame, many: int) -> DataFrame:
    """One large-star and one small-star over (u, v) with u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = with_least(both, "u", "v", many).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
    small = with_least(large, "u", "v", many)
    # every smaller neighbour but the least goes to the least, and the node itself too
    moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
    return small.select(moved.alias("u"), F.col("m").alias("v")).distinct()


def components(links: DataFrame, what: str = "links") -> DataFrame:
    """(u, v): every node that isn't its component's smallest, with the smallest.  ``links`` has u > v.

    A round is some ten small queries, so the driver's memory is given back after each.
    """
    held = Staged(links, what)
    while True:
        release_driver(held.spark)
        n = held.df.count()
        if not n:
            return held.df
        new = Staged(star_round(held.df, many_of(2 * n)), what)
        held.drop()
        held = new
        # finished when all links are stars: no centre is itself linked to a smaller node, and no node has two centres
        e = held.df
        deeper = e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        twice = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u").limit(1)
        if not deeper.union(twice).take(1):
            return e


def with_cluster(rows: DataFrame, key: str, found: DataFrame, name: str) -> DataFrame:
    """``rows`` with the component of ``key``: itself unless ``found`` (u, v) says otherwise."""
    return rows.join(found.select(F.col("u").alias(key), F.col("v").alias("__c")), key, "left").withColumn(name, F.coalesce("__c", key)).drop("__c")


class Forest:
    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True


def verified(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    forest, out, g = Forest(), [], len(ids)
    if g <= 8:
        for i in range(g):
            for j in range(i):
                small, large = sorted((len(sets[i]), len(sets[j])))
                if 100 * small < percent * large or forest.root(i) == forest.root(j):
                    continue
                inter = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * inter >= percent * (small + large - inter) and forest.join(i, j):
                    out.append((ids[i], ids[j]))
        return out
    size = np.array([len(s) for s in sets], np.int64)
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(g), size)
    use = count[at] > 1  # a shingle of one document is in no intersection
    owner, at = owner[use], at[use]
    renumber = np.cumsum(count > 1) - 1
    at = renumber[at]
    width = int(renumber[-1]) + 1 if len(renumber) else 0
    inter = np.zeros((g, g), np.float32)
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    step = max(256, 4_000_000 // g)
    for lo in range(0, width, step):
        a, b = np.searchsorted(at, (lo, lo + step))
        block = np.zeros((g, min(step, width - lo)), np.float32)
        block[owner[a:b], at[a:b] - lo] = 1
        inter += block @ block.T
    inter = np.rint(inter).astype(np.int64)
    linked = 100 * inter >= percent * (size[:, None] + size[None, :] - inter)
    for i in range(g):
        for j in np.flatnonzero(linked[i, :i]).tolist():
            if forest.join(i, j):
                out.append((ids[i], ids[j]))
    return out


def tiled(blocks: DataFrame, percent: int) -> DataFrame:
    """node, tile: the pieces of work that each class of a block takes part in.

    Classes of sizes more than ``percent`` apart can't be linked: sizes fall into bands of that ratio, and only
    equal and neighbouring bands meet.  A band with more than a tile's worth is dealt by hash into ``k`` tiles.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent)) + F.lit(1e-9)).cast("int")
    rows = blocks.withColumn("band", band)
    room = F.greatest(F.lit(8), F.least(F.lit(TILE_DOCS), F.floor(F.lit(TILE_SHINGLES) / F.max("n_shingles")))).cast("int")
    sizes = rows.groupBy("block", "band").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("k"))
    near = sizes.select("block", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"), F.struct(F.col("band").alias("at"), "k").alias("s"))
    near = near.groupBy("block", "band").agg(F.collect_list("s").alias("s"))
    k_of = lambda d: F.coalesce(F.try_element_at(F.filter("s", lambda x: x["at"] == F.col("band") + d), F.lit(1))["k"], F.lit(0))
    rows = rows.join(near, ["block", "band"]).select("node", "block", "band", k_of(-1).alias("below"), k_of(0).alias("k"), k_of(1).alias("above"))
    rows = rows.withColumn("t", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    band, t = F.col("band"), F.col("t")
    tile = lambda b1, t1, b2, t2: F.xxhash64("block", b1, t1, b2, t2)
    # (own band, own tile) with every tile of its band, of the one above and of the one below; one name for either side
    tiles = F.concat(
        F.transform(upto(F.col("k")), lambda x: tile(band, F.least(t, x), band, F.greatest(t, x))),
        F.transform(upto(F.col("above")), lambda x: tile(band, t, band + 1, x)),
        F.transform(upto(F.col("below")), lambda x: tile(band - 1, x, band, t)),
    )
    return rows.select("node", F.explode(tiles).alias("tile"))


def set_table(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, set (hashes of the shingles, ascending) of the wanted nodes; wanted: node, doc_id, text_key."""
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    # rows repeated whole are one text
    texts = texts.join(wanted, ["doc_id", "text_key"]).groupBy("node").agg(F.first("text").alias("text"))

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                sets = [shingles(t.as_py(), words).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return in_arrow(texts, to_sets, "node long, set array<long>")


def confirmed(links: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the links (u, v) with 100 * intersection >= percent * union; links have the sizes of the ends, nu and nv."""
    links = links.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    rows = links.join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u")
    rows = rows.join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
    both = F.size(F.array_intersect("su", "sv"))
    return rows.where(100 * both >= percent * (F.col("nu") + F.col("nv") - both)).select("u", "v")


def group_links(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (u, v), u > v, between classes of one group; groups: node, block, n_shingles."""
    work = Staged(tiled(groups, percent), "tiles")
    wanted = work.df.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("tile")
    pieces = work.df.join(wanted, "tile", "left_semi")
    rows = pieces.join(sets, "node").select("tile", "node", "set").repartition("tile").sortWithinPartitions("tile", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, out = None, [], [], []
        for batch in batches:
            tiles, nodes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (tile, node) in enumerate(zip(tiles, nodes)):
                if tile != now:
                    out += verified(ids, sets, percent)
                    now, ids, sets = tile, [], []
                ids.append(node)
                sets.append(batch.column(2)[i].values.to_numpy().view(np.uint64).copy())
            if out:
                yield as_links(out)
                out = []
        out += verified(ids, sets, percent)
        if out:
            yield as_links(out)

    def as_links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.int64()), pa.array([min(p) for p in pairs], pa.int64())], names=["u", "v"])

    return in_arrow(rows, compare, "u long, v long")


def mixed_groups(near: DataFrame, found: DataFrame) -> DataFrame | None:
    """(node, block): what is still to be compared, as table keys, or as unions of components where that is less work.

    A key of two classes has its one link tried; a key within one component has nothing to tell.  Of the others, keys and
    components that meet in them form unions.  Comparing a union is the square of its nodes, comparing it key by key the
    sum of the keys' squares.
    """
    ends = Staged(with_cluster(near, "node", found, "c"), "ends").df
    n_ends = ends.count()
    each = table_keys(ends).groupBy("k", "c").agg(F.count(F.lit(1)).alias("n"))
    mixed = each.groupBy("k").agg(F.sum("n").cast("double").alias("n"), F.count(F.lit(1)).alias("parts"), F.min("c").alias("low"))
    mixed = Staged(mixed.where("parts > 1 AND n > 2").select("k", "low", "n"), "mixed").df
    n_mixed = mixed.count()
    if not n_mixed:
        return None
    meet = each.join(mixed.select("k", "low"), "k").where("c <> low").select(F.col("c").alias("u"), F.col("low").alias("v")).distinct()
    unions = components(meet, "unions")
    named = unions.select(F.col("u").alias("c"), F.col("v").alias("block")).unionByName(unions.select(F.col("v").alias("c"), F.col("v").alias("block")).distinct())
    size = ends.groupBy("c").agg(F.count(F.lit(1)).alias("heavy"))
    size = Staged(named.join(size, "c"), "parts").df
    by_low = mixed.groupBy("low").agg(F.sum(F.col("n") * F.col("n")).alias("work"), F.count(F.lit(1)).alias("keys"))
    by_low = Staged(by_low.join(named.withColumnRenamed("c", "low"), "low"), "work").df
    work = by_low.groupBy("block").agg(F.sum("work").alias("work"))
    total = size.groupBy("block").agg(F.sum("heavy").cast("double").alias("size"))
    whole = Staged(total.join(work, "block").where(F.col("size") * F.col("size") < F.col("work")).select("block"), "whole").df
    dense = spread(ends.select("node", "c"), size.join(whole, "block").select("c", "block", "heavy"), "c", many_of(n_ends))
    dense = dense.select("node", F.xxhash64(F.lit("union"), "block").alias("block"))
    loose = by_low.join(whole, "block", "left_anti").select("low", F.col("keys").alias("heavy"))
    keys = spread(mixed.select("k", "low"), loose, "low", many_of(n_mixed)).select("k")
    return dense.unionByName(table_keys(ends.drop("c")).join(keys, "k").select("node", F.col("k").alias("block")))


def links_of(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v): nodes linked within their component, with its smallest node."""
    size = classes.select("node", "n_shingles")
    near = shared_hashes(classes, "a").join(shared_hashes(classes, "b"), "node")
    near = Staged(near, "near").df
    stars = Staged(candidate_links(near), "candidates").df
    ends = stars.select(F.col("u").alias("node")).unionByName(stars.select(F.col("v").alias("node"))).distinct()
    ends = Staged(ends.join(size, "node").join(near, "node"), "ends").df
    wanted = ends.select("node").join(classes.select("node", "first.doc_id", "first.text_key"), "node")
    sets = Staged(set_table(docs, wanted, words), "sets").df
    sized = stars.join(ends.select(F.col("node").alias("u"), F.col("n_shingles").alias("nu")), "u")
    sized = Staged(sized.join(ends.select(F.col("node").alias("v"), F.col("n_shingles").alias("nv")), "v"), "stars").df
    # each node's smallest hub of a size that allows a link
    able = sized.where(F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent)
    least = able.groupBy("u", "nu").agg(F.min(F.struct("v", "nv")).alias("m")).select("u", F.col("m.v").alias("v"), "nu", F.col("m.nv").alias("nv"))
    found = components(confirmed(least, sets, percent), "first-links")
    # links between components, tried before or not: those that were tried fail again
    rest = with_cluster(with_cluster(able, "u", found, "cu"), "v", found, "cv").where("cu <> cv")
    rest = rest.join(least.select("u", "v"), ["u", "v"], "left_anti").select("u", "v", "nu", "nv")
    more = Staged(confirmed(rest, sets, percent), "more-links").df
    if more.take(1):
        found = components(found.unionByName(more), "links")
    groups = mixed_groups(ends.select("node", "a", "b"), found)
    if groups is not None:
        groups = Staged(groups.join(ends.select("node", "n_shingles"), "node"), "groups").df
        found = components(found.unionByName(group_links(groups, sets, percent)), "links")
    return found


def clusters(docs: DataFrame, words: int = 4, percent: int = 80, m: int = M, t: int = T, text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: near-duplicate components under the Jaccard bound ``percent``."""
    sigs = Staged(signatures(docs, words, m, t), "signatures").df
    linkable = sigs.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    classes = linkable.groupBy("node").agg(
        F.min(F.struct("doc_id", "text_key")).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("a").alias("a"), F.first("b").alias("b")
    )
    classes = Staged(classes, "classes").df
    found = links_of(docs, classes, words, percent)
    least = classes.select("node", F.col("first.doc_id").alias("rep"))
    # a component is named by its smallest id
    of_root = found.select(F.col("u").alias("node"), F.col("v").alias("root"))
    of_root = of_root.unionByName(found.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    named = with_least(of_root.join(least, "node"), "root", "rep", many_of(found.count())).select("node", "m")
    of_class = least.join(named, "node", "left").select("node", F.coalesce("m", "rep").alias("c"))
    # a node that many copies share is large on the left only, where adaptive execution splits it
    node = F.when(F.col("doc_id").isNotNull(), F.col("node"))
    out = sigs.select("doc_id", "text_key", "n_shingles", node.alias("node")).join(of_class, "node", "left")
    component = F.coalesce("c", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", *(["text_key"] if text_key else []), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def deduplicate(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the rows that aren't kept; columns unchanged.  Rows of an id and text stay or go together.

    Only the ids and text hashes of the rows that go are joined, so the texts are shuffled only if these are too many to
    broadcast.
    """
    judged = clusters(docs, words, percent, text_key=True)
    gone = Staged(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct(), "gone").df
    ids = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    same = (docs["doc_id"].cast("long") == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__text"))
    return docs.join(ids, same, "left_anti")
