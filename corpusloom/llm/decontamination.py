"""Benchmark decontamination by suffix arrays over the training documents.

Each task cuts its documents into shards of about ``shard_words`` words (a document is never split) and sorts every
suffix of a shard, by prefix doubling, as far as the longest benchmark item reaches.  Every suffix of every benchmark
item is binary-searched in it; its longest verbatim match stands beside the place where it would be inserted.  Suffixes
that match for a window (13 words, or the whole of a shorter item) have all their occurrences read off the interval of
suffixes that begin with the window, each followed to its full length.

Nothing is shuffled.  The benchmark is broadcast in blocks of at most ``BLOCK_BYTES`` of text, as arrays of word
hashes; a shard is searched for one block after the other and a worker holds one block at a time, so a large benchmark
costs time and never a task's memory.

Words are compared by 64-bit hashes.  Defined cases: null text has no words; empty tables give no rows, an empty
benchmark no hits; an item shorter than a window is one window of its own length, one without words none;
a null item id is named by the empty string; equal windows of several items count for each of them; repeated
documents are judged each; of equally long matches the one of the smallest document, then the first, is named; a very
long text is a shard by itself, in memory in proportion to its words; other columns pass through ``scan`` unless they
carry the name of an output, and through ``decontaminate`` in any case.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import ITEM_WORDS, in_arrow, of_text, words_of_texts

WINDOW = 13
#: Bytes of benchmark text that one block holds, words that a shard has, and occurrences that are followed at once.
BLOCK_BYTES, SHARD_WORDS, AT_ONCE = 8_000_000, 1_000_000, 1_000_000
OUT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    T.StructField("longest", T.LongType()),
]


def word_codes(texts: list[str | None]) -> list[np.ndarray]:
    """Hashes of each text's words; 0 is kept for the ends of documents."""
    h, sizes = words_of_texts(texts, ITEM_WORDS)
    return np.split(np.maximum(h, np.uint64(1)), np.cumsum(sizes)[:-1]) if len(sizes) else []


class Items:
    """A block of benchmark items as word hashes; only these, the items' sizes and their names travel."""

    def __init__(self, items: list[tuple[str, str | None]]):
        codes = word_codes([text for _, text in items])
        self.names = [name for name, _ in items]
        self.sizes = np.array([len(c) for c in codes], np.int64)
        self.words = np.concatenate([np.zeros(0, np.uint64), *codes])

    @property
    def depth(self) -> int:
        return int(self.sizes.max(initial=0))


class Suffixes:
    """All suffixes of a block: each word's item, place in it, and words up to the item's end."""

    def __init__(self, items: Items):
        self.items, self.words = items, items.words
        self.item = np.repeat(np.arange(len(items.sizes), dtype=np.int32), items.sizes)
        self.left = np.repeat(np.cumsum(items.sizes), items.sizes) - np.arange(len(items.words))
        self.at = items.sizes[self.item] - self.left


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words or more; prefix doubling.

    After each round only suffixes that still share their place are sorted again.
    """
    n = len(words)
    if n == 0:
        return np.zeros(0, np.int64)
    rank = np.unique(words, return_inverse=True)[1].astype(np.int64)
    key = rank * (n + 1) + np.append(rank[1:] + 1, 0)
    order = np.argsort(key)
    ordered = key[order]
    first = np.ones(n + 1, bool)
    first[1:n] = ordered[1:] != ordered[:-1]
    rank = np.empty(n, np.int64)
    place, k = np.arange(n), 2
    while k < depth:
        rank[order] = np.maximum.accumulate(np.where(first[:n], place, 0))
        slots = np.flatnonzero(~(first[:-1] & first[1:]))
        if not len(slots):
            break
        at = order[slots]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + after
        again = np.argsort(key)
        order[slots] = at[again]
        key = key[again]
        first[slots[1:]] |= key[1:] != key[:-1]
        k *= 2
    return order


def common_words(words: np.ndarray, at: np.ndarray, asked: Suffixes, q: np.ndarray, most: np.ndarray, known: int = 0) -> np.ndarray:
    """How many words the suffix of the shard at ``at`` shares with suffix ``q``, up to ``most``; ``known`` of them surely."""
    out = np.full(len(at), known, np.int64)
    open_ = np.arange(len(at))
    d = known
    while True:
        open_ = open_[most[open_] > d]
        open_ = open_[words[at[open_] + d] == asked.words[q[open_] + d]]
        if not len(open_):
            return out
        d += 1
        out[open_] = d


def bound(words: np.ndarray, order: np.ndarray, asked: Suffixes, q: np.ndarray, most: np.ndarray, past: bool = False) -> np.ndarray:
    """For suffixes ``q`` cut at ``most`` words, the first place in ``order`` that isn't before them, or is past all that begin so."""
    lo, hi = np.zeros(len(q), np.int64), np.full(len(q), len(order), np.int64)
    while True:
        open_ = np.flatnonzero(lo < hi)
        if not len(open_):
            return lo
        mid = (lo[open_] + hi[open_]) // 2
        at, ask, upto = order[mid], q[open_], most[open_]
        same = common_words(words, at, asked, ask, upto)
        whole = same == upto
        differ = np.minimum(same, upto - 1)
        right = np.where(whole, past, words[at + differ] < asked.words[ask + differ])
        lo[open_[right]] = mid[right] + 1
        hi[open_[~right]] = mid[~right]


class Shard:
    """Documents in a row, a zero behind each, and the order of all their suffixes."""

    def __init__(self, docs: list[np.ndarray], depth: int):
        self.sizes = np.array([len(d) for d in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)[:-1])).astype(np.int64)
        self.n = int((self.sizes + 1).sum())
        self.words = np.zeros(self.n + depth + 1, np.uint64)
        for s, d in zip(self.starts, docs):
            self.words[s : s + len(d)] = d
        self.order = suffix_array(self.words[: self.n], depth)

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def longest(self, asked: Suffixes) -> tuple[np.ndarray, np.ndarray]:
        """The longest verbatim match of every suffix, and where in the shard it begins (0 words match nowhere)."""
        q = np.arange(len(asked.words))
        lo = bound(self.words, self.order, asked, q, asked.left)
        best, where = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)
        for side in (lo - 1, lo):
            at = self.order[np.clip(side, 0, self.n - 1)]
            got = common_words(self.words, at, asked, q, asked.left)
            better = (got > best) | ((got == best) & (at < where))
            best, where = np.where(better, got, best), np.where(better, at, where)
        return best, where

    def search(self, asked: Suffixes, window: int, hit: np.ndarray, found: list[set[str]], longest: np.ndarray) -> None:
        """Marks hit words, adds the items of each document, and raises its longest match."""
        size = np.minimum(asked.items.sizes, window)[asked.item]
        best, _ = self.longest(asked)
        q = np.flatnonzero((best >= size) & (asked.left >= size))
        lo = bound(self.words, self.order, asked, q, size[q])
        times = bound(self.words, self.order, asked, q, size[q], past=True) - lo
        ends = np.cumsum(times)
        start = 0
        while start < len(q):
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + AT_ONCE, "right")))
            t = times[start:end]
            inside = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
            at = self.order[np.repeat(lo[start:end], t) + inside]
            which = np.repeat(q[start:end], t)
            edge = np.bincount(at, minlength=len(hit) + 1) - np.bincount(at + size[which], minlength=len(hit) + 1)
            hit |= np.cumsum(edge)[: len(hit)] > 0
            owner = self.owner(at)
            np.maximum.at(longest, owner, common_words(self.words, at, asked, which, asked.left[which], int(size[which].min())))
            n = len(asked.items.names)
            for pair in np.unique(owner * n + asked.item[which]).tolist():
                found[pair // n].add(asked.items.names[pair % n])
            start = end


def stretches(hit: np.ndarray) -> list[list[int]]:
    """[start, end) of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str | None]]]:
    """The benchmark in blocks of about ``block_bytes`` of text, each read to the driver by itself."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.col("text").alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / block_bytes))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


class Benchmark:
    """The blocks as broadcasts."""

    def __init__(self, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
        context = benchmark.sparkSession.sparkContext
        made = map(Items, blocks(benchmark, block_bytes))
        held = [(x.depth, context.broadcast(x)) for x in made]
        self.held, self.depth = [b for _, b in held], max(d for d, _ in held)

    def __iter__(self) -> Iterator[Suffixes]:
        """One block after the other; of several none is kept by the worker."""
        for b in self.held:
            yield Suffixes(b.value)
            if len(self.held) > 1:
                b.__dict__.pop("_value", None)


def shards(texts: list[str | None], shard_words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, word codes of consecutive rows) of about ``shard_words`` words."""
    start, docs, size = 0, [], 0
    for i, codes in enumerate(word_codes(texts)):
        docs.append(codes)
        size += len(codes) + 1
        if size >= shard_words:
            yield start, docs
            start, docs, size = i + 1, [], 0
    if docs:
        yield start, docs


def searched(benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES):
    """The column function from a text to what of it is in the benchmark."""
    asked = Benchmark(benchmark, block_bytes)

    def begin():
        def judge(texts: list[str | None]) -> list:
            out = [[], [], [], [], []]
            for _, docs in shards(texts, shard_words):
                shard = Shard(docs, max(window, asked.depth))
                hit, found, longest = np.zeros(shard.n, bool), [set() for _ in docs], np.zeros(len(docs), np.int64)
                for part in asked:
                    shard.search(part, window, hit, found, longest)
                hits = [hit[s : s + k] for s, k in zip(shard.starts, shard.sizes)]
                rows = (shard.sizes.tolist(), [int(h.sum()) for h in hits], [sorted(f) for f in found], [stretches(h) for h in hits], longest.tolist())
                for column, more in zip(out, rows):
                    column += more
            return out

        return judge

    # larger parts make fewer shards to search
    return of_text(T.StructType(OUT), begin, most_bytes=4_000_000)


def scan(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """All columns of ``docs`` with n_words, n_hit, items (sorted ids), spans ([start, end) of hit words) and longest (words of
    the longest verbatim match that has a window)."""
    new = [o.name for o in OUT]
    kept = [c for c in docs.columns if c not in new]
    found = docs.select(*kept, searched(benchmark, **how)("text").alias("__searched"))
    return found.select(*kept, *[F.col("__searched")[c].alias(c) for c in new])


def contaminated(n_hit="n_hit", n_words="n_words"):
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """``docs`` without the documents of which a twentieth of the words or more is hit; columns unchanged."""
    found = docs.withColumn("__searched", searched(benchmark, **how)("text"))
    return found.where(~contaminated("__searched.n_hit", "__searched.n_words")).drop("__searched")


def longest_matches(docs: DataFrame, benchmark: DataFrame, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, at, longest, doc_id, word: for every suffix of every item, its longest verbatim match in the documents.

    Each shard yields one row a suffix that it matches, and the largest over shards is kept.
    """
    asked = Benchmark(benchmark, block_bytes)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    names = ["item_id", "at", "longest", "doc_id", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, docs in shards(batch.column(1).to_pylist(), shard_words):
                shard = Shard(docs, max(1, asked.depth))
                for part in asked:
                    best, where = shard.longest(part)
                    rows = np.flatnonzero(best > 0)
                    doc = shard.owner(where[rows])
                    columns = (
                        [part.items.names[i] for i in part.item[rows]], part.at[rows], best[rows],
                        [ids[start + d] for d in doc.tolist()], where[rows] - shard.starts[doc],
                    )
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    found = in_arrow(texts, run, "item_id string, at long, longest long, doc_id long, word long")
    best = found.groupBy("item_id", "at").agg(F.max(F.struct("longest", -F.col("doc_id"), -F.col("word"))).alias("m"))
    return best.select("item_id", "at", F.col("m.longest").alias("longest"), (-F.col("m.col2")).alias("doc_id"), (-F.col("m.col3")).alias("word"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest by document."""
    judged = scan(docs.select("doc_id", "text"), benchmark)
    return judged.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d) p, sizes WHERE i + n - 1 <= len(w)),
m AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hits AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs
        FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(xs, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""
