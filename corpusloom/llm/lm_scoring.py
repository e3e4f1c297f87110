"""Stupid-backoff scores of every document under the n-gram counts of all other documents.

The score of a word after its predecessor is ``C(prev word) / C(prev)`` if the pair occurs in another row, else
``alpha * C(word) / N``, else (a word of no other row) ``alpha * alpha / N``; a first word begins at the second.
Counts are leave-one-out: the corpus count less the row's own; ``N`` is the number of all words.  Logarithms are rounded
to millionths, ``L(x) = round(1e6 ln x)``, so that a document's score is a sum of integers, the same in any order.

1. Word counts: partial counts of each task, summed by hash and staged.  Words with at least ``N / hot`` occurrences
   are hot; there can be no more than ``hot`` of them, so their counts are broadcast.  Each task also reports pairs that
   are frequent in it; those that may have ``2 N / 2^17`` occurrences or more, and half of what a bucket should hold, are counted exactly by
   another scan and broadcast too (at most ``2^18``); without such pairs there is no other scan.
2. Pairs: each task packs its rows' pairs (previous word, word, id, times, own counts) by bucket, a hash of the
   pair for hot words and of the word for others; hot pairs, whose counts are known, are dealt over all buckets.  A
   bucket holds all rows of its other pairs, so it counts and scores them at once, and no key can fill it.
3. A pair that occurs elsewhere is divided by its first word's count, which a bucket knows for hot words only; the
   other words are joined with the count table.  Sums by document finish the score.

``relational`` is the plain form, for any order, with a row an n-gram; it gives the same scores for order 2.

Words are runs of other than ASCII white space with A-Z lower-cased, compared by 63-bit hashes.  Defined cases: null
text has no words; a document without words has score 0 and a null mean; rows that share an id (or have none) are left
out one by one and give one row, their sum; rows repeated whole see each other; a very long text is packed by itself,
in memory in proportion to its words; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, Staged, in_arrow, mix, slices, words_of_texts

ALPHA = 0.4
#: Hot words are at most so many, or as many as there are buckets, up to the second figure; hot pairs at most twice the first.
HOT, MOST_HOT = 1 << 17, 1 << 20
#: Bytes of text that a worker packs at once, and document sums that it holds.
PACK_BYTES, SUMS = 4_000_000, 1_000_000
#: Pairs that a bucket should hold.
BUCKET_PAIRS = 500_000
#: A pair with fewer occurrences fills less than half a bucket and needn't be spread.
HOT_PAIR = BUCKET_PAIRS // 2
COLD = np.uint64(1 << 63)
GOLD = np.uint64(0x9E3779B97F4A7C15)
NO_ID = -(2**63)


def micro_log(x: np.ndarray) -> np.ndarray:
    return np.rint(1e6 * np.log(np.maximum(x, 1))).astype(np.int64)


A = round(1e6 * math.log(ALPHA))


def doc_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes (63 bits, the top bit set) of all texts' words in a row, the row of each, and whether it is its text's first."""
    h, size = words_of_texts(texts, LOWER)
    first = np.zeros(len(h), bool)
    first[(np.cumsum(size) - size)[size > 0]] = True
    return h | COLD, np.repeat(np.arange(len(size)), size), first


def pair_hashes(w: np.ndarray, first: np.ndarray) -> np.ndarray:
    """63-bit hashes of the pairs (predecessor, word) of words that aren't first."""
    at = np.flatnonzero(~first)
    with np.errstate(over="ignore"):
        return mix(mix(w[at]) * GOLD + w[at - 1]) >> np.uint64(1)


def word_counts(docs: DataFrame, hot: int) -> DataFrame:
    """h, c, pair: the count of each word in the corpus, and of pairs that are frequent somewhere a lower bound of theirs.

    A part of n pairs reports those that occur more than n / ``hot`` times and more than once in it, so what goes
    unreported of a pair is at most a share of 1 / ``hot`` of all pairs, and one a part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, c = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out(h: np.ndarray, c: np.ndarray, pair: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c), pa.array(np.full(len(h), pair))], names=["h", "c", "pair"])

        for batch in batches:
            for part in slices(batch.column(0), PACK_BYTES):
                new, _, first = doc_words(part.to_pylist())
                every, at, n = np.unique(np.concatenate((h, new)), return_inverse=True, return_counts=True)
                held = np.bincount(at[: len(h)], weights=c, minlength=len(every)).astype(np.int64)
                c = held + n - np.bincount(at[: len(h)], minlength=len(every))
                h = every
                pairs, times = np.unique(pair_hashes(new, first), return_counts=True)
                often = times > max(1, times.sum() / hot)
                if often.any():
                    yield out(pairs[often], times[often], True)
                if len(h) > 1_000_000:
                    yield out(h, c, False)
                    h, c = h[:0], c[:0]
        if len(h):
            yield out(h, c, False)

    return in_arrow(docs.select("text"), run, "h long, c long, pair boolean").groupBy("pair", "h").agg(F.sum("c").alias("c"))


def pair_counts(docs: DataFrame, asked) -> DataFrame:
    """h, c: the counts of the pairs whose hashes are broadcast, in ascending order, as ``asked``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = asked.value
        total = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            for part in slices(batch.column(0), PACK_BYTES):
                w, _, first = doc_words(part.to_pylist())
                total += np.bincount(places(pair_hashes(w, first), wanted), minlength=len(total))
        found = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array(wanted[found].view(np.int64)), pa.array(total[1:][found])], names=["h", "c"])

    return in_arrow(docs.select("text"), run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def planes(x: np.ndarray) -> bytes:
    """64-bit numbers byte plane by byte plane, behind a byte that says which planes are kept: those of zeros aren't."""
    rows = x.astype("<u8").view(np.uint8).reshape(-1, 8).T
    kept = [i for i in range(8) if rows[i].any()]
    return bytes([sum(1 << i for i in kept)]) + rows[kept].tobytes()


def unplanes(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The numbers whose planes begin at ``at``, and where they end."""
    out = np.zeros((n, 8), np.uint8)
    mask, at = data[at], at + 1
    for i in range(8):
        if mask >> i & 1:
            out[:, i] = np.frombuffer(data, np.uint8, n, at)
            at += n
    return out.view("<u8").ravel(), at


#: The columns of a packed block.
PACKED = 6


def pack(w, prev, doc, tf, own_w, own_prev) -> bytes:
    """Rows sorted by word; words and ids as differences; zstd, as planes of few values are short by it, behind the size without it."""
    base = doc.min()
    step = np.diff(w, prepend=np.uint64(0))
    columns = (step, prev, (doc - base).view(np.uint64), tf, own_w, own_prev)
    data = len(w).to_bytes(8, "little") + int(base).to_bytes(8, "little", signed=True) + b"".join(map(planes, columns))
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(memoryview(data)[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n, base, at, out = int.from_bytes(data[:8], "little"), int.from_bytes(data[8:16], "little", signed=True), 16, []
    for _ in range(PACKED):
        x, at = unplanes(data, at, n)
        out.append(x)
    with np.errstate(over="ignore"):
        out[0] = np.cumsum(out[0], dtype=np.uint64)
    out[2] = out[2].view(np.int64) + base
    return out


def places(h: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """1 + place in ``ordered``, 0 for what isn't there."""
    if not len(ordered):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
    return np.where(ordered[at] == h, at + 1, 0)


def codes(h: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """1 + place in ``hot`` for hot words, the hash (top bit set) for others."""
    at = places(h, hot).astype(np.uint64)
    return np.where(at > 0, at, h)


@dataclass
class Frequent:
    """Hashes, ascending, and counts of hot words and hot pairs; there is a bounded number of either."""

    words: np.ndarray
    word_counts: np.ndarray
    pairs: np.ndarray
    pair_counts: np.ndarray


def pair_blocks(ids: np.ndarray, texts: tuple[np.ndarray, np.ndarray, np.ndarray], hot: Frequent, buckets: int) -> Iterator[tuple[int, bytes]]:
    """The distinct pairs of each row, by bucket; ``prev`` is 0 for a first word and has the top bit of nothing else.

    A hot pair is one entry of its own kind: ``w`` is the word's code, ``prev`` the predecessor's, and its rows are
    dealt over all buckets.
    """
    h, row, first = texts
    if not len(h):
        return
    pair = np.zeros(len(h), np.uint64)
    pair[~first] = pair_hashes(h, first)
    w = codes(h, hot.words)
    del h, texts
    prev = np.concatenate((w[:1], w[:-1]))
    prev[first] = 0
    r = row.astype(np.uint64)
    with np.errstate(over="ignore"):
        _, at, n = np.unique(mix(mix(w) + r * GOLD), return_inverse=True, return_counts=True)
        own = n[at].astype(np.uint64)
        del at, n
        own_prev = np.concatenate((own[:1], own[:-1]))
        own_prev[first] = 0
        mine = np.where(first, mix(w), pair)
        _, one, tf = np.unique(mix(mine + r * GOLD), return_index=True, return_counts=True)
        del mine, r
        w, prev, pair, own, own_prev, row = w[one], prev[one], pair[one], own[one], own_prev[one], row[one]
        del one
        # a bucket counts its cold words itself, so only pairs of hot words may stand elsewhere
        spread = ((places(pair, hot.pairs) > 0) | (prev == 0)) & (w < COLD)
        key = np.where(spread, mix(mix(w) + mix(ids[row].view(np.uint64) + row.astype(np.uint64) * GOLD)), np.where(w >= COLD, mix(w), pair))
        bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((w, bucket))
    bucket = bucket[order]
    w, prev, tf, own, own_prev, row = (x[order] for x in (w, prev, tf, own, own_prev, row))
    doc = ids[row]
    cut = np.flatnonzero(np.diff(bucket, prepend=-1))
    for a, b in zip(cut, np.append(cut[1:], len(bucket))):
        yield int(bucket[a]), pack(w[a:b], prev[a:b], doc[a:b], tf[a:b], own[a:b], own_prev[a:b])


def hash_of(code: np.ndarray, hot: Frequent) -> np.ndarray:
    """The word hashes that codes stand for."""
    if not len(hot.words):
        return code
    return np.where(code >= COLD, code, hot.words[np.minimum(np.maximum(code, np.uint64(1)) - np.uint64(1), np.uint64(len(hot.words) - 1)).astype(np.int64)])


def score_bucket(blocks: list[bytes], hot: Frequent) -> tuple[np.ndarray, ...]:
    """(doc, micro, tokens, backed off) by row, and (word, doc, times, own count) to divide by later."""
    w, prev, doc, tf, own, own_prev = (np.concatenate(x) for x in zip(*map(unpack, blocks)))
    blocks.clear()
    tf, own, own_prev = tf.astype(np.int64), own.astype(np.int64), own_prev.astype(np.int64)
    order = np.lexsort((prev, w))
    w, prev, doc, tf, own, own_prev = (x[order] for x in (w, prev, doc, tf, own, own_prev))
    n = len(w)
    new_word = np.append(True, w[1:] != w[:-1])
    new_pair = new_word | np.append(True, prev[1:] != prev[:-1])
    pair_at = np.cumsum(new_pair) - 1
    of_pair = np.bincount(pair_at, weights=tf).astype(np.int64)[pair_at]
    if len(hot.pairs):
        # a hot pair is counted over all buckets
        head = np.flatnonzero(new_pair)
        with np.errstate(over="ignore"):
            at = places(mix(mix(hash_of(w[head], hot)) * GOLD + hash_of(prev[head], hot)) >> np.uint64(1), hot.pairs)
        at = np.where(prev[head] != 0, at, 0)[pair_at]
        of_pair = np.where(at > 0, hot.pair_counts[np.maximum(at, 1) - 1], of_pair)
    word_at = np.cumsum(new_word) - 1
    of_word = np.bincount(word_at, weights=tf).astype(np.int64)[word_at]
    is_hot = w < COLD
    if is_hot.any():
        of_word[is_hot] = hot.word_counts[w[is_hot].astype(np.int64) - 1]
    others = of_pair - tf
    seen = (others > 0) & (prev != 0)
    micro = np.zeros(n, np.int64)
    micro[seen] = micro_log(others[seen])
    prev_hot = seen & (prev < COLD)
    micro[prev_hot] -= micro_log(hot.word_counts[prev[prev_hot].astype(np.int64) - 1] - own_prev[prev_hot])
    back = ~seen
    rest = of_word - own
    micro[back] = np.where(rest[back] > 0, micro_log(rest[back]), A) + np.where(prev[back] != 0, A, 0)
    ask = seen & (prev >= COLD)
    return doc, micro * tf, tf, tf * back, prev[ask], doc[ask], tf[ask], own_prev[ask]


def table(rows: list) -> tuple[np.ndarray, np.ndarray]:
    found = sorted((r["h"] & (2**64 - 1), r["c"]) for r in rows)
    return np.array([h for h, _ in found], np.uint64), np.array([c for _, c in found], np.int64)


def frequent(docs: DataFrame, counts: DataFrame, total: int, hot: int, hot_pairs: int, least: int) -> Frequent:
    """Words of at least ``total / hot`` occurrences; pairs that may have ``2 * total / hot_pairs``, and ``least``, counted exactly.

    There are at most ``hot`` such words and ``2 * hot_pairs`` such pairs.
    """
    words = table(counts.where(~F.col("pair") & (F.col("c") >= F.lit(max(1, math.ceil(total / hot))))).collect())
    cut = max(total / hot_pairs, least) / 2
    pairs = table(counts.where(F.col("pair") & (F.col("c") >= F.lit(math.ceil(cut)))).select("h", "c").collect())[0]
    if len(pairs):
        pairs = table(pair_counts(docs, docs.sparkSession.sparkContext.broadcast(pairs)).collect())
    else:
        pairs = (pairs, np.zeros(0, np.int64))
    return Frequent(*words, *pairs)


def scores(docs: DataFrame, hot: int | None = None, bucket_pairs: int = BUCKET_PAIRS, least: int = HOT_PAIR) -> DataFrame:
    """doc_id, n_words, n_backoff, score_micro (1e6 times the natural logarithm), mean (of a word)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = Staged(word_counts(docs, hot or HOT), "word-counts", "zstd").df
    total = every.where(~F.col("pair")).agg(F.sum("c")).first()[0] or 0
    # as many hot words and pairs as keep a bucket's share of the others at its size, within a fixed bound
    many = hot or min(MOST_HOT, max(HOT, total // bucket_pairs))
    held = spark.sparkContext.broadcast(frequent(docs, every, total, many, hot or HOT, least))
    counts = every.where(~F.col("pair")).select("h", "c")
    buckets = max(8, math.ceil(total / bucket_pairs))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            a = 0
            for part in slices(batch.column(1), PACK_BYTES):
                out = list(pair_blocks(ids[a : a + len(part)], doc_words(part.to_pylist()), known, buckets))
                a += len(part)
                if out:
                    bucket, data = zip(*out)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int64()), pa.array(data, pa.binary())], names=["bucket", "data"])

    names = ["doc", "micro", "n", "back", "h", "own"]

    def to_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now, blocks = held.value, None, []
        sums: list[np.ndarray] = []

        def asked(found) -> pa.RecordBatch:
            doc, micro, n, back, h, ask_doc, ask_n, own = found
            sums.append(np.stack((doc, micro, n, back)))
            if sum(x.shape[1] for x in sums) > SUMS:
                fold()
            none = np.zeros(len(h), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ask_doc, none, ask_n, none, h.view(np.int64), own)], names=names)

        def fold() -> None:
            doc, micro, n, back = np.concatenate(sums, axis=1)
            ids, at = np.unique(doc, return_inverse=True)
            out = np.zeros((3, len(ids)), np.int64)
            for k, x in enumerate((micro, n, back)):
                np.add.at(out[k], at, x)
            sums[:] = [np.concatenate((ids[None], out))]

        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(0)[i].as_py()
                if bucket != now and blocks:
                    yield asked(score_bucket(blocks, known))
                    blocks = []
                now = bucket
                blocks.append(batch.column(1)[i].as_py())
        if blocks:
            yield asked(score_bucket(blocks, known))
        if sums:
            fold()
            doc, micro, n, back = sums[0]
            empty = pa.nulls(len(doc), pa.int64())
            yield pa.RecordBatch.from_arrays([*map(pa.array, (doc, micro, n, back)), empty, empty], names=names)

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(buckets / 4))
    blocks = in_arrow(docs, to_blocks, "bucket long, data binary").repartition(parts, "bucket").sortWithinPartitions("bucket")
    found = Staged(in_arrow(blocks, to_scores, ", ".join(f"{n} long" for n in names)), "pair-scores", "zstd").df
    sums = found.where("h IS NULL").select("doc", "micro", "n", "back")
    asks = found.where("h IS NOT NULL").groupBy("h", "doc", "own").agg(F.sum("n").alias("n")).join(counts, "h")
    less = -F.col("n") * F.rint(1e6 * F.log(F.greatest(F.lit(1), F.col("c") - F.col("own")).cast("double"))).cast("long")
    zero = F.lit(0).cast("long")
    sums = sums.unionByName(asks.select("doc", less.alias("micro"), zero.alias("n"), zero.alias("back")))
    return by_id(docs, sums.groupBy("doc").agg(*[F.sum(c).alias(c) for c in ("micro", "n", "back")]), total)


def by_id(docs: DataFrame, sums: DataFrame, total: int) -> DataFrame:
    """A row for each id of ``docs`` from sums by id, in which what backed off isn't divided by all words yet."""
    zero, base = F.lit(0).cast("long"), round(1e6 * math.log(max(1, total)))
    every = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")).distinct().join(sums, "doc", "left")
    n_words, micro = F.coalesce("n", zero), F.coalesce(F.col("micro") - F.col("back") * F.lit(base), zero)
    return every.select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"),
        n_words.alias("n_words"),
        F.coalesce("back", zero).alias("n_backoff"),
        micro.alias("score_micro"),
        F.when(n_words > 0, micro / n_words / F.lit(1e6)).alias("mean"),
    )


def relational(docs: DataFrame, order: int = 3) -> DataFrame:
    """The same scores for any order, with rows for n-grams instead of packed blocks: the plain form of the method.

    Each row's distinct n-grams are exploded with their counts; count tables by n-gram hash are joined to them; the longest
    context that another row has gives the score, ``alpha`` less for each order that it is short of.  A word and its
    contexts are a row each, shuffled once an order, so it costs a multiple of ``scores`` in disk.
    """
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), "text")
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[ \\t-\\r]+"), lambda x: x != "")
    rows = Staged(docs.select("doc", F.monotonically_increasing_id().alias("row"), words.alias("w")).where(F.size("w") > 0), "rows").df
    tokens = rows.select("doc", "row", "w", F.posexplode("w").alias("i", "_"))
    gram = lambda k, last: F.when(F.col("i") + 1 - last >= k, F.xxhash64(F.array_join(F.slice("w", F.col("i") + 2 - k - last, k), " ")))
    grams = [gram(k, 0).alias(f"g{k}") for k in range(1, order + 1)] + [gram(k, 1).alias(f"p{k}") for k in range(1, order)]
    tokens = Staged(tokens.select("doc", "row", *grams), "grams").df
    own = {}
    for k in range(1, order + 1):
        mine = tokens.where(F.col(f"g{k}").isNotNull()).groupBy("row", F.col(f"g{k}").alias("g")).agg(F.count(F.lit(1)).alias("mine"))
        rest = mine.groupBy("g").agg(F.sum("mine").alias("c"))
        own[k] = Staged(mine.join(rest, "g").select("row", "g", (F.col("c") - F.col("mine")).alias("c")), f"others-{k}").df
    found = tokens
    for k in range(1, order + 1):
        found = found.join(own[k].select("row", F.col("g").alias(f"g{k}"), F.col("c").alias(f"c{k}")), ["row", f"g{k}"], "left")
        if k < order:
            found = found.join(own[k].select("row", F.col("g").alias(f"p{k}"), F.col("c").alias(f"d{k}")), ["row", f"p{k}"], "left")
    log = lambda c: F.rint(1e6 * F.log(F.greatest(c, F.lit(1)).cast("double"))).cast("long")
    longest = reduce(lambda a, k: F.when(F.col(f"g{k}").isNotNull(), k).otherwise(a), range(1, order + 1), F.lit(1))
    micro, back = F.when(F.col("c1") > 0, log(F.col("c1"))).otherwise(F.lit(A)), F.lit(1)
    micro = micro + A * (longest - 1)
    for k in range(2, order + 1):
        seen = F.col(f"c{k}") > 0
        micro = F.when(seen, log(F.col(f"c{k}")) - log(F.col(f"d{k - 1}")) + A * (longest - k)).otherwise(micro)
        back = F.when(seen, 0).otherwise(back)
    total = tokens.count()
    sums = found.groupBy("doc").agg(F.sum(micro).alias("micro"), F.count(F.lit(1)).alias("n"), F.sum(back).alias("back"))
    return by_id(docs.withColumnRenamed("doc", "doc_id"), sums, total)


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, doc_id, unnest(w) AS w, unnest(list_concat([NULL], w[1 : len(w) - 1])) AS p FROM d WHERE len(w) > 0),
dn AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
total AS (SELECT round_even(1e6 * ln(greatest(1, count(*))), 0)::BIGINT AS base FROM t),
d1 AS (SELECT r, w, count(*) AS k FROM t GROUP BY r, w),
c1 AS (SELECT w, sum(k) AS c FROM d1 GROUP BY w),
d2 AS (SELECT r, any_value(doc_id) AS doc_id, p, w, count(*) AS k FROM t GROUP BY r, p, w),
c2 AS (SELECT p, w, sum(k) AS c FROM d2 WHERE p IS NOT NULL GROUP BY p, w),
e AS (
  SELECT d2.doc_id, d2.k, d2.p IS NOT NULL AS inner_word, coalesce(c2.c - d2.k, 0) AS pair, cw.c - dw.k AS word, cp.c - dp.k AS first
  FROM d2 JOIN c1 cw ON cw.w = d2.w JOIN d1 dw ON dw.r = d2.r AND dw.w = d2.w
  LEFT JOIN c2 ON c2.p = d2.p AND c2.w = d2.w
  LEFT JOIN c1 cp ON cp.w = d2.p LEFT JOIN d1 dp ON dp.r = d2.r AND dp.w = d2.p),
s AS (
  SELECT doc_id, sum(CASE WHEN pair > 0 THEN 0 ELSE k END) AS back,
    sum(k * CASE WHEN pair > 0 THEN round_even(1e6 * ln(pair), 0)::BIGINT - round_even(1e6 * ln(first), 0)::BIGINT
                 ELSE (CASE WHEN word > 0 THEN round_even(1e6 * ln(greatest(word, 1)), 0)::BIGINT ELSE {A} END) + (CASE WHEN inner_word THEN {A} ELSE 0 END) END) AS micro
  FROM e GROUP BY doc_id),
r AS (
  SELECT i.doc_id, coalesce(dn.n, 0)::BIGINT AS n_words, coalesce(s.back, 0)::BIGINT AS n_backoff,
    coalesce(s.micro - s.back * total.base, 0)::BIGINT AS score_micro
  FROM (SELECT DISTINCT doc_id FROM d) i LEFT JOIN dn ON dn.doc_id IS NOT DISTINCT FROM i.doc_id
  LEFT JOIN s ON s.doc_id IS NOT DISTINCT FROM i.doc_id, total)
SELECT doc_id, n_words, n_backoff, score_micro, CASE WHEN n_words > 0 THEN score_micro / n_words / 1e6 END AS mean FROM r"""
