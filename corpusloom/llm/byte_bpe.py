"""Byte-level BPE over a published rank table.

Within a piece, a segment tree over its byte positions holds the rank of the pair that starts at each live
position; its root is the leftmost smallest rank.  A merge kills one position and changes the pairs of two live
neighbours: three point updates, each logarithmic in the piece.  Pieces of one padded length are merged side by
side in numpy; a long piece alone runs the same tree over lists.

Text is cut into units (a run of white space and what follows up to the next), whose ids don't depend on
their surroundings; units repeat, so each worker keeps a bounded memo of them.

Defined cases: null text encodes as the empty text (no ids); extra columns pass through, and one named like an
output is replaced; repeated rows give repeated results; an empty table gives no rows; ties of equal ranks go
to the left.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusloom.llm.common import in_arrow, slices

INF = np.int64(2**62)
#: Padded lengths above this are merged one by one.
SIDE_BY_SIDE = 128
#: Units that a worker remembers; longer ones than the second figure are never kept.
MEMO, MEMO_LEN = 80_000, 64


class PairRanks:
    """rank(a, b): the rank of the joined bytes of two tokens, if the table holds them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes_of: list[bytes] = [b""] * (max(ranks.values()) + 1)
        for b, r in ranks.items():
            self.bytes_of[r] = b
        self.ranks = ranks
        keys, values = [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.values = np.array(keys, np.int64)[order], np.array(values, np.int64)[order]
        self.pairs = dict(zip(keys, values))
        self.byte_ids = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        #: Ranks of pairs of bytes, by 256 * first + second.
        every = np.arange(65536)
        self.first = self.lookup(self.byte_ids[every >> 8], self.byte_ids[every & 255])
        #: Ids of pieces met before, so that a known word beside new punctuation is not merged again.
        self.memo: dict[bytes, bytes] = {}

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], INF)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> PairRanks:
    lines = Path(path).read_bytes().splitlines()
    return PairRanks({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)})


def merge_together(pieces: list[bytes], table: PairRanks, size: int) -> list[np.ndarray]:
    """Ids of pieces of at most ``size`` bytes (a power of two), all merged in step."""
    m, bits = len(pieces), size.bit_length() - 1
    length = np.fromiter(map(len, pieces), np.int64, m)
    raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(m, size)
    place = np.arange(size)
    ids = np.zeros((m, size + 1), np.int64)
    ids[:, :size] = table.byte_ids[raw]
    nxt = np.broadcast_to(np.arange(1, size + 2), (m, size + 1)).copy()
    nxt[:, :size] = np.where(place + 1 < length[:, None], place + 1, size)
    prv = np.broadcast_to(np.arange(-1, size), (m, size + 1)).copy()
    live = place < length[:, None]
    tree = np.full((m, 2 * size), INF)
    wide = np.zeros((m, size), np.int64)
    wide[:, :-1] = raw[:, :-1].astype(np.int64) << 8 | raw[:, 1:]
    pair = table.first[wide]
    leaf = (pair << bits) | place
    tree[:, size:] = np.where((place + 1 < length[:, None]) & (pair < INF), leaf, INF)
    width = size
    while width > 1:
        half = tree[:, width : 2 * width]
        width //= 2
        tree[:, width : 2 * width] = np.minimum(half[:, 0::2], half[:, 1::2])

    def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray | np.int64) -> None:
        node = at + size
        tree[rows, node] = value
        for _ in range(bits):
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    def pair_at(rows: np.ndarray, at: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = table.lookup(ids[rows, at], ids[rows, right])
        return np.where((right < size) & (rank < INF), (rank << bits) | at, INF)

    rows = np.flatnonzero(tree[:, 1] < INF)
    while len(rows):
        root = tree[rows, 1]
        at, rank = root & (size - 1), root >> bits
        dead = nxt[rows, at]
        after = nxt[rows, dead]
        ids[rows, at] = rank
        nxt[rows, at] = after
        prv[rows, after] = at
        live[rows, dead] = False
        put(rows, dead, INF)
        put(rows, at, pair_at(rows, at, after))
        before = prv[rows, at]
        has = before >= 0
        if has.any():
            r, b = rows[has], before[has]
            put(r, b, pair_at(r, b, at[has]))
        rows = rows[tree[rows, 1] < INF]
    return [ids[i, :size][live[i]] for i in range(m)]


def merge_alone(piece: bytes, table: PairRanks) -> list[int]:
    """The same tree over lists, for a long piece: n log n."""
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    bits, none, pairs = size.bit_length() - 1, int(INF), table.pairs
    ids = table.byte_ids[np.frombuffer(piece, np.uint8)].tolist()
    nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [none] * (2 * size)
    for i in range(n - 1):
        rank = pairs.get(ids[i] << 32 | ids[i + 1])
        if rank is not None:
            tree[size + i] = rank << bits | i
    for node in range(size - 1, 0, -1):
        tree[node] = min(tree[2 * node], tree[2 * node + 1])

    def put(at: int, value: int) -> None:
        node = at + size
        tree[node] = value
        while node > 1:
            node >>= 1
            a, b = tree[2 * node], tree[2 * node + 1]
            best = a if a < b else b
            if tree[node] == best:
                return
            tree[node] = best

    dead = bytearray(n)
    while tree[1] < none:
        at, rank = tree[1] & (size - 1), tree[1] >> bits
        gone = nxt[at]
        after = nxt[gone]
        ids[at], nxt[at], dead[gone] = rank, after, 1
        put(gone, none)
        new = none
        if after < n:
            prv[after] = at
            r = pairs.get(rank << 32 | ids[after])
            new = none if r is None else r << bits | at
        put(at, new)
        before = prv[at]
        if before >= 0:
            r = pairs.get(ids[before] << 32 | rank)
            put(before, none if r is None else r << bits | before)
    return [ids[i] for i in range(n) if not dead[i]]


def merge_pieces(pieces: set[bytes], table: PairRanks) -> dict[bytes, bytes]:
    """Ids (little-endian 32-bit) of each distinct piece."""
    out: dict[bytes, bytes] = {}
    by_size: dict[int, list[bytes]] = {}
    memo = table.memo
    if len(memo) > MEMO:
        memo.clear()
    for p in pieces:
        whole = table.ranks.get(p)
        if p in memo:
            out[p] = memo[p]
        elif whole is not None:
            out[p] = whole.to_bytes(4, "little")
        elif len(p) > SIDE_BY_SIDE:
            out[p] = np.array(merge_alone(p, table), "<u4").tobytes()
        elif p:
            by_size.setdefault(1 << max(1, (len(p) - 1).bit_length()), []).append(p)
    for size, group in by_size.items():
        step = max(1, 100_000 // size)
        for i in range(0, len(group), step):
            part = group[i : i + step]
            out.update(zip(part, (x.astype("<u4").tobytes() for x in merge_together(part, table, size))))
        memo.update((p, out[p]) for p in group)
    return out


class Encoder:
    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.table, self.pieces = load_ranks(ranks_path), regex.compile(pattern).findall
        self.units = regex.compile(r"\s*\S+|\s+").findall
        self.twice = regex.compile(r"\s\s").search
        # what parts a text into units, and what makes letters one piece, holds for this pattern and isn't taken for granted of others
        import public_tokenizers

        self.by_units = pattern == public_tokenizers.PATTERN
        #: By unit; those of ``spaced`` stand after one space that isn't in their key.
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}

    def learn(self, missing: set[str], memo: dict[str, bytes], prefix: str) -> None:
        cut: dict[str, list[bytes]] = {}
        for u in missing:
            if u.isalpha():  # one piece, of letters
                cut[u] = [(prefix + u).encode()]
            elif u[-1:] in (",", ".") and u[:-1].isalpha():
                cut[u] = [(prefix + u[:-1]).encode(), u[-1].encode()]
            else:
                cut[u] = [p.encode("utf-8", "surrogatepass") for p in self.pieces(prefix + u)]
        known = merge_pieces({p for ps in cut.values() for p in ps}, self.table)
        for u, ps in cut.items():
            memo[u] = known[ps[0]] if len(ps) == 1 else b"".join([known[p] for p in ps])

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_units:
            pieces = [[p.encode("utf-8", "surrogatepass") for p in self.pieces(t)] for t in texts]
            known = merge_pieces({p for ps in pieces for p in ps}, self.table)
            return [b"".join([known[p] for p in ps]) for ps in pieces]
        plain: list[list[str] | None] = []
        whole: list[list[str]] = []
        for t in texts:
            if self.twice(t):
                plain.append(None)
                whole.append(self.units(t))
            else:
                c = t.split(" ")
                plain.append(c)
                whole.append([c[0]] if c[0] else [])
        for memo in (self.bare, self.spaced):
            if len(memo) > MEMO:
                memo.clear()
        missing: set[str] = set()
        for u in whole:
            missing.update(set(u).difference(self.bare))
        self.learn(missing, self.bare, "")
        spaced_missing: set[str] = set()
        for c in plain:
            if c is not None and len(c) > 1:
                spaced_missing.update(set(c[1:]).difference(self.spaced))
        self.learn(spaced_missing, self.spaced, " ")
        out = []
        for c, u in zip(plain, whole):
            ids = b"".join(map(self.bare.__getitem__, u))
            if c is not None and len(c) > 1:
                ids += b"".join(map(self.spaced.__getitem__, c[1:]))
            out.append(ids)
        for memo, new in ((self.bare, missing), (self.spaced, spaced_missing)):
            for u in new:
                if len(u) > MEMO_LEN:
                    del memo[u]
        return out

    def forget(self) -> None:
        """Drops the memos and keeps the tables: what the next task reads is another part of the texts."""
        for memo in (self.bare, self.spaced, self.table.memo):
            memo.clear()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(ranks_path: str, pattern: str) -> Encoder:
    return Encoder(ranks_path, pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None, decoded_sha256: str | None = None, keep_text: bool = False) -> DataFrame:
    """Replaces ``text`` by ``ids`` (binary, little-endian 32-bit), and by what these decode to if ``decoded`` is given.

    ``decoded_sha256`` names a column for the digest of the decoded bytes, which then needn't travel.
    """
    kept = [f for f in docs.schema.fields if f.name not in (ids, decoded, decoded_sha256) and (keep_text or f.name != text)]
    names = [f.name for f in kept]
    added = [T.StructField(n, T.BinaryType()) for n in (ids, decoded) if n]
    if decoded_sha256:
        added.append(T.StructField(decoded_sha256, T.StringType()))
    source = docs.select(*[docs[n] for n in names], docs[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, pattern)
        for batch in batches:
            a = 0
            for part in slices(batch.column(len(names))):
                coded = enc.encode([t or "" for t in part.to_pylist()])
                columns = [batch.column(i).slice(a, len(part)) for i in range(len(names))] + [pa.array(coded, pa.binary())]
                a += len(part)
                if decoded:
                    columns.append(pa.array([enc.decode(x) for x in coded], pa.binary()))
                if decoded_sha256:
                    columns.append(pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in coded], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, *[f.name for f in added]])
        enc.forget()

    return in_arrow(source, run, T.StructType([*kept, *added]))


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Appends the bytes that the ids stand for; null ids decode to no bytes."""
    kept = [f for f in df.schema.fields if f.name != decoded]
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = load_ranks(ranks_path).bytes_of
        for batch in batches:
            out = [b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(out, pa.binary())], names=[*names, decoded])

    return in_arrow(df.select(*names), run, T.StructType([*kept, T.StructField(decoded, T.BinaryType())]))
