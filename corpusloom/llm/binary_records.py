"""Length-delimited binary records with masked checksums, and a separate offset index for shuffled reads.

A record is: payload length (unsigned 64-bit), masked checksum of those eight bytes, payload, masked checksum of
the payload, and a closing newline; numbers are little-endian, a masked checksum is crc32 rotated right by
15 bits plus a constant.  A sequence's payload is: flags (one byte: 1 = ids take four bytes, 2 = the id is null),
its id (signed 64-bit), then token ids of two or four bytes.

Files are written by Spark's text sink, whose line end is the closing newline, so any store that Spark can
write will do, the commit protocol covers lost executors, and no task touches a local folder.  Rows are dealt
by range of the id and sorted, so the files, in the order of their numbers, hold the ids in ascending order.
The index is a Parquet table (file, offset, length, id, tokens): a shuffled reader needs only its rows.

Defined cases: null text is encoded as empty (the end id alone); null ids come first; repeated ids stand
beside each other, ordered by the text's first 64 characters, then its hash; an empty table gives no records; other columns are not written; a very
long text is one record, whose size a file's number of records allows for.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import crc, in_arrow, scratch, slices

#: Fixed values of the framing.
MASK, HEAD, WIDE, NULL_ID = 0xA282EAD8, struct.Struct("<QI"), 1, 2
ENTRY = struct.Struct("<Bq")
#: Records that a file has at most, and bytes that it never exceeds unless a single record does (Spark reads 2 GB at once).
RECORDS, FILE_BYTES = 8192, 2_000_000_000
#: Words that a worker remembers; longer ones than the second figure are never kept.
MEMO, MEMO_LEN = 700_000, 64
#: Fixed value: the splitter that drops white space.
SPLITTER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs whose run behind letters the splitter sets apart as one; the apostrophe has rules of its own.
SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def masked(data: bytes) -> int:
    c = crc(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """The record without its closing newline."""
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def frames(data: bytes) -> Iterator[tuple[int, int, memoryview]]:
    """(offset, length with the closing newline, payload) of each record; raises on any damage."""
    view, at = memoryview(data), 0
    while at < len(data):
        if at + HEAD.size > len(data):
            raise ValueError(f"record at {at} is cut off")
        n, check = HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"length at {at} is damaged")
        body = at + HEAD.size
        if body + n + 5 > len(data) or data[body + n + 4] != 10:
            raise ValueError(f"record at {at} is cut off")
        payload = view[body : body + n]
        if masked(payload) != struct.unpack_from("<I", data, body + n)[0]:
            raise ValueError(f"record at {at} is damaged")
        yield at, n + HEAD.size + 5, payload
        at = body + n + 5


def pack(key: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    head = ENTRY.pack(wide * WIDE | (key is None) * NULL_ID, key or 0)
    return head + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload) -> tuple[int | None, np.ndarray]:
    flags, key = ENTRY.unpack_from(payload)
    ids = np.frombuffer(payload, "<u4" if flags & WIDE else "<u2", offset=ENTRY.size).astype("<u4")
    return (None if flags & NULL_ID else key), ids


class WordEncoder:
    """The tokenizers library behind a bounded memo.

    Where the file says that its splitter drops white space and sets signs apart, the ids of a text are those of its
    parts between spaces, which are remembered; any other file's tokenizer gets whole texts.  Where lower-casing is the
    library's own (Latin-1 texts) parts are remembered in lower case; letters and the signs behind them are remembered
    apart.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        normal, split = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
        steps = [n["type"] for n in normal.get("normalizers", [])]
        cuts = [(p.get("pattern"), p.get("behavior"), p.get("invert")) for p in split.get("pretokenizers", [])]
        self.by_parts = steps == ["NFC", "Replace", "Lowercase"] and cuts[:1] == [({"Regex": SPLITTER}, "Removed", True)]

    def ids_of(self, parts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in coded]

    def learn(self, missing: set[str]) -> None:
        memo, base = self.memo, {}
        for p in missing:
            word = p.rstrip(SIGNS)
            if 0 < len(word) < len(p) and word.isalpha() and word.lower().isalpha():
                base[p] = (word, p[len(word) :])
        new = list({q for p in missing for q in base.get(p, (p,)) if q not in memo})
        memo.update(zip(new, self.ids_of(new)))
        memo.update((p, memo[a] + memo[b]) for p, (a, b) in base.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_parts:
            return self.ids_of(texts)
        if len(self.memo) > MEMO:
            self.memo.clear()
        parts = []
        for t in texts:
            try:
                t.encode("latin-1")
                t = t.lower()
            except UnicodeEncodeError:
                pass
            parts.append([p for p in t.replace("\n", " ").split(" ") if p])
        missing: set[str] = set()
        for p in parts:
            missing.update(set(p).difference(self.memo))
        self.learn(missing)
        out = [b"".join(map(self.memo.__getitem__, p)) for p in parts]
        for p in missing:
            if len(p) > MEMO_LEN:
                del self.memo[p]
        return out


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def records_a_file(sizes: DataFrame, most_bytes: int = FILE_BYTES) -> int:
    """How many records a file may have so that no choice of as many exceeds ``most_bytes``; sizes: b (power of two), n.

    A record has at most four bytes for each byte of its text, and its end id, head and frame.
    """
    found, room = 0, most_bytes
    for b, n in sorted(((r["b"], r["n"]) for r in sizes.collect()), reverse=True):
        each = 4 * 2 ** (b + 1) + 64
        fits = min(n, room // each)
        found, room = found + fits, room - fits * each
        if fits < n:
            break
    return max(1, found)


def write_records(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes every text, closes it with ``end_id`` and writes record files in ascending order of ``key``.

    Ranges are of the key, then of the text's beginning and hash, then of chance, so rows that share a key, or are repeated whole,
    needn't share a task.  A file has at most RECORDS records, and fewer where their texts are so long that these could
    exceed FILE_BYTES; a single longer record is a file by itself.
    """
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    size = F.octet_length("t")
    bits = F.when(size > 0, F.floor(F.log2(size.cast("double")))).otherwise(0).cast("int")
    sizes = rows.groupBy(bits.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most = min(RECORDS, records_a_file(sizes))
    ties = F.struct(F.substring("t", 1, 64), F.xxhash64("t")).alias("h")
    rows = rows.select("k", "t", ties).repartitionByRange("k", "h", F.rand(5)).sortWithinPartitions(F.col("k").asc_nulls_first(), "h")
    end = np.uint32(end_id).astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = word_encoder(tokenizer_path)
        for batch in batches:
            keys, a = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1), 8_000_000):
                coded = enc.encode(part.to_pylist())
                out = [frame(pack(k, np.frombuffer(c + end, "<u4"))) for k, c in zip(keys[a : a + len(part)], coded)]
                a += len(part)
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    framed = in_arrow(rows.select("k", "t"), run, "value binary")
    framed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", most).text(path, lineSep="\n")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """One row a record, checked against its checksums: file, offset, length, key, ids (binary), before (ids of the file before it)."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                before, rows = 0, []
                for offset, length, payload in frames(data):
                    key, ids = unpack(payload)
                    rows.append((name, offset, length, key, ids.tobytes(), before))
                    before += len(ids)
                    if len(rows) == 2000:
                        yield as_batch(rows)
                        rows = []
                if rows:
                    yield as_batch(rows)

    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
    names = ("file", "offset", "length", "key", "ids", "before")

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=list(names))

    return in_arrow(files, run, "file string, offset long, length long, key long, ids binary, before long")


def write_index(spark: SparkSession, records: str, index: str) -> None:
    """The offset index: where each record stands, its key, tokens, crc, and the tokens before it in its file."""
    rows = scan_records(spark, records)
    rows.select(
        "file", "offset", "length", "key", "before",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").cast("long").alias("ids_crc32"),
    ).write.parquet(index)


def read_index(spark: SparkSession, index: str) -> DataFrame:
    """The index with ``start``: the tokens before a record over all files, in the order in which they were written.

    Only one row a file meets in the running sum.
    """
    rows = spark.read.parquet(index)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    # the writer's names hold the number of the range, and of the file in it
    number = lambda p: F.regexp_extract("file", p, 1).cast("long")
    order = Window.orderBy(number("part-([0-9]+)"), number("-c([0-9]+)[^/]*$"), "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("at"))
    return rows.join(starts, "file").withColumn("start", (F.col("at") + F.col("before")).cast("long")).drop("at", "before")


def read_at(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """Shuffled read: the ids of the wanted index rows; only files that hold some are opened, once each, and cut at the offsets.

    A file is the unit that a store hands out, so files are small (RECORDS); the wanted places of a file are at most its
    records, and one name a wanted file travels to the driver.
    """
    spark = index.sparkSession
    places = wanted.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("at"))
    names = [r[0] for r in places.select("file").collect()]
    if not names:
        return spark.createDataFrame([], "key long, ids binary")
    files = spark.read.format("binaryFile").load(names).select(F.col("path").alias("file"), "content").join(places, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = batch.column("content"), batch.column("at")
            for i in range(batch.num_rows):
                whole = data[i].as_py()
                got = [unpack(next(frames(whole[x["offset"] : x["offset"] + x["length"]]))[2]) for x in at[i].as_py()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in got], pa.int64()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=["key", "ids"]
                )

    return in_arrow(files.select("content", "at"), run, "key long, ids binary")


def token_records(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """Writes records and index into the shared folder, then returns what the files hold."""
    spark = docs.sparkSession
    records, index = scratch(spark, "records"), scratch(spark, "records-index")
    write_records(docs, records, tokenizer_path, end_id)
    write_index(spark, records, index)
    return read_index(spark, index).select(F.col("key").alias("doc_id"), "start", "n_tokens", "ids_crc32", "file", "offset", "length")
