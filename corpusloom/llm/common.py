"""What the operators of this subpackage share: the shared folder, staged tables, words, memos."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Turns ASCII white space into blanks and leaves the rest.
PLAIN = bytes(32 if c == 32 or 9 <= c <= 13 else c for c in range(256))
#: The same, with A-Z in lower case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in PLAIN)
#: Lower-cases A-Z and turns every ASCII byte that is neither digit nor letter into a space.
ITEM_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table; texts that would be scanned by fewer tasks than there are cores are dealt to as many.

    A large table has tasks enough and stays as it is.
    """
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    if table not in ("documents", "pages"):
        return df
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own one only where that is unset.

    An own one is a local folder, which executors on other machines can't see, so only a local master gets it.
    """
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corpusloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


#: Paths of this driver that are still there, in the order in which they were made.
LIVE: dict[str, None] = {}


def scratch(spark: SparkSession, what: str) -> str:
    """A new path below the shared folder; removed when the driver ends, or earlier by discard()."""
    path = f"{shared_dir(spark)}/corpusloom/{what}-{uuid.uuid4().hex}"
    LIVE[path] = None
    atexit.register(discard, spark, path)
    return path


def discard(spark: SparkSession, path: str) -> None:
    if path not in LIVE:
        return
    with contextlib.suppress(Exception):
        jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        del LIVE[path]


def discard_since(spark: SparkSession, before: set[str], but: str) -> None:
    """Removes what was written since ``before`` was the set of live paths, but for one path."""
    for path in [p for p in LIVE if p not in before and p != but]:
        discard(spark, path)


#: Whether the shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Within it, a query's shuffle files are removed as soon as it ends."""
    held = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if held is None else spark.conf.set(SHUFFLES_GO, held)


class Staged:
    """A DataFrame written once as Parquet into the shared folder, so lost executors cost no recomputation.

    What was shuffled on its way is removed, as nothing reads it again.
    """

    def __init__(self, df: DataFrame, what: str, codec: str = "snappy"):
        self.spark, self.path = df.sparkSession, scratch(df.sparkSession, what)
        with shuffles_go(self.spark):
            df.write.parquet(self.path, compression=codec)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        discard(self.spark, self.path)


def crc_of_id(col: str = "doc_id"):
    """crc32 of the id's decimal digits; the folds of the learning operators are remainders of it."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")))


def bounded_sample(df: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """About ``limit`` rows, at most twice as many, chosen by a hash of the id: a documented bound for fitting a classifier.

    Only ids travel to find the cut, and the rows stay where they are.  Where repeated ids make the choice more than
    twice as many rows, rows are chosen by a hash of all their columns; of those that share the last hash, which are
    equal, as many as the bound leaves room for.
    """

    def cut_at(h: Column) -> int | None:
        return df.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]

    h = F.xxhash64(F.col(key))
    cut = cut_at(h)
    if cut is None:
        return df.where(F.lit(False))
    chosen = df.where(h <= F.lit(cut))
    if chosen.count() <= 2 * limit:
        return chosen
    h = F.xxhash64(*df.columns)
    cut = cut_at(h)
    return df.where(h < F.lit(cut)).unionByName(df.where(h == F.lit(cut)).limit(limit))


#: Rows of a side that is broadcast; more are joined by shuffle.
FEW_ROWS = 2_000_000


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """Counts a side and marks it for a broadcast if it is small enough; then the other side isn't shuffled."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


#: Bits of a value that one pass over a table settles, and values that are looked at one by one.
STEP, FEW_VALUES = 12, 50_000


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list]:
    """By column, the values at these places (from 0) of its ascending order: exact, and no row is sorted or moved.

    Columns are doubles or longs that are neither null nor negative, so their bits are ordered like the values.  A pass
    counts the next bits of the values that may still be looked for, until these are few.
    """
    names, size = list(ranks), df.count()
    kinds = [df.schema[c].dataType for c in names]
    # by column and rank: the bits known and the rank among values with these bits
    at = {(i, k): (0, k) for i, c in enumerate(names) for k in ranks[c]}
    left, sizes = 64, {(i, 0): size for i in range(len(names))}
    df = df.select(*names)

    def bits(batch: pa.RecordBatch, i: int) -> np.ndarray:
        return batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64)

    def matching(b: np.ndarray, wanted: list[int], left: int) -> np.ndarray:
        return b if left == 64 else b[np.isin(b >> np.uint64(left), np.array(wanted, np.uint64))]

    def pass_over(wanted: dict[int, list[int]], left: int, shift: int) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int], int] = {}
            for batch in batches:
                for i, prefixes in wanted.items():
                    for b, n in zip(*map(np.ndarray.tolist, np.unique(matching(bits(batch, i), prefixes, left) >> np.uint64(shift), return_counts=True))):
                        found[i, b] = found.get((i, b), 0) + n
            columns = [[i for i, _ in found], [b for _, b in found], list(found.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["i", "b", "n"])

        return in_arrow(df, run, "i long, b long, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).collect()

    while left:
        wanted: dict[int, list[int]] = {}
        for (i, _), (b, _) in at.items():
            wanted.setdefault(i, []).append(b)
        few = sum(sizes[i, b] for i, prefixes in wanted.items() for b in set(prefixes)) <= FEW_VALUES
        shift = 0 if few else max(0, left - STEP)
        counts: dict[tuple[int, int], list] = {}
        for r in sorted(tuple(r) for r in pass_over(wanted, left, shift)):
            sizes[r[0], r[1]] = r[2]
            counts.setdefault((r[0], r[1] >> (left - shift) if left < 64 else 0), []).append(r[1:])
        for (i, k), (b, rank) in at.items():
            for deeper, n in counts[i, b]:
                if rank < n:
                    break
                rank -= n
            at[i, k] = (deeper, rank)
        left = shift
    value = lambda i, b: np.array([b], np.uint64).view(np.float64 if isinstance(kinds[i], T.DoubleType) else np.int64)[0].item()
    return {c: [value(i, at[i, k][0]) for k in ranks[c]] for i, c in enumerate(names)}


def slices(texts: pa.Array, most_bytes: int = 1_000_000) -> Iterator[pa.Array]:
    """Consecutive parts whose texts sum to about ``most_bytes``: bounds what a worker turns into strings at once."""
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    start = 0
    while start < len(texts):
        done = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, done + most_bytes, "right")))
        yield texts.slice(start, end - start)
        start = end


#: What a batch of rows that travels to a worker may hold.
BATCH = {"spark.sql.execution.arrow.maxBytesPerBatch": 4_000_000, "spark.sql.execution.arrow.maxRecordsPerBatch": 2_000}


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH where they are larger.

    By default a batch is 10,000 rows, so long texts make batches of 64 MB, held several times over by each task on either
    side.
    """
    for name, most in BATCH.items():
        held = re.sub(r"\D", "", spark.conf.get(name))
        if not held or not 0 < int(held) <= most:
            spark.conf.set(name, most)


def release() -> None:
    """Gives freed memory back to the system: workers and the driver live on while other stages need the room."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def release_driver(spark: SparkSession) -> str | None:
    """The same for the driver's JVM: collects its garbage, and with it broadcasts, and trims its native heap.

    Hundreds of small queries leave it several hundred MB that it has freed but not given back.  Returns the JVM's
    report; one without that diagnostic command only collects.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    jvm.System.gc()
    with contextlib.suppress(Exception):
        # the server's own class isn't open to reflection, so it is called by its interface
        named, kinds, args = jvm.java.lang.Class.forName, gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = named(kind)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke = named("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        return invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    return None


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers keep nothing when a task is done."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    small_batches(df.sparkSession)
    return df.mapInArrow(tidy, schema)


def of_text(kind: T.StructType, begin: Callable[[], Callable[[list[str | None]], list]], most_bytes: int = 1_000_000) -> Callable[[Column], Column]:
    """A column of structs made from a column of texts.

    Only the texts travel to Python and only the structs come back; the other columns stay in the JVM.  ``begin`` is
    called once a task and gives a function from texts, some ``most_bytes`` of them, to the struct's columns.  It is marked nondeterministic so that
    a filter and a projection of its result share one evaluation.
    """
    names = kind.names
    kinds = [_arrow_type(f.dataType) for f in kind.fields]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        judge = begin()
        for batch in batches:
            parts = [judge(part.to_pylist()) for part in slices(batch, most_bytes)]
            columns = [pa.chunked_array([pa.array(p[i], k) for p in parts], k).combine_chunks() for i, k in enumerate(kinds)]
            yield pa.StructArray.from_arrays(columns, names=names)
            del parts, columns, batch
        del judge
        release()

    if spark := SparkSession.getActiveSession():
        small_batches(spark)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


#: Bytes that are hashed at once; words of as many bytes or more are hashed one by one.
BLOCK = 1 << 18
_ODD = 0x9E3779B97F4A7C13
_VALUES = np.random.default_rng(97).integers(0, 2**64, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of an odd number and of its inverse, modulo 2^64; they are kept."""
    if _powers and len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size = max(4096, 1 << (n - 1).bit_length())
    made = []
    for base in (_ODD, pow(_ODD, -1, 2**64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        made.append(np.multiply.accumulate(x))
    _powers[:] = made
    return made[0], made[1]


def word_hashes(data: bytes, table: bytes, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of ``data``, and where each begins; ``table`` maps bytes, and those between words to a blank.

    All words are hashed side by side: a word's hash is the sum of its bytes' random values times powers of an odd number
    by place, a difference of running sums, brought to a common beginning and mixed.
    """
    found, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    data = data.translate(table)
    while at < len(data):
        end = len(data)
        if end - at >= most:
            end = data.rfind(b" ", at, at + most) + 1
            if not end:
                end = data.find(b" ", at + most)
                end = len(data) if end < 0 else end
                found.append(np.array([xxhash.xxh64_intdigest(data[at:end])], np.uint64))
                starts.append(np.array([at]))
                at = end
                continue
        raw = np.frombuffer(data, np.uint8, end - at, at)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], raw == 32, [True])).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        if len(first):
            up, down = powers(end - at)
            with np.errstate(over="ignore"):
                sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_VALUES[raw] * up[: len(raw)], dtype=np.uint64)))
                found.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
            starts.append(first + at)
        at = end
    return np.concatenate(found), np.concatenate(starts)


def words_of_texts(texts: list[str | None], table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' words in a row, and how many each text has."""
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begin = np.cumsum([0, *[len(c) + 1 for c in coded]])
    h, starts = word_hashes(b"\n".join(coded), table)
    return h, np.diff(np.searchsorted(starts, begin))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64 bits (splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words, from word hashes; order matters."""
    if len(h) < n:
        return h[:0]
    with np.errstate(over="ignore"):
        out = mix(h[: len(h) - n + 1] + np.uint64(n))
        for k in range(1, n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def crc(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

