"""Quality rules: rule statistics of a text, then an isolation forest on them.

Each tree of the forest splits rows of its own, drawn from all labelled good rows, at random values of random
statistics; texts that few splits set apart have short paths and are anomalous.  Ranges, spreads and the cut on the
anomaly score are those of all labelled rows: at most ``false_rejects`` of the rows labelled good may be rejected, and
within that as many labelled bad as can be.

Defined cases: null text has no words, so the base rule rejects it, as it does empty text; with no labelled rows, or
none of either label, the forest rejects nothing; rows with a null label teach nothing; labels that disagree for an
id all count; empty tables give no rows; repeated rows are judged alike; whole texts are read; other columns pass
through unless they carry the name of an output.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import PLAIN, Staged, broadcast_if_few, gram_hashes, in_arrow, of_text, order_statistics, release, word_hashes

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks")
#: The statistics that the forest reads: names, and pairs of counts whose ratio they are.
RATIOS = {
    "word_length": ("word_chars", "n_words"),
    "symbols": ("n_symbols", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "upper": ("n_upper", "word_chars"),
    "digits": ("n_digits", "word_chars"),
    "marks": ("n_marks", "n_words"),
}
#: The quantiles whose distance is a statistic's spread, and between them its middle.
SPREAD = (0.005, 0.5, 0.995)


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts named by COUNTS."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = word_hashes(data, PLAIN)[0]
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)] if "\n" in text else [1] if n else []
    repeated = 0
    if n > 3:
        grams = gram_hashes(words, 3)
        ordered = np.sort(grams)
        if (ordered[1:] == ordered[:-1]).any():
            _, at, times = np.unique(grams, return_inverse=True, return_counts=True)
            again = times[at] > 1
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : k + len(again)] |= again
            repeated = int(covered.sum())
    return (
        n,
        len(text) - sum(text.count(c) for c in SPACES),
        sum(data.count(c) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(data) - len(data.translate(None, UPPER)),
        len(data) - len(data.translate(None, DIGITS)),
        data.count(b"!") + data.count(b"?"),
    )


def base_failed(n_words, n_repeat_words):
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def ratios(counts: np.ndarray) -> np.ndarray:
    at = {name: i for i, name in enumerate(COUNTS)}
    return np.column_stack([counts[:, at[a]] / np.maximum(1, counts[:, at[b]]) for a, b in RATIOS.values()])


def path_constant(n: float) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


@dataclass
class Forest:
    """Trees as arrays: node i of a tree goes to 2i+1 below its value, else to 2i+2; feature -1 is a leaf."""

    feature: np.ndarray
    value: np.ndarray
    length: np.ndarray
    constant: float
    middle: np.ndarray
    scale: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1); higher is more anomalous."""
        x = np.arcsinh((x - self.middle) / self.scale)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, value, length in zip(self.feature, self.value, self.length):
            node = np.zeros(len(x), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= value[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            total += length[node]
        return 2.0 ** (-total / len(self.feature) / max(self.constant, 1e-9))


def grow(x: np.ndarray, good: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """Isolates among rows labelled good; split values are drawn from the range of all rows.

    So a region that only bad rows reach is empty and its paths are short.  Statistics are measured in spreads of
    the good rows, on a scale that is logarithmic far out.
    """
    own = x[good] if good.any() else x
    return isolate(own, *np.quantile(own, SPREAD, axis=0), x.min(axis=0), x.max(axis=0), trees, sample, seed)


def isolate(own: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
    """Grows trees among ``own``: each takes ``sample`` rows of its own where there are as many, else chooses among all."""
    rng = np.random.default_rng(seed)
    scale = np.maximum(high - low, 0.01) / 2
    own, least, most = (np.arcsinh((v - middle) / scale) for v in (own, least, most))
    dealt = len(own) >= trees * sample
    sample = min(sample, len(own))
    depth = max(1, math.ceil(math.log2(max(2, sample))))
    size = 2 ** (depth + 1) - 1
    feature, value, length = np.full((trees, size), -1), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        rows = own[t * sample : (t + 1) * sample] if dealt else own[rng.choice(len(own), sample, replace=False)]
        work = [(0, 0, rows, least, most)]
        while work:
            node, level, rows, low, high = work.pop()
            wide = np.flatnonzero(high > low)
            if level == depth or len(rows) < 2 or not len(wide):
                length[t, node] = level + path_constant(len(rows))
                continue
            f = int(rng.choice(wide))
            v = rng.uniform(low[f], high[f])
            feature[t, node], value[t, node] = f, v
            below = rows[:, f] < v
            under, over = high.copy(), low.copy()
            under[f] = over[f] = v
            work += [(2 * node + 1, level + 1, rows[below], low, under), (2 * node + 2, level + 1, rows[~below], over, high)]
    return Forest(feature, value, length, path_constant(sample), middle, scale)


def measured(docs: DataFrame, forest: Forest | None = None):
    """The column function that counts a text and, if there is a forest, scores its anomaly."""
    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    if forest is not None:
        fields.append(T.StructField("anomaly", T.DoubleType()))
    held = None if forest is None else docs.sparkSession.sparkContext.broadcast(forest)

    def begin():
        def judge(texts: list[str | None]) -> list:
            counts = np.array([count_text(t) for t in texts], np.int64).reshape(len(texts), len(COUNTS))
            return [*counts.T, *([] if held is None else [held.value.score(ratios(counts))])]

        return judge

    return of_text(T.StructType(fields), begin)


def statistics(docs: DataFrame, forest: Forest | None = None, keep_text: bool = False) -> DataFrame:
    """``docs`` with the counts of COUNTS, and the forest's anomaly score if there is one; by default without its text."""
    new = [*COUNTS, *(["anomaly"] if forest is not None else [])]
    kept = [c for c in docs.columns if c not in new and (keep_text or c != "text")]
    found = docs.select(*kept, measured(docs, forest)("text").alias("__measured"))
    return found.select(*kept, *[F.col("__measured")[c].alias(c) for c in new])


@dataclass
class Model:
    forest: Forest | None
    cut: float


def quantiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], n: int) -> np.ndarray:
    """Exact quantiles of columns of ``n`` rows, by share and column; between two values on the line that joins them."""
    places = [q * (n - 1) for q in shares]
    ranks = sorted({int(f(p)) for p in places for f in (math.floor, math.ceil)})
    found = order_statistics(df, {c: ranks for c in columns})
    return np.array([[np.interp(p, ranks, found[c]) for c in columns] for p in places])


def pool(own: DataFrame, n: int, most: int) -> np.ndarray:
    """The statistics of ``most`` of ``n`` rows, those of the least hashes; all rows are in the draw."""
    h = F.shiftrightunsigned(F.xxhash64("doc_id", *RATIOS), 1)
    own = own.select(h.alias("h"), *RATIOS)
    if n > most:
        cut = F.lit(order_statistics(own, {"h": [most - 1]})["h"][0])
        # rows of the last hash are equal
        own = own.where(F.col("h") < cut).unionByName(own.where(F.col("h") == cut).limit(most))
    return np.array(sorted(tuple(r) for r in own.collect())[:most], float)[:, 1:]


def fit(docs: DataFrame, labels: DataFrame, trees: int = 100, sample: int = 512, false_rejects: float = 0.004, seed: int = 3) -> Model:
    """Grows the forest on, and calibrates the cut by, all labelled rows.

    Ranges, spreads and the cut are exact over all of them.  A tree isolates ``sample`` rows, as the method has it: those
    of all trees are drawn from all good rows by hash.
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") > 0).alias("good"))
    rows = docs.select("doc_id", "text").join(broadcast_if_few(known), "doc_id").select("doc_id", "good", "text")
    stats = statistics(rows).where(~base_failed(F.col("n_words"), F.col("n_repeat_words")))
    shares = [(F.col(a) / F.greatest(F.lit(1), F.col(b))).alias(name) for name, (a, b) in RATIOS.items()]
    table = Staged(stats.select("doc_id", "good", *shares), "statistics")
    try:
        sizes = {r.good: r.n for r in table.df.groupBy("good").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not sizes:
            return Model(None, 2.0)
        n = sizes.get(True) or sizes[False]
        own = table.df.where("good") if True in sizes else table.df
        ends = table.df.agg(*[F.min(c) for c in RATIOS], *[F.max(c) for c in RATIOS]).first()
        least, most = np.array(ends[: len(RATIOS)]), np.array(ends[len(RATIOS) :])
        forest = isolate(pool(own, n, trees * sample), *quantiles(own, list(RATIOS), SPREAD, n), least, most, trees, sample, seed)
        return Model(forest, 2.0 if len(sizes) < 2 else calibrated(table.df, forest, n, false_rejects))
    finally:
        table.drop()
        release()


def calibrated(table: DataFrame, forest: Forest, n_good: int, false_rejects: float) -> float:
    """The cut: a bound that ``false_rejects`` of all good rows exceed, moved up to the bad rows beyond it."""
    held = table.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(held.value.score(x), pa.float64())], names=["good", "anomaly"])

    scored = Staged(in_arrow(table.select("good", *RATIOS), run, "good boolean, anomaly double"), "anomalies")
    bound = order_statistics(scored.df.where("good").select("anomaly"), {"anomaly": [n_good - 1 - int(n_good * false_rejects)]})["anomaly"][0]
    bad = scored.df.where(~F.col("good") & (F.col("anomaly") > F.lit(bound))).select("anomaly")
    n = bad.count()
    # what the bound rejects of the bad, but for a two-hundredth, is rejected with as few good rows as can be
    cut = order_statistics(bad, {"anomaly": [n // 200]})["anomaly"][0] if n else 2.0
    scored.drop()
    return cut


def judge(docs: DataFrame, model: Model, keep_text: bool = True) -> DataFrame:
    """``docs`` with the counts, anomaly, base_failed and kept."""
    df = statistics(docs.drop("anomaly", "base_failed", "kept"), model.forest, keep_text)
    if model.forest is None:
        df = df.withColumn("anomaly", F.lit(0.0))
    df = df.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < F.lit(model.cut)))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns they came with whatever their names."""
    found = docs.withColumn("__measured", measured(docs, model.forest)("text"))
    m = F.col("__measured")
    keep = ~base_failed(m["n_words"], m["n_repeat_words"])
    if model.forest is not None:
        keep &= m["anomaly"] < F.lit(model.cut)
    return found.where(keep).drop("__measured")


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    judged = judge(docs.select("doc_id", "text"), fit(docs, labels), keep_text=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
