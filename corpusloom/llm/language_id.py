"""Language identification: averaged hashed subword embeddings below a linear softmax, with calibrated rejection.

A text is the mean of the embeddings of its words' subwords (runs of 2 to 5 UTF-8 bytes of ``<word>``, hashed
into ``buckets``).  Embeddings and softmax are fitted together by stochastic gradient descent in numpy, on all rows
given for fitting but a fourth.  Rows are dealt to runs by a hash; each run takes ``max_rows`` rows or up to twice as
many, where it lies, and the model is the mean of the runs' logits (parallel gradient descent by averaging).  The
fourth that is set aside, by hash too, fits the temperature and the rejection cut, the score below which ``reject`` of
its rightly recognised rows lie; losses and scores are counted where the texts lie.  Fewer than 1 / ``reject`` such
rows can't tell that share: the cut is then the lowest of their scores.  No row is left out.
As embedding and softmax are linear, a word's share of the logits is a row that each worker remembers.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and rejected; with nothing to learn
from every row is; an empty table gives no rows; repeated rows are judged alike; whole texts are read however
long; other columns pass through unless they carry the name of an output; equal scores go to the first language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import crc_of_id, in_arrow, of_text, release, slices

UND = "und"
#: ASCII letters in lower case and all other bytes of UTF-8; the rest of ASCII parts words.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
LETTER = re.compile(r"[^\W\d_]")
SIZES = (2, 3, 4, 5)
#: Words that a worker remembers, and the longest of them in bytes.
MEMO, MEMO_LEN = 100_000, 64
#: Scores are counted by the logarithm of their odds, in steps of 1 / ODDS.
ODDS = 100
#: Cells by hash that rows to learn from are dealt into; a run takes neighbouring cells.
CELLS = 4096
#: Runs' logits are summed as integers, so their order makes no difference; by blocks of as many buckets.
FIXED, BLOCK = 1 << 20, 1024
#: Temperatures that are tried.
GRID = np.geomspace(0.05, 5, 41)
#: Has a word, as words_of finds it.
WORDED = r"[A-Za-z\x{80}-\x{10FFFF}]"
OUT = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(LETTERS).split()


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of all words, and where each word's begin (each word has at least two)."""
    data = np.frombuffer(b"".join(b"<%b>" % w for w in words), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    end = np.cumsum(size)
    left = np.repeat(end, size) - np.arange(len(data))  # bytes up to the word's end
    found, owner = [], []
    word = np.repeat(np.arange(len(words)), size)
    h = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(SIZES) + 1):
            h = h[: len(data) - n + 1] * np.uint64(0x100000001B3) + data[n - 1 :] + np.uint64(1)
            if n in SIZES:
                ok = left[: len(h)] >= n
                x = (h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
                found.append(((x >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64))
                owner.append(word[: len(h)][ok])
    found, owner = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(words)))


@dataclass
class Model:
    langs: list[str]
    #: By bucket and language: the embedding times the softmax weights.
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    cut: float = 0.0


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def learn(rows: Iterable[tuple[str, np.ndarray, np.ndarray]], n_rows: int, langs: list[str], buckets: int, dim: int, steps: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """One run of gradient descent over ``n_rows`` rows of (language, buckets, counts): logits by bucket, and bias.

    Rows are held only where they are too few for ``steps`` and are gone through several times.
    """
    rng = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(langs)}
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    top, bias = np.zeros((dim, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    epochs = min(100, max(1, round(steps / n_rows)))
    held = list(rows) if epochs > 1 else rows
    step, steps = 0, epochs * n_rows
    for _ in range(epochs):
        for lang, ids, n in (held[i] for i in rng.permutation(len(held))) if epochs > 1 else held:
            share = (n / n.sum()).astype(np.float32)
            x = share @ emb[ids]
            g = softmax(x @ top + bias)
            g[number[lang]] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = top @ g
            top -= lr * np.outer(x, g)
            bias -= lr * np.float32(0.1) * g
            # a subword's share of a text is small: its step is scaled up so that embeddings move at the pace of the softmax
            emb[ids] -= (lr * 20 * share)[:, None] * back
            step += 1
    return emb @ top, bias


def averaged_runs(used: DataFrame, sizes: dict[int, int], langs: list[str], buckets: int, dim: int, steps: int, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of the logits and biases of all runs; ``used`` has run, h (the order in a run), lang and text."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((buckets + 1, len(langs)), np.int64)

        def rows() -> Iterator[tuple[int, tuple[str, np.ndarray, np.ndarray]]]:
            for batch in batches:
                at = 0
                for part in slices(batch.column(2)):
                    for run, lang, text in zip(batch.column(0).slice(at).to_pylist(), batch.column(1).slice(at).to_pylist(), part.to_pylist()):
                        yield run, (lang, *np.unique(subwords(words_of(text), buckets)[0], return_counts=True))
                    at += len(part)

        any_run = False
        for run, own in groupby(rows(), key=lambda r: r[0]):
            logits, bias = learn((r for _, r in own), sizes[run], langs, buckets, dim, steps, rate, seed)
            total += np.rint(np.vstack((logits, bias)).astype(np.float64) * FIXED).astype(np.int64)
            any_run = True
        if any_run:
            for i in range(0, len(total), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total[i : i + BLOCK].tobytes()], pa.binary())], names=["block", "total"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(np.frombuffer(x.as_py(), np.int64) for batch in batches for x in batch.column(1))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "total"])

    dealt = used.repartition(len(sizes), "run").sortWithinPartitions("run", "h").select("run", "lang", "text")
    found = in_arrow(dealt, train, "block int, total binary").groupBy("block").applyInArrow(add, "block int, total binary").collect()
    total = np.concatenate([np.frombuffer(r.total, np.int64).reshape(-1, len(langs)) for r in sorted(found)]) / (FIXED * len(sizes))
    return total[:-1], total[-1]


def calibrate(aside: DataFrame, model: Model, reject: float) -> None:
    """Sets the temperature of the least loss on ``aside``, and the score below which ``reject`` of its rightly recognised rows lie.

    Losses are summed as integers; scores are counted for all temperatures at once, so the texts are read once.
    """
    held, number = aside.sparkSession.sparkContext.broadcast(model), {x: i for i, x in enumerate(model.langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor, losses, counts = Predictor(held.value), np.zeros(len(GRID), np.int64), Counter()
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                langs = batch.column(0).slice(at, len(part)).to_pylist()
                at += len(part)
                found = [(z, number[lang]) for z, lang in zip(predictor.logits(part.to_pylist()), langs) if z is not None]
                if not found:
                    continue
                z, y = np.array([z for z, _ in found]), np.array([y for _, y in found])
                right = z.argmax(axis=1) == y
                for i, t in enumerate(GRID):
                    p = softmax(z / t)
                    losses[i] += np.rint(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)) * FIXED).astype(np.int64).sum()
                    best = np.minimum(1.0, p[right].max(axis=1))
                    odds = np.log(best / np.maximum(1 - best, 1e-15))
                    counts.update((i, b) for b in np.floor(odds * ODDS).astype(int).tolist())
        rows = [(i, None, n) for i, n in enumerate(losses.tolist())] + [(i, b, n) for (i, b), n in counts.items()]
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["t", "b", "n"])

    found = in_arrow(aside.select("lang", "text"), run, "t long, b long, n long").groupBy("t", "b").agg(F.sum("n").alias("n")).collect()
    losses = {r.t: r.n for r in found if r.b is None}
    if not losses:
        return
    best = min(losses, key=lambda t: (losses[t], t))
    model.temperature = float(GRID[best])
    scores = sorted((r.b, r.n) for r in found if r.t == best and r.b is not None)
    left = int(sum(n for _, n in scores) * reject)
    for b, n in scores:
        if n > left:
            model.cut = float(1 / (1 + np.exp(-b / ODDS)))
            break
        left -= n


def fit(docs: DataFrame, max_rows: int = 15_000, buckets: int = 1 << 15, dim: int = 8, steps: int = 15_000, rate: float = 0.5, reject: float = 0.001, seed: int = 7) -> Model:
    """``docs`` has text and lang; rows with either null, or without a word, teach nothing, all others do."""
    h = F.xxhash64("doc_id", "text")
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(WORDED)).select(h.alias("h"), "lang", "text")
    cell, fourth = F.pmod(F.shiftright("h", 2), F.lit(CELLS)), F.pmod("h", F.lit(4))
    counted = rows.groupBy("lang", cell.alias("cell"), fourth.alias("fourth")).agg(F.count(F.lit(1)).alias("n")).collect()
    langs = sorted({r.lang for r in counted})
    if not langs:
        return Model([], np.zeros((buckets, 0), np.float32), np.zeros(0))
    apart = sum(r.n for r in counted) >= 40 and len({r.fourth == 0 for r in counted}) == 2
    n_used = sum(r.n for r in counted if not apart or r.fourth)
    runs = min(CELLS, max(1, n_used // max_rows))
    sizes: dict[int, int] = {}
    for r in counted:
        if not apart or r.fourth:
            k = r.cell * runs // CELLS
            sizes[k] = sizes.get(k, 0) + r.n
    used = rows.where(fourth > 0) if apart else rows
    used = used.select(F.floor(cell * runs / CELLS).cast("int").alias("run"), "h", "lang", "text")
    logits, bias = averaged_runs(used, sizes, langs, buckets, dim, steps, rate, seed)
    model = Model(langs, logits.astype(np.float32), bias)
    calibrate(rows.where(fourth == 0) if apart else rows, model, reject)
    release()
    return model


class Predictor:
    def __init__(self, model: Model):
        self.model = model
        #: A word's place in ``rows``: sums of its subwords' logits, then how many they are.  Only words of at most
        #: MEMO_LEN bytes have one.
        self.place: dict[bytes, int] = {}
        self.rows = np.zeros((0, len(model.langs) + 1))

    def sums(self, words: list[bytes]) -> np.ndarray:
        out = [np.zeros((0, self.rows.shape[1]))]
        start = size = 0
        for i, w in enumerate([*words, None]):
            # some 100,000 bytes of words at once; a longer word is a part by itself
            if w is None or (size and size + len(w) > 100_000):
                part = words[start:i]
                if part:
                    ids, starts = subwords(part, len(self.model.logits))
                    total = np.add.reduceat(self.model.logits[ids], starts, axis=0, dtype=np.float64)
                    out.append(np.column_stack((total, np.diff(np.append(starts, len(ids))))))
                start, size = i, 0
            size += len(w or b"")
        return np.concatenate(out)

    def logits(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """A text's logits before the temperature; None without a letter."""
        if len(self.place) > MEMO:
            self.place, self.rows = {}, self.rows[:0].copy()
        words = [words_of(t) if t and LETTER.search(t) else [] for t in texts]
        missing: set[bytes] = set()
        for w in words:
            missing.update(set(w).difference(self.place))
        new = sorted(missing, key=len)
        n_short, n_held = sum(len(w) <= MEMO_LEN for w in new), len(self.rows)
        rows = np.concatenate((self.rows, self.sums(new))) if new else self.rows
        self.place.update((w, n_held + i) for i, w in enumerate(new))
        self.rows = rows[: n_held + n_short]
        found: list[np.ndarray | None] = []
        for w in words:
            if not w:
                found.append(None)
                continue
            total = rows[np.fromiter(map(self.place.__getitem__, w), np.int64, len(w))].sum(axis=0)
            found.append(total[:-1] / total[-1] + self.model.bias)
        # long words aren't kept
        for w in new[n_short:]:
            del self.place[w]
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        m = self.model
        if not m.langs:
            return [UND] * len(texts), [0.0] * len(texts), [False] * len(texts)
        langs, scores, accepted = [], [], []
        for z in self.logits(texts):
            if z is None:
                langs.append(UND), scores.append(0.0), accepted.append(False)
                continue
            p = softmax(z / m.temperature)
            best = int(p.argmax())
            langs.append(m.langs[best]), scores.append(float(min(1.0, p[best]))), accepted.append(bool(p[best] >= m.cut))
        return langs, scores, accepted


def recognised(docs: DataFrame, model: Model):
    """The column function from a text to lang_pred, score and accepted."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return of_text(T.StructType(OUT), lambda: Predictor(held.value).predict)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Appends lang_pred, score and accepted; only ``text`` is read."""
    new = [o.name for o in OUT]
    kept = [c for c in docs.columns if c not in new]
    found = docs.select(*kept, recognised(docs, model)("text").alias("__recognised"))
    return found.select(*kept, *[F.col("__recognised")[c].alias(c) for c in new])


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with the columns they came with whatever their names."""
    found = docs.withColumn("__recognised", recognised(docs, model)("text"))
    return found.where(F.col("__recognised")["accepted"]).drop("__recognised")


def held_out():
    return crc_of_id() % 4 == 2


def predictions(docs: DataFrame) -> DataFrame:
    """Fits on the rows that aren't held out, then predicts every row from its text alone."""
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
