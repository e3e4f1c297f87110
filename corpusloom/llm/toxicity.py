"""Toxicity scores that see through spelling tricks: a noisy channel restores words, then the restored text is scored.

Restoring: a suspicious token (digits or signs among letters, letters between separators, repeated letters, or a
run of single characters apart) opens a lattice of characters; Viterbi finds its likeliest path under the channel's
costs and a language model: words by their counts, other words by character trigrams.  In a run of
single characters a word may end after each of them, and a sign that may be dropped may part two words as well.
Tokens of any length are read.  A token that isn't suspicious has one path only and is kept.

Scoring: words and word beginnings whose document counts by label say "toxic" beyond chance carry log-likelihood
ratios; a text's strongest ratio and the logarithm of their sum enter a logistic regression.  Counts come from one part
of the labelled rows, the regression from the other; together they are all labelled rows, none is left out.  Words,
trigrams and features are counted on executors; the driver gets trigrams, words of at least LEAST_SHARE of all words
(rarer ones are spelled by trigrams, which they were counted for) and the features that are chosen.

Defined cases: null and empty texts, and any text when there is nothing to learn from, get the score of no
evidence; empty tables give no rows; repeated rows are scored alike; whole texts are read; other columns pass
through unless they carry the name of an output; labels that disagree for one id all count.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import Staged, broadcast_if_few, crc_of_id, in_arrow, of_text, release

#: What a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "li", "+": "t", "€": "e", "(": "c", "£": "l", "¡": "i", "§": "s",
}
#: May stand for any letter.
WILD = "*#%"
#: May be dropped between letters.
GAPS = ".-_,·~'`^*/\\ "
#: Costs of the channel (natural logarithms): a sign for a letter, any letter for a wild sign, one dropped repeat, a dropped gap.
SIGN, ANY, REPEAT, GAP = -1.0, -4.0, -1.0, -0.2
EDGE = ".,;:?\"'()[]{}<>«»„“”…-_"
#: Single characters apart, by any white space.
SPACED = re.compile(r"(?<!\S)\S(?:\s++\S){2,}(?!\S)")
#: Opens the token that stands for such a run; white space, so no other token has it.
APART = "\x1f"
EQUAL = re.compile(r"(.)\1*", re.S)
#: Letters of which none is repeated, or a run of equal characters.
PIECE = re.compile(r"(?:([^\W\d_])(?!\1))+|(.)\2*", re.S)
RUN = re.compile(r"(.)\1+", re.S)
#: No spelling has this, so words with it teach the language model nothing.
THRICE = re.compile(r"(.)\1\1", re.S)
#: Tokens that a worker remembers, and the longest of them.
MEMO, MEMO_LEN = 400_000, 48
#: Counts that a worker holds before it hands them on.
HELD = 300_000
#: The share of all words from which a word is in the language model's list, which so has at most two million words.
LEAST_SHARE = 1 / 2_000_000
#: Ways through the lattice that a worker remembers.
LED = 100_000
OUT = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]


@dataclass
class CharModel:
    """Trigram model of characters with interpolated lower orders; ``^`` opens a word and ``$`` closes it."""

    three: dict[str, int]
    two: dict[str, int]
    one: dict[str, int]
    total: int
    #: Logarithms of the words' shares, the words in order, and the logarithm of the share left for unseen words.
    words: dict[str, float] = field(default_factory=dict)
    ordered: list[str] = field(default_factory=list)
    unseen: float = 0.0
    known: dict[str, float] = field(default_factory=dict)
    led: dict[str, list[tuple[str, float]]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "known": {}, "led": {}}

    def begins(self, prefix: str) -> bool:
        """Some word of the list begins so."""
        i = bisect_left(self.ordered, prefix)
        return i < len(self.ordered) and self.ordered[i].startswith(prefix)

    def logp(self, context: str, c: str) -> float:
        key = context + c
        p = self.known.get(key)
        if p is None:
            uni = (self.one.get(c, 0) + 0.5) / (self.total + 50)
            bi = (self.two.get(key[1:], 0) + 4 * uni) / (self.one.get(key[1], 0) + 4)
            tri = (self.three.get(key, 0) + 4 * bi) / (self.two.get(key[:2], 0) + 4)
            p = self.known[key] = math.log(tri)
        return p


def grams_of(words: Iterable[tuple[str, int]]) -> Counter:
    """Counts of the runs of one, two and three characters of words, by their length apart."""
    found: Counter = Counter()
    for w, n in words:
        s = "^^" + w + "$"
        for i in range(2, len(s)):
            found[s[i - 2 : i + 1]] += n
            found[s[i - 1 : i + 1]] += n
            found[s[i]] += n
        found["^^"] += n
        found["^"] += n
    return found


def model_of(grams: dict[str, int], words: dict[str, int], total: int, rest: int) -> CharModel:
    """From counts of runs and of listed words; ``rest`` of ``total`` words count as unseen ones."""
    three, two, one = ({g: n for g, n in grams.items() if len(g) == k} for k in (3, 2, 1))
    unseen = (rest + 1) / (total + 2)
    shares = {w: math.log(k / total * (1 - unseen)) for w, k in words.items()}
    return CharModel(three, two, one, sum(one.values()), shares, sorted(shares), math.log(unseen))


def char_model(words: Counter) -> CharModel:
    # unseen words get the share of the words seen once (Good and Turing)
    return model_of(grams_of(words.items()), words, sum(words.values()), sum(k == 1 for k in words.values()))


def suspicious(token: str) -> bool:
    """Has a lattice of more than one path."""
    if token.isalpha():
        return len(token) > 3 and RUN.search(token) is not None
    letters = sum(c.isalpha() for c in token)
    return letters > 0 and len(token) > 2 and (letters > 1 or len(token) <= 8)


def follow(lm: CharModel, state: str, out: str) -> list[tuple[str, float]]:
    """Where writing ``out`` leads from a state, and the logarithm of its chance; remembered, as far as there is room.

    States are "" between words, ``^`` and the last two characters in an unseen word, and the beginning written so far
    in a word of the list, behind ``=``.  A blank by itself ends a word.
    """
    key = f"{state} {out}"
    found = lm.led.get(key)
    if found is not None:
        return found
    found = []
    if out == " ":
        if state[:1] == "=":
            p = lm.words.get(state[1:])
            found = [] if p is None else [("", p)]
        elif state:
            found = [("", lm.logp(state[1:], "$"))]
    else:
        if state[:1] != "^" and lm.begins(state[1:] + out):
            found.append(("=" + state[1:] + out, 0.0))
        if state[:1] != "=":
            s, p = (state[1:], 0.0) if state else ("^^", lm.unseen)
            for x in out:
                p += lm.logp(s, x)
                s = s[1] + x
            found.insert(0, ("^" + s, p))
    if len(lm.led) >= LED:
        lm.led.clear()
    lm.led[key] = found
    return found


def likeliest(steps: list[list[tuple[str, float]]], lm: CharModel) -> str:
    """Viterbi over steps of (written, cost)."""
    best: dict[str, tuple[float, tuple | None]] = {"": (0.0, None)}
    for ways in [*steps, [(" ", 0.0)]]:
        step: dict[str, tuple[float, tuple | None]] = {}
        for out, cost in ways:
            parted = len(out) > 1 and " " in out
            for state, (p, path) in best.items():
                ends = follow(lm, state, out) if out and not parted else [(state, 0.0)]
                if parted:
                    for x in out:
                        ends = [(t, q + c) for s, q in ends for t, c in follow(lm, s, x)]
                for s, q in ends:
                    q += p + cost
                    if s not in step or q > step[s][0]:
                        step[s] = (q, (path, out) if out else path)
        best = step
    # nothing but gaps leaves no word to end
    path, out = best.get("", (0.0, None))[1], []
    while path:
        path, last = path
        out.append(last)
    return "".join(reversed(out)).strip()


def steps_of(token: str, cut: re.Pattern) -> list[list[tuple[str, float]]]:
    """What each piece of a token, as ``cut`` finds them, may stand for."""
    steps = []
    for m in cut.finditer(token):
        piece = m[0]
        c, n = piece[0], len(piece)
        if n > 1 and piece[1] != c:
            steps.append([(piece, 0.0)])
            continue
        ways: list[tuple[str, float]] = []
        if c.isalpha():
            ways.append((c * min(n, 2), 0.0 if n <= 2 else REPEAT))
            if n > 1:
                ways.append((c, REPEAT))
        else:
            for x in LEET.get(c, ""):
                ways.append((x, SIGN + (REPEAT if n > 1 else 0.0)))
                if n > 1:
                    ways.append((x + x, SIGN + SIGN))
            if c in GAPS:
                ways += [("", GAP), (" ", 0.0)]
            if c in WILD and n == 1:
                ways += [(x, ANY) for x in "abcdefghijklmnopqrstuvwxyz"]
        steps.append(ways)
    return steps


def veiled(token: str) -> bool:
    """Is read through a lattice; any other token is kept as it is."""
    return suspicious(token) and all(c.isalpha() or c in LEET or c in WILD or c in GAPS for c in token)


def restore_token(token: str, lm: CharModel) -> str:
    """The likeliest reading of one token: a word, or words parted by blanks."""
    return likeliest(steps_of(token, PIECE), lm) if veiled(token) else token


def restore_run(chars: str, lm: CharModel) -> str:
    """The likeliest words, parted by blanks, of characters that stood apart: a word may end after each of them."""
    if not any(c.isalpha() for c in chars):
        return chars
    return likeliest(steps_of_run(chars), lm)


def steps_of_run(chars: str) -> list[list[tuple[str, float]]]:
    steps = []
    for ways in steps_of(chars, EQUAL):
        # a sign that stands for no letter is dropped
        ways = ways or [("", GAP)]
        ways = ways + [(f"{w[0]} {w[1]}", p) for w, p in ways if len(w) == 2]
        steps += [ways, [("", 0.0), (" ", 0.0)]]
    return steps


def tokens_of(text: str) -> tuple[list[str], list[str]]:
    """Lower-cased tokens, and a token for each run of single characters."""
    text = text.lower()
    return text.split(), [APART + "".join(m[0].split()) for m in SPACED.finditer(text)]


def stripped(token: str) -> str:
    bare = token.strip(EDGE)
    if "(" in token and (suspicious(bare) or not bare.isalpha()):
        return token.strip(EDGE.replace("(", ""))
    return bare


class Restorer:
    def __init__(self, lm: CharModel):
        self.lm = lm

    def read(self, token: str) -> str:
        """The word that a token stands for; words parted by blanks for a run of single characters."""
        if token[0] == APART:
            return restore_run(token[1:], self.lm)
        bare = stripped(token)
        if bare.isalpha() and not suspicious(bare):
            return bare
        got = restore_token(bare, self.lm)
        if bare[-1:] == "!":
            # an exclamation mark that closes a word, unless reading it as a letter is likelier
            short = restore_token(bare.rstrip("!"), self.lm)
            return max(short, got, key=lambda w: sum(self.lm.logp(a, b) for a, b in trigrams(w)) / (len(w) + 1))
        return got


def trigrams(word: str) -> list[tuple[str, str]]:
    s = "^^" + word + "$"
    return [(s[i - 2 : i], s[i]) for i in range(2, len(s))]


def restore_text(text: str | None, lm: CharModel) -> str:
    """The text as it is read: words parted by single spaces, in lower case."""
    if not text:
        return ""
    text, tokens, at = text.lower(), [], 0
    for m in SPACED.finditer(text):
        tokens += [*text[at : m.start()].split(), APART + "".join(m[0].split())]
        at = m.end()
    r = Restorer(lm)
    return " ".join(w for w in map(r.read, tokens + text[at:].split()) if w)


def marks(word: str) -> tuple[str, ...]:
    """Features of a word: itself and its beginnings of 4, 5 and 6 characters; those of all words of a reading."""
    if " " in word:
        return tuple(f for w in word.split() for f in marks(w))
    return (word, *[word[:k] + "~" for k in (4, 5, 6) if len(word) >= k])


@dataclass
class Model:
    lm: CharModel
    weights: dict[str, float]
    theta: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def of_word(self, word: str) -> float:
        return max((self.weights.get(f, 0.0) for f in marks(word)), default=0.0) if word else 0.0

    def beyond(self, reading: str) -> float:
        """What the words of a reading weigh besides the strongest."""
        found = [self.of_word(w) for w in reading.split()] if " " in reading else [0.0]
        return sum(found) - max(found)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.theta[1:] + self.theta[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def evidence(found: np.ndarray, beyond: float = 0.0) -> list[float]:
    """Strongest weight, and the logarithm of the sum, of the words' weights: one plain word is enough in any length."""
    total = float(found.sum()) + beyond
    return [float(found.max()), math.log1p(total)] if len(found) and total > 0 else [0.0, 0.0]


def labelled_rows(docs: DataFrame, labels: DataFrame) -> Staged:
    """part, toxic and text of every labelled row, staged since they are read several times."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    rows = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(broadcast_if_few(known), "doc_id")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)).cast("int")
    return Staged(rows.select(part.alias("part"), "toxic", "text"), "labelled")


def handed_on(counts: list[Counter], names: list[str]) -> Iterator[pa.RecordBatch]:
    """What was counted by key, a column a counter, and forgets it."""
    for k, c in enumerate(counts):
        keys, n = list(c), list(c.values())
        for i in range(0, len(keys), 50_000):
            values = [pa.array(n[i : i + 50_000] if j == k else [0] * len(keys[i : i + 50_000]), pa.int64()) for j in range(len(counts))]
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + 50_000], pa.string()), *values], names=names)
        c.clear()


def language_model(rows: DataFrame) -> tuple[CharModel, int]:
    """The words of all rows counted on executors, and how many they are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                plain, spaced = tokens_of(text)
                held.update(plain + spaced if spaced else plain)
            if len(held) > HELD:
                yield from plain_words(held)
        yield from plain_words(held)

    def plain_words(held: Counter) -> Iterator[pa.RecordBatch]:
        plain: Counter = Counter()
        for t, n in held.items():
            if (w := t.strip(EDGE)).isalpha() and not THRICE.search(w):
                plain[w] += n
        held.clear()
        return handed_on([plain], ["w", "n"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            held.update(grams_of(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
            if len(held) > HELD:
                yield from handed_on([held], ["g", "n"])
        yield from handed_on([held], ["g", "n"])

    words = Staged(in_arrow(rows.select("text"), count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")), "words")
    found = words.df.agg(F.sum("n"), F.sum((F.col("n") == 1).cast("long"))).first()
    total, once = found[0] or 0, found[1] or 0
    least = total * LEAST_SHARE
    listed = {r.w: r.n for r in words.df.where(F.col("n") >= F.lit(least)).collect()}
    grams = {r.g: r.n for r in in_arrow(words.df, cut, "g string, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    words.drop()
    # the share of unseen words is that of words seen once (Good and Turing), or of all words that aren't listed
    return model_of(grams, listed, total, max(once, total - sum(listed.values()))), total


def chosen_features(rows: DataFrame, lm: CharModel, size: list[int], least_gain: float) -> list:
    """(feature, toxic documents, other documents) of the features that say "toxic" beyond chance; all are counted."""
    held = rows.sparkSession.sparkContext.broadcast(lm)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, memo = Restorer(held.value), {}
        by: list[Counter] = [Counter(), Counter()]
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plain, spaced = tokens_of(text)
                every = set(plain + spaced)
                for t in every.difference(memo):
                    memo[t] = marks(w) if (w := reader.read(t)) else ()
                by[y].update(set().union(*map(memo.__getitem__, every)))
                if len(memo) > MEMO // 2:
                    memo.clear()
            if len(by[0]) + len(by[1]) > HELD:
                yield from handed_on(by, ["f", "n", "t"])
        yield from handed_on(by, ["f", "n", "t"])

    found = in_arrow(rows.select("toxic", "text"), count, "f string, n long, t long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    base = size[1] / sum(size)
    rate = F.col("t") / (F.col("t") + F.col("n"))
    # log-likelihood gained by giving the feature a rate of its own; chance alone reaches this for few features
    gain = F.col("t") * F.log(rate / base) + F.when(F.col("n") > 0, F.col("n") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    return sorted(tuple(r) for r in found.where("t > 0").where((rate >= 0.7) & (gain >= least_gain)).select("f", "t", "n").collect())


def regress(rows: DataFrame, model: Model) -> None:
    """Fits the logistic regression on all rows given: Newton's steps, whose sums are taken on executors."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def begin():
        scorer = Scorer(held.value)
        return lambda texts: list(scorer.evidence(texts).T)

    found = rows.select("toxic", of_text(T.StructType([T.StructField(c, T.DoubleType()) for c in "ab"]), begin)("text").alias("e"))
    # equal rows become one with a count
    table = Staged(found.groupBy("toxic", "e.a", "e.b").agg(F.count(F.lit(1)).alias("n")), "evidence")
    n = F.col("n")
    count, *sums = table.df.agg(F.sum("n"), *[F.sum(n * F.col(c)) for c in "ab"]).first()
    if not count:
        table.drop()
        return
    mean = np.array(sums) / count
    spread = table.df.agg(*[F.sum(n * F.pow(F.col(c) - F.lit(float(m)), 2)) for c, m in zip("ab", mean)]).first()
    model.mean, model.scale = mean, np.sqrt(np.array(list(spread)) / count) + 1e-6
    z = [F.lit(1.0), *[(F.col(c) - F.lit(float(m))) / F.lit(float(s)) for c, m, s in zip("ab", model.mean, model.scale)]]
    theta = np.zeros(3)
    upper = [(i, j) for i in range(3) for j in range(i, 3)]
    for _ in range(100):
        line = sum(x * F.lit(float(t)) for x, t in zip(z, theta))
        p = 1 / (1 + F.exp(-F.least(F.greatest(line, F.lit(-30.0)), F.lit(30.0))))
        got = table.df.agg(
            *[F.sum(n * (p - F.col("toxic")) * x) for x in z], *[F.sum(n * p * (1 - p) * z[i] * z[j]) for i, j in upper]
        ).first()
        grad = np.array(got[:3]) / count + 1e-3 * np.append(0.0, theta[1:])
        curve = 1e-3 * np.eye(3)
        for (i, j), v in zip(upper, got[3:]):
            curve[i, j] += v / count
            if i != j:
                curve[j, i] += v / count
        move = np.linalg.solve(curve, grad)
        theta -= move
        if np.abs(move).max() < 1e-8:
            break
    model.theta = theta
    table.drop()


def fit(docs: DataFrame, labels: DataFrame, least_gain: float = 11.0) -> Model:
    """Reads every labelled row."""
    rows = labelled_rows(docs, labels)
    lm, total = language_model(rows.df)
    model = Model(lm, {}, np.array([-3.0, 2.0, 0.0]), np.zeros(2), np.ones(2))
    sizes = {(r.part, r.toxic): r.n for r in rows.df.groupBy("part", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    apart = sum(sizes.values()) >= 400
    size = [sum(n for (part, y), n in sizes.items() if y == k and (part == 0 or not apart)) for k in (0, 1)]
    if size[0] and size[1]:
        for f, t, n in chosen_features(rows.df.where("part = 0") if apart else rows.df, lm, size, least_gain):
            model.weights[f] = math.log((t + 0.2) / (size[1] + 0.4) / ((n + 0.2) / (size[0] + 0.4)))
            if not f.endswith("~") and f not in lm.words and f.isalpha():
                # a weighed word that isn't listed, or only read out of disguises, is a word too
                lm.words[f] = math.log((t + n) / (total + t + n))
        lm.ordered = sorted(lm.words)
        if model.weights:
            regress(rows.df.where("part = 1") if apart else rows.df, model)
    rows.drop()
    release()
    return model


class Scorer:
    def __init__(self, model: Model):
        self.model, self.reader = model, Restorer(model.lm)
        #: A token's strongest weight, and what its words weigh besides.
        self.memo: dict[str, float] = {}
        self.more: dict[str, float] = {}
        #: All beginnings of weighed features.
        self.begun = {f[:k] for f in model.weights for k in range(len(f) + 1)}

    def reaches(self, steps: list[list[tuple[str, float]]]) -> bool:
        """Some path through the lattice writes a weighed feature, as a word or as a word's beginning."""
        begun, weights = self.begun, self.model.weights
        states = {""}
        for ways in steps:
            after = set()
            for out, _ in ways:
                for state in states:
                    # None: in a word that begins like no feature
                    for c in out:
                        if c == " ":
                            if state in weights:
                                return True
                            state = ""
                        elif state is not None:
                            state += c
                            if state + "~" in weights:
                                return True
                            if state not in begun:
                                state = None
                    after.add(state)
            states = after
        return any(state in weights for state in states)

    def worth(self, token: str) -> bool:
        """False where no reading of a token weighs anything, which is found without looking for the likeliest one."""
        if token[0] == APART:
            return not any(c.isalpha() for c in token) or self.reaches(steps_of_run(token[1:]))
        bare = stripped(token)
        if not veiled(bare) or (bare[-1:] == "!" and not veiled(bare.rstrip("!"))):
            return True
        return self.reaches(steps_of(bare, PIECE)) or (bare[-1:] == "!" and self.reaches(steps_of(bare.rstrip("!"), PIECE)))

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO:
            memo.clear()
            self.more.clear()
        rows = []
        for t in texts:
            plain, spaced = tokens_of(t or "")
            every = plain + spaced if spaced else plain
            missing = set(every).difference(memo)
            for w in missing:
                if not self.worth(w):
                    memo[w] = 0.0
                    continue
                reading = self.reader.read(w)
                memo[w] = self.model.of_word(reading)
                if more := self.model.beyond(reading):
                    self.more[w] = more
            beyond = sum(self.more.get(w, 0.0) for w in every) if self.more else 0.0
            rows.append(evidence(np.fromiter(map(memo.__getitem__, every), float, len(every)), beyond))
            for w in missing:
                if len(w) > MEMO_LEN:
                    del memo[w]
                    self.more.pop(w, None)
        return np.array(rows).reshape(len(texts), 2)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return self.model.score(self.evidence(texts))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Appends score and predicted; only ``text`` is read."""
    new = [o.name for o in OUT]
    kept = [c for c in docs.columns if c not in new]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def begin():
        scorer = Scorer(held.value)

        def judge(texts: list[str | None]) -> list:
            s = scorer.score(texts)
            return [s, (s >= 0.5).astype(np.int32)]

        return judge

    found = docs.select(*kept, of_text(T.StructType(OUT), begin)("text").alias("__scored"))
    return found.select(*kept, *[F.col("__scored")[c].alias(c) for c in new])


def restore(docs: DataFrame, model: Model, restored: str = "restored") -> DataFrame:
    """Appends the text as the noisy channel reads it."""
    kept = [f for f in docs.schema.fields if f.name != restored]
    names = [f.name for f in kept]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lm = held.value.lm
        for batch in batches:
            out = [restore_text(t, lm) for t in batch.column(names.index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*names, restored])

    return in_arrow(docs.select(*names), run, T.StructType([*kept, T.StructField(restored, T.StringType())]))


def held_out():
    return crc_of_id() % 5 == 0


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on labelled rows that aren't held out, then scores every row from its text alone."""
    model = fit(docs.where(~held_out()), labels.where(~held_out()))
    return score(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
