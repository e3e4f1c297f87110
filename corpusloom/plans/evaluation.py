"""Learned scoring, evaluation, gates on reports, signals, samples, unions: queries with their twins."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import structure
from corpusloom.functions import textfn as X
from corpusloom.operators import dedup, joins, ordering, rules
from corpusloom.plans.documents import FLAT, LINE_BYTES, WORDS, docs, hits, literal, n_of, quoted
from corpusloom.plans.gates import QA_DOCS, TIDY_DOCS, qa_docs, tidy_docs
from corpusloom.plans.others import CHAT, NORM, SCORED, chats, events, scored, table
from corpusloom.plans.registry import query
from corpusloom.plans.spec import bounded, text_sql

T_ = "SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents"


# -- ridge regression ------------------------------------------------------------------------------------------------
def ridge_fit(df: DataFrame, features: str, label: str, lam: float) -> np.ndarray:
    """Weights and, last, the bias (not held down) by normal equations.

    Each task sums its rows' products, so a matrix a task travels and the driver solves one system of the features' size.
    """
    import pandas as pd

    def gram(batches):
        total = None
        for rows in batches:
            x = np.column_stack((np.array(rows["x"].tolist(), float).reshape(len(rows), -1), np.ones(len(rows))))
            own = np.column_stack((x.T @ x, x.T @ rows["y"].to_numpy(float)))
            total = own if total is None else total + own
        if total is not None:
            yield pd.DataFrame({"g": [total.ravel().tolist()]})

    rows = df.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(F.col(features).alias("x"), F.col(label).cast("double").alias("y"))
    parts = rows.mapInPandas(gram, "g array<double>")
    summed = parts.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r.v for r in summed])
    d = int((math.isqrt(1 + 4 * len(flat)) - 1) // 2)
    both = flat.reshape(d, d + 1)
    hold = lam * np.eye(d)
    hold[-1, -1] = 0.0
    return np.linalg.solve(both[:, :-1] + hold, both[:, -1])


def predicted(features: str, weights: np.ndarray, low: float = 0.0, high: float = 5.0) -> Column:
    """The dot product and bias, held within bounds."""
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    dot = F.aggregate(F.zip_with(features, w, lambda a, b: a.cast("double") * b), F.lit(float(weights[-1])), lambda a, x: a + x)
    return F.greatest(F.lit(low), F.least(F.lit(high), dot))


@query()
def ridge_scores(spark, sf_dir):
    """Labels from embeddings; tested against numpy."""
    df = table(spark, sf_dir, "embeddings")
    return df.select("vec_id", predicted("embedding", ridge_fit(df, "embedding", "label", 1.0)).alias("score"))


@query(
    "SELECT label, n, round_even(sum(abs(s)) * 1e3 / n, 0)::BIGINT AS mean_abs FROM (SELECT label, i, count(*) AS n, sum(x) AS s FROM (SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY label, i) GROUP BY label, n"
)
def mean_pool(spark, sf_dir):
    """Vectors of a label pooled by place, in one pass: the sum of a place is an aggregate, so no group is gathered."""
    each = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    pooled = each.groupBy("label", "i").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x").cast("double")).alias("s"))
    return pooled.groupBy("label", "n").agg(F.bround(F.sum(F.abs("s")) * 1e3 / F.col("n"), 0).cast("long").alias("mean_abs"))


@query(
    f"""SELECT n, round_even(sqrt(se / n) * 1e6, 0)::BIGINT AS rmse, round_even(ae / n * 1e6, 0)::BIGINT AS mae, round_even((n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy) + 1e-9) * 1e6, 0)::BIGINT AS pearson,
        round_even(1e6 * (CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END), 0)::BIGINT AS prec, round_even(1e6 * (CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END), 0)::BIGINT AS recall, round_even(1e6 * (tp + tn) / n, 0)::BIGINT AS accuracy
        FROM (SELECT count(*)::DOUBLE AS n, sum((score - y) ** 2) AS se, sum(abs(score - y)) AS ae, sum(score) AS sx, sum(y) AS sy, sum(score * score) AS sxx, sum(y * y) AS syy, sum(score * y) AS sxy,
        sum((score >= 2.5 AND y >= 3)::INT)::DOUBLE AS tp, sum((score >= 2.5 AND y < 3)::INT)::DOUBLE AS fp, sum((score < 2.5 AND y >= 3)::INT)::DOUBLE AS fn, sum((score < 2.5 AND y < 3)::INT)::DOUBLE AS tn
        FROM (SELECT score, quality * 5.0 AS y FROM ({SCORED})))"""
)
def regression_metrics(spark, sf_dir):
    """Errors, correlation, precision, recall and accuracy of scores, in millionths, from one pass of sums."""
    df = scored(spark, sf_dir).select("score", (F.col("quality") * 5.0).alias("y"))
    s, y = F.col("score"), F.col("y")
    n_if = lambda c: F.sum(c.cast("int")).cast("double")
    sums = df.agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum((s - y) * (s - y)).alias("se"), F.sum(F.abs(s - y)).alias("ae"), F.sum(s).alias("sx"), F.sum(y).alias("sy"), F.sum(s * s).alias("sxx"), F.sum(y * y).alias("syy"),
        F.sum(s * y).alias("sxy"), n_if((s >= 2.5) & (y >= 3)).alias("tp"), n_if((s >= 2.5) & (y < 3)).alias("fp"), n_if((s < 2.5) & (y >= 3)).alias("fn"), n_if((s < 2.5) & (y < 3)).alias("tn"),
    )
    micro = lambda e: F.expr(f"cast(bround({e} * 1e6D, 0) AS long)")
    return sums.select(
        "n", micro("sqrt(se / n)").alias("rmse"), micro("ae / n").alias("mae"), micro("(n * sxy - sx * sy) / (sqrt(n * sxx - sx * sx) * sqrt(n * syy - sy * sy) + 1e-9D)").alias("pearson"),
        micro("CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END").alias("prec"), micro("CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END").alias("recall"), micro("(tp + tn) / n").alias("accuracy"),
    )


SWEEP = f"""SELECT t, sum((score >= t / 100.0 AND quality = 1)::INT) AS tp, sum((score >= t / 100.0 AND quality = 0)::INT) AS fp, sum((score < t / 100.0 AND quality = 1)::INT) AS fn
    FROM ({SCORED}), (SELECT unnest(range(100, 405, 5)) AS t) GROUP BY t"""


@query(f"SELECT t, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn FROM ({SWEEP}) ORDER BY CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END DESC, t LIMIT 1")
def best_threshold(spark, sf_dir):
    """The first threshold of the grid with the greatest F1."""
    from corpusloom.plans.others import label_threshold_sweep

    return label_threshold_sweep(spark, sf_dir).orderBy(F.desc("f1"), "t").select("t", "tp", "fp", "fn").limit(1)


# -- answers ---------------------------------------------------------------------------------------------------------
PROBES = (
    ("p1", "target", ("alpha",), ("the", "and"), ("idiot",), "yes"), ("p2", "target", (), ("is", "of"), ("http",), None), ("p3", "retention", ("on",), (), (), "no"),
)
PLAIN = r"trim(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'))"


def plain_answer(c) -> Column:
    return F.trim(F.regexp_replace(F.lower(X.text_or_empty(c)), "[^a-z0-9]+", " "))


def polarity(norm) -> Column:
    """yes, no or null by an answer's first word."""
    like = lambda w: F.regexp_like(norm, F.lit(f"^({w})( |\\z)"))
    return F.when(like("ja|jawohl|richtig|stimmt|yes"), "yes").when(like("nein|nicht|falsch|no"), "no")


POLARITY = r"CASE WHEN regexp_matches({0}, '^(ja|jawohl|richtig|stimmt|yes)( |\z)') THEN 'yes' WHEN regexp_matches({0}, '^(nein|nicht|falsch|no)( |\z)') THEN 'no' END"


@query(f"SELECT conv_id, turn, {POLARITY.format(PLAIN.format('answer'))} AS polarity FROM ({QA_DOCS})")
def answer_polarity(spark, sf_dir):
    return qa_docs(spark, sf_dir).select("conv_id", "turn", polarity(plain_answer("answer")).alias("polarity"))


def probe_table(spark) -> DataFrame:
    kind = "id string, split string, must array<string>, any_of array<string>, forbid array<string>, polarity string"
    return spark.createDataFrame([(a, b, list(c), list(d), list(e), f) for a, b, c, d, e, f in PROBES], kind)


def semantic_issues(probes: DataFrame, given: DataFrame) -> DataFrame:
    """id, split, issues of answers (id, answer): wrong polarity, missing words, no word of a group, forbidden words."""
    df = given.join(F.broadcast(probes), "id").withColumn("norm", plain_answer("answer"))
    said = polarity(F.col("norm"))
    has = lambda w: F.contains("norm", plain_answer(w))
    named = lambda words, prefix, keep: F.transform(F.filter(words, keep), lambda w: F.concat(F.lit(prefix), w))
    wrong = F.when(F.col("polarity").isNotNull() & (said != F.col("polarity")), F.array(F.concat(F.lit("wrong_polarity:"), said))).otherwise(F.array().cast("array<string>"))
    group = F.when((F.size("any_of") > 0) & ~F.exists("any_of", has), F.array(F.lit("missing_any_group"))).otherwise(F.array().cast("array<string>"))
    issues = F.concat(wrong, named("must", "missing:", lambda w: ~has(w)), group, named("forbid", "forbidden:", has))
    return df.select(*[c for c in given.columns if c != "answer"], "split", issues.alias("issues"))


def _issues_sql() -> str:
    rows = []
    for i, (_, _, must, any_of, forbid, wanted) in enumerate(PROBES):
        parts = [f"CASE WHEN said <> '{wanted}' THEN 'wrong_polarity:' || said END"] if wanted else []
        parts += [f"CASE WHEN NOT contains(norm, '{w}') THEN 'missing:{w}' END" for w in must]
        parts += ["CASE WHEN NOT (" + " OR ".join(f"contains(norm, '{w}')" for w in any_of) + ") THEN 'missing_any_group' END"] if any_of else []
        parts += [f"CASE WHEN contains(norm, '{w}') THEN 'forbidden:{w}' END" for w in forbid]
        rows.append(f"WHEN conv_id % {len(PROBES)} = {i} THEN [{', '.join(parts)}]")
    return f"list_filter(CASE {' '.join(rows)} END, lambda x: x IS NOT NULL)"


ISSUES = f"""SELECT conv_id, turn, CASE conv_id % {len(PROBES)} {" ".join(f"WHEN {i} THEN '{p[1]}'" for i, p in enumerate(PROBES))} END AS split, {_issues_sql()} AS issues
    FROM (SELECT conv_id, turn, {PLAIN.format("answer")} AS norm, {POLARITY.format(PLAIN.format("answer"))} AS said FROM ({QA_DOCS}))"""


def probed(spark, sf_dir) -> DataFrame:
    """Answers dealt to the probes by conversation."""
    names = F.array(*[F.lit(p[0]) for p in PROBES])
    given = qa_docs(spark, sf_dir).select("conv_id", "turn", F.get(names, (F.col("conv_id") % len(PROBES)).cast("int")).alias("id"), "answer")
    return semantic_issues(probe_table(spark), given).drop("id")


@query(f"SELECT conv_id, turn, split, array_to_string(issues, ',') AS issues FROM ({ISSUES})")
def semantic_gate(spark, sf_dir):
    return probed(spark, sf_dir).withColumn("issues", F.array_join("issues", ","))


@query(f"SELECT split, count(*) AS n, sum((len(issues) = 0)::INT)::BIGINT AS passed, bool_and(len(issues) = 0) AS clean FROM ({ISSUES}) GROUP BY split")
def semantic_summary(spark, sf_dir):
    """Passed by split; the gate opens only if every split is clean."""
    ok = F.size("issues") == 0
    return probed(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(ok.cast("int")).alias("passed"), F.bool_and(ok).alias("clean"))


def answered(probes: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Probes with their answers; an unanswered probe is an error when the rows are read, an unknown answer is ignored."""
    both = probes.join(answers, key, "left")
    missing = F.col("answer").isNull()
    return both.withColumn("answer", F.when(missing, F.raise_error(F.concat(F.lit("no answer for "), F.col(key).cast("string")))).otherwise(F.col("answer")))


@query("SELECT item_id, text AS answer FROM benchmark")
def probe_answers(spark, sf_dir):
    """Each benchmark item with an answer of its own; more answers than items do no harm."""
    items = table(spark, sf_dir, "benchmark")
    given = items.select("item_id", F.col("text").alias("answer")).unionByName(spark.createDataFrame([(-1, "x")], "item_id long, answer string"))
    return answered(items.select("item_id"), given, "item_id")


QUESTIONS = (("q0", "general", ("the", "a"), None), ("q1", "exact", (), "is"), ("q2", "none", (), None))


@query(
    f"""SELECT category, count(*) AS n, sum(CASE category WHEN 'general' THEN (contains(a, 'the') OR contains(a, 'a'))::INT WHEN 'exact' THEN contains(a, 'is')::INT ELSE 0 END)::BIGINT AS points
        FROM (SELECT CASE conv_id % 3 WHEN 0 THEN 'general' WHEN 1 THEN 'exact' ELSE 'none' END AS category, lower(answer) AS a FROM ({QA_DOCS})) GROUP BY category"""
)
def baseline_scores(spark, sf_dir):
    """The exact answer where one is given, else any keyword; points by category."""
    asked = spark.createDataFrame([(i, c, list(k), e) for i, (_, c, k, e) in enumerate(QUESTIONS)], "q int, category string, keywords array<string>, expected string")
    df = qa_docs(spark, sf_dir).select((F.col("conv_id") % 3).cast("int").alias("q"), F.lower("answer").alias("a")).join(F.broadcast(asked), "q")
    hit = F.when(F.col("expected").isNotNull(), F.contains("a", F.col("expected"))).otherwise(F.exists("keywords", lambda k: F.contains("a", k)))
    return df.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.sum(hit.cast("int")).alias("points"))


@query(f"SELECT conv_id, turn, coalesce(list_extract(regexp_extract_all(prompt, '[0-9]+'), -1) = list_extract(regexp_extract_all(answer, '[0-9]+'), -1), false) AS exact FROM ({QA_DOCS})")
def last_number_match(spark, sf_dir):
    """Whether the last numbers of two texts are equal; without a number in either there is no match."""
    last = lambda c: F.try_element_at(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), F.lit(-1))
    return qa_docs(spark, sf_dir).select("conv_id", "turn", F.coalesce(last("prompt") == last("answer"), F.lit(False)).alias("exact"))


# -- probes and knowledge --------------------------------------------------------------------------------------------
PROBED = "SELECT event_type AS family, CASE WHEN user_id % 2 = 0 THEN 'target' ELSE 'retention' END AS split, value - 20 AS margin, event_id FROM events"


def margins(spark, sf_dir) -> DataFrame:
    split = F.when(F.col("user_id") % 2 == 0, "target").otherwise("retention")
    return events(spark, sf_dir).select("event_id", F.col("event_type").alias("family"), split.alias("split"), (F.col("value") - 20).alias("margin"))


@query(f"SELECT split, family, count(*) AS n, sum((margin > 0)::INT)::DOUBLE / count(*) AS pass_rate, round_even(avg(margin) * 1e4, 0)::BIGINT AS margin FROM ({PROBED}) GROUP BY GROUPING SETS ((split), (family))")
def probe_metrics(spark, sf_dir):
    """Pass rates and mean margins by split and by family, in one pass."""
    passed = F.sum((F.col("margin") > 0).cast("int")) / F.count(F.lit(1))
    df = margins(spark, sf_dir).groupingSets([["split"], ["family"]], "split", "family")
    return df.agg(F.count(F.lit(1)).alias("n"), passed.alias("pass_rate"), F.bround(F.avg("margin") * 1e4, 0).cast("long").alias("margin"))


@query(
    """SELECT family, count(*) AS n, avg(easy::INT) AS easy, avg(hard::INT) AS hard, avg(coalesce(hard, easy)::INT) AS strict FROM
       (SELECT event_type AS family, user_id, bool_or(value > 10) FILTER (WHERE event_id % 2 = 0) AS easy, bool_or(value > 40) FILTER (WHERE event_id % 2 = 1) AS hard FROM events GROUP BY ALL) GROUP BY family"""
)
def knowledge_profile(spark, sf_dir):
    """Accuracy by category and hardness; strict takes the hardest level that a probe has."""
    even = F.col("event_id") % 2 == 0
    by = events(spark, sf_dir).groupBy(F.col("event_type").alias("family"), "user_id").agg(F.bool_or(F.when(even, F.col("value") > 10)).alias("easy"), F.bool_or(F.when(~even, F.col("value") > 40)).alias("hard"))
    mean = lambda c: F.avg(c.cast("int"))
    return by.groupBy("family").agg(F.count(F.lit(1)).alias("n"), mean(F.col("easy")).alias("easy"), mean(F.col("hard")).alias("hard"), mean(F.coalesce("hard", "easy")).alias("strict"))


@query(f"SELECT round_even(greatest(0.5, 0.8 * m), 2) AS mastery, round_even(greatest(0.1, 0.25 * abs(m)), 2) AS guard FROM (SELECT median(margin) AS m FROM ({PROBED}) WHERE split = 'retention')")
def threshold_proposal(spark, sf_dir):
    """Thresholds from the median of what should already be known."""
    m = margins(spark, sf_dir).where("split = 'retention'").agg(F.median("margin").alias("m"))
    return m.select(F.bround(F.greatest(F.lit(0.5), 0.8 * F.col("m")), 2).alias("mastery"), F.bround(F.greatest(F.lit(0.1), 0.25 * F.abs("m")), 2).alias("guard"))


# -- reports and their gates -----------------------------------------------------------------------------------------
SUSPECT = r"(contains(t, chr(0)) OR len(regexp_extract_all(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]'))::DOUBLE / greatest(1, length(t)) > 0.05)"


def suspect(c) -> Column:
    """A NUL, or more than a twentieth of control characters."""
    odd = X.count_of(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]") / F.greatest(F.lit(1), F.length(c))
    return F.contains(c, F.lit("\x00")) | (odd > 0.05)


@query(f"SELECT source, count(*) AS n, sum({LINE_BYTES})::BIGINT AS bytes, avg(length(t)) AS mean, median(length(t))::DOUBLE AS median, avg({SUSPECT}::INT) AS suspect, 1 - count(DISTINCT substr(t, 1, 64))::DOUBLE / count(*) AS repeated FROM (SELECT source, text, coalesce(text, '') AS t FROM documents) GROUP BY source")
def scorecard(spark, sf_dir):
    """Sizes, lengths, damaged and repeated beginnings by source; all rows are counted, none sampled."""
    df = docs(spark, sf_dir).select("source", ordering.row_bytes().alias("b"), X.text_or_empty(F.col("text")).alias("t"))
    df = df.select("source", "b", F.length("t").alias("n"), suspect(F.col("t")).cast("int").alias("s"), F.sha2(F.substring("t", 1, 64), 256).alias("k"))
    by = df.groupBy("source").agg(F.count(F.lit(1)).alias("n_"), F.sum("b").alias("bytes"), F.avg("n").alias("mean"), F.percentile("n", 0.5).alias("median"), F.avg("s").alias("suspect"))
    unique = df.groupBy("source", "k").agg(F.lit(1).alias("x")).groupBy("source").agg(F.count(F.lit(1)).alias("unique"))
    return by.join(unique, "source").select("source", F.col("n_").alias("n"), "bytes", "mean", "median", "suspect", (1 - F.col("unique") / F.col("n_")).alias("repeated"))


ALARMS = """CASE WHEN 100.0 * short / n > 10 THEN 'many_short' ELSE 'ok' END AS shortness, CASE WHEN mean < 150 THEN 'fragments' WHEN mean > 2500 THEN 'packed' ELSE 'ok' END AS size,
    CASE WHEN 100.0 * most / n > 70 THEN 'dominated' ELSE 'ok' END AS balance"""


@query(f"SELECT {ALARMS} FROM (SELECT sum(n) AS n, sum(short) AS short, sum(words)::DOUBLE / sum(n) AS mean, max(n) AS most FROM (SELECT source, count(*) AS n, sum((len({WORDS}) < 100)::INT) AS short, sum(len({WORDS})) AS words FROM documents GROUP BY source))")
def gate_notes(spark, sf_dir):
    """Alarms on a corpus's report: short documents, fragments or packed ones, one source above all."""
    df = docs(spark, sf_dir).select("source", F.size(X.words("text")).alias("w"))
    by = df.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("w") < 100).cast("int")).alias("short"), F.sum("w").alias("words"))
    whole = by.agg(F.sum("n").alias("n"), F.sum("short").alias("short"), (F.sum("words") / F.sum("n")).alias("mean"), F.max("n").alias("most"))
    note = lambda *cases: cases[0] if len(cases) == 1 else F.when(cases[0], cases[1]).otherwise(note(*cases[2:]))
    return whole.select(
        note(F.expr("100.0 * short / n > 10"), "many_short", F.lit("ok")).alias("shortness"), note(F.expr("mean < 150"), "fragments", F.expr("mean > 2500"), "packed", F.lit("ok")).alias("size"),
        note(F.expr("100.0 * most / n > 70"), "dominated", F.lit("ok")).alias("balance"),
    )


@query(
    f"""SELECT source, CASE WHEN n = 0 THEN 'manual_check' WHEN ocr > 0.02 THEN 'hard_filter' WHEN keep < 0.35 THEN 'exclude' WHEN source IN ('src18', 'src19') THEN 'small_or_special' WHEN keep >= 0.70 THEN 'take' ELSE 'hard_filter' END AS triage
        FROM (SELECT source, count(*) AS n, avg({SUSPECT}::INT) AS ocr, avg((length(t) >= 300 AND {n_of("t", "[.!?]")} >= 2)::INT) AS keep FROM ({T_}) GROUP BY source)"""
)
def split_triage(spark, sf_dir):
    """What to do with a source, by its samples' noise and keep rate."""
    t = X.text_or_empty(F.col("text"))
    keep = (F.length(t) >= 300) & (X.count_of(t, "[.!?]") >= 2)
    by = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg(suspect(t).cast("int")).alias("ocr"), F.avg(keep.cast("int")).alias("keep"))
    verdict = (
        F.when(F.col("n") == 0, "manual_check").when(F.col("ocr") > 0.02, "hard_filter").when(F.col("keep") < 0.35, "exclude").when(F.col("source").isin("src18", "src19"), "small_or_special")
        .when(F.col("keep") >= 0.70, "take").otherwise("hard_filter")
    )
    return by.select("source", verdict.alias("triage"))


SAMPLE_BAD = ("cookie", "privacy policy", "newsletter", "all rights reserved", "impressum")


@query(
    f"""SELECT source, n, round_even(chars * 10 / n, 0)::BIGINT AS chars_tenths, greatest(0.05, least(0.98, 0.86 - least(0.35, bad * 0.06) - least(0.25, tags::DOUBLE / n * 0.35) - CASE WHEN chars / n < 120 THEN 0.18 ELSE 0 END)) AS keep_rate,
        CASE WHEN chars / n >= 650 THEN 10 WHEN chars / n >= 220 THEN 5 ELSE -8 END - least(18, bad * 5) - CASE WHEN urls::DOUBLE / n > 0.5 OR tags::DOUBLE / n > 0.35 THEN 12 ELSE 0 END AS score_delta
        FROM (SELECT source, count(*) AS n, sum(length(t))::DOUBLE AS chars, {" + ".join(f"bool_or(contains(low, '{b}'))::INT" for b in SAMPLE_BAD)} AS bad, sum(len(regexp_extract_all(low, 'https?://|www\\.'))) AS urls,
        sum(len(regexp_extract_all(low, '<[a-z][^>]{{0,80}}>'))) AS tags FROM (SELECT source, trim(t) AS t, lower(trim(t)) AS low FROM ({T_})) WHERE t <> '' GROUP BY source)"""
)
def sample_quality(spark, sf_dir):
    """A source's readable texts judged together: lengths, boilerplate hints, addresses and tags."""
    t = F.trim(X.text_or_empty(F.col("text")))
    df = docs(spark, sf_dir).select("source", t.alias("t"), F.lower(t).alias("low")).where("t <> ''")
    bad = sum((F.bool_or(F.contains("low", F.lit(b))).cast("int") for b in SAMPLE_BAD), F.lit(0))
    by = df.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).cast("double").alias("chars"), bad.alias("bad"), F.sum(X.count_of(F.col("low"), "https?://|www\\.")).alias("urls"), F.sum(X.count_of(F.col("low"), "<[a-z][^>]{0,80}>")).alias("tags")
    )
    keep = F.expr("greatest(0.05D, least(0.98D, 0.86D - least(0.35D, bad * 0.06D) - least(0.25D, tags / n * 0.35D) - CASE WHEN chars / n < 120 THEN 0.18D ELSE 0D END))")
    delta = F.expr("CASE WHEN chars / n >= 650 THEN 10 WHEN chars / n >= 220 THEN 5 ELSE -8 END - least(18, bad * 5) - CASE WHEN urls / n > 0.5 OR tags / n > 0.35 THEN 12 ELSE 0 END")
    return by.select("source", "n", F.bround(F.col("chars") * 10 / F.col("n"), 0).cast("long").alias("chars_tenths"), keep.alias("keep_rate"), delta.alias("score_delta"))


#: Cleaners by name: a DataFrame with ``text`` in, ``out`` (the text) and ``ok`` added.
CLEANERS = {
    "collapse": lambda df: df.withColumn("out", X.collapse(F.col("text"))).withColumn("ok", F.length("out") >= 200),
    "strict": lambda df: df.withColumn("out", X.strict_normalise(F.col("text"))).withColumn("ok", (F.length("out") >= 300) & (X.distinct_share_lost(X.words(F.lower("out")), 50) <= 0.8)),
}


@query(
    f"""SELECT cleaner, count(*) AS n, sum((ok = good)::INT)::BIGINT AS right_, sum((ok AND NOT good)::INT)::BIGINT AS false_keep, sum((NOT ok AND good)::INT)::BIGINT AS false_drop FROM (
        SELECT 'collapse' AS cleaner, length({FLAT}) >= 200 AS ok, quality = 1 AS good FROM documents JOIN labels USING (doc_id) UNION ALL
        SELECT 'strict', length(t) >= 300 AND (len(w) < 50 OR 1 - len(list_distinct(w))::DOUBLE / len(w) <= 0.8), good FROM (SELECT t, regexp_extract_all(lower(t), '{X.WORD}') AS w, good FROM
        (SELECT regexp_replace(regexp_replace(replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]{{2,}}', ' ', 'g'), '^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$', '', 'g') AS t, quality = 1 AS good FROM documents JOIN labels USING (doc_id)))) GROUP BY cleaner"""
)
def cleaner_leaderboard(spark, sf_dir):
    """Registered cleaners against labelled rows: right decisions, false keeps and false drops."""
    rows = docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good")), "doc_id")
    judged = None
    for name, clean in CLEANERS.items():
        one = clean(rows).select(F.lit(name).alias("cleaner"), "ok", "good")
        judged = one if judged is None else judged.unionByName(one)
    n = lambda c: F.sum(c.cast("int"))
    ok, good = F.col("ok"), F.col("good")
    return judged.groupBy("cleaner").agg(F.count(F.lit(1)).alias("n"), n(ok == good).alias("right_"), n(ok & ~good).alias("false_keep"), n(~ok & good).alias("false_drop"))


@query(
    f"""SELECT source, kind, count(*) AS n, sum((reason IS NOT NULL)::INT)::BIGINT AS dropped FROM (SELECT source, CASE WHEN regexp_matches(t, 'def |class |import ') THEN 'code' ELSE 'prose' END AS kind,
        CASE WHEN length(t) < 300 THEN 'too_short' WHEN {literal("t", "�")} > 0 THEN 'broken' END AS reason FROM ({T_})) GROUP BY GROUPING SETS ((source), (kind))"""
)
def hard_scan(spark, sf_dir):
    """Hard reasons of all rows, by source and by profile in one pass."""
    t = X.text_or_empty(F.col("text"))
    kind = F.when(F.regexp_like(t, F.lit("def |class |import ")), "code").otherwise("prose")
    reason = rules.first_reason([("too_short", F.length(t) < 300), ("broken", X.count_text(t, "�") > 0)])
    df = docs(spark, sf_dir).select("source", kind.alias("kind"), reason.isNotNull().cast("int").alias("d"))
    return df.groupingSets([["source"], ["kind"]], "source", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("dropped"))


def ready(spark, checks: dict[str, DataFrame]) -> DataFrame:
    """name, ok, whole: a check is a one-row DataFrame of a boolean; the gate is open if all are true."""
    rows = None
    for name, check in checks.items():
        one = check.select(F.lit(name).alias("name"), F.coalesce(F.col(check.columns[0]), F.lit(False)).alias("ok"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.crossJoin(F.broadcast(rows.agg(F.bool_and("ok").alias("whole"))))


@query(
    f"""WITH c AS (SELECT 'documents' AS name, count(*) > 0 AS ok FROM documents UNION ALL SELECT 'labelled', count(*) >= 10 FROM labels UNION ALL
        SELECT 'no_leak', count(*) = 0 FROM (SELECT sha256(lower({FLAT})) AS k FROM documents) JOIN (SELECT sha256(lower({FLAT})) AS k FROM benchmark) USING (k))
        SELECT name, ok, (SELECT bool_and(ok) FROM c) AS whole FROM c"""
)
def readiness(spark, sf_dir):
    """Tables there, labels enough, no benchmark item in the corpus."""
    leaks = joins.leaks(docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), X.text_key)
    return ready(
        spark,
        {
            "documents": docs(spark, sf_dir).agg(F.count(F.lit(1)) > 0), "labelled": table(spark, sf_dir, "labels").agg(F.count(F.lit(1)) >= 10), "no_leak": leaks.agg(F.count(F.lit(1)) == 0),
        },
    )


# -- signals ---------------------------------------------------------------------------------------------------------
# Phrases of web pages, of shops, and of adult and gambling sites.
WEB = (
    "(?i)zwei klicks f(ü|u)r mehr datenschutz|teilen-button|verfassen sie die erste bewertung|erste bewertung verfassen|bewertung verfassen|newsletter abonnieren|cookie-einstellungen|alle preise inkl|"
    "gratis versand|jetzt kaufen|in den warenkorb|warenkorb|lieferzeit|weiterlesen[ ]+[A-ZÄÖÜ0-9]|read more|facebook,[ ]*google\\+|twitter senden|bitte f(ü|u)llen sie [^\\n]*formular|kein rechtsanspruch"
)
COMMERCIAL = (
    "(?i)about us|ueber uns|über uns|impressum|kontaktformular|agb|allgemeine geschaeftsbedingungen|allgemeine geschäftsbedingungen|datenschutzerklaerung|datenschutzerklärung|versandkosten|versand und zahlung|"
    "lieferung und zahlung|preisvergleich|rabattcode|gutschein|warenkorb|checkout|produktbeschreibung|kunden kauften auch|trusted shops|bewertungen? schreiben|erotik,[ ]*wohlbefinden|"
    "wellness,[ ]*partnerschaft|singleboerse|singlebörse"
)
ADULT = (
    "(?i)online casino|casino bonus|slot machine|sportwetten|porn(o|hub)?|xxx|sexkontakte|escort|cams? live|nackte|erotik[ ]+chat|onlyfans|bitcoin casino|krypto casino|no deposit bonus|free spins|jackpot|"
    "roulette|blackjack"
)
OLD_PRINT = (
    "(?i)(^|[^\\p{L}])(thun|thats(a|ä)ch|th(e|a)il|selb(st|ige)n?|verh(a|ä)ltni|ge[ ]+stellt|be[ ]+stimm|ent[ ]+sch|ver[ ]+fahr|Verzeichni(ß|ss)|Ueber|Gesetzsammlung|Amtsblatt|Abtheilung|"
    "Civilproze(ß|ss)|Verwaltungsgericht)|[□�]|Å¿"
)
SPEAKER = "(^|[^A-Za-zÄÖÜäöüß])([A-ZÄÖÜ]{3,}( [A-ZÄÖÜ]{3,}){0,2})\\."
BREAKS, SPACED = "[A-Za-zÄÖÜäöüß]{2,}-[ \\n]+[A-Za-zÄÖÜäöüß]{2,}", "(^|[^\\p{L}\\p{N}_])[A-Za-zÄÖÜäöüß]{2,}[ ]+[A-Za-zÄÖÜäöüß]{1,3}[ ]+[A-Za-zÄÖÜäöüß]{2,}"


@query(
    f"""SELECT doc_id, {n_of("t", WEB)}::INT AS web, {n_of("t", COMMERCIAL)}::INT AS commercial, {n_of("t", ADULT)}::INT AS adult,
        ({n_of("h", OLD_PRINT)} + least({n_of("h", BREAKS)}, 6) + least({n_of("h", SPACED)} // 8, 6))::INT AS old_print, len(sp)::INT AS speakers, len(list_distinct(sp))::INT AS unique_speakers, {SUSPECT} AS suspect,
        (coalesce(list_sum(list_transform(regexp_extract_all(t, '(https?://|www\\.)[^ \\t\\n\\x0B\\f\\r]+'), lambda x: length(x))), 0)::DOUBLE / greatest(1, length(t))) AS url_share,
        len(list_filter(tok, lambda x: regexp_matches(x, '\\p{{L}}')))::DOUBLE / greatest(1, len(tok)) AS worded_share
        FROM (SELECT doc_id, t, substr(t, 1, 20000) AS h, regexp_extract_all(substr(t, 1, 20000), '{SPEAKER}', 2) AS sp, list_filter(string_split({FLAT.replace("coalesce(text, '')", "t")}, ' '), lambda x: x <> '') AS tok FROM ({T_}))"""
)
def noise_signals(spark, sf_dir):
    """Phrases of pages, shops and spam; old print; speakers; damaged bytes; shares of addresses and of words."""
    t, h = F.col("t"), F.col("h")
    df = docs(spark, sf_dir).select("doc_id", X.text_or_empty(F.col("text")).alias("t")).select("doc_id", "t", F.substring("t", 1, 20_000).alias("h"))
    df = df.select("doc_id", "t", "h", F.regexp_extract_all("h", F.lit(SPEAKER), F.lit(2)).alias("sp"), X.tokens(t).alias("tok"), F.regexp_extract_all("t", F.lit("(https?://|www\\.)[^ \\t\\n\\x0B\\f\\r]+"), F.lit(0)).alias("u"))
    old = X.count_of(h, OLD_PRINT) + F.least(X.count_of(h, BREAKS), F.lit(6)) + F.least(F.floor(X.count_of(h, SPACED) / 8), F.lit(6))
    return df.select(
        "doc_id", X.count_of(t, WEB).alias("web"), X.count_of(t, COMMERCIAL).alias("commercial"), X.count_of(t, ADULT).alias("adult"), old.cast("int").alias("old_print"), F.size("sp").alias("speakers"),
        F.size(F.array_distinct("sp")).alias("unique_speakers"), suspect(t).alias("suspect"), (F.aggregate("u", F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.lit(1), F.length("t"))).alias("url_share"),
        (F.size(F.filter("tok", lambda x: F.regexp_like(x, F.lit("\\p{L}")))) / F.greatest(F.lit(1), F.size("tok"))).alias("worded_share"),
    )


@query(
    f"""SELECT doc_id, (len(l) - len(list_distinct(l)))::DOUBLE / greatest(1, len(l)) AS repeated_lines, (len(p) - len(list_distinct(p)))::DOUBLE / greatest(1, len(p)) AS repeated_paragraphs,
        len(regexp_extract_all(t, '[ \\t\\n\\x0B\\f\\r]'))::DOUBLE / greatest(1, length(t)) AS white, len(regexp_extract_all(t, '[0-9]'))::DOUBLE / greatest(1, length(t)) AS numbers,
        len(list_filter(l, lambda x: regexp_matches(x, '[.!?"]\\z')))::DOUBLE / greatest(1, len(l)) AS end_marks, len(regexp_extract_all(t, '[()]'))::DOUBLE / greatest(1, length(t)) AS parentheses,
        len(regexp_extract_all(t, '[#…]|\\.\\.\\.'))::DOUBLE / greatest(1, len(w)) AS signs_a_word, coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 0.0) AS mean_word
        FROM (SELECT doc_id, t, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l, list_filter(list_transform(string_split(t, repeat(chr(10), 2)), lambda x: trim(x)), lambda x: x <> '') AS p,
        {WORDS.replace("coalesce(text, '')", "t")} AS w FROM ({T_}))"""
)
def layout_signals(spark, sf_dir):
    """More curator signals: repeated lines and paragraphs, white space, numbers, end marks, brackets, signs, word length."""
    t = F.col("t")
    parts = lambda sep: F.filter(F.transform(F.split("t", sep), lambda x: F.trim(x)), lambda x: x != "")
    df = docs(spark, sf_dir).select("doc_id", X.text_or_empty(F.col("text")).alias("t")).select("doc_id", "t", parts("\n").alias("l"), parts("\n\n").alias("p"), X.words(t).alias("w"))
    share = lambda a, b: a / F.greatest(F.lit(1), b)
    again = lambda a: share(F.size(a) - F.size(F.array_distinct(a)), F.size(a))
    n = F.length("t")
    mean = F.when(F.size("w") > 0, F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) / F.size("w")).otherwise(F.lit(0.0))
    return df.select(
        "doc_id", again("l").alias("repeated_lines"), again("p").alias("repeated_paragraphs"), share(X.count_of(t, "[ \\t\\n\\x0B\\f\\r]"), n).alias("white"), share(X.count_of(t, "[0-9]"), n).alias("numbers"),
        share(F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit('[.!?"]\\z')))), F.size("l")).alias("end_marks"), share(X.count_of(t, "[()]"), n).alias("parentheses"),
        share(X.count_of(t, "[#…]|\\.\\.\\."), F.size("w")).alias("signs_a_word"), mean.alias("mean_word"),
    )


@query("SELECT lang, bits, max(bits) OVER () / min(bits) OVER () AS gap FROM (SELECT lang, 1.5 * sum(1 + len(regexp_extract_all(text, '" + X.TOKEN_ESTIMATE + "')))::DOUBLE / sum(strlen(text)) / ln(2) AS bits FROM documents WHERE text IS NOT NULL GROUP BY lang)")
def bits_per_byte(spark, sf_dir):
    """A loss of 1.5 nats a token as bits a byte by language, and the gap between the worst and the best."""
    df = docs(spark, sf_dir).where("text IS NOT NULL").groupBy("lang").agg((F.lit(1.5) * F.sum(X.token_estimate("text")) / F.sum(F.octet_length("text")) / math.log(2)).alias("bits"))
    gap = df.agg((F.max("bits") / F.min("bits")).alias("gap"))
    return df.crossJoin(F.broadcast(gap))


# -- rewrites --------------------------------------------------------------------------------------------------------
FORUM_PLAIN = "coalesce({0}, '')"
for _a, _b in structure.ENTITIES:
    FORUM_PLAIN = f"replace({FORUM_PLAIN}, '{_a}', {text_sql(_b)})"
for _p, _n in (
    (r"\r\n?", "chr(10)"), (r"\x00", "''"), (r"\x{{200B}}", "' '"), (r"(^|\n)[ \t]*>[^\n]*", r"'\1'"), (r"\[[^\]]{{1,120}}\]\((https?://|www\.)[^)]+\)", "''"), (r"[ \t]{{2,}}", "' '"), (r"\n{{3,}}", "repeat(chr(10), 2)"),
    (r"\A[ \t\n]+|[ \t\n]+\z", "''"),
):
    FORUM_PLAIN = f"regexp_replace({FORUM_PLAIN}, '{_p}', {_n}, 'g')"


@query(f"SELECT conv_id, turn, {FORUM_PLAIN.format('text')} AS text FROM conversations")
def forum_text(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", structure.forum_plain(F.col("text")).alias("text"))


@query(f"SELECT conv_id, len(list_filter(m, lambda x: trim(x.text) <> ''))::INT AS turns FROM ({CHAT})")
def dialogue_turns(spark, sf_dir):
    """Turns read back from one text by their ``author:`` marks."""
    whole = F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), F.regexp_replace(x["text"], "[:\\x01\\x02]", " "))), "\n")
    return chats(spark, sf_dir).select("conv_id", F.size(structure.turns(whole)).alias("turns"))


@query(f"SELECT conv_id, turn, trim(prompt) AS prompt, trim(answer) AS preferred FROM ({QA_DOCS})")
def preference_pairs(spark, sf_dir):
    """Dialogues as text, split at the last question."""
    text = F.concat(F.lit("\n\nHuman: hi\n\nAssistant: hello\n\nHuman: "), F.col("prompt"), F.lit("\n\nAssistant: "), F.col("answer"))
    df = qa_docs(spark, sf_dir).select("conv_id", "turn", structure.preference(text, text).alias("p"))
    return df.select("conv_id", "turn", "p.prompt", "p.preferred")


@query(f"SELECT conv_id, turn, 'Problem: ' || prompt || chr(10) || 'Loesung: ' || answer AS math, '<|im_start|>user' || chr(10) || prompt || '<|im_end|>' AS chatml FROM ({QA_DOCS})")
def rendered_records(spark, sf_dir):
    """A problem with its solution, and a turn of markup that other tools read."""
    return qa_docs(spark, sf_dir).select(
        "conv_id", "turn", F.concat(F.lit("Problem: "), F.col("prompt"), F.lit("\nLoesung: "), F.col("answer")).alias("math"), F.concat(F.lit("<|im_start|>user\n"), F.col("prompt"), F.lit("<|im_end|>")).alias("chatml")
    )


@query(f"SELECT conv_id, len(m)::INT AS turns, array_to_string(list_transform(m, lambda x: x.role), ',') AS roles FROM ({CHAT})")
def markup_turns(spark, sf_dir):
    """Turns read from markup with start and end marks."""
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<|im_start|>"), x["role"], F.lit("\n"), x["text"], F.lit("<|im_end|>"))), "\n")
    found = F.regexp_extract_all(text, F.lit("(?s)<\\|im_start\\|>([a-z]+)\\n.*?<\\|im_end\\|>"), F.lit(1))
    return chats(spark, sf_dir).select("conv_id", F.size(found).alias("turns"), F.array_join(found, ",").alias("roles"))


# -- duplicates, samples, unions -------------------------------------------------------------------------------------
@query("SELECT source, count(*) AS n, 1 - count(DISTINCT substr(coalesce(text, ''), 1, 64))::DOUBLE / count(*) AS repeated FROM documents GROUP BY source")
def prefix_repeats(spark, sf_dir):
    """The share of rows whose beginning stood before in the source: counted, not sampled."""
    df = docs(spark, sf_dir).select("source", F.sha2(F.substring(X.text_or_empty(F.col("text")), 1, 64), 256).alias("k"))
    by = df.groupBy("source", "k").agg(F.count(F.lit(1)).alias("n")).groupBy("source").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("u"))
    return by.select("source", "n", (1 - F.col("u") / F.col("n")).alias("repeated"))


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY sha256(lower({FLAT})) ORDER BY doc_id) AS c FROM documents) WHERE c = 1) WHERE r <= 20")
def unique_with_cap(spark, sf_dir):
    """First of equal texts, at most twenty of a source."""
    first = dedup.first_of_each(docs(spark, sf_dir).select("doc_id", "source", X.text_key(F.col("text")).alias("k")), F.col("k")).where("kept")
    return dedup.capped(first, F.col("source"), [F.col("doc_id")], 20).select("doc_id", "source")


@query(f"SELECT doc_id, kept FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(lower({FLAT})) ORDER BY lang DESC, doc_id) = 1 AS kept FROM documents)")
def ranked_source_dedup(spark, sf_dir):
    """First of equal texts by the sources' rank, then by id."""
    df = docs(spark, sf_dir).select("doc_id", "lang", X.text_key(F.col("text")).alias("k"))
    return dedup.ranked(df, [F.col("k")], [F.desc("lang"), F.col("doc_id")]).select("doc_id", (F.col("rank") == 1).alias("kept"))


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('s7|' || doc_id)) AS r FROM documents) WHERE r <= 5")
def line_sample(spark, sf_dir):
    """Five rows of each source by a keyed hash: the same on each run, without a bias for long lines."""
    return ordering.hash_sample(docs(spark, sf_dir).select("source", "doc_id"), ["source"], 5, "s7", F.col("doc_id").cast("string")).select("source", "doc_id")


@query("SELECT doc_id, 'good' AS part FROM documents JOIN labels USING (doc_id) WHERE quality = 1 UNION ALL SELECT doc_id, 'rest' FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def concatenated(spark, sf_dir):
    d, good = docs(spark, sf_dir).select("doc_id"), table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return d.join(good, "doc_id").withColumn("part", F.lit("good")).unionByName(d.join(good, "doc_id", "left_anti").withColumn("part", F.lit("rest")))


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND toxic = 1) AND source <> ''")
def holdout_rows(spark, sf_dir):
    """What isn't held out, by (source, row)."""
    d = docs(spark, sf_dir).select("doc_id", "source").where("source <> ''")
    held = d.join(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return joins.without(d, held, ["source", "doc_id"])


@query(f"SELECT conv_id, turn FROM ({QA_DOCS}) q WHERE NOT EXISTS (SELECT 1 FROM (SELECT lower(trim(prompt)) AS p FROM ({QA_DOCS}) WHERE conv_id % 5 = 0) b WHERE b.p = lower(trim(q.prompt)))")
def blocked_prompts(spark, sf_dir):
    """Pairs whose exact prompt is on no block list."""
    qa = qa_docs(spark, sf_dir).withColumn("p", F.lower(F.trim("prompt")))
    return joins.without(qa, qa.where("conv_id % 5 = 0"), ["p"]).select("conv_id", "turn")


@query(f"SELECT doc_id, score FROM ({SCORED}) WHERE score BETWEEN 2 AND 3 ORDER BY doc_id LIMIT 40")
def review_band(spark, sf_dir):
    """The first forty of a band of scores."""
    return scored(spark, sf_dir).where(F.col("score").between(2, 3)).select("doc_id", "score").orderBy("doc_id").limit(40)


@query(f"SELECT doc_id, flags, len(list_intersect(flags, ['short', 'odd']))::INT AS hard FROM (SELECT doc_id, list_filter([CASE WHEN length(t) < 300 THEN 'short' END, CASE WHEN doc_id % 2 = 1 THEN 'odd' END, CASE WHEN contains(t, chr(10)) THEN 'lines' END], lambda x: x IS NOT NULL) AS flags FROM ({T_}))")
def flag_intersection(spark, sf_dir):
    t = X.text_or_empty(F.col("text"))
    flags = rules.all_reasons([("short", F.length(t) < 300), ("odd", F.col("doc_id") % 2 == 1), ("lines", F.contains(t, F.lit("\n")))])
    return docs(spark, sf_dir).select("doc_id", flags.alias("flags")).select("doc_id", "flags", F.size(F.array_intersect("flags", F.array(F.lit("short"), F.lit("odd")))).alias("hard"))


@query("SELECT shard, rank, count(*) AS n, sum(length(coalesce(text, '')))::BIGINT AS chars FROM (SELECT *, doc_id // 64 AS shard, (doc_id // 64) % 4 AS rank FROM documents) GROUP BY ALL")
def rank_shards(spark, sf_dir):
    """Windows of 64 rows dealt to four ranks."""
    shard = F.floor(F.col("doc_id") / 64)
    return docs(spark, sf_dir).groupBy(shard.alias("shard"), (shard % 4).alias("rank")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(X.text_or_empty(F.col("text")))).alias("chars"))


def allocated(weights: dict[str, float], rows: int, batches: int) -> list[tuple[int, str, int]]:
    """(batch, source, rows): whole rows by weight; what rounding owes a source is its credit, and the largest goes first."""
    total, credit, out = sum(weights.values()), dict.fromkeys(weights, 0.0), []
    for b in range(batches):
        for s, w in weights.items():
            credit[s] += rows * w / total
        given = {s: int(max(0.0, c)) for s, c in credit.items()}
        for s in sorted(weights, key=lambda s: (given[s] - credit[s], s))[: rows - sum(given.values())]:
            given[s] += 1
        for s, n in given.items():
            credit[s] -= n
            out.append((b, s, n))
    return out


@query()
def batch_allocation(spark, sf_dir):
    """Rows of each language in ten batches of 32, by its documents: a fold over a few sources, tested by its sums."""
    sizes = {r["lang"] or "": float(r["n"]) for r in docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").collect()}
    return spark.createDataFrame(allocated(sizes, 32, 10), "batch long, source string, n long")


@query("SELECT a, op, b, CASE op WHEN 0 THEN a + b WHEN 1 THEN a - b ELSE a * b END AS result FROM (SELECT (i // 30)::BIGINT AS a, (i % 30 // 3 + 1)::BIGINT AS b, (i % 3)::BIGINT AS op FROM (SELECT unnest(range(900)) AS i))")
def arithmetic_examples(spark, sf_dir):
    """Made examples of sums, differences and products."""
    i = F.col("id")
    df = spark.range(900).select(F.floor(i / 30).alias("a"), (F.floor(i % 30 / 3) + 1).alias("b"), (i % 3).alias("op"))
    return df.withColumn("result", F.when(F.col("op") == 0, F.col("a") + F.col("b")).when(F.col("op") == 1, F.col("a") - F.col("b")).otherwise(F.col("a") * F.col("b")))


def combined(df: DataFrame, metrics: dict) -> DataFrame:
    """Adds each metric (name -> function from the DataFrame to a Column); one that can't be planned is null, with its name in ``failed``.

    A metric that fails on single rows should be built of ``try_`` functions.
    """
    failed = []
    for name, make in metrics.items():
        try:
            new = df.withColumn(name, make(df))
            new.schema  # noqa: B018  planned here, so that a bad one is told apart
            df = new
        except Exception:
            failed.append(name)
            df = df.withColumn(name, F.lit(None).cast("double"))
    return df.withColumn("failed", F.array(*map(F.lit, failed)).cast("array<string>"))


#: Benchmarks by name: a query, or None where there is no runner.
RUNNERS = {"token_f1": "token_f1", "last_number": "last_number_match", "choice": "argmax_accuracy", "code": None}


def run_benchmark(spark, sf_dir, name: str) -> DataFrame | None:
    """The rows of a benchmark's query; None for one that has no runner, an error for an unknown name."""
    from corpusloom.plans import registry

    found = RUNNERS[name]
    return None if found is None else registry.queries()[found](spark, sf_dir)


