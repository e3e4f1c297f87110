"""Queries over the documents table: features, gates, classes, duplicates, budgets, splits, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X
from corpusloom.operators import dedup, ordering, rules
from corpusloom.plans.registry import query
from corpusloom.sources.text_sources import spread_out

# -- pieces of the SQL twins -----------------------------------------------------------------------------------------
S = r"[ \t\n\x0B\f\r]+"
FLAT = rf"trim(regexp_replace(coalesce(text, ''), '{S}', ' ', 'g'))"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{X.WORD}')"
LOW_WORDS = f"regexp_extract_all(lower(coalesce(text, '')), '{X.WORD}')"
FOLD = "replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"
FOLD_WORDS = f"regexp_extract_all({FOLD.format("coalesce(text, '')")}, '{X.WORD}')"
LINE_BYTES = "(strlen(coalesce(text, '')) + 1)"


def n_of(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def literal(text: str, needle: str) -> str:
    return f"((length({text}) - length(replace({text}, '{needle}', ''))) // {len(needle)})"


def lost(array: str, least: int = 1) -> str:
    return f"CASE WHEN len({array}) < {least} THEN 0.0::DOUBLE ELSE 1 - len(list_distinct({array}))::DOUBLE / len({array}) END"


def grams(array: str, n: int = 4, least: int = 16) -> str:
    g = f"list_transform(range(1, len({array}) - {n} + 2), lambda i: array_to_string({array}[i : i + {n - 1}], ' '))"
    return f"CASE WHEN len({array}) < {least} THEN 0.0::DOUBLE ELSE 1 - len(list_distinct({g}))::DOUBLE / len({g}) END"


def quoted(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def any_in(text: str, phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def hits(array: str, vocabulary: tuple[str, ...]) -> str:
    return f"len(list_filter({array}, lambda w: list_contains({quoted(vocabulary)}, w)))"


ALPHA, DIGIT, SYMBOL = r"\p{L}", r"\p{Nd}", r"[^\p{L}\p{N}\s]"
LIST_SCORE = (
    "({0} + {1} + {2} + {3})".format(
        n_of("t", r"(^|[ \t\n\x0B\f\r])([-*•]|[0-9]{1,3}[.)])[ \t\n\x0B\f\r]+"),
        n_of("t", r"[0-9]{1,4}[ \t\n\x0B\f\r]*(\.{2,}|…|—|-)[ \t\n\x0B\f\r]*[0-9]{1,5}"),
        literal("t", " | "),
        "(length(t) - length(replace(t, chr(9), '')))",
    )
)
MOJIBAKE = "(" + " + ".join([*(literal("t", h) for h in X.MOJIBAKE_HINTS), "3 * " + literal("t", "�")]) + ")"


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread_out(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The column by name: a Column would need a session when the module is imported.
TEXT = "text"


# -- features --------------------------------------------------------------------------------------------------------
@query(
    f"""SELECT doc_id, {n_of("coalesce(text, '')", ALPHA)}::DOUBLE / greatest(1, length(text)) AS alpha,
        {n_of("coalesce(text, '')", DIGIT)}::DOUBLE / greatest(1, length(text)) AS digit,
        {n_of("coalesce(text, '')", SYMBOL)}::DOUBLE / greatest(1, length(text)) AS symbol FROM documents"""
)
def doc_ratios(spark, sf_dir):
    n = F.greatest(F.lit(1), F.length("text"))
    return docs(spark, sf_dir).select(
        "doc_id", (X.alpha_count(TEXT) / n).alias("alpha"), (X.digit_count(TEXT) / n).alias("digit"), (X.symbol_count(TEXT) / n).alias("symbol")
    )


@query(
    f"""SELECT doc_id, len(tok)::INT AS n_tokens, CASE WHEN len(tok) = 0 THEN 0.0::DOUBLE ELSE
        len(list_filter(tok, lambda x: starts_with(x, 'http://') OR starts_with(x, 'https://') OR starts_with(x, 'www.')))::DOUBLE / len(tok) END AS url_share
        FROM (SELECT doc_id, list_filter(string_split({FLAT}, ' '), lambda x: x <> '') AS tok FROM documents)"""
)
def url_density(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.tokens(TEXT).alias("tok"))
    urls = F.size(F.filter("tok", lambda x: F.regexp_like(x, F.lit("^(https?://|www\\.)"))))
    return df.select("doc_id", F.size("tok").alias("n_tokens"), X.ratio(urls, F.size("tok")).alias("url_share"))


@query(
    f"""SELECT doc_id, {lost("tok")} AS by_token, {lost("w", 50)} AS by_word FROM
        (SELECT doc_id, list_filter(string_split({FLAT}, ' '), lambda x: x <> '') AS tok, {FOLD_WORDS} AS w FROM documents)"""
)
def token_repetition(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.tokens(TEXT).alias("tok"), X.words(X.ascii_fold(TEXT)).alias("w"))
    return df.select("doc_id", X.distinct_share_lost(F.col("tok")).alias("by_token"), X.distinct_share_lost(F.col("w"), 50).alias("by_word"))


@query(f"SELECT doc_id, {grams('w')} AS four, {grams('w', 3, 6)} AS three FROM (SELECT doc_id, {LOW_WORDS} AS w FROM documents)")
def ngram_repetition(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.words(F.lower("text")).alias("w"))
    w = F.col("w")
    return df.select("doc_id", X.ngram_repetition(w).alias("four"), X.ngram_repetition(w, 3, 6).alias("three"))


@query(
    f"""SELECT doc_id, de::INT AS de_hits, en::INT AS en_hits, signal,
        CASE WHEN n < 30 THEN false WHEN lang = 'de' THEN (de >= 6 AND de >= en * 1.1) OR (uml >= 2 AND de >= en)
             WHEN lang = 'en' THEN en >= 6 AND en >= de * 1.1 ELSE true END AS language_ok
        FROM (SELECT doc_id, lang, len(w) AS n, {hits("w", X.GERMAN_HITS)} AS de, {hits("w", X.ENGLISH_HITS)} AS en, uml,
              {hits("w2", X.GERMAN_STOPWORDS)}::DOUBLE / greatest(1, len(w2)) AS signal
              FROM (SELECT doc_id, lang, {FOLD_WORDS} AS w, {LOW_WORDS} AS w2, {n_of("lower(coalesce(text, ''))", "[äöüß]")} AS uml FROM documents))"""
)
def stopword_language(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", "lang", F.lower("text").alias("low"), X.words(X.ascii_fold(TEXT)).alias("w"), X.words(F.lower("text")).alias("w2"))
    signal = X.hits_in(F.col("w2"), X.GERMAN_STOPWORDS) / F.greatest(F.lit(1), F.size("w2"))
    return df.select(
        "doc_id",
        X.hits_in(F.col("w"), X.GERMAN_HITS).alias("de_hits"),
        X.hits_in(F.col("w"), X.ENGLISH_HITS).alias("en_hits"),
        signal.alias("signal"),
        rules.language_ok(F.col("low"), F.col("w"), F.col("lang")).alias("language_ok"),
    )


@query(f"SELECT doc_id, {MOJIBAKE}::INT AS score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def mojibake_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.mojibake_score(TEXT).cast("int").alias("score"))


@query(
    """SELECT doc_id, len(l)::INT AS n_lines, len(list_filter(l, lambda x: length(x) > 240))::INT AS long_lines,
       list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / len(l) AS mean_length
       FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)"""
)
def line_stats(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.lines(TEXT).alias("l"))
    total = F.aggregate(F.transform("l", F.length), F.lit(0), lambda a, b: a + b)
    long = F.size(F.filter("l", lambda x: F.length(x) > 240))
    return df.select("doc_id", F.size("l").alias("n_lines"), long.alias("long_lines"), (total / F.size("l")).alias("mean_length"))


@query(
    """SELECT d.doc_id, coalesce(m, 0)::INT AS repeats FROM documents d LEFT JOIN
       (SELECT doc_id, max(n) AS m FROM (SELECT doc_id, x, count(*) AS n FROM
         (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS x FROM documents) WHERE x <> '' GROUP BY doc_id, x) GROUP BY doc_id) r
       ON r.doc_id = d.doc_id"""
)
def max_line_repeat(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.max_line_repeat(TEXT).alias("repeats"))


@query(f"SELECT doc_id, {LIST_SCORE}::INT AS score FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def list_score(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.list_score(TEXT).cast("int").alias("score"))


@query(
    f"""SELECT doc_id, {hits("w", ("the", "of", "and"))}::INT AS en, {hits("w", ("der", "die", "das"))}::INT AS de,
        len(list_filter({WORDS}, lambda x: upper(x) = x AND length(x) > 1))::DOUBLE / greatest(1, len(w)) AS caps_share
        FROM (SELECT doc_id, text, {LOW_WORDS} AS w FROM documents)"""
)
def keyword_hits(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.words(TEXT).alias("raw"), X.words(F.lower("text")).alias("w"))
    caps = F.size(F.filter("raw", lambda x: (F.upper(x) == x) & (F.length(x) > 1)))
    return df.select(
        "doc_id",
        X.hits_in(F.col("w"), ("the", "of", "and")).alias("en"),
        X.hits_in(F.col("w"), ("der", "die", "das")).alias("de"),
        (caps / F.greatest(F.lit(1), F.size("w"))).alias("caps_share"),
    )


METRICS = f"""SELECT doc_id, length(t) AS chars, len(w) AS words, len(list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '')) AS paragraphs,
    len(regexp_extract_all(t, '[.!?]+([ \\t\\n\\x0B\\f\\r]|$)')) AS sentences,
    {n_of("t", ALPHA)}::DOUBLE / greatest(1, length(t)) AS alpha, {n_of("t", SYMBOL)}::DOUBLE / greatest(1, length(t)) AS symbol,
    {n_of("t", DIGIT)}::DOUBLE / greatest(1, length(t)) AS digit, {grams("lw", 4, 8)} AS repetition,
    {hits("lw", X.GERMAN_STOPWORDS)}::DOUBLE / greatest(1, len(lw)) AS language,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE / greatest(1, len(w)) AS word_length
    FROM (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, {LOW_WORDS} AS lw FROM documents)"""


def metrics(spark, sf_dir) -> DataFrame:
    df = docs(spark, sf_dir).select("doc_id", X.text_or_empty(TEXT).alias("t"))
    df = df.withColumn("w", X.words(F.col("t"))).withColumn("lw", X.words(F.lower("t")))
    t, w, n = F.col("t"), F.col("w"), F.greatest(F.lit(1), F.length("t"))
    return df.select(
        "doc_id",
        F.length("t").cast("long").alias("chars"),
        F.size("w").cast("long").alias("words"),
        F.size(F.filter(X.lines(t), lambda x: F.trim(x) != "")).cast("long").alias("paragraphs"),
        X.count_of(t, "[.!?]+([ \\t\\n\\x0B\\f\\r]|$)").cast("long").alias("sentences"),
        (X.alpha_count(t) / n).alias("alpha"),
        (X.symbol_count(t) / n).alias("symbol"),
        (X.digit_count(t) / n).alias("digit"),
        X.ngram_repetition(F.col("lw"), 4, 8).alias("repetition"),
        (X.hits_in(F.col("lw"), X.GERMAN_STOPWORDS) / F.greatest(F.lit(1), F.size("lw"))).alias("language"),
        (F.aggregate(F.transform(w, F.length), F.lit(0), lambda a, b: a + b) / F.greatest(F.lit(1), F.size("w"))).alias("word_length"),
    )


query(METRICS, "doc_metrics")(metrics)

QUALITY = """greatest(0.0, least(1.0, 1.0 - (0.0 + CASE WHEN words < 80 THEN 0.25 ELSE 0 END + CASE WHEN sentences < 3 THEN 0.2 ELSE 0 END
    + CASE WHEN alpha < 0.55 THEN 0.2 ELSE 0 END + CASE WHEN symbol > 0.18 THEN least(0.25, (symbol - 0.18) * 1.5) ELSE 0 END
    + CASE WHEN digit > 0.25 THEN 0.15 ELSE 0 END + CASE WHEN repetition > 0.18 THEN least(0.35, repetition) ELSE 0 END
    + CASE WHEN language < 0.035 THEN 0.18 ELSE 0 END + CASE WHEN word_length BETWEEN 3.0 AND 10.5 THEN 0 ELSE 0.08 END)))"""


@query(f"SELECT doc_id, floor({QUALITY} * 1000 + 0.0001)::BIGINT AS permille FROM ({METRICS})")
def quality_score(spark, sf_dir):
    m = [F.col(c) for c in ("words", "sentences", "alpha", "symbol", "digit", "repetition", "language", "word_length")]
    return metrics(spark, sf_dir).select("doc_id", F.floor(rules.quality_score(*m) * 1000 + 0.0001).cast("long").alias("permille"))


@query(
    f"""SELECT doc_id, n::BIGINT AS tokens_estimate, strlen(t)::DOUBLE / n AS bytes_per_token, n * 100.0 / greatest(1, len(w)) AS tokens_per_100_words
        FROM (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w, 1 + {n_of("coalesce(text, '')", X.TOKEN_ESTIMATE)} AS n FROM documents)"""
)
def token_economy(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.token_estimate(TEXT).alias("n"), F.octet_length("text").alias("b"), F.size(X.words(TEXT)).alias("w"))
    return df.select(
        "doc_id", F.col("n").alias("tokens_estimate"), (F.col("b") / F.col("n")).alias("bytes_per_token"), (F.col("n") * 100.0 / F.greatest(F.lit(1), F.col("w"))).alias("tokens_per_100_words")
    )


@query(f"SELECT doc_id, sha256(lower({FLAT})) AS text_key, sha256(substr(coalesce(text, ''), 1, 500)) AS prefix_key FROM documents")
def text_hashes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.text_key(TEXT).alias("text_key"), X.prefix_key(TEXT, 500).alias("prefix_key"))


# -- gates and classes -----------------------------------------------------------------------------------------------
LIGHT = f"""SELECT doc_id, CASE
    WHEN n < lo THEN 'too_short' WHEN n > hi THEN 'too_long'
    WHEN {any_in("lower(t)", rules.BOILERPLATE)} THEN 'boilerplate'
    WHEN len(list_filter(tok, lambda x: regexp_matches(x, '^(https?://|www\\.)')))::DOUBLE / len(tok) > 0.20 THEN 'url_dense'
    WHEN {n_of("t", SYMBOL)}::DOUBLE / n > 0.35 THEN 'symbol_dense'
    WHEN {lost("tok")} > 0.60 THEN 'repetitive'
    WHEN {any_in("t", rules.LIGHT_MOJIBAKE)} THEN 'mojibake' END AS reason
    FROM (SELECT *, length(t) AS n, list_filter(string_split(t, ' '), lambda x: x <> '') AS tok, CASE WHEN lang = 'de' THEN 300 ELSE 200 END AS lo, 100000 AS hi
          FROM (SELECT doc_id, lang, trim(regexp_replace(replace(coalesce(text, ''), chr(13), ''), '{S}', ' ', 'g')) AS t FROM documents))"""


@query(LIGHT)
def quality_gate_reason(spark, sf_dir):
    return rules.light_gate(docs(spark, sf_dir))


@query(f"SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ({LIGHT}) GROUP BY 1")
def drop_reason_counts(spark, sf_dir):
    return rules.reason_counts(rules.light_gate(docs(spark, sf_dir)))


@query(
    f"""SELECT doc_id, reason, rank::INT AS rank FROM
        (SELECT doc_id, reason, row_number() OVER (PARTITION BY reason ORDER BY doc_id) AS rank FROM ({LIGHT}) WHERE reason IS NOT NULL) WHERE rank <= 5"""
)
def reject_samples(spark, sf_dir):
    return rules.reject_samples(rules.light_gate(docs(spark, sf_dir)), 5)


STRICT = f"""
WITH p(profile, min_chars, max_chars, min_alpha, max_symbol, max_repetition, max_ngram, max_digit, max_list) AS (VALUES
  ('prose', 200, 60000, 0.60::DOUBLE, 0.25::DOUBLE, 0.80::DOUBLE, 0.35::DOUBLE, 0.16::DOUBLE, 10),
  ('code', 80, 60000, 0.25::DOUBLE, 0.60::DOUBLE, 0.95::DOUBLE, 0.80::DOUBLE, 0.50::DOUBLE, 1000),
  ('math', 80, 60000, 0.30::DOUBLE, 0.60::DOUBLE, 0.90::DOUBLE, 0.60::DOUBLE, 0.50::DOUBLE, 1000)),
a AS (SELECT doc_id, lang, CASE WHEN source IN ('src3', 'src7') THEN 'code' WHEN source = 'src5' THEN 'math' ELSE 'prose' END AS profile,
        regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'),
                       '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM documents),
b AS (SELECT *, lower(t) AS low, regexp_extract_all({FOLD.format("t")}, '{X.WORD}') AS ws, length(t) AS n FROM a JOIN p USING (profile)),
c AS (SELECT *, {n_of("low", rules.TOC)} AS toc, {LIST_SCORE} AS lists, profile = 'prose' AS prose, {hits("ws", X.GERMAN_HITS)} AS de, {hits("ws", X.ENGLISH_HITS)} AS en,
        {n_of("low", "[äöüß]")} AS uml FROM b),
d AS (SELECT *, CASE WHEN n NOT BETWEEN min_chars AND max_chars THEN NULL WHEN regexp_matches(low, '{rules.CHAT}') THEN 'chat_marker'
        WHEN toc >= 2 OR (prose AND toc >= 1 AND lists >= 4) THEN 'toc_or_index'
        WHEN {n_of("low", rules.BIBLIOGRAPHY)} >= CASE WHEN prose THEN 3 ELSE 4 END THEN 'bibliography_or_metadata'
        WHEN prose AND lists >= max_list THEN 'list_or_table_heavy'
        WHEN prose AND {n_of("t", DIGIT)}::DOUBLE / n > max_digit THEN 'digit_dense'
        WHEN ({grams("ws")}) > max_ngram THEN 'repetitive_ngram' END AS structure FROM c)
SELECT doc_id, profile, coalesce(CASE WHEN n < min_chars THEN 'too_short' WHEN n > max_chars THEN 'too_long'
    WHEN structure IN ('chat_marker', 'toc_or_index') THEN structure WHEN {MOJIBAKE} > 0 THEN 'mojibake'
    WHEN regexp_matches(low, '{rules.HTML}') THEN 'html' WHEN {any_in("low", rules.BOILERPLATE)} THEN 'boilerplate'
    WHEN {n_of("low", rules.URL)} > 3 THEN 'url_dense' WHEN {n_of("t", ALPHA)}::DOUBLE / n < min_alpha THEN 'low_alpha'
    WHEN {n_of("t", SYMBOL)}::DOUBLE / n > max_symbol THEN 'symbol_dense' WHEN ({lost("ws", 50)}) > max_repetition THEN 'repetitive' END, structure,
    CASE WHEN NOT (CASE WHEN len(ws) < 30 THEN false WHEN lang = 'de' THEN (de >= 6 AND de >= en * 1.1) OR (uml >= 2 AND de >= en)
                        WHEN lang = 'en' THEN en >= 6 AND en >= de * 1.1 ELSE true END) THEN 'language_mismatch' END) AS reason FROM d"""


@query(STRICT)
def strict_gate_reason(spark, sf_dir):
    named = spark.createDataFrame([("src3", "code"), ("src7", "code"), ("src5", "math")], "source string, profile string")
    return rules.strict_gate(docs(spark, sf_dir), rules.profiles(spark), named)


AUDIT = f"""
WITH a AS (SELECT doc_id, source, t, lower(t) AS low, length(t) AS n, regexp_extract_all(lower(t), '{X.WORD}') AS ws
           FROM (SELECT doc_id, source, trim(coalesce(text, ''), ' ') AS t FROM documents)),
b AS (SELECT *, {n_of("low", rules.TOC)} AS toc, {LIST_SCORE} AS lists FROM a),
c AS (SELECT doc_id, source, n, len(ws) AS nw, list_filter([
  CASE WHEN n < 180 THEN 'too_short' END, CASE WHEN n > 50000 THEN 'very_long_doc' END, CASE WHEN regexp_matches(t, 'Ã.|Â.|â€|�') THEN 'mojibake' END,
  CASE WHEN regexp_matches(low, '{rules.HTML}') THEN 'html' END, CASE WHEN {n_of("low", rules.URL)} >= 3 THEN 'url_dense' END,
  CASE WHEN regexp_matches(low, '{rules.CHAT}') THEN 'chat_or_sft_marker' END,
  CASE WHEN regexp_matches(low, 'cookie|privacy policy|javascript|newsletter|subscribe|sign in|alle rechte vorbehalten') THEN 'boilerplate' END,
  CASE WHEN toc >= 2 OR (toc >= 1 AND lists >= 4) THEN 'toc_or_index' END, CASE WHEN {n_of("low", rules.BIBLIOGRAPHY)} >= 3 THEN 'bibliography_or_metadata' END,
  CASE WHEN {n_of("t", ALPHA)}::DOUBLE / n < 0.45 OR n = 0 THEN 'low_alpha' END, CASE WHEN {n_of("t", SYMBOL)}::DOUBLE / n > 0.22 THEN 'symbol_dense' END,
  CASE WHEN {n_of("t", DIGIT)}::DOUBLE / n > 0.16 THEN 'digit_dense' END, CASE WHEN ({lost("ws", 30)}) > 0.68 OR ({grams("ws")}) > 0.28 THEN 'repetitive' END,
  CASE WHEN lists >= 8 THEN 'list_or_table_heavy' END, CASE WHEN regexp_matches(t, '{rules.CODE}') THEN 'code_like' END,
  CASE WHEN regexp_matches(t, '{rules.MATH}') THEN 'math_like' END], lambda x: x IS NOT NULL) AS fl FROM b),
d AS (SELECT *, CASE WHEN list_has_any(fl, {quoted(rules.FALSE_LABELS)}) THEN 'trash' WHEN list_has_any(fl, {quoted(rules.REPAIRABLE)}) THEN 'repair'
     WHEN n >= 240 AND nw >= 35 THEN 'keep' ELSE 'repair' END AS quality FROM c)
"""


@query(AUDIT + "SELECT doc_id, quality, array_to_string(fl, ',') AS flags FROM d")
def keep_repair_trash(spark, sf_dir):
    return rules.audit(docs(spark, sf_dir)).select("doc_id", "quality", F.array_join("flags", ",").alias("flags"))


@query(
    AUDIT
    + """SELECT source, count(*) AS n, sum((quality = 'keep')::INT)::BIGINT AS keep, sum((quality = 'repair')::INT)::BIGINT AS repair, sum((quality = 'trash')::INT)::BIGINT AS trash,
       sum(n)::DOUBLE / count(*) AS mean_chars, sum(nw)::DOUBLE / count(*) AS mean_words FROM d GROUP BY source"""
)
def source_audit(spark, sf_dir):
    of = lambda q: F.sum((F.col("quality") == q).cast("int")).alias(q)
    mean = lambda c: (F.sum(c) / F.count(F.lit(1)))
    return rules.audit(docs(spark, sf_dir)).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), of("keep"), of("repair"), of("trash"), mean("n_chars").alias("mean_chars"), mean("n_words").alias("mean_words")
    )


@query(AUDIT + "SELECT source, flag, count(*) AS n FROM (SELECT source, unnest(fl) AS flag FROM d) GROUP BY GROUPING SETS ((source, flag), (flag), (source))")
def audit_grouping_sets(spark, sf_dir):
    # the outer form, since the filter that an inner one implies would be pushed down with all flags written out in it
    flags = rules.audit(docs(spark, sf_dir)).select("source", F.explode_outer("flags").alias("flag")).where("flag IS NOT NULL")
    return flags.groupingSets([["source", "flag"], ["flag"], ["source"]], "source", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    AUDIT
    + """SELECT source, CASE WHEN trash * 10 > n THEN 'reject' WHEN repair * 2 > n THEN 'repair_first' WHEN keep * 10 >= n * 7 THEN 'take' ELSE 'review' END AS advice FROM
       (SELECT source, count(*) AS n, sum((quality = 'keep')::INT) AS keep, sum((quality = 'repair')::INT) AS repair, sum((quality = 'trash')::INT) AS trash FROM d GROUP BY source)"""
)
def source_recommendation(spark, sf_dir):
    of = lambda q: F.sum((F.col("quality") == q).cast("int")).alias(q)
    df = rules.audit(docs(spark, sf_dir)).groupBy("source").agg(F.count(F.lit(1)).alias("n"), of("keep"), of("repair"), of("trash"))
    advice = F.when(F.expr("trash * 10 > n"), "reject").when(F.expr("repair * 2 > n"), "repair_first").when(F.expr("keep * 10 >= n * 7"), "take").otherwise("review")
    return df.select("source", advice.alias("advice"))


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(t, '(^|[^acgtACGT])[acgtACGT]{{40,}}') THEN 'dna' WHEN regexp_matches(t, '{rules.MATH}') THEN 'math'
        WHEN regexp_matches(t, '{rules.CODE}') THEN 'code' WHEN de > en AND de >= 3 THEN 'german' WHEN en > de AND en >= 3 THEN 'english' ELSE 'other' END AS domain
        FROM (SELECT doc_id, t, {hits("w", X.GERMAN_HITS)} AS de, {hits("w", X.ENGLISH_HITS)} AS en FROM (SELECT doc_id, coalesce(text, '') AS t, {FOLD_WORDS} AS w FROM documents))"""
)
def domain_class(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.text_or_empty(TEXT).alias("t"), X.words(X.ascii_fold(TEXT)).alias("w"))
    df = df.withColumn("de", X.hits_in(F.col("w"), X.GERMAN_HITS)).withColumn("en", X.hits_in(F.col("w"), X.ENGLISH_HITS))
    like = lambda p: F.regexp_like("t", F.lit(p))
    domain = F.when(like("(^|[^acgtACGT])[acgtACGT]{40,}"), "dna").when(like(rules.MATH), "math").when(like(rules.CODE), "code")
    domain = domain.when(F.expr("de > en AND de >= 3"), "german").when(F.expr("en > de AND en >= 3"), "english").otherwise("other")
    return df.select("doc_id", domain.alias("domain"))


@query(
    f"""SELECT doc_id, CASE WHEN regexp_matches(low, '{rules.HTML}') OR regexp_matches(low, '{rules.CHAT}') OR {n_of("low", rules.URL)} >= 3 THEN 'hard_noise'
        WHEN regexp_matches(t, 'Ã.|�|Å¿') THEN 'ocr_or_mojibake' WHEN regexp_matches(t, '\\|[ ]*[-:]+[ ]*\\||^[ ]*\\|') THEN 'table_fragment'
        WHEN regexp_matches(low, '{rules.TOC}') THEN 'index_or_toc' WHEN regexp_matches(t, '[|]{{2,}}|(^|[ \\n])[-*•][ ]') THEN 'list_like' WHEN nw < 8 THEN 'tiny_fragment'
        WHEN lower_start AND NOT terminal THEN 'broken_sentence_fragment' WHEN lower_start OR NOT terminal THEN 'sentence_fragment'
        WHEN contains(t, ':') AND nw < 28 THEN 'definition_or_label' ELSE 'compact_valid' END AS kind
        FROM (SELECT doc_id, t, lower(t) AS low, len(regexp_extract_all(t, '{X.WORD}')) AS nw, regexp_matches(t, '^[a-zäöüß]') AS lower_start, regexp_matches(t, '[.!?:)\\]"]$') AS terminal
              FROM (SELECT doc_id, trim(coalesce(text, ''), ' ') AS t FROM documents))"""
)
def short_kind(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", F.trim(X.text_or_empty(TEXT)).alias("t")).withColumn("low", F.lower("t")).withColumn("nw", F.size(X.words(F.col("t"))))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    small, closed, t, low, nw = like("t", "^[a-zäöüß]"), like("t", '[.!?:)\\]"]\\z'), "t", "low", F.col("nw")
    kind = rules.first_reason(
        [
            ("hard_noise", like(low, rules.HTML) | like(low, rules.CHAT) | (X.count_of(F.col(low), rules.URL) >= 3)),
            ("ocr_or_mojibake", like(t, "Ã.|�|Å¿")),
            ("table_fragment", like(t, "\\|[ ]*[-:]+[ ]*\\||^[ ]*\\|")),
            ("index_or_toc", like(low, rules.TOC)),
            ("list_like", like(t, "[|]{2,}|(^|[ \\n])[-*•][ ]")),
            ("tiny_fragment", nw < 8),
            ("broken_sentence_fragment", small & ~closed),
            ("sentence_fragment", small | ~closed),
            ("definition_or_label", F.contains(t, F.lit(":")) & (nw < 28)),
        ]
    )
    return df.select("doc_id", F.coalesce(kind, F.lit("compact_valid")).alias("kind"))


@query(
    f"""SELECT doc_id, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(coalesce(text, ''), '{p}') THEN '{n}' END" for n, p in rules.SECRETS.items())}], lambda x: x IS NOT NULL), ',') AS found
        FROM documents"""
)
def secret_families(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.array_join(rules.secrets(TEXT), ",").alias("found"))


# -- duplicates ------------------------------------------------------------------------------------------------------
@query(f"SELECT doc_id, row_number() OVER (PARTITION BY sha256(lower({FLAT})) ORDER BY doc_id) = 1 AS kept FROM documents")
def exact_dedup(spark, sf_dir):
    return dedup.first_of_each(docs(spark, sf_dir).select("doc_id", "text"), X.text_key(TEXT)).select("doc_id", "kept")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(substr(coalesce(text, ''), 1, 500)) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def prefix_dedup(spark, sf_dir):
    return dedup.first_of_each(docs(spark, sf_dir).select("doc_id", "text"), X.prefix_key(TEXT, 500)).where("kept").select("doc_id")


@query(f"SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_unique, sum(n - 1)::BIGINT AS n_duplicates FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(lower({FLAT})))")
def dup_counters(spark, sf_dir):
    return dedup.counters(docs(spark, sf_dir), X.text_key(TEXT))


@query(f"SELECT doc_id, rank::INT AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(lower({FLAT})) ORDER BY doc_id) AS rank FROM documents) WHERE rank <= 3")
def capped_dups(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.text_key(TEXT).alias("k"))
    return dedup.capped(df, F.col("k"), [F.col("doc_id")], 3).select("doc_id", "rank")


@query(f"SELECT max(doc_id) AS doc_id, sha256(lower({FLAT})) AS k FROM documents GROUP BY 2")
def last_wins(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.text_key(TEXT).alias("k"))
    return dedup.upsert(df, "k", [F.col("doc_id")]).select("doc_id", "k")


BUCKETS = f"""SELECT doc_id, substr(sha1(coalesce(string_agg(w, ' ' ORDER BY n DESC, w), '')), 1, 8) AS bucket FROM (
    SELECT doc_id, w, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) AS r FROM
    (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest({LOW_WORDS}[1:2000]) AS w FROM documents) GROUP BY doc_id, w)) WHERE r <= 32 GROUP BY doc_id"""


@query(f"SELECT d.doc_id, coalesce(bucket, 'da39a3ee') AS bucket FROM documents d LEFT JOIN ({BUCKETS}) b ON b.doc_id = d.doc_id")
def near_dup_bucket(spark, sf_dir):
    return dedup.word_bucket(docs(spark, sf_dir), X.words(F.lower("text")))


# -- budgets, samples, order -----------------------------------------------------------------------------------------
RUN = f"SELECT doc_id, source, {LINE_BYTES} AS b, row_number() OVER w AS rn, sum({LINE_BYTES}) OVER w AS cum FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"


def sized(spark, sf_dir) -> DataFrame:
    """Only ids, sources and sizes go on: windows shuffle no text."""
    return docs(spark, sf_dir).select("doc_id", "source", ordering.row_bytes().alias("b"))


@query(f"SELECT doc_id, source, cum::BIGINT AS cum FROM ({RUN}) WHERE cum <= 20000 OR rn = 1")
def budget_prefix(spark, sf_dir):
    return ordering.budget_prefix(sized(spark, sf_dir), ["source"], ["doc_id"], F.col("b"), 20_000).select("doc_id", "source", "cum")


@query(f"SELECT doc_id, source, cum::BIGINT AS cum FROM ({RUN}) WHERE cum - b < 20000")
def target_stop(spark, sf_dir):
    return ordering.target_stop(sized(spark, sf_dir), ["source"], ["doc_id"], F.col("b"), 20_000).select("doc_id", "source", "cum")


@query(f"SELECT doc_id, source, CASE WHEN cum > tot * (1 - 0.2::DOUBLE) THEN 'holdout' ELSE 'train' END AS split FROM (SELECT *, sum(b) OVER (PARTITION BY source) AS tot FROM ({RUN}))")
def tail_reserve(spark, sf_dir):
    return ordering.tail_reserve(sized(spark, sf_dir), ["source"], ["doc_id"], F.col("b"), 0.2).select("doc_id", "source", "split")


@query(f"SELECT doc_id, source, cum::BIGINT AS cum FROM (SELECT doc_id, source, b, sum(b) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM ({RUN}) WHERE rn > 5) WHERE cum - b < 10000")
def offset_slice(spark, sf_dir):
    return ordering.skip_then_take(sized(spark, sf_dir), ["source"], ["doc_id"], 5, F.col("b"), 10_000).select("doc_id", "source", "cum")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('s|' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def hash_sample_per_class(spark, sf_dir):
    key = F.col("doc_id").cast("string")
    return ordering.hash_sample(docs(spark, sf_dir).select("doc_id", "lang"), ["lang"], 20, "s", key).select("doc_id", "lang")


@query("SELECT doc_id FROM documents WHERE ('0x' || substr(sha256('s|' || doc_id), 1, 16))::UBIGINT % 1000 < 150")
def bernoulli_sample(spark, sf_dir):
    return ordering.bernoulli(docs(spark, sf_dir).select("doc_id"), 150, "s", F.col("doc_id").cast("string"))


@query("SELECT doc_id, sha256('shuffle|' || doc_id) AS key FROM documents ORDER BY key")
def keyed_shuffle(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.shuffle_key("shuffle", F.col("doc_id").cast("string")).alias("key")).orderBy("key")


@query("SELECT doc_id, source, ((r - 1) // 4)::INT AS turn FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)")
def interleave(spark, sf_dir):
    return ordering.interleave(docs(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"], 4).select("doc_id", "source", "turn")


@query(
    f"""SELECT doc_id, source, cum::BIGINT AS cum FROM (SELECT doc_id, source, sum(b) OVER (ORDER BY rn, source ROWS UNBOUNDED PRECEDING) AS cum FROM ({RUN})) WHERE cum <= 400000"""
)
def round_robin_budget(spark, sf_dir):
    return ordering.round_robin_budget(sized(spark, sf_dir), "source", ["doc_id"], F.col("b"), 400_000).select("doc_id", "source", "cum")


@query(
    f"""SELECT doc_id, n::BIGINT AS n_tokens, (sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n)::BIGINT AS start
        FROM (SELECT doc_id, 1 + {n_of("coalesce(text, '')", X.TOKEN_ESTIMATE)} AS n FROM documents)"""
)
def token_offsets(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", X.token_estimate(TEXT).alias("n_tokens"))
    return ordering.offsets(df, "doc_id", "n_tokens", 100_000)


# -- splits and mixes ------------------------------------------------------------------------------------------------
@query("SELECT doc_id, CASE WHEN ('0x' || substr(sha256(source || ':' || doc_id), 1, 16))::UBIGINT % 100 < 10 THEN 'holdout' ELSE 'train' END AS split FROM documents")
def holdout_split(spark, sf_dir):
    b = X.bucket(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 100)
    return docs(spark, sf_dir).select("doc_id", F.when(b < 10, "holdout").otherwise("train").alias("split"))


@query("SELECT source, (('0x' || substr(sha256(source), 1, 16))::UBIGINT % 10)::BIGINT AS fold, count(*) AS n FROM documents GROUP BY source")
def group_split(spark, sf_dir):
    return docs(spark, sf_dir).groupBy("source", X.bucket(F.col("source"), 10).alias("fold")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT source, bytes::BIGINT AS bytes, bytes::DOUBLE / sum(bytes) OVER () AS share, bytes < 100000 AS shortfall
        FROM (SELECT source, sum({LINE_BYTES}) AS bytes FROM documents GROUP BY source)"""
)
def mix_report(spark, sf_dir):
    df = sized(spark, sf_dir).groupBy("source").agg(F.sum("b").alias("bytes"))
    total = df.agg(F.sum("bytes").alias("total"))
    return df.crossJoin(F.broadcast(total)).select("source", "bytes", (F.col("bytes") / F.col("total")).alias("share"), (F.col("bytes") < 100_000).alias("shortfall"))


@query("SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY sha256('r|' || doc_id)) <= greatest(1, count(*) OVER (PARTITION BY lang) // 50) THEN 'holdout' ELSE 'train' END AS split FROM documents) GROUP BY split")
def ratio_split(spark, sf_dir):
    w = Window.partitionBy("lang")
    rank = F.row_number().over(w.orderBy(X.shuffle_key("r", F.col("doc_id").cast("string"))))
    held = rank <= F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(w) / 50))
    return docs(spark, sf_dir).select("lang", "doc_id").select(F.when(held, "holdout").otherwise("train").alias("split")).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# -- profiles --------------------------------------------------------------------------------------------------------
@query(
    """SELECT lang, quantile_cont(n, 0.01) AS p01, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.99) AS p99, min(n) AS least, max(n) AS most,
       sum((n < 200)::INT)::DOUBLE / count(*) AS share_short FROM (SELECT lang, length(text) AS n FROM documents) GROUP BY lang"""
)
def length_profile(spark, sf_dir):
    df = docs(spark, sf_dir).select("lang", F.length("text").cast("long").alias("n"))
    p = lambda q: F.percentile("n", F.lit(q))
    return df.groupBy("lang").agg(
        p(0.01).alias("p01"), p(0.5).alias("p50"), p(0.99).alias("p99"), F.min("n").alias("least"), F.max("n").alias("most"),
        (F.sum((F.col("n") < 200).cast("int")) / F.count(F.lit(1))).alias("share_short"),
    )


@query(
    """SELECT source, max(n) FILTER (WHERE r = round_even((c - 1) * 0.9, 0)::BIGINT + 1) AS nearest, max(n) FILTER (WHERE r = floor(c * 0.95)::BIGINT + 1) AS by_index FROM
       (SELECT source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) AS r, count(*) OVER (PARTITION BY source) AS c FROM documents) GROUP BY source"""
)
def nearest_rank(spark, sf_dir):
    w = Window.partitionBy("source")
    df = docs(spark, sf_dir).select("source", "doc_id", F.length("text").cast("long").alias("n"))
    df = df.select("source", "n", F.row_number().over(w.orderBy("n", "doc_id")).alias("r"), F.count(F.lit(1)).over(w).alias("c"))
    pick = lambda at: F.max(F.when(F.col("r") == at + 1, F.col("n")))
    return df.groupBy("source").agg(pick(F.bround((F.col("c") - 1) * 0.9, 0)).alias("nearest"), pick(F.floor(F.col("c") * 0.95)).alias("by_index"))


@query(
    """SELECT 'text' AS name, count(text) AS filled, count(DISTINCT text) AS distinct_values, min(length(text)) AS least, max(length(text)) AS most FROM documents UNION ALL
       SELECT 'lang', count(lang), count(DISTINCT lang), min(length(lang)), max(length(lang)) FROM documents UNION ALL
       SELECT 'source', count(source), count(DISTINCT source), min(length(source)), max(length(source)) FROM documents"""
)
def column_profile(spark, sf_dir):
    """One pass: each column becomes rows (name, value), distinct values counted by their hash classes."""
    df = docs(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("v")) for c in ("text", "lang", "source")])).alias("s"))
    df = df.select("s.name", F.sha2("s.v", 256).alias("k"), F.length("s.v").cast("long").alias("n"))
    by_value = df.groupBy("name", "k").agg(F.count("k").alias("filled"), F.min("n").alias("least"), F.max("n").alias("most"))
    return by_value.groupBy("name").agg(F.sum("filled").alias("filled"), F.count("k").alias("distinct_values"), F.min("least").alias("least"), F.max("most").alias("most"))


@query(
    """WITH span(lo, hi, name) AS (VALUES (0, 99, 'head'), (100, 249, 'body'), (400, 599, 'tail'))
       SELECT coalesce(name, 'unknown') AS span, count(*) AS n FROM documents LEFT JOIN span ON doc_id BETWEEN lo AND hi GROUP BY 1"""
)
def span_join(spark, sf_dir):
    from corpusloom.operators.joins import span_lookup

    spans = spark.createDataFrame([(0, 99, "head"), (100, 249, "body"), (400, 599, "tail")], "lo long, hi long, name string")
    return span_lookup(docs(spark, sf_dir).select("doc_id"), "doc_id", spans).groupBy(F.col("name").alias("span")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT source, count(*) AS n, sum((reason IS NULL)::INT)::BIGINT AS kept, sum((reason IS NULL)::INT)::DOUBLE / greatest(1, count(*)) AS keep_rate,
        sum(CASE WHEN reason IS NULL THEN b ELSE 0 END)::DOUBLE / greatest(1, sum(b)) AS byte_keep_rate
        FROM (SELECT doc_id, source, {LINE_BYTES} AS b FROM documents) JOIN ({LIGHT}) USING (doc_id) GROUP BY source"""
)
def keep_rates(spark, sf_dir):
    both = rules.light_gate(docs(spark, sf_dir).withColumn("b", ordering.row_bytes()), ("source", "b"))
    kept = F.col("reason").isNull()
    return both.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(kept.cast("int")).alias("kept"),
        (F.sum(kept.cast("int")) / F.greatest(F.lit(1), F.count(F.lit(1)))).alias("keep_rate"),
        (F.sum(F.when(kept, F.col("b")).otherwise(F.lit(0))) / F.greatest(F.lit(1), F.sum("b"))).alias("byte_keep_rate"),
    )
