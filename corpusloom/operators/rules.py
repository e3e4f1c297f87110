"""Reason-coded gates: ordered rules as columns, the first that holds (or all), counts and reject samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X

Rule = tuple[str, Column]

# Thresholds, phrases and patterns of the light and strict gates.
LIGHT_BOUNDS = {"en": (200, 100_000), "de": (300, 100_000)}
PROTECTED = ("<|code|>", "<|endcode|>", "<filename>", "<file_sep>", "<|file|>")
BOILERPLATE = (
    "cookie policy",
    "privacy policy",
    "accept all cookies",
    "subscribe to our newsletter",
    "all rights reserved",
    "sign in to continue",
    "javascript is disabled",
    "diese website verwendet cookies",
    "wir verwenden cookies",
    "cookies akzeptieren",
    "alle cookies akzeptieren",
    "alle rechte vorbehalten",
    "newsletter abonnieren",
    "javascript ist deaktiviert",
    "bitte aktivieren sie javascript",
    "in den warenkorb",
    "zur kasse",
    "passwort vergessen",
    "anmelden oder registrieren",
)
LIGHT_MOJIBAKE = ("â€™", "â€œ", "â€", "Ã¼", "Ã¶", "Ã¤", "Â ")
HTML = "<[ ]*/?[ ]*(html|body|div|span|script|style|table|iframe|a|p|br)[ />]"
CHAT = "<\\|(system|user|assistant|end|im_start|im_end)\\|>|###[ ]*(aufgabe|antwort):"
URL = "https?://|www\\."
TOC = "(^|[^a-z])(contents?|inhaltsverzeichnis|table of contents)([^a-z]|$)|(\\.{3,}|…{2,})[ ]*[0-9]{1,5}([ \\n]|$)"
BIBLIOGRAPHY = "isbn|doi:|copyright|all rights reserved|published by|herausgegeben|druckerei|bibliothek"
CODE = "(^|[^a-z])(def|class|import|return|function|const|let|var|public static|#include)([^a-z]|$)|[{};]{3,}"
MATH = "\\\\\\[|\\\\\\(|(^|[^a-z])(theorem|lemma|proof|beweis|gleichung|integral|matrix)([^a-z]|$)|[=+*/^-]{3,}"
SECRETS = {
    "private_key": "-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "cloud_key": "AKIA[0-9A-Z]{16}",
    "token": "gh[pousr]_[A-Za-z0-9]{20,}",
    "assignment": "(api_key|apikey|secret|password|token)[ ]*[=:][ ]*[^ ]{8,}",
}
FALSE_LABELS = ("html", "url_dense", "chat_or_sft_marker", "boilerplate", "mojibake", "repetitive")
REPAIRABLE = (
    "toc_or_index", "bibliography_or_metadata", "list_or_table_heavy", "very_long_doc", "symbol_dense", "digit_dense", "low_alpha",
)


def first_reason(rules: list[Rule]) -> Column:
    """The first rule that holds, else null.  One CASE: later rules aren't evaluated for rows decided before."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, holds in rules[1:]:
        out = out.when(holds, F.lit(name))
    return out


def all_reasons(rules: list[Rule]) -> Column:
    """Every rule that holds, in order."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))


def contains_any(c: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | F.contains(c, F.lit(p))
    return out


def reason_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias(reason)).agg(F.count(F.lit(1)).alias("n"))


def reject_samples(df: DataFrame, n: int, reason: str = "reason", order: str = "doc_id") -> DataFrame:
    """The first ``n`` rows of each reason; Spark keeps n a task before the rows of a reason meet."""
    rank = F.row_number().over(Window.partitionBy(reason).orderBy(order))
    return df.where(F.col(reason).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= n)


def light_gate(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, reason of the light quality gate, beside the columns of ``keep``; bounds of length by language."""
    df = df.select("doc_id", *keep, "lang", X.one_line(F.col("text")).alias("t"))
    df = df.withColumn("tok", F.filter(F.split("t", " "), lambda x: x != "")).withColumn("low", F.lower("t"))
    t, tok, n = F.col("t"), F.col("tok"), F.length("t")
    bound = lambda i: F.when(F.col("lang") == "de", LIGHT_BOUNDS["de"][i]).otherwise(LIGHT_BOUNDS["en"][i])
    protected = F.lit(False)
    for p in PROTECTED:
        protected = protected | F.startswith(t, F.lit(p))
    urls = F.size(F.filter(tok, lambda x: F.startswith(x, F.lit("http://")) | F.startswith(x, F.lit("https://")) | F.startswith(x, F.lit("www."))))
    rules = [
        ("too_long", protected & (n > bound(1))),
        ("", protected),
        ("too_short", n < bound(0)),
        ("too_long", n > bound(1)),
        ("boilerplate", contains_any(F.col("low"), BOILERPLATE)),
        ("url_dense", X.ratio(urls, F.size(tok)) > 0.20),
        ("symbol_dense", X.ratio(X.symbol_count(t), n) > 0.35),
        ("repetitive", X.distinct_share_lost(tok) > 0.60),
        ("mojibake", contains_any(t, LIGHT_MOJIBAKE)),
    ]
    return df.select("doc_id", *keep, F.nullif(first_reason(rules), F.lit("")).alias("reason"))


def profiles(spark) -> DataFrame:
    """Thresholds by source profile: one plan serves all sources by joining its row of this table."""
    rows = [
        ("prose", 200, 60_000, 0.60, 0.25, 0.80, 0.35, 0.16, 10),
        ("code", 80, 60_000, 0.25, 0.60, 0.95, 0.80, 0.50, 1_000),
        ("math", 80, 60_000, 0.30, 0.60, 0.90, 0.60, 0.50, 1_000),
        ("booster", 20, 20_000, 0.10, 0.80, 1.00, 1.00, 1.00, 10_000),
    ]
    names = "profile string, min_chars int, max_chars int, min_alpha double, max_symbol double, max_repetition double, max_ngram double, max_digit double, max_list int"
    return spark.createDataFrame(rows, names)


def language_ok(low: Column, ws: Column, language: Column) -> Column:
    """Stopword votes over a folded text's words; the German test may pass by umlauts alone."""
    de, en = X.hits_in(ws, X.GERMAN_HITS), X.hits_in(ws, X.ENGLISH_HITS)
    umlauts = X.count_of(low, "[äöüß]")
    german = ((de >= 6) & (de >= en * 1.1)) | ((umlauts >= 2) & (de >= en))
    english = (en >= 6) & (en >= de * 1.1)
    return F.when(F.size(ws) < 30, False).when(language == "de", german).when(language == "en", english).otherwise(True)


#: Rows of a table of sources or profiles that is broadcast without being counted.
FEW = 10_000


def small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows, else left to the optimiser."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def strict_gate(df: DataFrame, thresholds: DataFrame, profile_of: DataFrame | None = None) -> DataFrame:
    """doc_id, profile, reason.  The structure reason is found once and reported early or late by its kind.

    ``profile_of`` (source, profile) names the sources' profiles; a source that it doesn't name is prose.
    """
    base = df.select("doc_id", "lang", "source", X.strict_normalise(F.col("text")).alias("t"))
    if profile_of is not None:
        base = base.join(small(profile_of), "source", "left")
    else:
        base = base.withColumn("profile", F.lit(None).cast("string"))
    base = base.withColumn("profile", F.coalesce("profile", F.lit("prose"))).drop("source").join(small(thresholds), "profile")
    base = base.withColumn("low", F.lower("t")).withColumn("ws", X.words(X.ascii_fold(F.col("t"))))
    t, low, ws, n = F.col("t"), F.col("low"), F.col("ws"), F.length("t")
    prose, booster = F.col("profile") == "prose", F.col("profile") == "booster"
    toc, lists = X.count_of(low, TOC), X.list_score(t)
    grams = X.ngram_repetition(ws)
    structure = F.when(F.regexp_like(low, F.lit(CHAT)), "chat_marker").when(
        ~booster,
        first_reason(
            [
                ("toc_or_index", (toc >= 2) | (prose & (toc >= 1) & (lists >= 4))),
                ("bibliography_or_metadata", X.count_of(low, BIBLIOGRAPHY) >= F.when(prose, 3).otherwise(4)),
                ("list_or_table_heavy", prose & (lists >= F.col("max_list"))),
                ("digit_dense", prose & (X.ratio(X.digit_count(t), n) > F.col("max_digit"))),
                ("repetitive_ngram", grams > F.col("max_ngram")),
            ]
        ),
    )
    base = base.withColumn("structure", F.when(n.between(F.col("min_chars"), F.col("max_chars")), structure))
    s = F.col("structure")
    rules = [
        ("too_short", n < F.col("min_chars")),
        ("too_long", n > F.col("max_chars")),
        ("chat_marker", s == "chat_marker"),
        ("toc_or_index", s == "toc_or_index"),
        ("mojibake", X.mojibake_score(t) > 0),
        ("html", F.regexp_like(low, F.lit(HTML))),
        ("boilerplate", contains_any(low, BOILERPLATE)),
        ("url_dense", X.count_of(low, URL) > 3),
        ("low_alpha", X.ratio(X.alpha_count(t), n) < F.col("min_alpha")),
        ("symbol_dense", X.ratio(X.symbol_count(t), n) > F.col("max_symbol")),
        ("repetitive", X.distinct_share_lost(ws, 50) > F.col("max_repetition")),
    ]
    late = ~booster & ~language_ok(low, ws, F.col("lang"))
    reason = F.coalesce(first_reason(rules), s, F.when(late, "language_mismatch"))
    return base.select("doc_id", "profile", reason.alias("reason"))


def audit_flags(c: Column, ws: Column) -> Column:
    """All flags of the mix audit, in order; ``ws`` are the lower-cased words."""
    low, n = F.lower(c), F.length(c)
    toc, lists = X.count_of(low, TOC), X.list_score(c)
    return all_reasons(
        [
            ("too_short", n < 180),
            ("very_long_doc", n > 50_000),
            ("mojibake", F.regexp_like(c, F.lit("Ã.|Â.|â€|�"))),
            ("html", F.regexp_like(low, F.lit(HTML))),
            ("url_dense", X.count_of(low, URL) >= 3),
            ("chat_or_sft_marker", F.regexp_like(low, F.lit(CHAT))),
            ("boilerplate", F.regexp_like(low, F.lit("cookie|privacy policy|javascript|newsletter|subscribe|sign in|alle rechte vorbehalten"))),
            ("toc_or_index", (toc >= 2) | ((toc >= 1) & (lists >= 4))),
            ("bibliography_or_metadata", X.count_of(low, BIBLIOGRAPHY) >= 3),
            ("low_alpha", X.ratio(X.alpha_count(c), n) < 0.45),
            ("symbol_dense", X.ratio(X.symbol_count(c), n) > 0.22),
            ("digit_dense", X.ratio(X.digit_count(c), n) > 0.16),
            ("repetitive", (X.distinct_share_lost(ws, 30) > 0.68) | (X.ngram_repetition(ws) > 0.28)),
            ("list_or_table_heavy", lists >= 8),
            ("code_like", F.regexp_like(c, F.lit(CODE))),
            ("math_like", F.regexp_like(c, F.lit(MATH))),
        ]
    )


def audit(df: DataFrame) -> DataFrame:
    """doc_id, source, quality (keep, repair, trash), flags, n_chars and n_words."""
    df = df.select("doc_id", "source", F.trim(X.text_or_empty(F.col("text"))).alias("t"))
    df = df.withColumn("ws", X.words(F.lower("t")))
    df = df.select("doc_id", "source", audit_flags(F.col("t"), F.col("ws")).alias("flags"), F.length("t").alias("n_chars"), F.size("ws").alias("n_words"))
    any_of = lambda names: F.arrays_overlap("flags", F.array(*map(F.lit, names)))
    good = (F.col("n_chars") >= 240) & (F.col("n_words") >= 35)
    quality = F.when(any_of(FALSE_LABELS), "trash").when(any_of(REPAIRABLE), "repair").when(good, "keep").otherwise("repair")
    return df.withColumn("quality", quality)


def quality_score(words: Column, sentences: Column, alpha: Column, symbol: Column, digit: Column, repetition: Column, language: Column, length: Column) -> Column:
    """1 less eight penalties, within 0 and 1."""
    off = lambda bad, by: F.when(bad, by).otherwise(F.lit(0.0))
    lost = (
        off(words < 80, F.lit(0.25))
        + off(sentences < 3, F.lit(0.2))
        + off(alpha < 0.55, F.lit(0.2))
        + off(symbol > 0.18, F.least(F.lit(0.25), (symbol - 0.18) * 1.5))
        + off(digit > 0.25, F.lit(0.15))
        + off(repetition > 0.18, F.least(F.lit(0.35), repetition))
        + off(language < 0.035, F.lit(0.18))
        + off(~length.between(3.0, 10.5), F.lit(0.08))
    )
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - lost))


def secrets(c: Column) -> Column:
    return all_reasons([(name, F.regexp_like(X.text_or_empty(c), F.lit(p))) for name, p in SECRETS.items()])
