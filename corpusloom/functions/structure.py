"""Structure cleaning as columns: repaired encodings, plain lines without page furniture, sentences packed to paragraphs.

Everything runs in the JVM: lines and sentences are arrays that are mapped, filtered and folded, with no Python function.
Entities are those of ``ENTITIES``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X

# Signs of text decoded by the wrong code page.
HINTS = ("Ã¤", "Ã¶", "Ã¼", "ÃŸ", "Ã„", "Ã–", "Ãœ", "â€", "Â ", "�")
# What code page 1252 has at 80-9F, and where.
WESTERN = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
WESTERN_AT = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
# Entities that are read.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
# Lines that are page furniture, fragments that no prose holds, template marks, openings of list articles.
HEADER_NOISE = (
    "home", "menu", "navigation", "login", "log in", "sign in", "register", "teilen", "share", "mehr lesen", "read more", "weiterlesen",
    "zurück", "kontakt", "impressum", "datenschutz", "cookie", "cookies", "newsletter", "abo", "subscribe", "advertisement", "anzeige",
)
BAD_FRAGMENTS = (
    "_end_of_the_data", "_user-data", "<|im_start|>", "<|im_end|>", "javascript is disabled", "accept all cookies", "cookie policy",
    "privacy policy", "all rights reserved", "subscribe to our newsletter", "sign in to continue", "advertisement", "anzeige",
)
BAD_WORDS = ("newsletter",)
TEMPLATE = "(?i)###[ ]*(aufgabe|antwort|instruction|response)|(^|[^\\p{L}\\p{N}_])(frage|antwort)[ ]*:"
LIST_ARTICLE = "(?i)(heissen|heißen) folgende|folgende geographische objekte|steht (fuer|für)[ ]*:|bezeichnet[ ]*:|(^|[^\\p{L}])liste der([^\\p{L}]|\\z)"
TRAILS = ("sie befinden sich hier", "sie sind hier", "aktuelle seite", "you are here", "navigation:", "startseite", "you are at")
BULLET = "\\A[ \\t]*([-*•]+|[0-9]+[.)]|[a-zA-Z][.)])[ \\t]+"
#: Options: least words and score, language share, paragraph sizes.
OPTIONS = {"words": 80, "score": 0.55, "signal": 0.10, "target": 700, "most": 1600}


def damage(c: Column, hints: tuple[str, ...] = HINTS) -> Column:
    """Signs of a wrong code page, replacement characters fourfold."""
    return reduce(lambda a, h: a + X.count_text(c, h), hints, F.lit(0)) + 3 * X.count_text(c, "�")


def repaired(c: Column, hints: tuple[str, ...] = HINTS) -> Column:
    """The reading with the least damage: as it stands, or as UTF-8 bytes that were taken for Latin-1 or code page 1252.

    Without a sign of damage nothing is tried.  A reading counts only if all characters are in its code page and the bytes
    are UTF-8.
    """
    c = X.text_or_empty(c)

    def reading(fits: str, chars: Column) -> Column:
        data = F.encode(F.regexp_replace(chars, "[^\\x{0}-\\x{FF}]", "?"), "ISO-8859-1").cast("string")
        return F.when(F.regexp_like(c, F.lit(fits)), F.when(F.is_valid_utf8(data), data))

    others = (
        reading("\\A[\\x{0}-\\x{FF}]*\\z", c),
        reading(f"\\A[\\x{{0}}-\\x{{7F}}\\x{{A0}}-\\x{{FF}}{WESTERN}]*\\z", F.translate(c, WESTERN, WESTERN_AT)),
    )
    tried = F.array_compact(F.array(*[F.when(x.isNotNull(), F.struct(damage(x, hints).alias("d"), F.lit(i).alias("i"), x.alias("x"))) for i, x in enumerate((c, *others))]))
    return F.when(damage(c, hints) > 0, F.array_min(tried)["x"]).otherwise(c)


def plain(c: Column) -> Column:
    """Repaired text without entities, control characters, line-end hyphens, tags, addresses and typographic quotes."""
    c = repaired(c)
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    for pattern, new in (
        ("\\r\\n?", "\n"), ("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " "), ("([\\p{L}\\p{N}_])-\\n([\\p{L}\\p{N}_])", "$1$2"), ("<[^>]{1,160}>", " "),
        ("(?i)(https?://|www\\.)[^ \\t\\n\\x0B\\f\\r]+", " "), ("[\\p{L}\\p{N}_][^ \\t\\n\\x0B\\f\\r]*@[^ \\t\\n\\x0B\\f\\r]+\\.[^ \\t\\n\\x0B\\f\\r]*[\\p{L}\\p{N}_]", " "),
    ):
        c = F.regexp_replace(c, pattern, new)
    c = F.translate(c, "“”„’‘`�", "\"\"\"''' ")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t\\u00A0]{2,}", " "), "[ \\t]*\\n[ \\t]*", "\n")
    return F.regexp_replace(F.regexp_replace(c, "\\n{3,}", "\n\n"), "\\A[ \\t\\n]+|[ \\t\\n]+\\z", "")


def has_fragment(c: Column) -> Column:
    low = F.lower(c)
    found = reduce(lambda a, p: a | F.contains(low, F.lit(p)), BAD_FRAGMENTS, F.lit(False))
    return found | F.regexp_like(low, F.lit("(^|[^\\p{L}\\p{N}_])(" + "|".join(BAD_WORDS) + ")([^\\p{L}\\p{N}_]|\\z)"))


def said_twice(c: Column, window: int = 30) -> Column:
    """From the second of two equal phrases that follow each other at a line's beginning; longer phrases go first."""
    words = F.split(X.collapse(c), " ")
    head, tail = F.array_join(F.slice(words, 1, window), " "), F.array_join(F.slice(words, window + 1, 1_000_000), " ")
    forms = [f"\\A(?:.*? )??((?:[^ ]+ ){{{k - 1}}}[^ ]+) \\1(?= |\\z)" for k in range(6, 0, -1)]
    cut = reduce(lambda rest, p: F.when(F.regexp_like(head, F.lit(p)), F.regexp_replace(head, p, "$1")).otherwise(rest), reversed(forms), head)
    return F.trim(F.concat_ws(" ", cut, F.nullif(tail, F.lit(""))))


def without_trail(c: Column) -> Column:
    """A line without the navigation trail before its text: a labelled one, or bars between short names."""
    head = F.substring(c, 1, 160)
    labelled = F.regexp_like(F.lower(head), F.lit("\\A(" + "|".join(TRAILS) + ")"))
    marked = F.regexp_extract(head, "(?s)\\A.*[>/›»·|][ \\t]*", 0)
    bars = F.regexp_extract(head, "(?s)\\A.*\\|", 0)
    names = F.filter(F.transform(F.split(bars, "\\|"), lambda x: F.trim(x)), lambda x: x != "")
    short = F.coalesce(F.array_max(F.transform(names, lambda x: F.length(x))) <= 40, F.lit(False))
    after = lambda part: F.trim(F.substr(c, F.length(part) + F.lit(1)))
    unlabelled = F.trim(F.regexp_replace(c, "\\A[^:]{0,24}:", ""))
    return (
        F.when(labelled & (marked != ""), after(marked))
        .when(labelled, said_twice(unlabelled))
        .when((X.count_text(head, "|") >= 2) & short, after(bars))
        .otherwise(c)
    )


def furniture(c: Column) -> Column:
    """Nothing, a menu's name, two words or fewer, or a fragment that no prose holds."""
    bare = F.btrim(F.regexp_replace(c, BULLET, ""), F.lit(" .:;|/-"))
    brief = (F.length(bare) < 32) & (X.count_of(bare, X.WORD) <= 2)
    return (bare == "") | F.lower(bare).isin(*HEADER_NOISE) | brief | has_fragment(bare)


def prose_lines(c: Column) -> Column:
    rows = F.transform(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), without_trail)
    return F.transform(F.filter(rows, lambda x: ~furniture(x)), lambda x: F.regexp_replace(x, BULLET, ""))


def sentences(c: Column, least: int = 24) -> Column:
    return F.filter(F.split(X.collapse(c), "(?<=[.!?])[ ]+"), lambda s: (F.length(s) >= least) & ~has_fragment(s))


def packed(parts: Column, target: int, most: int, least_parts: int = 2, joint: str = " ") -> Column:
    """Paragraphs from parts in order: closed at ``target`` characters and ``least_parts`` parts, never filled past ``most``."""
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))
    closed = lambda a: F.when(a["n"] > 0, F.concat(a["done"], F.array(a["held"]))).otherwise(a["done"])

    def add(a: Column, part: Column) -> Column:
        full = (a["n"] > 0) & (F.length(a["held"]) + len(joint) + F.length(part) > most)
        n = F.when(full, F.lit(0)).otherwise(a["n"])
        held = F.when(n > 0, F.concat(a["held"], F.lit(joint), part)).otherwise(part)
        done = F.when(full, closed(a)).otherwise(a["done"])
        ready = (F.length(held) >= target) & (n + 1 >= least_parts)
        return F.struct(
            F.when(ready, F.concat(done, F.array(held))).otherwise(done).alias("done"),
            F.when(ready, F.lit("")).otherwise(held).alias("held"),
            F.when(ready, F.lit(0)).otherwise(n + 1).alias("n"),
        )

    return F.aggregate(parts, start, add, closed)


def book_chunks(c: Column, least: int = 400, target: int = 1500, most: int = 3000) -> Column:
    """A book in chunks of whole paragraphs; longer ones are cut by sentences, and a last chunk below ``least`` is dropped."""
    whole = F.filter(F.transform(F.split(X.text_or_empty(c), "\\n[ \\t\\r\\f]*\\n"), X.collapse), lambda p: p != "")
    units = F.flatten(F.transform(whole, lambda p: F.when(F.length(p) > most, packed(F.split(p, "(?<=[.!?])[ ]+"), target, most, 1)).otherwise(F.array(p))))
    made = packed(units, target, most, 1)
    short = F.length(F.try_element_at(made, F.lit(-1))) < least
    return F.when(short, F.slice(made, F.lit(1), F.size(made) - 1)).otherwise(made)


def list_like(c: Column) -> Column:
    """A list article's opening, and eight or more commas or brief sentences in its first 2,500 characters."""
    head = F.substring(c, 1, 2500)
    signs = X.count_text(head, ",") + X.count_text(head, ";")
    brief = F.size(F.filter(F.split(head, "[.;]"), lambda s: F.size(X.tokens(s)).between(1, 8)))
    return F.regexp_like(head, F.lit(LIST_ARTICLE)) & ((signs >= 8) | (brief >= 8))


def cleaned(df: DataFrame, text: str = "text", options: dict | None = None) -> DataFrame:
    """Adds clean (the structured text), paragraphs, score and reason (null: kept) to rows with ``text``."""
    o = {**OPTIONS, **(options or {})}
    df = df.withColumn("__t", plain(F.col(text)))
    t = F.col("__t")
    early = (
        F.when(t == "", "empty").when(damage(t) > 0, "mojibake").when(has_fragment(t), "boilerplate")
        .when(F.regexp_count(t, F.lit(TEMPLATE)) >= 2, "template").when(list_like(t), "list_article")
    )
    df = df.withColumn("__early", early)
    df = df.withColumn("__s", F.when(F.col("__early").isNull(), sentences(F.array_join(prose_lines(t), "\n"))))
    df = df.withColumn("__p", F.filter(packed(F.col("__s"), o["target"], o["most"]), lambda p: X.count_of(p, X.WORD) >= 12))
    df = df.withColumn("clean", F.array_join("__p", "\n\n"))
    c = F.col("clean")
    df = df.withColumn("__w", X.words(F.lower(c)))
    w = F.col("__w")
    n, n_words = F.greatest(F.lit(1), F.length(c)), F.size(w)
    in_paragraphs = F.aggregate("__p", F.lit(0), lambda a, p: a + F.greatest(F.lit(1), F.size(sentences(p))))
    from corpusloom.operators.rules import quality_score

    df = df.withColumn("__signal", X.hits_in(w, X.GERMAN_STOPWORDS) / F.greatest(F.lit(1), n_words))
    repetition = X.ngram_repetition(w, 4, 8)
    mean = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / F.greatest(F.lit(1), n_words)
    score = quality_score(n_words, in_paragraphs, X.alpha_count(c) / n, X.symbol_count(c) / n, X.digit_count(c) / n, repetition, F.col("__signal"), mean)
    df = df.withColumn("score", F.when(F.size("__p") > 0, score))
    late = (
        F.when(F.size("__s") < 2, "too_few_sentences").when(F.size("__p") == 0, "too_short").when(n_words < o["words"], "too_few_words")
        .when(F.col("__signal") < o["signal"], "language_mismatch").when(F.col("score") < o["score"], "low_quality")
    )
    df = df.withColumn("paragraphs", F.coalesce(F.size("__p"), F.lit(0))).withColumn("reason", F.coalesce("__early", late))
    return df.drop("__t", "__early", "__s", "__p", "__w", "__signal")


# -- other rewrites --------------------------------------------------------------------------------------------------
def without_book_frame(c: Column) -> Column:
    """A digital book's text between the marks that open and close it."""
    c = F.regexp_replace(F.translate(F.regexp_replace(X.text_or_empty(c), "\\r\\n?", "\n"), "\x00", ""), "(?is)\\*\\*\\*\\s*START OF (THE|THIS) PROJECT GUTENBERG EBOOK.*?\\*\\*\\*", "")
    c = F.regexp_replace(c, "(?is)\\*\\*\\*\\s*END OF (THE|THIS) PROJECT GUTENBERG EBOOK.*", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]+", " "), "\\n{4,}", "\n\n")
    return F.regexp_replace(c, "\\A[ \\t\\n]+|[ \\t\\n]+\\z", "")


def without_banner(c: Column, most: int = 80) -> Column:
    """Code without the comment lines that open it, if these speak of a licence; at most ``most`` lines are looked at."""
    c = F.regexp_replace(X.text_or_empty(c), "\\r\\n", "\n")
    banner = F.regexp_extract(c, f"\\A(?:[ \\t]*(?:#[^\\n]*|\"\"\"|''')?[ \\t]*(?:\\n|\\z)){{1,{most}}}+", 0)
    speaks = F.regexp_like(F.lower(banner), F.lit("(^|[^a-z])(copyright|license|apache|mit license|bsd license|gpl|mozilla public license)([^a-z]|\\z)"))
    commented = F.regexp_like(banner, F.lit("#|\"\"\"|'''"))
    return F.when(commented & speaks, F.regexp_replace(F.substr(c, F.length(banner) + F.lit(1)), "\\A\\n+", "")).otherwise(c)


def forum_plain(c: Column) -> Column:
    """A forum post without quoted lines, links in brackets and zero-width spaces."""
    c = X.text_or_empty(c)
    for a, b in ENTITIES:
        c = F.replace(c, F.lit(a), F.lit(b))
    for pattern, new in (
        ("\\r\\n?", "\n"), ("\\x00", ""), ("\\x{200B}", " "), ("(^|\\n)[ \\t]*>[^\\n]*", "$1"),
        ("\\[[^\\]]{1,120}\\]\\((https?://|www\\.)[^)]+\\)", ""), ("[ \\t]{2,}", " "), ("\\n{3,}", "\n\n"), ("\\A[ \\t\\n]+|[ \\t\\n]+\\z", ""),
    ):
        c = F.regexp_replace(c, pattern, new)
    return c


def turns(c: Column) -> Column:
    """array of (author, body): what stands between one ``author:`` and the next; empty bodies fall away."""
    marked = F.regexp_replace(X.text_or_empty(c), "(?:^|[ \\t\\n])([A-Za-z0-9_-]{2,24}):[ \\t\\n]", "\x01$1\x02")
    parts = F.slice(F.split(marked, "\x01"), 2, 1_000_000)
    pairs = F.transform(parts, lambda p: F.struct(F.substring_index(p, "\x02", 1).alias("author"), X.strict_normalise(F.substring_index(p, "\x02", -1)).alias("body")))
    return F.filter(pairs, lambda p: p["body"] != "")


def preference(chosen: Column, rejected: Column) -> Column:
    """(prompt, preferred, rejected) of two dialogues that share their turns up to the last answer."""
    tail = F.when(F.instr(chosen, "Human:") > 0, F.concat(F.lit("Human:"), F.substring_index(chosen, "Human:", -1)))
    at = F.instr(tail, "Assistant:")
    split = F.coalesce(at > 1, F.lit(False))
    other = F.when(F.instr(rejected, "Assistant:") > 0, X.strict_normalise(F.substring_index(rejected, "Assistant:", -1))).otherwise(rejected)
    return F.struct(
        F.when(split, X.strict_normalise(F.replace(F.substr(tail, F.lit(1), at - 1), F.lit("Human:"), F.lit("")))).otherwise(F.lit("")).alias("prompt"),
        F.when(split, X.strict_normalise(F.substr(tail, at + F.lit(10)))).otherwise(chosen).alias("preferred"),
        F.when(split, other).otherwise(rejected).alias("rejected"),
    )


def surrounding(context: Column, answer: Column) -> Column:
    """The first sentence of ``context`` that holds ``answer``; empty if there is none."""
    parts = F.split(X.text_or_empty(context), "(?<=[.!?])[ \\t\\n]+(?=[A-Z])")
    found = F.try_element_at(F.filter(parts, lambda s: F.contains(s, answer)), F.lit(1))
    return F.when(X.text_or_empty(answer) == "", F.lit("")).otherwise(F.coalesce(F.trim(found), F.lit("")))
