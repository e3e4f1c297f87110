"""Column builders for text: normalising, tokens, ratios, hits, hashes.  All JVM-side, no Python functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, thresholds' patterns and hint strings that define the metrics.
WORD = "[A-Za-zÄÖÜäöüß]+"
SPACES = "[ \\t\\n\\x0B\\f\\r]+"
TOKEN_ESTIMATE = "\\p{L}+|\\p{N}+|[^\\s\\p{L}\\p{N}]"
MOJIBAKE_HINTS = ("�", "Ã¤", "Ã¶", "Ã¼", "Ã\u009f", "Ã¢â‚¬", "Â ")
GERMAN_STOPWORDS = tuple(
    "der die das und oder nicht ist sind ein eine einer einen mit auf von zu im den dem des dass auch als wie wird werden "
    "fuer ueber für durch bei aus nach über".split()
)
GERMAN_HITS = tuple(
    "der die das und oder nicht ist sind ein eine einer einen mit fuer fur auf von zu im den dem des dass ich du sie wir kann "
    "wird werden wenn weil aber auch als wie was warum deutsch".split()
)
ENGLISH_HITS = tuple("the and or not is are a an with for to of in that this you your we can will if because please explain example answer".split())


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapse(c: Column) -> Column:
    """One line: runs of white space become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text_or_empty(c), SPACES, " "))


def one_line(c: Column) -> Column:
    """collapse() without NUL and carriage returns."""
    return collapse(F.translate(text_or_empty(c), "\x00\r", ""))


def strict_normalise(c: Column) -> Column:
    """Line ends unified, NUL dropped, runs of blanks and tabs collapsed, ends stripped."""
    c = F.regexp_replace(F.regexp_replace(text_or_empty(c), "\\r\\n?", "\n"), "\\x00", "")
    return F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$", "")


def drop_controls(c: Column) -> Column:
    return F.regexp_replace(c, "[\\x00-\\x08\\x0B-\\x1F]", "")


def drop_thoughts(c: Column) -> Column:
    return collapse(F.regexp_replace(text_or_empty(c), "</?think>", " "))


def ascii_fold(c: Column) -> Column:
    for a, b in (("ä", "ae"), ("ö", "oe"), ("ü", "ue"), ("ß", "ss")):
        c = F.replace(F.lower(c) if a == "ä" else c, F.lit(a), F.lit(b))
    return c


def strip_tags(c: Column) -> Column:
    """Tags to spaces, the seven common entities decoded, white space collapsed."""
    c = F.regexp_replace(text_or_empty(c), "<[^>]+>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return collapse(c)


def excerpt(c: Column, limit: int) -> Column:
    """At most ``limit`` characters, cut back to a word's end if that loses 80 or fewer, with an ellipsis."""
    flat = collapse(c)
    head = F.substring(flat, 1, limit)
    back = F.instr(F.reverse(head), " ")
    cut = F.when((back > 0) & (back <= 80), F.substr(head, F.lit(1), F.lit(limit) - back)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(cut), F.lit(" …")))


def words(c: Column) -> Column:
    return F.regexp_extract_all(text_or_empty(c), F.lit(WORD), F.lit(0))


def tokens(c: Column) -> Column:
    """White-space tokens of a collapsed text; none of an empty one."""
    return F.filter(F.split(collapse(c), " "), lambda x: x != "")


def lines(c: Column) -> Column:
    return F.split(text_or_empty(c), "\n")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(text_or_empty(c), F.lit(pattern))


def count_text(c: Column, needle: str) -> Column:
    """Occurrences of a literal, not overlapping."""
    c = text_or_empty(c)
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("int")


def ratio(part: Column, whole: Column) -> Column:
    """0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def alpha_count(c: Column) -> Column:
    return count_of(c, "\\p{L}")


def digit_count(c: Column) -> Column:
    return count_of(c, "\\p{Nd}")


def symbol_count(c: Column) -> Column:
    """Neither letter, number nor white space."""
    return count_of(c, "[^\\p{L}\\p{N}\\s]")


def distinct_share_lost(a: Column, least: int = 1) -> Column:
    """1 - distinct / all of an array; 0 below ``least`` elements."""
    return F.when(F.size(a) < max(1, least), F.lit(0.0)).otherwise(1 - F.size(F.array_distinct(a)) / F.size(a))


def ngrams(a: Column, n: int) -> Column:
    at = F.when(F.size(a) >= n, F.sequence(F.lit(1), F.size(a) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.array_join(F.slice(a, i, n), " "))


def ngram_repetition(a: Column, n: int = 4, least: int = 16) -> Column:
    return F.when(F.size(a) < least, F.lit(0.0)).otherwise(distinct_share_lost(ngrams(a, n)))


def hits_in(a: Column, vocabulary: tuple[str, ...]) -> Column:
    known = F.array(*[F.lit(w) for w in vocabulary])
    return F.size(F.filter(a, lambda w: F.array_contains(known, w)))


def mojibake_score(c: Column) -> Column:
    return reduce(lambda a, h: a + count_text(c, h), MOJIBAKE_HINTS, F.lit(0)) + 3 * count_text(c, "�")


def list_score(c: Column) -> Column:
    """List markers, dotted page references and separators."""
    c = text_or_empty(c)
    return (
        count_of(c, "(^|[ \\t\\n\\x0B\\f\\r])([-*•]|[0-9]{1,3}[.)])[ \\t\\n\\x0B\\f\\r]+")
        + count_of(c, "[0-9]{1,4}[ \\t\\n\\x0B\\f\\r]*(\\.{2,}|…|—|-)[ \\t\\n\\x0B\\f\\r]*[0-9]{1,5}")
        + count_text(c, " | ")
        + count_text(c, "\t")
    )


def max_line_repeat(c: Column) -> Column:
    """How often the commonest non-blank line stands: sorted once, then runs are counted in one fold."""
    rows = F.array_sort(F.filter(F.transform(lines(c), lambda x: F.trim(x)), lambda x: x != ""))
    start = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["last"] == x, acc["run"] + 1).otherwise(F.lit(1))
        return F.struct(x.alias("last"), run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(rows, start, step)["best"]


def token_estimate(c: Column) -> Column:
    """Letters, numbers and single signs counted, plus one closing token: an estimate for want of a vocabulary."""
    return (count_of(c, TOKEN_ESTIMATE) + 1).cast("long")


def text_key(c: Column) -> Column:
    """Equality class of a text without regard to case and white space."""
    return F.sha2(F.lower(collapse(c)), 256)


def prefix_key(c: Column, n: int) -> Column:
    return F.sha2(F.substring(text_or_empty(c), 1, n), 256)


def bucket(key: Column, mod: int) -> Column:
    """The first 8 bytes of SHA-256, big-endian, modulo ``mod``: the same in any engine."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(mod)).cast("long")


def shuffle_key(seed: str, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(seed), *keys), 256)
