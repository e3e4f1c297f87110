"""Gates of corpora by kind: mixes, books, code, forums, dialogues, records; their counters and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import structure
from corpusloom.functions import textfn as X
from corpusloom.operators import dedup, joins, rules
from corpusloom.plans.documents import FLAT, S, docs, hits, literal, lost, n_of, quoted
from corpusloom.plans.others import CHAT, QA, chats, table
from corpusloom.plans.registry import query
from corpusloom.plans.spec import Gate, bounded, text_sql

# -- texts that gates read -------------------------------------------------------------------------------------------
TIDY = r"""trim(regexp_replace(regexp_replace(replace(regexp_replace(coalesce({0}, ''), '\r\n?', chr(10), 'g'), chr(0), ''), '[ \t]{{2,}}', ' ', 'g'), '\n{{4,}}', repeat(chr(10), 3), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"""


def tidy(c):
    """Line ends unified, NUL dropped, blanks and empty lines collapsed, ends stripped."""
    c = F.regexp_replace(F.regexp_replace(X.text_or_empty(c), "\\r\\n?", "\n"), "\\x00", "")
    c = F.regexp_replace(F.regexp_replace(c, "[ \\t]{2,}", " "), "\\n{4,}", "\n\n\n")
    return F.btrim(c, F.lit(" \t\n\x0b\x0c\r"))


def tidy_docs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "source", "lang", tidy(F.col("text")).alias("t"))


TIDY_DOCS = f"SELECT doc_id, source, lang, {TIDY.format('text')} AS t FROM documents"
QA_TEXT = "'System: You are a helpful assistant.' || chr(10) || 'Frage: ' || trim(prompt) || chr(10) || 'Antwort: ' || trim(answer)"


def qa_docs(spark, sf_dir):
    text = F.concat(F.lit("System: You are a helpful assistant.\nFrage: "), F.trim("prompt"), F.lit("\nAntwort: "), F.trim("answer"))
    return joins.replies(table(spark, sf_dir, "conversations")).select("conv_id", "turn", F.trim("prompt").alias("prompt"), F.trim("answer").alias("answer"), text.alias("t"))


QA_DOCS = f"SELECT conv_id, turn, trim(prompt) AS prompt, trim(answer) AS answer, {QA_TEXT} AS t FROM ({QA})"

# The patterns that define the gates.
URL = "(?i)https?://|www\\."
BAD = (
    "(?i)\\[(deleted|removed)\\]|onlyfans|discord\\.gg|telegram|whatsapp|free karma|subscribe to|promo code|coupon code|buy now|nsfw|porn|"
    "sexkontakte|casino|sportwetten|warenkorb|rabattcode|cookie policy|xxxHHxxx"
)
CANDIDATE_BAD = (
    "(?i)\\[(deleted|removed)\\]|onlyfans|discord\\.gg|telegram|whatsapp|free karma|upvote if|subscribe to|promo code|coupon code|buy now|nsfw|"
    "porn|sexkontakte|casino|sportwetten|warenkorb|rabattcode|cookie policy"
)
MIX_BAD = (
    "(?i)\\[(deleted|removed)\\]|discord\\.gg|onlyfans|free karma|subscribe to|promo code|online casino|casino bonus|free spins|jackpot|"
    "sportwetten|sexkontakte|erotik[ \\t\\n]+(chat|kontakte|shop)|erotik,[ \\t\\n]*wohlbefinden|porn|xxx|warenkorb|checkout|rabattcode|gutschein|"
    "trusted shops|all rights reserved|cookie policy|privacy policy"
)
TAGS = "(?i)<[ ]*/?[ ]*(html|body|div|script|style|iframe)([^\\p{L}\\p{N}_]|\\z)"
ENTITY = "(?i)&(amp|gt|lt|quot);"
CHAT_MARK = "(?i)<\\|(im_start|im_end|user|assistant|system|endoftext)\\|>|_end_of_the_data"
COMMERCE = bounded("warenkorb|rabatt|gutschein|checkout|kaufen|shop|preis|automarkt")
BOILER = bounded("cookie|privacy policy|datenschutz|impressum|all rights reserved")
LIST_TABLE = "(^|[ \\t\\n])([-*]|[0-9]{1,3}[.)])[ \\t\\n]+|\\|[ ]*[-:]+[ ]*\\||\\t|\\.{3,}[ ]*[0-9]{1,5}"
GERMAN_SIGN = bounded("der|die|das|und|ist|nicht|frage|antwort|schritt|erklaere|erklare")
GATE_NEAR = bounded("hauptstadt von deutschland")
SECRET_WORD = "(?i)api[_-]?key|secret|password|private key|token"
WIKI_TALK = "(?i)(^|[^\\p{L}\\p{N}_])(nicht signierter beitrag|ce[st]\\)|wikipedia:|qs-baustein|redaktion[_ ]|diskussion:|benutzer:)"
TABLE_MARK = "\\|[ ]*[-:]+[ ]*\\||\\{\\||\\|\\}|\\A[ \\t\\n]*\\|"
INDEX_MARK = "(?i)(^|[^\\p{L}\\p{N}_])(kategorie:|liste der|personen nach|artikel des tages|portal:)|\\.{3,}[ ]*[0-9]{1,5}"
LIST_MARK = "(^|[ \\t\\n])([-*•]|[0-9]{1,3}[.)])[ \\t\\n]+|[|]{2,}|\\t"
TERMINAL = "[.!?:)\\]\"”]\\z"


def common(least: int, most: int, urls: int) -> tuple[dict, list]:
    """What the mix's keepers of one generation share."""
    features = {"bad": ("has", BAD), "html": ("has", TAGS), "href": ("has", "(?i)href="), "entity": ("has", ENTITY), "near": ("has", GATE_NEAR), "urls": ("count", URL), "alpha": ("letters", "")}
    ruled = [
        ("too_short", f"n < {least}"), ("too_long", f"n > {most}"), ("bad_marker", "bad"), ("html", "html OR href OR entity"), ("gate_near", "near"),
        ("url_dense", f"urls > {urls}"), ("low_alpha", "alpha < 0.32"),
    ]
    return features, ruled


_f, _r = common(700, 12000, 0)
Gate(
    _f | {"commerce": ("has", COMMERCE), "boiler": ("has", BOILER), "lists": ("has", LIST_TABLE), "german": ("has", GERMAN_SIGN)},
    _r + [("commerce", "commerce"), ("boilerplate", "boiler"), ("list_table", "lists"), ("weak_de_signal", "NOT german")],
).register("keep_web", tidy_docs, TIDY_DOCS, "Web pages of the mix.")
_f, _r = common(80, 8000, 0)
Gate(_f, _r, keep=("conv_id", "turn")).register("keep_instruction", qa_docs, QA_DOCS, "Instructions of the mix, rendered as question and answer.")
_f, _r = common(180, 7000, 0)


def math_docs(spark, sf_dir):
    text = F.concat(F.lit("Problem: "), F.col("prompt"), F.lit("\nLoesung: "), F.col("answer"))
    return qa_docs(spark, sf_dir).withColumn("t", text)


MATH_DOCS = f"SELECT conv_id, turn, 'Problem: ' || prompt || chr(10) || 'Loesung: ' || answer AS t FROM ({QA_DOCS})"
Gate(_f, _r, keep=("conv_id", "turn")).register("keep_math", math_docs, MATH_DOCS, "Problems with solutions of the mix.")
Gate(
    {"secret": ("has", SECRET_WORD), "html": ("has", TAGS), "href": ("has", "(?i)href="), "entity": ("has", ENTITY), "urls": ("count", URL)},
    [("too_short", "n < 160"), ("too_long", "n > 18000"), ("secret_word", "secret"), ("html", "html OR href OR entity"), ("url_dense", "urls > 2")],
).register("keep_code", tidy_docs, TIDY_DOCS, "Code of the mix.")
Gate(
    {
        "bad": ("has", CANDIDATE_BAD), "chat": ("has", CHAT_MARK), "html": ("has", TAGS), "entity": ("has", ENTITY), "urls": ("count", URL),
        "words": ("count", "[\\p{L}\\p{N}_]+"), "alpha": ("letters", ""),
    },
    [
        ("too_short", "n < 400"), ("too_long", "n > 20000"), ("bad_marker", "bad"), ("chat_marker", "chat"), ("html_or_entity", "html OR entity"),
        ("url_dense", "urls > 1"), ("too_few_words", "words < 60"), ("low_alpha", "alpha < 0.32"),
    ],
).register("candidate_gate", tidy_docs, TIDY_DOCS, "Candidates of a mix, before their source's own gate.")

# -- the mix's gate, with what it observed and what it dropped --------------------------------------------------------
#: (signal, condition, drops): signals are observed in this order as long as nothing has dropped the row.
MIX_SIGNALS = [
    ("too_short", "n < 90", True), ("chat_marker", "chat", True), ("html_or_entity", "html OR entity", True), ("bad_marker", "bad", True),
    ("has_url", "urls > 0", False), ("url_dense", "urls > 2", True), ("wiki_talk", "wiki", True), ("table_or_index", "tables OR indexed", True),
    ("low_alpha", "alpha < 0.32", True), ("list_like", "lists", False), ("broken_sentence_fragment", "lower_start AND NOT closed", False),
    ("short_list_like", "tokens < 120 AND lists", True), ("short_broken_sentence", "tokens < 120 AND lower_start AND NOT closed", True),
    ("too_few_tokens", "tokens < 40", True),
]
MIX_FEATURES = Gate(
    {
        "chat": ("has", CHAT_MARK), "html": ("has", "(?i)<[ ]*/?[ ]*(html|body|div|script|style|table|iframe)([^\\p{L}\\p{N}_]|\\z)"), "entity": ("has", "(?i)&(amp|gt|lt|quot|#x200b);"),
        "bad": ("has", MIX_BAD), "urls": ("count", URL), "wiki": ("has", WIKI_TALK), "tables": ("has", TABLE_MARK), "indexed": ("has", INDEX_MARK), "alpha": ("letters", ""),
        "lists": ("has", LIST_MARK), "lower_start": ("has", "\\A\\p{Ll}"), "closed": ("has", TERMINAL), "tokens": ("count", X.TOKEN_ESTIMATE.replace("\\s", " \\t\\n\\x0B\\f\\r")),
    },
    [],
)
FLAT_DOCS = f"SELECT doc_id, source, {FLAT} AS t FROM documents"


def _reached(i: int) -> str:
    earlier = [c for _, c, drops in MIX_SIGNALS[:i] if drops]
    return "(" + " OR ".join(f"({c})" for c in earlier) + ")" if earlier else "false"


MIX_SQL = (
    "SELECT doc_id, source, CASE " + " ".join(f"WHEN {c} THEN '{s}'" for s, c, drops in MIX_SIGNALS if drops) + " END AS reason, list_filter(["
    + ", ".join(f"CASE WHEN ({c}) AND NOT {_reached(i)} THEN '{s}' END" for i, (s, c, _) in enumerate(MIX_SIGNALS)) + "], lambda x: x IS NOT NULL) AS observed FROM ("
    + "SELECT doc_id, source, t, length(t) AS n, "
    + MIX_FEATURES.sql("x").split("length(t) AS n, ", 1)[1].rsplit(" FROM (x)", 1)[0] + f" FROM ({FLAT_DOCS}))"
)


def mix_judged(spark, sf_dir):
    """doc_id, source, reason, observed: signals are observed only where the row got that far."""
    df = docs(spark, sf_dir).select("doc_id", "source", X.collapse(F.col("text")).alias("t"))
    df = df.select("doc_id", "source", *MIX_FEATURES.columns())
    reason = rules.first_reason([(s, F.expr(c)) for s, c, drops in MIX_SIGNALS if drops])
    seen = rules.all_reasons([(s, F.expr(f"({c}) AND NOT {_reached(i)}")) for i, (s, c, _) in enumerate(MIX_SIGNALS)])
    return df.select("doc_id", "source", reason.alias("reason"), seen.alias("observed"))


@query(f"SELECT doc_id, reason, array_to_string(observed, ',') AS observed FROM ({MIX_SQL})")
def mix_gate(spark, sf_dir):
    return mix_judged(spark, sf_dir).select("doc_id", "reason", F.array_join("observed", ",").alias("observed"))


@query(
    f"""WITH j AS ({MIX_SQL}), o AS (SELECT source, unnest(observed) AS signal FROM j), n AS (SELECT source, signal, count(*) AS observed FROM o GROUP BY ALL),
        d AS (SELECT source, reason AS signal, count(*) AS skipped FROM j WHERE reason IS NOT NULL GROUP BY ALL)
        SELECT source, signal, coalesce(skipped, 0)::BIGINT AS skipped, observed, 100.0::DOUBLE * coalesce(skipped, 0) / observed AS percent FROM n LEFT JOIN d USING (source, signal)"""
)
def skip_rates(spark, sf_dir):
    """What share of the observed was dropped, by source and signal: one pass, a row a source and signal is shuffled."""
    each = mix_judged(spark, sf_dir).select("source", "reason", F.explode("observed").alias("signal"))
    by = each.groupBy("source", "signal").agg(F.sum((F.col("reason") == F.col("signal")).cast("long")).alias("k"), F.count(F.lit(1)).alias("observed"))
    skipped = F.coalesce("k", F.lit(0))
    return by.select("source", "signal", skipped.alias("skipped"), "observed", (100.0 * skipped / F.col("observed")).alias("percent"))


# -- books -----------------------------------------------------------------------------------------------------------
GUTENBERG = (
    "(?i)project gutenberg|gutenberg\\.org|gutenberg etext|gutenberg ebook|gutenberg-tm|electronic work|etext[ ]+#|ebook[ ]+#|distributed proofreading|"
    "produced by|prepared by volunteers|transcriber'?s note|proofreaders"
)
LICENCE = (
    "(?i)copyright|all rights reserved|terms of use|permission is granted|redistribution|public domain|creative commons|license|licence|"
    "without warranty|limited warranty|trademark|royalties|foundation|donations?|tax deductible"
)
FRONT = (
    "(?i)\\A[ ]*(title page|half-title|preface|foreword|introduction|publisher'?s note|editor'?s note|author'?s note|dedication|acknowledge?ments|contents|"
    "table of contents|inhaltsverzeichnis|inhalt|list of illustrations|list of plates|errata|bibliography|index|appendix|glossary|notes?|footnotes?)([^\\p{L}\\p{N}_]|\\z)"
)
CONTENTS = bounded("contents|table of contents|inhaltsverzeichnis|inhalt|list of illustrations|list of plates")
PAGE_REF = "(?i)(^|[^a-z0-9_])page[ ]+[0-9]{1,4}([^0-9]|\\z)|(^|[^a-z0-9_])p\\.[ ]*[0-9]{1,4}([^0-9]|\\z)|\\.{3,}[ ]*[0-9]{1,4}([^0-9]|\\z)|\\[[ ]*page[ ]+[0-9]{1,4}[ ]*\\]"
INDEXED = bounded("index|general index|name index|subject index|register|glossary")
CHAPTER_PAGE = "(?i)(chapter|kapitel)[ ]+[ivxlcdm0-9]+[^\\n]{0,80}(page|seite)"


def _listish(t: str) -> tuple[str, str]:
    """The share of short parts between full stops and semicolons, in both engines."""
    return t, f"(SELECT len(list_filter(p, lambda x: len(string_split(trim(x), ' ')) <= 7 AND trim(x) <> ''))::DOUBLE / greatest(1, len(p)) FROM (SELECT regexp_split_to_array({t}, '[.;][ ]+') AS p))"


def listish(t):
    parts = F.split(t, "[.;][ ]+")
    short = F.filter(parts, lambda x: (F.trim(x) != "") & (F.size(F.split(F.trim(x), " ")) <= 7))
    return F.size(short) / F.greatest(F.lit(1), F.size(parts))


BOOK_RULES = [
    ("too_short", "n < 700"), ("mojibake", "mojibake"), ("url", "urls"), ("gutenberg_boilerplate", "gutenberg"),
    ("license_block", "licence AND redistribution"), ("license_short", "licence AND n < 2500"), ("front_back_matter", "front"),
    ("table_of_contents", "contents AND (refs_head OR chapter_page)"), ("index_glossary", "indexed AND (refs OR listish > 0.45)"),
    ("page_list", "refs_early AND listish_early > 0.40"), ("all_caps", "caps > 0.28"), ("low_alpha", "alpha < 0.52"),
    ("too_few_words", "words < 120"), ("repetitive", "unique_share < 0.16"),
]
_caps = "CASE WHEN len(w3) = 0 THEN 0.0 ELSE len(list_filter(w3, lambda x: length(x) >= 4 AND upper(x) = x))::DOUBLE / len(w3) END"
BOOK_SQL = f"""SELECT doc_id, CASE {" ".join(f"WHEN {c} THEN '{r}'" for r, c in BOOK_RULES)} END AS reason FROM (
    SELECT doc_id, length(t) AS n, regexp_matches(t, 'Ã[^\\n]|Â[^\\n]|�|â€|ï¬') AS mojibake, regexp_matches(t, {text_sql(URL)}) AS urls, regexp_matches(t, {text_sql(GUTENBERG)}) AS gutenberg,
    regexp_matches(h, {text_sql(LICENCE)}) AS licence, contains(h, 'project gutenberg') OR contains(h, 'redistribution') AS redistribution, regexp_matches(substr(t, 1, 400), {text_sql(FRONT)}) AS front,
    regexp_matches(h, {text_sql(CONTENTS)}) AS contents, regexp_matches(h, {text_sql(PAGE_REF)}) AS refs_head, regexp_matches(h, {text_sql(CHAPTER_PAGE)}) AS chapter_page,
    regexp_matches(substr(t, 1, 800), {text_sql(INDEXED)}) AS indexed, regexp_matches(t, {text_sql(PAGE_REF)}) AS refs, {_listish("t")[1]} AS listish,
    regexp_matches(substr(t, 1, 2000), {text_sql(PAGE_REF)}) AS refs_early, {_listish("substr(t, 1, 3000)")[1]} AS listish_early, {_caps} AS caps,
    len(regexp_extract_all(t, '\\p{{L}}'))::DOUBLE / greatest(1, length(t)) AS alpha, len(w) AS words, len(list_distinct(w))::DOUBLE / greatest(1, len(w)) AS unique_share
    FROM (SELECT doc_id, t, lower(substr(t, 1, 2500)) AS h, regexp_extract_all(lower(t), '{X.WORD}') AS w, regexp_extract_all(substr(t, 1, 3000), '{X.WORD}') AS w3 FROM ({FLAT_DOCS})))"""


@query(BOOK_SQL)
def book_gate(spark, sf_dir):
    """Books: frames, licences, front and back matter, contents, indexes, capitals, few or repeated words."""
    t, h = F.col("t"), F.col("h")
    df = docs(spark, sf_dir).select("doc_id", X.collapse(F.col("text")).alias("t"))
    df = df.select("doc_id", "t", F.lower(F.substring("t", 1, 2500)).alias("h"), X.words(F.lower("t")).alias("w"), X.words(F.substring("t", 1, 3000)).alias("w3"))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    caps = F.when(F.size("w3") == 0, F.lit(0.0)).otherwise(F.size(F.filter("w3", lambda x: (F.length(x) >= 4) & (F.upper(x) == x))) / F.size("w3"))
    df = df.select(
        "doc_id", F.length(t).alias("n"), like(t, "Ã[^\\n]|Â[^\\n]|�|â€|ï¬").alias("mojibake"), like(t, URL).alias("urls"), like(t, GUTENBERG).alias("gutenberg"), like(h, LICENCE).alias("licence"),
        (F.contains(h, F.lit("project gutenberg")) | F.contains(h, F.lit("redistribution"))).alias("redistribution"), like(F.substring(t, 1, 400), FRONT).alias("front"), like(h, CONTENTS).alias("contents"),
        like(h, PAGE_REF).alias("refs_head"), like(h, CHAPTER_PAGE).alias("chapter_page"), like(F.substring(t, 1, 800), INDEXED).alias("indexed"), like(t, PAGE_REF).alias("refs"), listish(t).alias("listish"),
        like(F.substring(t, 1, 2000), PAGE_REF).alias("refs_early"), listish(F.substring(t, 1, 3000)).alias("listish_early"), caps.alias("caps"), (X.alpha_count(t) / F.greatest(F.lit(1), F.length(t))).alias("alpha"),
        F.size("w").alias("words"), (F.size(F.array_distinct("w")) / F.greatest(F.lit(1), F.size("w"))).alias("unique_share"),
    )
    return df.select("doc_id", rules.first_reason([(r, F.expr(c)) for r, c in BOOK_RULES]).alias("reason"))


# -- code ------------------------------------------------------------------------------------------------------------
SECRETS = {
    "aws_access_key": "(^|[^\\p{L}\\p{N}_])AKIA[0-9A-Z]{16}([^\\p{L}\\p{N}_]|\\z)",
    "private_key": "-----BEGIN (RSA |OPENSSH |EC |DSA )?PRIVATE KEY-----",
    "github_token": "(^|[^\\p{L}\\p{N}_])gh[pousr]_[A-Za-z0-9_]{30,}",
    "generic_token": "(?i)(^|[^\\p{L}\\p{N}_])(api[_-]?key|secret|token|password|passwd)[ \\t]*[:=][ \\t]*['\"][^'\" \\t\\n]{12,}['\"]",
}
GENERATED = bounded("auto[- ]?generated|generated by|do not edit|compiled from|webpackBootstrap|minified|sourceMappingURL|protobuf generated|eslint-disable")
CODE_HTML = "(?i)</?(html|body|div|script|style|span|table)([^\\p{L}\\p{N}_]|\\z)|&(nbsp|lt|gt|amp);"
LOG = "(?i)(^|[^\\p{L}\\p{N}_])(traceback \\(most recent call last\\)|exception in thread|stack trace|error:|warning:)"
NOTEBOOK = "\"cells\"[ \\t\\n]*:[ \\t\\n]*\\[|\"nbformat\"[ \\t\\n]*:"
VENDOR = "(^|/)(node_modules|vendor|dist|build|third_party|externals|site-packages)(/|\\z)"
FILENAME = "(^|\\n)<filename>([^\\n]+)"
CODE_LICENSE = bounded("mit license|apache license|gnu general public license|copyright")
TODO = ("todo", "fixme", "hack", "xxx")
HIGH_RISK = (
    "control_chars", "replacement_chars", "notebook_json", "generated_or_compiled", "vendor_or_dependency_path", "python_syntax_error", "collapsed_or_minified",
    *[f"possible_secret_{k}" for k in SECRETS],
)
#: Reasons of the filter and flags of the audit, with their conditions; the audit's bounds differ.
CODE_REASONS = [
    ("too_short", "n < 300"), ("import_only", "content > 0 AND imports = content"), ("too_long", "n > 60000"), ("replacement_chars", "replaced"), ("control_chars", "controls"),
    ("collapsed_or_minified", "rows <= 2 AND n > 800"), ("long_line_dense", "long_rows >= greatest(3, floor(rows * 0.2)) OR mean_row > 180"), ("generated_or_compiled", "generated"),
    ("notebook_json", "notebook"), ("html_embedded", "html"), ("log_or_traceback", "log"), ("url_dense", "urls >= 4"), ("todo_dense", "todos >= 8"), ("vendor_or_dependency_path", "vendor"),
    *[(f"possible_secret_{k}", k) for k in SECRETS], ("exact_duplicate", "copy"),
]
CODE_FLAGS = [
    ("too_short_fragment", "n < 80"), ("too_long_file", "n > 80000"), ("replacement_chars", "replaced"), ("control_chars", "controls"), ("collapsed_or_minified", "rows <= 2 AND n > 800"),
    ("long_line_dense", "long_rows >= greatest(3, ceil(rows * 0.2)) OR mean_row > 180"), ("generated_or_compiled", "generated"), ("notebook_json", "notebook"), ("html_embedded", "html"),
    ("log_or_traceback", "log"), ("url_dense", "urls >= 3"), ("license_boilerplate", "licence AND n < 5000"), ("todo_dense", "todos >= 8"), ("vendor_or_dependency_path", "vendor"),
    *[(f"possible_secret_{k}", k) for k in SECRETS], ("exact_duplicate", "copy"),
]
COMPACT = "array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: rtrim(x)), lambda x: trim(x) <> ''), chr(10))"
CODE_SQL = f"""SELECT doc_id, lang, length(t) AS n, regexp_matches(t, '�') AS replaced, regexp_matches(t, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]') AS controls, len(l) AS rows,
    len(list_filter(l, lambda x: length(x) > 240)) AS long_rows, list_sum(list_transform(l, lambda x: length(x)))::DOUBLE / len(l) AS mean_row,
    regexp_matches(t, {text_sql(GENERATED)}) AS generated, regexp_matches(t, {text_sql(NOTEBOOK)}) AS notebook, regexp_matches(t, {text_sql(CODE_HTML)}) AS html, regexp_matches(t, {text_sql(LOG)}) AS log,
    len(regexp_extract_all(t, {text_sql(URL)})) AS urls, {hits("regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+')", TODO)} AS todos, regexp_matches(t, {text_sql(CODE_LICENSE)}) AS licence,
    regexp_matches(lower(regexp_extract(t, {text_sql(FILENAME)}, 2)), {text_sql(VENDOR)}) AS vendor, {", ".join(f"regexp_matches(t, {text_sql(p)}) AS {k}" for k, p in SECRETS.items())},
    len(list_filter(l, lambda x: trim(x) <> '' AND NOT starts_with(x, '<filename>') AND NOT starts_with(x, '<reponame>') AND NOT starts_with(trim(x), '#'))) AS content,
    len(list_filter(l, lambda x: NOT starts_with(x, '<filename>') AND NOT starts_with(x, '<reponame>') AND regexp_matches(trim(x), '^(import |from |__all__)'))) AS imports,
    row_number() OVER (PARTITION BY sha256({COMPACT}) ORDER BY doc_id) > 1 AS copy FROM (SELECT doc_id, lang, t, string_split(t, chr(10)) AS l FROM ({TIDY_DOCS}))"""


def code_features(df, text="t"):
    """doc_id, lang and what the code gate and the code audit read; the first of equal texts by id is no copy."""
    df = df.select("doc_id", "lang", F.col(text).alias("t")).withColumn("l", X.lines(F.col("t")))
    t, like = F.col("t"), lambda p: F.regexp_like("t", F.lit(p))
    marked = lambda x: F.startswith(x, F.lit("<filename>")) | F.startswith(x, F.lit("<reponame>"))
    compact = F.array_join(F.filter(F.transform("l", lambda x: F.rtrim(x)), lambda x: F.trim(x) != ""), "\n")
    df = df.withColumn("k", F.sha2(compact, 256))
    found = df.select(
        "doc_id", "lang", "k", F.length(t).alias("n"), like("�").alias("replaced"), like("[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]").alias("controls"), F.size("l").alias("rows"),
        F.size(F.filter("l", lambda x: F.length(x) > 240)).alias("long_rows"), (F.aggregate("l", F.lit(0), lambda a, x: a + F.length(x)) / F.size("l")).alias("mean_row"),
        like(GENERATED).alias("generated"), like(NOTEBOOK).alias("notebook"), like(CODE_HTML).alias("html"), like(LOG).alias("log"), X.count_of(t, URL).alias("urls"),
        X.hits_in(F.regexp_extract_all(F.lower(t), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0)), TODO).alias("todos"), like(CODE_LICENSE).alias("licence"),
        F.regexp_like(F.lower(F.regexp_extract(t, FILENAME, 2)), F.lit(VENDOR)).alias("vendor"), *[like(p).alias(k) for k, p in SECRETS.items()],
        F.size(F.filter("l", lambda x: (F.trim(x) != "") & ~marked(x) & ~F.startswith(F.trim(x), F.lit("#")))).alias("content"),
        F.size(F.filter("l", lambda x: ~marked(x) & F.regexp_like(F.trim(x), F.lit("^(import |from |__all__)")))).alias("imports"),
    )
    return dedup.first_of_each(found, F.col("k")).withColumn("copy", ~F.col("kept")).drop("k", "kept")


def code_reasons(df, text="t", syntax=False):
    """All reasons; with ``syntax``, Python that doesn't parse too (an Arrow function over rows of that language)."""
    found = code_features(df, text)
    reasons = rules.all_reasons([(r, F.expr(c)) for r, c in CODE_REASONS])
    found = found.select("doc_id", "lang", reasons.alias("reasons"))
    if syntax:
        from corpusloom.functions.pyfn import parses

        bad = df.where("lang = 'python'").select("doc_id", (~parses(text)).alias("bad")).where("bad").select("doc_id", F.lit(True).alias("bad"))
        wrong = F.when(F.col("bad"), F.array(F.lit("python_syntax_error"))).otherwise(F.array().cast("array<string>"))
        found = found.join(bad, "doc_id", "left").withColumn("reasons", F.concat("reasons", wrong)).drop("bad")
    return found


def _multi(named, source):
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{r}' END" for r, c in named) + f"], lambda x: x IS NOT NULL), ',') {source}"


@query(f"SELECT doc_id, {_multi(CODE_REASONS, 'AS reasons')} FROM ({CODE_SQL})")
def code_gate(spark, sf_dir):
    """All reasons at once; syntax isn't judged here, as no document says that it is Python."""
    return code_reasons(tidy_docs(spark, sf_dir)).select("doc_id", F.array_join("reasons", ",").alias("reasons"))


CODE_AUDIT = f"SELECT doc_id, lang, list_filter([{', '.join(f"CASE WHEN {c} THEN '{r}' END" for r, c in CODE_FLAGS)}], lambda x: x IS NOT NULL) AS flags FROM ({CODE_SQL})"


def code_flags(spark, sf_dir):
    flags = rules.all_reasons([(r, F.expr(c)) for r, c in CODE_FLAGS])
    return code_features(tidy_docs(spark, sf_dir)).select("doc_id", "lang", flags.alias("flags"))


@query(f"SELECT lang, flag, count(*) AS n FROM (SELECT lang, unnest(flags) AS flag FROM ({CODE_AUDIT})) GROUP BY ALL")
def code_audit(spark, sf_dir):
    """Flags by language."""
    return code_flags(spark, sf_dir).select("lang", F.explode("flags").alias("flag")).groupBy("lang", "flag").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS docs, sum(len(list_filter(flags, lambda x: list_contains({quoted(HIGH_RISK)}, x))))::BIGINT AS high_risk, sum(list_contains(flags, 'exact_duplicate')::INT)::BIGINT AS copies FROM ({CODE_AUDIT})")
def code_risk(spark, sf_dir):
    risky = F.size(F.array_intersect("flags", F.array(*map(F.lit, HIGH_RISK))))
    return code_flags(spark, sf_dir).agg(F.count(F.lit(1)).alias("docs"), F.sum(risky).alias("high_risk"), F.sum(F.array_contains("flags", "exact_duplicate").cast("int")).alias("copies"))


#: Metadata of code records: the licence, copies, the longest and the mean line.
RECORD_RULES = [
    ("license_not_allowed", "license NOT IN ('apache-2.0', 'mit', 'bsd-3-clause', 'bsd-2-clause', 'isc', 'cc0-1.0', 'unlicense')"), ("too_short", "n < 200"), ("too_long", "n > 20000"),
    ("too_many_copies", "copies > 5"), ("long_line_field", "line_max > 300"), ("high_mean_line_length", "line_mean > 140"), ("generated_or_compiled", "generated"), ("possible_secret", "secret"),
]
RECORD_SECRET = "|".join(f"({SECRETS[k]})" for k in ("generic_token", "private_key", "aws_access_key"))


@query(
    f"""SELECT doc_id, {_multi(RECORD_RULES, 'AS reasons')} FROM (SELECT doc_id, length(t) AS n, coalesce(nullif(regexp_replace(lower(trim(regexp_extract(t, 'Licensed under ([A-Za-z0-9 .-]+)', 1))), '[ ]+', '-', 'g'), ''), 'unknown') AS license,
        count(*) OVER (PARTITION BY sha256(t)) AS copies, list_max(list_transform(string_split(t, chr(10)), lambda x: length(x))) AS line_max,
        list_sum(list_transform(string_split(t, chr(10)), lambda x: length(x)))::DOUBLE / len(string_split(t, chr(10))) AS line_mean, regexp_matches(t, {text_sql(GENERATED)}) AS generated,
        regexp_matches(t, {text_sql(RECORD_SECRET)}) AS secret FROM ({TIDY_DOCS}))"""
)
def code_record_gate(spark, sf_dir):
    """Code records by their metadata; copies are counted before they are joined, so a text of many copies is one row."""
    df = tidy_docs(spark, sf_dir).withColumn("k", F.sha2("t", 256)).withColumn("l", F.transform(X.lines(F.col("t")), lambda x: F.length(x)))
    license_ = F.regexp_replace(F.lower(F.trim(F.regexp_extract("t", "Licensed under ([A-Za-z0-9 .-]+)", 1))), "[ ]+", "-")
    like = lambda p: F.regexp_like("t", F.lit(p))
    df = df.select(
        "doc_id", "k", F.length("t").alias("n"), F.coalesce(F.nullif(license_, F.lit("")), F.lit("unknown")).alias("license"), F.array_max("l").alias("line_max"),
        (F.aggregate("l", F.lit(0), lambda a, x: a + x) / F.size("l")).alias("line_mean"), like(GENERATED).alias("generated"), like(RECORD_SECRET).alias("secret"),
    )
    df = df.join(df.groupBy("k").agg(F.count(F.lit(1)).alias("copies")), "k")
    return df.select("doc_id", F.array_join(rules.all_reasons([(r, F.expr(c)) for r, c in RECORD_RULES]), ",").alias("reasons"))


# -- forums ----------------------------------------------------------------------------------------------------------
FORUM_BAD = (
    "(?i)\\[(deleted|removed)\\]|onlyfans|discord\\.gg|telegram|whatsapp|free karma|upvote if|subscribe to|promo code|coupon code|buy now|nsfw|porn|sex chat|"
    "fuck|fucking|shit|bullshit|bitch|asshole|i am a bot|beep boop|performed automatically|question answered|thanks everyone|thanks in advance|edit:|eta:"
)
FORUM_SPAM = "(?i)onlyfans|discord\\.gg|telegram|whatsapp|free karma|upvote if|subscribe to|check out my|promo code|coupon code|buy now|nsfw|porn|sex chat"
FORUM_BOT = bounded("i am a bot|beep boop|this action was performed automatically")
FORUM_META = bounded("reddit|subreddit|upvote|downvote|karma|mods?|moderators?|crosspost|front page|reddit gold|thanks for the gold|pm me|throwaway")
QUESTION = "(?i)\\A[ \\t\\n]*(why|what|how|when|where|who|which|can|could|would|should|does|do|did|is|are|was|were|if|eli5)([^\\p{L}\\p{N}_]|\\z)"
FORUM_WORD = "[A-Za-z][A-Za-z']+"


def forum_docs(spark, sf_dir):
    d = tidy_docs(spark, sf_dir)
    return d.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 3).alias("votes")), "doc_id", "left").withColumn("votes", F.coalesce("votes", F.lit(1)))


FORUM_DOCS = f"SELECT d.*, coalesce(l.quality * 3, 1) AS votes FROM ({TIDY_DOCS}) d LEFT JOIN labels l ON l.doc_id = d.doc_id"
Gate(
    {
        "low": ("sql", "lower(t)"), "votes_": ("sql", "votes"), "junk": ("has", "(?i)\\A[ \\t\\n]*(&gt;|>|\\*|-|_)[ \\t\\n]*\\z"), "bot": ("has", FORUM_BOT), "spam": ("has", FORUM_SPAM),
        "words": ("count", FORUM_WORD), "urls": ("count", URL), "alpha": ("letters", ""), "breaks": ("count", "\\n"),
    },
    [
        ("deleted_or_removed", "low IN ('[deleted]', '[removed]', 'deleted', 'removed', '')"), ("too_short", "n < 120"), ("too_long", "n > 6000"), ("low_score", "votes_ < 2"),
        ("markdown_junk", "junk"), ("bot", "bot"), ("spam_or_nsfw", "spam"), ("too_few_words", "words < 12"), ("too_many_urls", "urls > 1"), ("link_dominant", "urls = 1 AND words < 35"),
        ("low_alpha_density", "alpha < 0.45"), ("too_many_lines", "breaks > 12"),
    ],
).register("forum_quality", forum_docs, FORUM_DOCS, "Forum posts; votes are three for a document labelled good.")
FORUM_TEXT = {"bad": ("has", FORUM_BAD), "meta": ("has", FORUM_META), "words": ("count", FORUM_WORD), "urls": ("count", URL), "asked": ("count", "[?]"), "alpha": ("letters", "")}


def prompts(spark, sf_dir):
    return qa_docs(spark, sf_dir).withColumn("t", F.col("prompt"))


def answers(spark, sf_dir):
    return qa_docs(spark, sf_dir).withColumn("t", F.col("answer"))


PROMPTS, ANSWERS = (f"SELECT conv_id, turn, {c} AS t FROM ({QA_DOCS})" for c in ("prompt", "answer"))
Gate(
    FORUM_TEXT,
    [
        ("too_short", "n < 20"), ("too_long", "n > 4000"), ("bad_marker", "bad"), ("reddit_meta", "meta"), ("too_few_words", "words < 12"), ("too_many_questions", "asked > 3"),
        ("too_many_urls", "urls > 1"), ("link_dominant", "urls = 1 AND words < 40"), ("low_alpha_density", "alpha < 0.45"),
    ],
    keep=("conv_id", "turn"),
).register("forum_pair", answers, ANSWERS, "Answers of threaded questions.")
Gate(
    FORUM_TEXT | {"question": ("has", QUESTION)},
    [
        ("too_short", "n < 15"), ("too_long", "n > 2000"), ("bad_marker", "bad"), ("reddit_meta", "meta"), ("not_question_like", "asked = 0 OR NOT question"), ("too_few_words", "words < 4"),
        ("has_url", "urls > 0"), ("low_alpha_density", "alpha < 0.45"),
    ],
    keep=("conv_id", "turn"),
).register("forum_question", prompts, PROMPTS, "Questions that a best answer is wanted for.")

# -- streams of sources ----------------------------------------------------------------------------------------------
Gate(
    {
        "edu": ("sql", "quality * 3"), "listed": ("has", "(?i)\\A(list of|liste)|disambiguation"), "wanted": ("sql", "source LIKE '%1%' OR source LIKE '%2%' OR source LIKE '%src%'"),
    },
    [
        ("low_education_score", "coalesce(edu, 3) < 3"), ("disambiguation_or_list", "listed"), ("source_not_wanted", "NOT wanted"), ("too_short", "n < 500"), ("too_long", "n > 100000"),
    ],
).register(
    "stream_gate",
    lambda spark, sf_dir: tidy_docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left"),
    f"SELECT d.*, quality FROM ({TIDY_DOCS}) d LEFT JOIN labels l ON l.doc_id = d.doc_id",
    "Streams: an educational score where there is one, titles, wanted sources, bounds.",
)

# -- dialogues -------------------------------------------------------------------------------------------------------
DE_WORDS = (
    "der die das und oder nicht ist sind ein eine einer einen mit fuer fur auf von zu im den dem des dass ich du sie wir kann koennen konnen wird werden wenn weil aber auch als wie "
    "was warum bitte erklaere erklare beispiel loesung losung antwort deutsch nein ja dies diese dieser"
).split()
EN_WORDS = "the and or not is are a an with for to of in that this you your we can will if because please explain example solution answer".split()
DE_MARKERS = tuple(f" {w} " for w in "der die das und ist nicht sich wird mit auf den für eine auch von im zu".split())
EN_MARKERS = tuple(f" {w} " for w in "the and of is that to a in for with on was it be as at by".split())
NO_INPUT = "(?i)bitte[ ]+(poste|gib|sende|teile).{0,80}(text|kommentar|code|datei|frage)|sobald[ ]+du[ ]+mir[ ]+.{0,80}(gibst|sendest|postest)|ich[ ]+brauche[ ]+.{0,80}(text|input|eingabe)"
BAD_PHRASE = "(?i)as an ai language model|i cannot browse|knowledge cutoff|<\\|im_start\\|>|<\\|im_end\\|>|_end_of_the_data|user-data|cookie policy|privacy policy|accept all cookies|javascript is disabled"
FOLDED = "replace(replace(replace(replace(lower({0}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')"


def german(c):
    """Stopword votes by a ratio of 1.25, or umlauts."""
    w = X.words(X.ascii_fold(F.substring(c, 1, 12_000)))
    de, en = X.hits_in(w, tuple(DE_WORDS)), X.hits_in(w, tuple(EN_WORDS))
    return (F.size(w) > 0) & (((de >= 4) & (de >= en * 1.25)) | ((X.count_of(F.lower(c), "[äöüß]") >= 2) & (de >= en)))


GERMAN_SQL = f"(len(w) > 0 AND ((de >= 4 AND de >= en * 1.25) OR (uml >= 2 AND de >= en)))"


@query(
    f"""SELECT doc_id, {GERMAN_SQL} AS german, CASE WHEN {" + ".join(literal("s", m) for m in DE_MARKERS)} > {" + ".join(literal("s", m) for m in EN_MARKERS)} THEN 'de' ELSE 'en' END AS by_markers
        FROM (SELECT doc_id, w, {hits("w", tuple(DE_WORDS))} AS de, {hits("w", tuple(EN_WORDS))} AS en, {n_of("lower(t)", "[äöüß]")} AS uml, lower(substr(t, 1, 1000)) AS s
        FROM (SELECT doc_id, t, regexp_extract_all({FOLDED.format("substr(t, 1, 12000)")}, '{X.WORD}') AS w FROM ({TIDY_DOCS})))"""
)
def language_votes(spark, sf_dir):
    """Two detectors: stopwords among the first 12,000 characters, and markers among the first 1,000."""
    s = F.lower(F.substring("t", 1, 1000))
    votes = lambda ms: sum((X.count_text(s, m) for m in ms), F.lit(0))
    return tidy_docs(spark, sf_dir).select("doc_id", german(F.col("t")).alias("german"), F.when(votes(DE_MARKERS) > votes(EN_MARKERS), "de").otherwise("en").alias("by_markers"))


COMPLETE = r"""(t <> '' AND len(regexp_extract_all(t, '```')) % 2 = 0 AND NOT regexp_matches(last, '^([0-9]+[.)]?|[-*+]|#{1,6})\z') AND NOT regexp_matches(last, '[:;]\z')
    AND (length(t) < 80 OR regexp_matches(t, '([.!?…)}\]"»”]|''|```)\z')))"""


def complete(c):
    """Even fences, a last line that is no bare list mark and doesn't end in a colon, and an end where one is due."""
    t = F.regexp_replace(X.text_or_empty(c), "[ \\t\\n\\x0B\\f\\r]+\\z", "")
    last = F.trim(F.substring_index(t, "\n", -1))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    ends = (F.length(t) < 80) | like(t, "([.!?…)}\\]\"»”]|'|```)\\z")
    return (t != "") & (X.count_of(t, "```") % 2 == 0) & ~like(last, "^([0-9]+[.)]?|[-*+]|#{1,6})\\z") & ~like(last, "[:;]\\z") & ends


SFT_RULES = [
    ("bad_role_order", "NOT ordered"), ("too_short", "length(said) < 48 OR least_user < 8 OR least_answer < 20"), ("too_long", "length(said) > 24000 OR most_answer > 12000"), ("mojibake", "broken >= 3"),
    ("html", "html"), ("bad_phrase", "phrase"), ("url_dense", "urls > 2"), ("generic_missing_input", "no_input"), ("repetitive", "repeated > 0.72 OR line_repeat >= 4"),
    ("truncated_assistant", "incomplete > 0"), ("assistant_not_german", "NOT german"),
]
ORDERED = "(len(r) > 0 AND len(r) % 2 = 0 AND len(list_filter(r, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0)"
SFT_HTML = "(?i)<[ ]*/?[ ]*(html|body|div|script|style|a|span|table|iframe|form)([^\\p{L}\\p{N}_]|\\z)"
MAX_LINE = "coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(list_filter(list_transform(string_split(answers, chr(10)), lambda x: trim(x)), lambda x: x <> '')) AS q) GROUP BY q)), 0)"
SFT_SQL = f"""WITH c AS (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN m[2:] ELSE m END AS m FROM ({CHAT})),
    d AS (SELECT conv_id, list_transform(m, lambda x: x.role) AS r, array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: x.text), chr(10)) AS said,
      array_to_string(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: x.text), chr(10)) AS answers,
      list_min(list_transform(list_filter(m, lambda x: x.role = 'user'), lambda x: length(x.text))) AS least_user, list_min(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: length(x.text))) AS least_answer,
      list_max(list_transform(list_filter(m, lambda x: x.role = 'assistant'), lambda x: length(x.text))) AS most_answer FROM c),
    a AS (SELECT conv_id, count(*) FILTER (WHERE NOT {COMPLETE}) AS incomplete FROM (SELECT conv_id, t, trim(string_split(t, chr(10))[-1], ' ') AS last FROM (SELECT conv_id, regexp_replace(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+\\z', '') AS t FROM conversations WHERE role = 'assistant')) GROUP BY conv_id),
    e AS (SELECT d.*, {ORDERED} AS ordered, coalesce(incomplete, 0) AS incomplete, regexp_matches(said, {text_sql(SFT_HTML)}) AS html, regexp_matches(said, {text_sql(BAD_PHRASE)}) AS phrase,
      len(regexp_extract_all(said, {text_sql(URL)})) AS urls, regexp_matches(answers, {text_sql("(?s)" + NO_INPUT)}) AS no_input, {" + ".join([*(literal("said", h) for h in X.MOJIBAKE_HINTS), "3 * " + literal("said", "�")])} AS broken,
      regexp_extract_all({FOLDED.format("answers")}, '{X.WORD}') AS fw, regexp_extract_all({FOLDED.format("substr(answers, 1, 12000)")}, '{X.WORD}') AS w, {n_of("lower(answers)", "[äöüß]")} AS uml, {MAX_LINE} AS line_repeat FROM d LEFT JOIN a USING (conv_id)),
    f AS (SELECT *, {lost("fw", 24)} AS repeated, {hits("w", tuple(DE_WORDS))} AS de, {hits("w", tuple(EN_WORDS))} AS en FROM e),
    g AS (SELECT * EXCLUDE (de, en), {GERMAN_SQL} AS german FROM f)
    SELECT conv_id, CASE {" ".join(f"WHEN {c} THEN '{r}'" for r, c in SFT_RULES)} END AS reason FROM g"""


def sft_judged(conversations):
    """conv_id, reason of conversations (conv_id, m: turns in order with role and text)."""
    m = F.when(F.col("m")[0]["role"] == "system", F.slice("m", F.lit(2), F.size("m"))).otherwise(F.col("m"))
    df = conversations.select("conv_id", m.alias("m"))
    of = lambda role: F.transform(F.filter("m", lambda x: x["role"] == role), lambda x: x["text"])
    df = df.select("conv_id", F.transform("m", lambda x: x["role"]).alias("r"), F.array_join(F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: x["text"]), "\n").alias("said"), of("assistant").alias("a"), of("user").alias("u"))
    df = df.withColumn("answers", F.array_join("a", "\n"))
    wrong = F.filter("r", lambda x, i: x != F.when(i % 2 == 0, "user").otherwise("assistant"))
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    like = lambda c, p: F.regexp_like(c, F.lit(p))
    df = df.select(
        "conv_id", "said", ((F.size("r") > 0) & (F.size("r") % 2 == 0) & (F.size(wrong) == 0)).alias("ordered"), F.array_min(lengths("u")).alias("least_user"), F.array_min(lengths("a")).alias("least_answer"),
        F.array_max(lengths("a")).alias("most_answer"), X.mojibake_score(F.col("said")).alias("broken"), like("said", SFT_HTML).alias("html"), like("said", BAD_PHRASE).alias("phrase"), X.count_of(F.col("said"), URL).alias("urls"),
        like("answers", "(?s)" + NO_INPUT).alias("no_input"), X.distinct_share_lost(X.words(X.ascii_fold(F.col("answers"))), 24).alias("repeated"), F.coalesce(X.max_line_repeat(F.col("answers")), F.lit(0)).alias("line_repeat"),
        F.size(F.filter("a", lambda x: ~complete(x))).alias("incomplete"), german(F.col("answers")).alias("german"),
    )
    return df.select("conv_id", rules.first_reason([(r, F.expr(c)) for r, c in SFT_RULES]).alias("reason"))


@query(SFT_SQL)
def sft_gate(spark, sf_dir):
    """Conversations for tuning: order, bounds, noise, missing input, repetition, cut answers, language."""
    return sft_judged(chats(spark, sf_dir))


SFT_BAD = ("```", "python", "javascript", "typescript", "function", "class ", "def ", "import ", "stack trace", "traceback", "html", "http://")


@query(
    f"""SELECT conv_id, turn, kind, kind <> 'code' AND NOT ({" OR ".join(f"contains(lower(t), '{b}')" for b in SFT_BAD)}) AND length(answer) BETWEEN 40 AND 850 AND len(regexp_extract_all(answer, '\\n')) <= 8 AS kept
        FROM (SELECT *, CASE WHEN regexp_matches(lower(prompt), 'code|function|class ') THEN 'code' WHEN contains(prompt, '?') THEN 'factual_qa' ELSE 'general_assistant' END AS kind FROM ({QA_DOCS}))"""
)
def sft_keep(spark, sf_dir):
    """Answers of wanted categories, without code, of 40 to 850 characters and at most nine lines."""
    kind = F.when(F.regexp_like(F.lower("prompt"), F.lit("code|function|class ")), "code").when(F.contains("prompt", F.lit("?")), "factual_qa").otherwise("general_assistant")
    kept = (kind != "code") & ~rules.contains_any(F.lower("t"), SFT_BAD) & F.length("answer").between(40, 850) & (X.count_of(F.col("answer"), "\\n") <= 8)
    return qa_docs(spark, sf_dir).select("conv_id", "turn", kind.alias("kind"), kept.alias("kept"))


@query(
    f"""SELECT conv_id, CASE WHEN regexp_matches(u, 'ist |wer |was |wo |wann |welche |in welchem') THEN 'qa_de' WHEN regexp_matches(u, 'erklaere|formuliere|schreibe|fasse|antworte') THEN 'instruction_de' ELSE 'response_de' END AS intent
        FROM (SELECT conv_id, {FOLDED.format("coalesce(list_filter(m, lambda x: x.role = 'user')[1].text, '')")} AS u FROM ({CHAT}))"""
)
def intent_class(spark, sf_dir):
    """A conversation's intent by its first prompt."""
    u = X.ascii_fold(F.coalesce(F.try_element_at(F.filter("m", lambda x: x["role"] == "user"), F.lit(1))["text"], F.lit("")))
    like = lambda p: F.regexp_like("u", F.lit(p))
    kind = F.when(like("ist |wer |was |wo |wann |welche |in welchem"), "qa_de").when(like("erklaere|formuliere|schreibe|fasse|antworte"), "instruction_de").otherwise("response_de")
    return chats(spark, sf_dir).select("conv_id", u.alias("u")).select("conv_id", kind.alias("intent"))


@query(f"SELECT conv_id, turn, array_to_string(list_filter([CASE WHEN q = '' OR q = '-' THEN 'empty_question' END, CASE WHEN a = '' THEN 'empty_solution' END, CASE WHEN rate < 0.5 THEN 'low_pass_rate' END], lambda x: x IS NOT NULL), ',') AS reasons FROM (SELECT conv_id, turn, prompt AS q, answer AS a, (length(answer) % 10) / 10.0 AS rate FROM ({QA_DOCS}))")
def reasoning_gate(spark, sf_dir):
    """Reasoning records; a pass rate that is missing passes.  The rate here is a stand-in."""
    rate = (F.length("answer") % 10) / F.lit(10.0)
    named = [("empty_question", F.col("prompt").isin("", "-")), ("empty_solution", F.col("answer") == ""), ("low_pass_rate", rate < 0.5)]
    return qa_docs(spark, sf_dir).select("conv_id", "turn", F.array_join(rules.all_reasons(named), ",").alias("reasons"))


# -- licences, toxicity, safety --------------------------------------------------------------------------------------
ALLOWED = {
    "permissive": (
        "cc0", "cc0-1.0", "creative-commons-zero", "public-domain", "cc-by", "cc-by-4.0", "cc-by-3.0", "cc-by-2.0", "cc-by-sa", "cc-by-sa-4.0", "odbl-1.0", "open-database", "dbcl", "odc-by-1.0", "mit", "apache-2.0", "bsd",
    ),
    "commercial": ("cc0", "cc0-1.0", "creative-commons-zero", "public-domain", "cc-by", "cc-by-4.0", "cc-by-3.0", "cc-by-2.0", "odc-by-1.0", "mit", "apache-2.0", "bsd"),
}
NORM_LICENSE = "replace(replace(replace(lower(trim({0})), ' ', '-'), '_', '-'), 'creativecommons', 'creative-commons')"


def license_verdict(c, kind: str):
    """Whether a licence may be used: no derivatives never, non-commercial and share-alike by class, then the list by name or tokens."""
    norm = F.replace(F.replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("-")), F.lit("_"), F.lit("-")), F.lit("creativecommons"), F.lit("creative-commons"))
    like = lambda p: F.regexp_like(norm, F.lit(p))
    tokens = F.split(norm, "-")
    by_tokens = F.lit(False)
    for allowed in ALLOWED[kind]:
        own = F.array(*map(F.lit, allowed.split("-")))
        by_tokens = by_tokens | (F.size(F.array_except(own, tokens)) == 0) | (F.size(F.array_except(tokens, own)) == 0)
    reason = F.when(norm == "", "missing").when(like("-nd|no-?derivatives"), "no_derivatives").when(like("-nc|non-?commercial"), "non_commercial")
    if kind == "commercial":
        reason = reason.when(like("-sa|share-?alike"), "share_alike")
    return reason.when(norm.isin(*ALLOWED[kind]), "exact").when(by_tokens, "tokens").otherwise("not_listed")


def _license_sql(kind: str) -> str:
    sa = "WHEN regexp_matches(k, '-sa|share-?alike') THEN 'share_alike'" if kind == "commercial" else ""
    own = [quoted(tuple(dict.fromkeys(a.split("-")))) for a in ALLOWED[kind]]
    tokens = " OR ".join(f"len(list_filter({o}, lambda x: NOT list_contains(z, x))) = 0 OR len(list_filter(z, lambda x: NOT list_contains({o}, x))) = 0" for o in own)
    return f"CASE WHEN k = '' THEN 'missing' WHEN regexp_matches(k, '-nd|no-?derivatives') THEN 'no_derivatives' WHEN regexp_matches(k, '-nc|non-?commercial') THEN 'non_commercial' {sa} WHEN list_contains({quoted(ALLOWED[kind])}, k) THEN 'exact' WHEN {tokens} THEN 'tokens' ELSE 'not_listed' END"


@query(
    f"SELECT doc_id, {_license_sql('permissive')} AS permissive, {_license_sql('commercial')} AS commercial FROM (SELECT doc_id, k, string_split(k, '-') AS z FROM (SELECT doc_id, {NORM_LICENSE.format('r')} AS k FROM (SELECT doc_id, regexp_extract(text, 'Licensed under ([A-Za-z0-9 .-]+)', 1) AS r FROM documents WHERE contains(text, 'Licensed under'))))"
)
def license_gate(spark, sf_dir):
    df = docs(spark, sf_dir).where(F.contains("text", F.lit("Licensed under"))).select("doc_id", F.regexp_extract("text", "Licensed under ([A-Za-z0-9 .-]+)", 1).alias("r"))
    return df.select("doc_id", license_verdict(F.col("r"), "permissive").alias("permissive"), license_verdict(F.col("r"), "commercial").alias("commercial"))


def moderated(mods, threshold: float, names=("toxicity", "severe_toxicity", "obscene", "identity_attack", "sexual_explicit", "threat", "insult")):
    """No score of any moderation (an array of maps) above the threshold; what isn't scored passes."""
    over = F.exists(mods, lambda m: F.exists(F.array(*[F.coalesce(F.element_at(m, F.lit(n)), F.lit(0.0)) for n in names]), lambda x: x > threshold))
    return ~F.coalesce(over, F.lit(False))


@query("SELECT doc_id, NOT coalesce(toxic = 1 OR toxic * 0.8 > 0.5 OR quality * 0.3 > 0.5, false) AS kept FROM documents d LEFT JOIN labels l USING (doc_id)")
def moderation_gate(spark, sf_dir):
    """Flags and moderation scores; the scores here are made from the labels."""
    score = F.create_map(F.lit("toxicity"), F.col("toxic") * F.lit(0.8), F.lit("insult"), F.col("quality") * F.lit(0.3))
    df = docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return df.select("doc_id", (~F.coalesce(F.col("toxic") == 1, F.lit(False)) & moderated(F.array(score), 0.5)).alias("kept"))


#: Bins of a safety table, by pattern; the first that is found names the bin.  A deployment brings its own table.
SAFETY = (
    ("weapons", "(synthesi[sz]e|produce|build)[^.\\n]{0,120}(nerve agent|dirty bomb|anthrax)"), ("attack", "(kill|attack|stalk)[^.\\n]{0,40}my (neighbor|teacher|boss)"),
    ("doxxing", "(find|look up)[^.\\n]{0,60}(home address|social security)"), ("malware", "(write|generate)[^.\\n]{0,40}working[^.\\n]{0,60}(ransomware|keylogger)"), ("self_harm", "how to[^.\\n]{0,40}overdose"),
)
SOFT = bounded("drugs?|hack|hacking|exploit|weapon|gun|suicide|overdose|jailbreak")


@query(
    f"""SELECT conv_id, turn, coalesce({", ".join(f"CASE WHEN regexp_matches({c}, {text_sql('(?i)' + p)}) THEN '{n}' END" for c in ("prompt", "answer") for n, p in SAFETY)},
        CASE WHEN regexp_matches(prompt, {text_sql(SOFT)}) OR regexp_matches(answer, {text_sql(SOFT)}) THEN 'softable' ELSE 'normal' END) AS bin FROM ({QA_DOCS})"""
)
def safety_bins(spark, sf_dir):
    """Hard bins by the prompt and then by the replies, then what may be softened, then the rest."""
    hard = [F.when(F.regexp_like(c, F.lit("(?i)" + p)), n) for c in ("prompt", "answer") for n, p in SAFETY]
    soft = F.regexp_like("prompt", F.lit(SOFT)) | F.regexp_like("answer", F.lit(SOFT))
    return qa_docs(spark, sf_dir).select("conv_id", "turn", F.coalesce(*hard, F.when(soft, "softable").otherwise("normal")).alias("bin"))


# -- structure cleaning ----------------------------------------------------------------------------------------------
@query()
def structure_clean(spark, sf_dir):
    """Pages as structured prose, or why there is none."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return structure.cleaned(pages).select("page_id", "clean", "paragraphs", "reason")


def _fragments(t: str) -> str:
    found = " OR ".join(f"contains(lower({t}), '{p}')" for p in structure.BAD_FRAGMENTS)
    return f"({found} OR regexp_matches(lower({t}), '(^|[^\\p{{L}}\\p{{N}}_])newsletter([^\\p{{L}}\\p{{N}}_]|\\z)'))"


_plain = "coalesce(text, '')"
for _a, _b in structure.ENTITIES:
    _plain = f"replace({_plain}, '{_a}', {text_sql(_b)})"
for _p, _n in (
    (r"\r\n?", "chr(10)"), (r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "' '"), (r"([\p{L}\p{N}_])-\n([\p{L}\p{N}_])", r"'\1\2'"), ("<[^>]{1,160}>", "' '"),
    (r"(?i)(https?://|www\.)[^ \t\n\x0B\f\r]+", "' '"), (r"[\p{L}\p{N}_][^ \t\n\x0B\f\r]*@[^ \t\n\x0B\f\r]+\.[^ \t\n\x0B\f\r]*[\p{L}\p{N}_]", "' '"),
):
    _plain = f"regexp_replace({_plain}, '{_p}', {_n}, 'g')"
_plain = f"translate({_plain}, '“”„’‘`�', '\"\"\"'''''' ')"
for _p, _n in ((r"[ \t\x{A0}]{2,}", "' '"), (r"[ \t]*\n[ \t]*", "chr(10)"), (r"\n{3,}", "repeat(chr(10), 2)"), (r"\A[ \t\n]+|[ \t\n]+\z", "''")):
    _plain = f"regexp_replace({_plain}, '{_p}', {_n}, 'g')"
_head = "substr(t, 1, 2500)"
CLEAN_EARLY = f"""CASE WHEN t = '' THEN 'empty' WHEN {" + ".join([*(literal("t", h) for h in structure.HINTS), "3 * " + literal("t", "�")])} > 0 THEN 'mojibake' WHEN {_fragments("t")} THEN 'boilerplate'
    WHEN len(regexp_extract_all(t, {text_sql(structure.TEMPLATE)})) >= 2 THEN 'template'
    WHEN regexp_matches({_head}, {text_sql(structure.LIST_ARTICLE)}) AND ({literal(_head, ",")} + {literal(_head, ";")} >= 8
      OR len(list_filter(regexp_split_to_array({_head}, '[.;]'), lambda s: len(list_filter(string_split(trim(regexp_replace(s, '{S}', ' ', 'g')), ' '), lambda x: x <> '')) BETWEEN 1 AND 8)) >= 8) THEN 'list_article' END"""


@query(f"SELECT doc_id, {CLEAN_EARLY} AS reason FROM (SELECT doc_id, {_plain} AS t FROM documents)")
def structure_gate(spark, sf_dir):
    """The reasons that are found before a text is rewritten; the others need the rewrite and are tested by goldens."""
    df = structure.cleaned(docs(spark, sf_dir).select("doc_id", "text"))
    early = F.col("reason").isin("empty", "mojibake", "boilerplate", "template", "list_article")
    return df.select("doc_id", F.when(early, F.col("reason")).alias("reason"))


@query()
def structure_reasons(spark, sf_dir):
    """How many documents go for each of the ten reasons."""
    return rules.reason_counts(structure.cleaned(docs(spark, sf_dir).select("doc_id", "text")).select("reason"))
