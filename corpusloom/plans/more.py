"""More queries: code, seed and book gates, answer scoring, evaluation summaries, quotas, cards, dialogue parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X
from corpusloom.operators import dedup, joins, ordering, rules, series
from corpusloom.plans.documents import AUDIT, FLAT, LINE_BYTES, LOW_WORDS, TEXT, WORDS, docs, n_of, quoted
from corpusloom.plans.others import CHAT, QA, W, chats, events, table
from corpusloom.plans.registry import query

T_ = "SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents"


# -- gates -----------------------------------------------------------------------------------------------------------
LANGUAGES = (
    ("python", r"(^|\n)(def|class|import|from) [A-Za-z_]"), ("c", r"(^|\n)#include"), ("java", "public (static|class)"),
    ("javascript", r"(function|const|let|var) [A-Za-z_$]"), ("sql", r"(^|\n)(SELECT|INSERT|CREATE) "), ("markup", "</[a-z]+>"),
)


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in LANGUAGES) + f" ELSE 'text' END AS language FROM ({T_})")
def program_language(spark, sf_dir):
    found = rules.first_reason([(n, F.regexp_like(X.text_or_empty(TEXT), F.lit(p))) for n, p in LANGUAGES])
    return docs(spark, sf_dir).select("doc_id", F.coalesce(found, F.lit("text")).alias("language"))


@query(
    f"""SELECT doc_id, CASE WHEN technical >= 2 THEN 'technical' WHEN procedural >= 2 THEN 'procedural' WHEN numbers * 20 > words THEN 'factual' WHEN opinion >= 2 THEN 'opinion' WHEN words > 400 THEN 'narrative' ELSE 'general' END AS kind,
        numbers::INT AS numbers, round_even(1000.0 * upper / greatest(1, n), 0)::INT AS upper_permille
        FROM (SELECT doc_id, length(t) AS n, {n_of("t", r"\p{Lu}")} AS upper, {n_of("t", "[0-9]+")} AS numbers, len({WORDS.replace("coalesce(text, '')", "t")}) AS words,
              {n_of("lower(t)", "(function|algorithm|server|matrix)")} AS technical, {n_of("lower(t)", "(first|then|next|finally)")} AS procedural, {n_of("lower(t)", "(think|believe|opinion|should)")} AS opinion FROM ({T_}))"""
)
def seed_type(spark, sf_dir):
    t = X.text_or_empty(TEXT)
    low = F.lower(t)
    df = docs(spark, sf_dir).select(
        "doc_id", F.length(t).alias("n"), X.count_of(t, "\\p{Lu}").alias("upper"), X.count_of(t, "[0-9]+").alias("numbers"), F.size(X.words(t)).alias("words"),
        X.count_of(low, "(function|algorithm|server|matrix)").alias("technical"), X.count_of(low, "(first|then|next|finally)").alias("procedural"), X.count_of(low, "(think|believe|opinion|should)").alias("opinion"),
    )
    kind = rules.first_reason(
        [("technical", F.expr("technical >= 2")), ("procedural", F.expr("procedural >= 2")), ("factual", F.expr("numbers * 20 > words")), ("opinion", F.expr("opinion >= 2")), ("narrative", F.expr("words > 400"))]
    )
    permille = F.bround(1000.0 * F.col("upper") / F.greatest(F.lit(1), F.col("n")), 0).cast("int")
    return df.select("doc_id", F.coalesce(kind, F.lit("general")).alias("kind"), "numbers", permille.alias("upper_permille"))


@query(
    f"""SELECT doc_id, len(tok)::INT AS words, {n_of("t", r"[^\p{L}\p{N}\s]")}::INT AS signs, len(list_filter(l, lambda x: regexp_matches(x, '^[ ]*[-*•]')))::INT AS bullets,
        len(list_filter(l, lambda x: regexp_matches(x, '(…|[.]{{3}})$')))::INT AS ellipses, (len(l) - len(list_distinct(l)))::INT AS repeated_lines,
        len(list_filter(tok, lambda x: regexp_matches(x, '[A-Za-z]')))::INT AS worded, list_max(list_transform(tok, lambda x: length(x)))::INT AS longest, {n_of("t", "[(){}]")}::INT AS brackets
        FROM (SELECT doc_id, t, string_split(t, chr(10)) AS l, list_filter(string_split({FLAT.replace("coalesce(text, '')", "t")}, ' '), lambda x: x <> '') AS tok FROM ({T_}))"""
)
def curator_signals(spark, sf_dir):
    """Signals by their published descriptions; the formulas are our own."""
    t = X.text_or_empty(TEXT)
    df = docs(spark, sf_dir).select("doc_id", t.alias("t"), X.lines(t).alias("l"), X.tokens(t).alias("tok"))
    like = lambda c, p: F.size(F.filter(c, lambda x: F.regexp_like(x, F.lit(p))))
    return df.select(
        "doc_id", F.size("tok").alias("words"), X.symbol_count(F.col("t")).alias("signs"), like("l", "^[ ]*[-*•]").alias("bullets"), like("l", "(…|[.]{3})\\z").alias("ellipses"),
        (F.size("l") - F.size(F.array_distinct("l"))).alias("repeated_lines"), like("tok", "[A-Za-z]").alias("worded"),
        F.array_max(F.transform("tok", lambda x: F.length(x))).alias("longest"), X.count_of(F.col("t"), "[(){}]").alias("brackets"),
    )


@query(
    r"""SELECT license, CASE WHEN regexp_matches(license, '(^|-)nd(-|$)') THEN 'denied' WHEN regexp_matches(license, '(^|-)nc(-|$)') THEN 'non_commercial' WHEN regexp_matches(license, '(^|-)sa(-|$)') THEN 'share_alike' ELSE 'open' END AS class, count(*) AS n
        FROM (SELECT regexp_replace(lower(trim(regexp_extract(text, 'Licensed under ([A-Za-z0-9 .-]+)', 1))), '[ .]+', '-', 'g') AS license FROM documents) WHERE license <> '' GROUP BY ALL"""
)
def license_classes(spark, sf_dir):
    raw = F.regexp_replace(F.lower(F.trim(F.regexp_extract("text", "Licensed under ([A-Za-z0-9 .-]+)", 1))), "[ .]+", "-")
    like = lambda x: F.regexp_like("license", F.lit(f"(^|-){x}(-|$)"))
    kind = F.when(like("nd"), "denied").when(like("nc"), "non_commercial").when(like("sa"), "share_alike").otherwise("open")
    return docs(spark, sf_dir).select(raw.alias("license")).where("license <> ''").groupBy("license", kind.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size > 45 THEN 'size' WHEN p_retailprice > 1800 THEN 'price' END AS reason FROM part")
def metadata_gate(spark, sf_dir):
    """A missing value passes: null compares as not above."""
    return table(spark, sf_dir, "part").select("p_partkey", rules.first_reason([("size", F.col("p_size") > 45), ("price", F.col("p_retailprice") > 1800)]).alias("reason"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN length(trim(prompt)) < 8 THEN 'short_prompt' WHEN length(trim(answer)) < 20 THEN 'short_answer' WHEN length(answer) > 8000 THEN 'long_answer'
        WHEN lower(trim(prompt)) = lower(trim(answer)) THEN 'echo' WHEN len(w) >= 24 AND 1 - len(list_distinct(w))::DOUBLE / len(w) > 0.7 THEN 'repetitive' END AS reason
        FROM (SELECT *, regexp_extract_all(lower(answer), '{X.WORD}') AS w FROM ({QA}))"""
)
def answer_gate(spark, sf_dir):
    qa = joins.replies(table(spark, sf_dir, "conversations")).withColumn("w", X.words(F.lower("answer")))
    p, a = F.trim("prompt"), F.trim("answer")
    named = [
        ("short_prompt", F.length(p) < 8), ("short_answer", F.length(a) < 20), ("long_answer", F.length("answer") > 8000),
        ("echo", F.lower(p) == F.lower(a)), ("repetitive", X.distinct_share_lost(F.col("w"), 24) > 0.7),
    ]
    return qa.select("conv_id", "turn", rules.first_reason(named).alias("reason"))


# -- duplicates, quotas, holdouts ------------------------------------------------------------------------------------
@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, (length(text) // 50) ORDER BY doc_id) AS r FROM documents) WHERE r = 5")
def bucket_flags(spark, sf_dir):
    """The row at which a bucket reaches five."""
    df = docs(spark, sf_dir).select("doc_id", "lang", F.floor(F.length("text") / 50).alias("b"))
    return dedup.ranked(df, [F.col("lang"), F.col("b")], [F.col("doc_id")]).where("rank = 5").select("doc_id")


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events WHERE value IS NOT NULL) WHERE r = 1")
def best_of_each(spark, sf_dir):
    """The best row of each, the earliest of equals: an aggregate of structs, so a row a task and key is shuffled."""
    best = F.max(F.struct("value", (-F.col("event_id")).alias("e")))
    df = events(spark, sf_dir).where("value IS NOT NULL").groupBy("user_id").agg(best.alias("b"))
    return df.select("user_id", (-F.col("b.e")).alias("event_id"), F.col("b.value").alias("value"))


@query("SELECT user_id, string_agg(event_type, '>' ORDER BY ts, event_id) AS path FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r <= 3 GROUP BY user_id")
def first_few_joined(spark, sf_dir):
    first = ordering.first_n(events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), ["user_id"], [F.col("ts"), F.col("event_id")], 3)
    path = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_type"))), lambda x: x["event_type"]), ">")
    return first.groupBy("user_id").agg(path.alias("path"))


@query(
    """SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('c|' || doc_id)) AS r FROM documents), (SELECT greatest(180, floor(1.15 * count(*))) AS cap FROM documents WHERE lang = 'de')
       WHERE lang <> 'en' OR r <= cap"""
)
def category_cap(spark, sf_dir):
    """One category at most 1.15 times another's size: a count of one row, met by every row's rank."""
    df = docs(spark, sf_dir).select("doc_id", "lang")
    cap = df.where("lang = 'de'").agg(F.greatest(F.lit(180), F.floor(1.15 * F.count(F.lit(1)))).alias("cap"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(X.shuffle_key("c", F.col("doc_id").cast("string"))))
    return df.withColumn("r", rank).crossJoin(F.broadcast(cap)).where("lang <> 'en' OR r <= cap").select("doc_id", "lang")


@query(f"SELECT shard, bytes::BIGINT AS bytes FROM (SELECT shard, bytes, sum(bytes) OVER (ORDER BY shard) - bytes AS before FROM (SELECT doc_id // 100 AS shard, sum({LINE_BYTES}) AS bytes FROM documents GROUP BY 1)) WHERE before < 1000000")
def shard_target(spark, sf_dir):
    """Whole shards until the target is met."""
    df = docs(spark, sf_dir).groupBy(F.floor(F.col("doc_id") / 100).alias("shard")).agg(F.sum(ordering.row_bytes()).alias("bytes"))
    before = F.sum("bytes").over(Window.orderBy("shard")) - F.col("bytes")
    return df.withColumn("before", before).where("before < 1000000").select("shard", "bytes")


@query("SELECT route, count(*) AS n FROM (SELECT CASE WHEN toxic = 1 THEN 'reject' WHEN ('0x' || substr(sha256('h:' || d.doc_id), 1, 16))::UBIGINT % 20 = 0 THEN 'holdout' ELSE 'train' END AS route FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id) GROUP BY route")
def routed(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    b = X.bucket(F.concat(F.lit("h:"), F.col("doc_id").cast("string")), 20)
    return df.select(F.when(F.col("toxic") == 1, "reject").when(b == 0, "holdout").otherwise("train").alias("route")).groupBy("route").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d FROM documents WHERE doc_id % 3 = 0) WHERE d = doc_id)")
def resume_antijoin(spark, sf_dir):
    """What a restarted sink has left to write."""
    df = docs(spark, sf_dir).select("doc_id")
    return joins.without(df, df.where("doc_id % 3 = 0"), ["doc_id"])


@query(
    """WITH plan(source, target) AS (VALUES ('src0', 10), ('src1', 1000000), ('missing', 5)), have AS (SELECT source, count(*) AS n FROM documents GROUP BY source)
       SELECT p.source, coalesce(n, 0)::BIGINT AS n, CASE WHEN n IS NULL THEN 'missing' WHEN n < target THEN 'short' ELSE 'ready' END AS status FROM plan p LEFT JOIN have h ON h.source = p.source"""
)
def plan_status(spark, sf_dir):
    plan = spark.createDataFrame([("src0", 10), ("src1", 1_000_000), ("missing", 5)], "source string, target int")
    have = docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") < F.col("target"), "short").otherwise("ready")
    return plan.join(have, "source", "left").select("source", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


# -- answers and evaluation ------------------------------------------------------------------------------------------
@query(
    f"""SELECT conv_id, turn, CASE WHEN na = 0 OR nb = 0 OR c = 0 THEN 0.0::DOUBLE ELSE 2.0 * c / (na + nb) END AS f1
        FROM (SELECT conv_id, turn, len(a) AS na, len(b) AS nb, len(list_intersect(a, b)) AS c FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(prompt), '{X.WORD}')) AS a, list_distinct(regexp_extract_all(lower(answer), '{X.WORD}')) AS b FROM ({QA})))"""
)
def token_f1(spark, sf_dir):
    qa = joins.replies(table(spark, sf_dir, "conversations"))
    qa = qa.select("conv_id", "turn", F.array_distinct(X.words(F.lower("prompt"))).alias("a"), F.array_distinct(X.words(F.lower("answer"))).alias("b"))
    qa = qa.select("conv_id", "turn", F.size("a").alias("na"), F.size("b").alias("nb"), F.size(F.array_intersect("a", "b")).alias("c"))
    return qa.select("conv_id", "turn", F.when(F.expr("na = 0 OR nb = 0 OR c = 0"), F.lit(0.0)).otherwise(2.0 * F.col("c") / (F.col("na") + F.col("nb"))).alias("f1"))


@query(
    f"""SELECT conv_id, turn, greatest(0.0, base - CASE WHEN bad THEN 0.4 ELSE 0 END - CASE WHEN garbage THEN 0.3 ELSE 0 END)::DOUBLE AS score FROM
        (SELECT conv_id, turn, CASE WHEN contains(low, 'the') OR contains(low, 'is') THEN 1.0 WHEN length(low) > 40 THEN 0.5 ELSE 0.0 END AS base, contains(low, 'idiot') OR contains(low, 'http') AS bad,
         regexp_matches(answer, '(\\*{{3}}|#{{3}}|%{{3}})') AS garbage FROM (SELECT *, lower(answer) AS low FROM ({QA})))"""
)
def answer_score(spark, sf_dir):
    low = F.lower("answer")
    has = lambda *xs: rules.contains_any(low, xs)
    base = F.when(has("the", "is"), 1.0).when(F.length("answer") > 40, 0.5).otherwise(0.0)
    lost = F.when(has("idiot", "http"), 0.4).otherwise(0.0), F.when(F.regexp_like("answer", F.lit("(\\*{3}|#{3}|%{3})")), 0.3).otherwise(0.0)
    decimal = lambda c: c.cast("decimal(3,1)")
    score = F.greatest(decimal(F.lit(0)), decimal(base) - decimal(lost[0]) - decimal(lost[1]))
    return joins.replies(table(spark, sf_dir, "conversations")).select("conv_id", "turn", score.cast("double").alias("score"))


@query(
    r"""SELECT conv_id, turn, coalesce(try_cast(coalesce(nullif(list_extract(regexp_extract_all(t, 'Bewertung:[ \t\n]*([0-5])', 1), -1), ''), list_extract(regexp_extract_all(' ' || t || ' ', '[^\p{L}\p{N}_]([0-5])[^\p{L}\p{N}_]', 1), -1)) AS INT), -1) AS last,
        coalesce(try_cast(regexp_extract(t, '([1-5])', 1) AS INT), 0) AS first, coalesce(try_cast(regexp_extract(t, '([1-5])', 1) AS INT), 0) >= 3 AS kept FROM (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations)"""
)
def parsed_scores(spark, sf_dir):
    """A judge's score: the last tagged digit, else the last digit by itself (-1: none); or the first of 1 to 5 and whether it keeps."""
    t = X.text_or_empty(TEXT)
    tagged = F.try_element_at(F.regexp_extract_all(t, F.lit("Bewertung:[ \\t\\n]*([0-5])"), F.lit(1)), F.lit(-1))
    bare = F.try_element_at(F.regexp_extract_all(F.concat(F.lit(" "), t, F.lit(" ")), F.lit("[^\\p{L}\\p{N}_]([0-5])[^\\p{L}\\p{N}_]"), F.lit(1)), F.lit(-1))
    first = F.coalesce(F.nullif(F.regexp_extract(t, "([1-5])", 1), F.lit("")).try_cast("int"), F.lit(0))
    last = F.coalesce(F.coalesce(tagged, bare).try_cast("int"), F.lit(-1))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", last.alias("last"), first.alias("first"), (first >= 3).alias("kept"))


@query("SELECT event_type, count(*) AS n, sum((value > 10)::INT)::BIGINT AS passed, bool_and(value > 0) AS clean, CASE WHEN bool_and(value > 0) THEN 'promote' ELSE 'hold' END AS verdict FROM events GROUP BY event_type")
def gate_summary(spark, sf_dir):
    clean = F.bool_and(F.col("value") > 0)
    return events(spark, sf_dir).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 10).cast("int")).alias("passed"), clean.alias("clean"), F.when(clean, "promote").otherwise("hold").alias("verdict")
    )


@query("SELECT lang, count(*) FILTER (WHERE toxic = 0)::BIGINT AS t0, count(*) FILTER (WHERE toxic = 1)::BIGINT AS t1 FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def label_pivot(spark, sf_dir):
    df = docs(spark, sf_dir).select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    p = df.groupBy("lang").pivot("toxic", [0, 1]).agg(F.count(F.lit(1)))
    return p.select("lang", F.coalesce("0", F.lit(0)).alias("t0"), F.coalesce("1", F.lit(0)).alias("t1"))


@query("SELECT event_type, count(*) AS n, floor(1e3 * avg(value))::BIGINT AS mean_milli, CASE WHEN count(*) = 1 THEN 0 ELSE floor(1e3 * stddev_pop(value))::BIGINT END AS spread_milli FROM events GROUP BY event_type")
def seed_sweep(spark, sf_dir):
    spread = F.when(F.count(F.lit(1)) == 1, F.lit(0)).otherwise(F.floor(1e3 * F.stddev_pop("value")))
    return events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.floor(1e3 * F.avg("value")).alias("mean_milli"), spread.alias("spread_milli"))


@query(
    """WITH price(model, cents) AS (VALUES ('user', 3), ('assistant', 15)) SELECT role AS model, sum(length(text))::BIGINT AS chars, (sum(length(text)) // 4 * max(cents))::BIGINT AS cost
       FROM conversations JOIN price ON model = role GROUP BY role"""
)
def cost_accounting(spark, sf_dir):
    price = spark.createDataFrame([("user", 3), ("assistant", 15)], "model string, cents int")
    df = table(spark, sf_dir, "conversations").join(F.broadcast(price), F.col("role") == F.col("model"))
    return df.groupBy("model").agg(F.sum(F.length("text")).alias("chars"), (F.floor(F.sum(F.length("text")) / 4) * F.max("cents")).alias("cost"))


@query("SELECT lang, sum(strlen(text))::BIGINT AS bytes, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE / sum(strlen(text)) AS tokens_per_byte FROM (SELECT lang, text, 1 + len(regexp_extract_all(text, '" + X.TOKEN_ESTIMATE + "')) AS n FROM documents) GROUP BY lang")
def fertility(spark, sf_dir):
    df = docs(spark, sf_dir).select("lang", F.octet_length("text").alias("b"), X.token_estimate(TEXT).alias("n"))
    return df.groupBy("lang").agg(F.sum("b").alias("bytes"), F.sum("n").alias("tokens"), (F.sum("n") / F.sum("b")).alias("tokens_per_byte"))


@query("SELECT CASE WHEN p_retailprice < 950 THEN 'low' WHEN p_retailprice < 1200 THEN 'middle' ELSE 'high' END AS bucket, p_size // 10 AS size_class, count(*) AS n FROM part GROUP BY ALL")
def perplexity_buckets(spark, sf_dir):
    price = F.col("p_retailprice")
    bucket = F.when(price < 950, "low").when(price < 1200, "middle").otherwise("high")
    return table(spark, sf_dir, "part").groupBy(bucket.alias("bucket"), F.floor(F.col("p_size") / 10).cast("int").alias("size_class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey, score, CASE WHEN score >= 70 THEN 'strong' WHEN score >= 40 THEN 'fair' ELSE 'weak' END AS label FROM
       (SELECT c_custkey, greatest(0, least(100, floor(10 * log10(greatest(1, c_acctbal)) + (c_custkey % 7) * 5)))::BIGINT AS score FROM customer)"""
)
def card_score(spark, sf_dir):
    raw = F.floor(10 * F.log10(F.greatest(F.lit(1.0), F.col("c_acctbal"))) + (F.col("c_custkey") % 7) * 5)
    df = table(spark, sf_dir, "customer").select("c_custkey", F.greatest(F.lit(0), F.least(F.lit(100), raw)).cast("long").alias("score"))
    return df.withColumn("label", F.when(F.col("score") >= 70, "strong").when(F.col("score") >= 40, "fair").otherwise("weak"))


@query("SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value < 0 THEN 'danger' WHEN value >= 75 THEN 'strong' WHEN value >= 10 THEN 'watch' ELSE 'weak' END AS status FROM events")
def margin_status(spark, sf_dir):
    v = F.col("value")
    return events(spark, sf_dir).select("event_id", F.when(v.isNull(), "unknown").when(v < 0, "danger").when(v >= 75, "strong").when(v >= 10, "watch").otherwise("weak").alias("status"))


@query(
    f"""SELECT event_id, breaches::INT AS breaches FROM (SELECT event_id, CASE WHEN bad THEN sum(bad::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS breaches
        FROM (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island
        FROM (SELECT *, row_number() OVER w >= 5 AND peak > 0 AND value < peak * 0.3::DOUBLE AS bad FROM (SELECT *, max(value) OVER (w ROWS UNBOUNDED PRECEDING) AS peak FROM events {W}) {W})))"""
)
def throughput_collapse(spark, sf_dir):
    return series.throughput_collapse(events(spark, sf_dir), "user_id", ["ts", "event_id"], "value", 0.3, 5, 3).select("event_id", "breaches")


# -- dialogue and records --------------------------------------------------------------------------------------------
@query(f"SELECT conv_id, len(regexp_extract_all(r, '<turn:([a-z]+)>'))::INT AS turns, regexp_extract(r, '<turn:([a-z]+)>', 1) AS first_role FROM (SELECT conv_id, array_to_string(list_transform(m, lambda x: '<turn:' || x.role || '>' || x.text), '') AS r FROM ({CHAT}))")
def chat_parse(spark, sf_dir):
    """Roles read back from rendered text."""
    text = F.array_join(F.transform("m", lambda x: F.concat(F.lit("<turn:"), x["role"], F.lit(">"), x["text"])), "")
    df = chats(spark, sf_dir).select("conv_id", text.alias("r"))
    roles = F.regexp_extract_all("r", F.lit("<turn:([a-z]+)>"), F.lit(1))
    return df.select("conv_id", F.size(roles).alias("turns"), F.coalesce(F.get(roles, F.lit(0)), F.lit("")).alias("first_role"))


CLIPPED = "substr(f, 1, 60)"
BACK = f"strpos(reverse({CLIPPED}), ' ')"


@query(f"SELECT doc_id, CASE WHEN length(f) <= 60 THEN f ELSE rtrim(CASE WHEN {BACK} BETWEEN 1 AND 80 THEN substr(f, 1, 60 - {BACK}) ELSE {CLIPPED} END) || ' …' END AS preview FROM (SELECT doc_id, " + FLAT + " AS f FROM documents)")
def preview(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.excerpt(F.col("text"), 60).alias("preview"))


@query(f"SELECT conv_id, turn, 'Question: ' || trim(prompt) || chr(10) || 'Answer: ' || trim(answer) AS text FROM ({QA})")
def qa_text(spark, sf_dir):
    text = F.concat(F.lit("Question: "), F.trim("prompt"), F.lit("\nAnswer: "), F.trim("answer"))
    return joins.replies(table(spark, sf_dir, "conversations")).select("conv_id", "turn", text.alias("text"))


@query("SELECT event_id, coalesce(props ->> 'k', props) AS picked, coalesce(event_type, '') || ':' || coalesce(props ->> 'k', '') AS group_key FROM events")
def record_fields(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    df = table(spark, sf_dir, "events")
    return df.select("event_id", F.coalesce(k, F.col("props")).alias("picked"), F.concat(F.coalesce("event_type", F.lit("")), F.lit(":"), F.coalesce(k, F.lit(""))).alias("group_key"))


@query(AUDIT + "SELECT flag, count(DISTINCT source) AS sources, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM d) AS rate FROM (SELECT source, unnest(fl) AS flag FROM d) GROUP BY flag")
def flag_rates(spark, sf_dir):
    judged = rules.audit(docs(spark, sf_dir)).select("source", "flags")
    n = docs(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))
    each = judged.select("source", F.explode_outer("flags").alias("flag")).where("flag IS NOT NULL")
    by = each.groupBy("flag", "source").agg(F.count(F.lit(1)).alias("k")).groupBy("flag").agg(F.count(F.lit(1)).alias("sources"), F.sum("k").alias("n"))
    return by.crossJoin(F.broadcast(n)).select("flag", "sources", "n", (F.col("n") / F.col("total")).alias("rate"))


@query(f"SELECT lang, len(list_filter(list_distinct(flatten(list({LOW_WORDS}))), lambda w: list_contains({quoted(X.GERMAN_STOPWORDS)}, w)))::INT AS stopwords FROM documents GROUP BY lang")
def stopword_coverage(spark, sf_dir):
    """Which stopwords a language's documents hold at all: found a row at a time, so few rows meet."""
    known = F.array(*map(F.lit, X.GERMAN_STOPWORDS))
    df = docs(spark, sf_dir).select("lang", F.explode_outer(F.array_intersect(X.words(F.lower("text")), known)).alias("w"))
    return df.groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count("w").cast("int").alias("stopwords"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) EXCEPT SELECT doc_id, source FROM documents WHERE lang = 'en'")
def set_difference(spark, sf_dir):
    d = docs(spark, sf_dir).select("doc_id", "source", "lang")
    good = d.join(table(spark, sf_dir, "labels").where("quality = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "source")
    return good.subtract(d.where("lang = 'en'").select("doc_id", "source"))

