"""Queries over benchmark, labels, conversations, pages, events and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import textfn as X
from corpusloom.operators import dedup, joins, series
from corpusloom.plans.documents import FLAT, S
from corpusloom.plans.registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- documents and benchmark -----------------------------------------------------------------------------------------
NORM = r"' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' '"
PAIRS = f"""SELECT doc_id, item_id FROM (SELECT doc_id, {NORM} AS d FROM documents) a
    JOIN (SELECT item_id, {NORM} AS i FROM benchmark) b ON length(trim(i)) >= 20 AND contains(d, i)"""


@query(PAIRS)
def contamination_anchor(spark, sf_dir):
    return joins.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(f"SELECT item_id, doc_id, rank::INT AS rank FROM (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY doc_id) AS rank FROM ({PAIRS})) WHERE rank <= 3")
def contamination_hits(spark, sf_dir):
    pairs = joins.containment(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return joins.first_hits(pairs).select("item_id", "doc_id", "rank")


@query(f"SELECT doc_id, item_id FROM (SELECT doc_id, sha256(lower({FLAT})) AS k FROM documents) JOIN (SELECT item_id, sha256(lower({FLAT})) AS k FROM benchmark) USING (k)")
def leak_hash(spark, sf_dir):
    return joins.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), X.text_key)


# -- documents and labels --------------------------------------------------------------------------------------------
SCORED = "SELECT doc_id, quality, toxic, (n_chars % 500) / 100.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)"


def scored(spark, sf_dir) -> DataFrame:
    """A stand-in for a model's score between 0 and 5, beside the labels."""
    docs = table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") % 500) / F.lit(100.0)).alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", "toxic", "score")


@query(
    f"""SELECT t, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, CASE WHEN tp = 0 THEN 0.0::DOUBLE ELSE 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM (
        SELECT t, sum((score >= t / 100.0 AND quality = 1)::INT) AS tp, sum((score >= t / 100.0 AND quality = 0)::INT) AS fp, sum((score < t / 100.0 AND quality = 1)::INT) AS fn
        FROM ({SCORED}), (SELECT unnest(range(100, 405, 5)) AS t) GROUP BY t)"""
)
def label_threshold_sweep(spark, sf_dir):
    """Counts by score cell first (at most 500), so the grid meets cells and not rows."""
    cells = scored(spark, sf_dir).groupBy("score", "quality").agg(F.count(F.lit(1)).alias("n"))
    grid = spark.range(100, 405, 5).select(F.col("id").alias("t"))
    over = F.col("score") >= F.col("t") / 100.0
    of = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(F.lit(0)))
    swept = cells.crossJoin(F.broadcast(grid)).groupBy("t").agg(
        of(over & (F.col("quality") == 1)).alias("tp"), of(over & (F.col("quality") == 0)).alias("fp"), of(~over & (F.col("quality") == 1)).alias("fn")
    )
    f1 = F.when(F.col("tp") == 0, F.lit(0.0)).otherwise(2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return swept.withColumn("f1", f1)


@query(
    f"""SELECT count(*) AS n, sum((score >= 2.5 AND quality = 1)::INT)::BIGINT AS tp, sum((score >= 2.5 AND quality = 0)::INT)::BIGINT AS fp,
        sum((score < 2.5 AND quality = 1)::INT)::BIGINT AS fn, sum(abs(round_even(score * 100, 0)::BIGINT - 500 * quality))::BIGINT AS absolute_error_percent FROM ({SCORED})"""
)
def label_metrics(spark, sf_dir):
    df, q = scored(spark, sf_dir), F.col("quality")
    over = F.col("score") >= 2.5
    n = lambda c: F.sum(c.cast("int"))
    error = F.sum(F.abs(F.bround(F.col("score") * 100, 0).cast("long") - 500 * q))
    return df.agg(F.count(F.lit(1)).alias("n"), n(over & (q == 1)).alias("tp"), n(over & (q == 0)).alias("fp"), n(~over & (q == 1)).alias("fn"), error.alias("absolute_error_percent"))


@query(f"SELECT round_even(score, 0)::INT AS bin, count(*) AS n, sum((score >= 3)::INT)::BIGINT AS kept FROM ({SCORED}) GROUP BY 1")
def score_histogram(spark, sf_dir):
    return scored(spark, sf_dir).groupBy(F.bround("score", 0).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("score") >= 3).cast("int")).alias("kept"))


@query("SELECT lang, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY lang")
def toxic_filter(spark, sf_dir):
    toxic = table(spark, sf_dir, "labels").where("toxic = 1")
    return joins.without(table(spark, sf_dir, "documents").select("doc_id", "lang"), toxic, ["doc_id"]).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, source, score FROM documents JOIN ({SCORED}) USING (doc_id) WHERE score BETWEEN 2 AND 3")
def band_join(spark, sf_dir):
    return joins.band(table(spark, sf_dir, "documents").select("doc_id", "source"), scored(spark, sf_dir), "doc_id", "score", 2.0, 3.0)


@query(f"SELECT doc_id, score FROM ({SCORED}) ORDER BY abs(score - 3.0), doc_id LIMIT 50")
def uncertainty_queue(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", "score").orderBy(F.abs(F.col("score") - 3.0), "doc_id").limit(50)


@query("SELECT source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) GROUP BY source")
def reviewed_antijoin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return joins.without(docs, table(spark, sf_dir, "labels"), ["doc_id"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# -- conversations ---------------------------------------------------------------------------------------------------
QA = """SELECT conv_id, turn, prompt, text AS answer FROM (SELECT conv_id, turn, role, text, lag(role) OVER w AS before, lag(text) OVER w AS prompt FROM conversations
    WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'assistant' AND before = 'user'"""
CHAT = """SELECT conv_id, list(struct_pack(turn := turn, role := role, text := coalesce(text, '')) ORDER BY turn) AS m FROM conversations GROUP BY conv_id"""


def chats(spark, sf_dir) -> DataFrame:
    """conv_id, m: the turns in order."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("m"))


@query(QA)
def qa_pairs(spark, sf_dir):
    return joins.replies(table(spark, sf_dir, "conversations"))


@query("SELECT c.conv_id, c.turn, p.role AS parent_role, c.role FROM conversations c JOIN conversations p ON p.conv_id = c.conv_id AND c.turn = p.turn + 1")
def parent_join(spark, sf_dir):
    return joins.parents(table(spark, sf_dir, "conversations"))


@query(
    f"""SELECT conv_id, len(r) > 0 AND len(r) % 2 = 0 AND len(list_filter(r, lambda x, i: x <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS order_ok FROM
        (SELECT conv_id, CASE WHEN m[1].role = 'system' THEN list_transform(m[2:], lambda x: x.role) ELSE list_transform(m, lambda x: x.role) END AS r FROM ({CHAT}))"""
)
def role_order(spark, sf_dir):
    roles = F.transform("m", lambda x: x["role"])
    df = chats(spark, sf_dir).select("conv_id", roles.alias("r"))
    df = df.select("conv_id", F.when(F.col("r")[0] == "system", F.slice("r", F.lit(2), F.size("r"))).otherwise(F.col("r")).alias("r"))
    wrong = F.filter("r", lambda x, i: x != F.when(i % 2 == 0, "user").otherwise("assistant"))
    return df.select("conv_id", ((F.size("r") > 0) & (F.size("r") % 2 == 0) & (F.size(wrong) == 0)).alias("order_ok"))


@query(
    f"""SELECT conv_id, array_to_string(list_concat(CASE WHEN m[1].role = 'system' THEN [] ELSE ['<|system|>' || chr(10) || 'You are a helpful assistant.' || chr(10) || '<|end|>'] END,
        list_transform(m, lambda x: '<|' || x.role || '|>' || chr(10) || trim(x.text) || chr(10) || '<|end|>')), chr(10)) AS rendered FROM ({CHAT})"""
)
def chat_render(spark, sf_dir):
    part = lambda role, text: F.concat(F.lit("<|"), role, F.lit("|>\n"), F.trim(text), F.lit("\n<|end|>"))
    lead = F.array(part(F.lit("system"), F.lit("You are a helpful assistant.")))
    body = F.transform("m", lambda x: part(x["role"], x["text"]))
    has = F.col("m")[0]["role"] == "system"
    return chats(spark, sf_dir).select("conv_id", F.array_join(F.when(has, body).otherwise(F.concat(lead, body)), "\n").alias("rendered"))


KEYED = f"SELECT conv_id, sha256(array_to_string(list_transform(list_filter(m, lambda x: x.role <> 'system'), lambda x: x.role || ':' || lower(trim(x.text))), chr(10))) AS k FROM ({CHAT})"


def chat_keys(spark, sf_dir) -> DataFrame:
    said = F.transform(F.filter("m", lambda x: x["role"] != "system"), lambda x: F.concat(x["role"], F.lit(":"), F.lower(F.trim(x["text"]))))
    return chats(spark, sf_dir).select("conv_id", F.sha2(F.array_join(said, "\n"), 256).alias("k"))


@query(f"SELECT conv_id, row_number() OVER (PARTITION BY k ORDER BY conv_id) = 1 AS kept FROM ({KEYED})")
def chat_dedup(spark, sf_dir):
    return dedup.first_of_each(chat_keys(spark, sf_dir), F.col("k"), "conv_id").select("conv_id", "kept")


@query(
    f"SELECT conv_id, turn, rank::INT AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY sha256(lower({FLAT.replace('text', 'answer')})) ORDER BY conv_id, turn) AS rank FROM ({QA})) WHERE rank <= 3"
)
def answer_cap(spark, sf_dir):
    qa = joins.replies(table(spark, sf_dir, "conversations")).select("conv_id", "turn", X.text_key(F.col("answer")).alias("k"))
    return dedup.capped(qa, F.col("k"), [F.col("conv_id"), F.col("turn")], 3).select("conv_id", "turn", "rank")


@query(
    r"""SELECT conv_id, turn, len(regexp_extract_all(t, '```')) % 2 = 0 AND NOT regexp_matches(t, '(^|\n)[ ]*([-*•]|[0-9]+[.)])[ ]*$') AND NOT regexp_matches(t, '[:;]$')
        AND (length(t) < 80 OR regexp_matches(t, '[.!?…)"»`]$')) AS complete FROM (SELECT conv_id, turn, trim(coalesce(text, ''), ' ') AS t FROM conversations WHERE role = 'assistant')"""
)
def assistant_complete(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.trim(X.text_or_empty(F.col("text"))).alias("t"))
    like = lambda p: F.regexp_like("t", F.lit(p))
    whole = (X.count_of(F.col("t"), "```") % 2 == 0) & ~like("(^|\\n)[ ]*([-*•]|[0-9]+[.)])[ ]*\\z") & ~like("[:;]\\z")
    return df.select("conv_id", "turn", (whole & ((F.length("t") < 80) | like('[.!?…)"»`]\\z'))).alias("complete"))


@query("SELECT role, count(*) AS n, sum(length(text))::BIGINT AS chars, max(turn) AS last_turn FROM conversations GROUP BY role")
def role_profile(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("last_turn"))


@query(
    f"""SELECT conv_id, array_to_string(list_transform(m[1:6], lambda x: x.role || ': ' || x.text), chr(10)) AS dialog FROM ({CHAT}) WHERE len(list_filter(m[1:6], lambda x: x.text <> '')) >= 2"""
)
def dialog_text(spark, sf_dir):
    df = chats(spark, sf_dir).select("conv_id", F.slice("m", 1, 6).alias("m")).where(F.size(F.filter("m", lambda x: x["text"] != "")) >= 2)
    return df.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("dialog"))


# -- pages -----------------------------------------------------------------------------------------------------------
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&"))
STRIPPED = "regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g')"
for _a, _b in ENTITIES:
    STRIPPED = f"replace({STRIPPED}, '{_a}', '{_b}')"


@query(f"SELECT page_id, trim(regexp_replace({STRIPPED}, '{S}', ' ', 'g')) AS text FROM pages")
def tag_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.strip_tags(F.col("html")).alias("text"))


@query("SELECT page_id, replace(regexp_extract(lower(url), '^[a-z]+://([^/?#:]*)', 1), 'www.', '') AS domain FROM pages")
def url_domain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.replace(F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#:]*)", 1), F.lit("www."), F.lit("")).alias("domain"))


@query()
def main_content(spark, sf_dir):
    from corpusloom.functions.pyfn import main_text

    return table(spark, sf_dir, "pages").select("page_id", main_text("html").alias("text"))


# -- events as metric series -----------------------------------------------------------------------------------------
W = "WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"
KEY = ["ts", "event_id"]


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")


def micro(c: str):
    """Millionths, half to even, as a whole number: comparable between engines."""
    return F.bround(F.col(c) * 1e6, 0).cast("long")


@query("SELECT event_id, CASE WHEN x = 0 THEN 0 ELSE floor(regr_slope(value, x) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) * 1000 + 0.2371) END::BIGINT AS slope FROM (SELECT *, (row_number() OVER w - 1)::DOUBLE AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def trend_slope(spark, sf_dir):
    df = series.with_slope(events(spark, sf_dir), "user_id", KEY, "value")
    return df.select("event_id", F.floor(F.col("slope") * 1000 + 0.2371).cast("long").alias("slope"))


@query(
    f"""SELECT event_id, coalesce(value - max(value) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS improvement,
        coalesce(max(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) <= max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) + 0.5, false) AS plateaued,
        count(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3 AND min(value) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 20 AS stable,
        coalesce(max(value) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - value >= 30, false) AS regressed FROM events {W}"""
)
def metric_signals(spark, sf_dir):
    s = series.Series("user_id", KEY, "value")
    return events(spark, sf_dir).select(
        "event_id", s.improvement(5).alias("improvement"), s.plateaued(3, 0.5).alias("plateaued"), s.stable_above(20, 3).alias("stable"), s.regressed(30).alias("regressed")
    )


@query(
    f"""SELECT event_id, breaches::INT AS breaches, breaches >= 2 AS alarm FROM (SELECT event_id, CASE WHEN bad THEN sum(bad::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) ELSE 0 END AS breaches
        FROM (SELECT *, coalesce(value > 50, false) AS bad, sum(CASE WHEN coalesce(value > 50, false) THEN 0 ELSE 1 END) OVER (w ROWS UNBOUNDED PRECEDING) AS island FROM events {W}))"""
)
def k_consecutive(spark, sf_dir):
    df = series.breaches(events(spark, sf_dir), "user_id", KEY, F.col("value") > 50, 2)
    return df.select("event_id", "breaches", "alarm")


@query(f"SELECT event_id, coalesce(count(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) >= 4 AND round_even(value * 1e6, 0) > round_even(3.0 * 1e6 * avg(value) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0), false) AS spike FROM events {W}")
def loss_spike(spark, sf_dir):
    rows = Window.partitionBy("user_id").orderBy(*KEY).rowsBetween(-20, -1)
    over = micro("value") > F.bround(3.0 * 1e6 * F.avg("value").over(rows), 0)
    return events(spark, sf_dir).select("event_id", F.coalesce((F.count("value").over(rows) >= 4) & over, F.lit(False)).alias("spike"))


@query(f"SELECT event_id, value - lag(value) OVER w AS delta FROM events {W}")
def metric_delta(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", series.Series("user_id", KEY, "value").delta().alias("delta"))


@query(f"SELECT event_id, last_value(CASE WHEN n % 5 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS held FROM (SELECT *, row_number() OVER w - 1 AS n FROM events {W})")
def carried_forward(spark, sf_dir):
    return series.carried_forward(events(spark, sf_dir), "user_id", KEY, "value", 5).select("event_id", "held")


@query()
def ema(spark, sf_dir):
    return series.ema(events(spark, sf_dir), "user_id", KEY, "value", 0.3).select("event_id", "ema")


@query("SELECT event_type, count(*) AS n, sum((props ->> 'k')::BIGINT)::BIGINT AS total, max((props ->> 'k')::BIGINT) AS most FROM events GROUP BY event_type")
def json_field(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_counts(spark, sf_dir):
    """An extension beyond the surveyed operators: tumbling windows of an hour."""
    df = events(spark, sf_dir).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return df.select(F.col("w.start").cast(dict(events(spark, sf_dir).dtypes)["ts"]).alias("hour"), "event_type", "n")


# -- embeddings ------------------------------------------------------------------------------------------------------
@query("SELECT vec_id, label, round_even(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) * 1e4, 0)::BIGINT AS square FROM embeddings")
def embedding_norms(spark, sf_dir):
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.bround(square * 1e4, 0).cast("long").alias("square"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding))::INT - 1 AS best, list_position(embedding, list_max(embedding)) - 1 = label AS hit FROM embeddings")
def argmax_accuracy(spark, sf_dir):
    best = (F.array_position("embedding", F.array_max("embedding")) - 1).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", best.alias("best"), (best == F.col("label")).alias("hit"))


@query("SELECT vec_id, round_even(greatest(0.0, least(5.0, 2.5 + list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i % 3 - 1))))) * 1e4, 0)::BIGINT AS score FROM embeddings")
def linear_score(spark, sf_dir):
    dot = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * ((i + 1) % 3 - 1)), F.lit(0.0), lambda a, b: a + b)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(5.0), 2.5 + dot)) * 1e4, 0).cast("long").alias("score"))


@query()
def l2_normalise(spark, sf_dir):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    df = table(spark, sf_dir, "embeddings").withColumn("n", norm)
    return df.select("vec_id", F.transform("embedding", lambda x: F.when(F.col("n") == 0, x.cast("double")).otherwise(x.cast("double") / F.col("n"))).alias("unit"))


# -- carriers for generic operators ----------------------------------------------------------------------------------
@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def topk_sorted(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").limit(25)


@query(
    """SELECT p_partkey, floor(1e6 * w / sum(w) OVER ())::BIGINT AS tokens FROM
       (SELECT p_partkey, (greatest(5, p_size) * CASE WHEN p_size >= 40 THEN 125 WHEN p_size < 10 THEN 75 ELSE 100 END)::BIGINT AS w FROM part)"""
)
def mix_weights(spark, sf_dir):
    scale = F.when(F.col("p_size") >= 40, 125).when(F.col("p_size") < 10, 75).otherwise(100)
    df = table(spark, sf_dir, "part").select("p_partkey", (F.greatest(F.lit(5), F.col("p_size")) * scale).cast("long").alias("w"))
    total = df.agg(F.sum("w").alias("total"))
    return df.crossJoin(F.broadcast(total)).select("p_partkey", F.floor(F.lit(1e6) * F.col("w") / F.col("total")).cast("long").alias("tokens"))


@query(
    """SELECT l_returnflag, l_linestatus, count(*) AS n, sum(round_even(l_quantity, 0)::BIGINT)::BIGINT AS quantity, max(l_extendedprice) AS most FROM lineitem
       WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL"""
)
def grouped_sums(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.bround("l_quantity", 0).cast("long")).alias("quantity"), F.max("l_extendedprice").alias("most"))


@query("SELECT n_name, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def plan_join(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    df = orders.select("o_custkey").join(customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    return df.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n_orders"))
