"""Behaviour of operators, functions, sources, sinks and streams on own literals."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import pyfn
from corpusloom.functions import textfn as X
from corpusloom.operators import dedup, joins, ordering, rules, series
from corpusloom.sources import sinks, text_sources
from corpusloom.streaming import monitors


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "lang", "reason"),
    [
        ("short", "en", "too_short"),
        ("word%d " * 60 % tuple(range(60)), "en", None),
        ("word%d " * 35 % tuple(range(35)), "de", "too_short"),
        ("please accept all cookies " + "word%d " * 60 % tuple(range(60)), "en", "boilerplate"),
        ("same same " * 60, "en", "repetitive"),
        ("http://a.b/c%d word%d " * 20 % tuple(range(40)), "en", "url_dense"),
        ("<file_sep>x", "en", None),
        (None, "en", "too_short"),
        ("fÃ¼r " + "word%d " * 60 % tuple(range(60)), "en", "mojibake"),
    ],
)
def test_light_gate(spark, text, lang, reason):
    df = spark.createDataFrame([(1, text, lang)], "doc_id long, text string, lang string")
    assert rules.light_gate(df).first().reason == reason


def test_text_functions(spark):
    assert one(spark, X.collapse(F.col("text")), " a \n b\t") == "a b"
    assert one(spark, X.ascii_fold(F.col("text")), "Größe Übel") == "groesse uebel"
    assert one(spark, X.max_line_repeat(F.col("text")), "a\nb\na\n\n\n a") == 3
    assert one(spark, X.ngram_repetition(F.split("text", " "), 2, 4), "a b a b") == pytest.approx(1 / 3)
    assert one(spark, X.strip_tags(F.col("text")), "<p>a&amp;b</p><br>c") == "a&b c"
    assert one(spark, X.excerpt(F.col("text"), 12), "hello wonderful world") == "hello …"
    assert one(spark, X.strict_normalise(F.col("text")), "\n a\r\nb  c \n") == "a\nb c"


def test_reasons_and_samples(spark):
    df = spark.createDataFrame([(i, "a" if i % 2 else None) for i in range(10)], "doc_id long, reason string")
    assert {tuple(r) for r in rules.reason_counts(df).collect()} == {("a", 5), ("kept", 5)}
    assert [r.doc_id for r in rules.reject_samples(df, 2).orderBy("doc_id").collect()] == [1, 3]


def test_budgets(spark):
    df = spark.createDataFrame([("a", i, 10) for i in range(6)] + [("b", 0, 99)], "source string, doc_id long, b int")
    kept = ordering.budget_prefix(df, ["source"], ["doc_id"], F.col("b"), 25).collect()
    assert sorted((r.source, r.doc_id) for r in kept) == [("a", 0), ("a", 1), ("b", 0)]
    met = ordering.target_stop(df, ["source"], ["doc_id"], F.col("b"), 25).collect()
    assert sorted((r.source, r.doc_id) for r in met) == [("a", 0), ("a", 1), ("a", 2), ("b", 0)]
    turns = ordering.round_robin_budget(df, "source", ["doc_id"], F.col("b"), 125).orderBy("cum").collect()
    assert [(r.source, r.doc_id) for r in turns] == [("a", 0), ("b", 0), ("a", 1)]
    starts = ordering.offsets(spark.range(10).select(F.col("id"), F.lit(2).alias("n")), "id", "n", 3).orderBy("id").collect()
    assert [r.start for r in starts] == list(range(0, 20, 2))


def test_duplicates(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, None), (5, "y")], "doc_id long, k string")
    assert {r.doc_id for r in dedup.first_of_each(df, F.col("k")).where("kept").collect()} == {1, 2, 4, 5}
    assert {r.doc_id for r in dedup.upsert(df.where("k is not null"), "k", [F.col("doc_id")]).collect()} == {3, 5}


def test_span_lookup_both_ways(spark, monkeypatch):
    df = spark.range(20).withColumnRenamed("id", "p")
    spans = spark.createDataFrame([(0, 4, "a"), (10, 12, "b")], "lo long, hi long, name string")
    small = {tuple(r) for r in joins.span_lookup(df, "p", spans).collect()}
    monkeypatch.setattr(joins, "SPAN_ROWS", 1)
    assert {tuple(r) for r in joins.span_lookup(df, "p", spans, 3).collect()} == small
    assert (2, "a") in small and (11, "b") in small and (7, "unknown") in small


def test_anchor_join_equals_the_loop(spark):
    docs = spark.createDataFrame([(1, "The quick brown fox, jumps over it"), (2, "quick brown"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick BROWN fox jumps over"), (2, "brown fox jumps"), (3, "x"), (4, "own fox jumps over it")], "item_id long, text string")
    for least in (1, 20):
        a, b = ({tuple(r) for r in f(docs, items, least).collect()} for f in (joins.containment, joins.containment_loop))
        assert a == b and (1, 1) in a and (1, 4) not in a


def test_replies_overwrite_unanswered_prompts(spark):
    turns = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", " "), (1, 3, "assistant", "c"), (1, 4, "assistant", "d")]
    got = joins.replies(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.turn, r.prompt, r.answer) for r in got] == [(3, "b", "c")]


def metric(spark, values):
    return spark.createDataFrame([("r", i, float(v)) for i, v in enumerate(values)], "run string, step long, v double")


def test_series(spark):
    df = metric(spark, [1, 2, 3, 3, 3, 1])
    s = series.Series("run", ["step"], "v")
    got = df.select("step", s.plateaued(2, 0.1).alias("p"), s.stable_above(3, 3).alias("m"), s.regressed(2).alias("g"), s.improvement(2).alias("i")).orderBy("step").collect()
    assert [r.p for r in got] == [False, False, False, False, True, True]
    assert [r.m for r in got] == [False, False, False, False, True, False]
    assert [r.g for r in got] == [False] * 5 + [True] and got[1].i == 1 and got[0].i == 0
    ema = [r.ema for r in series.ema(df, "run", ["step"], "v", 0.5).orderBy("step").collect()]
    assert ema[:3] == [1.0, 1.5, 2.25]
    runs = series.breaches(metric(spark, [9, 9, 1, 9, 9, 9]), "run", ["step"], F.col("v") > 5, 3).orderBy("step").collect()
    assert [r.breaches for r in runs] == [1, 2, 0, 1, 2, 3] and [r.alarm for r in runs] == [False] * 5 + [True]
    assert series.with_slope(metric(spark, [0, 2, 4]), "run", ["step"], "v").orderBy("step").collect()[2].slope == pytest.approx(2)


def test_python_functions():
    assert pyfn.fold("Ünï-Çode 1²") == "uni code 12"
    page = '<html><head><script>var t="</p>";x()</script></head><body><nav>Home</nav><p>One &amp; two.<br>Three</p></body></html>'
    assert pyfn.visible(page) == "One & two.\nThree"


def test_sources(spark, tmp_path):
    (tmp_path / "lines.txt").write_text("one\n\ntwo\n")
    assert sorted(r.text for r in text_sources.line_docs(spark, str(tmp_path / "lines.txt")).collect()) == ["one", "two"]
    (tmp_path / "blank.txt").write_text("a\n b\n\nc\n\n\n\nd")
    assert sorted(r.text for r in text_sources.blank_separated(spark, str(tmp_path / "blank.txt")).collect()) == ["a b", "c", "d"]
    (tmp_path / "code.txt").write_text("<|code|>python\nx = 1\n<|endcode|>\n<|code|>\ny\n")
    got = {(r.lang, r.text) for r in text_sources.documents(spark, str(tmp_path / "code.txt")).collect()}
    assert got == {("python", "x = 1"), ("", "y")}
    (tmp_path / "repo.txt").write_text("<reponame>a/b\nbody one\n<reponame>c/d\nbody two")
    assert {(r.repo, r.text) for r in text_sources.documents(spark, str(tmp_path / "repo.txt")).collect()} == {("a/b", "body one"), ("c/d", "body two")}
    with gzip.open(tmp_path / "x.jsonl.gz", "wt") as f:
        f.write(json.dumps({"text": "t", "score": 1.5}) + "\nnot json\n")
    rows = text_sources.json_docs(spark, str(tmp_path / "x.jsonl.gz"), "text string, score double").collect()
    assert {(r.text, r.bad_json) for r in rows} == {("t", None), (None, "not json")}
    assert text_sources.inventory(spark, str(tmp_path)).where("lines > 0").count() == 5


def test_message_layouts(spark):
    rows = [(None, "p", "r", None, None, None), (None, None, None, "do", "it", "done"), ([("user", "u")], None, None, None, None, None)]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string>>, prompt string, response string, instruction string, input string, output string")
    got = [[tuple(m) for m in r.messages] for r in text_sources.messages(df).collect()]
    assert got == [[("user", "p"), ("assistant", "r")], [("user", "do\n\nit"), ("assistant", "done")], [("user", "u")]]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "aé", None), (2, "b", "bad"), (3, "c", "bad")], "doc_id long, text string, reason string")
    m = sinks.manifest(df).first()
    assert (m.docs_in, m.docs_written, m.bytes_written, m.dropped) == (3, 1, 4, {"bad": 2})
    sinks.write_gate(df, str(tmp_path / "g"), 1)
    assert spark.read.json(str(tmp_path / "g/rejects")).count() == 1 and spark.read.json(str(tmp_path / "g/kept")).count() == 1
    path = str(tmp_path / "ids")
    assert [sinks.append_missing(d, path, "doc_id") for d in (df, df, df.union(spark.createDataFrame([(9, "z", None)], df.schema)))] == [3, 0, 1]


def test_health_stream_equals_batch(spark, tmp_path):
    rows = [("a", i, 1.0 if i != 8 else 9.0, 60.0 if i in (4, 5, 6) else 1.0) for i in range(12)] + [("b", i, 2.0, 1e-6) for i in range(12)]
    df = spark.createDataFrame(rows, "run string, step long, loss double, grad_norm double")
    expected = {tuple(r) for r in monitors.health_batch(df).collect()}
    assert ("a", 6, "stop: gradient explosion") in expected and ("a", 8, "warn: loss spike") in expected and ("b", 9, "warn: gradient collapse") in expected
    for part in range(3):  # the state crosses batches
        df.where(F.col("step").between(part * 4, part * 4 + 3)).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = monitors.health(stream).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("alerts").collect()} == expected


def test_curriculum(spark):
    rows = [("r", i, v, 1.0) for i, v in enumerate([0.1, 0.9, 0.9, 0.9, 0.5, 0.95, 0.95, 0.95])] + [("s", 0, 0.1, 1.0), ("s", 1, 0.1, 0.5), ("s", 2, 0.1, 1.0)]
    got = monitors.curriculum(spark.createDataFrame(rows, "run string, step long, value double, guard double"), [monitors.Stage("one", 0.8), monitors.Stage("two", 0.9)])
    actions = {(r.run, r.step): r.action for r in got.collect()}
    assert actions[("r", 3)] == "advance" and actions[("r", 7)] == "finished" and actions[("s", 1)] == "stopped" and actions[("s", 2)] == "done"


def test_log_metrics(spark):
    df = spark.createDataFrame([("step 120 | loss 2.5 | lr 3e-4 | tok_s=900",), ("hello",)], "value string")
    got = monitors.log_metrics(df).collect()
    assert len(got) == 1 and (got[0].step, got[0].loss, got[0].lr, got[0].tok_s, got[0].bpb) == (120, 2.5, 3e-4, 900.0, None)
