"""Structure cleaning, rewrites, gates, sources and evaluation on own literals."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import structure as S
from corpusloom.operators import joins, ordering, series
from corpusloom.plans import evaluation, gates
from corpusloom.sources import sinks, text_sources
from corpusloom.streaming import monitors


def one(spark, column, *texts):
    names = [f"c{i}" for i in range(len(texts))]
    return spark.createDataFrame([texts], ", ".join(f"{n} string" for n in names)).select(column(*map(F.col, names)).alias("x")).first().x


@pytest.mark.parametrize(
    ("broken", "whole"),
    [
        ("fÃ¼r schÃ¶n", "für schön"), ("für", "für"), ("â€œgut", "“gut"), ("â€œgutâ€\x9d", "â€œgutâ€\x9d"), ("â€“ strich", "– strich"), ("Ã¤ and 漢", "Ã¤ and 漢"), (None, ""), ("plain", "plain"),
        ("Ã¤ � x", "Ã¤ � x"),
    ],
)
def test_repaired(spark, broken, whole):
    assert one(spark, S.repaired, broken) == whole


def test_plain(spark):
    raw = "A&amp;B <b>bold</b>  x\r\nwrap-\nped see http://a.b/c and me@x.org now\n\n\n\n“q” it’s\x07"
    assert one(spark, S.plain, raw) == 'A&B bold x\nwrapped see and now\n\n"q" it\'s'


@pytest.mark.parametrize(
    ("line", "kept"),
    [
        ("You are here: Home > Shop > Real text here", "Real text here"), ("Home | A | Real text", "Real text"), ("Startseite Heat Pumps Heat Pumps move heat", "Heat Pumps move heat"),
        ("a | b", "a | b"), ("Plain line", "Plain line"), ("x" * 50 + " | " + "y" * 50 + " | z", "x" * 50 + " | " + "y" * 50 + " | z"),
    ],
)
def test_trails(spark, line, kept):
    assert one(spark, S.without_trail, line) == kept


@pytest.mark.parametrize(
    ("line", "is_noise"),
    [
        ("", True), (" - ", True), ("Impressum", True), ("2) two words", True), ("Accept all cookies to go on reading this page", True), ("A line of prose that says something", False), ("* A list item that says something", False),
        ("our newsletter is a thing of beauty, truly", True),
    ],
)
def test_furniture(spark, line, is_noise):
    assert one(spark, S.furniture, line) is is_noise


def test_packing(spark):
    parts = F.array(*[F.lit(c * 30) for c in "abc"])
    assert one(spark, lambda c: S.packed(parts, 50, 70), "") == ["a" * 30 + " " + "b" * 30, "c" * 30]
    assert one(spark, lambda c: S.packed(parts, 10, 30, 1), "") == ["a" * 30, "b" * 30, "c" * 30]
    chunks = one(spark, lambda c: S.book_chunks(c, 50, 200, 300), "One two. " * 400 + "\n\n" + "tail")
    assert all(50 <= len(c) <= 300 for c in chunks) and one(spark, S.book_chunks, None) == []


SENTENCE = "Der Motor ist mit dem Getriebe und der Achse auf eine Weise verbunden die Nummer %d hat. "


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        (None, "empty"), ("  \n ", "empty"), ("kaputt � Ã¤ 漢 text", "mojibake"), ("Please accept all cookies on this page", "boilerplate"),
        ("### Aufgabe\nFrage: was ist das\nAntwort: nichts", "template"),
        ("Das Wort steht für: " + ", ".join(f"Ort {i}" for i in range(12)), "list_article"),
        ("Nur ein Satz der lang genug ist.", "too_few_sentences"),
        ("Dies sind wenige Worte hier. Dies sind andere Worte da.", "too_short"),
        ("".join(SENTENCE % i for i in range(4)), "too_few_words"),
        ("".join(f"The quick engine number {i} drives another machine towards distant harbours every single morning. " for i in range(12)), "language_mismatch"),
        ("Der Hund und die Katze sind auf dem Dach und nicht im Haus mit dem Mann. " * 30, "low_quality"),
        ("".join("Der %shund und die %skatze sind mit dem %skarren auf einem Weg nach %sheim gekommen. " % tuple(a + b for b in "aeiou"[:4]) for a in "bdfghklmnprstwz"), None),
    ],
)
def test_cleaned(spark, text, reason):
    # the repeated sentence falls below the score only through its repetition
    row = S.cleaned(spark.createDataFrame([(text,)], "text string"), options={"score": 0.7}).first()
    assert row.reason == reason and (reason is not None or row.paragraphs >= 1)


def test_rewrites(spark):
    code = "# Copyright me\n# MIT License\n\nimport x\n# note\ny = 1"
    assert one(spark, S.without_banner, code) == "import x\n# note\ny = 1" and one(spark, S.without_banner, "# hello\nx") == "# hello\nx"
    book = "head\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\nbody  text\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nlicence"
    assert one(spark, S.without_book_frame, book) == "head\n\nbody text"
    assert one(spark, S.forum_plain, "a &gt; b\n> quoted\n[link](http://x.y) end​") == "a > b\n\n end"
    assert [tuple(t) for t in one(spark, S.turns, "intro ann: hello there bob_1: hi ann: ")] == [("ann", "hello there"), ("bob_1", "hi")]
    p = one(spark, S.preference, "\n\nHuman: a\n\nAssistant: b\n\nHuman: q?\n\nAssistant: good", "Human: q?\n\nAssistant: bad")
    assert tuple(p) == ("q?", "good", "bad") and tuple(one(spark, S.preference, "plain", "other")) == ("", "plain", "other")
    assert one(spark, S.surrounding, "First one. Second has it. Third.", "has") == "Second has it." and one(spark, S.surrounding, "x", "y") == ""


def test_code_reasons(spark):
    rows = [
        (1, "python", "import a\nfrom b import c\n# x"), (2, "python", "def f(:\n" + "x = 1\n" * 80), (3, "c", "key = AKIA" + "A" * 16 + "\n" + "int x;\n" * 80),
        (4, "c", "int x; // TODO\n" * 60), (5, "c", "int x; // TODO\n" * 60), (6, "js", "<filename>a/node_modules/b.js\n" + "let y = 2;\n" * 60), (7, "python", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, lang string, t string").withColumn("t", F.coalesce("t", F.lit("")))
    got = {r.doc_id: set(r.reasons) for r in gates.code_reasons(df, syntax=True).collect()}
    assert got[1] == {"too_short", "import_only"} and got[2] == {"python_syntax_error"} and got[3] == {"possible_secret_aws_access_key"}
    assert got[4] == {"todo_dense"} and got[5] == {"todo_dense", "exact_duplicate"} and got[6] == {"vendor_or_dependency_path"} and got[7] == {"too_short"}


def test_licences(spark):
    f = lambda name, kind: one(spark, lambda c: gates.license_verdict(c, kind), name)
    assert f("CC BY 4.0", "commercial") == "exact" and f("cc-by-nd-4.0", "permissive") == "no_derivatives" and f("cc_by_sa_4.0", "commercial") == "share_alike"
    assert f("CC BY SA 4.0", "permissive") == "exact" and f("", "permissive") == "missing" and f("proprietary", "permissive") == "not_listed"


def test_ridge(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    y = x @ rng.normal(size=6) + 2 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, y double").repartition(5)
    xb = np.column_stack((x, np.ones(300)))
    hold = 3.0 * np.eye(7)
    hold[-1, -1] = 0
    assert evaluation.ridge_fit(df, "x", "y", 3.0) == pytest.approx(np.linalg.solve(xb.T @ xb + hold, xb.T @ y))


def test_answers(spark):
    probes = spark.createDataFrame([("a",), ("b",)], "id string")
    given = spark.createDataFrame([("a", "x"), ("z", "y")], "id string, answer string")
    assert evaluation.answered(probes.where("id = 'a'"), given).collect() == [("a", "x")]
    with pytest.raises(Exception, match="no answer for b"):
        evaluation.answered(probes, given).collect()
    made = evaluation.semantic_issues(evaluation.probe_table(spark), spark.createDataFrame([("p1", "Nein, idiot")], "id string, answer string")).first()
    assert made.issues == ["wrong_polarity:no", "missing:alpha", "missing_any_group", "forbidden:idiot"]


def test_allocation():
    rows = evaluation.allocated({"a": 5.0, "b": 3.0, "c": 1.0}, 8, 9)
    assert all(sum(n for b, _, n in rows if b == k) == 8 for k in range(9))
    assert [sum(n for _, s, n in rows if s == x) for x in "abc"] == [40, 24, 8]


def test_metrics_that_fail_are_set_apart(spark):
    row = evaluation.combined(spark.range(1), {"good": lambda df: F.col("id") + 1, "bad": lambda df: F.col("nowhere")}).first()
    assert (row.good, row.bad, row.failed) == (1, None, ["bad"])


def test_running_in_two_levels(spark):
    rows = [(s, i, (i * 7) % 5 + 1) for s in ("a", None) for i in [*range(40), 39]]
    df = spark.createDataFrame(rows, "source string, doc_id long, b int")
    whole = sorted(map(tuple, ordering.running(df, ["source"], ["doc_id"], F.col("b"), 10**9).select("source", "rn", "cum").collect()), key=str)
    assert sorted(map(tuple, ordering.running(df, ["source"], ["doc_id"], F.col("b"), 7).select("source", "rn", "cum").collect()), key=str) == whole


def test_spans_that_overlap(spark, monkeypatch):
    df = spark.createDataFrame([(1,), (1,), (5,), (50,)], "p long")
    spans = spark.createDataFrame([(0, 6, "a"), (4, 9, "b")], "lo long, hi long, name string")
    want = [(1, "a"), (1, "a"), (5, "b"), (50, "unknown")]
    assert sorted(map(tuple, joins.span_lookup(df, "p", spans).collect())) == want
    monkeypatch.setattr(joins, "SPAN_ROWS", 1)
    assert sorted(map(tuple, joins.span_lookup(df, "p", spans, 3).collect())) == want


def test_anchors_beyond_the_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "The quick brown fox, jumps over it"), (2, "quick brown"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "quick BROWN fox jumps over"), (2, "brown fox jumps")], "item_id long, text string")
    few = sorted(map(tuple, joins.containment(docs, items, 1).collect()))
    monkeypatch.setattr(joins, "SPAN_ROWS", 0)
    assert sorted(map(tuple, joins.containment(docs, items, 1).collect())) == few == [(1, 1), (1, 2)]


def test_ema_in_blocks(spark):
    df = spark.createDataFrame([("r", i, float(i % 4)) for i in range(50)] + [("q", 0, 3.0)], "run string, step long, v double")
    whole = {(r.run, r.step): r.ema for r in series.ema(df, "run", ["step"], "v", 0.3).collect()}
    parts = {(r.run, r.step): r.ema for r in series.ema(df, "run", ["step"], "v", 0.3, block=7).collect()}
    held = 0.0
    for i in range(50):
        held = (i % 4) if i == 0 else 0.3 * (i % 4) + 0.7 * held
        assert whole["r", i] == pytest.approx(held) and parts["r", i] == pytest.approx(held)
    assert parts["q", 0] == 3.0


def test_archives_and_prompts(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("a.xml", "<d><p>" + "word " * 60 + "</p></d>")
        z.writestr("b.xml", "<d>short</d>")
        z.writestr("c.txt", "word " * 80)
    (tmp_path / "x.zip").write_bytes(data.getvalue())
    got = text_sources.archived_xml(spark, str(tmp_path / "x.zip")).collect()
    assert [(r.source, r.member) for r in got] == [("x.zip", "a.xml")] and "<" not in got[0].text
    rows = spark.createDataFrame([("7", None, "x" * 7000)], "wp string, redner string, text string")
    made = text_sources.prompt_rows(rows, "plenary").first()
    assert made.redner == "?" and len(made.text) == 6000 and made.raw_id is None
    politician = text_sources.prompt_rows(spark.createDataFrame([("n", "1")], "nachname string, id string"), "politician").first()
    assert json.loads(politician.record) == {"nachname": "n"}
    chat = spark.createDataFrame([("prompter", "q"), ("assistant", "a")], "role string, text string")
    assert [tuple(r)[1:3] for r in text_sources.preference_rows(chat, "tree").collect()] == [("q", ""), ("", "a")]


def test_speeches(spark, tmp_path):
    body = "<rede id='r1'><redner><vorname>A</vorname><nachname>B</nachname><fraktion>C</fraktion></redner><p>" + "Rede " * 12 + "</p><p>Ende</p></rede><rede id='r2'><p>kurz</p></rede>"
    (tmp_path / "s.xml").write_text(f"<x>{body}</x>")
    got = text_sources.speeches(spark, str(tmp_path / "s.xml")).collect()
    assert [(r.source, r.speaker, r.group) for r in got] == [("r1", "A B", "C")] and got[0].text.endswith("\nEnde")


def test_lists_categories_and_caps(spark, tmp_path):
    for name in ("b.txt", "a.txt"):
        (tmp_path / name).write_text("x = 1\ny = 2\n\nz = 3")
    assert [p.rsplit("/", 1)[1] for p in text_sources.expanded(spark, [str(tmp_path / "*.txt"), str(tmp_path / "a.txt")])][:2] == ["a.txt", "b.txt"]
    with pytest.raises(FileNotFoundError):
        text_sources.expanded(spark, [str(tmp_path / "none*")])
    lines = [r.line for r in text_sources.code_lines(spark, str(tmp_path / "a.txt")).orderBy("at").collect()]
    assert lines.count("<file_sep>") == 2 and {"x = 1", "y = 2", "z = 3"} <= set(lines)
    (tmp_path / "c.jsonl").write_text("\n".join(json.dumps(r) for r in ({"text": "a", "category": "code"}, {"text": "b", "category": "prose"}, {"text": "c"})))
    assert sorted(r.text for r in text_sources.category_docs(spark, str(tmp_path / "c.jsonl")).collect()) == ["a", "c"]
    spark.createDataFrame([(f"text {i}",) for i in range(100)], "text string").write.parquet(str(tmp_path / "p"))
    capped = text_sources.parquet_texts(spark, str(tmp_path / "p"), most_bytes=200).collect()
    assert sum(len(r.text) + 1 for r in capped[:-1]) < 200 and 200 <= sum(len(r.text) + 1 for r in capped) < 210
    found = {r.path.rsplit("/", 1)[1]: r for r in text_sources.inventory(spark, str(tmp_path / "c.jsonl")).collect()}["c.jsonl"]
    assert found.lines == 3 and found["keys"] == ["text", "category"] and len(found.samples) == 2


def test_sinks_that_resume(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    encode = lambda c: F.transform(F.split(c, " "), lambda w: F.ascii(w))
    assert sinks.write_tokens(docs, str(tmp_path / "t"), encode) and not sinks.write_tokens(docs, str(tmp_path / "t"), encode)
    assert {(r.doc_id, r.start, tuple(r.ids)) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, 0, (97, 98)), (2, 2, (99,))}
    sinks.write_both(docs, str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b" / "text")).count() == spark.read.json(str(tmp_path / "b" / "records")).count() == 2
    sinks.append_reviews(docs.where("doc_id = 1").select("doc_id"), str(tmp_path / "r"))
    assert [r.doc_id for r in sinks.unreviewed(docs, str(tmp_path / "r"), "doc_id long").collect()] == [2]


def test_guards(spark):
    rows = [("r", i, 1.0, 100.0 if i < 6 else 10.0, 0.5 if i < 9 else 0.99, float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "run string, step long, loss double, rate double, memory double, val_loss double")
    got = {(r.step, r.alert) for r in monitors.health_batch(df).collect()}
    assert (8, "warn: throughput collapse") in got and (9, "stop: memory full") in got and (5, "stop: validation loss rises") in got and (4, "stop: validation loss rises") not in got
    state, Row = monitors.fresh(), type("Row", (), {})
    seen = []
    for i, bits in enumerate([1.0, 1.0, 1.0, 1.3, 1.3]):
        row = Row()
        row.bits, row.backup_ok, row.write_seconds = {"de": bits}, i < 2, 1.0 if i < 4 else 9.0
        seen.append(monitors.health_step(state, row, monitors.Limits()))
    assert seen[3] == [] and seen[4] == ["stop: bits a byte of de rise", "warn: slow checkpoint", "stop: backups fail"] and state["stopped"]
    assert monitors.bits_per_byte(spark.createDataFrame([(float(np.log(2) * 2), 0.5)], "l double, t double"), "l", "t").first().bits == pytest.approx(1.0)
