"""More of the ten operators: repeated ids, hot keys, blocks, bounds, recall on a table, brute force where SQL has no say."""

import itertools
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import binary_records, common, decontamination, language_id, lm_scoring, near_dedup, quality_rules, sharding, toxicity, url_filters
from corpusloom.llm.common import ITEM_WORDS, LOWER, PLAIN, bounded_sample, word_hashes, words_of_texts
from corpusloom.llm.queries import tokenizer_file

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa la mu nu xi pi rho sigma tau".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


# -- words -----------------------------------------------------------------------------------------------------------
def test_words_are_hashed_as_they_are_split():
    rng = random.Random(0)
    texts = [None, "", " \t", "a", "Ab aB  ab\nAB", "ü Ü ß 漢字 🙂", "x" * 3000 + " y " + "x" * 3000, "12-34 a.b"]
    texts += ["".join(rng.choice("abcABC \n\t.ü") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    for table in (PLAIN, LOWER, ITEM_WORDS):
        words = [(t or "").encode().translate(table).split() for t in texts]
        h, sizes = words_of_texts(texts, table)
        assert sizes.tolist() == list(map(len, words))
        flat = [w for ws in words for w in ws]
        by_word, by_hash = dict(zip(flat, h.tolist())), dict(zip(h.tolist(), flat))
        assert [by_word[w] for w in flat] == h.tolist() and len(by_word) == len(by_hash)
        data = " ".join(t or "" for t in texts).encode()
        whole, starts = word_hashes(data, table)
        split = data.translate(table).split()
        for most in (1, 7, 100, 3000, 3001, 5000):
            part, at = word_hashes(data, table, most)
            assert (at == starts).all() and len(set(part.tolist())) == len(set(split)) == len(set(zip(part.tolist(), split)))


# -- 1 ---------------------------------------------------------------------------------------------------------------
def test_scores_of_repeated_ids_equal_the_twin(spark):
    rng = random.Random(4)
    rows = [(1, "a b a b c"), (1, "a b c"), (2, "a b x"), (None, "a b"), (None, None), (4, ""), (1, "a b c")] + [(rng.randint(5, 30), prose(rng, rng.randint(0, 30))) for _ in range(60)]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows])}))
    want = {tuple(r)[:4] for r in con.execute(lm_scoring.ORACLE).fetchall()}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for how in ({}, {"least": 4, "bucket_pairs": 50}, {"hot": 6, "bucket_pairs": 20, "least": 2}):
        assert {tuple(r)[:4] for r in lm_scoring.scores(docs, **how).collect()} == want
    assert {tuple(r)[:4] for r in lm_scoring.relational(docs, 2).collect()} == want


def test_third_order(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c d"), (3, "x b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in lm_scoring.relational(docs, 3).collect()}
    log = lambda x: round(1e6 * np.log(x))
    # a: back off to the word (1 other of 10 words); ab after a: 1 of 1; abc after ab: 1 of 1
    assert got[1].score_micro == log(1) - log(10) + 0 + 0 and got[1].n_backoff == 1


def test_hot_pairs_are_spread():
    rng = np.random.default_rng(1)
    hot = lm_scoring.Frequent(*(np.zeros(0, np.uint64), np.zeros(0, np.int64)) * 2)
    w, row, first = lm_scoring.doc_words(["of the"] * 400)
    h = np.unique(w)
    pair = np.unique(lm_scoring.pair_hashes(w, first))
    hot = lm_scoring.Frequent(h, np.full(len(h), 400), pair, np.full(len(pair), 400))
    buckets = [b for b, _ in lm_scoring.pair_blocks(rng.integers(0, 10**6, 400), (w, row, first), hot, 64)]
    assert len(set(buckets)) > 40


# -- 2 ---------------------------------------------------------------------------------------------------------------
def test_path_lengths_by_walking():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 3))
    forest = quality_rules.grow(x, np.ones(60, bool), 7, 16, 3)
    z = np.arcsinh((x - forest.middle) / forest.scale)
    want = []
    for row in z:
        total = 0.0
        for feature, value, length in zip(forest.feature, forest.value, forest.length):
            node = 0
            while feature[node] >= 0:
                node = 2 * node + 1 + int(row[feature[node]] >= value[node])
            total += length[node]
        want.append(2 ** (-total / 7 / forest.constant))
    assert forest.score(x) == pytest.approx(np.array(want))


def test_samples_don_t_depend_on_chance(spark):
    rows = [(1, f"t{i % 40}") for i in range(400)]
    picks = [sorted(r.text for r in bounded_sample(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), 10).collect()) for n in (1, 4)]
    assert picks[0] == picks[1] and 10 <= len(picks[0]) <= 20


# -- 3 ---------------------------------------------------------------------------------------------------------------
def test_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(binary_records, "RECORDS", 7)
    docs = spark.createDataFrame([(5, "same text")] * 40 + [(i, f"word {i}") for i in range(30)], "doc_id long, text string").repartition(4)
    rows = binary_records.token_records(docs, tokenizer_file("word_bpe_49k.json"), 2).orderBy("start").collect()
    assert len(rows) == 70 and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[:-1])
    per_file = {f: sum(r.file == f for r in rows) for f in {r.file for r in rows}}
    assert max(per_file.values()) <= 7
    sizes = spark.createDataFrame([(20, 3), (10, 5)], "b int, n long")
    assert binary_records.records_a_file(sizes, 10**9) == 8 and binary_records.records_a_file(sizes, 9_000_000) == 1


# -- 5 ---------------------------------------------------------------------------------------------------------------
def test_many_rules_are_joined_and_say_the_same(spark):
    rng = random.Random(3)
    urls = [f"http://{rng.choice(['a.', 'b.a.', ''])}{rng.choice(['x.org', 'y.com', 'org'])}/{rng.choice(['', 'en/', 'en/1', 'de/x'])}" for _ in range(80)] + [None, "nothing", "HTTP://A.X.ORG/en/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [(a, h, p) for a, h, p in itertools.product(("allow", "block"), ("x.org", "org", "a.x.org", "com"), ("/", "/en/", "/de/"))]
    model = url_filters.UrlModel(8, 4, -1, (0,) * 8)
    by_case = {tuple(r) for r in url_filters.judge(pages, model, rules).collect()}
    table = spark.createDataFrame(rules, "action string, host string, path string")
    assert {tuple(r) for r in url_filters.judge(pages, model, table).collect()} == by_case and any(r[3] for r in by_case)


def test_unseen_hosts():
    model = url_filters.fit(url_filters.labelled_urls())
    held = url_filters.labelled_urls(held_out=True)
    seen = {url_filters.split_url(u)[0] for u, _ in url_filters.labelled_urls()}
    fresh = [(u, y) for u, y in held if url_filters.split_url(u)[0] not in seen]
    right = sum((model.bias + sum(model.weights[i] for i in url_filters.features(u, model.dim, model.n)) > 0) == bool(y) for u, y in fresh)
    assert len(fresh) > 150 and right / len(fresh) >= 0.95


# -- 6 ---------------------------------------------------------------------------------------------------------------
def test_long_words_leave_nothing_behind():
    model = language_id.Model(["a", "b"], np.random.default_rng(0).normal(size=(64, 2)).astype(np.float32), np.zeros(2))
    p = language_id.Predictor(model)
    long = "x" * 5000 + " kurz"
    first = p.predict([long, "kurz wort"])
    assert len(p.place) == len(p.rows) == 2 and p.predict([long, "kurz wort"]) == first and len(p.rows) == 2


# -- 7 ---------------------------------------------------------------------------------------------------------------
def test_draws_by_hand(spark):
    layout = sharding.Layout(base=4, weights={0: 3.0})
    tree = layout.tree(5)
    rows = sharding.assign(spark.range(300).withColumnRenamed("id", "doc_id"), 5, layout=layout).collect()
    names = []

    def walk(node):
        names.append(node)
        for c in node.children:
            walk(c)

    walk(tree)
    draws = spark.range(300).select("id", *[sharding.draw(F.col("id"), n).alias(f"d{i}") for i, n in enumerate(names)]).collect()
    at = {id(n): i for i, n in enumerate(names)}
    for row, drawn in zip(sorted(rows, key=lambda r: r.doc_id), sorted(draws, key=lambda r: r.id)):
        node = tree
        while node.shard is None:
            node = min(node.children, key=lambda c: drawn[f"d{at[id(c)]}"])
        assert row.shard == node.shard


# -- 8 ---------------------------------------------------------------------------------------------------------------
def test_viterbi_finds_the_best_path():
    from collections import Counter

    lm = toxicity.char_model(Counter({"bad": 5, "bat": 2, "sad": 3, "a": 4}))

    def cost(steps, choice):
        states = {"": 0.0}
        for ways, k in zip([*steps, [(" ", 0.0)]], [*choice, 0]):
            out, c = ways[k]
            new = {}
            for s, p in states.items():
                for t, q in toxicity.follow(lm, s, out) if out else [(s, 0.0)]:
                    new[t] = max(new.get(t, -1e18), p + q + c)
            states = new
        return states.get("", -1e18)

    for token in ("b4d", "s@d", "b.a.d", "b4+", "b*d"):
        steps = toxicity.steps_of(token, toxicity.PIECE)
        best = max(itertools.product(*[range(len(w)) for w in steps]), key=lambda c: cost(steps, c))
        assert toxicity.likeliest(steps, lm) == "".join(w[k][0] for w, k in zip(steps, best)).strip()


def test_toxicity_learns_from_every_labelled_row(spark):
    rows = [(i, f"alpha w{'abcdefghij'[i % 10]}x" + (" zorble" if i % 50 == 0 else ""), int(i % 25 == 0)) for i in range(17_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    model = toxicity.fit(table.select("doc_id", "text"), table.select("doc_id", "toxic"))
    part = {r.doc_id for r in table.where(F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(2)) == 0).select("doc_id").collect()}
    size = [sum(i in part and y == k for i, _, y in rows) for k in (0, 1)]
    t = sum(i in part and "zorble" in x for i, x, _ in rows)
    assert abs(model.weights["zorble"] - math.log((t + 0.2) / (size[1] + 0.4) / (0.2 / (size[0] + 0.4)))) < 1e-12
    whole = toxicity.char_model(Counter(w for _, x, _ in rows for w in x.split()))
    assert (model.lm.three, model.lm.two, model.lm.one, model.lm.words) == (whole.three, whole.two, whole.one, whole.words)
    # the regression's mean is that of every row of the other part
    found = [toxicity.Scorer(model).evidence([x])[0] for i, x, _ in rows if i not in part]
    assert np.allclose(model.mean, np.mean(found, axis=0)) and np.allclose(model.scale, np.std(found, axis=0) + 1e-6)


def test_only_tokens_that_can_weigh_are_read():
    rng = random.Random(31)
    lm = toxicity.char_model(Counter({"blorgon": 3, "snarfel": 3, "beta": 9, "alpha": 9, "seen": 4}))
    model = toxicity.Model(lm, {"blorgon": 2.0, "snarf~": 1.5, "i10": 1.0, "12": 0.5}, np.array([-3.0, 2.0, 0.0]), np.zeros(2), np.ones(2))
    scorer = toxicity.Scorer(model)
    tokens = ["bl0rg0n!", "sna.rf", "s.n.a.r.f.x", "blorgon!!", "(bl0rgon)", "i10", toxicity.APART + "12", toxicity.APART + "blorgonbeta", "be.ta", "beta!"]
    tokens += ["".join(rng.choice("bl0rgon.snarfe!l112*(") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    weighed = [t for t in tokens if model.of_word(scorer.reader.read(t))]
    assert len(weighed) > 5 and all(map(scorer.worth, weighed)) and not scorer.worth("be.ta")


# -- 9 ---------------------------------------------------------------------------------------------------------------
def test_blocks_say_the_same(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(0, 40))) for i in range(25)] + [(None, prose(rng, 20)), (3, prose(rng, 300))]
    docs = [(i, prose(rng, 60) + " " + (items[i % 27][1] or "") + " " + prose(rng, 20), "x", "y") for i in range(50)] + [(None, None, "x", "y"), (50, items[26][1], "x", "y")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string, n_words string, items string")
    whole = sorted(map(str, decontamination.scan(d, b).collect()))
    assert sorted(map(str, decontamination.scan(d, b, block_bytes=300, shard_words=50).collect())) == whole
    assert {r.longest for r in decontamination.scan(d.where("doc_id = 50"), b).collect()} == {300}
    kept = decontamination.decontaminate(d, b)
    assert kept.columns == d.columns and {r.items for r in kept.collect()} <= {"y"}
    none = decontamination.scan(d, b.where("false")).collect()
    assert all(r.n_hit == 0 for r in none) and len(none) == 52


# -- 10 --------------------------------------------------------------------------------------------------------------
def sets_of(rows, n):
    out = []
    for text in rows:
        w = (text or "").encode().translate(near_dedup.LOWER).split()
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def roots(rows, sets, percent=80):
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(rows))]


def test_repeated_ids_keep_their_links(spark):
    rng = random.Random(8)
    a, b = prose(rng, 120), prose(rng, 120)
    near = lambda t: t + " extra"
    docs = spark.createDataFrame([(1, a), (1, b), (2, near(a)), (3, near(b)), (3, near(b))], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_dedup.clusters(docs).collect()} == {(1, 1), (2, 1), (3, 1)}
    rows = [(7, a), (7, prose(rng, 90)), (3, near(a))]
    kept = near_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([rows[1], rows[2]])


@pytest.mark.parametrize("share", [0.05, 0.24])
def test_groups_near_the_bound(spark, share):
    """Variants of one text around the bound: keys of many classes from several components, against brute force."""
    rng = random.Random(9)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(150)]
    rows = []
    for i in range(160):
        words = list(base)
        for _ in range(int(share * 150 * rng.random())):
            words[rng.randrange(150)] = f"v{rng.randint(0, 10**6)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in near_dedup.clusters(docs, words=1).collect()}
    want = roots(rows, sets_of([t for _, t in rows], 1))
    assert sum(got[i] == want[i] for i in range(160)) >= 158


def test_recall_on_a_table(spark):
    """Every document whose id is divisible by 20 against all rows of the table."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.clusters(docs).collect()}
    sets = sets_of([t for _, t in rows], 4)
    assert [got[i][0] for i, _ in rows] == list(map(len, sets))
    linked = missed = 0
    for k, (i, _) in enumerate(rows):
        if i % 20 == 0 and sets[k]:
            for m, (j, _) in enumerate(rows):
                both = len(sets[k] & sets[m])
                if j != i and 100 * both >= 80 * (len(sets[k]) + len(sets[m]) - both):
                    linked += 1
                    missed += got[i][1] != got[j][1]
    assert linked > 5 and missed == 0


# -- models of all rows ----------------------------------------------------------------------------------------------
def test_order_statistics(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.concatenate((np.zeros(40), rng.exponential(3, 300), np.full(60, 0.25), [1e-300, 1e300]))
    df = spark.createDataFrame([(float(v), int(k)) for v, k in zip(x, rng.integers(0, 2**62, len(x)))], "x double, k long").repartition(3)
    k = sorted(r.k for r in df.collect())
    ranks = [0, 39, 40, 100, 250, 400, 401]
    for few in (1, 50, 10_000):
        monkeypatch.setattr(common, "FEW_VALUES", few)
        assert common.order_statistics(df, {"x": ranks, "k": [0, 7, 401]}) == {"x": np.sort(x)[ranks].tolist(), "k": [k[0], k[7], k[401]]}


def test_quality_rules_are_calibrated_on_every_labelled_row(spark, monkeypatch):
    monkeypatch.setattr(common, "FEW_VALUES", 100)
    rng = random.Random(6)
    texts = [prose(rng, 60) + " !" * rng.randint(0, 9) + " #" * (i % 9 == 0) * rng.randint(0, 60) for i in range(900)]
    rows = [(i, texts[i % 900], int(i % 9 > 0)) for i in range(45_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    model = quality_rules.fit(table.select("doc_id", "text"), table.select("doc_id", "quality"), trees=5, sample=64)
    counts = np.array([quality_rules.count_text(t) for t in texts])
    held = ~quality_rules.base_failed(counts[:, 0], counts[:, 4])
    x = quality_rules.ratios(counts)
    good = np.array([i % 9 > 0 for i in range(900)]) & held
    assert np.allclose(model.forest.middle, np.median(np.repeat(x[good], 50, axis=0), axis=0))
    score = model.forest.score(x)
    own = np.sort(np.repeat(score[good], 50))[::-1]
    bad = np.repeat(score[~good & held], 50)
    bad = np.sort(bad[bad > own[int(len(own) * 0.004)]])
    assert model.cut == (bad[len(bad) // 200] if len(bad) else 2.0)
    # as many trees' rows as there are, each row in one tree
    own = table.where("quality > 0").select("doc_id", *[F.col("doc_id").cast("double").alias(c) for c in quality_rules.RATIOS])
    drawn = quality_rules.pool(own, own.count(), 320)
    assert drawn.shape == (320, len(quality_rules.RATIOS)) and len(set(drawn[:, 0])) == 320


def test_languages_are_learned_from_every_row(spark):
    # a language of few rows, which a sample by hash would hold one of at most
    rows = [(i, ("kla mor tin sel " if i % 2 else "schü keit ung zer ") * 3 + str(i), "ab"[i % 2]) for i in range(9000)]
    rows += [(9000 + i, f"моло дца рек лес {i}", "c") for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = (language_id.fit(docs.repartition(n), max_rows=2000, steps=2000) for n in (1, 5))
    assert one.langs == ["a", "b", "c"] and (one.logits == two.logits).all() and (one.temperature, one.cut) == (two.temperature, two.cut)
    right = language_id.identify(docs, one).where("lang_pred = lang").groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in right if r.lang != "c"} == {"a": 4500, "b": 4500}
    # every row but a fourth takes a step in one run; the runs' sizes are those that were counted
    seen = []
    counted = language_id.averaged_runs
    try:
        language_id.averaged_runs = lambda used, sizes, *more: (seen.append((used, sizes)), counted(used, sizes, *more))[1]
        language_id.fit(docs, max_rows=2000, steps=2000)
    finally:
        language_id.averaged_runs = counted
    used, sizes = seen[0]
    assert {r.run: r["count"] for r in used.groupBy("run").count().collect()} == sizes and len(sizes) == 3
    assert sum(sizes.values()) + docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)) == 0).count() == 9004


# -- what is left on disk and in memory ------------------------------------------------------------------------------
def test_driver_gives_memory_back_in_every_round(spark, monkeypatch):
    assert "native heap" in common.release_driver(spark)
    calls = []
    monkeypatch.setattr(near_dedup, "release_driver", lambda s: calls.append(common.release_driver(s)))
    links = spark.createDataFrame([(i + 1, i) for i in range(20)], "u long, v long")
    found = near_dedup.components(links)
    assert sorted(map(tuple, found.collect())) == [(i + 1, 0) for i in range(20)]
    assert len(calls) > 1


def test_staging_leaves_no_shuffle_files(spark):
    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, rows = shuffles(), spark.range(5000)
    held = common.Staged(rows.repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "tidy")
    assert not shuffles() - before and spark.conf.get(common.SHUFFLES_GO, "false") == "false"
    assert sorted(map(tuple, held.df.collect())) == [(k, 715 if k < 2 else 714) for k in range(7)]
    held.drop()


def test_packed_pairs_of_few_values_are_short():
    rng = np.random.default_rng(5)
    w = np.sort(rng.zipf(1.3, 5000).astype(np.uint64))
    cols = [rng.zipf(1.3, 5000).astype(np.uint64), np.arange(5000), *[np.minimum(rng.zipf(2, 5000), 200).astype(np.uint64) for _ in range(3)]]
    data = lm_scoring.pack(w, *cols)
    plain = sum(len(lm_scoring.planes(x)) for x in (np.diff(w, prepend=np.uint64(0)), cols[0], cols[1].view(np.uint64), *cols[2:]))
    assert len(data) < 0.75 * plain
    assert all((a == b).all() for a, b in zip([w, *cols], lm_scoring.unpack(data)))
