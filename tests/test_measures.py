import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgauge.operators import classify, diversity, mauve, vectors


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{'abcdefghij'[i % 10]}{'xyz'[i % 3]}{'q' * (i // 30)}" for i in range(120)]
    rows = []
    for i in range(60):
        label = "pos" if i % 2 else "neg"
        pool = words[:90] if i % 2 else words[30:]
        rows.append((f"d{i % 2}", i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 80))), label))
    return spark.createDataFrame(rows, "dataset_id string, row_id bigint, text string, label string")


def tokens(corpus):
    out = {}
    for r in corpus.orderBy("row_id").collect():
        out.setdefault(r["dataset_id"], []).extend("".join(c for c in r["text"] if c.isascii() and c.isalpha() or c == " ").split(" "))
    return out


def test_distinctness(spark, corpus):
    counts = diversity.token_counts(corpus, ["dataset_id"])
    got = {r[0]: r[1] for r in diversity.distinctness(counts, ["dataset_id"]).collect()}
    for d, t in tokens(corpus).items():
        assert got[d] == pytest.approx(len(set(t)) / len(t))


def test_rarefied_equals_exact_expectation(spark, corpus):
    m = 50
    got = {r[0]: r[1] for r in diversity.average_distinctness(corpus, m=m).collect()}
    for d, t in tokens(corpus).items():
        n = len(t)
        want = sum(1 - math.comb(n - k, m) / math.comb(n, m) for k in Counter(t).values()) / m
        assert got[d] == pytest.approx(want, abs=1e-9)


def test_rarefied_edge_sizes(spark):
    df = spark.createDataFrame([("a", 1, "x x x y"), ("b", 2, "x y"), ("c", 3, "x x x x x")], "dataset_id string, row_id bigint, text string")
    found = diversity.average_distinctness(df, m=4).collect()
    got = {r[0]: r[1] for r in found}
    assert {r[0]: r["basis"] for r in found} == {"a": "rarefied", "b": "plain", "c": "rarefied"}
    assert got == pytest.approx({"a": 0.5, "b": 1.0, "c": 0.25})


def test_sampled_is_close_to_rarefied(spark, corpus):
    exact = {r[0]: r[1] for r in diversity.average_distinctness(corpus, m=100).collect()}
    got = {r[0]: r[1] for r in diversity.sampled_distinctness(corpus, m=100, repetitions=60).collect()}
    for d in exact:
        assert got[d] == pytest.approx(exact[d], abs=0.02)


def test_sampling_everything_gives_plain_distinctness(spark, corpus):
    for d, t in tokens(corpus).items():
        one = corpus.filter(F.col("dataset_id") == d)
        got = diversity.sampled_distinctness(one, m=len(t), repetitions=2).first()[1]
        assert got == pytest.approx(len(set(t)) / len(t))


def test_lemma_lexicon_and_stop_words(spark):
    df = spark.createDataFrame([("d", 1, "The mice ran, running MICE! -- cats")], "dataset_id string, row_id bigint, text string")
    lexicon = spark.createDataFrame([("mice", "mouse"), ("ran", "run"), ("running", "run")], "word string, lemma string")
    got = {r["token"]: r["n"] for r in diversity.lemma_counts(df, ["dataset_id"], lexicon).collect()}
    assert got == {"mouse": 2, "run": 2, "cat": 1}
    stop = spark.createDataFrame([("mice",)], "word string")
    got = {r["token"] for r in diversity.lemma_counts(df, ["dataset_id"], None, stop).collect()}
    assert got == {"the", "ran", "runn", "cat"}


def test_corpus_budget(spark, corpus):
    for budget in (1, 100, 10_000_000):
        cut = diversity.corpus_budget(corpus, budget=budget)
        for d in ("d0", "d1"):
            texts = [r["text"] for r in corpus.filter(F.col("dataset_id") == d).orderBy("row_id").collect()]
            kept = [r["text"] for r in cut.filter(F.col("dataset_id") == d).orderBy("row_id").collect()]
            assert " ".join(kept).rstrip() == " ".join(texts)[:budget].rstrip()


def naive_bayes(train, test, labels):
    docs, counts = Counter(l for _, l in train), {l: Counter() for l in labels}
    for t, l in train:
        counts[l].update(w for w in "".join(c for c in t.lower() if c.isascii() and c.isalpha() or c == " ").split(" ") if w)
    vocabulary = set().union(*counts.values())
    out = []
    for t in test:
        scores = {}
        for l in labels:
            if not docs[l]:
                continue
            n = sum(counts[l].values()) + len(vocabulary)
            s = math.log(docs[l] / len(train))
            s += sum(math.log((counts[l][w] + 1) / n) for w in "".join(c for c in t.lower() if c.isascii() and c.isalpha() or c == " ").split(" ") if w in vocabulary and w)
            scores[l] = round(s, 9)
        top = max(scores.values())
        out.append((min(l for l in scores if scores[l] == top), 1 / sum(math.exp(s - top) for s in scores.values())))
    return out


def test_naive_bayes_against_plain_python(spark, corpus):
    train, test = corpus.filter("row_id < 40"), corpus.filter("row_id >= 40")
    labels = ("neg", "pos", "zero")
    model = classify.train(train.withColumn("m", F.lit("one")), ["m"])
    got = classify.predict(model, test, ["row_id"]).orderBy("row_id").collect()
    want = naive_bayes(
        [(r["text"], r["label"]) for r in train.collect()], [r["text"] for r in test.orderBy("row_id").collect()], labels
    )
    assert [r["predicted"] for r in got] == [w[0] for w in want]
    assert [r["confidence"] for r in got] == pytest.approx([w[1] for w in want])


def test_unknown_words_take_the_top_prior(spark):
    train = spark.createDataFrame([("m", 1, "a b", "x"), ("m", 2, "c", "x"), ("m", 3, "d", "y")], "m string, row_id bigint, text string, label string")
    test = spark.createDataFrame([(9, "zzz 1", "y"), (10, "", "x")], "row_id bigint, text string, label string")
    got = classify.predict(classify.train(train, ["m"]), test, ["row_id"]).collect()
    assert {(r["row_id"], r["predicted"], round(r["confidence"], 6)) for r in got} == {(9, "x", 0.666667), (10, "x", 0.666667)}


def test_scores(spark):
    rows = [("k", "a", "a", 0.9), ("k", "a", "b", 0.6), ("k", "b", "b", 0.8), ("k", "c", "b", 0.7)]
    df = spark.createDataFrame(rows, "k string, label string, predicted string, confidence double")
    r = classify.transfer_scores(df, ["k"]).first()
    assert r["accuracy"] == 0.5
    assert r["complexity_abs"] == pytest.approx(0.25)
    assert r["f1"] == pytest.approx((2 / 3 + 2 / 4 + 0) / 3)


def test_mauve_properties(spark):
    bins = [("same", s, i, i % 5) for i in range(100) for s in ("p", "q")]
    bins += [("apart", "p", i, 0) for i in range(10)] + [("apart", "q", i, 1) for i in range(10)]
    bins += [("ab", "p", i, i % 3) for i in range(30)] + [("ab", "q", i, i % 4) for i in range(30)]
    bins += [("ba", "q", i, i % 3) for i in range(30)] + [("ba", "p", i, i % 4) for i in range(30)]
    df = spark.createDataFrame(bins, "dataset_id string, side string, row_id bigint, bin bigint")
    got = {r[0]: r[1] for r in mauve.mauve(df).collect()}
    assert got["same"] == pytest.approx(1.0) and got["apart"] == pytest.approx(0.0041, abs=1e-3)
    assert got["ab"] == pytest.approx(got["ba"]) and 0 < got["ab"] < 1


def test_quantise_separates_clusters(spark):
    rng = np.random.default_rng(1)
    near, far = np.eye(8)[0], np.eye(8)[1]
    def make(centre, d, start):
        return [(d, start + i, [float(x) for x in centre + rng.normal(0, 0.01, 8)]) for i in range(40)]
    schema = "dataset_id string, row_id bigint, vector array<double>"
    real = spark.createDataFrame(make(near, "real", 0), schema)
    sets = spark.createDataFrame(make(near, "close", 0) + make(far, "away", 100), schema)
    got = {r[0]: r[1] for r in mauve.mauve(mauve.quantise(sets, real)).collect()}
    assert got["away"] < 0.05 < got["close"]


def test_quantise_does_not_depend_on_blocks_or_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(f"d{i % 3}", i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(150)]
    rows += [("d0", 900, None), ("d0", 901, [1.0, None, 0.0, 0.0]), ("d1", 902, [float("nan")] * 4), ("d2", 903, [0.0] * 4)]
    df = spark.createDataFrame(rows, "dataset_id string, row_id bigint, vector array<double>")
    real = df.filter("dataset_id = 'd2'").drop("dataset_id")

    def bins(sets, **kw):
        return {tuple(r) for r in mauve.quantise(sets, real, rounds=3, **kw).collect()}

    both = bins(df.filter("dataset_id <> 'd2'"))
    assert both == bins(df.filter("dataset_id <> 'd2'"), block=8, chunk=1)
    assert {r for r in both if r[0] == "d0"} == bins(df.filter("dataset_id = 'd0'"))
    assert sum(r[3] for r in both if r[0] == "d0" and r[1] == "p") == 50
    assert sum(r[3] for r in both if r[0] == "d0" and r[1] == "q") == 51
    assert bins(df.limit(0)) == set()


def greedy(points, epsilon):
    kept = []
    for i, v in points:
        if all(math.dist(v, w) > epsilon for _, w in kept):
            kept.append((i, v))
    return {i: {j for j, w in points if math.dist(v, w) <= epsilon} for i, v in kept}


@pytest.mark.parametrize("epsilon", [0.3, 1e-8])
def test_dedup_within_equals_greedy(spark, epsilon):
    rng = np.random.default_rng(5)
    base = [[float(x) for x in rng.uniform(-1, 1, 3)] for _ in range(60)]
    chain = [[0.25 * i, 5.0, 5.0] for i in range(8)]
    points = list(enumerate(base + chain + base[:10] + [[5.0, 5.0, x / 1000] for x in range(30)]))
    df = spark.createDataFrame([(f"s{i % 3}", i, v) for i, v in points], "dataset_id string, row_id bigint, vector array<double>")
    got = {}
    for r in vectors.dedup_within(df, epsilon).collect():
        got[r["kept_id"]] = got.get(r["kept_id"], 0) + r["members"]
    assert got == {i: len(m) for i, m in greedy(points, epsilon).items()}


def test_exact_copies(spark):
    df = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [1.0]), ("b", 3, [1.0]), ("a", 4, [2.0])], "dataset_id string, row_id bigint, vector array<double>")
    assert {tuple(r) for r in vectors.exact_copies(df).collect()} == {(1, "a", 1), (1, "b", 2), (4, "a", 1)}


def test_user_encoder(spark, corpus):
    out = vectors.embed_with(corpus.limit(3), lambda s: s.map(lambda t: [float(len(t)), 1.0]))
    assert all(r["vector"] == [float(len(r["text"])), 1.0] for r in out.collect())


def test_pair_words_are_tagged(spark):
    df = spark.createDataFrame([("Yes it", "No", "x"), ("a", None, "x")], "text string, other_text string, label string")
    assert [r[0] for r in df.select(classify.pair_words()).collect()] == [["a:yes", "a:it", "b:no"], ["a:a"]]
