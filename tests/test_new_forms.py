"""Rolling budgets as a stream, table functions, logistic regression, sketches, draws, grids side by side, stored settings."""

import json
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillgauge.functions import sql_functions
from quillgauge.operators import diversity, generate, logistic, sampling
from quillgauge.plans import settings, stages
from quillgauge.session import scratch_path
from quillgauge.streaming import jobs


def test_rolling_use():
    rng = np.random.default_rng(1)
    ts = np.sort(rng.integers(0, 300, 200))
    tokens = rng.integers(0, 50, 200)
    want = [int(tokens[(ts <= t) & (ts > t - 60)].sum()) for t in ts]
    assert jobs.rolling_use(ts, tokens, 60).tolist() == want
    assert jobs.rolling_use(ts[:0], tokens[:0], 60).tolist() == []


def test_stream_of_late_rows_equals_the_batch(spark):
    """Rows in any order within the lateness count as in the batch; a row later than that is dropped; state waits for its slice."""
    rng = np.random.default_rng(3)
    second = 1_000_000
    rows = [(i, f"m{i % 2}", int(t), int(rng.integers(1, 90))) for i, t in enumerate(rng.integers(0, 3600 * second, 900))]
    rows += [(1000 + i, "m0", 1799 * second + i, 7) for i in range(5)] + [(2000, "m0", 1800 * second, 7), (2001, "m1", 1859 * second + 999_999, 9)]
    at = lambda r: r[2] + int(rng.integers(0, 240)) * second
    arrived = sorted(rows, key=at)
    too_late = (5000, "m0", 10 * second, 1000)
    folder = scratch_path(spark, "in")
    schema = "event_id bigint, model string, us bigint, tokens bigint"

    def lot(part):
        df = spark.createDataFrame(part, schema).withColumn("ts", F.timestamp_micros("us")).drop("us")
        df.coalesce(1).write.mode("append").parquet(folder)

    for i in range(4):
        lot(arrived[i * len(arrived) // 4 : (i + 1) * len(arrived) // 4] + ([too_late] if i == 3 else []))
    out = scratch_path(spark, "out")

    def run():
        stream = spark.readStream.schema("event_id bigint, model string, ts timestamp, tokens bigint").option("maxFilesPerTrigger", 1).parquet(folder)
        return {tuple(r) for r in jobs.token_budget(stream, out, 2000, 100, "5 minutes", 120).select("event_id", "used", "admitted").collect()}

    batch = generate.token_budget(spark.createDataFrame(rows, "event_id bigint, model string, ts bigint, tokens bigint"), 2000, 100)
    want = {r["event_id"]: (r["event_id"], r["used"], r["admitted"]) for r in batch.collect()}
    top = max(r[2] for r in rows) // 1000 - 300_000
    closed = {want[r[0]] for r in rows if (r[2] // (120 * second) + 1) * 120_000 < top}
    assert run() == closed and 0 < len(closed) < len(rows)
    # A later row moves the watermark: the waiting state comes out, once.
    lot([(6000, "m1", 9000 * second, 1)])
    assert run() == set(want.values())


def test_table_function(spark):
    sql_functions.register(spark)
    rows = [(1, "1. one\n2. two\n3. three", "stop"), (2, "1. one\n2. cut", "length"), (3, None, "stop"), (4, "no list", "stop"), (5, "", None)]
    spark.createDataFrame(rows, "id int, t string, r string").createOrReplaceTempView("said")
    got = spark.sql("SELECT id, a.answer_idx, a.answer FROM said, LATERAL numbered_rows(t, r) a").collect()
    assert sorted(map(tuple, got)) == [(1, 0, "one"), (1, 1, "two"), (1, 2, "three"), (2, 0, "one")]


def plain_logistic(rows, labels, steps, rate, penalty, x):
    w = np.zeros((len(labels), x.shape[1]))
    y = np.array([[r[3] == label for label in labels] for r in rows], float)
    for _ in range(steps):
        p = np.exp(x @ w.T)
        p /= p.sum(1, keepdims=True)
        w -= rate * ((p - y).T @ x / len(rows) + penalty * w)
    return w


def test_logistic_models_do_not_meet(spark):
    """Models of different labels, one of a single label, rows without words or label; blocks change nothing."""
    rng = np.random.default_rng(7)
    pools = {"a": ["red", "green", "blue"], "b": ["one", "two", "three"], "c": ["sun", "moon", "blue"]}
    rows = [(m, i, " ".join(rng.choice(pools[lab], 6)), lab) for m, labs in (("m", "ab"), ("n", "abc"), ("o", "c")) for i, lab in enumerate(labs * 20)]
    rows += [("m", 900, "", "a"), ("m", 901, None, "b"), ("n", 902, "red red", None)]
    df = spark.createDataFrame(rows, "model string, row_id bigint, text string, label string")
    weights = logistic.train(df, ["model"], steps=5, dim=64)
    small = logistic.train(df, ["model"], steps=5, dim=64, block=7)
    got, other = ({(r["model"], r["label"]): np.array(r["w"]) for r in w.collect()} for w in (weights, small))
    assert set(got) == {("m", "a"), ("m", "b"), ("n", "a"), ("n", "b"), ("n", "c"), ("o", "c")}
    assert all(np.abs(got[k] - other[k]).max() < 1e-12 for k in got)
    blocks = logistic.Blocks(df, ["model"], 64, 8192)
    lists = {(r["model"], r["row_id"]): r["buckets"] for r in blocks.rows.collect()}
    blocks.close()
    own = [r for r in rows if r[0] == "n" and r[3] is not None]
    x = logistic._features([lists[("n", r[1])] for r in own], 64)
    want = plain_logistic(own, "abc", 5, 4.0, 0.001, x)
    assert all(np.abs(got[("n", label)] - w).max() < 1e-9 for label, w in zip("abc", want, strict=True))
    guesses = logistic.predict(weights, df, ["model"]).collect()
    assert len(guesses) == len(rows)
    told = [r["label"] == r["predicted"] for r in guesses if r["label"] is not None and r["row_id"] < 900]
    assert np.mean(told) > 0.95 and all(0 < r["confidence"] <= 1 for r in guesses)


def test_sketches_merge(spark):
    words = [(f"d{d}", " ".join("w" + "abcdefghij"[i % 10] * (1 + i % 7) + "klmnop"[i // 7 % 6] * (i // 70 % 40) for i in range(lot, 9000, 3))) for d in (0, 1) for lot in (0, 1, 2)]
    df = spark.createDataFrame([(d, i, t, "x") for i, (d, t) in enumerate(words)], "dataset_id string, row_id bigint, text string, label string")
    lots = [diversity.token_sketches(df.filter(F.col("row_id") % 3 == k)) for k in range(3)]
    merged = {r[0]: (r[1], r[2]) for r in diversity.sketched_distinctness(diversity.merge_sketches(*lots)).collect()}
    whole = {r[0]: (r[1], r[2]) for r in diversity.sketched_distinctness(diversity.token_sketches(df)).collect()}
    exact = {r[0]: r[1] for r in diversity.distinctness(diversity.token_counts(df, ["dataset_id"]), ["dataset_id"]).collect()}
    assert all(merged[d] == (9000, pytest.approx(exact[d], rel=0.02)) and whole[d] == (9000, pytest.approx(merged[d][1], rel=0.01)) for d in exact)


@pytest.mark.parametrize("m", [1, 5, 40])
def test_draws_are_whole(spark, m):
    sizes = spark.createDataFrame([("a", 5), ("b", 41), ("c", 10**12), ("d", 2 * m + 1), ("e", 2 * m), ("f", m)], "k string, n bigint")
    got = Counter()
    for r in sampling.draw_indices(sizes, ["k"], "n", m, 20, "s").groupBy("k", "n", "repetition").agg(F.collect_set("index").alias("i"), F.collect_set("draw").alias("d")).collect():
        assert len(r["i"]) == m and sorted(r["d"]) == list(range(1, m + 1)) and min(r["i"]) >= 0 and max(r["i"]) < r["n"]
        got[r["k"]] += 1
    assert got == {k: 20 for k, n in (("a", 5), ("b", 41), ("c", 10**12), ("d", 2 * m + 1), ("e", 2 * m), ("f", m)) if n >= m}


def test_grid_runs_side_by_side(spark):
    """Branches overlap in time, a shared prefix runs once, and a failing branch leaves the others and their outputs."""
    times, lock = {}, threading.Lock()

    def slow(name):
        def run(df):
            begin = time.time()
            time.sleep(1.5)
            with lock:
                times.setdefault(name, []).append((begin, time.time()))
            return df.withColumn(name, F.lit(1))

        return (name, run)

    def bad(df):
        raise ValueError("no such thing")

    folder, df = scratch_path(spark, "grid"), spark.range(5)
    chains = {"x": [slow("p"), slow("a")], "y": [slow("p"), slow("b")], "z": [slow("p"), ("bad", bad), slow("c")], "w": [slow("q")]}
    with pytest.raises(stages.GridError) as told:
        stages.run_grid(df, chains, folder)
    assert set(told.value.failed) == {"z"} and isinstance(told.value.failed["z"], ValueError)
    assert {k: len(v) for k, v in times.items()} == {"p": 1, "q": 1, "a": 1, "b": 1}
    overlap = lambda a, b: times[a][0][0] < times[b][0][1] and times[b][0][0] < times[a][0][1]
    assert overlap("p", "q") and overlap("a", "b") and times["p"][0][1] <= times["a"][0][0]
    manifest = spark.read.parquet(f"{folder}/manifest").collect()
    assert {json.loads(r["entry"])["settings"] for r in manifest} == {"x", "y", "w"}
    chains["z"] = [slow("p"), slow("c")]
    _, ran = stages.run_grid(df, chains, folder)
    assert ran == {"x": [], "y": [], "z": [1], "w": []}


def test_settings(spark):
    text = """{"class": "Chain", "stages": [{"seed": "é|1", "class": "Sample", "probability": 0.5}, {"class": "Chain", "stages": []}, {"class": "FirstRows", "n": 2}]}"""
    chain = settings.read_chain(text)
    rows = spark.createDataFrame([(json.dumps(s),) for s in json.loads(text)["stages"] if s["class"] != "Chain"], "s string")
    assert [r[0] for r in rows.select(stages.stage_key("s")).collect()] == [k for k, _ in chain]
    df = spark.createDataFrame([("d", i, f"text {i}", "x") for i in range(50)], "dataset_id string, row_id bigint, text string, label string")
    want = stages.run_chain(df, [lambda d: sampling.bernoulli(d, 0.5, "é|1"), lambda d: sampling.first_n(d, 2)]).collect()
    assert sorted(stages.run_chain(df, [s for _, s in chain]).collect()) == sorted(want) and len(want) == 2
    for wrong in ('{"class": "Nope"}', '{"class": "FirstRows"}', '{"class": "FirstRows", "n": 1, "m": 2}', '{"n": 1}', "[]", '{"class": "Chain", "stages": 3}'):
        with pytest.raises(ValueError):
            settings.read_chain(wrong)
