import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgauge.functions.keys import id_bucket, key_below, order_key
from quillgauge.operators import ordering, rows, sampling


def frame(spark, ids, groups=3):
    return spark.createDataFrame([(f"d{i % groups}", i, f"l{i % 2}") for i in ids], "dataset_id string, row_id bigint, label string")


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.sets(st.integers(-500, 100_000), min_size=1, max_size=60), st.sampled_from([1, 7, 1 << 16]))
def test_bucketed_numbers_equal_plain_window(spark, ids, width):
    df = frame(spark, sorted(ids))
    w = Window.partitionBy("dataset_id").orderBy("row_id")
    want = set(df.select("row_id", F.row_number().over(w)).collect())
    got = ordering.number_by_id(df, ["dataset_id"], width=width)
    assert set(got.select("row_id", "position").collect()) == want


def test_numbers_over_all_rows_and_prefix(spark):
    df = frame(spark, range(0, 500, 3))
    got = ordering.number_by_id(df, [], width=10, at_most=25).orderBy("position").collect()
    assert [r["row_id"] for r in got] == list(range(0, 75, 3))
    assert [r["position"] for r in got] == list(range(1, 26))


def test_start_limit_prunes_buckets_before_the_shuffle(spark):
    df = frame(spark, range(1000), 1)
    kept = ordering.running_totals(df, ["dataset_id"], ["row_id"], id_bucket("row_id", 10), {"n": F.lit(1)}, start_below=("n", 20))
    assert kept.count() == 20


def test_running_totals_match_window(spark):
    df = frame(spark, range(300)).withColumn("v", F.col("row_id") % 7)
    got = ordering.running_totals(df, ["dataset_id"], ["row_id"], id_bucket("row_id", 16), {"s": F.col("v")}, totals={"t": "s"})
    w = Window.partitionBy("dataset_id").orderBy("row_id")
    want = df.select("row_id", F.sum("v").over(w).alias("s"), F.sum("v").over(Window.partitionBy("dataset_id")).alias("t"))
    assert set(got.select("row_id", "s", "t").collect()) == set(want.collect())


def test_hash_order_is_a_permutation(spark):
    df = frame(spark, range(200))
    one = {r["row_id"]: r["position"] for r in sampling.shuffle(df).collect()}
    two = {r["row_id"]: r["position"] for r in sampling.shuffle(df.repartition(3)).collect()}
    assert one == two
    assert one != {r["row_id"]: r["position"] for r in sampling.shuffle(df, seed="7").collect()}


def test_folds_partition_rows(spark):
    df = frame(spark, range(307))
    folds = sampling.stratified_folds(df, 5)
    assert folds.count() == 307
    sizes = folds.groupBy("dataset_id", "label", "fold").count().groupBy("dataset_id", "label").agg(F.max("count") - F.min("count"))
    assert all(r[2] <= 1 for r in sizes.collect())
    parts = sampling.fold_parts(folds, 5)
    by = {(r[0], r[1], r[2]): r[3] for r in parts.groupBy("dataset_id", "run", "side").count().collect()}
    for d in ("d0", "d1", "d2"):
        for run in range(5):
            assert by[d, run, "train"] == by[d, run, "valid"]
    both = parts.groupBy("dataset_id", "run", "row_id").count().filter("count > 1")
    assert both.count() == 0


def test_validation_rows_come_in_order_from_the_rest(spark):
    folds = sampling.stratified_folds(frame(spark, range(60), 1), 3)
    rows_ = {r["row_id"]: r["fold"] for r in folds.collect()}
    parts = sampling.fold_parts(folds, 3)
    for run in range(3):
        size = sum(f == run for f in rows_.values())
        want = [i for i in sorted(rows_) if rows_[i] != run][:size]
        got = sorted(r["row_id"] for r in parts.filter((F.col("run") == run) & (F.col("side") == "valid")).collect())
        assert got == want
    turned = sampling.fold_parts(folds, 3, swap=False)
    assert turned.filter("side = 'valid'").count() == 60 and turned.filter("side = 'train'").count() == 120


def test_holdout_and_halves(spark):
    df = frame(spark, range(101), 1)
    sides = dict(sampling.holdout(df).groupBy("side").count().collect())
    assert sides == {"test": 31, "train": 70}
    half = dict(sampling.halves(df).groupBy("half").count().collect())
    assert half == {1: 50, 2: 51}


def test_draws_are_distinct_and_complete(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 10), ("c", 1_000_000_000_000), ("d", 2)], "g string, n bigint")
    got = sampling.draw_indices(sizes, ["g"], "n", 5, 8, "s").collect()
    by = {}
    for r in got:
        by.setdefault((r["g"], r["repetition"]), []).append(r["index"])
    assert len(by) == 24 and all(len(v) == len(set(v)) == 5 for v in by.values())
    assert all(0 <= i < {"a": 5, "b": 10, "c": 10**12}[g] for (g, _), v in by.items() for i in v)
    assert len({tuple(v) for (g, _), v in by.items() if g == "c"}) == 8


def test_bernoulli_shares(spark):
    df = spark.range(20_000).withColumnRenamed("id", "row_id")
    assert abs(sampling.bernoulli(df, 0.3).count() / 20_000 - 0.3) < 0.02
    assert sampling.bernoulli(df, 1.0).count() == 20_000 and sampling.bernoulli(df, 0.0).count() == 0
    assert df.select(key_below(order_key("row_id", seed="x"), 0.5)).distinct().count() == 2


def test_row_edits(spark):
    df = spark.createDataFrame(
        [("d", 1, "one", "x"), ("d", 2, "two", "x"), ("d", 3, "one", "y"), ("d", 4, "", "y"), ("d", 5, "f", None)],
        "dataset_id string, row_id bigint, text string, label string",
    )
    clean = rows.load_normalise(df)
    assert [r["row_id"] for r in clean.orderBy("row_id").collect()] == [1, 2, 3]
    edits = spark.createDataFrame([("d", 2, "TWO")], "dataset_id string, row_id bigint, text string")
    assert {r["text"] for r in rows.apply_edits(clean, edits).collect()} == {"one", "TWO"}
    gone = spark.createDataFrame([("d", 2)], "dataset_id string, row_id bigint")
    assert [(r["row_id"], r["position"]) for r in rows.delete_rows(clean, gone).orderBy("row_id").collect()] == [(1, 1), (3, 2)]
    assert rows.delete_texts(clean, spark.createDataFrame([("one",)], "text string")).count() == 1
    assert [r["other_text"] for r in rows.pairs(clean).collect()] == [None] * 3
    assert rows.row_at(clean, 2).first()["text"] == "two"
    both = rows.append_rows(clean, clean.withColumn("other_text", F.lit("o")))
    assert both.filter("other_text is null").count() == 3


def test_first_wins(spark):
    df = spark.createDataFrame([("b", 3), ("a", 5), ("b", 9), ("c", 1)], "k string, position bigint")
    got = {r["k"]: (r["first_position"], r["first_id"]) for r in rows.first_wins(df, ["k"]).collect()}
    assert got == {"c": (1, 0), "b": (3, 1), "a": (5, 2)}


def test_numbers_of_ids_of_any_kind(spark):
    rng = random.Random(7)
    ids = {rng.randrange(-(1 << 63), 1 << 63) for _ in range(300)} | set(range(-40, 40)) | {65535, 65536, 1 << 32, (1 << 63) - 1, -(1 << 63)}
    rows = [(f"g{i % 3}", i) for i in ids]
    df = spark.createDataFrame(rows, "g string, row_id bigint")
    want = {}
    for g in ("g0", "g1", "g2"):
        mine = sorted(i for h, i in rows if h == g)
        want |= {(g, i): (k, len(mine)) for k, i in enumerate(mine, 1)}
    for dense in (False, True):
        out = ordering.number_by_id(df, ["g"], dense=dense, total="size").collect()
        assert {(r["g"], r["row_id"]): (r["position"], r["size"]) for r in out} == want
    first = ordering.number_by_id(df, [], dense=False, at_most=7).collect()
    assert {r["row_id"]: r["position"] for r in first} == {i: k for k, i in enumerate(sorted(ids)[:7], 1)}
