"""What a larger table brings: folders of files, many chunks, many vectors close by chance."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quillgauge.catalog import base, stores, streams
from quillgauge.operators import classify, mauve, vectors
from quillgauge.plans import evaluate
from quillgauge.streaming import jobs


def test_stream_reads_a_table_that_is_a_folder(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"src{i % 3}", "en" if i % 2 else None) for i in range(20)], "doc_id bigint, source string, lang string")
    rows.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    got = jobs.run_available(streams._stream(spark, str(tmp_path), "documents"), str(tmp_path / "job"), "append")
    assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))
    single = jobs.run_available(streams._stream(spark, "/root/testdata/sf0.001", "documents"), str(tmp_path / "file"), "append")
    assert single.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


def test_rows_in_many_chunks_meet_models_in_many_groups(spark):
    train = spark.createDataFrame(
        [(m, f"w{i % 5} w{i % 3} w{m}", f"l{i % 2}") for m in range(3) for i in range(12)], "m bigint, text string, label string"
    )
    model = classify.train(train, ["m"])
    test = spark.createDataFrame([(i, f"w{i % 5} w{i % 4} new", "l0") for i in range(30)] + [(5, None, "l0")], "row_id bigint, text string, label string")

    def result(**sizes):
        return sorted(map(tuple, classify.predict(model, test, ["row_id"], **sizes).withColumn("confidence", F.round("confidence", 9)).collect()))

    assert len(result()) == 90
    assert result(chunk=4, types=1) == result()


def test_vectors_apart_share_few_cells(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 16))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    rows = [("a", i, v.tolist()) for i, v in enumerate(x)] + [("b", 5000 + i, (v + 2e-4 * (i % 2)).tolist()) for i, v in enumerate(x[:50])]
    df = spark.createDataFrame([*rows, ("a", 9000, None), ("a", 9001, [float("nan")] * 16), (None, 9002, [None] * 16)], "dataset_id string, row_id bigint, vector array<double>")
    placed = vectors.cells_around(df.filter("row_id < 2000"), 1e-3)
    met = placed.select(F.explode("around").alias("cell"), F.col("row_id").alias("other")).join(placed, "cell")
    assert placed.agg(F.avg(F.size("around"))).first()[0] < 4
    assert 2000 <= met.count() < 2500
    got = {(r["kept_id"], r["dataset_id"]): r["members"] for r in vectors.dedup_within(df, 1e-3).collect()}
    assert got == {(i, "a"): 1 for i in range(2000)} | {(i, "b"): 1 for i in range(50)}


def test_nearest_centre_is_exact_where_single_precision_is_not():
    rng = np.random.default_rng(2)
    x = np.floor(rng.normal(size=(500, 64)) * 1e5)
    c = np.concatenate([x[:20], x[:20] + (np.arange(64) == 3), np.floor(rng.normal(size=(40, 64)) * 1e5)])
    x = np.concatenate([x, c + (np.arange(64) == 3) * rng.integers(0, 2, 80)[:, None]])
    near = mauve._nearest(x, x.astype(np.float32), np.sqrt((x**2).sum(1)), c)
    assert (near == ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)).all()


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")).split("Initial Plan")[0]


def test_vectors_of_few_groups_stay_where_they_are(spark):
    """Rows of two groups meet their weights without being gathered in two tasks."""
    df = spark.createDataFrame([(f"g{i % 2}", i, f"w{chr(97 + i % 7)} the") for i in range(60)], "g string, row_id bigint, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        plan = final_plan(vectors.hash_vectors(df, by=["g"]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_fixed_point_works_a_vector_out_once(spark):
    """What makes the vector is not repeated for its length, the filter and its components."""
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "row_id bigint, vector array<double>")
    made = df.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.25)))
    out = mauve.fixed_point(made)
    assert final_plan(out).count("0.25") == 1
    for r in out.collect():
        x, y = r["row_id"] + 0.25, 1.25
        assert r["vector"] == [float(np.floor(v / np.sqrt(x * x + y * y) * 1e6 + 0.5)) for v in (x, y)]


def test_vectors_without_use_go_and_empty_ones_stay(spark):
    rows = [(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1e200, 1.0]), (8, [])]
    out = mauve.fixed_point(spark.createDataFrame(rows, "row_id bigint, vector array<double>"))
    assert {r["row_id"]: r["vector"] for r in out.collect()} == {1: [6e5, 8e5], 2: [0.0, 0.0], 8: []}


def test_folds_are_trained_once_for_both_tests(spark, monkeypatch):
    calls = []
    train = classify.train
    monkeypatch.setattr(classify, "train", lambda *a, **kw: calls.append(a) or train(*a, **kw))
    rows = [(f"d{i % 2}", i, f"w{chr(97 + i % 5)} w{chr(97 + i % 3)}", f"l{i % 2}") for i in range(40)]
    schema = "dataset_id string, row_id bigint, text string, label string"
    folds = evaluate.make_folds(spark.createDataFrame(rows, schema), spark.createDataFrame([("real", 100 + i, t, lab) for _, i, t, lab in rows], schema), 2)
    got = {(r["dataset_id"], r["run"], r["metric"]): r["value"] for r in evaluate._transfer(folds).collect()}
    assert len(calls) == 1
    alone = [(evaluate.fake_to_real(folds), "real"), (evaluate.fake_to_fake(folds), "fake")]
    want = {(r["dataset_id"], r["run"], f"finetune_temporal_fake_to_{name}.{m}"): r[m] for df, name in alone for r in df.collect() for m in ("accuracy", "f1", "complexity_abs")}
    assert got == want


def test_csv_files_stay_small(spark, tmp_path, monkeypatch):
    """A file is one value while it is cut up, so no file may grow with the splits of the table."""
    rows = spark.createDataFrame([(i, "src0", "the e, \"e\" \\", "en") for i in range(40)], "doc_id bigint, source string, text string, lang string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(stores, "CSV_ROWS", 4, raising=False)
    folders, scratch = [], stores.scratch_path
    monkeypatch.setattr(stores, "scratch_path", lambda *a: folders.append(scratch(*a)) or folders[-1])
    spread = base.spread
    monkeypatch.setattr(base, "spread", lambda df, *c: df)
    got = stores.src_csv_roundtrip(spark, str(tmp_path)).collect()
    monkeypatch.setattr(base, "spread", spread)
    want = {i: 'th\\e" \\e", "\\e"" \\\\' if i % 2 == 0 else 'th"e,  "e, , ""e, " \\' for i in range(40)}
    assert {r["row_id"]: r["text"] for r in got} == want
    for folder in folders:
        assert max(spark.read.text(folder).groupBy(F.input_file_name()).count().toPandas()["count"]) <= 5


def test_scores_do_not_depend_on_how_common_words_are(monkeypatch):
    """Words added up by a product and those added up one by one give the scores that plain sums give."""
    rng = np.random.default_rng(3)
    vocabulary, labels = [f"w{i}" for i in range(30)], ["a", "b", "c"]
    seen = {(m, w): {lab: float(rng.random()) for lab in labels[: m + 1] if rng.random() < 0.6} for m in range(3) for w in vocabulary if rng.random() < 0.7}
    texts = ["\0".join(rng.choice([*vocabulary, "new"], rng.integers(1, 40), p=[0.03] * 30 + [0.1])) for _ in range(25)]
    lists, struct = pa.list_, pa.struct([("label", pa.string()), ("w", pa.float64()), ("z", pa.float64())])
    weights = [(classify.PRIOR_TOKEN, m, m, labels[: m + 1], [-0.5] * (m + 1), [1.0] * (m + 1)) for m in range(3)]
    weights += [(w, m, None, list(of), list(of.values()), None) for (m, w), of in seen.items()]
    kinds = [pa.string(), pa.int32(), pa.int64(), lists(pa.string()), lists(pa.float64()), lists(pa.float64())]
    names = ["token", "__model", "run", "__labels", "__w", "__z"]
    table = pa.table([pa.array([r[i] for r in weights], k) for i, k in enumerate(kinds)], names)
    rows = pa.table([pa.array(range(25), pa.int64()), pa.array(["a"] * 25), pa.array(texts)], ["row_id", "__truth", "__words"])
    schema = pa.schema([("run", pa.int64()), ("row_id", pa.int64()), ("__truth", pa.string()), ("known", pa.float64()), ("labels", lists(struct))])
    for common in (0, 1, 7, 4096):
        monkeypatch.setattr(classify, "_COMMON", common)
        monkeypatch.setattr(classify, "_AT_ONCE", 4)
        got = {(r["run"], r["row_id"]): r for r in classify._unit_scores(["row_id"], ["run", "row_id"], schema)(rows, table).to_pylist()}
        assert len(got) == 75
        for (m, i), r in got.items():
            words = texts[i].split("\0")
            assert r["known"] == sum((m, w) in seen for w in words)
            assert [x["label"] for x in r["labels"]] == labels[: m + 1]
            for x in r["labels"]:
                assert abs(x["w"] - (-0.5 + sum(seen.get((m, w), {}).get(x["label"], 0) for w in words))) < 1e-9
