"""Steps whose time, shuffles or files grew too fast with the tables."""

import re
import time

import numpy as np
from pyspark.sql import functions as F

from quillgauge.catalog import QUERIES
from quillgauge.functions import text
from quillgauge.operators import rows
from quillgauge.sources import datasets as sources

SPACES = "".join(map(chr, [*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def odd_texts(n=400):
    rng = np.random.default_rng(5)
    signs = [*"abcxyzABZ--  ..09_[`{@", *SPACES, *map(chr, [0, 0xDF, 0xE9, 0x130, 0x180E, 0x200B, 0x212A, 0xFEFF, 0x1F600])]
    drawn = ["".join(rng.choice(signs, rng.integers(0, 25))) for _ in range(n)]
    return [None, "", " ", "  ", "\n", "a", "a-b-c", " a ", " ", "a\n", "a \n\n", *SPACES, *drawn]


def quickest(df, column, times=3):
    took = []
    for _ in range(times):
        began = time.perf_counter()
        df.agg(F.sum(F.hash(column))).collect()
        took.append(time.perf_counter() - began)
    return min(took)


def prose(spark):
    return spark.range(0, 4, 1, 4).select(F.repeat(F.concat(F.lit("Some words, and 12 more - of a text; "), "id"), 20_000).alias("text")).cache()


def test_tokens_of_odd_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd_texts())], "id int, text string")
    got = df.select("text", text.token_array("text"), text.token_number("text")).collect()
    for t, tokens, number in got:
        want = None if t is None else re.sub("[^a-zA-Z ]", "", t).split(" ")
        assert (tokens, number) == (want, None if want is None else len(want))


def test_tokens_take_less_time_than_by_two_ranges(spark):
    df = prose(spark)
    ranges = F.split(F.regexp_replace("text", "[^a-zA-Z ]", ""), " ", -1)
    slow = quickest(df, ranges)
    assert quickest(df, text.token_array("text")) < slow / 1.7
    assert quickest(df, text.token_number("text")) < slow / 1.7


def test_clean_text_of_odd_texts(spark):
    def want(t):
        t = re.sub("([a-z])-([a-z])", r"\1 \2", t)
        t = re.sub(f"[^a-z{SPACES}]", "", t)
        return re.sub("[^a-z]{2,}", " ", t).strip(SPACES)

    df = spark.createDataFrame([(t,) for t in odd_texts()], "text string")
    got = df.select(F.lower("text"), text.clean_text("text")).collect()
    assert [c for _, c in got] == [None if t is None else want(t) for t, _ in got]


def test_clean_text_takes_less_time_than_by_all_ranges(spark):
    df, ws = prose(spark), text.WHITESPACE
    ranges = F.regexp_replace(F.regexp_replace(F.lower("text"), r"([a-z])-([a-z])", "$1 $2"), f"[^a-z{ws}]", "")
    ranges = F.regexp_replace(F.regexp_replace(ranges, f"[{ws}]{{2,}}", " "), f"^[{ws}]+|[{ws}]+$", "")
    slow = quickest(df, ranges)
    assert quickest(df, text.clean_text("text")) < slow / 1.7


def test_remove_empty_tests_a_text_once(spark):
    df = spark.createDataFrame([("",), ("a",), ("ab",), (None,)], "raw string").select(F.upper("raw").alias("text"))
    assert [r[0] for r in rows.remove_empty(df).collect()] == ["AB"]
    assert sorted(r[0] for r in rows.remove_empty(df, 0).collect()) == ["A", "AB"]
    plan = rows.remove_empty(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.partition("Filter")[2].split("\n")[0].count("upper(") == 1


def test_features_are_cut_behind_join_and_sort(spark, sf, monkeypatch):
    """What is shuffled and sorted has no tokens."""
    kept = []
    write = sources.write_features
    monkeypatch.setattr(sources, "write_features", lambda df, path: (kept.append(df), write(df, path)))
    QUERIES["features_vectors"](spark, sf)
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("split(") < plan.index("Sort [") < plan.index("Join ")
    assert plan.count("split(") == 1


def test_csv_in_many_files_keeps_the_order(spark, tmp_path):
    said = [(f"d{i % 2}", i, f"text {i}\nof it", "x") for i in range(40)]
    df = spark.createDataFrame(said, "dataset_id string, row_id int, text string, label string")
    ordered = df.repartitionByRange(3, "dataset_id", "row_id").sortWithinPartitions("dataset_id", "row_id")
    sources.write_csv(ordered.select("dataset_id", "text", "label"), f"{tmp_path}/out", ["dataset_id"], rows_per_file=4)
    assert all(len(list((tmp_path / f"out/dataset_id={d}").glob("*.csv"))) >= 5 for d in ("d0", "d1"))
    got = sources.load_many(spark, [f"{tmp_path}/out/dataset_id={d}" for d in ("d0", "d1")]).collect()
    want = {(f"{tmp_path}/out/dataset_id={d}", i // 2, t) for d, i, t, _ in said}
    assert {(r["dataset_id"], r["row_id"], r["text"]) for r in got} == want and len(got) == len(said)


def test_load_many_parses_once_and_takes_names_with_a_scheme(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("one", "x"), ("two", "y")], "text string, label string")
    sources.write_csv(df.coalesce(1), f"{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("*.csv")
    kept = []
    stored = sources.stored
    monkeypatch.setattr(sources, "stored", lambda df, name: kept.append(df) or stored(df, name))
    for name in (f"{tmp_path}/a", f"file://{tmp_path}/a", f"file:{tmp_path}/a/", str(file), f"file://{file}"):
        got = sources.load_many(spark, [name]).collect()
        assert sorted((r["dataset_id"], r["row_id"], r["text"]) for r in got) == [(name.rstrip("/"), 0, "one"), (name.rstrip("/"), 1, "two")]
        plan = kept[-1]._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == 1


def test_manifest_load_writes_many_files_of_a_dataset(spark, sf, monkeypatch):
    """No dataset is sorted and written by one task."""
    kept = []
    write = sources.write_csv
    monkeypatch.setattr(sources, "write_csv", lambda df, *a, **kw: (kept.append((df, kw)), write(df, *a, **kw)))
    QUERIES["manifest_load"](spark, sf)
    (df, options), = kept
    assert "RepartitionByExpression [dataset_id" in (plan := df._jdf.queryExecution().optimizedPlan().toString())
    assert re.search(r"RepartitionByExpression \[dataset_id#\d+ ASC NULLS FIRST, row_id#\d+L? ASC", plan)
    assert options["rows_per_file"] > 0
