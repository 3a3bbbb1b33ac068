import json

import pytest
from pyspark.sql import functions as F

from quillgauge.functions import extract, sql_functions
from quillgauge.functions.keys import key_number, order_key
from quillgauge.operators import generate, metrics, report, rewrite
from quillgauge.plans import evaluate, stages
from quillgauge.session import scratch_path
from quillgauge.sources import datasets as sources
from quillgauge.sources import stores
from quillgauge.streaming import jobs


def test_csv_round_trip_and_foreign_files(spark, tmp_path):
    texts = ['a "quote", b', "back\\slash", "line\nbreak\r\nmore", "tail\\", "", " padded ", None, '\\"']
    df = spark.createDataFrame([(i, t, "l") for i, t in enumerate(texts)], "row_id int, text string, label string")
    path = str(tmp_path / "own")
    sources.write_csv(df, path)
    back = sources.read_csv(spark, path, "row_id int, text string, label string").orderBy("row_id").collect()
    assert [r["text"] for r in back] == [t or None for t in texts]
    plain = tmp_path / "plain.csv"
    plain.write_text('text,label\n"a ""b"" c\\d",x\n"ends \\",y\n')
    escaped = tmp_path / "escaped.csv"
    escaped.write_text('text,label\n"a\\\\b, ""q""",x\nplain,y\n,z\nlost,\n')
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('text,label\n"he said \\"hi\\", ok",x\n"a \\"b\\"\nc",y\n')
    back = sources.read_csv(spark, str(quoted), "text string, label string").collect()
    assert [tuple(r) for r in back] == [('he said "hi", ok', "x"), ('a "b"\nc', "y")]
    got = sources.read_csv(spark, [str(plain), str(escaped)], "text string, label string").collect()
    assert {r["text"] for r in got} == {'a "b" c\\d', "ends \\", 'a\\b, "q"', "plain", None, "lost"}
    assert {r["text"] for r in sources.load(spark, str(escaped)).collect()} == {'a\\b, "q"', "plain"}


def test_csv_marks_line_ends_and_malformed_files(spark, tmp_path):
    odd = ["﷐", "﷐r﷐f", 'x﷐"', "\\\\\\", 'q""', '"', ",", "\n", "\r", "a\\,b", "é\\é"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(odd)], "row_id int, text string, label string")
    path = str(tmp_path / "odd")
    sources.write_csv(df, path)
    back = sources.read_csv(spark, path, "row_id int, text string, label string").orderBy("row_id").collect()
    assert [r["text"] for r in back] == odd and {r["label"] for r in back} == {None}
    mixed = tmp_path / "mixed.csv"
    mixed.write_bytes('text;label\r\n"a ""b"" and \\"c\\"";x\r\n\r\nd\\;e\\\\;y\r\n"";\r\nshort'.encode())
    got = sources.read_csv(spark, str(mixed), "text string, label string", sep=";", origin=True).orderBy("at").collect()
    assert [(r["text"], r["label"], r["at"]) for r in got] == [('a "b" and "c"', "x", 0), ("d;e\\", "y", 1), (None, None, 2), ("short", None, 3)]
    for name, content in (("empty", ""), ("header", "text,label\n")):
        (tmp_path / name).write_text(content)
        assert sources.read_csv(spark, str(tmp_path / name), "text string, label string").collect() == []
    for name, content in (("open", 'text,label\n"a,b\n'), ("wide", "text,label\na,b,c\n")):
        (tmp_path / name).write_text(content)
        with pytest.raises(Exception, match="malformed CSV"):
            sources.read_csv(spark, str(tmp_path / name), "text string, label string").collect()
    spaced = tmp_path / "a b%20c=d+e"
    spaced.mkdir()
    for part in "12":
        (spaced / f"{part}.csv").write_text(f"text,label\nrow {part},x\nmore {part},x\n")
    loaded = sources.load_many(spark, [str(spaced)]).orderBy("row_id").collect()
    assert [(r["dataset_id"], r["row_id"], r["text"]) for r in loaded] == [(str(spaced), i, t) for i, t in enumerate(["row 1", "more 1", "row 2", "more 2"])]
    plan = sources.read_csv(spark, path, "row_id int, text string")._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "binaryFile" not in plan


def test_leaderboard_with_all_metrics(spark):
    runs = spark.createDataFrame(
        [("a", 1, ["x", "y"]), ("b", 2, ["y", "z", "y"]), ("c", 3, [])], "dataset_id string, position bigint, chain array<string>"
    )
    ids = {r["dataset_id"]: r["ids"] for r in report.chain_ids(runs, ["dataset_id"]).collect()}
    assert ids == {"a": [0, 1], "b": [1, 2, 1], "c": []}
    rows = [("a", 0.5), ("b", 0.5), ("c", None), ("d", float("nan")), ("e", 0.75), ("f", -3.0)]
    boards = spark.createDataFrame(rows, "dataset_id string, y double")
    own = spark.createDataFrame([("real", 0.9)], "dataset_id string, y double")
    store = spark.createDataFrame([("a", "m", 1.0), ("a", "n", 2.0), ("real", "k", 3.0), ("b", "m", 4.0)], "dataset_id string, metric string, value double")
    got = {r["dataset_id"]: (r["rank"], r["metrics"]) for r in report.leaderboard(boards, own, store).collect()}
    assert [d for d, _ in sorted(got.items(), key=lambda x: x[1][0])] == ["real", "e", "a", "b", "f", "c", "d"]
    assert got["a"][1] == {"k": 0.0, "m": 1.0, "n": 2.0} and got["real"][1] == {"k": 3.0, "m": 0.0, "n": 0.0}
    assert got["e"][1] == {"k": 0.0, "m": 0.0, "n": 0.0}
    empty = report.leaderboard(boards.limit(0), own, store.limit(0)).collect()
    assert [(r["dataset_id"], r["rank"]) for r in empty] == [("real", 0)]


def test_evaluation_folder_of_named_files(spark, tmp_path):
    task = tmp_path / "all runs" / "sst"
    (task / "pipelines").mkdir(parents=True)
    (task / "results").mkdir()
    for i, model in enumerate(["ada", "curie"]):
        generator = {"class": "Generator", "prompts": {"prompts": {"pos": ["Write."]}}, "querier": {"model": model, "temperature": 0.7, "top_p": 1}}
        (task / "pipelines" / f"pipeline_{i}.json").write_text(json.dumps({"class": "Pipeline", "generator": generator}, indent=2))
    (task / "results" / "list_dict_metrics_0-1.json").write_text(json.dumps([{"mauve": 0.5, "name": "x"}, {"mauve": 0.25}], indent=2))
    (task / "results" / "dict_real_metrics.json").write_text(json.dumps({"mauve": 1.0}))
    settings, store, real = stores.read_evaluations(spark, str(tmp_path / "all runs"))
    got = report.experiment_table(store, report.run_flags(stores.parse_settings(settings)), real).collect()
    assert {(r["task"], r["position"], r["model"], r["conformity"]) for r in got} == {("sst", 0, "ada", 0.5), ("sst", 1, "curie", 0.25), ("sst", -1, "real", 1.0)}
    expected = settings.select("task", "position")
    assert metrics.results_missing(expected, store, real).count() == 0
    missing = metrics.results_missing(expected, store.filter("position = 1"), real.limit(0)).collect()
    assert {tuple(r) for r in missing} == {("sst", 0), ("sst", -1)}
    assert metrics.results_missing(expected, store, None).count() == 0


def test_level_keeps_rows_whose_label_has_no_prompt(spark):
    rows = spark.createDataFrame([(1, "a", "one"), (2, "b", "two"), (3, None, "three")], "row_id int, label string, answer string")
    prompts = spark.createDataFrame([("a", 0, "Again: {{answer}}")], "label string, prompt_idx bigint, template string")
    log = spark.createDataFrame([(1, "uno"), (2, "dos")], "row_id int, answer string")
    first = rewrite.run_level(rows, prompts, log, ["row_id"])
    got = {r["row_id"]: (r["messages"] and r["messages"][-1]["content"], r["answer"]) for r in first.collect()}
    assert got == {1: ("Again: one", "uno"), 2: (None, "dos"), 3: (None, None)}
    second = rewrite.run_level(first, prompts, log, ["row_id"], messages="messages").collect()
    assert {r["row_id"]: r["messages"] and len(r["messages"]) for r in second} == {1: 4, 2: None, 3: None}


def test_labels_are_drawn_in_their_order(spark):
    names = ["b", "ba", "", "é", "a", "𝄞"]
    prompts = spark.createDataFrame([(n, 0, n) for n in names], "label string, prompt_idx bigint, template string")
    free = spark.range(300).select(F.col("id").alias("request_id"), F.lit(None).cast("string").alias("label"))
    got = {r["request_id"]: r["label"] for r in generate.pick_prompts(free, prompts).collect()}
    code = F.pmod(key_number(order_key("request_id", seed="pick-label")), F.lit(len(names)))
    want = {r["request_id"]: sorted(names)[r["c"]] for r in free.select("request_id", code.alias("c")).collect()}
    assert got == want and set(got.values()) == set(names)


def test_source_layouts(spark):
    news = spark.createDataFrame([(1, "A (AP)"), (4, "Bee"), (2, "x)")], "`Class Index` int, Title string")
    assert {(r["text"], r["label"]) for r in sources.news(news, "Class Index", "Title").collect()} == {("A ", "World"), ("Bee", "Sci/Tech")}
    qa = spark.createDataFrame([("why", "sub", None), (None, "sub", "d")], "title string, subreddit string, document string")
    assert [tuple(r) for r in sources.questions(qa, "document", "title", "subreddit").collect()] == [("why", "sub")]
    flags = spark.createDataFrame([("aa", False, 1, 1, 0, 0, 0), ("bb", True, 1, 0, 0, 0, 0)], "text string, example_very_unclear boolean, gratitude int, nervousness int, desire int, grief int, surprise int")
    assert {(r["text"], r["label"]) for r in sources.emotions(flags).collect()} == {("aa", "gratitude"), ("aa", "nervousness")}


def test_metric_shards_last_file_wins(spark, tmp_path):
    folder = tmp_path / "results"
    folder.mkdir()
    (folder / "list_dict_metrics_0-3.json").write_text(json.dumps([{"a": 1.0}, {"a": 2.0, "b": "text"}, {"a": 3}]))
    (folder / "list_dict_metrics_1-2.json").write_text(json.dumps({"a": 9.0}))
    got = stores.read_metric_shards(spark, [str(folder / "list_dict_metrics_0-3.json"), str(folder / "list_dict_metrics_1-2.json")])
    assert {(r["position"], r["metric"], r["value"]) for r in got.collect()} == {(0, "a", 1.0), (1, "a", 9.0), (2, "a", 3.0)}


def test_manifest(spark):
    entries = spark.createDataFrame([(0, json.dumps({"settings": "s0", "datasets": ["x", "y"]})), (1, json.dumps({"settings": "s1", "datasets": ["x", "z", "z"]}))], "position bigint, entry string")
    got = {(r["path"], r["settings"], r["depth"]) for r in stores.manifest_datasets(entries).collect()}
    assert got == {("x", "s0", 1), ("y", "s0", 2), ("z", "s1", 2)}


def test_settings_of_a_chain(spark):
    member = {"class": "Generator", "prompts": {"prompts": {"pos": ["a"] * 6, "neg": ["b"]}}, "querier": {"model": "m", "temperature": 1.3, "presence_penalty": 0.5}}
    alone = {"class": "Pipeline", "generator": {**member, "querier": {"model": "n", "temperature": 0.7, "top_p": 0.9}}}
    chain = {"class": "Pipeline", "generator": {"class": "MultiConverter", "converters": [member, {"class": "Rewrite"}]}}
    df = spark.createDataFrame([(0, json.dumps(alone)), (1, json.dumps(chain))], "position bigint, settings string")
    got = report.run_flags(stores.parse_settings(df)).orderBy("position").collect()
    assert [(r["model"], r["temperature"], r["top_p"], r["few_shot"], r["diverse"], r["diverse_bad"]) for r in got] == [
        ("n", 0.7, 0.9, True, False, False),
        ("m", 1.3, None, True, True, True),
    ]


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("d", "a", 1.0), ("d", "b", 2.0)], "dataset_id string, metric string, value double")
    new = spark.createDataFrame([("d", "b", 5.0), ("e", "a", 6.0)], "dataset_id string, metric string, value double")
    once = metrics.upsert(old, new)
    assert set(once.collect()) == set(metrics.upsert(once, new).collect()) and once.count() == 3


def test_kfold_and_flatten(spark):
    folds = spark.createDataFrame([("d", "m", v) for v in (1.0, 2.0, 3.0, 4.0)], "dataset_id string, metric string, value double")
    r = metrics.kfold_summary(folds).first()
    assert r["mean"] == 2.5 and r["std"] == pytest.approx(1.25**0.5 / 4) and r["stderr"] == pytest.approx(1.25**0.5 / 2)
    nested = spark.createDataFrame([("d", {"f": {"1": 0.5, "1_std": 0.1}})], "dataset_id string, r map<string, map<string, double>>")
    assert {(x["metric"], x["value"]) for x in metrics.flatten_map(nested, "r", ["dataset_id"]).collect()} == {("f.1", 0.5), ("f.1_std", 0.1)}


def test_metric_plan_prefix_rule(spark):
    sets = spark.createDataFrame([("a", True, 2), ("b", True, 1), ("c", False, 2)], "dataset_id string, has_real boolean, n_labels int")
    store = spark.createDataFrame([("a", "average_distinctness_spacy.1")], "dataset_id string, metric string")
    names = ["average_distinctness", "average_distinctness_spacy", "mauve", "finetune_temporal"]
    got = {tuple(r) for r in metrics.metric_plan(sets, names, store, exclude=["mauve"]).collect()}
    assert got == {("a", "finetune_temporal")} | {(d, m) for d in "bc" for m in names[:2]}


def test_request_plan(spark):
    deficits = spark.createDataFrame([("d", "x", 45), ("d", "y", 0), ("d", "z", 20)], "dataset_id string, label string, deficit bigint")
    plan = generate.request_plan(deficits, 20, block=2)
    assert sorted((r["label"], r["request"], r["size"]) for r in plan.collect()) == [("x", 0, 20), ("x", 1, 20), ("x", 2, 5), ("z", 0, 20)]
    assert {r["size"] for r in generate.request_plan(deficits, 20, retry=True).collect()} == {20}


def test_top_up_overshoots_and_stops(spark):
    have = spark.createDataFrame([("d", 1, "t", "x")], "dataset_id string, row_id bigint, text string, label string")
    quotas = spark.createDataFrame([("d", "x", 30), ("d", "y", 5)], "dataset_id string, label string, wanted bigint")

    def answer(plan, turn):
        return plan.withColumn("text", F.lit("n")).withColumn("row_id", F.col("request") + 100 * turn).withColumn(
            "k", F.explode(F.sequence(F.lit(1), F.lit(7)))
        ).select("dataset_id", "row_id", "text", "label")

    rows, deficits = generate.top_up(have, quotas, answer, per_request=10, retries=5)
    assert deficits[0] == 34 and deficits[-1] == 0 and len(deficits) <= 6
    got = dict(rows.groupBy("label").count().collect())
    assert got["x"] >= 30 and got["y"] == 7


def test_prompts_round_robin_and_pick(spark):
    prompts = spark.createDataFrame([("x", 0, "p0"), ("x", 1, "p1"), ("y", 0, "q0")], "label string, prompt_idx bigint, template string")
    requests = spark.createDataFrame([(i, "x" if i % 2 else "y") for i in range(10)], "request_id bigint, label string")
    turn = {r["request_id"]: r["template"] for r in generate.round_robin_prompts(requests, prompts).collect()}
    assert [turn[i] for i in (1, 3, 5, 7)] == ["p0", "p1", "p0", "p1"]
    free = requests.withColumn("label", F.lit(None).cast("string"))
    picked = generate.pick_prompts(free, prompts).collect()
    assert len(picked) == 10 and {r["label"] for r in picked} == {"x", "y"}


@pytest.mark.parametrize("seconds", [100, 20, 7])
def test_token_budget_equals_direct_sum(spark, seconds):
    usage = [("m", t * 7_000_000 + (t % 3), t % 50) for t in range(300)]
    df = spark.createDataFrame(usage, "model string, ts bigint, tokens bigint")
    got = {r["ts"]: (r["used"], r["admitted"]) for r in generate.token_budget(df, 200, 10, slice_seconds=seconds).collect()}
    for _, ts, _ in usage:
        used = sum(k for _, s, k in usage if s <= ts and ts - s < 60_000_000)
        assert got[ts] == (used, (200 - min(used, 200)) // 10)


def test_chat_replies_are_read(spark):
    raw = '{"choices": [{"message": {"role": "assistant", "content": "1. one\\n2. two"}, "finish_reason": "stop"}], "usage": {"total_tokens": 3}}'
    decoded = extract.decode_responses(spark.createDataFrame([(1, raw)], "request_id int, raw string"))
    out = generate.ingest(decoded, extract.numbered_answers("text", "finish_reason"), ["request_id"])
    assert sorted(r["text"] for r in out.collect()) == ["one", "two"]


def test_rewrite_level_draws_one_prompt_and_keeps_the_unanswered(spark):
    requests = spark.createDataFrame([(c, "x", f"block {c}") for c in range(30)], "chunk int, label string, answer string")
    prompts = spark.createDataFrame([("x", i, f"p{i} {{{{answer}}}}") for i in range(2)], "label string, prompt_idx bigint, template string")
    log = spark.createDataFrame([(0, "x", "done")], "chunk int, label string, answer string")
    out = rewrite.run_level(requests, prompts, log, ["chunk", "label"]).collect()
    assert sorted(r["chunk"] for r in out) == list(range(30))
    assert [r["answer"] for r in out if r["chunk"] == 0] == ["done"] and all(r["answer"] is None for r in out if r["chunk"])
    assert len({r["messages"][-1]["content"][:2] for r in out}) == 2


def test_complete_with_user_function(spark):
    def shout(batches):
        for b in batches:
            yield b.assign(text=b["text"].str.upper())

    df = spark.createDataFrame([(1, "a")], "request_id bigint, text string")
    assert generate.complete_with(df, shout, "request_id bigint, text string").first()["text"] == "A"


def test_rewrite_keeps_every_row(spark):
    df = spark.createDataFrame([("d", i, f"text {i}", "xy"[i % 2]) for i in range(50)], "dataset_id string, row_id bigint, text string, label string")
    marked = rewrite.mark_chosen(df, 0.5)
    requests = rewrite.numbered_chunks(marked.filter("chosen"), 4, shuffle_seed="s")
    answers = extract.numbered_answers("block", F.lit("stop"))
    merged = rewrite.merge(marked, requests, requests, answers)
    assert merged.count() == 50 and {r["text"] for r in merged.collect()} == {f"text {i}" for i in range(50)}
    extended = rewrite.merge(marked, requests, requests, answers, extend=True)
    assert extended.count() == 100


def test_longest_prefix_and_grid(spark):
    runs = spark.createDataFrame([(0, ["g", "a", "b"]), (1, ["g", "a", "c"]), (2, ["h"]), (3, ["g", "a", "c", "d"])], "run bigint, chain array<string>")
    got = {r["run"]: (r["source"], r["shared"]) for r in stages.longest_prefix_match(runs).collect()}
    assert got == {1: (0, 2), 3: (1, 3)}
    level = lambda *names: F.array(*[F.lit(n) for n in names])
    generators = spark.createDataFrame([("g1",), ("g2",)], "generator string")

    def chains(levels, skip=True):
        return {tuple(r["chain"]) for r in stages.config_grid(generators, levels, skip).collect()}

    assert chains([]) == {()}
    assert chains([level("a", "b"), level("c")]) == {("a", "c"), ("b", "c"), ("c",)}
    assert chains([level("a", "b"), level("c")], skip=False) == {("a", "c"), ("b", "c")}
    assert stages.config_grid(generators, [level("a")], runs=3).count() == 2 * 3 * 3


def test_stage_key_ignores_key_order(spark):
    df = spark.createDataFrame([('{"b": {"y": 1, "x": [1, 2]}, "a": "s"}',), ('{"a":"s","b":{"x":[1,2],"y":1}}',), ('{"a":"s","b":{"x":[2,1],"y":1}}',)], "s string")
    keys = [r[0] for r in df.select(stages.stage_key("s")).collect()]
    assert keys[0] == keys[1] != keys[2]


def test_stored_stages_resume(spark):
    folder = scratch_path(spark, "resume")
    df = spark.range(5)
    chain = [lambda d: d.withColumn("a", F.lit(1)), lambda d: d.withColumn("b", F.col("id") * 2)]
    _, first = stages.run_stored(df, chain[:1], folder)
    out, second = stages.run_stored(df, chain, folder)
    assert out.count() == 5
    _, third = stages.run_stored(df, chain, folder, resume=False)
    assert (first, second, third) == ([0], [1], [0, 1])


def test_common_prefix(spark):
    df = spark.createDataFrame([("g", "a/bc/d"), ("g", "a/bcd"), ("h", "x/y/z"), ("i", "q"), ("i", "r"), ("j", "a/b"), ("j", "a/b")], "g string, p string")
    got = {r["g"]: r["prefix"] for r in report.common_prefix(df, "p", ["g"]).collect()}
    assert got == {"g": "a/", "h": "x/y/", "i": "", "j": "a/"}


def test_model_matchers(spark):
    names = ["ada", "text-ada-001", "text-davinci-003", "gpt-3.5-turbo", "davinci"]
    df = spark.createDataFrame([(n,) for n in names], "model string")

    def hits(*matchers, **kw):
        return {r[0] for r in df.filter(report.model_matches(list(matchers), **kw)).collect()}

    assert hits("text") == {"text-ada-001"}
    assert hits("!text") == {"ada", "davinci"}
    assert hits("rlhf") == {"text-davinci-003", "gpt-3.5-turbo"}
    assert hits("ada$", "turbo") == {"ada", "gpt-3.5-turbo"}
    assert hits("!text", "ada") == {"ada", "davinci", "text-ada-001"}
    assert hits("!text", "ada", sticky_negation=True) == {"ada", "davinci"}
    assert hits() == set(names)


def test_sql_functions(spark):
    sql_functions.register(spark)
    row = spark.sql("SELECT clean_text('A-b  C!') c, token_array('a, b') t, numbered_lines('x\n1. a\n\n2) b') n").first()
    assert row["c"] == "a-b c".replace("-", " ") or row["c"] == "a b c"
    assert row["t"] == ["a", "b"] and row["n"] == ["1. a", "2) b"]
    replies = ["1. \"Great\" he said\n2) plain  \n3: 'unclosed\n4. \n5. \"a\"", "1. \"\"\n2. it's\n3. an AI language model", "none", ""]
    said = spark.createDataFrame([(t, r) for t in replies for r in ("stop", "length", None)], "t string, r string")
    both = said.select(extract.numbered_answers("t", "r").alias("want"), F.expr("extract_numbered(t, r)").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in both) and any(r["got"] for r in both)


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame([("d", "x")] * (k + 1) + [("d", "y")], "dataset_id string, label string").coalesce(1).write.mode("append").parquet(str(folder))
    schema = spark.read.parquet(str(folder)).schema
    quotas = spark.createDataFrame([("d", "x", 8), ("d", "y", 2), ("d", "z", 4)], "dataset_id string, label string, wanted bigint")
    stream = jobs.file_stream(spark, str(folder), schema, "*.parquet", files_per_batch=1)
    got = {(r["label"], r["deficit"]) for r in jobs.label_deficit(stream, quotas, str(tmp_path / "out")).collect()}
    batch = generate.label_deficit(spark.read.parquet(str(folder)), quotas)
    assert got == {(r["label"], r["deficit"]) for r in batch.collect()} == {("x", 2), ("y", 0), ("z", 4)}


def test_evaluate_with_one_label_and_excludes(spark):
    rows = [(d, i + 100 * k, f"word{i % 7} other{i % 3} text{d}", "only") for k, d in enumerate(("a", "real")) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset_id string, row_id bigint, text string, label string")
    out = evaluate.evaluate_all(df.filter("dataset_id = 'a'"), df.filter("dataset_id = 'real'"), exclude=("mauve",))
    got = {(r["dataset_id"], r["metric"]): r["value"] for r in out.collect()}
    assert not any(metric.startswith("finetune") for _, metric in got)
    assert ("a", "distinctness.3") in got and ("a", "average_distinctness_spacy.1") in got


def test_load_many_numbers_rows_by_file_and_place(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "1.csv").write_text('text,label\n"one, two",x\nz,x\nthree,\n"four ""five""",y\n')
    (tmp_path / "a" / "2.csv").write_text("text,label\nsix six,y\n")
    (tmp_path / "b.csv").write_text('text,label\n"line\nbreak",x\n,y\n')
    paths = [f"{tmp_path}/a", f"{tmp_path}/b.csv"]
    got = sorted(tuple(r) for r in sources.load_many(spark, paths).collect())
    assert got == [
        (paths[0], 0, "one, two", "x"), (paths[0], 1, 'four "five"', "y"), (paths[0], 2, "six six", "y"), (paths[1], 0, "line\nbreak", "x"),
    ]


def test_store_issues(spark, tmp_path):
    path = str(tmp_path / "store")
    empty, number = stores.read_store(spark, path)
    assert (empty.count(), number) == (0, 0)
    for issue, value in ((1, 0.5), (2, 0.7)):
        stores.write_store(spark.createDataFrame([("d", "m", value)], stores.STORE), path, issue)
    # Rows without an entry as complete are not part of the store.
    spark.createDataFrame([("d", "m", 9.0)], stores.STORE).write.parquet(f"{path}/data/torn")
    store, number = stores.read_store(spark, path)
    assert (number, [tuple(r) for r in store.collect()]) == (2, [("d", "m", 0.7)])


def test_evaluate_into_takes_only_what_lacks(spark, tmp_path):
    rows = [(d, i + 100 * k, f"word{i % 7} other{i % 3} text{d}", "xy"[i % 2]) for k, d in enumerate(("a", "b", "real")) for i in range(20)]
    df = spark.createDataFrame(rows, "dataset_id string, row_id bigint, text string, label string")
    fake, real, path = df.filter("dataset_id <> 'real'"), df.filter("dataset_id = 'real'"), str(tmp_path / "metrics")
    stores.write_store(spark.createDataFrame([("a", "distinctness.3", -1.0)], stores.STORE), path, 1)
    others = ("mauve", "finetune_temporal", "average_distinctness", "average_distinctness_spacy")
    got = {(r["dataset_id"], r["metric"]): r["value"] for r in evaluate.evaluate_into(path, fake, real, exclude=others).collect()}
    assert set(got) == {("a", "distinctness.3")} | {(d, f"distinctness.3{end}") for d in ("b", "real") for end in ("", "_std")}
    assert got["a", "distinctness.3"] == -1
    again = evaluate.evaluate_into(path, fake, real, exclude=others, force=True)
    assert again.filter("dataset_id = 'a' AND metric = 'distinctness.3'").first()["value"] > 0
    assert stores.read_store(spark, path)[1] == 3
    alone = evaluate.evaluate_into(str(tmp_path / "alone"), fake, real.limit(0), exclude=("average_distinctness_spacy",))
    assert {r[0] for r in alone.select("metric").distinct().collect()} == {f"{m}.3{end}" for m in ("distinctness", "average_distinctness") for end in ("", "_std")}


def test_grid_runs_what_is_missing(spark):
    folder, df = scratch_path(spark, "grid"), spark.range(3)
    one, two = ("one", lambda d: d.withColumn("a", F.lit(1))), ("two", lambda d: d.withColumn("b", F.lit(2)))
    _, ran = stages.run_grid(df, {"short": [one], "long": [one, two]}, folder)
    assert ran == {"short": [0], "long": [1]}
    manifest, ran = stages.run_grid(df, {"short": [one], "long": [one, two], "other": [two]}, folder)
    assert ran == {"short": [], "long": [], "other": [0]}
    found = stores.manifest_datasets(manifest)
    assert {(r["settings"], r["depth"]) for r in found.collect()} == {("short", 1), ("long", 2), ("other", 1)}
