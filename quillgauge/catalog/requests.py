"""Quotas, requests, prompts, recorded responses, rewriting, stage chains."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.catalog.base import CONFIGS, DS, datasets, key_number_sql, md5_sql, query, run_configs, table
from quillgauge.catalog.rows import RAGGED, ragged
from quillgauge.catalog.texts import NUMBERED, numbered_responses
from quillgauge.functions import extract
from quillgauge.functions.text import clean_text
from quillgauge.operators import generate, rewrite, rows
from quillgauge.operators.ordering import number_by_id
from quillgauge.plans import stages
from quillgauge.session import scratch_path


def prompt_set(spark, sf, mark: str) -> DataFrame:
    """Prompt templates per language out of the documents with the given mark."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").filter(f"{mark} = 1"), "doc_id")
    named = docs.select(F.col("lang").alias("label"), F.col("doc_id").alias("row_id"), F.col("text").alias("head"))
    numbered = number_by_id(named, ["label"])
    template = F.concat(F.lit("Like "), "head", F.lit(": {{answer}}"))
    return numbered.select("label", (F.col("position") - 1).alias("prompt_idx"), template.alias("template"))


def prompt_sql(name: str, mark: str) -> str:
    return f"""{name} AS (SELECT lang AS label, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS prompt_idx,
  'Like ' || text || ': {{{{answer}}}}' AS template FROM documents JOIN labels USING (doc_id) WHERE {mark} = 1)"""


PROMPTS = prompt_sql("prompts", "quality")


def doc_requests(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), F.col("lang").alias("label"))


@query("merge_prompt_sets", f"""WITH {PROMPTS}, {prompt_sql("more", "toxic")},
n AS (SELECT label, count(*) AS n FROM prompts GROUP BY 1)
SELECT * FROM prompts UNION ALL SELECT label, prompt_idx + coalesce(n, 0), template FROM more LEFT JOIN n USING (label)""")
def merge_prompt_sets(spark, sf):
    return generate.merge_prompt_sets(prompt_set(spark, sf, "quality"), prompt_set(spark, sf, "toxic"))


@query("prompt_round_robin", f"""WITH {PROMPTS}, n AS (SELECT label, count(*) AS n FROM prompts GROUP BY 1),
r AS (SELECT doc_id AS request_id, lang AS label, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS turn FROM documents)
SELECT request_id, label, prompt_idx, template FROM r JOIN n USING (label) JOIN prompts USING (label) WHERE prompt_idx = turn % n""")
def prompt_round_robin(spark, sf):
    return generate.round_robin_prompts(doc_requests(spark, sf), prompt_set(spark, sf, "quality"))


@query("prompt_pick", f"""WITH {PROMPTS}, n AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY label) - 1 AS code FROM prompts GROUP BY 1),
r AS (SELECT doc_id AS request_id, CASE WHEN n_chars % 3 = 0 THEN NULL ELSE lang END AS label FROM documents),
l AS (SELECT r.request_id, coalesce(r.label, n.label) AS label FROM r
  JOIN n ON n.code = {key_number_sql(md5_sql("request_id", seed="pick-label"))} % (SELECT count(*) FROM n))
SELECT request_id, label, prompt_idx, template FROM l JOIN n USING (label) JOIN prompts USING (label)
WHERE prompt_idx = {key_number_sql(md5_sql("request_id", seed="pick"))} % n""")
def prompt_pick(spark, sf):
    label = F.when(F.col("n_chars") % 3 != 0, F.col("lang"))
    requests = table(spark, sf, "documents").select(F.col("doc_id").alias("request_id"), label.alias("label"))
    return generate.pick_prompts(requests, prompt_set(spark, sf, "quality"))


SHOTS = f"""examples AS (SELECT lang AS label, doc_id AS row_id, text,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM documents),
sizes AS (SELECT label, count(*) AS n FROM examples GROUP BY 1),
tries AS (SELECT label, n, repetition, t FROM (SELECT *, unnest(range(CASE WHEN n <= 6 THEN n ELSE 70 END)) AS t
  FROM (SELECT *, unnest(range(500)) AS repetition FROM sizes))),
keyed AS (SELECT *, {md5_sql("label", "repetition", "t", seed="shots")} AS k FROM tries),
picked AS (SELECT label, repetition, CASE WHEN n <= 6 THEN t ELSE {key_number_sql("k", 15)} % n END AS idx,
  CASE WHEN n <= 6 THEN {key_number_sql("k", 15)} ELSE t END AS rank FROM keyed),
firsts AS (SELECT label, repetition, idx, min(rank) AS rank FROM picked GROUP BY 1, 2, 3),
ranked AS (SELECT *, row_number() OVER (PARTITION BY label, repetition ORDER BY rank, idx) AS draw FROM firsts),
shots AS (SELECT label, repetition AS prompt_idx, draw, row_id, text FROM ranked JOIN examples USING (label, idx) WHERE draw <= 3)"""


def _shots(spark, sf) -> DataFrame:
    examples = table(spark, sf, "documents").select(
        F.col("lang").alias("label"), F.col("doc_id").alias("row_id"), "text"
    )
    return generate.fewshot_sample(examples)


@query("fewshot_sample", f"WITH {SHOTS} SELECT * FROM shots")
def fewshot_sample(spark, sf):
    return _shots(spark, sf)


@query("fewshot_block", f"""WITH {SHOTS} SELECT label, prompt_idx,
string_agg(CAST(draw AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY draw) AS single,
string_agg(CAST(draw AS VARCHAR) || 'a. ' || text || chr(10) || ' ' || CAST(draw AS VARCHAR) || 'b. ' || CAST(row_id AS VARCHAR) || chr(10), '' ORDER BY draw) AS dual
FROM shots GROUP BY 1, 2""")
def fewshot_block(spark, sf):
    shots = _shots(spark, sf).withColumn("other", F.col("row_id").cast("string"))
    single = generate.numbered_block(shots, ["label", "prompt_idx"], "draw", out="single")
    dual = generate.numbered_block(shots, ["label", "prompt_idx"], "draw", other="other", out="dual")
    return single.join(dual, ["label", "prompt_idx"])


def quotas(spark, sf, wanted: int) -> DataFrame:
    """The same quota for every language in every source, also those a source lacks."""
    pairs = datasets(spark, sf).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"))
    label = F.explode(F.array(*[F.lit(v) for v in ("de", "en", "es", "fr", "it")])).alias("label")
    return pairs.select("dataset_id", label, F.lit(wanted).cast("bigint").alias("wanted"))


DEFICITS = """have AS (SELECT source AS dataset_id, lang AS label, count(*) AS have FROM documents GROUP BY 1, 2),
quotas AS (SELECT DISTINCT source AS dataset_id, unnest(['de', 'en', 'es', 'fr', 'it']) AS label, CAST({wanted} AS BIGINT) AS wanted FROM documents),
deficits AS (SELECT dataset_id, label, wanted, coalesce(have, 0) AS have, greatest(wanted - coalesce(have, 0), 0) AS deficit
  FROM quotas LEFT JOIN have USING (dataset_id, label))"""


@query("label_deficit", f"""WITH {DEFICITS.format(wanted=30)} SELECT * FROM deficits""")
def label_deficit(spark, sf):
    return generate.label_deficit(datasets(spark, sf), quotas(spark, sf, 30))


@query("request_plan", f"""WITH {DEFICITS.format(wanted=3000)},
r AS (SELECT *, unnest(range(0, deficit, 20)) AS i FROM deficits)
SELECT dataset_id, label, wanted, have, deficit, i // 20 AS request, least(20, deficit - i) AS size FROM r""")
def request_plan(spark, sf):
    return generate.request_plan(generate.label_deficit(datasets(spark, sf), quotas(spark, sf, 3000)))


@query("request_response_join", f"""WITH {PROMPTS}
SELECT conv_id * 1000 + u.turn AS request_id, u.text AS prompt, a.text AS response
FROM conversations u LEFT JOIN conversations a USING (conv_id) WHERE u.role = 'user' AND a.turn = u.turn + 1 AND a.role = 'assistant'
UNION ALL SELECT conv_id * 1000 + u.turn, u.text, NULL FROM conversations u WHERE u.role = 'user'
AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""")
def request_response_join(spark, sf):
    turns = table(spark, sf, "conversations")
    asked = turns.filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("prompt"))
    log = turns.filter("role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("request_id"), F.col("text").alias("response")
    )
    return generate.complete_from_log(asked, log)


@query("ingest_responses", f"""WITH {NUMBERED}
SELECT request_id, 'label' || CAST(request_id % 3 AS VARCHAR) AS label, answer_idx, text FROM numbered""")
def ingest_responses(spark, sf):
    turns = table(spark, sf, "conversations")
    request_id = F.col("conv_id") * 1000 + F.col("turn")
    label = F.concat(F.lit("label"), (request_id % 3).cast("string"))
    requests = turns.select(request_id.alias("request_id"), label.alias("label"))
    answered = generate.complete_from_log(requests, numbered_responses(spark, sf).drop("label"))
    out = generate.ingest(answered, extract.numbered_answers(extract.reply_text(), "finish_reason"), ["request_id", "label"])
    return out.withColumn("answer_idx", F.col("answer_idx").cast("bigint"))


@query("topup_rounds", f"""WITH RECURSIVE {DEFICITS.format(wanted=90)},
t(dataset_id, label, wanted, have, turn) AS (
  SELECT dataset_id, label, wanted, have, 0 FROM deficits
  UNION ALL
  SELECT dataset_id, label, wanted, have + coalesce(list_sum(list_transform(range((wanted - have + 19) // 20),
    lambda r: greatest((CASE WHEN turn = 0 THEN least(20, wanted - have - r * 20) ELSE 20 END) - (r + 1) * 3, 0))), 0), turn + 1
  FROM t WHERE turn <= 5 AND have < wanted)
SELECT dataset_id, label, max(have) AS have, max(wanted) AS wanted, max(wanted) - least(max(have), max(wanted)) AS deficit FROM t GROUP BY 1, 2""")
def topup_rounds(spark, sf):
    pool = table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text"
    )
    pool = number_by_id(pool, []).select((F.col("position") - 1).alias("pick"), "text")
    size = pool.count()

    def answer(plan, turn):
        lost = (F.col("request") + 1) * 3
        some = plan.filter(F.col("size") > lost).withColumn("j", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("size") - lost)))
        some = some.withColumn("pick", F.pmod(F.xxhash64("dataset_id", "label", "request", "j"), F.lit(size)))
        row_id = F.lit(10**12 * (turn + 1)) + F.col("request") * 1000 + F.col("j")
        return some.join(pool, "pick").select("dataset_id", row_id.alias("row_id"), "text", "label")

    wanted = quotas(spark, sf, 90)
    filled, _ = generate.top_up(datasets(spark, sf), wanted, answer)
    return generate.label_deficit(filled, wanted)


def raw_log(events: DataFrame) -> DataFrame:
    """A response log out of the events: errors, broken JSON, missing bodies, and good answers."""
    e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("bigint")
    good = F.concat(
        F.lit('{"choices": [{"text": "answer '), e.cast("string"), F.lit('", "finish_reason": "'),
        F.when(k % 2 == 0, "stop").otherwise("length"), F.lit('"}], "usage": {"total_tokens": '), k.cast("string"), F.lit("}}"),
    )
    raw = (
        F.when(F.col("event_type") == "error", F.concat(F.lit('{"error": {"message": "busy", "code": '), k.cast("string"), F.lit("}}")))
        .when(k % 10 == 0, F.expr("substring(x, 1, length(x) - 7)"))
        .when(k % 10 == 1, F.lit(None))
        .otherwise(F.col("x"))
    )
    return events.withColumn("x", good).select("event_id", F.col("event_type").alias("model"), raw.alias("raw"))


def raw_responses(spark, sf) -> DataFrame:
    return raw_log(table(spark, sf, "events"))


STATUS = """k AS (SELECT event_id, event_type AS model, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
decoded AS (SELECT event_id, model, CASE WHEN model = 'error' OR k % 10 = 1 THEN 'api_error' WHEN k % 10 = 0 THEN 'parse_error' ELSE 'ok' END AS status, k FROM k)"""


@query("response_status", f"""WITH {STATUS} SELECT event_id, model, status, CASE WHEN status = 'ok' THEN 'answer ' || CAST(event_id AS VARCHAR) END AS text,
CASE WHEN status = 'ok' THEN CASE WHEN k % 2 = 0 THEN 'stop' ELSE 'length' END END AS finish_reason, CASE WHEN status = 'ok' THEN k END AS total_tokens FROM decoded""")
def response_status(spark, sf):
    return extract.decode_responses(raw_responses(spark, sf)).drop("raw", "message")


@query("request_outcomes", f"""WITH {STATUS} SELECT model, count(*) FILTER (WHERE status = 'ok') AS succeeded, count(*) FILTER (WHERE status = 'api_error') AS api_errors,
count(*) FILTER (WHERE status = 'parse_error') AS parse_errors, round(avg(CAST(status = 'ok' AS INTEGER)), 6) AS share_done FROM decoded GROUP BY 1""")
def request_outcomes(spark, sf):
    out = generate.request_outcomes(extract.decode_responses(raw_responses(spark, sf)), ["model"])
    return out.withColumn("share_done", F.round("share_done", 6))


USAGE = "usage AS (SELECT event_id, event_type AS model, epoch_us(ts) AS ts, CAST(floor(value * 100) AS BIGINT) AS tokens FROM events)"


@query("token_budget", f"""WITH {USAGE}, w AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM usage)
SELECT event_id, model, ts, tokens, used, (10000 - least(used, 10000)) // 500 AS admitted FROM w""")
def token_budget(spark, sf):
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    usage = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model"), ts.alias("ts"), F.floor(F.col("value") * 100).alias("tokens")
    )
    return generate.token_budget(usage, 10_000, 500)


@query("numbered_chunks", f"""WITH {DS}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label ORDER BY row_id) - 1 AS p FROM ds)
SELECT dataset_id, label, p // 20 AS chunk, string_agg(CAST(p % 20 + 1 AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY p) AS block FROM n GROUP BY 1, 2, 3""")
def numbered_chunks(spark, sf):
    return rewrite.numbered_chunks(datasets(spark, sf))


def _flat(spark, sf) -> DataFrame:
    """Datasets with every text on one line, 60 % of the rows chosen for rewriting."""
    ds = datasets(spark, sf).withColumn("text", F.translate("text", "\n\"'", "   "))
    return rewrite.mark_chosen(ds, 0.6)


_CHOSEN = f"{key_number_sql(md5_sql('doc_id', seed='rewrite'))} < {int(0.6 * 2**32)}"
FLAT = f"""flat AS (SELECT source AS dataset_id, doc_id AS row_id, translate(text, chr(10) || '"' || chr(39), '   ') AS text, lang AS label, {_CHOSEN} AS chosen FROM documents)"""


def chunks_sql(size: int) -> str:
    return f"""placed AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label ORDER BY {md5_sql("row_id", seed="order")}) - 1 AS p FROM flat WHERE chosen),
chunks AS (SELECT dataset_id, label, p // {size} AS chunk, string_agg(CAST(p % {size} + 1 AS VARCHAR) || '. ' || text || chr(10), '' ORDER BY p) AS block
  FROM placed GROUP BY 1, 2, 3)"""


def _requests(spark, sf, size: int) -> tuple[DataFrame, DataFrame]:
    flat = _flat(spark, sf)
    return flat, rewrite.numbered_chunks(flat.filter("chosen").drop("chosen"), size, shuffle_seed="order")


@query("rewrite_requests", f"WITH {FLAT}, {chunks_sql(3)} SELECT * FROM chunks")
def rewrite_requests(spark, sf):
    return _requests(spark, sf, 3)[1]


@query("rewrite_levels", f"""WITH {FLAT}, {chunks_sql(3)}, {PROMPTS}, {prompt_sql("more", "toxic")},
np AS (SELECT label, count(*) AS np FROM prompts GROUP BY 1), nm AS (SELECT label, count(*) AS nm FROM more GROUP BY 1),
l AS (SELECT dataset_id, label, chunk, block, p.template AS t1, m.template AS t2 FROM chunks JOIN np USING (label) JOIN nm USING (label)
  JOIN prompts p USING (label) JOIN more m USING (label)
  WHERE p.prompt_idx = {key_number_sql(md5_sql("dataset_id", "label", "chunk", seed="first"))} % np
  AND m.prompt_idx = {key_number_sql(md5_sql("dataset_id", "label", "chunk", seed="second"))} % nm),
m AS (SELECT dataset_id, label, chunk, unnest(range(4)) AS place, unnest(['system', 'user', 'assistant', 'user']) AS role,
  unnest(['You are a helpful assistant.', replace(t1, '{{{{answer}}}}', block), replace(block, 'e', 'E'), t2]) AS content FROM l)
SELECT dataset_id, label, chunk, CAST(place AS INTEGER) AS place, role, content FROM m""")
def rewrite_levels(spark, sf):
    _, requests = _requests(spark, sf, 3)
    keys = ["dataset_id", "label", "chunk"]
    log = requests.select(*keys, F.replace("block", F.lit("e"), F.lit("E")).alias("answer"))
    first, second = prompt_set(spark, sf, "quality"), prompt_set(spark, sf, "toxic")
    level1 = rewrite.run_level(requests.withColumnRenamed("block", "answer"), first, log, keys, seed="first")
    level2 = rewrite.run_level(level1, second, log, keys, messages="messages", seed="second")
    return level2.select(*keys, F.posexplode("messages").alias("place", "m")).select(*keys, "place", "m.role", "m.content")


_ANSWERS = f"""answers AS (SELECT dataset_id, label, rtrim(regexp_replace(replace(text, 'e', 'E'), '^[\\p{{N}}.: )]*', ''), ' ') AS text FROM placed),
merged AS (SELECT dataset_id, label, text, 'unchosen' AS origin FROM flat WHERE NOT chosen
  UNION ALL SELECT dataset_id, label, text, 'answer' FROM answers WHERE length(text) > 0)"""


def _merge(spark, sf, extend: bool) -> DataFrame:
    flat, requests = _requests(spark, sf, 3)
    responses = requests.withColumn("text", F.replace("block", F.lit("e"), F.lit("E")))
    return rewrite.merge(flat, requests, responses, extract.numbered_answers("text", F.lit("stop")), extend)


@query("rewrite_merge", f"WITH {FLAT}, {chunks_sql(3)}, {_ANSWERS} SELECT * FROM merged")
def rewrite_merge(spark, sf):
    return _merge(spark, sf, False)


def _chain_sql() -> str:
    """Two rewrites: each takes chosen rows in chunks and gives answers with ids that the next one can choose by."""

    def level(n: int, flat: str, size: int, old: str, new: str) -> str:
        key = md5_sql("dataset_id", "label", "chunk", "place", seed="answer")
        return f"""p{n} AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label ORDER BY {md5_sql("row_id", seed="order")}, row_id) - 1 AS p FROM {flat} WHERE chosen),
a{n} AS (SELECT dataset_id, label, p, p // {size} AS chunk, rtrim(regexp_replace(replace(text, '{old}', '{new}'), '^[\\p{{N}}.: )]*', ''), ' ') AS text FROM p{n}),
n{n} AS (SELECT *, row_number() OVER (PARTITION BY dataset_id, label, chunk ORDER BY p) - 1 AS place FROM a{n} WHERE text <> ''),
m{n} AS (SELECT dataset_id, label, row_id, text, 'unchosen' AS origin FROM {flat} WHERE NOT chosen
  UNION ALL SELECT dataset_id, label, {key_number_sql(key, 15)}, text, 'answer' FROM n{n} WHERE length(text) > 0)"""

    again = f"f2 AS (SELECT *, {key_number_sql(md5_sql('row_id', seed='again'))} < {1 << 31} AS chosen FROM m1)"
    return f"WITH {FLAT}, {level(1, 'flat', 3, 'e', 'E')}, {again}, {level(2, 'f2', 2, 'o', 'O')} SELECT * FROM m2"


@query("rewrite_chain", _chain_sql())
def rewrite_chain(spark, sf):
    """A dataset rewritten, and half of the outcome rewritten once more."""
    rows = _flat(spark, sf)
    for size, old, seed in ((3, "e", None), (2, "o", "again")):
        rows = rows if seed is None else rewrite.mark_chosen(rows.drop("origin"), 0.5, seed)
        requests = rewrite.numbered_chunks(rows.filter("chosen").drop("chosen"), size, shuffle_seed="order")
        said = requests.withColumn("text", F.replace("block", F.lit(old), F.lit(old.upper())))
        rows = rewrite.merge(rows, requests, said, extract.numbered_answers("text", F.lit("stop")), row_ids=True)
    return rows


@query("rewrite_extend", f"WITH {FLAT}, {chunks_sql(3)}, {_ANSWERS} SELECT * FROM merged UNION ALL SELECT dataset_id, label, text, 'original' FROM flat")
def rewrite_extend(spark, sf):
    return _merge(spark, sf, True)


@query("rewrite_prepend", f"""WITH {FLAT}, {chunks_sql(1)}
SELECT dataset_id, label, text, 'unchosen' AS origin FROM flat WHERE NOT chosen
UNION ALL SELECT dataset_id, label, text || 'And so on in ' || label, 'answer' FROM placed""")
def rewrite_prepend(spark, sf):
    flat, requests = _requests(spark, sf, 1)
    responses = requests.withColumn("text", F.concat(F.lit('"And so on in '), "label", F.lit('"')))
    answer = extract.plain_answer("text", strip_chars="\"'")
    return rewrite.merge(flat, requests, responses, F.array_compact(F.array(answer)), prepend=True)


def _stage_list() -> list[stages.Stage]:
    return [
        rows.load_normalise,
        lambda df: df.withColumn("text", clean_text("text")),
        rows.remove_empty,
        lambda df: df.withColumn("text", F.concat("label", F.lit(": "), "text")),
    ]


_CHAIN = f"""{RAGGED}, s0 AS (SELECT * FROM ragged WHERE label IS NOT NULL AND length(text) >= 2),
s1 AS (SELECT dataset_id, row_id, label, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '([a-z])-([a-z])', '\\1 \\2', 'g'),
  '[^a-z\\s]', '', 'g'), '\\s{{2,}}', ' ', 'g'), ' ' || chr(10)) AS text FROM s0),
s3 AS (SELECT dataset_id, row_id, label, label || ': ' || text AS text FROM s1 WHERE length(text) >= 2)
SELECT dataset_id, row_id, label, text FROM s3"""


@query("stage_chain", f"WITH {_CHAIN}")
def stage_chain(spark, sf):
    chain = _stage_list()
    return stages.run_chain(stages.run_chain(ragged(spark, sf), chain, end=1), chain, start=1)


@query("stage_resume", f"WITH {_CHAIN}")
def stage_resume(spark, sf):
    """Resumed behind its first two stages; a chain with another second stage shares only the first."""
    folder, chain, keys = scratch_path(spark, "stages"), _stage_list(), ["load", "clean", "remove", "mark"]
    stages.run_stored(ragged(spark, sf), chain[:2], folder, keys=keys[:2])
    other = [chain[0], lambda df: df.withColumn("text", F.upper("text")), *chain[2:]]
    _, changed = stages.run_stored(ragged(spark, sf), other, folder, keys=["load", "upper", *keys[2:]])
    done, ran = stages.run_stored(ragged(spark, sf), chain, folder, keys=keys)
    if (changed, ran) != ([1, 2, 3], [2, 3]):
        raise RuntimeError(f"stages {changed} and {ran} ran")
    return done


@query("grid_run", """WITH m AS (SELECT source AS dataset_id, doc_id AS row_id, replace(text, 'e', '3') AS text FROM documents)
SELECT 'even' AS run, 2::BIGINT AS depth, dataset_id, row_id, md5(text) AS digest FROM m WHERE length(text) % 2 = 0
UNION ALL SELECT 'joined', 2, dataset_id, row_id, md5(replace(text, ' ', '_')) FROM m
UNION ALL SELECT 'joined marked', 3, dataset_id, row_id, md5(replace(text, ' ', '_') || '!') FROM m""")
def grid_run(spark, sf):
    """Three chains that share prefixes, the last outputs found through the manifest."""
    digits = ("digits", lambda df: df.withColumn("text", F.replace("text", F.lit("e"), F.lit("3"))))
    joined = ("joined", lambda df: df.withColumn("text", F.replace("text", F.lit(" "), F.lit("_"))))
    even = ("even", lambda df: df.filter(F.length("text") % 2 == 0))
    mark = ("mark", lambda df: df.withColumn("text", F.concat("text", F.lit("!"))))
    chains = {"even": [digits, even], "joined": [digits, joined], "joined marked": [digits, joined, mark]}
    manifest, ran = stages.run_grid(datasets(spark, sf), chains, scratch_path(spark, "grid"))
    if ran != {"even": [0, 1], "joined": [1], "joined marked": [2]}:
        raise RuntimeError(f"stages {ran} ran")
    parts = []
    for (entry,) in manifest.orderBy("position").select("entry").collect():
        run = json.loads(entry)
        last = spark.read.parquet(run["datasets"][-1])
        parts.append(last.select(
            F.lit(run["settings"]).alias("run"), F.lit(len(run["datasets"])).cast("bigint").alias("depth"), "dataset_id", "row_id", F.md5("text").alias("digest")
        ))
    return reduce(DataFrame.unionByName, parts)


@query("stage_key", f"""WITH {CONFIGS} SELECT task, dataset_id, sha256('{{"generator":{{"class":"' || generator_class || '","n_prompts":' || CAST(n_prompts AS VARCHAR)
|| '}},"querier":{{"model":"' || model || '","tpm":30000}}}}') AS key FROM configs""")
def stage_key(spark, sf):
    inner = F.concat(F.lit('{"class": "'), "generator_class", F.lit('", "n_prompts": '), F.col("n_prompts").cast("string"), F.lit("}"))
    turned = F.concat(F.lit('{"n_prompts":'), F.col("n_prompts").cast("string"), F.lit(',"class":"'), "generator_class", F.lit('"}'))
    querier = F.concat(F.lit('{"tpm": 30000, "model": "'), "model", F.lit('"}'))
    settings = F.when(
        F.col("position") % 2 == 0, F.concat(F.lit('{"querier":'), querier, F.lit(', "generator":'), inner, F.lit("}"))
    ).otherwise(F.concat(F.lit('{"generator": '), turned, F.lit(', "querier": '), querier, F.lit("}")))
    return run_configs(spark, sf).select("task", "dataset_id", stages.stage_key(settings).alias("key"))


@query("longest_prefix_match", """WITH r AS (SELECT doc_id AS run, source || '>' AS p1, source || '>' || lang || '>' AS p2,
  source || '>' || lang || '>' || CAST(n_chars % 5 AS VARCHAR) AS p3 FROM documents),
p AS (SELECT run, 1 AS shared, p1 AS prefix FROM r UNION ALL SELECT run, 2, p2 FROM r UNION ALL SELECT run, 3, p3 FROM r),
m AS (SELECT *, min(run) OVER (PARTITION BY prefix) AS source FROM p)
SELECT run, arg_max(source, shared) AS source, CAST(max(shared) AS BIGINT) AS shared FROM m WHERE source < run GROUP BY 1""")
def longest_prefix_match(spark, sf):
    runs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("run"), F.array("source", "lang", (F.col("n_chars") % 5).cast("string")).alias("chain")
    )
    return stages.longest_prefix_match(runs)


@query("config_grid", """WITH l AS (SELECT DISTINCT source AS generator, lang AS a FROM documents),
b AS (SELECT DISTINCT source AS generator, CAST(n_chars % 3 AS VARCHAR) AS b FROM documents),
c AS (SELECT generator, a || '>' || b AS chain FROM l JOIN b USING (generator) UNION ALL SELECT generator, b FROM b)
SELECT generator, chain, t AS temperature, run FROM c, (SELECT unnest([0.7::DOUBLE, 1.0, 1.3]) AS t), (SELECT unnest(range(2)) AS run)""")
def config_grid(spark, sf):
    generators = table(spark, sf, "documents").groupBy(F.col("source").alias("generator")).agg(
        F.collect_set("lang").alias("first"), F.collect_set((F.col("n_chars") % 3).cast("string")).alias("second")
    )
    grid = stages.config_grid(generators, [F.col("first"), F.col("second")], runs=2)
    return grid.select("generator", F.concat_ws(">", "chain").alias("chain"), "temperature", "run")
