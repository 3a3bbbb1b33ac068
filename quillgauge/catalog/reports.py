"""Experiment tables and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgauge.catalog.base import CONFIGS, EXPERIMENTS, METRICS, experiments, metric_store, query, real, real_store, rounded, run_configs, table
from quillgauge.operators import metrics, report
from quillgauge.operators.rows import first_wins
from quillgauge.session import scratch_path
from quillgauge.sources import stores

_VALUES = ", ".join(f"round({m}, 6) AS {m}" for m in report.MEASURES)
_SETTINGS = "temperature, model, top_p, few_shot, diverse, diverse_bad"


def settings_json(spark, sf):
    """The run configurations as the JSON a run writes beside its datasets."""
    n = F.col("n_prompts").cast("int")
    prompts = F.struct(F.create_map(F.lit("first"), F.array_repeat(F.lit("Write."), n)).alias("prompts")).alias("prompts")
    querier = F.struct("model", "temperature", "top_p", "presence_penalty").alias("querier")
    alone = F.to_json(F.struct(F.lit("Generator").alias("class"), prompts, querier))
    member = F.struct(F.lit("Generator").alias("class"), prompts, querier)
    chain = F.to_json(F.struct(F.lit("MultiConverter").alias("class"), F.array(member).alias("converters")))
    generator = F.when(F.col("generator_class") == "Generator", alone).otherwise(chain)
    text = F.concat(F.lit('{"class": "Pipeline", "generator": '), generator, F.lit("}"))
    return run_configs(spark, sf).select("task", "position", text.alias("settings"))


@query("experiment_table", f"WITH {EXPERIMENTS} SELECT task, position, {_VALUES}, {_SETTINGS} FROM experiments")
def experiment_table(spark, sf):
    configs = report.run_flags(stores.parse_settings(settings_json(spark, sf)))
    return rounded(report.experiment_table(metric_store(spark, sf), configs, real_store(spark, sf)))


@query("experiment_tsv", f"""WITH {EXPERIMENTS} SELECT task, position, round(coalesce(complexity, 1), 6) AS complexity, round(coalesce(conformity, 1), 6) AS conformity,
model, coalesce(top_p, 1) AS top_p, few_shot FROM experiments""")
def experiment_tsv(spark, sf):
    path = scratch_path(spark, "tsv")
    columns = ["task", "position", "complexity", "conformity", "model", "top_p", "few_shot"]
    stores.write_tsv(experiments(spark, sf).select(*columns), path)
    schema = "task string, position bigint, complexity double, conformity double, model string, top_p double, few_shot boolean"
    return rounded(stores.read_tsv(spark, path, schema))


@query("run_flags", f"""WITH {CONFIGS} SELECT task, position, n_prompts > 5 AS few_shot, generator_class <> 'Generator' AS diverse,
coalesce(presence_penalty, 0) > 0 AS diverse_bad FROM configs""")
def run_flags(spark, sf):
    flagged = report.run_flags(stores.parse_settings(settings_json(spark, sf)))
    return flagged.select("task", "position", "few_shot", "diverse", "diverse_bad")


_STANDARD = "NOT few_shot AND NOT diverse AND top_p = 1 AND NOT diverse_bad"


@query("run_filters", f"WITH {EXPERIMENTS} SELECT task, position, model, temperature FROM experiments WHERE {_STANDARD}")
def run_filters(spark, sf):
    return report.standard_runs(experiments(spark, sf)).select("task", "position", "model", "temperature")


_FAMILY = "CASE WHEN contains(model, 'turbo') OR contains(model, '003') THEN 'RLHF' WHEN contains(model, 'text-') THEN 'Instruction-Tuned' ELSE 'Vanilla' END"


@query("model_family", f"WITH {CONFIGS} SELECT task, position, model, {_FAMILY} AS family FROM configs")
def model_family(spark, sf):
    return run_configs(spark, sf).select("task", "position", "model", report.model_family().alias("family"))


_ALIGNED = "(contains(model, 'turbo') OR contains(model, '003'))"


@query("model_matchers", f"""WITH {CONFIGS} SELECT task, position, model, contains(model, 'text') AND NOT {_ALIGNED} AS tuned, NOT contains(model, 'text') AND NOT {_ALIGNED} AS vanilla,
{_ALIGNED} AS aligned, ends_with(model, '001') OR regexp_matches(model, '^ada') AS mixed,
(NOT contains(model, 'text') AND NOT {_ALIGNED}) OR (NOT regexp_matches(model, 'ada') AND NOT {_ALIGNED}) AS sticky FROM configs""")
def model_matchers(spark, sf):
    tests = {"tuned": ["text"], "vanilla": ["!text"], "aligned": ["rlhf"], "mixed": ["001$", "^ada"]}
    columns = [report.model_matches(m).alias(name) for name, m in tests.items()]
    sticky = report.model_matches(["!text", "ada"], sticky_negation=True).alias("sticky")
    return run_configs(spark, sf).select("task", "position", "model", *columns, sticky)


@query("sort_models", f"""WITH {EXPERIMENTS} SELECT model, temperature, task, position,
row_number() OVER (PARTITION BY task ORDER BY model = 'gpt-3.5-turbo', model, temperature, position) AS place FROM experiments""")
def sort_models(spark, sf):
    order = Window.partitionBy("task").orderBy(report.model_order(), "temperature", "position")
    place = F.row_number().over(order).cast("bigint")
    return experiments(spark, sf).select("model", "temperature", "task", "position", place.alias("place")).orderBy("task", "place")


_AXIS = " ".join(f"WHEN '{m}' THEN {i}" for m, i in report.MODEL_AXIS.items())


@query("model_ordinal", f"WITH {EXPERIMENTS} SELECT task, position, model, CASE model {_AXIS} END AS ordinal FROM experiments")
def model_ordinal(spark, sf):
    return experiments(spark, sf).select("task", "position", "model", report.model_ordinal().alias("ordinal"))


_NORMAL = f"""{EXPERIMENTS}, normal AS (SELECT * FROM experiments WHERE ({_STANDARD} AND NOT contains(model, 'real')) OR contains(model, 'real'))"""


def _normal(spark, sf):
    runs = experiments(spark, sf).fillna(1.0)
    return report.with_real(report.standard_runs(runs), runs)


_FILLED = _NORMAL.replace("FROM experiments WHERE", "FROM (SELECT * REPLACE (coalesce(conformity, 1) AS conformity, coalesce(top_p, 1) AS top_p) FROM experiments) WHERE")


@query("union_real", f"WITH {_FILLED} SELECT task, position, model, temperature, round(conformity, 6) AS conformity FROM normal")
def union_real(spark, sf):
    return rounded(_normal(spark, sf).select("task", "position", "model", "temperature", "conformity"))


_MEANS = ", ".join(f"round(avg({m}), 6) AS {m}" for m in report.MEASURES)


@query("measure_grouping_sets", f"""WITH {_FILLED} SELECT task AS dataset, model, temperature, CAST(grouping(task) AS INTEGER) AS overall, {_MEANS}
FROM normal GROUP BY GROUPING SETS ((model, temperature), (task, model, temperature))""")
def measure_grouping_sets(spark, sf):
    return rounded(report.measure_means(_normal(spark, sf).withColumnRenamed("task", "dataset")))


@query("trajectory_direction", f"""WITH {EXPERIMENTS}, m AS (SELECT task, model, temperature, avg(diversity) AS x, avg(faithfulness) AS y FROM experiments WHERE model <> 'real' GROUP BY 1, 2, 3),
s AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, row_number() OVER (PARTITION BY task, model ORDER BY temperature DESC) AS r FROM m
  WINDOW w AS (PARTITION BY task, model ORDER BY temperature))
SELECT task, model, round(dx / sqrt(dx * dx + dy * dy), 6) AS direction_x, round(dy / sqrt(dx * dx + dy * dy), 6) AS direction_y FROM s
WHERE r = 1 AND dx IS NOT NULL AND dx * dx + dy * dy > 0""")
def trajectory_direction(spark, sf):
    points = experiments(spark, sf).filter("model <> 'real'").groupBy("task", "model", "temperature").agg(
        F.avg("diversity").alias("diversity"), F.avg("faithfulness").alias("faithfulness")
    )
    return rounded(report.last_direction(points, ["task", "model"], "diversity", "faithfulness"))


_SCORED = f"{CONFIGS}, {METRICS}, y AS (SELECT task, position, max(value) FILTER (WHERE metric = 'finetune_temporal_fake_to_real.accuracy') AS y FROM store GROUP BY 1, 2)"


def _scored(spark, sf):
    y = metric_store(spark, sf).filter("metric = 'finetune_temporal_fake_to_real.accuracy'")
    return run_configs(spark, sf).join(y.select("task", "position", F.col("value").alias("y")), ["task", "position"])


_CHAIN = "[CASE WHEN position % 2 = 0 THEN 'rewrite' ELSE 'extend' END] || CASE WHEN position % 3 = 0 THEN ['prepend'] ELSE [] END"


def _chain():
    first = F.when(F.col("position") % 2 == 0, "rewrite").otherwise("extend")
    more = F.when(F.col("position") % 3 == 0, F.array(F.lit("prepend"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(first), more)


@query("score_by_generator", f"""WITH {_SCORED} SELECT model AS generator, round(sum(y), 6) AS total, count(y) AS n, round(avg(y), 6) AS mean FROM configs JOIN y USING (task, position) GROUP BY 1""")
def score_by_generator(spark, sf):
    return rounded(report.score_by(_scored(spark, sf).withColumnRenamed("model", "generator"), "generator"))


@query("score_by_converter", f"""WITH {_SCORED}, c AS (SELECT unnest({_CHAIN}) AS converter, y FROM configs JOIN y USING (task, position))
SELECT converter, round(sum(y), 6) AS total, count(y) AS n, round(avg(y), 6) AS mean FROM c GROUP BY 1""")
def score_by_converter(spark, sf):
    return rounded(report.score_by(_scored(spark, sf).withColumn("converter", F.explode(_chain())), "converter"))


@query("leaderboard", f"""WITH {_SCORED}, p AS (SELECT lang AS task, CAST(substr(source, 4) AS BIGINT) AS position, count(*) AS size FROM documents GROUP BY 1, 2),
g AS (SELECT model, row_number() OVER (ORDER BY min(position)) - 1 AS generator FROM configs GROUP BY 1),
d AS (SELECT task || '/' || dataset_id AS dataset_id, y, size, CAST(generator AS VARCHAR) AS generator, array_to_string({_CHAIN}, '>') AS converters, task || '/run' || CAST(position AS VARCHAR) AS location
  FROM configs JOIN y USING (task, position) JOIN p USING (task, position) JOIN g USING (model))
SELECT 0 AS rank, 'real' AS dataset_id, round((SELECT avg(value) FROM real_store WHERE metric = 'finetune_temporal_fake_to_real.accuracy'), 6) AS y,
  (SELECT count(*) FROM documents WHERE source IN ('src0', 'src1', 'src2', 'src3')) AS size, '-' AS generator, '-' AS converters, '-' AS location
UNION ALL SELECT row_number() OVER (ORDER BY round(y, 9) DESC, dataset_id), dataset_id, round(y, 6), size, generator, converters, location FROM d""")
def leaderboard(spark, sf):
    scored = _scored(spark, sf)
    generators = first_wins(scored.select("model", "position"), ["model"]).select("model", F.col("first_id").cast("string").alias("generator"))
    docs = table(spark, sf, "documents").groupBy(F.col("lang").alias("task"), F.col("source").alias("dataset_id")).agg(F.count(F.lit(1)).alias("size"))
    located = scored.join(docs, ["task", "dataset_id"]).join(generators, "model")
    root = F.concat(F.lit("sets/generated/"), "task", F.lit("/run"), F.col("position").cast("string"))
    prefix = report.common_prefix(located.withColumn("path", root), "path").select(F.length("prefix")).scalar()
    boards = located.select(
        F.concat_ws("/", "task", "dataset_id").alias("dataset_id"),
        F.round("y", 9).alias("y"),
        "size",
        "generator",
        F.concat_ws(">", _chain()).alias("converters"),
        F.substring(root, prefix + 1, F.length(root)).alias("location"),
    )
    dash = F.lit("-")
    score = real_store(spark, sf).filter("metric = 'finetune_temporal_fake_to_real.accuracy'").agg(F.avg("value")).scalar()
    own = real(spark, sf).agg(F.count(F.lit(1)).alias("size")).select(
        F.lit("real").alias("dataset_id"), score.alias("y"), "size", dash.alias("generator"), dash.alias("converters"), dash.alias("location")
    )
    return rounded(report.leaderboard(boards, own))


@query("leaderboard_metrics", f"""WITH {_SCORED}, n AS (SELECT DISTINCT metric FROM store),
g AS (SELECT model, row_number() OVER (ORDER BY min(position)) - 1 AS generator FROM configs GROUP BY 1),
c AS (SELECT task, dataset_id, position, unnest({_CHAIN}) AS member, generate_subscripts({_CHAIN}, 1) AS place FROM configs),
i AS (SELECT member, row_number() OVER (ORDER BY min(position * 65536 + place)) - 1 AS id FROM c GROUP BY 1),
h AS (SELECT task, dataset_id, string_agg(CAST(id AS VARCHAR), '>' ORDER BY place) AS converters FROM c JOIN i USING (member) GROUP BY 1, 2),
d AS (SELECT task, dataset_id, row_number() OVER (ORDER BY round(y, 9) DESC, task || '/' || dataset_id) AS rank, generator FROM configs JOIN y USING (task, position) JOIN g USING (model))
SELECT 0 AS rank, 'real' AS dataset_id, '-' AS generator, '-' AS converters, n.metric, round(coalesce(r.value, 0), 6) AS value
FROM n LEFT JOIN (SELECT metric, avg(value) AS value FROM real_store GROUP BY 1) r USING (metric)
UNION ALL SELECT rank, d.task || '/' || d.dataset_id, CAST(generator AS VARCHAR), converters, n.metric, round(coalesce(s.value, 0), 6)
FROM d JOIN h USING (task, dataset_id), n LEFT JOIN store s ON s.task = d.task AND s.dataset_id = d.dataset_id AND s.metric = n.metric""")
def leaderboard_metrics(spark, sf):
    """The leaderboard with converter numbers and all metrics, one row per metric."""
    scored, key = _scored(spark, sf), ["task", "dataset_id"]
    generators = first_wins(scored.select("model", "position"), ["model"]).select("model", F.col("first_id").cast("string").alias("generator"))
    chains = report.chain_ids(scored.withColumn("chain", _chain()), key)
    name = F.concat_ws("/", "task", "dataset_id").alias("dataset_id")
    boards = scored.join(generators, "model").join(chains, key).select(
        name, F.round("y", 9).alias("y"), "generator", F.concat_ws(">", F.col("ids").cast("array<string>")).alias("converters")
    )
    of_real = real_store(spark, sf).groupBy("metric").agg(F.avg("value").alias("value")).withColumn("dataset_id", F.lit("real"))
    own = of_real.filter("metric = 'finetune_temporal_fake_to_real.accuracy'").select(
        "dataset_id", F.col("value").alias("y"), F.lit("-").alias("generator"), F.lit("-").alias("converters")
    )
    every = metric_store(spark, sf).select(name, "metric", "value").unionByName(of_real)
    board = report.leaderboard(boards, own, every)
    return rounded(board.select("rank", "dataset_id", "generator", "converters", F.explode("metrics").alias("metric", "value")))


@query("evaluation_folder", f"WITH {EXPERIMENTS} SELECT task, position, {_VALUES}, {_SETTINGS} FROM experiments")
def evaluation_folder(spark, sf):
    """Settings, shards and real metrics written as a folder; the experiment table read back from it."""
    path = scratch_path(spark, "evaluations")
    stores.write_evaluations(settings_json(spark, sf), metric_store(spark, sf), real_store(spark, sf), path)
    settings, store, own = stores.read_evaluations(spark, path)
    return rounded(report.experiment_table(store, report.run_flags(stores.parse_settings(settings)), own))


@query("results_missing", f"""WITH {CONFIGS}, {METRICS} SELECT task, position FROM configs WHERE (task, position) NOT IN (SELECT (task, position) FROM store WHERE metric = 'mauve')
UNION ALL SELECT DISTINCT task, -1::BIGINT FROM configs WHERE task NOT IN (SELECT task FROM real_store WHERE value >= 0.9)""")
def results_missing(spark, sf):
    """Runs without the match, and tasks whose real set has no measure of 0.9 or more."""
    store = metric_store(spark, sf).filter("metric = 'mauve'")
    return metrics.results_missing(run_configs(spark, sf), store, real_store(spark, sf).filter("value >= 0.9"))


@query("common_prefix", """WITH p AS (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, url FROM pages),
e AS (SELECT *, unnest(range(1, length(url) + 1)) AS i FROM p),
c AS (SELECT scheme, host, i, count(*) AS k, count(DISTINCT substr(url, 1, i)) AS d, min(substr(url, 1, i)) AS pre FROM e GROUP BY GROUPING SETS ((scheme, i), (scheme, host, i))),
n AS (SELECT scheme, host, count(*) AS n FROM p GROUP BY GROUPING SETS ((scheme), (scheme, host))),
l AS (SELECT c.scheme, c.host, n.n, max(pre) FILTER (WHERE c.k = n.n AND d = 1) AS longest FROM c JOIN n ON c.scheme = n.scheme AND c.host IS NOT DISTINCT FROM n.host GROUP BY 1, 2, 3)
SELECT scheme, host, n, regexp_extract(coalesce(longest, ''), '^(.*/)', 1, 's') AS prefix FROM l""")
def common_prefix(spark, sf):
    urls = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), "url"
    )
    by_host = report.common_prefix(urls, "url", ["scheme", "host"])
    overall = report.common_prefix(urls, "url", ["scheme"]).withColumn("host", F.lit(None).cast("string"))
    return by_host.unionByName(overall)
