"""Query registry and the binding of the driver tables to the data model.

``documents`` are labelled datasets (source = dataset, lang = label); the sources src0 to src3
form the real set, the others are generated ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.operators import report
from quillgauge.session import spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

REAL_SOURCES = ("src0", "src1", "src2", "src3")
MODELS = ("ada", "babbage", "davinci", "text-ada-001", "text-davinci-001", "text-davinci-003", "gpt-3.5-turbo")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


# Tables with long texts and the id their rows are dealt out by when they come in few files.
_TEXT_TABLES = {"documents": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"]}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    return spread(df, *_TEXT_TABLES[name]) if name in _TEXT_TABLES else df


def datasets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("source").alias("dataset_id"), F.col("doc_id").alias("row_id"), "text", F.col("lang").alias("label")
    )


def generated(spark: SparkSession, sf: str) -> DataFrame:
    return datasets(spark, sf).filter(~F.col("dataset_id").isin(*REAL_SOURCES))


def real(spark: SparkSession, sf: str) -> DataFrame:
    return datasets(spark, sf).filter(F.col("dataset_id").isin(*REAL_SOURCES)).withColumn("dataset_id", F.lit("real"))


# The same bindings for the SQL side.
DS = "ds AS (SELECT source AS dataset_id, doc_id AS row_id, text, lang AS label FROM documents)"
_REAL_LIST = ", ".join(f"'{s}'" for s in REAL_SOURCES)
GEN = f"gen AS (SELECT source AS dataset_id, doc_id AS row_id, text, lang AS label FROM documents WHERE source NOT IN ({_REAL_LIST}))"
REAL = f"real_set AS (SELECT 'real' AS dataset_id, doc_id AS row_id, text, lang AS label FROM documents WHERE source IN ({_REAL_LIST}))"


def md5_sql(*parts: str, seed: str) -> str:
    cast = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"md5(concat_ws('|', {cast}, '{seed}'))"


def key_number_sql(key: str, digits: int = 8) -> str:
    return f"CAST('0x' || substr({key}, 1, {digits}) AS BIGINT)"


TOKENS_SQL = "string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' ')"
WORDS_SQL = "list_filter(string_split(regexp_replace(lower(text), '[^a-zA-Z ]', '', 'g'), ' '), lambda w: w <> '')"


def source_number(column: str = "dataset_id") -> Column:
    return F.substring(F.col(column), 4, 10).cast("bigint")


def run_configs(spark: SparkSession, sf: str) -> DataFrame:
    """A run per (language, source): model, temperature and settings follow from the source number."""
    n = F.col("position")
    runs = table(spark, sf, "documents").select(F.col("lang").alias("task"), F.col("source").alias("dataset_id")).distinct()
    models = F.array(*[F.lit(m) for m in MODELS])
    return runs.withColumn("position", source_number()).select(
        "*",
        F.element_at(models, (n % len(MODELS) + 1).cast("int")).alias("model"),
        ((n % 3 * 3 + 7) / 10).alias("temperature"),
        F.when(n % 9 == 4, 0.9).when(n % 9 == 5, None).otherwise(1.0).alias("top_p"),
        F.when(n % 11 == 7, 0.5).alias("presence_penalty"),
        F.when(n % 6 == 5, 500).otherwise(1).cast("bigint").alias("n_prompts"),
        F.when(n % 10 == 9, "MultiConverter").otherwise("Generator").alias("generator_class"),
    )


_MODEL_SQL = "[" + ", ".join(f"'{m}'" for m in MODELS) + "]"
CONFIGS = f"""
runs0 AS (SELECT DISTINCT lang AS task, source AS dataset_id, CAST(substr(source, 4) AS BIGINT) AS position FROM documents),
configs AS (
  SELECT *, {_MODEL_SQL}[position % {len(MODELS)} + 1] AS model,
    CAST(position % 3 * 3 + 7 AS DOUBLE) / 10 AS temperature,
    CASE WHEN position % 9 = 4 THEN 0.9::DOUBLE WHEN position % 9 = 5 THEN NULL ELSE 1.0::DOUBLE END AS top_p,
    CASE WHEN position % 11 = 7 THEN 0.5::DOUBLE END AS presence_penalty,
    CASE WHEN position % 6 = 5 THEN 500::BIGINT ELSE 1::BIGINT END AS n_prompts,
    CASE WHEN position % 10 = 9 THEN 'MultiConverter' ELSE 'Generator' END AS generator_class
  FROM runs0)"""

# Cheap text shares that stand for the stored metrics of a run.
_STAND_INS = {
    "finetune_temporal_fake_to_fake.accuracy": "text LIKE '%the%'",
    "average_distinctness_spacy.1": "text LIKE '%un%'",
    "finetune_temporal_fake_to_real.accuracy": "text LIKE '%, %'",
    "finetune_temporal_real_to_fake.accuracy": "text LIKE '%on%'",
    "mauve": "text LIKE '%and%'",
}


def metric_store(spark: SparkSession, sf: str) -> DataFrame:
    """(task, dataset_id, position, metric, value): five shares per run; mauve lacks for some runs."""
    docs = table(spark, sf, "documents").select(F.col("lang").alias("task"), F.col("source").alias("dataset_id"), "text")
    wide = docs.groupBy("task", "dataset_id").agg(
        *[F.avg(F.expr(test).cast("double")).alias(name) for name, test in _STAND_INS.items()]
    )
    long = wide.select(
        "task", "dataset_id", F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"`{n}`").alias("value")) for n in _STAND_INS]))
    )
    out = long.withColumn("position", source_number())
    return out.filter((F.col("metric") != "mauve") | (F.col("position") % 4 != 1)).select(
        "task", "dataset_id", "position", "metric", "value"
    )


METRICS = f"""
wide_metrics AS (
  SELECT lang AS task, source AS dataset_id, CAST(substr(source, 4) AS BIGINT) AS position,
    {", ".join(f'avg(CAST({test} AS INTEGER)) AS "{name}"' for name, test in _STAND_INS.items())}
  FROM documents GROUP BY 1, 2, 3),
store AS (
  {" UNION ALL ".join(f"SELECT task, dataset_id, position, '{n}' AS metric, {chr(34)}{n}{chr(34)} AS value FROM wide_metrics" + (" WHERE position % 4 <> 1" if n == "mauve" else "") for n in _STAND_INS)}),
real_store AS (
  SELECT task, metric, avg(value) AS value FROM store WHERE dataset_id IN ({_REAL_LIST}) GROUP BY 1, 2)"""


def real_store(spark: SparkSession, sf: str) -> DataFrame:
    store = metric_store(spark, sf)
    return store.filter(F.col("dataset_id").isin(*REAL_SOURCES)).groupBy("task", "metric").agg(F.avg("value").alias("value"))


def experiments(spark: SparkSession, sf: str) -> DataFrame:
    return report.experiment_table(metric_store(spark, sf), report.run_flags(run_configs(spark, sf)), real_store(spark, sf))


_MEASURE_SQL = ", ".join(
    f"{'1 - ' if m == 'complexity' else ''}max(value) FILTER (WHERE metric = '{n}') AS {m}" for m, n in report.MEASURES.items()
)
EXPERIMENTS = f"""{CONFIGS}, {METRICS},
experiments AS (
  SELECT m.task, m.position, m.complexity, m.diversity, m.performance, m.faithfulness, m.conformity,
    c.temperature, c.model, c.top_p, c.n_prompts > 5 AS few_shot, c.generator_class <> 'Generator' AS diverse,
    coalesce(c.presence_penalty, 0) > 0 AS diverse_bad
  FROM (SELECT task, position, {_MEASURE_SQL} FROM store GROUP BY 1, 2) m JOIN configs c USING (task, position)
  UNION ALL
  SELECT task, -1, complexity, diversity, performance, faithfulness, conformity, 1.0, 'real', 1.0, false, false, false
  FROM (SELECT task, {_MEASURE_SQL} FROM real_store GROUP BY 1))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison across engines."""
    return df.select(
        *[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
