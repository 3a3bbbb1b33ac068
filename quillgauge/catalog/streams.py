"""Streaming jobs; each must give what the batch query gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgauge.catalog.base import query, table
from quillgauge.catalog.requests import DEFICITS, STATUS, USAGE, quotas, raw_log
from quillgauge.functions import extract
from quillgauge.session import scratch_path
from quillgauge.streaming import jobs


def _stream(spark, sf, name: str):
    # A table is a file or a folder of files; a stream takes a single file only by a pattern.
    return jobs.file_stream(spark, sf, table(spark, sf, name).schema, f"{name}.[p]arquet")


@query("stream_token_use", """WITH e AS (SELECT event_type AS model, ts, CAST(floor(value * 100) AS BIGINT) AS tokens, epoch_us(ts) // 10000000 AS s FROM events),
w AS (SELECT model, tokens, unnest(range(s - 5, s + 1)) AS s FROM e)
SELECT make_timestamp(s * 10000000) AS window_start, model, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS n_requests FROM w GROUP BY 1, 2""")
def stream_token_use(spark, sf):
    usage = _stream(spark, sf, "events").select(
        F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).alias("tokens")
    )
    used = jobs.token_use(usage, scratch_path(spark, "stream"))
    return used.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stream_ingest", """WITH l AS (SELECT conv_id, turn, string_split(text, chr(10)) AS lines FROM conversations),
i AS (SELECT conv_id, turn, rtrim(regexp_replace(unnest(lines), '^[\\p{N}.: )]*', ''), ' ') AS text, unnest(range(len(lines))) AS i FROM l)
SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS INTEGER) AS answer_idx, text FROM i WHERE text <> ''""")
def stream_ingest(spark, sf):
    said = _stream(spark, sf, "conversations")
    answers = extract.numbered_answers("text", F.lit("stop"), only_numbered=False)
    return jobs.ingest(said, answers, ["conv_id", "turn"], scratch_path(spark, "stream"))


@query("stream_outcomes", f"WITH {STATUS} SELECT model, status, count(*) AS n FROM decoded GROUP BY 1, 2")
def stream_outcomes(spark, sf):
    decoded = extract.decode_responses(raw_log(_stream(spark, sf, "events")))
    return jobs.outcome_counts(decoded, "model", scratch_path(spark, "stream"))


@query("stream_deficit", f"WITH {DEFICITS.format(wanted=30)} SELECT * FROM deficits")
def stream_deficit(spark, sf):
    rows = _stream(spark, sf, "documents").select(F.col("source").alias("dataset_id"), F.col("lang").alias("label"))
    return jobs.label_deficit(rows, quotas(spark, sf, 30), scratch_path(spark, "stream"))


ARRIVALS = 5


def arriving(spark, sf) -> str:
    """The events in the order in which they arrive, up to five minutes after their time: a folder per arrival batch."""
    folder = scratch_path(spark, "arrivals")
    late = F.pmod(F.xxhash64("event_id"), F.lit(300))
    rows = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("model"), F.col("ts").cast("timestamp").alias("ts"), F.floor(F.col("value") * 100).alias("tokens"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + late).alias("arrival"),
    )
    cuts = rows.agg(F.percentile_approx("arrival", [i / ARRIVALS for i in range(1, ARRIVALS)])).first()[0]
    batch = sum(((F.col("arrival") > cut).cast("int") for cut in cuts or []), F.lit(0))
    # One after the other, because a file stream takes files in the order of their times.
    for i in range(ARRIVALS):
        rows.filter(batch == i).drop("arrival").coalesce(1).write.mode("append").parquet(folder)
    return folder


@query("stream_token_budget", f"""WITH {USAGE}, w AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY model ORDER BY ts RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS BIGINT) AS used FROM usage)
SELECT event_id, model, ts, tokens, used, (10000 - least(used, 10000)) // 500 AS admitted FROM w
-- the slices that the watermark has passed
WHERE (ts // 3600000000 + 1) * 3600000 < (SELECT max(ts) // 1000 FROM usage) - 600000""")
def stream_token_budget(spark, sf):
    """Rolling token use over batches that hold late rows, for all slices of an hour that are closed."""
    schema = "event_id bigint, model string, ts timestamp, tokens bigint"
    usage = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(arriving(spark, sf))
    return jobs.token_budget(usage, scratch_path(spark, "stream"), 10_000, 500, "10 minutes", 3600)
