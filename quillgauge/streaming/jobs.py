"""Streaming token accounting and response ingestion.

Every job runs over the files present (``availableNow``) and writes Parquet under the given
folder; a batch's folder is overwritten when the batch is run again, so results count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, folder: str, schema: StructType, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """The files of a folder whose names fit the pattern, and those within folders whose names do."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{pattern}")


def run_available(stream: DataFrame, folder: str, mode: str, change: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Process what is there; every batch lands in its own folder with its number."""
    out = f"{folder}/rows"

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if change is None else change(batch)
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.parquet(out)


def latest(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of an update stream's rows those of the last batch per key."""
    values = [c for c in rows.columns if c not in key and c != "batch"]
    newest = rows.groupBy(*key).agg(F.max_by(F.struct(*values), "batch").alias("__row"))
    return newest.select(*key, "__row.*")


def token_use(
    usage: DataFrame, folder: str, window: str = "60 seconds", slide: str = "10 seconds", late: str = "10 minutes"
) -> DataFrame:
    """Tokens per model in sliding windows; later rows than the watermark allows are dropped."""
    used = (
        usage.withWatermark("ts", late)
        .groupBy(F.window("ts", window, slide), "model")
        .agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_requests"))
        .select(F.col("window.start").alias("window_start"), "model", "tokens", "n_requests")
    )
    return latest(run_available(used, folder, "update"), ["window_start", "model"])


def rolling_use(ts: np.ndarray, tokens: np.ndarray, width: int) -> np.ndarray:
    """Tokens of the ``width`` microseconds up to each time, all rows of that time included; times rise."""
    upto = np.concatenate([[0], np.cumsum(tokens)])
    return upto[np.searchsorted(ts, ts, "right")] - upto[np.searchsorted(ts, ts - width, "right")]


def token_budget(
    usage: DataFrame,
    folder: str,
    tokens_per_minute: int = 30_000,
    max_tokens: int = 1000,
    late: str = "10 minutes",
    slice_seconds: int = 600,
) -> DataFrame:
    """The batch ``token_budget`` on arriving rows (event_id, model, ts, tokens), exact for rows in any order within ``late``.

    State is kept per model and slice of time, with the rows of the slice and those of the minute
    before it, so a busy model is spread over tasks and a state is bounded by a slice. When the watermark has
    passed a slice nothing can change it any more: its rows come out and its state is gone. Rows later
    than the watermark allows are dropped; slices that the watermark has not passed stay in the state for the next run.
    """
    width, minute = slice_seconds * 1_000_000, 60_000_000
    own = F.floor(F.col("at") / width)
    timed = usage.withWatermark("ts", late).withColumn("at", F.unix_micros("ts"))
    # A row counts in its own slice and, without coming out again, in all that its minute reaches.
    reach = F.sequence(own, F.floor((F.col("at") + minute - 1) / width))
    spread = timed.withColumn("slice", F.explode(reach)).withColumn("echo", F.col("slice") > own)
    kept = ("at", "tokens", "event_id", "echo")

    def close(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        model, number = key
        held = [list(column) for column in state.get] if state.exists else [[] for _ in kept]
        if state.hasTimedOut:
            state.remove()
            at, tokens, ids, echo = (np.array(column) for column in held)
            order = np.argsort(at, kind="stable")
            used = rolling_use(at[order], tokens[order], minute)
            mine = ~echo[order].astype(bool)
            yield pd.DataFrame({"event_id": ids[order][mine], "model": model, "ts": at[order][mine], "tokens": tokens[order][mine], "used": used[mine]})
            return
        for frame in frames:
            for column, name in zip(held, kept, strict=True):
                column += frame[name].tolist()
        state.update(tuple(held))
        state.setTimeoutTimestamp(max((int(number) + 1) * slice_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield from ()

    done = spread.groupBy("model", "slice").applyInPandasWithState(
        close,
        "event_id bigint, model string, ts bigint, tokens bigint, used bigint",
        "at array<bigint>, tokens array<bigint>, event_id array<bigint>, echo array<boolean>",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    free = F.lit(tokens_per_minute) - F.least(F.col("used"), F.lit(tokens_per_minute))
    return run_available(done, folder, "append").drop("batch").withColumn("admitted", F.floor(free / max_tokens).cast("bigint"))


def ingest(responses: DataFrame, answers: Column, keep: Sequence[str], folder: str) -> DataFrame:
    """Parsed answers of arriving responses; no state is kept."""
    rows = responses.select(*keep, F.posexplode(answers).alias("answer_idx", "text"))
    return run_available(rows, folder, "append").drop("batch")


def outcome_counts(decoded: DataFrame, key: str, folder: str) -> DataFrame:
    """Running counts of response statuses."""
    counts = decoded.groupBy(key, "status").agg(F.count(F.lit(1)).alias("n"))
    return latest(run_available(counts, folder, "update"), [key, "status"])


def label_deficit(rows: DataFrame, quotas: DataFrame, folder: str) -> DataFrame:
    """Rows each label still lacks after the rows that have arrived."""
    counts = rows.groupBy("dataset_id", "label").agg(F.count(F.lit(1)).alias("have"))
    have = latest(run_available(counts, folder, "update"), ["dataset_id", "label"])
    out = quotas.join(have, ["dataset_id", "label"], "left").withColumn("have", F.coalesce("have", F.lit(0).cast("bigint")))
    return out.withColumn("deficit", F.greatest(F.col("wanted") - F.col("have"), F.lit(0)).cast("bigint"))
