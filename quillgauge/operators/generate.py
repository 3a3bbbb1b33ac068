"""Making datasets as table steps: quotas, request plans, prompts, recorded responses, ingestion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.functions import extract
from quillgauge.functions import prompts as P
from quillgauge.operators.ordering import number_by_id, number_rows
from quillgauge.operators.sampling import draw_indices, pick_number
from quillgauge.session import stored

# Ways to get answers out of a response, by name: (text, finish_reason) to an array.
PARSERS: dict[str, Callable[..., Column]] = {
    "plain": lambda text, _finish, **options: F.array_compact(F.array(extract.plain_answer(text, **options))),
    "numbered": extract.numbered_answers,
    "paired": extract.paired_answers,
    "classification": lambda text, _finish, classes: F.array(extract.most_mentioned(text, classes)),
}


def label_deficit(df: DataFrame, quotas: DataFrame, group: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Rows each label still lacks: quotas has (group, label, wanted)."""
    return _lacking(quotas.withColumn("have", F.lit(0).cast("bigint")), df, group)


def _lacking(known: DataFrame, new: DataFrame, group: Sequence[str]) -> DataFrame:
    """``known`` has (group, label, wanted, have); the rows of ``new`` are added to what it has."""
    more = new.groupBy(*group, "label").agg(F.count(F.lit(1)).alias("__more"))
    have = F.col("have") + F.coalesce("__more", F.lit(0))
    out = known.join(more, [*group, "label"], "left").withColumn("have", have).drop("__more")
    return out.withColumn("deficit", F.greatest(F.col("wanted") - F.col("have"), F.lit(0)).cast("bigint"))


def request_plan(deficits: DataFrame, per_request: int = 20, retry: bool = False, block: int = 10_000) -> DataFrame:
    """One row per request; the last of a label asks for the remainder, or in full on a retry.

    Large deficits are cut into blocks first, so that no task makes all requests of a label.
    """
    requests = F.ceil(F.col("deficit") / per_request)
    spread = int(deficits.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (
        deficits.filter(F.col("deficit") > 0)
        .withColumn("__n", requests)
        .withColumn("__from", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__n") - 1, F.lit(block).cast("bigint"))))
        .repartition(spread, *deficits.columns, "__from")
    )
    single = blocks.withColumn(
        "request", F.explode(F.sequence("__from", F.least(F.col("__from") + block, F.col("__n")) - 1))
    )
    rest = F.col("deficit") - F.col("request") * per_request
    size = F.lit(per_request).cast("bigint") if retry else F.least(F.lit(per_request).cast("bigint"), rest)
    return single.withColumn("size", size).drop("__n", "__from")


def merge_prompt_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Per label the prompts of the first set, then those of the second: (label, prompt_idx, template)."""
    sizes = first.groupBy("label").agg(F.count(F.lit(1)).alias("__n"))
    moved = second.join(sizes, "label", "left").withColumn(
        "prompt_idx", F.col("prompt_idx") + F.coalesce("__n", F.lit(0))
    )
    return first.unionByName(moved.select(*first.columns))


def prompt_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("label").agg(F.count(F.lit(1)).alias("n_prompts"))


def pick_prompts(requests: DataFrame, prompts: DataFrame, request_id: str = "request_id", seed: str = "pick") -> DataFrame:
    """A random prompt of the request's label; a request without label draws the label first.

    Labels are numbered in slices of their first character, their count is a subquery.
    """
    labels = prompts.select("label").distinct()
    codes = number_rows(labels, [], ["label"], F.ascii("label").cast("bigint"), name="__code")
    codes = codes.select("label", (F.col("__code") - 1).alias("__code"))
    n_labels = labels.agg(F.count(F.lit(1)).alias("n")).scalar()
    code = pick_number(request_id, size=n_labels, seed=f"{seed}-label")
    labelled = (
        requests.withColumn("__code", code)
        .join(codes.withColumnRenamed("label", "__label"), "__code")
        .withColumn("label", F.coalesce("label", "__label"))
        .drop("__code", "__label")
    )
    sized = labelled.join(prompt_counts(prompts), "label")
    picked = sized.withColumn("prompt_idx", pick_number(request_id, size=F.col("n_prompts"), seed=seed))
    return picked.drop("n_prompts").join(prompts, ["label", "prompt_idx"])


def round_robin_prompts(requests: DataFrame, prompts: DataFrame, request_id: str = "request_id") -> DataFrame:
    """The prompts of a label in turn: request number modulo prompt count."""
    numbered = number_by_id(requests, ["label"], row_id=request_id).join(prompt_counts(prompts), "label")
    turn = numbered.withColumn("prompt_idx", F.pmod(F.col("position") - 1, F.col("n_prompts")))
    return turn.drop("position", "n_prompts").join(prompts, ["label", "prompt_idx"])


def fewshot_sample(
    examples: DataFrame, shots: int = 3, prompts_per_label: int = 500, seed: str = "shots", group: Sequence[str] = ("label",)
) -> DataFrame:
    """For each prompt of a label its shots, drawn without replacement, in random order."""
    keys = list(group)
    numbered = number_by_id(examples, keys).withColumn("index", F.col("position") - 1).drop("position")
    sizes = examples.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    draws = draw_indices(sizes, keys, "__n", shots, prompts_per_label, seed)
    return draws.join(numbered, [*keys, "index"]).withColumnRenamed("repetition", "prompt_idx").drop("__n", "index")


def numbered_block(
    rows: DataFrame, group: Sequence[str], position: str, text: str = "text", other: str | None = None, out: str = "block"
) -> DataFrame:
    """Concatenate the few rows of each group as ``1. text`` lines, pairs as ``1a.``/``1b.``."""
    number = F.col(position).cast("string")
    if other is None:
        line = F.concat(number, F.lit(". "), F.col(text), F.lit("\n"))
    else:
        line = F.concat(number, F.lit("a. "), F.col(text), F.lit("\n "), number, F.lit("b. "), F.col(other), F.lit("\n"))
    lines = F.array_sort(F.collect_list(F.struct(F.col(position).alias("j"), line.alias("line"))))
    return rows.groupBy(*group).agg(F.concat_ws("", F.transform(lines, lambda e: e["line"])).alias(out))


def complete_from_log(requests: DataFrame, log: DataFrame, key: str = "request_id") -> DataFrame:
    """Answer requests from recorded responses, by id; requests without one stay, unanswered."""
    return requests.join(log, key, "left")


def complete_with(
    requests: DataFrame, complete: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str
) -> DataFrame:
    """Answer requests by a user's batch function; this package holds no network code."""
    return requests.mapInPandas(complete, schema)


def ingest(responses: DataFrame, answers: Column, keep: Sequence[str]) -> DataFrame:
    """Answers as rows: label and ids come from the request; answers number from 0."""
    return responses.select(*keep, F.posexplode(answers).alias("answer_idx", "text"))


def request_outcomes(decoded: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Counts of successes, API errors and undecodable responses, and the share done."""
    return decoded.groupBy(*group).agg(
        F.count_if(F.col("status") == "ok").alias("succeeded"),
        F.count_if(F.col("status") == "api_error").alias("api_errors"),
        F.count_if(F.col("status") == "parse_error").alias("parse_errors"),
        (F.count_if(F.col("status") == "ok") / F.count(F.lit(1))).alias("share_done"),
    )


def top_up(
    df: DataFrame,
    quotas: DataFrame,
    answer: Callable[[DataFrame, int], DataFrame],
    per_request: int = 20,
    retries: int = 5,
    group: Sequence[str] = ("dataset_id",),
) -> tuple[DataFrame, list[int]]:
    """Ask for what is missing, append what comes back, and retry while labels lack rows.

    ``answer(plan, round)`` returns rows shaped like ``df``. Each round's new rows are written out
    and only they are counted again. Returns the rows and the total deficit before every round.
    """
    deficits_seen: list[int] = []
    deficits = stored(label_deficit(df, quotas, group), "deficits")
    for turn in range(retries + 1):
        missing = deficits.agg(F.sum("deficit")).first()[0] or 0
        deficits_seen.append(int(missing))
        if missing == 0:
            break
        plan = request_plan(deficits, per_request, retry=turn > 0)
        got = stored(answer(plan, turn), "answers")
        df = df.unionByName(got, allowMissingColumns=True)
        deficits = stored(_lacking(deficits, got, group), "deficits")
    return df, deficits_seen


def token_budget(
    usage: DataFrame,
    tokens_per_minute: int = 30_000,
    max_tokens: int = 1000,
    group: Sequence[str] = ("model",),
    slice_seconds: int = 600,
) -> DataFrame:
    """Tokens used in the 60 s before each completion, and the requests that may start after it.

    ``usage`` has the group, ``ts`` (microseconds) and ``tokens``. Time is cut into slices; every
    completion is repeated in each later slice that its minute reaches, so the window of a busy
    model is spread over many tasks and still exact, also for slices shorter than a minute.
    """
    minute, width = 60_000_000, slice_seconds * 1_000_000
    own = F.floor(F.col("ts") / width)
    spread = usage.withColumn("__slice", own).withColumn("__echo", F.lit(False))
    echo = (
        usage.withColumn("__slice", F.explode(F.sequence(own + 1, own + -(-60 // slice_seconds))))
        .withColumn("__echo", F.lit(True))
        .filter(F.col("__slice") * width - F.col("ts") < minute)
    )
    w = Window.partitionBy(*group, "__slice").orderBy("ts").rangeBetween(-(minute - 1), 0)
    used = F.sum("tokens").over(w)
    return (
        spread.unionByName(echo)
        .withColumn("used", used)
        .filter(~F.col("__echo"))
        .withColumn(
            "admitted",
            F.floor((tokens_per_minute - F.least(F.col("used"), F.lit(tokens_per_minute))) / max_tokens).cast("bigint"),
        )
        .drop("__slice", "__echo")
    )


def chat_prompts(requests: DataFrame, template: str = "template", args: str = "args") -> DataFrame:
    """Rendered prompt and its message list."""
    return requests.withColumn("prompt", P.render(template, args)).withColumn("messages", P.chat_from_text("prompt"))
