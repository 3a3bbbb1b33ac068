"""Rewriting a dataset through one or more levels of prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import prompts as P
from quillgauge.functions.keys import key_below, key_id, order_key
from quillgauge.operators.generate import numbered_block, prompt_counts
from quillgauge.operators.ordering import number_by_hash, number_by_id
from quillgauge.operators.sampling import pick_number


def mark_chosen(df: DataFrame, probability: float = 1.0, seed: str = "rewrite") -> DataFrame:
    return df.withColumn("chosen", key_below(order_key("row_id", seed=seed), probability))


def numbered_chunks(
    df: DataFrame, size: int = 20, shuffle_seed: str | None = None, group: tuple[str, ...] = ("dataset_id", "label")
) -> DataFrame:
    """Groups of ``size`` rows per label as one numbered text; size 1 keeps the raw text.

    The chunk number and the place in it come from row numbers; a chunk has at most ``size`` rows.
    """
    keys = list(group)
    if shuffle_seed is None:
        placed = number_by_id(df, keys)
    else:
        placed = number_by_hash(df, keys, seed=shuffle_seed)
    placed = placed.withColumn("chunk", F.floor((F.col("position") - 1) / size)).withColumn(
        "place", F.pmod(F.col("position") - 1, F.lit(size)) + 1
    )
    if size == 1:
        return placed.select(*keys, "chunk", F.col("text").alias("block"))
    return numbered_block(placed, [*keys, "chunk"], "place")


def run_level(
    previous: DataFrame,
    prompts: DataFrame,
    log: DataFrame,
    key: list[str],
    answer: str = "answer",
    messages: str | None = None,
    seed: str = "level",
) -> DataFrame:
    """One level: prompts built from the previous answers, joined with their recorded responses.

    ``prompts`` holds (label, prompt_idx, template) with the slot ``{{answer}}``; each request draws
    one of its label's. With ``messages`` the prompt continues that chat instead: messages so far,
    the answer, the new prompt. A request without a recorded response stays, with a null answer, and
    so does one whose label has no prompt, with null messages.
    """
    sized = previous.join(prompt_counts(prompts), "label", "left")
    drawn = sized.withColumn("prompt_idx", pick_number(*key, size=F.col("n_prompts"), seed=seed)).drop("n_prompts")
    named = drawn.join(prompts, ["label", "prompt_idx"], "left").drop("prompt_idx")
    has_prompt = F.col("template").isNotNull()
    if messages is None:
        text = P.render("template", F.create_map(F.lit("answer"), F.col(answer)))
        asked = named.withColumn("messages", F.when(has_prompt, P.chat_from_text(text)))
    else:
        reply = P.message(answer, F.lit("assistant"))
        asked = named.withColumn("messages", F.when(has_prompt, P.extend_chat(messages, reply, "template")))
    return asked.drop("template", answer).join(log, key, "left")


def merge(
    df: DataFrame,
    requests: DataFrame,
    responses: DataFrame,
    answers: Column,
    extend: bool = False,
    prepend: bool = False,
    row_ids: bool = False,
) -> DataFrame:
    """The rewritten dataset: untouched rows plus the parsed answers, marked by ``origin``.

    ``extend`` keeps all originals as well, so untouched rows then appear twice. ``prepend`` puts
    the original prefix before each answer. ``requests`` has (dataset, label, chunk, block). With ``row_ids``
    the result has a ``row_id`` and can be rewritten again: untouched rows keep theirs, an answer's is made of
    its chunk and place, that of a kept original of its own.
    """
    keys = ["dataset_id", "label", "chunk"]
    parsed = responses.select(*keys, F.posexplode(answers).alias("place", "text")).filter(F.length("text") > 0)
    if prepend:
        parsed = parsed.join(requests, keys).withColumn("text", F.concat("block", "text"))

    def rows(part: DataFrame, origin: str, row_id: Column) -> DataFrame:
        number = [row_id.cast("bigint").alias("row_id")] if row_ids else []
        return part.select("dataset_id", "label", *number, "text", F.lit(origin).alias("origin"))

    own = F.col("row_id")
    out = rows(df.filter(~F.col("chosen")), "unchosen", own).unionByName(rows(parsed, "answer", key_id(*keys, "place", seed="answer")))
    return out.unionByName(rows(df, "original", key_id("row_id", seed="original"))) if extend else out
