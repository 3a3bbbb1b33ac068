"""Stage chains from stored settings: nested JSON with a ``class`` in every object, read by a registry.

``{"class": "Chain", "stages": [...]}`` holds stages in order and may itself be a stage; every other class is
a stage with its arguments. Unknown classes and arguments are refused before anything runs. The key of a
stage is the hash of its settings with sorted keys, the same that ``stage_key`` finds in a table.
"""

from __future__ import annotations

import hashlib
import inspect
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions import extract, text
from quillgauge.functions.keys import key_id
from quillgauge.operators import generate, rewrite, rows, sampling
from quillgauge.plans.stages import Stage

REGISTRY: dict[str, Callable[..., Stage]] = {}


def stage(build: Callable[..., Stage]) -> Callable[..., Stage]:
    """Make a builder known under its name."""
    REGISTRY[build.__name__] = build
    return build


@stage
def Normalise(min_length: int = 2) -> Stage:
    return lambda df: rows.load_normalise(df, min_length)


@stage
def Clean() -> Stage:
    return lambda df: df.withColumn("text", text.clean_text("text"))


@stage
def Sample(probability: float, seed: str = "42") -> Stage:
    return lambda df: sampling.bernoulli(df, probability, seed)


@stage
def FirstRows(n: int) -> Stage:
    return lambda df: sampling.first_n(df, n)


@stage
def Generator(parser: str = "numbered", reason: str = "stop", **options) -> Stage:
    """The answers in recorded responses (dataset_id, row_id, text, label) as rows, by a parser of ``generate.PARSERS``.

    Answers are numbered within their response; ``row_id`` becomes a hash of both.
    """
    answers: Column = generate.PARSERS[parser](F.col("text"), F.lit(reason), **options)

    def run(df: DataFrame) -> DataFrame:
        said = generate.ingest(df, answers, ["dataset_id", F.col("row_id").alias("request"), "label"])
        return said.select("dataset_id", key_id("request", "answer_idx", seed="answer").alias("row_id"), "text", "label")

    return run


@stage
def Rewrite(probability: float = 1.0, seed: str = "rewrite", prefix: str = "") -> Stage:
    """Chosen rows with their quotes taken off and a prefix put before them; the others stay as they are."""

    def run(df: DataFrame) -> DataFrame:
        said = extract.plain_answer("text")
        new = F.concat(F.lit(prefix), F.coalesce(said, F.col("text")))
        return rewrite.mark_chosen(df, probability, seed).withColumn("text", F.when(F.col("chosen"), new).otherwise(F.col("text"))).drop("chosen")

    return run


def key(settings: dict) -> str:
    """Identity of a stage, as ``stages.stage_key`` has it."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def _flat(settings: dict, where: str) -> Iterator[dict]:
    if not isinstance(settings, dict) or not isinstance(settings.get("class"), str):
        raise ValueError(f"{where}: an object with a class is needed")
    if settings["class"] != "Chain":
        yield settings
        return
    if set(settings) != {"class", "stages"} or not isinstance(settings["stages"], list):
        raise ValueError(f"{where}: a Chain has stages and nothing else")
    for i, inner in enumerate(settings["stages"]):
        yield from _flat(inner, f"{where}.stages[{i}]")


def read_chain(settings: str) -> list[tuple[str, Stage]]:
    """(key, stage) of every stage of a settings text, in order, for ``stages.run_stored`` or ``run_grid``."""
    out = []
    for own in _flat(json.loads(settings), "settings"):
        build = REGISTRY.get(own["class"])
        if build is None:
            raise ValueError(f"unknown class {own['class']!r}; known are {', '.join(sorted(REGISTRY))}")
        given = {k: v for k, v in own.items() if k != "class"}
        try:
            inspect.signature(build).bind(**given)
        except TypeError as e:
            raise ValueError(f"{own['class']}: {e}") from e
        out.append((key(own), build(**given)))
    return out
