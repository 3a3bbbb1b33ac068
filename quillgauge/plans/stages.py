"""Stage chains: composition, stored outputs, shared prefixes, grids, identity."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def run_chain(df: DataFrame, stages: Sequence[Stage], start: int = 0, end: int | None = None) -> DataFrame:
    """Apply the stages from ``start`` up to ``end``."""
    for stage in stages[start:end]:
        df = df.transform(stage)
    return df


def _finished(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    marker = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def stage_path(folder: str, keys: Sequence[str]) -> str:
    """Where the output of the last of these stages is kept."""
    prefix = hashlib.sha256(json.dumps(list(keys)).encode()).hexdigest()
    return f"{folder}/stage={len(keys) - 1}/key={prefix}"


def run_stored(
    df: DataFrame, stages: Sequence[Stage], folder: str, resume: bool = True, keys: Sequence[str] | None = None
) -> tuple[DataFrame, list[int]]:
    """Run a chain and store each stage's output; finished outputs are read, not made again.

    ``keys`` identify the stages, by their settings for instance. An output is kept under the keys
    of all stages up to it, so a changed stage and all behind it run anew; without keys a stage is
    known by its place alone. Returns the last output and the numbers of the stages that ran.
    """
    spark, ran = df.sparkSession, []
    keys = list(keys) if keys is not None else [""] * len(stages)
    for i, stage in enumerate(stages):
        path = stage_path(folder, keys[: i + 1])
        if not (resume and _finished(spark, path)):
            df.transform(stage).write.mode("overwrite").parquet(path)
            ran.append(i)
        df = spark.read.parquet(path)
    return df, ran


def stage_key(settings: Column | str) -> Column:
    """Identity of a stage: its settings JSON with sorted keys at every depth, hashed."""
    raw = F.col(settings) if isinstance(settings, str) else settings
    return F.sha2(F.to_json(F.parse_json(raw)), 256)


def longest_prefix_match(runs: DataFrame, run_id: str = "run", chain: str = "chain") -> DataFrame:
    """For each run the longest stage prefix an earlier run has made, and the first run that made it.

    Every run lists its prefixes, each prefix remembers the first run that has it, and the two
    meet in an equi-join on the prefix. Runs that share nothing with an earlier one are left out.
    """
    lengths = F.sequence(F.lit(1), F.size(chain))
    prefixes = runs.filter(F.size(chain) > 0).select(run_id, F.explode(lengths).alias("shared"), chain).select(
        run_id, F.col("shared").cast("bigint").alias("shared"), F.slice(chain, 1, F.col("shared")).alias("prefix")
    )
    makers = prefixes.groupBy("prefix").agg(F.min(run_id).alias("source"))
    return (
        prefixes.join(makers, "prefix")
        .filter(F.col("source") < F.col(run_id))
        .groupBy(run_id)
        .agg(F.max_by("source", "shared").alias("source"), F.max("shared").alias("shared"))
    )


def run_grid(
    df: DataFrame, chains: Mapping[str, Sequence[tuple[str, Stage]]], folder: str, source: str = "input", side_by_side: int = 4
) -> tuple[DataFrame, dict[str, list[int]]]:
    """Run many chains of (key, stage) on one input; a prefix that chains share is run once.

    ``source`` names the input, and equal keys must mean equal stages. Outputs are kept under
    their prefix, so a grid that was cut short, or has grown, runs only what is missing. A stage
    starts when the one before it is done, and up to ``side_by_side`` stages of different branches run at the same
    time, each in a scheduler pool of its own name. A stage that fails ends the runs that need it and no others: those are
    finished and in the manifest before ``GridError`` names the failed ones.

    Returns the manifest, which is also written to ``folder/manifest``, as (position, entry), and the numbers of
    the stages that ran by run. An entry lists the outputs of a run from its first stage on.
    """
    spark = df.sparkSession
    prefixes: dict[str, list[str]] = {}
    nodes: dict[str, tuple[str | None, Stage, str, int]] = {}
    for run, chain in chains.items():
        keys = [json.dumps([source, key]) if i == 0 else key for i, (key, _) in enumerate(chain)]
        prefixes[run] = [stage_path(folder, keys[: i + 1]) for i in range(len(keys))]
        for i, path in enumerate(prefixes[run]):
            nodes.setdefault(path, (prefixes[run][i - 1] if i else None, chain[i][1], run, i))
    done: dict[str, Future] = {}

    def work(path: str) -> bool:
        before, stage, _, number = nodes[path]
        if before is not None:
            done[before].result()
        if _finished(spark, path):
            return False
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"stage-{number}-{path[-8:]}")
        given = df if before is None else spark.read.parquet(before)
        given.transform(stage).write.mode("overwrite").parquet(path)
        return True

    # Shorter prefixes come first, so what a waiting stage waits for has always started.
    with ThreadPoolExecutor(max(1, side_by_side)) as pool:
        for path in sorted(nodes, key=lambda p: nodes[p][3]):
            done[path] = pool.submit(inheritable_thread_target(spark)(work), path)
    failed = {run: next(e for e in map(Future.exception, map(done.get, paths)) if e) for run, paths in prefixes.items() if any(done[p].exception() for p in paths)}
    ran: dict[str, list[int]] = {run: [] for run in chains}
    for path, (_, _, run, number) in nodes.items():
        if done[path].exception() is None and done[path].result():
            ran[run].append(number)
    entries = [(i, json.dumps({"settings": run, "datasets": prefixes[run]})) for i, run in enumerate(chains) if run not in failed]
    manifest = spark.createDataFrame(entries, "position bigint, entry string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest")
    if failed:
        raise GridError(failed)
    return spark.read.parquet(f"{folder}/manifest"), ran


class GridError(RuntimeError):
    """Runs of a grid that failed, with what failed in them, by name."""

    def __init__(self, failed: dict[str, BaseException]):
        super().__init__(f"failed runs: {', '.join(sorted(failed))}")
        self.failed = failed


def converter_chains(levels: Sequence[Column], skip_levels: bool = True) -> Column:
    """All chains over array columns of converters, one per level.

    A chain takes at most one converter per level, may skip earlier levels, and ends with one of
    the last level. No levels, or no full chain, give the empty chain alone.
    """
    empty = F.array(F.array().cast("array<string>"))

    def extended(chains: Column, level: Column) -> Column:
        return F.flatten(F.transform(chains, lambda head: F.transform(level, lambda c: F.concat(head, F.array(c)))))

    heads, ends = empty, None
    for level in levels:
        ends = extended(heads, level)
        heads = F.concat(heads, ends)
    if ends is None:
        return empty
    if not skip_levels:
        ends = F.filter(ends, lambda chain: F.size(chain) == len(levels))
    return F.when(F.size(ends) > 0, ends).otherwise(empty)


def config_grid(
    generators: DataFrame,
    levels: Sequence[Column],
    skip_levels: bool = True,
    temperatures: tuple[float, float, float] = (0.7, 1.31, 0.3),
    runs: int = 1,
) -> DataFrame:
    """Every generator with every chain, temperature of the half-open range, and run number."""
    low, high, step = (round(t * 1000) for t in temperatures)
    sweep = F.sequence(F.lit(low), F.lit(high - 1), F.lit(step))
    return (
        generators.withColumn("chain", F.explode(converter_chains(levels, skip_levels)))
        .withColumn("__milli", F.explode(sweep))
        .withColumn("temperature", F.col("__milli") / 1000)
        .withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)).cast("array<bigint>")))
        .drop("__milli")
    )
