"""All measures of many generated datasets against a real one, as long metric tables.

Every measure is a function of fold parts that handles all datasets and folds in one job. New
measures are added to ``MEASURES`` by name.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.operators import classify, diversity, mauve, metrics, rows, sampling, vectors
from quillgauge.session import spread, stored
from quillgauge.sources import stores

KEY = ("dataset_id", "run")
MODEL_KEY = (*KEY, "test_set")


@dataclass(frozen=True)
class Folds:
    """Training and validation rows by (dataset, run), and test rows.

    ``test_set`` says which test rows a dataset is judged by.
    """

    train: DataFrame
    valid: DataFrame
    test: DataFrame


def make_folds(datasets: DataFrame, real: DataFrame, n_runs: int = 5) -> Folds:
    """Fold every dataset. Without ``test_set`` all share one test set."""
    if "test_set" not in datasets.columns:
        datasets, real = (df.withColumn("test_set", F.lit("real")) for df in (datasets, real))
    parts = sampling.fold_parts(sampling.stratified_folds(datasets, n_runs), n_runs)
    return Folds(parts.filter(F.col("side") == "train"), parts.filter(F.col("side") == "valid"), real)


def _long(df: DataFrame, prefix: str) -> DataFrame:
    return metrics.wide_to_long(df, list(KEY), prefix)


def fold_model(folds: Folds, words: Column | None = None) -> classify.Model:
    return classify.train(folds.train, MODEL_KEY, words)


def fake_to_real(folds: Folds, words: Column | None = None, model: classify.Model | None = None) -> DataFrame:
    """Trained on each generated fold, tested on the real set."""
    texts = [c for c in ("text", "other_text") if c in folds.test.columns]
    test = folds.test.select("test_set", "row_id", "label", *texts)
    return classify.transfer_scores(classify.predict(model or fold_model(folds, words), test, ["row_id"], words), KEY)


def fake_to_fake(folds: Folds, words: Column | None = None, model: classify.Model | None = None) -> DataFrame:
    """Trained on each generated fold, tested on its held-out rows."""
    guesses = classify.predict(model or fold_model(folds, words), folds.valid, [*MODEL_KEY, "row_id"], words)
    return classify.transfer_scores(guesses, KEY)


def real_to_fake(datasets: DataFrame, real: DataFrame, words: Column | None = None) -> DataFrame:
    """Trained once, on the training part of the first real half, tested on every dataset.

    Rows whose label the real set lacks are left out.
    """
    first = sampling.halves(real, []).filter(F.col("half") == 1)
    train = sampling.holdout(first, []).filter(F.col("side") == "train")
    model = classify.train(train.withColumn("model", F.lit("real")), ["model"], words)
    known = rows.known_labels(datasets, real)
    guesses = classify.predict(model, known, ["dataset_id", "row_id"], words)
    return classify.transfer_scores(guesses, ["dataset_id"])


def real_halves(real: DataFrame) -> tuple[DataFrame, DataFrame]:
    """First half as the dataset ``real``, second half as its test set."""
    split = sampling.halves(real, [])
    columns = real.columns
    return (
        split.filter(F.col("half") == 1).withColumn("dataset_id", F.lit("real")).select(*columns),
        split.filter(F.col("half") == 2).select(*columns),
    )


def _distinctness(folds: Folds) -> DataFrame:
    counts = diversity.token_counts(folds.train, KEY)
    return _long(diversity.distinctness(counts, KEY).withColumnRenamed("distinctness", "3"), "distinctness.")


def _average_distinctness(folds: Folds) -> DataFrame:
    out = diversity.average_distinctness(folds.train, KEY)
    return _long(out.drop("basis").withColumnRenamed("average_distinctness", "3"), "average_distinctness.")


def _lemma_distinctness(folds: Folds) -> DataFrame:
    out = diversity.lemma_distinctness(folds.train, KEY)
    return _long(out.drop("basis").withColumnRenamed("lemma_distinctness", "1"), "average_distinctness_spacy.")


def _mauve(folds: Folds) -> DataFrame:
    """Match of hashed text vectors of each fold with those of its test set, which also weighs the words."""
    name = F.concat_ws("|", *KEY)
    rows = folds.train.select(name.alias("dataset_id"), "row_id", "text", "test_set")
    tests = folds.test.select("row_id", "text", "test_set")
    weights = vectors.hash_weights(tests, by=["test_set"])
    own, real = (vectors.hash_vectors(df, by=["test_set"], weights=weights, keep_text=False) for df in (rows, tests))
    bins = mauve.quantise(own, real)
    cut = F.split("dataset_id", r"\|")
    return mauve.mauve(bins).select(
        F.array_join(F.slice(cut, 1, F.size(cut) - 1), "|").alias("dataset_id"),
        F.element_at(cut, -1).cast("bigint").alias("run"),
        F.lit("mauve").alias("metric"),
        F.col("mauve").alias("value"),
    )


def _transfer(folds: Folds) -> DataFrame:
    # Both tests are of the same models, which are trained once.
    model = classify.written(fold_model(folds))
    real = _long(fake_to_real(folds, model=model), "finetune_temporal_fake_to_real.")
    return real.unionByName(_long(fake_to_fake(folds, model=model), "finetune_temporal_fake_to_fake."))


MEASURES: dict[str, Callable[[Folds], DataFrame]] = {
    "distinctness": _distinctness,
    "average_distinctness": _average_distinctness,
    "average_distinctness_spacy": _lemma_distinctness,
    "mauve": _mauve,
    "finetune_temporal": _transfer,
}

# Measures left out unless asked for.
DEFAULT_EXCLUDE = ("distinctness",)


def _planned(df: DataFrame, plan: DataFrame | None, measure: str) -> DataFrame:
    """The rows of the datasets for which a measure is planned; all of them without a plan."""
    if plan is None:
        return df
    return df.join(plan.filter(F.col("metric") == measure).select("dataset_id"), "dataset_id", "left_semi").select(*df.columns)


def measure_folds(folds: Folds, exclude: Sequence[str], plan: DataFrame | None = None) -> DataFrame:
    names = [n for n in MEASURES if n not in exclude]
    parts = []
    for name in names:
        train, valid = (_planned(side, plan, name) for side in (folds.train, folds.valid))
        parts.append(MEASURES[name](replace(folds, train=train, valid=valid)))
    return reduce(DataFrame.unionByName, parts)


def evaluate_all(
    datasets: DataFrame,
    real: DataFrame,
    n_runs: int = 5,
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    plan: DataFrame | None = None,
) -> DataFrame:
    """(dataset, metric, value, std) for every dataset and for the real set itself.

    Measures are means over the folds' training parts with their published spread. The real set
    is judged by its first half against its second; its real-to-fake scores are its held-out ones.
    Against a real set with one label there are no transfer scores.
    Folds and test rows are written once and every measure reads them from there. ``plan``
    (``dataset_id, metric``) names the measures to take of each dataset; the real set is ``real``.
    """
    if real.select("label").distinct().limit(2).count() < 2:
        exclude = (*exclude, "finetune_temporal")
    first, second = real_halves(real)
    whole, half = F.lit("real"), F.lit("second half")
    judged = datasets.withColumn("test_set", whole).unionByName(first.withColumn("test_set", half))
    tests = real.withColumn("test_set", whole).unionByName(second.withColumn("test_set", half))
    folds = make_folds(judged, tests, n_runs)
    parts = stored(folds.train.unionByName(folds.valid), "folds", ("side",))
    sides = [spread(parts.filter(f"side = '{side}'"), "row_id") for side in ("train", "valid")]
    written = Folds(*sides, spread(stored(folds.test, "tests"), "row_id"))
    folded = measure_folds(written, exclude, plan)
    summary = metrics.kfold_summary(folded).select(
        "dataset_id", "metric", F.col("mean").alias("value"), "std"
    )
    if "finetune_temporal" in exclude:
        return summary
    faithful = metrics.wide_to_long(
        real_to_fake(_planned(datasets, plan, "finetune_temporal"), real), ["dataset_id"], "finetune_temporal_real_to_fake."
    ).withColumn("std", F.lit(None).cast("double"))
    copied = summary.filter(
        (F.col("dataset_id") == "real") & F.col("metric").startswith("finetune_temporal_fake_to_fake")
    ).withColumn("metric", F.replace("metric", F.lit("_fake_to_fake"), F.lit("_real_to_fake")))
    return summary.unionByName(faithful.select(*summary.columns)).unionByName(copied)


def spread_rows(scores: DataFrame) -> DataFrame:
    """(dataset, metric, value): the spread of a metric becomes the metric ``<name>_std``."""
    std = scores.filter(F.col("std").isNotNull()).select(
        "dataset_id", F.concat("metric", F.lit("_std")).alias("metric"), F.col("std").alias("value")
    )
    return scores.select("dataset_id", "metric", "value").unionByName(std)


def evaluate_into(
    path: str,
    datasets: DataFrame,
    real: DataFrame,
    n_runs: int = 5,
    exclude: Sequence[str] = DEFAULT_EXCLUDE,
    force: bool = False,
) -> DataFrame:
    """Bring the metric store at ``path`` up to date and return it: (dataset, metric, value).

    Only measures that a dataset lacks are taken, all of them with ``force``. Without real rows
    only diversity is measured, and a dataset with one label gets no transfer scores. New values win
    over stored ones; the store is then written anew as its next issue, which readers see
    only when it is complete.
    """
    spark = datasets.sparkSession
    store, issue = stores.read_store(spark, path)
    has_real = not real.isEmpty()
    every = datasets.unionByName(real.withColumn("dataset_id", F.lit("real")).select(*datasets.columns))
    sizes = every.groupBy("dataset_id", "label").count().groupBy("dataset_id").agg(
        F.count("label").alias("n_labels"), F.lit(has_real).alias("has_real")
    )
    known = store.filter(F.lit(not force))
    plan = stored(metrics.metric_plan(sizes, list(MEASURES), known, exclude), "plan")
    needed = {r["metric"] for r in plan.select("metric").distinct().collect()}
    if not needed:
        return store
    skipped = tuple(name for name in MEASURES if name not in needed)
    wanted = datasets.join(plan.select("dataset_id").distinct(), "dataset_id", "left_semi").select(*datasets.columns)
    scores = evaluate_all(wanted, real, n_runs, skipped, plan=plan)
    stores.write_store(metrics.upsert(store, spread_rows(scores)), path, issue + 1)
    return stores.read_store(spark, path)[0]
