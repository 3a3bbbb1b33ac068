"""The long metric table: flattening, upserts, gaps, plans, fold summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flatten_struct(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """A nested struct of numbers as rows with dotted names."""

    def leaves(schema: T.StructType, path: Column, prefix: str) -> list[Column]:
        out = []
        for field in schema.fields:
            name = f"{prefix}{field.name}"
            inner = path.getField(field.name)
            if isinstance(field.dataType, T.StructType):
                out += leaves(field.dataType, inner, f"{name}.")
            elif isinstance(field.dataType, T.NumericType):
                out.append(F.struct(F.lit(name).alias("metric"), inner.cast("double").alias("value")))
        return out

    entries = leaves(df.schema[column].dataType, F.col(column), "")
    return df.select(*keep, F.inline(F.array(*entries))).filter(F.col("value").isNotNull())


def flatten_map(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    """A map of maps of numbers as rows with dotted names."""
    outer = df.select(*keep, F.explode(column).alias("__outer", "__inner"))
    return outer.select(*keep, "__outer", F.explode("__inner").alias("__name", "value")).select(
        *keep, F.concat_ws(".", "__outer", "__name").alias("metric"), "value"
    )


def wide_to_long(df: DataFrame, keys: Sequence[str], prefix: str = "") -> DataFrame:
    """Metric columns as rows."""
    values = [c for c in df.columns if c not in keys]
    doubles = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    long = doubles.unpivot(list(keys), [F.col(f"`{c}`") for c in values], "metric", "value")
    return long.withColumn("metric", F.concat(F.lit(prefix), "metric")) if prefix else long


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str] = ("dataset_id", "metric")) -> DataFrame:
    """New values win; values only the old store has survive."""
    renamed = new.withColumnRenamed("value", "__new")
    return old.join(renamed, list(key), "full").select(*key, F.coalesce("__new", "value").alias("value"))


def gaps(expected: DataFrame, store: DataFrame, key: Sequence[str] = ("position",)) -> DataFrame:
    """Expected positions without any stored metric."""
    return expected.join(store.select(*key).distinct(), list(key), "left_anti")


def last_shard_wins(entries: DataFrame, key: Sequence[str], file_order: str = "file") -> DataFrame:
    """Of the entries at one position those of the last file."""
    last = entries.groupBy(*key).agg(F.max(file_order).alias(file_order))
    return entries.join(last, [*key, file_order])


def metric_plan(datasets: DataFrame, metrics: Sequence[str], store: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(dataset, metric) still to compute.

    A metric counts as done when any stored name starts with its name. ``datasets`` has
    ``n_labels`` and ``has_real``: without a real set only diversity is planned, with one label
    no transfer.
    """
    wanted = [m for m in metrics if m not in exclude]
    supervised = [m for m in wanted if m.startswith(("mauve", "finetune"))]
    allowed = F.array(*[F.lit(m) for m in wanted])
    allowed = F.when(F.col("has_real") & (F.col("n_labels") > 1), allowed).otherwise(
        F.filter(allowed, lambda m: ~m.isin(supervised))
    )
    planned = datasets.select("dataset_id", F.explode(allowed).alias("metric"))
    names = F.filter(F.array(*[F.lit(m) for m in wanted]), lambda m: F.col("metric").startswith(m))
    done = store.select("dataset_id", F.explode(names).alias("metric")).distinct()
    return planned.join(done, ["dataset_id", "metric"], "left_anti")


def kfold_summary(folds: DataFrame, key: Sequence[str] = ("dataset_id", "metric")) -> DataFrame:
    """Mean over folds, and the spread as published: population deviation over n (not √n)."""
    n = F.count("value")
    return folds.groupBy(*key).agg(
        F.avg("value").alias("mean"),
        (F.stddev_pop("value") / n).alias("std"),
        (F.stddev_pop("value") / F.sqrt(n)).alias("stderr"),
    )


def results_missing(expected: DataFrame, store: DataFrame, real: DataFrame | None, task: str = "task") -> DataFrame:
    """(task, position) without any stored metric; position -1 is the real set of a task.

    With ``real`` None no real metrics are demanded.
    """
    runs = gaps(expected.select(task, "position"), store, [task, "position"])
    if real is None:
        return runs
    tasks = expected.select(task).distinct().withColumn("position", F.lit(-1).cast("bigint"))
    return runs.unionByName(gaps(tasks, real, [task]))


def dense_matrix(
    store: DataFrame, fill: float = 0.0, key: Sequence[str] = ("dataset_id",), names: Sequence[str] | None = None
) -> DataFrame:
    """Every dataset with a column per metric name; missing values take ``fill``.

    Columns must be known before a query runs: without ``names`` the store is read once for them.
    """
    wide = store.groupBy(*key).pivot("metric", list(names) if names is not None else None).agg(F.first("value"))
    return wide.fillna(fill)


def dense_maps(
    store: DataFrame, fill: float = 0.0, key: Sequence[str] = ("dataset_id",), every: DataFrame | None = None
) -> DataFrame:
    """(key, metrics): a map with every metric name of the store; missing values take ``fill``.

    ``every`` lists the datasets, also those without a stored metric. The names are a subquery of the same job, so nothing runs beforehand.
    """
    names = store.agg(F.array_sort(F.collect_set("metric")).alias("names"))
    pairs = store.groupBy(*key, "metric").agg(F.max("value").alias("value"))
    own = pairs.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("metric", "value"))).alias("own"))
    listed = own if every is None else every.select(*key).distinct().join(own, list(key), "left")
    named = listed.withColumn("names", names.scalar())
    filled = F.transform("names", lambda name: F.struct(name, F.coalesce(F.try_element_at("own", name), F.lit(fill))))
    return named.select(*key, F.map_from_entries(filled).alias("metrics"))
