"""Multinomial logistic regression of many models at once, by full gradient steps.

A model is named by key columns, as in ``classify``. A text is its hashed words: counts per bucket,
scaled to unit length, and a constant. All models take their steps together: a step joins the weights, one row
per model and label, to blocks of rows that were written once in buckets and stay where they are; a block
gives its part of the gradient, and parts are added up by model and label before they move. So a step
shuffles weights and gradients only, a task holds one block and one model's weights, and a large model
is spread over as many tasks as it has blocks.

Steps start from zero and have a fixed rate, so any engine that adds up the same sums follows them.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgauge.functions.keys import key_number
from quillgauge.functions.text import word_array
from quillgauge.operators.mauve import array_sum
from quillgauge.session import scratch_path, stored


def _features(lists: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors of bucket counts, with a constant in the last column."""
    x = np.zeros((len(lists), dim + 1))
    for row, buckets in zip(x, lists, strict=True):
        counts = np.bincount(np.asarray(buckets, np.int64), minlength=dim) if buckets is not None else np.zeros(dim)
        row[:dim] = counts / max(1e-300, np.sqrt((counts**2).sum()))
    x[:, dim] = 1
    return x


def _likelihoods(x: np.ndarray, weights: pd.DataFrame) -> tuple[list, np.ndarray]:
    """The labels of a model in order, and the probability of each for every row."""
    own = weights.sort_values("label")
    scores = x @ np.stack(own["w"].to_numpy()).T
    scores = np.exp(scores - scores.max(axis=1, keepdims=True))
    return own["label"].tolist(), scores / scores.sum(axis=1, keepdims=True)


class Blocks:
    """Rows of (key, row_id, label, text) as hashed words, written once in blocks of about ``block`` rows of a model."""

    def __init__(self, rows: DataFrame, key: Sequence[str], dim: int, block: int):
        self.key, self.dim, self.spark = list(key), dim, rows.sparkSession
        buckets = F.transform(word_array("text"), lambda w: F.pmod(key_number(F.md5(w)), F.lit(dim)).cast("int"))
        sizes = stored(rows.groupBy(*self.key).agg(F.ceil(F.count(F.lit(1)) / block).alias("__blocks")), "sizes")
        number = F.pmod(F.xxhash64("row_id"), F.col("__blocks")).cast("int")
        made = rows.join(sizes, self.key).select(*self.key, "row_id", "label", buckets.alias("buckets"), number.alias("block"))
        self.unit = [*self.key, "block"]
        n, self.table = int(self.spark.conf.get("spark.sql.shuffle.partitions")), f"logistic_{uuid.uuid4().hex}"
        made.repartition(n, *self.unit).write.bucketBy(n, *self.unit).option("path", scratch_path(self.spark, "rows")).saveAsTable(self.table)
        self.rows = self.spark.table(self.table)
        self.units = sizes.select(*self.key, F.explode(F.sequence(F.lit(0), F.col("__blocks").cast("int") - 1)).alias("block"))

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def with_weights(self, weights: DataFrame, work, out: list[tuple[str, T.DataType]]) -> DataFrame:
        """``work(rows, weights)`` on every block, beside the weights of its model."""
        schema = T.StructType([weights.schema[k] for k in self.key])
        for name, kind in out:
            schema.add(name, kind)
        names, key, dim = schema.names, self.key, self.dim

        def run(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(own):
                return pd.DataFrame(columns=names)
            made = work(rows, own, _features(rows["buckets"], dim))
            return made.assign(**{k: own[k].iloc[0] for k in key})[names]

        wanted = weights.join(self.units, self.key)
        return self.rows.groupBy(*self.unit).cogroup(wanted.groupBy(*self.unit)).applyInPandas(run, schema)


def _slopes(rows: pd.DataFrame, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
    labels, p = _likelihoods(x, own)
    truth = rows["label"].to_numpy()[:, None] == np.array(labels, dtype=object)[None, :]
    slopes = (p - truth).T @ x
    return pd.DataFrame({"label": labels, "n": len(rows), "slope": list(slopes)})


def train(rows: DataFrame, key: Sequence[str], steps: int = 8, rate: float = 4.0, penalty: float = 0.001, dim: int = 256, block: int = 8192) -> DataFrame:
    """(key, label, w): the weights of every model and label after ``steps`` steps.

    ``rows`` has the key, ``row_id``, ``label`` and ``text``; rows without a label teach nothing. The last of
    the ``dim`` + 1 weights belongs to the constant.
    """
    keys = list(key)
    known = rows.filter(F.col("label").isNotNull()).select(*keys, "row_id", "label", "text")
    blocks = Blocks(known, keys, dim, block)
    weights = stored(known.select(*keys, "label").distinct().withColumn("w", F.array_repeat(F.lit(0.0), dim + 1)), "weights")
    for _ in range(steps):
        out = [("label", weights.schema["label"].dataType), ("n", T.LongType()), ("slope", T.ArrayType(T.DoubleType()))]
        parts = blocks.with_weights(weights, _slopes, out)
        slopes = parts.groupBy(*keys, "label").agg(F.sum("n").alias("n"), array_sum("slope", dim + 1).alias("slope"))
        moved = F.zip_with("w", "slope", lambda w, g: w - rate * (g / F.col("n") + penalty * w))
        weights = stored(weights.join(slopes, [*keys, "label"]).select(*keys, "label", moved.alias("w")), "weights")
    blocks.close()
    return weights


def _guesses(rows: pd.DataFrame, own: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
    labels, p = _likelihoods(x, own)
    best = p.round(9).argmax(axis=1)
    return pd.DataFrame(
        {"row_id": rows["row_id"], "label": rows["label"], "predicted": [labels[b] for b in best], "confidence": p[np.arange(len(p)), best]}
    )


def predict(weights: DataFrame, rows: DataFrame, key: Sequence[str], block: int = 8192) -> DataFrame:
    """(key, row_id, label, predicted, confidence) of every row of ``rows``, each judged by the model of its key."""
    first = weights.select(F.size("w").alias("n")).first()
    blocks = Blocks(rows, key, (first["n"] if first else 2) - 1, block)
    label = weights.schema["label"].dataType
    out = [("row_id", rows.schema["row_id"].dataType), ("label", rows.schema["label"].dataType), ("predicted", label), ("confidence", T.DoubleType())]
    found = stored(blocks.with_weights(weights, _guesses, out), "guesses")
    blocks.close()
    return found
