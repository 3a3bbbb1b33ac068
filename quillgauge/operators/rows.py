"""Row filters, edits, unions and first-wins selection on the long dataset table.

The table has ``dataset_id, row_id, text, label`` and, for pair tasks, ``other_text``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.operators.ordering import number_by_id


def remove_empty(df: DataFrame, min_length: int = 2) -> DataFrame:
    # One test: a filter computes the text anew for each mention of it.
    return df.filter(F.length("text") >= max(min_length, 1))


def load_normalise(df: DataFrame, min_length: int = 2) -> DataFrame:
    """Drop rows without label, then turn nulls into empty text, then drop short text."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    return remove_empty(df.filter(F.col("label").isNotNull()).fillna("", subset=strings), min_length)


def with_label(df: DataFrame, label: str) -> DataFrame:
    """The rows of one label with their position in the dataset."""
    return number_by_id(df, ["dataset_id"]).filter(F.col("label") == label)


def row_at(df: DataFrame, position: int) -> DataFrame:
    """The row at a position (from 1) of every dataset; later buckets are never shuffled."""
    return number_by_id(df, ["dataset_id"], at_most=position).filter(F.col("position") == position)


def apply_edits(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Replace ``text``/``other_text`` of the rows an edit names; null means unchanged."""
    columns = [c for c in ("text", "other_text") if c in df.columns and c in edits.columns]
    renamed = edits.select("dataset_id", "row_id", *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = df.join(renamed, ["dataset_id", "row_id"], "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"__new_{c}", c))
    return out.select(*df.columns)


def delete_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """Delete rows by id and number the rest again."""
    return number_by_id(df.join(gone, ["dataset_id", "row_id"], "left_anti"), ["dataset_id"])


def delete_texts(df: DataFrame, texts: DataFrame) -> DataFrame:
    """Delete every row whose text equals one of the given texts."""
    return df.join(texts.select("text").distinct(), "text", "left_anti").select(*df.columns)


def pairs(df: DataFrame) -> DataFrame:
    """(text, other_text, label) with a null partner for tasks on single texts."""
    other = F.col("other_text") if "other_text" in df.columns else F.lit(None).cast("string")
    return df.select("dataset_id", "row_id", "text", other.alias("other_text"), "label")


def append_rows(df: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of ``new`` behind those of ``df``; a missing partner text becomes null."""
    return df.unionByName(new, allowMissingColumns=True)


def first_wins(df: DataFrame, key: Sequence[str], position: str = "position") -> DataFrame:
    """For each key its first position and a number by first appearance, from 0."""
    firsts = df.groupBy(*key).agg(F.min(position).alias("first_position"))
    numbered = number_by_id(firsts, [], row_id="first_position", name="__n")
    return numbered.withColumn("first_id", F.col("__n") - 1).drop("__n")


def known_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose label a model was trained on."""
    return df.join(labels.select("label").distinct(), "label", "left_semi").select(*df.columns)


def unpivot_flags(df: DataFrame, flags: Sequence[str], unclear: Column | None = None) -> DataFrame:
    """One-hot label columns to label rows: a row with k flags set yields k rows."""
    clear = df if unclear is None else df.filter(~unclear)
    ids = [c for c in df.columns if c not in flags]
    return clear.unpivot(ids, list(flags), "label", "__flag").filter(F.col("__flag") == 1).drop("__flag")
