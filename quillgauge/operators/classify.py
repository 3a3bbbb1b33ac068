"""Text classification as counting: many multinomial Naive Bayes models in one grouped job.

A model is named by key columns (say dataset and run). Its weights are one row per (model, token)
with an array of the labels the token occurs with, so labels are rows of data: there may be any
number of them, and none passes through the driver. Smoothed likelihoods ln((c+1)/(n+types)) are
kept in two parts: ln(c+1) per token and label, nothing where c is 0, and ln(n+types) once per model
on the row of a token that every document has once. Training so needs no join at token level, and
scoring brings chunks of rows and the weights they need together. A third of all words being the
same word is no trouble: counts are combined per partition before they are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgauge.functions.text import word_array
from quillgauge.session import stored


# The token every document has once; its row holds the priors and the label sizes.
PRIOR_TOKEN = ""

# What stands between the words of a row on their way to a task; no word holds it.
_SEPARATOR = "\0"

# So many of the commonest words of a chunk are added up by a product, for so many rows at once.
_COMMON, _AT_ONCE = 4096, 1024


@dataclass(frozen=True)
class Model:
    """Rows (key, token, entries), entries an array of (label, w, z).

    A word's row has ln(c+1) in w for the labels it occurs with, and an entry without a label and
    with a w of 1, whose sum over a text is its number of known words. The prior token's row has, for
    every label with training rows, the log prior in w and ln(n+types) in z.
    """

    weights: DataFrame
    key: tuple[str, ...]
    # Whether the weights are read from a table, so that each use need not work them out.
    written: bool = False


def label_table(df: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Labels with their code: the rank in ascending order, from 0."""
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("label")) - 1
    return df.select(*group, "label").distinct().withColumn("code", rank.cast("bigint"))


def pair_words(text: Column | str = "text", other: Column | str = "other_text") -> Column:
    """Words of a sentence pair, tagged by the side they are on."""
    left = F.transform(word_array(text), lambda w: F.concat(F.lit("a:"), w))
    right = F.transform(word_array(F.coalesce(other, F.lit(""))), lambda w: F.concat(F.lit("b:"), w))
    return F.concat(left, right)


def _entry(label: Column, w: Column, z: Column) -> Column:
    return F.struct(label.alias("label"), w.cast("double").alias("w"), z.cast("double").alias("z"))


def train(rows: DataFrame, key: Sequence[str], words: Column | None = None) -> Model:
    """Add-one smoothed token likelihoods and document priors per key.

    ``rows`` has the key columns, ``text`` and ``label``. The labels of a model are those of its rows;
    rows without a label teach nothing.
    """
    keys, none = list(key), F.lit(None)
    tokens = word_array("text") if words is None else words
    is_prior = F.col("token") == PRIOR_TOKEN
    # Every document has the prior token once, so its counts are the documents per label.
    counts = (
        rows.filter(F.col("label").isNotNull())
        .select(*keys, "label", F.explode(F.concat(F.array(F.lit(PRIOR_TOKEN)), tokens)).alias("token"))
        .groupBy(*keys, "token", "label")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy(*keys, "token")
        .agg(F.collect_list(F.struct("label", "c")).alias("counts"))
    )
    # The entry without a label counts the types.
    type_entry = F.array(F.struct(F.lit(None).cast("string").alias("label"), F.when(~is_prior, 1).otherwise(0).cast("bigint").alias("c")))
    sizes = (
        counts.select(*keys, is_prior.alias("prior"), F.inline(F.concat("counts", type_entry)))
        .groupBy(*keys, "label")
        .agg(F.sum(F.when(~F.col("prior"), F.col("c")).otherwise(0)).alias("n"), F.sum(F.when(F.col("prior"), F.col("c")).otherwise(0)).alias("d"))
        .groupBy(*keys)
        .agg(
            F.sum("d").alias("docs"),
            F.max(F.when(F.col("label").isNull(), F.col("n"))).alias("types"),
            F.collect_list(F.when(F.col("label").isNotNull(), F.struct("label", "n", "d"))).alias("labels"),
        )
    )
    # No filter here: it would be pushed below the counting and make it run once more. The counts
    # row of the prior token has no entries instead.
    own = F.transform("counts", lambda x: _entry(x["label"], F.log(x["c"] + 1), none))
    known = F.array(_entry(none.cast("string"), F.lit(1.0), none))
    words_rows = counts.select(*keys, "token", F.when(~is_prior, F.concat(own, known)).alias("entries"))
    prior = F.transform(
        "labels",
        lambda x: _entry(x["label"], F.log(x["d"] / F.col("docs")), F.log(F.greatest(x["n"] + F.col("types"), F.lit(1)))),
    )
    prior_rows = sizes.select(*keys, F.lit(PRIOR_TOKEN).alias("token"), prior.alias("entries"))
    return Model(words_rows.unionByName(prior_rows), tuple(keys))


def written(model: Model) -> Model:
    """The model with its weights in a table, for several uses of it."""
    return model if model.written else Model(stored(model.weights, "weights"), model.key, True)


def likelihoods(model: Model) -> DataFrame:
    """(key, token, label, weight): smoothed log likelihoods, and the log priors under the prior token."""
    keys = list(model.key)
    is_prior = F.col("token") == PRIOR_TOKEN
    priors = model.weights.filter(is_prior & F.col("entries").isNotNull()).select(*keys, F.col("entries").alias("labels"))
    # A word that a label lacks has ln(1) there.
    seen = F.map_from_entries(F.transform(F.filter("entries", lambda x: x["label"].isNotNull()), lambda x: F.struct(x["label"], x["w"])))
    words = model.weights.filter(~is_prior).select(*keys, "token", seen.alias("seen"))
    smoothed = words.join(priors, keys).select(*keys, "token", "seen", F.inline("labels"))
    weight = F.coalesce(F.try_element_at("seen", F.col("label")), F.lit(0.0)) - F.col("z")
    own = priors.select(*keys, F.lit(PRIOR_TOKEN).alias("token"), F.inline("labels")).select(*keys, "token", "label", F.col("w").alias("weight"))
    return smoothed.select(*keys, "token", "label", weight.alias("weight")).unionByName(own)


def _unit_scores(row: list[str], result_key: list[str], schema: pa.Schema) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores of a chunk of rows under the models of a group, label by label."""

    def run(rows: pa.Table, weights: pa.Table) -> pa.Table:
        # A filter of its own would cut every text into words once more.
        rows = rows.filter(pc.is_valid(rows["__words"]))
        if not rows.num_rows or not weights.num_rows:
            return schema.empty_table()
        # Rows of the same id and label count as one.
        codes = np.stack([rows[c].combine_chunks().dictionary_encode("encode").indices.to_numpy() for c in [*row, "__truth"]], axis=1)
        _, first, number = np.unique(codes, axis=0, return_index=True, return_inverse=True)
        number, n = number.reshape(-1), len(first)
        lists = pc.split_pattern(rows["__words"].combine_chunks(), _SEPARATOR)
        at = number[pc.list_parent_indices(lists).to_numpy()]
        words = lists.flatten().dictionary_encode()
        word, types = words.indices.to_numpy(), words.dictionary
        is_prior = pc.equal(weights["token"], PRIOR_TOKEN)
        priors = weights.filter(is_prior)
        met = weights.filter(pc.and_(pc.invert(is_prior), pc.is_in(weights["token"], types)))
        place = pc.index_in(met["token"], types).to_numpy().astype(np.int64)
        entries = met["__labels"].combine_chunks()
        entry_type = pc.list_parent_indices(entries).to_numpy()
        entry_label, entry_w = entries.flatten(), met["__w"].combine_chunks().flatten().to_numpy()
        model, ids = met["__model"].to_numpy(), rows.take(pa.array(first))
        times, out = np.bincount(number, minlength=n), []

        # The commonest words make up most of a text. They are counted by row, and all their weights are added up
        # in one product; the other words are added up one by one.
        often = np.bincount(word, minlength=len(types))
        common = np.argpartition(-often, _COMMON)[:_COMMON] if len(types) > _COMMON else np.arange(len(types))
        rank = np.full(len(types), -1)
        rank[common] = np.arange(len(common))
        names = priors["__model"].to_pylist()
        labels_of = [priors["__labels"][i].values for i in range(len(names))]
        # A column for each label of a model, and one for the number of known words.
        starts = np.concatenate([[0], np.cumsum([len(labels) + 1 for labels in labels_of])]).astype(int)
        dense, rare_weights = np.zeros((len(common), starts[-1])), []
        entry_model = model[entry_type]
        by_model, by_entry = np.argsort(model, kind="stable"), np.argsort(entry_model, kind="stable")
        ends, entry_ends = (np.searchsorted(of[order], [names, np.add(names, 1)]) for of, order in ((model, by_model), (entry_model, by_entry)))
        for i, labels in enumerate(labels_of):
            types_of = place[by_model[ends[0, i] : ends[1, i]]]
            own = by_entry[entry_ends[0, i] : entry_ends[1, i]]
            code = pc.index_in(entry_label.take(pa.array(own)), labels).to_numpy()
            for j in range(len(labels) + 1):
                mine = own[code == j]
                of, w = (types_of, np.ones(len(types_of))) if j == len(labels) else (place[entry_type[mine]], entry_w[mine])
                is_common = rank[of] >= 0
                dense[rank[of[is_common]], starts[i] + j] = w[is_common]
                rare_weights.append((of[~is_common], w[~is_common]))
        total = np.empty((n, starts[-1]))
        place_of = rank[word]
        rare = np.flatnonzero(place_of < 0)
        rare_at, rare_word = at[rare], word[rare]
        frequent = np.flatnonzero(place_of >= 0)
        frequent = frequent[np.argsort(at[frequent], kind="stable")]
        row_at, cell = at[frequent], place_of[frequent]
        for start in range(0, n, _AT_ONCE):
            end = min(start + _AT_ONCE, n)
            part = slice(*np.searchsorted(row_at, [start, end]))
            counts = np.bincount((row_at[part] - start) * len(common) + cell[part], minlength=(end - start) * len(common))
            total[start:end] = counts.reshape(end - start, -1).astype(float) @ dense
        for column, (of, w) in enumerate(rare_weights):
            if len(of):
                by_type = np.zeros(len(types))
                by_type[of] = w
                total[:, column] += np.bincount(rare_at, by_type[rare_word], n)

        for i, labels in enumerate(labels_of):
            prior, z = (priors[c][i].values for c in ("__w", "__z"))
            sums = times[:, None] * prior.to_numpy() + total[:, starts[i] : starts[i + 1] - 1]
            spread = pa.array(np.tile(np.arange(len(labels)), n))
            scored = pa.StructArray.from_arrays([labels.take(spread), pa.array(sums.reshape(-1)), z.take(spread)], fields=list(schema.field("labels").type.value_type))
            arrays = [ids[c].combine_chunks() if c in row else priors[c].take(pa.array(np.full(n, i))).combine_chunks() for c in result_key]
            arrays += [ids["__truth"].combine_chunks(), pa.array(total[:, starts[i + 1] - 1].copy())]
            arrays.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(labels), pa.int32()), scored))
            out.append(pa.Table.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema, strict=True)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def predict(
    model: Model, rows: DataFrame, row_key: Sequence[str], words: Column | None = None, chunk: int = 8192, types: int = 1 << 22
) -> DataFrame:
    """Predicted label and confidence for each row under each model that applies to it.

    Model key columns that ``rows`` has are joined on; those it lacks multiply, which is the test
    of every model on one shared set. Rows without a known word get the top prior. Scores that agree
    to nine digits are ties, which go to the label that sorts first.

    Rows stay whole: chunks of about ``chunk`` rows meet groups of models, of about ``types`` words
    together or a single model, and a row's words are added up where it is. Only texts, weights and one result per
    row and model are shuffled, never a row per word and model. Where models share rows, a chunk is sent
    the weights of the words it holds.
    """
    keys, ids = list(model.key), list(row_key)
    shared = [k for k in keys if k in rows.columns]
    tokens = word_array("text") if words is None else words
    result_key = list(dict.fromkeys([*keys, *ids]))
    row = list(dict.fromkeys([*shared, *ids]))
    by = shared or ["__all"]
    whole = {} if shared else {"__all": F.lit(0)}
    rows = rows.withColumns({"__truth": F.col("label"), **whole}).dropna(subset=by)
    weights = written(model).weights.filter(F.col("entries").isNotNull()).withColumns(whole).dropna(subset=by)
    per_model = list(dict.fromkeys([*by, *keys]))
    before = Window.partitionBy(*by).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    models = weights.groupBy(*per_model).agg(F.count(F.lit(1)).alias("__types")).select(
        *per_model,
        F.floor(F.coalesce(F.sum("__types").over(before), F.lit(0)) / types).alias("__group"),
        (F.row_number().over(Window.partitionBy(*by).orderBy(*keys)) - 1).alias("__model"),
    )
    models = stored(models, "models")
    n_rows = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chunk).alias("__chunks"))
    plan = stored(models.groupBy(*by).agg(F.collect_set("__group").alias("__groups")).join(n_rows, by), "plan")
    listed = rows.select(*by, *[c for c in row if c not in by], "__truth", tokens.alias("__list"))
    placed = listed.join(plan, by).withColumn("__chunk", F.pmod(F.xxhash64(*row), F.col("__chunks")))
    texts = placed.select(
        *by, *[c for c in row if c not in by], "__truth", "__chunk", F.array_join("__list", _SEPARATOR).alias("__words"), F.explode("__groups").alias("__group")
    )
    is_prior = F.col("token") == PRIOR_TOKEN
    # Only the prior's row of a model needs to name it.
    entries = F.array_sort(F.filter("entries", lambda x: x["label"].isNotNull()))
    same = reduce(Column.__and__, [F.col(f"w.{k}").eqNullSafe(F.col(f"m.{k}")) for k in per_model])
    named = weights.alias("w").join(models.alias("m"), same).select(
        *[F.col(f"w.{k}").alias(k) for k in by], "__group", "__model", "token",
        *[F.when(is_prior, F.col(f"w.{k}")).alias(k) for k in keys if k not in by],
        entries["label"].alias("__labels"), entries["w"].alias("__w"), F.when(is_prior, entries["z"]).alias("__z"),
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__chunks") - 1)).alias("__chunk")
    chunks = plan.select(*by, every)
    if len(shared) < len(keys):
        seen = placed.select(*by, F.explode("__list").alias("token"), "__chunk").distinct()
        sent = named.filter(~is_prior).join(seen, [*by, "token"]).unionByName(named.filter(is_prior).join(chunks, by))
    else:
        sent = named.join(chunks, by)
    texts = texts.select(*by, "__group", "__chunk", *[c for c in texts.columns if c not in (*by, "__group", "__chunk")])
    unit = [*by, "__group", "__chunk"]
    # Both sides come from the plan and the rows; names of their own keep them apart.
    sent = sent.toDF(*[f"__{c}_of" if c in unit else c for c in sent.columns])
    schema = T.StructType(
        [*(T.StructField(c, (rows if c in row else model.weights).schema[c].dataType) for c in result_key), T.StructField("__truth", rows.schema["label"].dataType)]
        + [T.StructField("known", T.DoubleType()), T.StructField("labels", model.weights.schema["entries"].dataType)]
    )
    run = _unit_scores(row, result_key, to_arrow_schema(schema))
    by_row = texts.groupBy(*unit).cogroup(sent.groupBy(*[f"__{c}_of" for c in unit])).applyInArrow(run, schema)
    scores = by_row.withColumn("scores", F.transform("labels", lambda x: F.round(x["w"] - F.col("known") * x["z"], 9)))
    top = scores.withColumn("top", F.array_max("scores"))
    best = F.element_at("labels", F.array_position("scores", F.col("top")).cast("int"))["label"]
    others = F.aggregate("scores", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    return top.select(*result_key, F.col("__truth").alias("label"), best.alias("predicted"), (1 / others).alias("confidence"))


def confusion(predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    return predictions.groupBy(*key, "label", "predicted").agg(
        F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("confidence")).alias("doubt")
    )


def cell_scores(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    """accuracy, complexity_abs and f1 per key, from the confusion cells in one pass.

    f1 is the mean over the labels that occur as truth or prediction. Every row counts once as
    truth and once as prediction, so the sums over the labels hold each row twice.
    """
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    sides = cells.select(
        *key,
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), (2 * hit).alias("tp2"), F.col("n").alias("seen"), F.col("doubt").alias("doubt")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("bigint").alias("tp2"), F.col("n").alias("seen"), F.lit(0.0).alias("doubt")),
            )
        ).alias("s"),
    )
    per_class = sides.groupBy(*key, "s.class").agg(
        F.sum("s.tp2").alias("tp2"), F.sum("s.seen").alias("seen"), F.sum("s.doubt").alias("doubt")
    )
    return per_class.groupBy(*key).agg(
        (F.sum("tp2") / F.sum("seen")).alias("accuracy"),
        (2 * F.sum("doubt") / F.sum("seen")).alias("complexity_abs"),
        F.avg(F.col("tp2") / F.col("seen")).alias("f1"),
    )


def macro_f1(cells: DataFrame, key: Sequence[str]) -> DataFrame:
    return cell_scores(cells, key).select(*key, "f1")


def transfer_scores(predictions: DataFrame, key: Sequence[str]) -> DataFrame:
    return cell_scores(confusion(predictions, key), key)
