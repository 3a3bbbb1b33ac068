"""Shuffles, folds, splits and draws, repeatable and without single-task groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgauge.functions.keys import id_bucket, key_below, key_number, order_key
from quillgauge.operators.ordering import number_by_hash, number_by_id, running_totals


def shuffle(df: DataFrame, part: Sequence[str] = ("dataset_id",), seed: str = "42") -> DataFrame:
    """Give every row its position in a random order of its group."""
    return number_by_hash(df, list(part), seed=seed)


def bernoulli(df: DataFrame, probability: float, seed: str = "42") -> DataFrame:
    return df.filter(key_below(order_key("row_id", seed=seed), probability))


def holdout(df: DataFrame, part: Sequence[str] = ("dataset_id",), test_share: float = 0.3, seed: str = "42") -> DataFrame:
    """Mark each row ``test`` or ``train``; the test part holds ceil(share · n) rows."""
    out = number_by_hash(df, list(part), seed=seed, total="__size")
    is_test = F.col("position") <= F.ceil(F.col("__size") * test_share)
    return out.withColumn("side", F.when(is_test, "test").otherwise("train")).drop("__size", "position")


def halves(df: DataFrame, part: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """Half 1 is the first n//2 rows in id order, half 2 the rest."""
    out = number_by_id(df, list(part), total="__size")
    first = F.col("position") <= F.floor(F.col("__size") / 2)
    return out.withColumn("half", F.when(first, 1).otherwise(2)).drop("__size", "position")


def first_n(df: DataFrame, n: int, part: Sequence[str] = ("dataset_id",)) -> DataFrame:
    """The first n rows of each group; only the buckets that can hold them are shuffled."""
    return number_by_id(df, list(part), at_most=n).drop("position")


def stratified_folds(df: DataFrame, n: int = 5, part: Sequence[str] = ("dataset_id",), seed: str = "42") -> DataFrame:
    """Deal the shuffled rows of each label round the n folds."""
    dealt = number_by_hash(df, [*part, "label"], seed=seed)
    return dealt.withColumn("fold", F.pmod(F.col("position") - 1, F.lit(n))).drop("position")


def fold_parts(df: DataFrame, n: int = 5, part: Sequence[str] = ("dataset_id",), swap: bool = True) -> DataFrame:
    """Training and validation rows of every fold.

    With ``swap`` (what the published measures use) fold f itself is the training part and the
    validation part is as many of the other rows, in id order. Without it the fold is validated
    on and all other rows train. Takes rows with a ``fold``; returns them once per fold they
    take part in, with ``run`` and ``side``.
    """
    runs = F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")
    own = F.col("run") == F.col("fold")
    if not swap:
        return df.withColumn("run", F.explode(runs)).withColumn("side", F.when(own, "valid").otherwise("train"))
    sums = {"__pos": F.lit(1)} | {f"__c{f}": (F.col("fold") == f).cast("int") for f in range(n)}
    counted = running_totals(
        df, list(part), ["row_id"], id_bucket("row_id"), sums, totals={f"__t{f}": f"__c{f}" for f in range(n)}
    )
    at = (F.col("run") + 1).cast("int")
    seen = F.element_at(F.array(*[F.col(f"__c{f}") for f in range(n)]), at)
    size = F.element_at(F.array(*[F.col(f"__t{f}") for f in range(n)]), at)
    spread = counted.withColumn("run", F.explode(runs)).filter(own | (F.col("__pos") - seen <= size))
    return spread.select(*df.columns, "run", F.when(own, "train").otherwise("valid").alias("side"))


def draw_indices(groups: DataFrame, key: Sequence[str], size: str, m: int, repetitions: int, seed: str) -> DataFrame:
    """For each group and repetition, exactly m of the numbers 0 … size−1 without replacement.

    A row makes its own draws: 2·m + 64 numbers, of which the first m different ones count, a simple
    random sample in random order. Groups up to 2·m in size rank all their numbers instead. Should fewer
    than m of the draws differ, the lowest numbers not drawn follow, so a group never lacks any. Work and
    memory depend on m, not on the size; nothing is shuffled but the groups. Groups smaller than m yield nothing.
    """
    small = F.col(size) <= 2 * m
    # A fixed partition count: the few rows here grow by the draws, which no size estimate sees.
    spread = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = (
        groups.filter(F.col(size) >= m)
        .withColumn("repetition", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1)).cast("array<bigint>")))
        .repartition(spread, *key, "repetition")
    )

    def number(i: Column) -> Column:
        return F.conv(F.substring(order_key(*key, "repetition", i, seed=seed), 1, 15), 16, 10).cast("bigint")

    def upto(n: Column) -> Column:
        return F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)

    ranked = F.transform(F.array_sort(F.transform(upto(F.col(size)), lambda i: F.struct(number(i).alias("at"), i.alias("i")))), lambda x: x["i"])
    drawn = F.transform(upto(F.lit(2 * m + 64)), lambda i: F.pmod(number(i), F.col(size)))
    picked = F.when(small, ranked).otherwise(F.array_distinct(F.concat(drawn, upto(F.lit(m)))))
    return rows.select(*groups.columns, "repetition", F.posexplode(F.slice(picked, 1, m)).alias("draw", "index")).withColumn(
        "draw", (F.col("draw") + 1).cast("bigint")
    )


def pick_number(*parts, size, seed: str):
    """A pick of 0 … size−1 by hash."""
    return F.pmod(key_number(order_key(*parts, seed=seed)), size)
