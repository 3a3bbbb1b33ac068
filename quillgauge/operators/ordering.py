"""Row numbers and running totals that never gather a whole group in one task.

A plain ``row_number() over (partition by dataset order by id)`` sends a dataset to one task,
however large it is. Here each group is cut into buckets that follow the wanted order. Per-bucket
totals are aggregated with map-side combine, a window over the few bucket rows gives every bucket
its start, and the rows are then numbered inside their bucket only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.functions.keys import id_bucket, key_bucket, order_key

_BUCKET = "__bucket"
_GROUP = "__group"


def _starts(per_bucket: DataFrame, keys: list[str], levels: list[str], sums: list[str], totals: dict[str, str]) -> DataFrame:
    """What comes before each bucket; windows reach over the buckets of one next coarser bucket."""
    outer = [*keys, *levels[1:2]]
    before = Window.partitionBy(*outer).orderBy(levels[0]).rowsBetween(Window.unboundedPreceding, -1)
    inner = {n: F.coalesce(F.sum(f"__n_{n}").over(before), F.lit(0)) for n in sums}
    if len(levels) == 1:
        whole = Window.partitionBy(*keys)
        return per_bucket.select(
            *keys,
            *levels,
            *[start.alias(f"__s_{n}") for n, start in inner.items()],
            *[F.sum(f"__n_{n}").over(whole).alias(total) for total, n in totals.items()],
        )
    coarse = per_bucket.groupBy(*keys, *levels[1:]).agg(*[F.sum(f"__n_{n}").alias(f"__n_{n}") for n in sums])
    above = _starts(coarse, keys, levels[1:], sums, totals).select(*outer, *[F.col(f"__s_{n}").alias(f"__a_{n}") for n in sums], *totals)
    here = per_bucket.select(*keys, *levels, *[start.alias(f"__s_{n}") for n, start in inner.items()])
    return here.join(above, outer).select(
        *keys, *levels, *[(F.col(f"__s_{n}") + F.col(f"__a_{n}")).alias(f"__s_{n}") for n in sums], *totals
    )


def running_totals(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    sums: dict[str, Column],
    totals: dict[str, str] | None = None,
    start_below: tuple[str, int] | None = None,
    coarser: Sequence[Column] = (),
) -> DataFrame:
    """Add inclusive running sums per ``part`` in ``order``.

    ``bucket`` must be monotone in ``order``; together, ``part``, ``bucket`` and ``order`` must
    name one row. The part columns must not be null. ``totals`` maps a new column to the name of
    the sum whose group total it holds. ``start_below=(name, limit)`` drops, before any row is
    shuffled, the buckets whose running sum already reaches the limit. ``coarser`` are buckets of
    the buckets, from fine to coarse, for groups with too many buckets for one window.
    """
    keys = list(part)
    # One call for all columns: every call analyses the whole plan again.
    new = {_BUCKET: bucket} | {f"__v_{name}": value.cast("bigint") for name, value in sums.items()}
    if not keys:
        keys, new[_GROUP] = [_GROUP], F.lit(0)
    levels = [_BUCKET, *[f"{_BUCKET}{i}" for i in range(1, len(coarser) + 1)]]
    keyed = df.withColumns(new | dict(zip(levels[1:], coarser, strict=True)))
    per_bucket = keyed.groupBy(*keys, *levels).agg(
        *[F.sum(f"__v_{name}").alias(f"__n_{name}") for name in sums]
    )
    starts = _starts(per_bucket, keys, levels, list(sums), totals or {}).drop(*levels[1:])
    keyed = keyed.drop(*levels[1:])
    if start_below is not None:
        name, limit = start_below
        starts = starts.filter(F.col(f"__s_{name}") < limit)
    inside = (
        Window.partitionBy(*keys, _BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    kept = [F.col(c) for c in df.columns if c not in sums]
    running = [(F.sum(f"__v_{n}").over(inside) + F.col(f"__s_{n}")).alias(n) for n in sums]
    return keyed.join(starts, [*keys, _BUCKET]).select(*kept, *running, *(totals or {}))


def number_rows(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[str],
    bucket: Column,
    name: str = "position",
    total: str | None = None,
    at_most: int | None = None,
    coarser: Sequence[Column] = (),
) -> DataFrame:
    """Number the rows of each group from 1; keep only the first ``at_most`` when given."""
    out = running_totals(
        df,
        part,
        order,
        bucket,
        {name: F.lit(1)},
        totals={total: name} if total else None,
        start_below=(name, at_most) if at_most is not None else None,
        coarser=coarser,
    )
    return out if at_most is None else out.filter(F.col(name) <= at_most)


def number_by_id(df: DataFrame, part: Sequence[str], row_id: str = "row_id", width: int = 1 << 16, dense: bool = True, **kw) -> DataFrame:
    """Number rows in the order of a unique integer id.

    Dense ids fill their buckets. For ids of any kind, hashes for instance, ``dense=False`` cuts the
    64 bits into four levels, so that no window reaches over more than 65536 rows or buckets.
    """
    if dense:
        return number_rows(df, part, [row_id], id_bucket(row_id, width), **kw)
    level = [F.shiftright(F.col(row_id).cast("bigint"), bits) for bits in (16, 32, 48)]
    return number_rows(df, part, [row_id], level[0], coarser=level[1:], **kw)


def number_by_hash(
    df: DataFrame, part: Sequence[str], row_id: str = "row_id", seed: str = "42", digits: int = 3, **kw
) -> DataFrame:
    """Number rows in a random order that depends on the id and the seed only."""
    keyed = df.withColumn("__key", order_key(row_id, seed=seed))
    return number_rows(keyed, part, ["__key", row_id], key_bucket("__key", digits), **kw).drop("__key")
