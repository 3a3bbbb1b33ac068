"""Mixing sources to target weights by weighted sampling without replacement.

Sources in code point order, null last, weigh ``weights`` in turn and share all words; a target
stops at ``most`` times its source's size, and what is over is shared among the others by weight.
With S the sizes, w the weights and T all words, the targets are min(most*S, L*w), where the level L
follows from the sources in order of S/w.

A source gives whole documents. Its target holds a number of complete epochs, in which every
document is taken once, and a rest. For the rest every document has an Efraimidis-Spirakis key,
an exponential variate divided by the document's quality; documents are taken by rising key while
the middle of the document lies within the rest, so the words taken end nearest to the target.

Keys fall into buckets that follow their order: a key's bucket is the share of the source's keys
expected below it, by the number of its documents of each quality. Bucket sums are aggregated before
the shuffle, and only the one bucket per source in which the rest ends is sorted: about
``bucket_rows`` rows, however large the source and however its qualities are spread. What comes out is one row per source
with the key at which its rest ends, so every row tells by itself how often it is taken: the table of
sources joins by the size Spark measured in storage, and texts are never shuffled.

A key is made of id, text and source. Rows that agree in all three are copies with equal keys; they are
folded before the sort and, where the rest ends among them, numbered in buckets of their own, so neither
null ids nor copies gather anywhere.

Edge cases: null and empty texts have size 0 and are taken for 0 words, and so is everything in an
empty mix; null sources are one source; null ids are told apart by their texts; equal keys are ordered
by size; rows that repeat are documents of their own; a quality that is null or not above 0 counts as 1;
a single document larger than the rest is taken if its middle lies within the rest; very long texts are
only counted and hashed; ``mixed`` keeps all columns whatever their names, ``mix`` takes over the id only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.operators.ordering import number_rows
from quillgauge.session import stored

WORD = r"[^\x20\x09-\x0D]+"
_BITS = 52
# The values ``quality`` can have.
QUALITIES = (0.25, 0.5, 0.75, 1.0)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column, size: Column) -> Column:
    """Half for a usual word length (3 to 10 characters), a quarter for a usual size, a quarter for all."""
    length = F.coalesce(F.char_length(text), F.lit(0)) / F.greatest(size, F.lit(1))
    return (
        F.lit(0.25)
        + F.when(size.between(50, 100000), 0.25).otherwise(0.0)
        + F.when(length.between(3, 10), 0.5).otherwise(0.0)
    )


def identity(doc_id: Column, text: Column, source: Column) -> Column:
    """What tells one document from another: rows that agree in it are copies, and interchangeable."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, F.md5(text), source)]
    return F.concat_ws("|", *parts)


def order_key(name: Column, weight: Column, seed: str) -> Column:
    """An exponential variate with rate ``weight``, made of the name of a document and the seed."""
    digest = F.md5(F.concat_ws("|", F.coalesce(name.cast("string"), F.lit("")), F.lit(seed)))
    number = F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("double")
    rate = F.when(weight > 0, weight).otherwise(1.0)
    return -F.ln((number + 0.5) / float(2**_BITS)) / rate


def key_share(key: Column, n: Column, counts: list[Column]) -> Column:
    """The share of ``n`` keys expected below ``key``, from their counts by quality; it rises with the key."""
    below = [c * (1 - F.exp(-rate * key)) for rate, c in zip(QUALITIES, counts, strict=True)]
    return reduce(Column.__add__, below) / n


def targets(sources: DataFrame, weights: tuple[float, ...], most: int) -> DataFrame:
    """Add ``target`` to (source, source_size, ...), a row per source.

    The windows run over one row per source, sums over all documents of it.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    full = F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = weighed.withColumn("level", full.cast("double") / F.sum("weight").over(after))
    open_ = F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("level"))
    # The first source in order that stays below its stop gives the level of all that follow.
    settled = level.withColumn("level", F.first(open_, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    stop = (most * F.col("source_size")).cast("double")
    return settled.withColumn("target", F.coalesce(F.least(stop, F.col("level") * F.col("weight")), stop)).drop("level", "weight")


def sized(df: DataFrame, doc_id: str, text: str, source: str, seed: str) -> DataFrame:
    """Add ``size``, ``quality`` and ``key`` to every row."""
    t = F.col(text)
    own = df.withColumn("size", words(t)).withColumn("quality", quality(t, F.col("size")))
    return own.withColumn("key", order_key(identity(F.col(doc_id), t, F.col(source)), F.col("quality"), seed))


def cuts(keyed: DataFrame, weights: tuple[float, ...], most: int, bucket_rows: int) -> DataFrame:
    """One row per source with its target, its epochs, and where the rest ends among its keys.

    ``keyed`` has (source, size, quality, key). Whole buckets below ``last`` are taken for the rest, and of
    ``last`` the rows up to the (key, size) ``cut``; of the ``copies`` rows at the cut, equal in all that
    counts, ``some`` are taken.
    """
    by_quality = [F.count_if(F.col("quality") == q).alias(f"n_{i}") for i, q in enumerate(QUALITIES)]
    sums = keyed.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *by_quality)
    plan = targets(sums, weights, most).withColumn("epochs", F.floor(F.col("target") / F.greatest("source_size", F.lit(1))))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = stored(plan.withColumn("buckets", F.ceil(F.col("n") / bucket_rows)).withColumnRenamed("source", "p_source"), "targets")
    placed = keyed.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("bucket", bucket())
    totals = placed.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = totals.withColumn("end", F.sum("words").over(upto))
    # The first bucket whose words do not all fit; below it all are taken, beyond it none.
    least = F.min(F.struct("bucket", (F.col("end") - F.col("words")).alias("start"))).alias("x")
    last = stored(ends.filter(F.col("end") > F.col("rest")).groupBy(F.col("source").alias("l_source")).agg(least), "bounds")
    inside = placed.join(last, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("bucket") == F.col("x.bucket")))
    # Copies are folded before they are sorted, so the window has about ``bucket_rows`` rows.
    folded = inside.groupBy("source", "key", "size").agg(F.count("*").alias("copies"), F.first("rest").alias("rest"), F.first("x.start").alias("start"))
    before = Window.partitionBy("source").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("rest") - F.col("start") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(before), F.lit(0))
    # As many copies as have their middle within the room.
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size") + 0.5)).otherwise(F.when(room >= 0, F.col("copies")).otherwise(0))
    some = F.least(F.greatest(fit.cast("long"), F.lit(0)), F.col("copies"))
    cut = folded.withColumn("some", some).filter("some > 0").groupBy(F.col("source").alias("c_source")).agg(
        F.max(F.struct("key", "size", "some", "copies")).alias("cut")
    )
    known = plan.join(last, F.col("p_source").eqNullSafe(F.col("l_source")), "left").join(cut, F.col("p_source").eqNullSafe(F.col("c_source")), "left")
    counts = [f"n_{i}" for i in range(len(QUALITIES))]
    return stored(known.select("p_source", "source_size", "target", "epochs", "rest", "n", *counts, "buckets", F.col("x.bucket").alias("last"), "cut"), "cuts")


def bucket() -> Column:
    share = key_share(F.col("key"), F.col("n"), [F.col(f"n_{i}") for i in range(len(QUALITIES))])
    return F.floor(share * F.col("buckets"))


def repeated(keyed: DataFrame, plan: DataFrame) -> DataFrame:
    """Add ``repeats`` and the columns of ``plan`` to rows with (source, size, quality, key).

    Every row tells from its own key how often it is taken. Only where a cut falls among copies, these
    are numbered, in buckets of their places, and the first of them taken.
    """
    at_cut = F.struct(F.col("key"), F.col("size"))
    cut = F.struct(F.col("cut.key").alias("key"), F.col("cut.size").alias("size"))
    some = F.coalesce((F.col("bucket") == F.col("last")) & (at_cut == cut) & (F.col("cut.some") < F.col("cut.copies")), F.lit(False))
    below = F.when(F.col("last").isNull() | (F.col("bucket") < F.col("last")), True).otherwise(
        (F.col("bucket") == F.col("last")) & F.coalesce(at_cut <= cut, F.lit(False))
    )
    placed = keyed.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).withColumn("bucket", bucket())
    told = placed.withColumn("__some", some).withColumn("more", below)
    if not plan.filter("cut.some < cut.copies").isEmpty():
        place = F.monotonically_increasing_id()
        tied = stored(told.filter("__some").withColumn("__place", place).withColumn("__of", F.hash("p_source", "cut")), "tied")
        bits = [F.shiftright("__place", n) for n in (13, 33)]
        numbered = number_rows(tied, ["__of"], ["__place"], bits[0], "__number", coarser=bits[1:])
        numbered = numbered.withColumn("more", F.col("__number") <= F.col("cut.some")).select(*told.columns)
        told = told.filter("NOT __some").unionByName(numbered)
    repeats = F.col("epochs") + F.when(F.col("more") & (F.col("rest") > 0), 1).otherwise(0)
    return told.withColumn("repeats", repeats.cast("long"))


def mix(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    seed: str = "mix",
    bucket_rows: int = 8192,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, repeats, taken) of every row."""
    base = df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    keyed = stored(sized(base, "doc_id", "text", "source", seed).drop("text"), "sizes")
    out = repeated(keyed, cuts(keyed, weights, most, bucket_rows))
    return out.select("doc_id", "source", "size", "source_size", "target", "repeats", (F.col("repeats") * F.col("size")).alias("taken"))


def mixed(
    df: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    most: int = 3,
    seed: str = "mix",
    bucket_rows: int = 8192,
) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it, with the columns of ``df``; no text is shuffled."""
    # Own names for the columns of the input, so that none of them meets one of the mix.
    names = [f"__own_{i}" for i in range(len(df.columns))]
    own = dict(zip(df.columns, names, strict=True))
    keyed = sized(df.toDF(*names), own[doc_id], own[text], own[source], seed).withColumn("source", F.col(own[source]))
    plan = cuts(stored(keyed.select("source", "size", "quality", "key"), "sizes"), weights, most, bucket_rows)
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("__copy")
    return repeated(keyed, plan).filter("repeats > 0").select(*names, copies).select(*names).toDF(*df.columns)
