"""Near copies by SimHash: fingerprints at most ``radius`` bits apart, found by ball hashing.

A fingerprint has bit b set if over half of a text's shingle hashes have it set. Two fingerprints
within a radius of 2 share a fingerprint within 1 of both: every distinct fingerprint therefore
emits itself and its 64 neighbours, rows meet on equal variants, and the pairs found are verified.
All members of one variant are within 1 of it, hence at most 65 and pairwise linked, so a chain
through the sorted members keeps every connection without listing the pairs. Copies are folded into
one row per fingerprint first, however many there are; no link or fingerprint reaches the driver.

Edge cases: null texts and texts without words have fingerprint zero and link like any other;
texts of fewer words than a shingle are one shingle; rows that repeat are members of one class;
a null id never names a component unless all its members have null ids, and of each such component a row
stays; very long texts are hashed in blocks; ``one_of_each`` keeps all columns of the input, whatever
their names, and in ``near_copies`` only the id is taken over; an empty table stays empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgauge.llm.batches import append
from quillgauge.session import stored

BITS = 64


def fingerprint(text: bytes, width: int = 3, seed: int = 42) -> int:
    """The fingerprint of a text; words are parted by ASCII white space, A-Z are lower-cased."""
    own = text.lower().split()
    if not own:
        return 0
    ends = [own[i:] for i in range(min(width, len(own)))]
    shingles = map(b" ".join, zip(*ends, strict=False)) if len(own) >= width else [b" ".join(own)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, seed) for s in shingles), np.dtype("<u8"))
    ones = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        block = hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", width: int = 3, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add the fingerprint as a signed long."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        found = np.array([fingerprint(t or b"", width) for t in texts], np.uint64)
        return [pa.array(found.view(np.int64))]

    return append(df, f"`{name}` long", make, drop)


def links(classes: DataFrame, name: str = "fingerprint") -> DataFrame:
    """Distinct links (a, b) between distinct fingerprints at most 2 bits apart, as chains.

    Two fingerprints are connected by the chains exactly if links at most 2 bits long connect them.
    """
    own = F.col(name)
    flips = F.array(F.lit(0).cast("long"), *[F.expr(f"shiftleft(1L, {b})") for b in range(BITS)])
    variants = classes.select(own.alias("b"), F.explode(flips).alias("flip")).select("b", F.col("b").bitwiseXOR(F.col("flip")).alias("variant"))
    chain = variants.withColumn("a", F.lag("b").over(Window.partitionBy("variant").orderBy("b")))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    return chain.filter(F.col("a").isNotNull() & near).select("a", "b").distinct()


def components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root) of every node with a link: root is the smallest node of its component.

    Alternates large and small stars: each round hangs the neighbours of a node on the smallest of
    them, until nothing moves. Minima are aggregated before the shuffle and joined back, so a node
    with many links is never gathered; every round is written to the shared folder.
    """
    edges, before = stored(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "links"), None
    mark = F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
    for _ in range(rounds):
        # Large star: every larger neighbour hangs on the smallest one.
        both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi")))
        least = both.groupBy("lo").agg(F.min("hi").alias("m")).select("lo", F.least("lo", "m").alias("m"))
        large = both.filter("hi > lo").join(least, "lo").select(F.col("m").alias("lo"), "hi").distinct()
        # Small star: a node and its smaller neighbours hang on the smallest.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        pulled = large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
        edges = stored(pulled.filter("lo < hi").distinct(), "star")
        now = edges.agg(F.count("*"), mark).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))
    return roots.unionByName(edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")))


def label(marked: DataFrame, doc_id: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """Add ``component_id``: the smallest id among all rows reachable over links."""
    classes = stored(marked.groupBy(name).agg(F.min(doc_id).alias("first_id")), "classes")
    found = components(links(classes, name))
    rooted = classes.join(found, classes[name] == found["node"], "left").select(
        F.col(name), "first_id", F.coalesce("root", name).alias("root")
    )
    rooted = stored(rooted, "roots")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(first, "root").select(F.col(name).alias("__fp"), "component_id")
    kept = [F.col(c) for c in marked.columns if c.lower() != "component_id"]
    return marked.join(named, F.col(name) == F.col("__fp")).select(*kept, "component_id")


def near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    marked = fingerprints(df.select(F.col(doc_id), F.col(text)), text, drop=(text,))
    return label(stored(marked, "fingerprints"), doc_id)


def first_of_each(kept: DataFrame, found: DataFrame, df: DataFrame, doc_id: str, name: str) -> DataFrame:
    """One row of every component, with the columns of ``df``.

    ``kept`` is ``df`` as stored with a number ``__rid`` per row and its class ``name``, ``found`` the
    (node, root) of linked classes. The row with the smallest id stays; of rows that repeat it, or if
    all ids are null, the one that sorts first by all sortable columns. Texts move by row number.
    """
    rooted = kept.select("__rid", F.col(doc_id).alias("__id"), name).join(found, F.col(name) == F.col("node"), "left")
    rooted = stored(rooted.select("__rid", "__id", F.coalesce("root", name).alias("__root")), "rooted")
    first = rooted.groupBy(F.col("__root").alias("__r")).agg(F.min("__id").alias("__first"))
    chosen = rooted.join(first, (F.col("__root") == F.col("__r")) & F.col("__id").eqNullSafe(F.col("__first"))).select("__rid", "__root")
    counts = chosen.groupBy(F.col("__root").alias("__r")).agg(F.count("*").alias("__of"))
    chosen = stored(chosen.join(counts, F.col("__root") == F.col("__r")).select("__rid", "__root", "__of"), "chosen")
    columns = [F.col(f"`{c}`") for c in df.columns]
    rest = [F.col(f"`{c}`") for c, t in df.dtypes if c != doc_id and "map<" not in t and "variant" not in t]
    alone = kept.join(chosen.filter("__of = 1"), "__rid", "left_semi").select(*columns)
    among = kept.join(chosen.filter("__of > 1").select("__rid", "__root"), "__rid")
    picked = among.groupBy("__root").agg(F.min_by(F.struct(*columns), F.struct(F.lit(0), *rest)).alias("__row"))
    return alone.unionByName(picked.select("__row.*"))


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near copies, as ``first_of_each`` chooses it, with the columns of ``df``."""
    # Own names for the columns of the input, so that none of them gives way.
    names = [f"__own_{i}" for i in range(len(df.columns))]
    renamed, own = df.toDF(*names), dict(zip(df.columns, names, strict=True))
    numbered = renamed.withColumn("__rid", F.monotonically_increasing_id())
    kept = stored(fingerprints(numbered, own[text], "__fp"), "fingerprints")
    found = components(links(kept.select("__fp").distinct(), "__fp"))
    return first_of_each(kept, found, renamed, own[doc_id], "__fp").toDF(*df.columns)
