"""Lines that repeat across documents go, except in the smallest document that holds them.

Lines are exploded per document and normalised to a key (ASCII white space stripped at both ends,
A-Z lower-cased), keys are hashed with MD5, and the distinct documents of each hash are counted in
two aggregated shuffles, so a very common line never gathers. What a document has to give up comes
back to it as a set of hashes, bounded by its own lines, and its remaining lines are put together
in their order.

Edge cases: null and empty texts are one empty line; keys under ``min_chars`` code points always
stay; a line that repeats within one document only stays; rows that repeat an id are one document
for the count and are each cleaned; rows without an id hold no place in the count and stay as they
are; an empty table stays empty.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.batches import append

_SPACE = b" \t\n\x0b\x0c\r"


def key(line: bytes) -> bytes:
    return line.strip(_SPACE).lower()


def long_enough(line_key: bytes, min_chars: int) -> bool:
    if len(line_key) < min_chars:
        return False
    return line_key.isascii() or sum((b & 0xC0) != 0x80 for b in line_key) >= min_chars


def hashed(line_key: bytes) -> bytes:
    return hashlib.md5(line_key, usedforsecurity=False).digest()


def _texts(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def line_hashes(df: DataFrame, doc_id: str, text: str, min_chars: int) -> DataFrame:
    """(id, hash): a row per document row and distinct long key."""

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        out = []
        for t in _texts(batch, text):
            keys = {key(line) for line in (t or b"").split(b"\n")}
            out.append([hashed(k) for k in keys if long_enough(k, min_chars)])
        return [pa.array(out, pa.list_(pa.binary()))]

    rows = append(df.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), "hashes array<binary>", make, ("t",))
    return rows.select("id", F.explode("hashes").alias("hash")).filter("id IS NOT NULL")


def drops(df: DataFrame, doc_id: str, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """(id, gone): the hashes whose lines a document gives up."""
    held = line_hashes(df, doc_id, text, min_chars).distinct()
    common = held.groupBy("hash").agg(F.count("*").alias("docs"), F.min("id").alias("owner")).filter(F.col("docs") >= min_docs)
    lost = held.join(common, "hash").filter("id > owner")
    return lost.groupBy("id").agg(F.collect_set("hash").alias("gone"))


def dedup(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", min_docs: int = 2, min_chars: int = 10
) -> DataFrame:
    """(id, kept, n_lines, n_dropped) of every row; ``kept`` is the text that remains."""
    gone = drops(df, doc_id, text, min_docs, min_chars).withColumnRenamed("id", "gone__id")
    rows = df.select(F.col(doc_id), F.col(text).alias("t"))
    rows = rows.join(gone, F.col(doc_id) == F.col("gone__id"), "left").select(doc_id, "t", "gone")

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        kept, total, lost = [], [], []
        lists = batch.column(batch.schema.get_field_index("gone")).to_pylist()
        for t, out in zip(_texts(batch, "t"), lists, strict=True):
            lines = (t or b"").split(b"\n")
            stay = lines
            if out:
                dropped = set(out)
                stay = [x for x in lines if not long_enough(k := key(x), min_chars) or hashed(k) not in dropped]
            kept.append(b"\n".join(stay).decode())
            total.append(len(lines))
            lost.append(len(lines) - len(stay))
        return [pa.array(kept, pa.string()), pa.array(total, pa.int64()), pa.array(lost, pa.int64())]

    return append(rows, "kept string, n_lines long, n_dropped long", make, ("t", "gone"))
