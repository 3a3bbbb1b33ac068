"""Row-wise work on Arrow batches: every input row gives one output row, in place."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs of about ``limit`` bytes of a text or binary column; a longer value is a run by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(sizes, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1)) if len(part) else np.empty(0, int)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield batch.slice(a, b - a)


def append(
    df: DataFrame, new: str, make: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = (), by_bytes_of: str | None = None
) -> DataFrame:
    """Add the columns of the DDL string ``new``, which ``make`` computes from a batch of whole rows.

    Columns of the input that bear one of the new names (in any case) give way to the new ones;
    those in ``drop`` are read by ``make`` but not returned. With ``by_bytes_of``, a text column, a batch
    is worked on in slices of about a megabyte of it, so what ``make`` holds does not grow with the rows.
    """
    added = T._parse_datatype_string(new)
    taken = {f.name.lower() for f in added.fields}
    df = df.select(*[f"`{c}`" for c in df.columns if c.lower() not in taken])
    gone = {c.lower() for c in drop}
    kept = [i for i, c in enumerate(df.columns) if c.lower() not in gone]
    schema = T.StructType([df.schema.fields[i] for i in kept] + added.fields)
    names = schema.names

    def run(stream):
        for whole in stream:
            for batch in slices(whole, by_bytes_of) if by_bytes_of else (whole,):
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + make(batch), names=names)

    return df.mapInArrow(run, schema)
