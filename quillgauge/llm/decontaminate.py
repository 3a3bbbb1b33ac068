"""Benchmark passages in documents: one Aho-Corasick automaton, one scan of each text.

A text is a run of words: bytes 0-9, a-z (A-Z lower-cased) and everything beyond ASCII; all else
parts words. A passage is ``width`` consecutive words of an item, or the whole item where it is
shorter. The passages, with a blank at both ends, are the automaton's patterns; a document's words,
joined by single blanks, are scanned once. Every document word inside an occurrence is hit, and runs
of hit words are mapped back to code point offsets of the text as given.

The benchmark is the broadcast side. It is read in blocks of at most ``block_bytes`` of passages;
each block is an automaton of its own and a further pass over the documents, so neither the driver
nor a task ever holds more than a block, however large the benchmark is. An automaton takes about 45
times the bytes of its passages: some 400 MB for a full block of the default size.

Edge cases: null and empty texts have no words and are clean; an item that is null or has no word
has no passage; an item without an id hits words but is not named; items with equal passages are all named; an item that repeats counts once; rows that
repeat are judged one by one; without items all documents are clean; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.batches import append
from quillgauge.session import stored

_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_BLANK = 32
Passages = dict[bytes, tuple[int, set[str]]]


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def passages(text: bytes, width: int) -> Iterator[tuple[bytes, int]]:
    """The passages of an item with their number of words."""
    own = words(text)
    n = min(width, len(own))
    for i in range(len(own) - n + 1 if n else 0):
        yield b" ".join(own[i : i + n]), n


def blocks(items: DataFrame, item_id: str, text: str, width: int, block_bytes: int) -> Iterator[Passages]:
    """The passages of all items in blocks of bounded size."""
    block: Passages = {}
    used = 0
    rows = items.select(F.col(item_id).cast("string"), F.col(text).cast("binary")).filter(F.col(text).isNotNull())
    for name, data in rows.toLocalIterator():
        for passage, n in passages(bytes(data), width):
            if passage not in block:
                block[passage] = (n, set())
                used += len(passage)
            if name is not None:
                block[passage][1].add(name)
            if used >= block_bytes:
                yield block
                block, used = {}, 0
    if block:
        yield block


def automaton(block: Passages) -> ahocorasick.Automaton | None:
    if not block:
        return None
    made = ahocorasick.Automaton()
    for passage, (n, names) in block.items():
        # Latin-1 keeps one character per byte.
        made.add_word(f" {passage.decode('latin-1')} ", (n, names))
    made.make_automaton()
    return made


def search(text: bytes, made: ahocorasick.Automaton | None) -> tuple[int, np.ndarray, set[str]]:
    """Number of words, hit words as a mask (empty without a hit), names of the items found."""
    own = words(text)
    if not own or made is None:
        return len(own), np.empty(0, bool), set()
    line = b" %b " % b" ".join(own)
    found = list(made.iter(line.decode("latin-1")))
    if not found:
        return len(own), np.empty(0, bool), set()
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == _BLANK)
    after = np.searchsorted(blanks, [end for end, _ in found])
    edge = np.zeros(len(own) + 1, np.int64)
    np.add.at(edge, after - [n for _, (n, _) in found], 1)
    np.add.at(edge, after, -1)
    return len(own), np.cumsum(edge)[:-1] > 0, set().union(*(names for _, (_, names) in found))


def spans(text: bytes, hit: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans, end exclusive, of the runs of hit words."""
    inside = np.frombuffer(text.translate(_FOLD), np.uint8) != _BLANK
    step = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    point = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    run = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    first, last = np.flatnonzero(run == 1), np.flatnonzero(run == -1) - 1
    return [(int(point[begin[a]]), int(point[end[b]])) for a, b in zip(first, last, strict=True)]


_STATE = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>, hits binary"


def scan(
    df: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    width: int = 10,
    block_bytes: int = 8 << 20,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``n_words, n_hit, items`` (names, sorted as strings) and ``spans`` to every row."""
    context = df.sparkSession.sparkContext
    return _passes(df, blocks(items, item_id, item_text, width, block_bytes), context, text, drop)


def _passes(df: DataFrame, found: Iterable[Passages], context, text: str, drop: tuple[str, ...]) -> DataFrame:
    found = iter(found)
    block, old = next(found, {}), False
    while True:
        following = next(found, None)
        df = _one_pass(df, context.broadcast(block), text, drop if following is None else (), old)
        if following is None:
            return df.drop("hits")
        df, block, old = stored(df, "scan"), following, True


def _one_pass(df: DataFrame, block, text: str, drop: tuple[str, ...], old: bool) -> DataFrame:
    if old:  # what earlier passes found
        df = df.withColumnsRenamed({"hits": "old__hits", "items": "old__items"})
        drop = (*drop, "old__hits", "old__items")
    cache: list = []

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            cache.append(automaton(block.value))
        rows = []
        texts = batch.column(batch.schema.get_field_index(text)).cast(pa.binary()).to_pylist()
        before = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("old__hits", "old__items")] if old else None
        for i, data in enumerate(texts):
            data = data or b""
            n, hit, names = search(data, cache[0])
            if before and before[0][i]:
                earlier = np.unpackbits(np.frombuffer(before[0][i], np.uint8), count=n).astype(bool)
                hit = hit | earlier if len(hit) else earlier
                names = names | set(before[1][i])
            rows.append((n, int(hit.sum()), sorted(names), spans(data, hit) if len(hit) else [], np.packbits(hit).tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
        columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        columns[3] = [[{"start": a, "end": b} for a, b in x] for x in columns[3]]
        return [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]

    return append(df, _STATE, make, drop)


def clean(df: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``df`` without any hit word, with the columns of ``df``."""
    # Own names for what is added, so that no column of the input gives way.
    names = [f"__own_{i}" for i in range(len(df.columns))]
    text = how.pop("text", "text")
    renamed = df.toDF(*names)
    out = scan(renamed, items, text=names[df.columns.index(text)], **how)
    return out.filter("n_hit = 0").select(*names).toDF(*df.columns)
