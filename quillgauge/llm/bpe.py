"""Byte-level BPE: whole texts to token ids and ids back to bytes, with the tiktoken library.

The rank file is read by the driver and broadcast (a megabyte); every worker process builds one
encoding from it. tiktoken gets a text in pieces of about ``piece`` characters, so that its regular
expression never sees a very long string. A text may be cut at two kinds of places without changing
any match of the pattern:

* between a character and white space after it: no match goes on from other characters into white
  space, and the only look-ahead stands at the end of a run of white space;
* before the last character of a run of white space: what is before it is one match of its own, and
  the last one is matched with what follows.

A run of more than ``piece`` white space characters is one match and is merged as one, without the
expression, whose look-ahead would need as much stack. Other long runs need no cut.

Decoding joins the raw bytes of the ids. Bytes of single tokens need not be UTF-8; the joined bytes of
an encoded text are exactly the text's.

Edge cases: a null text is empty and has no ids; strings that look like special tokens are ordinary
text; null ids decode to no bytes, and an id without a rank adds none; rows that repeat get equal
ids; columns of the input named like an added one, in any case, give way; an empty table stays empty.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from quillgauge.llm.batches import append

# Fixed value: the pattern whose matches are merged separately.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE = 1 << 15
_ROWS = 64
_BEFORE_SPACE = regex.compile(r"\P{White_Space}\p{White_Space}")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """A rank file: lines of a token in base64 and its rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines()) if token}


def encoding(ranks: dict[bytes, int]) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, piece: int = PIECE) -> Iterator[tuple[str, bool]]:
    """The text cut at safe places; True marks a piece that is a single match of white space."""
    if len(text) <= piece:
        yield text, False
        return
    runs = regex.compile(rf"\p{{White_Space}}{{{piece + 1},}}")
    at = 0
    for run in runs.finditer(text):
        yield from ((p, False) for p in _between(text, at, run.start(), piece))
        at = run.end() if run.end() == len(text) else run.end() - 1
        yield text[run.start() : at], True
    yield from ((p, False) for p in _between(text, at, len(text), piece))


def _between(text: str, at: int, end: int, piece: int) -> Iterator[str]:
    """Pieces of a stretch that begins and ends at safe places."""
    while end - at > piece:
        found = _BEFORE_SPACE.search(text, at + piece - 1, end)
        cut = found.start() + 1 if found else end
        yield text[at:cut]
        at = cut
    if at < end:
        yield text[at:end]


def ids_of(own: tiktoken.Encoding, text: str, piece: int = PIECE) -> np.ndarray:
    """The token ids of a whole text."""
    parts = [
        np.array(own._encode_single_piece(p), np.uint32) if single else own.encode_to_numpy(p, disallowed_special=())
        for p, single in pieces(text, piece)
    ]
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])


def encode(df: DataFrame, text: str = "text", ranks: str = RANKS, piece: int = PIECE, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``ids array<int>`` to every row; ``ranks`` is a path that the driver can read."""
    with open(ranks, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    cache: list = []

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            cache.append(encoding(read_ranks(content.value)))
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        found = [ids_of(cache[0], t or "", piece) for t in texts]
        ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
        flat = np.concatenate([np.empty(0, np.uint32), *found]).astype(np.int32)
        return [pa.ListArray.from_arrays(ends, pa.array(flat))]

    return append(df, "ids array<int>", make, drop, text)


def decode(df: DataFrame, ids: str = "ids", ranks: str = RANKS, drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``decoded binary``, the bytes of the ids, to every row."""
    with open(ranks, "rb") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    cache: list = []

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            cache.append({rank: token for token, rank in read_ranks(content.value).items()})
        lists = batch.column(batch.schema.get_field_index(ids))
        out = []
        for at in range(0, len(lists), _ROWS):
            out += [b"".join([cache[0].get(i, b"") for i in own or ()]) for own in lists.slice(at, _ROWS).to_pylist()]
        return [pa.array(out, pa.binary())]

    return append(df, "decoded binary", make, drop)
