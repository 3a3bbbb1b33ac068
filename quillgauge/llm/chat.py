"""Chats as training text: rendered whole, encoded once, loss masks aligned by offsets.

Every turn is rendered as three marks around its role and its text. The marks are single tokens
added to the tokenizer's vocabulary. In roles and texts every ``<``, ``[`` and ``\\`` is followed by
a ``\\``, so neither a mark nor a control string of a usual template (``</s>``, ``[INST]``) can
stand in them, and taking the ``\\`` away again gives the text back exactly.

A conversation is encoded once with offsets. The assistant texts are sorted spans of the rendered
string; the token range of each is found by binary search in the sorted token offsets.

Edge cases: null roles and texts are empty; turns that are equal are ordered by role and text, null
turns first; rows with a null id are one conversation; a conversation is one training row and must
fit in one; rows that repeat are turns that repeat; an empty table stays empty. Empty assistant
texts have no tokens and add nothing to the loss.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.llm.batches import append

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
MARKS = (TURN, TEXT, END)
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
_SPECIAL = re.compile(r"([<\[\\])")
_ESCAPED = re.compile(r"([<\[\\])\\")
_TURNS = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _SPECIAL.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]], learnt: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the sorted spans of the texts to learn."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = TURN + escape(role) + TEXT, escape(text)
        if role == learnt and body:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(role), unescape(text)) for role, text in _TURNS.findall(formatted)]


def mask(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Marks the tokens that share a character with a span; both sides are sorted."""
    out = np.zeros(len(offsets), bool)
    if spans and len(offsets):
        first = np.searchsorted(offsets[:, 1], [a for a, _ in spans], "right")
        last = np.searchsorted(offsets[:, 0], [b for _, b in spans], "left")
        for a, b in zip(first, last, strict=True):
            out[a:b] = True
    return out


def masked_text(formatted: str, offsets: list[tuple[int, int]], loss: list[bool]) -> str:
    """All text under the mask, unescaped; a character of several tokens counts once."""
    pieces, at = [], 0
    for (a, b), on in zip(offsets, loss, strict=True):
        if on and b > at:
            pieces.append(formatted[max(a, at) : b])
            at = b
    return unescape("".join(pieces))


def load_tokenizer(content: str):
    from tokenizers import AddedToken, Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    made = Tokenizer.from_str(content)
    made.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in MARKS])
    return made


def conversations(df: DataFrame) -> DataFrame:
    """(conv_id, turns): rows of (conv_id, turn, role, text) gathered in order."""
    rows = df.select("conv_id", "turn", "role", "text")
    return rows.groupBy("conv_id").agg(F.expr("array_sort(collect_list(struct(turn IS NOT NULL AS told, turn, coalesce(role, '') AS role, coalesce(text, '') AS text)))").alias("turns"))


_OUT = "formatted string, token_ids array<int>, token_starts array<int>, token_ends array<int>, loss array<boolean>"


def format_chats(df: DataFrame, tokenizer: str = TOKENIZER, learnt: str = "assistant") -> DataFrame:
    """(conv_id, formatted, token_ids, token_starts, token_ends, loss) of every conversation.

    ``tokenizer`` is the path of a tokenizer file that the driver can read; its content, a few
    megabytes, goes to the executors.
    """
    with open(tokenizer, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())
    cache: list = []

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        if not cache:
            cache.append(load_tokenizer(content.value))
        columns: list[list] = [[], [], [], [], []]
        for turns in batch.column(batch.schema.get_field_index("turns")).to_pylist():
            formatted, spans = render([(t["role"], t["text"]) for t in turns], learnt)
            code = cache[0].encode(formatted, add_special_tokens=False)
            offsets = np.array(code.offsets, np.int32).reshape(-1, 2)
            values = (formatted, code.ids, offsets[:, 0], offsets[:, 1], mask(offsets, spans))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        ints, flags = pa.list_(pa.int32()), pa.list_(pa.bool_())
        return [pa.array(c, t) for c, t in zip(columns, (pa.string(), ints, ints, ints, flags), strict=True)]

    return append(conversations(df), _OUT, make, ("turns",))
