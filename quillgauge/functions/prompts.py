"""Prompt rendering and chat message lists as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the system message put before a prompt that has none.
SYSTEM_MESSAGE = "You are a helpful assistant."


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def render(template: Column | str, args: Column | str) -> Column:
    """Replace each ``{{name}}`` of the template by the value the argument map has for it."""
    return F.aggregate(
        F.map_entries(_col(args)),
        _col(template),
        lambda text, e: F.replace(text, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]),
    )


def message(content: Column | str, role: Column | str) -> Column:
    return F.struct(_col(content).alias("content"), _col(role).alias("role"))


def chat_from_text(text: Column | str) -> Column:
    """A rendered prompt as a message list."""
    return chat_envelope(F.array(message(text, F.lit("user"))))


def chat_envelope(messages: Column | str) -> Column:
    """Put the system message first unless the list already starts with one."""
    m = _col(messages)
    system = F.array(message(F.lit(SYSTEM_MESSAGE), F.lit("system")))
    return F.when(m[0]["role"] == "system", m).otherwise(F.concat(system, m))


def extend_chat(previous: Column | str, answer: Column, new_text: Column | str) -> Column:
    """The next turn: the messages so far, the answer to them, and the new user prompt."""
    return F.concat(_col(previous), F.array(answer), F.array(message(new_text, F.lit("user"))))
