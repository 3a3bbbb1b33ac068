"""Answers out of model responses, as column expressions over a whole response table.

A response row has ``text`` and/or ``message`` (struct of role and content) and ``finish_reason``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that mark an answer as a refusal.
EXCLUDED_PHRASES = ("AI language model",)

RESPONSE_SCHEMA = (
    "struct<error: string, usage: struct<total_tokens: bigint>, choices: array<struct<text: string, "
    "message: struct<role: string, content: string>, finish_reason: string>>>"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _mentions_any(text: Column, phrases: Sequence[str]) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.contains(phrase)
    return found


def plain_answer(
    text: Column | str,
    content: Column | str | None = None,
    strip_chars: str = "",
    excluded: Sequence[str] = EXCLUDED_PHRASES,
) -> Column:
    """The whole response as one answer: ``text`` before message content; null when unusable."""
    t = _col(text) if content is None else F.coalesce(_col(text), _col(content))
    if strip_chars:
        t = F.btrim(t, F.lit(strip_chars))
    return F.when((F.length(t) > 0) & ~_mentions_any(t, excluded), t)


def unquote_all(lines: Column, marker: str) -> Column:
    """Drop each line's leading ``marker`` characters, then the quotes around the sentence.

    Text after the last closing quote is lost and an unclosed quote keeps the rest of the line;
    without an opening quote only spaces at the end go.
    """
    # Two steps, so that the pattern runs once per line.
    parts = F.transform(
        lines, lambda line: F.struct(line.alias("raw"), F.regexp_replace(line, f"^[{marker}]+", "").alias("rest"))
    )

    def sentence(part: Column) -> Column:
        raw, rest = part["raw"], part["rest"]
        inner = F.substring(rest, 2, 1 << 30)

        def closed(quote: str) -> Column:
            head = F.regexp_extract(inner, f"(?s)^(.*){quote}", 1)
            return F.when(F.length(head) <= 1, inner).otherwise(head)

        return (
            F.when(rest.startswith('"'), closed('"'))
            .when(rest.startswith("'"), closed("'"))
            .when(rest != "", F.rtrim(rest))
            .when(F.rtrim(raw) == "", raw)
            .otherwise(F.rtrim(raw))
        )

    return F.transform(parts, sentence)


def response_lines(text: Column | str) -> Column:
    """The lines of a response, double line breaks counted once."""
    return F.split(F.replace(_col(text), F.lit("\n\n"), F.lit("\n")), "\n", -1)


def _drop_last_if_cut(answers: Column, finish_reason: Column | str) -> Column:
    size = F.size(answers)
    return F.when(
        _col(finish_reason).eqNullSafe("length"), F.slice(answers, 1, F.greatest(size - 1, F.lit(0)))
    ).otherwise(answers)


def numbered_answers(
    text: Column | str,
    finish_reason: Column | str,
    only_numbered: bool = True,
    excluded: Sequence[str] = EXCLUDED_PHRASES,
) -> Column:
    """The sentences of a numbered list; a response cut for length loses its last one."""

    def keep(line: Column) -> Column:
        ok = ~_mentions_any(line, excluded)
        return (line.rlike(r"^\p{Nd}+[.:)]") & ok) if only_numbered else ok

    lines = F.filter(response_lines(text), keep)
    found = F.filter(unquote_all(lines, r"\p{N}.: )"), lambda s: s != "")
    return _drop_last_if_cut(found, finish_reason)


def paired_answers(text: Column | str, finish_reason: Column | str) -> Column:
    """Pairs out of lines ``1a. …`` and ``1b. …``.

    The newest a and b are held; when both are there the pair is emitted and both are forgotten.
    An empty sentence forgets both. The numbers themselves are not compared.
    """
    pair_type = "array<struct<text: string, other_text: string>>"
    state_type = f"struct<a: string, b: string, pairs: {pair_type}>"
    marker = r"^\p{Nd}+(a+|b+)[.:)]\s?"
    marked = F.filter(response_lines(text), lambda line: line.rlike(marker))
    kinds = F.transform(marked, lambda line: F.substring(F.regexp_extract(line, marker, 1), 1, 1))
    sentences = unquote_all(F.transform(marked, lambda line: F.regexp_replace(line, marker, "")), ".: )")
    items = F.arrays_zip(kinds.alias("kind"), sentences.alias("sentence"))
    nothing = F.lit(None).cast("string")

    def state(a: Column, b: Column, pairs: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"), pairs.alias("pairs")).cast(state_type)

    start = state(nothing, nothing, F.array().cast(pair_type))

    def step(acc: Column, item: Column) -> Column:
        is_a, said = item["kind"] == "a", item["sentence"]
        a = F.when(is_a, said).otherwise(acc["a"])
        b = F.when(is_a, acc["b"]).otherwise(said)
        pair = F.array(F.struct(a.alias("text"), b.alias("other_text")))
        return (
            F.when(said == "", state(nothing, nothing, acc["pairs"]))
            .when(a.isNotNull() & b.isNotNull(), state(nothing, nothing, F.concat(acc["pairs"], pair)))
            .otherwise(state(a, b, acc["pairs"]))
        )

    pairs = F.aggregate(items, start, step, lambda acc: acc["pairs"])
    return _drop_last_if_cut(pairs, finish_reason)


def most_mentioned(text: Column | str, classes: Sequence[str]) -> Column:
    """The class named most often, the first on a tie, ``"None"`` when none is named."""
    t = F.lower(_col(text))

    def mentions(name: str) -> Column:
        needle = name.lower()
        left = F.length(F.replace(t, F.lit(needle), F.lit("")))
        return ((F.length(t) - left) / F.lit(len(needle))).cast("bigint")

    best = F.array_max(
        F.array(*[F.struct(mentions(c).alias("n"), F.lit(-i).alias("rank"), F.lit(c).alias("name")) for i, c in enumerate(classes)])
    )
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit("None"))


def variable_answers(variables: Column | str, prefixes: Sequence[str] = ("OUTPUT",)) -> Column:
    """The non-empty values of the variables whose name starts with one of the prefixes."""

    def wanted(name: Column, _value: Column) -> Column:
        hit = F.lit(False)
        for prefix in prefixes:
            hit = hit | name.startswith(prefix)
        return hit

    values = F.map_values(F.map_filter(_col(variables), wanted))
    flat = F.transform(values, lambda v: F.translate(v, "\u00a0\n", ""))
    return F.filter(flat, lambda v: F.length(v) > 0)


def reply_text(text: Column | str = "text", message: Column | str = "message") -> Column:
    """What a response says: the content of its chat message, else its text."""
    return F.coalesce(_col(message)["content"], _col(text))


def decode_responses(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Decode a log of raw JSON responses: a status, the first choice and the token use.

    ``text`` is the content of a chat reply's message, else the text, so every parser serves both.
    ``error`` answers and undecodable ones are told apart; a missing body counts as an API error.
    """
    body = F.from_json(F.col(raw), RESPONSE_SCHEMA)
    parsed = df.withColumn("__body", body)
    choice = F.col("__body.choices")[0]
    status = (
        F.when(F.col(raw).isNull() | F.col("__body.error").isNotNull(), "api_error")
        .when(choice.isNull() | F.col("__body.usage.total_tokens").isNull(), "parse_error")
        .otherwise("ok")
    )
    good = status == "ok"
    return (
        parsed.withColumn("status", status)
        .withColumn("text", F.when(good, reply_text(choice["text"], choice["message"])))
        .withColumn("message", F.when(good, choice["message"]))
        .withColumn("finish_reason", F.when(good, choice["finish_reason"]))
        .withColumn("total_tokens", F.when(good, F.col("__body.usage.total_tokens")))
        .drop("__body")
    )
