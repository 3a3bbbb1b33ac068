"""The text expressions as temporary SQL functions, for use from ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from quillgauge.functions.extract import EXCLUDED_PHRASES
from quillgauge.functions.text import WHITESPACE

# The sentence of a line, given as (raw, rest): without its marker and the quotes around it.
_SENTENCE = r"""CASE
  WHEN startswith(p.rest, '"') THEN if(length(regexp_extract(substring(p.rest, 2), r'(?s)^(.*)"', 1)) <= 1,
    substring(p.rest, 2), regexp_extract(substring(p.rest, 2), r'(?s)^(.*)"', 1))
  WHEN startswith(p.rest, "'") THEN if(length(regexp_extract(substring(p.rest, 2), r"(?s)^(.*)'", 1)) <= 1,
    substring(p.rest, 2), regexp_extract(substring(p.rest, 2), r"(?s)^(.*)'", 1))
  WHEN p.rest <> '' THEN rtrim(p.rest)
  WHEN rtrim(p.raw) = '' THEN p.raw
  ELSE rtrim(p.raw) END"""


def register(spark: SparkSession) -> list[str]:
    """Create ``clean_text``, ``token_array``, ``numbered_lines``, ``extract_numbered`` and ``numbered_rows``; return their names.

    ``extract_numbered(text, finish_reason)`` gives the sentences of a numbered list, and the table function
    ``numbered_rows(text, finish_reason)`` gives them as rows (answer_idx, answer), for a lateral join.
    """
    ws = WHITESPACE
    refusal = " OR ".join(f"contains(x, '{phrase}')" for phrase in EXCLUDED_PHRASES)
    parts = r"transform(filter(numbered_lines(t), x -> NOT (REFUSAL)), x -> named_struct('raw', x, 'rest', regexp_replace(x, r'^[\p{N}.: )]+', '')))"
    found = f"filter(transform({parts.replace('REFUSAL', refusal)}, p -> {_SENTENCE}), s -> s <> '')"
    bodies = {
        "clean_text": (
            "STRING",
            "regexp_replace(regexp_replace(regexp_replace(regexp_replace("
            f"lower(t), r'([a-z])-([a-z])', '$1 $2'), r'[^a-z{ws}]', ''), r'[{ws}]{{2,}}', ' '), "
            f"r'^[{ws}]+|[{ws}]+$', '')",
        ),
        "token_array": ("ARRAY<STRING>", "split(regexp_replace(t, '[^a-zA-Z ]', ''), ' ', -1)"),
        "numbered_lines": (
            "ARRAY<STRING>",
            r"filter(split(replace(t, '\n\n', '\n'), '\n', -1), x -> x rlike r'^\p{Nd}+[.:)]')",
        ),
    }
    for name, (result, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {result} RETURN {body}")
    # An answer that was cut for length loses its last sentence; the list is bound once as f.
    uncut = f"transform(array({found}), f -> if(reason <=> 'length', slice(f, 1, greatest(size(f) - 1, 0)), f))[0]"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION extract_numbered(t STRING, reason STRING) RETURNS ARRAY<STRING> RETURN {uncut}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION numbered_rows(t STRING, reason STRING) RETURNS TABLE (answer_idx INT, answer STRING) "
        "RETURN SELECT pos, col FROM (SELECT extract_numbered(t, reason) AS found), LATERAL posexplode(found)"
    )
    return [*bodies, "extract_numbered", "numbered_rows"]
