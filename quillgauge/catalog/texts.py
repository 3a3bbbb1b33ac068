"""Text functions and answers out of responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgauge.catalog.base import DS, datasets, query, table
from quillgauge.functions import extract, prompts, sql_functions, text
from quillgauge.functions.text import WHITESPACE
from quillgauge.operators import generate

_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(text), '([a-z])-([a-z])', '\\1 \\2', 'g'), "
    f"'[^a-z{WHITESPACE}]', '', 'g'), '[{WHITESPACE}]{{2,}}', ' ', 'g'), '^[{WHITESPACE}]+|[{WHITESPACE}]+$', '', 'g')"
)


@query("clean_text", f"WITH {DS} SELECT dataset_id, row_id, {_CLEAN} AS text FROM ds")
def clean_text(spark, sf):
    return datasets(spark, sf).select("dataset_id", "row_id", text.clean_text("text").alias("text"))


@query("clean_text_sql", f"SELECT item_id, {_CLEAN} AS text, len(string_split(regexp_replace(text, '[^a-zA-Z ]', '', 'g'), ' ')) AS n FROM benchmark")
def clean_text_sql(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        "SELECT item_id, clean_text(text) AS text, cast(size(token_array(text)) AS bigint) AS n FROM {bench}",
        bench=table(spark, sf, "benchmark"),
    )


@query("strip_paren", """WITH t AS (SELECT page_id, url || '(' || html || CASE WHEN page_id % 3 = 0 THEN ')' ELSE '' END AS title FROM pages)
SELECT page_id, CASE WHEN ends_with(title, ')') THEN regexp_extract(title, '^(.*)\\(', 1, 's') ELSE title END AS text FROM t""")
def strip_paren(spark, sf):
    tail = F.when(F.col("page_id") % 3 == 0, ")").otherwise("")
    title = F.concat("url", F.lit("("), "html", tail)
    return table(spark, sf, "pages").select("page_id", text.strip_parenthetical(title).alias("text"))


_STRIP = '"\'' + " .\n"
_STRIP_SQL = "'\"'' .' || chr(10)"


@query("extract_plain", f"""WITH t AS (SELECT conv_id, turn, trim(CASE WHEN turn % 2 = 0 THEN text ELSE ' "' || text || '" ' END, {_STRIP_SQL}) AS text
  FROM conversations)
SELECT * FROM t WHERE length(text) > 0 AND NOT contains(text, 'AI language model') AND NOT contains(text, 'xx')""")
def extract_plain(spark, sf):
    said = table(spark, sf, "conversations")
    even = F.col("turn") % 2 == 0
    responses = said.select(
        "conv_id",
        "turn",
        F.when(even, F.col("text")).alias("text"),
        F.when(~even, F.concat(F.lit(' "'), "text", F.lit('" '))).alias("content"),
    )
    answer = extract.plain_answer("text", "content", _STRIP, (*extract.EXCLUDED_PHRASES, "xx"))
    return responses.select("conv_id", "turn", answer.alias("text")).filter("text IS NOT NULL")


def numbered_responses(spark, sf):
    """Each turn as a numbered list of its lines, in changing quote styles; some are cut for length.

    Odd turns are chat replies, which have a message and no text.
    """
    style = F.array(F.lit('"'), F.lit("'"), F.lit(""))
    lines = F.split("text", "\n", -1)
    one = F.transform(
        lines,
        lambda line, i: F.concat(
            (i + 1).cast("string"),
            F.when(i % 2 == 0, ". ").otherwise(") "),
            F.element_at(style, (i % 3 + 1).cast("int")),
            line,
            F.element_at(style, (i % 3 + 1).cast("int")),
            F.lit("  "),
        ),
    )
    said, chat = F.concat(F.lit("Sure:\n\n"), F.concat_ws("\n\n", one)), F.col("turn") % 2 == 1
    return table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
        F.col("role").alias("label"),
        F.when(~chat, said).alias("text"),
        F.when(chat, F.struct(F.lit("assistant").alias("role"), said.alias("content"))).alias("message"),
        F.when(F.col("turn") % 3 == 0, "length").otherwise("stop").alias("finish_reason"),
    )


# The list's lines, before and after the numbers and quotes go. A quoted line keeps what stands
# before its last quote of that kind.
NUMBERED = """
lined AS (SELECT conv_id * 1000 + turn AS request_id, role AS label, turn % 3 = 0 AS cut,
    string_split(text, chr(10)) AS lines FROM conversations),
items AS (SELECT request_id, label, cut, i, lines[i + 1] AS line FROM (SELECT *, unnest(range(len(lines))) AS i FROM lined)),
answers0 AS (SELECT request_id, label, cut, i,
    CASE WHEN i % 3 = 0 THEN CASE WHEN length(line) <= 1 THEN line || '"  ' ELSE line END
         WHEN i % 3 = 1 THEN CASE WHEN length(line) <= 1 THEN line || chr(39) || '  ' ELSE line END
         WHEN rest = '' THEN rtrim(CAST(i + 1 AS VARCHAR) || CASE WHEN i % 2 = 0 THEN '. ' ELSE ') ' END || line, ' ')
         ELSE rest END AS text
  FROM (SELECT *, rtrim(regexp_replace(line, '^[\\p{N}.: )]*', ''), ' ') AS rest FROM items)),
answers1 AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY i) - 1 AS answer_idx,
    count(*) OVER (PARTITION BY request_id) AS size FROM answers0 WHERE text <> '' AND NOT contains(text, 'AI language model')),
numbered AS (SELECT request_id, label, answer_idx, text FROM answers1 WHERE NOT (cut AND answer_idx = size - 1))"""


@query("extract_numbered", f"WITH {NUMBERED} SELECT * FROM numbered")
def extract_numbered(spark, sf):
    answers = extract.numbered_answers(extract.reply_text(), "finish_reason")
    out = generate.ingest(numbered_responses(spark, sf), answers, ["request_id", "label"])
    return out.withColumn("answer_idx", F.col("answer_idx").cast("bigint"))


@query("extract_numbered_sql", f"WITH {NUMBERED} SELECT * FROM numbered")
def extract_numbered_sql(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        "SELECT request_id, label, cast(answer_idx AS bigint) AS answer_idx, answer AS text FROM "
        "(SELECT request_id, label, extract_numbered(coalesce(text, message.content), finish_reason) AS answers FROM {said}) "
        "LATERAL VIEW posexplode(answers) AS answer_idx, answer",
        said=numbered_responses(spark, sf),
    )


@query("extract_numbered_udtf", f"WITH {NUMBERED} SELECT * FROM numbered")
def extract_numbered_udtf(spark, sf):
    sql_functions.register(spark)
    return spark.sql(
        "SELECT r.request_id, r.label, cast(a.answer_idx AS bigint) AS answer_idx, a.answer AS text "
        "FROM {said} r, LATERAL numbered_rows(coalesce(r.text, r.message.content), r.finish_reason) a",
        said=numbered_responses(spark, sf),
    )


@query("extract_pairs", """WITH lined AS (SELECT doc_id AS request_id, doc_id % 4 = 0 AS cut, string_split(text, chr(10)) AS lines FROM documents),
raws AS (SELECT request_id, cut, i, lines[i + 1] AS raw FROM (SELECT *, unnest(range(len(lines))) AS i FROM lined)),
items AS (SELECT request_id, cut, i, CASE WHEN trim(raw, ' ') = '' THEN raw || '   ' WHEN regexp_matches(raw, '^[.: )]*$') THEN rtrim(raw, ' ')
  ELSE rtrim(regexp_replace(raw, '^[.: )]*', ''), ' ') END AS line FROM raws),
paired AS (SELECT request_id, cut, i // 2 AS pair_idx, line AS text, lead(line) OVER (PARTITION BY request_id ORDER BY i) AS other_text, i,
  count(*) OVER (PARTITION BY request_id) // 2 AS size FROM items)
SELECT request_id, pair_idx, text, other_text FROM paired WHERE i % 2 = 0 AND other_text IS NOT NULL AND NOT (cut AND pair_idx = size - 1)""")
def extract_pairs(spark, sf):
    lines = F.split("text", "\n", -1)
    marked = F.transform(
        lines,
        lambda line, i: F.concat(
            F.floor(i / 2 + 1).cast("string"), F.when(i % 2 == 0, "a. ").otherwise("b) "), line, F.lit("   ")
        ),
    )
    responses = table(spark, sf, "documents").select(
        F.col("doc_id").alias("request_id"),
        F.concat_ws("\n", marked).alias("text"),
        F.when(F.col("doc_id") % 4 == 0, "length").otherwise("stop").alias("finish_reason"),
    )
    found = responses.select("request_id", F.posexplode(extract.paired_answers("text", "finish_reason")).alias("j", "pair"))
    return found.select("request_id", F.col("j").cast("bigint").alias("pair_idx"), "pair.text", "pair.other_text")


_CLASSES = ("the", "un", "der", "los", "AND")


def _mentions(c: str) -> str:
    return f"(length(t) - length(replace(t, '{c.lower()}', ''))) // {len(c)}"


@query("classify_mentions", f"""WITH t AS (SELECT source AS dataset_id, doc_id AS row_id, lower(text) AS t FROM documents),
n AS (SELECT dataset_id, row_id, [{", ".join(_mentions(c) for c in _CLASSES)}] AS n FROM t)
SELECT dataset_id, row_id, CASE WHEN list_max(n) > 0 THEN [{", ".join(f"'{c}'" for c in _CLASSES)}][list_position(n, list_max(n))] ELSE 'None' END AS class FROM n""")
def classify_mentions(spark, sf):
    return datasets(spark, sf).select("dataset_id", "row_id", extract.most_mentioned("text", _CLASSES).alias("class"))


@query("extract_variables", """WITH v AS (SELECT conv_id, unnest(['OUTPUT_' || role, 'INPUT', 'OUTPUT2']) AS name,
    unnest([text || chr(160) || chr(10) || CAST(turn AS VARCHAR), text, chr(10)]) AS raw, turn FROM conversations),
t AS (SELECT conv_id, turn, replace(replace(raw, chr(160), ''), chr(10), '') AS text FROM v WHERE starts_with(name, 'OUTPUT'))
SELECT * FROM t WHERE length(text) > 0""")
def extract_variables(spark, sf):
    turns = table(spark, sf, "conversations")
    variables = F.create_map(
        F.concat(F.lit("OUTPUT_"), "role"),
        F.concat("text", F.lit("\u00a0\n"), F.col("turn").cast("string")),
        F.lit("INPUT"),
        F.col("text"),
        F.lit("OUTPUT2"),
        F.lit("\n"),
    )
    return turns.select("conv_id", "turn", F.explode(extract.variable_answers(variables)).alias("text"))


def _requests(spark, sf):
    docs = table(spark, sf, "documents")
    template = (
        F.when(F.col("lang") == "en", "Write {{n}} texts like {{text}}.")
        .when(F.col("lang") == "fr", "{{text}}: {{n}} fois, {{n}} textes")
        .otherwise("No slot here {{unknown}}")
    )
    args = F.create_map(F.lit("n"), (F.col("n_chars") % 20 + 1).cast("string"), F.lit("text"), F.col("text"))
    return docs.select(F.col("doc_id").alias("request_id"), F.col("lang").alias("label"), template.alias("template"), args.alias("args"))


_RENDERED = """rendered AS (SELECT doc_id AS request_id, lang AS label, CASE lang
  WHEN 'en' THEN 'Write ' || CAST(n_chars % 20 + 1 AS VARCHAR) || ' texts like ' || text || '.'
  WHEN 'fr' THEN text || ': ' || CAST(n_chars % 20 + 1 AS VARCHAR) || ' fois, ' || CAST(n_chars % 20 + 1 AS VARCHAR) || ' textes'
  ELSE 'No slot here {{unknown}}' END AS prompt FROM documents)"""


@query("render_prompts", f"WITH {_RENDERED} SELECT * FROM rendered")
def render_prompts(spark, sf):
    return _requests(spark, sf).select("request_id", "label", prompts.render("template", "args").alias("prompt"))


@query("chat_envelope", f"""WITH {_RENDERED}
SELECT request_id, 0 AS place, 'system' AS role, 'You are a helpful assistant.' AS content FROM rendered
UNION ALL SELECT request_id, 1, 'user', prompt FROM rendered
UNION ALL SELECT -1 - conv_id * 1000 - turn, CASE WHEN role = 'system' THEN 0 ELSE 1 END, role, text FROM conversations
UNION ALL SELECT -1 - conv_id * 1000 - turn, 0, 'system', 'You are a helpful assistant.' FROM conversations WHERE role <> 'system'""")
def chat_envelope(spark, sf):
    text_prompts = generate.chat_prompts(_requests(spark, sf)).select("request_id", "messages")
    turns = table(spark, sf, "conversations").select(
        (-1 - F.col("conv_id") * 1000 - F.col("turn")).alias("request_id"),
        prompts.chat_envelope(F.array(prompts.message("text", "role"))).alias("messages"),
    )
    both = text_prompts.unionByName(turns).select("request_id", F.posexplode("messages").alias("place", "m"))
    return both.select("request_id", "place", "m.role", "m.content")


@query("conversation_fold", """WITH c AS (SELECT a.conv_id, a.turn, u.text AS t0, a.text AS t1, n.text AS t2
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  JOIN conversations n ON n.conv_id = u.conv_id AND n.turn = u.turn + 2
  WHERE u.role = 'user' AND a.role = 'assistant' AND n.role = 'user'),
m AS (SELECT conv_id, turn - 1 AS turn, unnest(range(4)) AS place, unnest(['system', 'user', 'assistant', 'user']) AS role,
  unnest(['You are a helpful assistant.', t0, t1, t2]) AS content FROM c)
SELECT conv_id, turn, CAST(place AS INTEGER) AS place, role, content FROM m""")
def conversation_fold(spark, sf):
    turns = table(spark, sf, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    nexts = turns.filter("role = 'user'").select("conv_id", (F.col("turn") - 2).alias("turn"), F.col("text").alias("next"))
    asked = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"]).join(nexts, ["conv_id", "turn"])
    chat = prompts.extend_chat(prompts.chat_from_text("text"), prompts.message("answer", F.lit("assistant")), "next")
    return asked.select("conv_id", "turn", F.posexplode(chat).alias("place", "m")).select(
        "conv_id", "turn", "place", "m.role", "m.content"
    )
