import re

from pyspark.sql import functions as F

from quillgauge.functions import extract, prompts, text


def column(spark, values, make, name="t"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(make(F.col(name))).collect()]


def test_clean_text_against_plain_python(spark):
    cases = ["a-b-c", "Ab\t\u00a0 cd", "\n x  y\u2003", "Don't 12 stop-me", "", "ÀÉ-z", "a\x1c\x1db"]

    def expected(t):
        t = re.sub(r"([a-z])-([a-z])", r"\1 \2", t.lower())
        t = re.sub(r"\s{2,}", " ", re.sub(r"[^a-z\s]", "", t))
        return t.strip()

    assert column(spark, cases, text.clean_text) == [expected(c) for c in cases]


def test_token_array_keeps_empty_tokens(spark):
    got = column(spark, ["a  b", "x\ny", "1 2", ""], text.token_array)
    assert got == [["a", "", "b"], ["xy"], ["", ""], [""]]


def test_strip_parenthetical(spark):
    cases = ["News (AP)", "a (b) c (d)", "no)", "plain", "(all)"]
    assert column(spark, cases, text.strip_parenthetical) == ["News ", "a (b) c ", "", "plain", ""]


def test_lemmas(spark):
    cases = ["cities", "boxes", "classes", "glass", "cats", "this", "bus", "walking", "ring", "jumped", "red"]
    assert column(spark, cases, text.rule_lemma) == [
        "city", "box", "class", "glass", "cat", "this", "bus", "walk", "ring", "jump", "red",
    ]


def test_unquote_cases(spark):
    cases = ['1. "Great film" he said', "2) plain  ", "3: 'unclosed", "4. ", '5. "a"', '""', "6. 'tis what I don't", "   ", "7. a\"b\""]
    want = ["Great film", "plain", "unclosed", "4.", 'a"', '"', "tis what I don", "   ", 'a"b"']
    got = column(spark, cases, lambda c: extract.unquote_all(F.array(c), r"\p{N}.: )")[0])
    assert got == want


def test_numbered_answers(spark):
    body = 'Sure!\n\n1. "One"\n2) As an AI language model no\n\n3: three\n4. "four'
    df = spark.createDataFrame([(body, "stop"), (body, "length"), ("none", "stop")], "t string, f string")
    got = [r[0] for r in df.select(extract.numbered_answers("t", "f")).collect()]
    assert got == [["One", "three", "four"], ["One", "three"], []]
    loose = df.limit(1).select(extract.numbered_answers("t", "f", only_numbered=False, excluded=())).first()[0]
    assert loose == ["Sure!", "One", "As an AI language model no", "three", "four"]


def test_paired_answers(spark):
    cases = [
        ("1a. x\n1b. y\n2a: u\n2b) v", "stop", [("x", "y"), ("u", "v")]),
        ("1a. x\n1b. y\n2a: u\n2b) v", "length", [("x", "y")]),
        ("1a. old\n2a. new\n2b. y", "stop", [("new", "y")]),
        ("1a. x\n1b.\n2b. z\n3a. w", "stop", [("w", "z")]),
        ("1b. first\n1a. second", "stop", [("second", "first")]),
        ("text\n1. no", "stop", []),
    ]
    df = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(cases)], "i int, t string, f string")
    got = [[tuple(p) for p in r[0]] for r in df.orderBy("i").select(extract.paired_answers("t", "f")).collect()]
    assert got == [c[2] for c in cases]


def test_most_mentioned(spark):
    pick = lambda c: extract.most_mentioned(c, ["World", "Sports", "aa"])
    assert column(spark, ["sports world", "SPORTS sports world", "none", "aaaa aaa world"], pick) == ["World", "Sports", "None", "aa"]


def test_plain_answer(spark):
    df = spark.createDataFrame(
        [(0, ' "Yes." ', "other"), (1, None, "'chat'"), (2, '""', None), (3, "As an AI language model", None), (4, None, None)],
        "i int, t string, c string",
    )
    got = [r[0] for r in df.orderBy("i").select(extract.plain_answer("t", "c", "\"' ")).collect()]
    assert got == ["Yes.", "chat", None, None, None]


def test_variable_answers(spark):
    m = F.create_map(F.lit("OUTPUT1"), F.lit("a\u00a0b\n"), F.lit("x"), F.lit("no"), F.lit("OUTPUT2"), F.lit("\n"))
    assert spark.range(1).select(extract.variable_answers(m)).first()[0] == ["ab"]


def test_decode_responses(spark):
    rows = [
        '{"choices": [{"text": "a", "finish_reason": "stop"}], "usage": {"total_tokens": 5}}',
        '{"choices": [{"message": {"role": "assistant", "content": "b"}, "finish_reason": "length"}], "usage": {"total_tokens": 7}}',
        '{"error": {"code": 1}}',
        '{"choices": [{"text": "a"',
        "<html>",
        None,
        '{"choices": [{"text": "a", "finish_reason": "stop"}], "usage": {"total_tokens": 5}',
    ]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, raw string")
    out = extract.decode_responses(df).orderBy("i").collect()
    assert [r["status"] for r in out] == ["ok", "ok", "api_error", "parse_error", "parse_error", "api_error", "parse_error"]
    assert out[1]["message"]["content"] == "b" and out[1]["total_tokens"] == 7 and out[6]["text"] is None


def test_render_and_chat(spark):
    args = F.create_map(F.lit("n"), F.lit("3"), F.lit("x"), F.lit("$1 {{n}}"))
    out = spark.range(1).select(prompts.render(F.lit("{{n}} of {{x}}, {{n}}, {{y}}"), args).alias("p"))
    assert out.first()[0] in ("3 of $1 {{n}}, 3, {{y}}", "3 of $1 3, 3, {{y}}")
    chat = out.select(prompts.extend_chat(prompts.chat_from_text("p"), prompts.message(F.lit("ans"), F.lit("assistant")), F.lit("next")).alias("m"))
    assert [(m["role"]) for m in chat.first()["m"]] == ["system", "user", "assistant", "user"]
    kept = spark.range(1).select(prompts.chat_envelope(F.array(prompts.message(F.lit("own"), F.lit("system")))).alias("m"))
    assert len(kept.first()["m"]) == 1
