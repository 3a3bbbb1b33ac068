"""The queries of this subpackage over the given tables, and the SQL they must equal."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgauge.llm import align, bpe, chat, decontaminate, langid, linededup, mixing, pii, sharding, simhash, topk, warc, whiten
from quillgauge.llm.batches import append


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, _table(spark, sf, "benchmark"), drop=("text",))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


CONTROL = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.createDataFrame([(-7, 0, "user", CONTROL), (-7, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)

    def read(batch: pa.RecordBatch) -> list[pa.Array]:
        columns: list[list] = [[], [], [], [], []]
        lists = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("formatted", "token_starts", "token_ends", "loss")]
        for formatted, starts, ends, on in zip(*lists, strict=True):
            turns = chat.read_back(formatted)
            learnt = chat.masked_text(formatted, list(zip(starts, ends, strict=True)), on)
            told = "".join(f"{role}\n{text}\n" for role, text in turns)
            values = (len(turns), _hex(told), len(learnt), _hex(learnt), len(formatted))
            for column, value in zip(columns, values, strict=True):
                column.append(value)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]

    made = chat.format_chats(rows)
    return append(
        made, "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long", read,
        ("formatted", "token_ids", "token_starts", "token_ends", "loss"),
    )


def op3_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


def op4_simhash(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_copies(_table(spark, sf, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(_table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    model = langid.fit(docs.filter(~langid.held_out()))
    told = langid.predict(docs.select("doc_id", "text"), model, drop=("text",))
    return told.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op7_linededup(spark: SparkSession, sf: str) -> DataFrame:
    kept = linededup.dedup(_table(spark, sf, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def _listed(column: str):
    return F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def op8_pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs), drop=("text",))
    counts = [F.expr(f"CAST(size(filter(base, s -> s.kind = '{kind}')) AS LONG)").alias(f"n_{kind}") for kind in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("found").alias("spans"))


def op9_sharding(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.shard(_table(spark, sf, "documents"))


def op10_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = warc.archive(_table(spark, sf, "pages"))
    made = warc.captures(spark, path).select(
        F.col("metadata.page_id").alias("page_id"), "response.payload_bytes", "response.payload_digest", "response.record_type", "response.refers_to_id"
    )
    return made.join(warc.referred_pages(spark, path), "refers_to_id", "left").drop("refers_to_id")


def _joined(ids, by: str):
    return F.concat_ws(by, F.col(ids).cast("array<string>") if isinstance(ids, str) else ids.cast("array<string>"))


def op11_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = bpe.encode(_table(spark, sf, "documents").select("doc_id", "text"), drop=("text",))
    return bpe.decode(coded).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(_joined("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_align(spark: SparkSession, sf: str) -> DataFrame:
    give = ("n_a", "n_b", "n_groups", "spelt", "pairs", "times")
    made = align.align(_table(spark, sf, "documents").select("doc_id", "text"), give=give, drop=("text",))
    digest = F.when(F.col("n_groups") > 0, F.sha2("spelt", 256)).otherwise("").alias("groups_sha256")
    return align.count_links(made.select("doc_id", "n_a", "n_b", "n_groups", digest, "pairs", "times"))


def op13_whiten(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    fitted = whiten.fit(vectors)
    rows = whiten.whiten(vectors, fitted, drop=("vector",)).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    explained = F.array(*[F.lit(float(x)) for x in fitted.explained]) if fitted else F.array().cast("array<double>")
    return rows.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("i")).alias("explained"), F.lit(fitted.error if fitted else 0.0).cast("double").alias("identity_error"),
    )


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_chat, op3_topk, op4_simhash, op5_mixing, op6_langid, op7_linededup, op8_pii, op9_sharding, op10_warc,
    op11_bpe, op12_align, op13_whiten,
)}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP1_WORDS = rf"regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLES = {
    "op1_decontaminate": f"""
WITH d AS (SELECT doc_id, {_OP1_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_OP1_WORDS} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[p:p+n-1], ' ') AS w
  FROM (SELECT item_id, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS p FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, p, array_to_string(ws[p:p+n-1], ' ') AS w
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM d, lens WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, p, dw.n FROM dw JOIN win USING (w, n)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM m) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM m) GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op2_chat": rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL}'),
e AS (SELECT *, length(role) + length(text) + len(regexp_extract_all(role || text, '[<\[\\]')) + {sum(map(len, chat.MARKS))} AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM e GROUP BY 1""",
    "op3_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op5_mixing": r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
  coalesce(length(text), 0)::DOUBLE AS chars, text FROM documents),
k AS (SELECT doc_id, source, size,
  -ln((CAST(CAST('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(md5(text), ''), coalesce(source, ''), 'mix')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
  / (0.25::DOUBLE + CASE WHEN size BETWEEN 50 AND 100000 THEN 0.25::DOUBLE ELSE 0::DOUBLE END
     + CASE WHEN chars / greatest(size, 1) BETWEEN 3 AND 10 THEN 0.5::DOUBLE ELSE 0::DOUBLE END) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
l AS (SELECT *, source_size / weight AS o,
  CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
  / sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
lv AS (SELECT level FROM l WHERE level * weight <= 3 * source_size ORDER BY o, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, coalesce(least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM lv) * weight), 3 * source_size) AS target FROM l),
e AS (SELECT *, floor(target / greatest(source_size, 1)) AS epochs FROM t),
r AS (SELECT *, target - epochs * source_size AS rest FROM e),
p AS (SELECT k.doc_id, k.size, r.*, sum(k.size) OVER (PARTITION BY k.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN rest > 0 AND CAST(upto AS DOUBLE) - CAST(size AS DOUBLE) / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM p""",
    "op7_linededup": f"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, {_SPACES}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM d),
c AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 2),
j AS (SELECT k.*, c.key IS NOT NULL AND doc_id <> owner AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY 1""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, h, sha1(h) || '0' AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(x, CAST(5 * i // 4 + 1 AS BIGINT), 2) AS INTEGER) >> CAST(3 - 5 * i % 4 AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM s""",
}
