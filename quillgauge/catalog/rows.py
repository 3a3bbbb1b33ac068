"""Row edits, unions, numbering, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.catalog.base import DS, GEN, datasets, generated, key_number_sql, md5_sql, query, real, REAL, table
from quillgauge.operators import classify, rows, sampling
from quillgauge.operators.ordering import number_by_id

IDS = ["dataset_id", "row_id", "label"]


def ragged(spark, sf) -> DataFrame:
    """All documents, some without labels, and as many rows again with missing or very short texts."""
    docs = table(spark, sf, "documents")
    marks = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    n = F.col("n_chars")
    short = F.when(n % 4 == 0, None).otherwise(F.substring(F.lit("abc"), 1, (n % 4 - 1).cast("int")))
    marked = docs.join(marks, "doc_id", "left").select(F.col("source").alias("dataset_id"), "doc_id", "text", "label", short.alias("short"))
    # Both rows of a document by one explode, so the texts are read once.
    both = F.array(
        F.struct(F.col("doc_id").alias("row_id"), F.col("text").alias("text")),
        F.struct((F.col("doc_id") + F.lit(1_000_000_000)).alias("row_id"), F.col("short").alias("text")),
    )
    return marked.select("dataset_id", "label", F.inline(both)).select("dataset_id", "row_id", "text", "label")


RAGGED = """ragged AS (
  SELECT source AS dataset_id, doc_id AS row_id, CAST(quality AS VARCHAR) AS label, text FROM documents LEFT JOIN labels USING (doc_id)
  UNION ALL SELECT source, doc_id + 1000000000, CAST(quality AS VARCHAR),
    CASE n_chars % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'a' ELSE 'ab' END
  FROM documents LEFT JOIN labels USING (doc_id))"""


@query("load_normalise", f"""WITH {RAGGED}, filled AS (
  SELECT dataset_id, row_id, label, coalesce(text, '') AS text FROM ragged WHERE label IS NOT NULL)
SELECT * FROM filled WHERE text <> '' AND length(text) >= 2""")
def load_normalise(spark, sf):
    return rows.load_normalise(ragged(spark, sf))


@query("remove_empty", f"WITH {RAGGED} SELECT dataset_id, row_id, text FROM ragged WHERE length(text) >= 2")
def remove_empty(spark, sf):
    return rows.remove_empty(ragged(spark, sf)).select("dataset_id", "row_id", "text")


@query("filter_label", f"""WITH {DS}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS position FROM ds)
SELECT dataset_id, row_id, label, text, position FROM n WHERE label = 'fr'""")
def filter_label(spark, sf):
    return rows.with_label(datasets(spark, sf), "fr")


@query("get_row", f"""WITH {DS}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS position FROM ds)
SELECT dataset_id, row_id, label, text FROM n WHERE position = 7""")
def get_row(spark, sf):
    return rows.row_at(datasets(spark, sf), 7).drop("position")


@query("apply_edits", f"""WITH {DS}, edits AS (SELECT doc_id AS row_id, CASE quality WHEN 1 THEN 'good ' ELSE 'bad ' END AS mark FROM labels)
SELECT dataset_id, row_id, label, coalesce(mark || CAST(row_id AS VARCHAR), text) AS text FROM ds LEFT JOIN edits USING (row_id)""")
def apply_edits(spark, sf):
    ds = datasets(spark, sf)
    mark = F.when(F.col("quality") == 1, "good ").otherwise("bad ")
    edits = table(spark, sf, "labels").select(
        F.col("doc_id").alias("row_id"), F.concat(mark, F.col("doc_id").cast("string")).alias("text")
    ).join(ds.select("dataset_id", "row_id"), "row_id")
    return rows.apply_edits(ds, edits)


@query("delete_rows", f"""WITH {DS}
SELECT dataset_id, row_id, label, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS position
FROM ds WHERE row_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def delete_rows(spark, sf):
    ds = datasets(spark, sf).select(*IDS)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id"))
    return rows.delete_rows(ds, toxic.join(ds.select("dataset_id", "row_id"), "row_id"))


@query("delete_text", f"""WITH {DS} SELECT dataset_id, row_id, label FROM ds
WHERE text NOT IN (SELECT d.text FROM documents d JOIN labels USING (doc_id) WHERE toxic = 1)""")
def delete_text(spark, sf):
    ds = datasets(spark, sf)
    toxic = table(spark, sf, "labels").filter("toxic = 1").select(F.col("doc_id").alias("row_id"))
    return rows.delete_texts(ds, ds.join(toxic, "row_id")).select(*IDS)


@query("pair_projection", """SELECT CAST(u.conv_id AS VARCHAR) AS dataset_id, u.turn AS row_id, u.text, a.text AS other_text, u.role AS label
FROM conversations u LEFT JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'""")
def pair_projection(spark, sf):
    turns = table(spark, sf, "conversations").withColumn("dataset_id", F.col("conv_id").cast("string"))
    answers = turns.filter("role = 'assistant'").select(
        "dataset_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other_text")
    )
    asked = turns.filter("role = 'user'").join(answers, ["dataset_id", "turn"], "left")
    return rows.pairs(asked.withColumnRenamed("turn", "row_id").withColumnRenamed("role", "label"))


@query("renumber", f"""WITH {RAGGED}
SELECT dataset_id, row_id, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS position FROM ragged WHERE length(text) >= 2""")
def renumber(spark, sf):
    return number_by_id(rows.remove_empty(ragged(spark, sf)).select("dataset_id", "row_id"), ["dataset_id"])


@query("sort_labels", f"WITH {DS} SELECT dataset_id, row_id, label FROM ds ORDER BY label, row_id")
def sort_labels(spark, sf):
    return datasets(spark, sf).select(*IDS).orderBy("label", "row_id")


@query("first_n", f"""WITH {DS}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS position FROM ds)
SELECT dataset_id, row_id, label, text FROM n WHERE position <= 40""")
def first_n(spark, sf):
    return sampling.first_n(datasets(spark, sf), 40)


@query("append_rows", """SELECT source AS dataset_id, doc_id AS row_id, text, lang AS label, NULL AS other_text FROM documents
UNION ALL SELECT 'chat', u.conv_id * 1000 + u.turn, u.text, u.role, a.text
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1""")
def append_rows(spark, sf):
    turns = table(spark, sf, "conversations")
    nexts = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other_text"))
    chat = turns.join(nexts, ["conv_id", "turn"]).select(
        F.lit("chat").alias("dataset_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", F.col("role").alias("label"), "other_text"
    )
    return rows.append_rows(datasets(spark, sf), chat)


@query("label_union", f"""WITH {GEN} SELECT label FROM gen UNION SELECT role FROM conversations""")
def label_union(spark, sf):
    roles = table(spark, sf, "conversations").select(F.col("role").alias("label"))
    return generated(spark, sf).select("label").distinct().union(roles).distinct()


@query("label_set", f"WITH {DS} SELECT DISTINCT dataset_id, label FROM ds ORDER BY 1, 2")
def label_set(spark, sf):
    return datasets(spark, sf).select("dataset_id", "label").distinct().orderBy("dataset_id", "label")


@query("size_by_label", f"""WITH {DS} SELECT dataset_id, label, count(*) AS n FROM ds GROUP BY GROUPING SETS ((dataset_id), (dataset_id, label))""")
def size_by_label(spark, sf):
    d, lab = F.col("dataset_id"), F.col("label")
    return datasets(spark, sf).groupingSets([[d], [d, lab]], d, lab).agg(F.count(F.lit(1)).alias("n"))


_HOST = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query("first_wins", f"""WITH f AS (SELECT {_HOST} AS host, min(page_id) AS first_position FROM pages GROUP BY 1)
SELECT host, first_position, row_number() OVER (ORDER BY first_position) - 1 AS first_id FROM f""")
def first_wins(spark, sf):
    hosts = table(spark, sf, "pages").select(
        F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.col("page_id").alias("position")
    )
    return rows.first_wins(hosts, ["host"])


@query("known_labels", """SELECT d.source AS dataset_id, d.doc_id AS row_id, d.lang AS label FROM documents d
WHERE d.lang IN (SELECT x.lang FROM documents x JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)""")
def known_labels(spark, sf):
    ds = datasets(spark, sf).select(*IDS)
    trained = table(spark, sf, "labels").filter("toxic = 1 AND quality = 0").select(F.col("doc_id").alias("row_id"))
    return rows.known_labels(ds, ds.join(trained, "row_id"))


@query("label_encode", f"""WITH {DS}, l AS (SELECT DISTINCT label FROM ds UNION SELECT DISTINCT role FROM conversations),
c AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM l)
SELECT dataset_id, row_id, label, code FROM ds JOIN c USING (label)""")
def label_encode(spark, sf):
    ds = datasets(spark, sf).select(*IDS)
    roles = table(spark, sf, "conversations").select(F.col("role").alias("label"))
    return ds.join(classify.label_table(ds.select("label").union(roles)), "label")


_KEY = md5_sql("row_id", seed="42")


@query("shuffle_md5", f"""WITH {DS} SELECT dataset_id, row_id, label,
row_number() OVER (PARTITION BY dataset_id ORDER BY {_KEY}) AS position FROM ds""")
def shuffle_md5(spark, sf):
    return sampling.shuffle(datasets(spark, sf).select(*IDS))


@query("bernoulli", f"""WITH {DS} SELECT dataset_id, row_id, label FROM ds
WHERE {key_number_sql(_KEY)} < {int(0.4 * 2**32)}""")
def bernoulli(spark, sf):
    return sampling.bernoulli(datasets(spark, sf).select(*IDS), 0.4)


@query("holdout_split", f"""WITH {DS}, n AS (SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {_KEY}) AS p,
count(*) OVER (PARTITION BY dataset_id) AS size FROM ds)
SELECT dataset_id, row_id, label, CASE WHEN p <= ceil(size * 0.3::DOUBLE) THEN 'test' ELSE 'train' END AS side FROM n""")
def holdout_split(spark, sf):
    return sampling.holdout(datasets(spark, sf).select(*IDS))


@query("halves", f"""WITH {REAL}, n AS (SELECT *, row_number() OVER (ORDER BY row_id) AS p, count(*) OVER () AS size FROM real_set)
SELECT dataset_id, row_id, label, CASE WHEN p <= size // 2 THEN 1 ELSE 2 END AS half FROM n""")
def halves(spark, sf):
    return sampling.halves(real(spark, sf).select(*IDS), [])


FOLDS = f"""folds AS (SELECT *, (row_number() OVER (PARTITION BY dataset_id, label ORDER BY {_KEY}) - 1) % 5 AS fold FROM ds)"""
PARTS = f"""{FOLDS}, sizes AS (SELECT dataset_id, fold AS run, count(*) AS size FROM folds GROUP BY 1, 2),
rest AS (SELECT f.*, s.run, s.size, row_number() OVER (PARTITION BY f.dataset_id, s.run ORDER BY f.row_id) AS p
  FROM folds f JOIN sizes s USING (dataset_id) WHERE f.fold <> s.run),
parts AS (SELECT dataset_id, row_id, text, label, fold, fold AS run, 'train' AS side FROM folds
  UNION ALL SELECT dataset_id, row_id, text, label, fold, run, 'valid' FROM rest WHERE p <= size)"""


@query("stratified_folds", f"WITH {DS}, {FOLDS} SELECT dataset_id, row_id, label, fold FROM folds")
def stratified_folds(spark, sf):
    return sampling.stratified_folds(datasets(spark, sf).select(*IDS))


@query("fold_train_valid", f"WITH {DS}, {PARTS} SELECT dataset_id, row_id, label, fold, run, side FROM parts")
def fold_train_valid(spark, sf):
    return sampling.fold_parts(sampling.stratified_folds(datasets(spark, sf).select(*IDS)))
