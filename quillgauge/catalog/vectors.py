"""Sentence vectors, removal of near copies, distribution match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.catalog.base import DS, WORDS_SQL, datasets, key_number_sql, md5_sql, query, rounded, table
from quillgauge.operators import mauve, vectors
from quillgauge.session import stored


def embedded(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.col("label").cast("string").alias("dataset_id"),
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("vector"),
    )


def hash_sql(tag: str, rows: str, fit_on: str, keep: str, text: str = "text", by: str = "0") -> str:
    """CTE {tag}: ``keep`` and the vector of every row, its words weighted by the rows of ``fit_on``."""
    words = WORDS_SQL.replace("lower(text)", f"lower(coalesce({text}, ''))")
    buckets = f"list_transform({words}, lambda w: {key_number_sql('md5(w)')} % 256)"
    return f"""{tag}_fit AS MATERIALIZED (SELECT {by} AS g, {buckets} AS b FROM {fit_on}),
{tag}_df AS (SELECT g, b, count(*) AS n FROM (SELECT g, unnest(list_distinct(b)) AS b FROM {tag}_fit) GROUP BY 1, 2),
{tag}_idf AS MATERIALIZED (SELECT g, list(ln((n_rows + 1) / (coalesce(n, 0) + 1)) ORDER BY i) AS idf
  FROM (SELECT g, count(*) AS n_rows, unnest(range(256)) AS i FROM {tag}_fit GROUP BY 1) s LEFT JOIN (SELECT g, b AS i, n FROM {tag}_df) USING (g, i) GROUP BY 1),
{tag}_raw AS MATERIALIZED (SELECT {keep}, list_transform(idf, lambda w, i: w * len(list_filter(b, lambda x: x = i - 1))) AS r
  FROM (SELECT *, {by} AS g, {buckets} AS b FROM {rows}) JOIN {tag}_idf USING (g)),
{tag} AS MATERIALIZED (SELECT * EXCLUDE (r, l), CASE WHEN l > 0 THEN list_transform(r, lambda x: x / l) ELSE r END AS vector
  FROM (SELECT *, sqrt(list_inner_product(r, r)) AS l FROM {tag}_raw))"""


@query("hash_vectors", f"""WITH {DS}, {hash_sql("h", "ds", "ds", "dataset_id, row_id")}
SELECT dataset_id, row_id, round(sqrt(list_inner_product(vector, vector)), 6) AS length, CAST(len(list_filter(vector, lambda x: x <> 0)) AS INTEGER) AS n_used FROM h""")
def hash_vectors(spark, sf):
    hashed = vectors.hash_vectors(datasets(spark, sf))
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x * x))
    used = F.size(F.filter("vector", lambda x: x != 0))
    return hashed.select("dataset_id", "row_id", F.round(length, 6).alias("length"), used.alias("n_used"))


@query("pair_vectors", f"""WITH pairs AS (SELECT u.conv_id, u.turn, u.text, a.text AS other_text FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'),
{hash_sql("v", "pairs", "pairs", "conv_id, turn, other_text")}, vr AS (SELECT conv_id, turn, other_text, vector AS first FROM v),
{hash_sql("w", "vr", "vr", "conv_id, turn, first", "other_text")}
SELECT conv_id, turn, round(list_inner_product(first, vector), 6) AS cosine FROM w""")
def pair_vectors(spark, sf):
    """Vectors of both texts of a pair and their cosine."""
    turns = table(spark, sf, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other_text"))
    pairs = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"])
    both = vectors.hash_vectors(vectors.hash_vectors(pairs), "other_text", "other_vector")
    dot = F.aggregate(F.zip_with("vector", "other_vector", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    return both.select("conv_id", "turn", F.round(dot, 6).alias("cosine"))


@query("mean_pool", """WITH t AS (SELECT label, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
SELECT CAST(label AS VARCHAR) AS dataset_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM t GROUP BY 1, 2""")
def mean_pool(spark, sf):
    return rounded(vectors.mean_pool(embedded(spark, sf), ["dataset_id"]))


@query("vector_dedup_exact", """WITH v AS (SELECT CAST(label AS VARCHAR) AS dataset_id, vec_id AS row_id, embedding AS vector FROM embeddings
UNION ALL SELECT CAST((label + k) % 10 AS VARCHAR), vec_id + 1000000000 * k::BIGINT, embedding FROM embeddings, (SELECT unnest([1, 2, 3]) AS k)),
k AS (SELECT *, min(row_id) OVER (PARTITION BY vector) AS kept_id FROM v)
SELECT kept_id, dataset_id, count(*) AS copies FROM k GROUP BY 1, 2""")
def vector_dedup_exact(spark, sf):
    v = table(spark, sf, "embeddings")
    copies = v.withColumn("k", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    every = copies.select(
        ((F.col("label") + F.col("k")) % 10).cast("string").alias("dataset_id"),
        (F.col("vec_id") + F.col("k").cast("bigint") * 1000000000).alias("row_id"),
        F.col("embedding").alias("vector"),
    )
    return vectors.exact_copies(every)


DEDUP_WITHIN = """WITH v AS (SELECT CAST((label + k) % 10 AS VARCHAR) AS dataset_id, vec_id + 1000000000 * k::BIGINT AS row_id,
  list_transform(CAST(embedding AS DOUBLE[]), lambda x: x + s) AS vector FROM embeddings,
  (SELECT unnest([0, 1, 2, 3]) AS k, unnest([0, 0, 1e-5, 1e-2]::DOUBLE[]) AS s)),
near AS (SELECT a.row_id AS a, b.row_id AS b, b.dataset_id FROM v a JOIN v b ON list_distance(a.vector, b.vector) <= 1e-3),
-- the copies of a vector lie within the distance of each other, so the lowest id of each such set is kept
kept AS (SELECT a FROM near GROUP BY 1 HAVING min(b) = a)
SELECT a AS kept_id, dataset_id, count(*) AS members FROM near JOIN kept USING (a) GROUP BY 1, 2"""


def shifted(spark, sf) -> DataFrame:
    """Every embedding four times: as it is, copied, and with two shifts of all components."""
    shift = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate((0.0, 0.0, 1e-5, 1e-2))])
    return table(spark, sf, "embeddings").select("*", F.inline(shift)).select(
        ((F.col("label") + F.col("k")) % 10).cast("string").alias("dataset_id"),
        (F.col("vec_id") + F.col("k").cast("bigint") * 1000000000).alias("row_id"),
        F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.col("s")).alias("vector"),
    )


@query("vector_dedup_within", DEDUP_WITHIN)
def vector_dedup_within(spark, sf):
    return vectors.dedup_within(shifted(spark, sf), 1e-3)


@query("vector_dedup_lsh", DEDUP_WITHIN)
def vector_dedup_lsh(spark, sf):
    return vectors.dedup_lsh(shifted(spark, sf), 1e-3)


def _bins(spark, sf) -> DataFrame:
    n = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        (F.floor(n / 2) % 3).cast("string").alias("dataset_id"),
        F.when(n % 2 == 0, "p").otherwise("q").alias("side"),
        n.alias("row_id"),
        F.col("label").cast("bigint").alias("bin"),
    )


SHARES = """b AS (SELECT CAST(vec_id // 2 % 3 AS VARCHAR) AS dataset_id, vec_id % 2 AS side, CAST(label AS BIGINT) AS bin FROM embeddings),
c AS (SELECT dataset_id, bin, count(*) FILTER (WHERE side = 0) AS np, count(*) FILTER (WHERE side = 1) AS nq FROM b GROUP BY 1, 2),
shares AS (SELECT dataset_id, bin, np / sum(np) OVER (PARTITION BY dataset_id) AS p, nq / sum(nq) OVER (PARTITION BY dataset_id) AS q FROM c)"""


def frontier_sql(shares: str, tag: str = "") -> str:
    return f"""{tag}mix AS (SELECT *, 1e-6::DOUBLE + (1 - 2e-6::DOUBLE) * i / 24 AS w FROM {shares}, (SELECT unnest(range(25)) AS i)),
{tag}inner_points AS (SELECT dataset_id, i, exp(-5 * sum(CASE WHEN q > 0 THEN q * ln(q / (w * p + (1 - w) * q)) ELSE 0 END)) AS x,
  exp(-5 * sum(CASE WHEN p > 0 THEN p * ln(p / (w * p + (1 - w) * q)) ELSE 0 END)) AS y FROM {tag}mix GROUP BY 1, 2),
{tag}points AS (SELECT * FROM {tag}inner_points UNION ALL SELECT DISTINCT dataset_id, -1, 0.0::DOUBLE, 1.0::DOUBLE FROM {shares} UNION ALL SELECT DISTINCT dataset_id, 25, 1.0, 0.0 FROM {shares})"""


def score_sql(points: str, tag: str = "") -> str:
    return f"""{tag}slabs AS (SELECT dataset_id, (x - lag(x) OVER a) * (y + lag(y) OVER a) / 2 AS slab FROM {points} WINDOW a AS (PARTITION BY dataset_id ORDER BY x, y)
  UNION ALL SELECT dataset_id, (y - lag(y) OVER b) * (x + lag(x) OVER b) / 2 FROM {points} WINDOW b AS (PARTITION BY dataset_id ORDER BY y, x)),
{tag}score AS (SELECT dataset_id, sum(slab) / 2 AS mauve FROM {tag}slabs GROUP BY 1)"""


FRONTIER = f"{SHARES}, {frontier_sql('shares')}"


def match_sql(tag: str, own: str, real: str, rounds: int = 10, max_bins: int = 400, seed: str = mauve.SEED) -> str:
    """CTE {tag}_score: the match of ``own`` (dataset_id, test_set, row_id, vector) with ``real`` (test_set, row_id, vector)."""

    def prepared(side: str) -> str:
        fixed = "CASE WHEN l > 0 THEN list_transform(vector, lambda x: floor(x / l * 1000000 + 0.5)) ELSE list_transform(vector, lambda x: 0.0::DOUBLE) END"
        return f"{md5_sql(repr(side), 'row_id', seed=seed)} AS key, '{side}' AS side, {fixed} AS v"

    length = "(SELECT *, sqrt(list_inner_product(vector, vector)) AS l FROM {})"
    out = [f"""{tag}_p AS MATERIALIZED (SELECT dataset_id, test_set, {prepared("p")} FROM {length.format(own)}),
{tag}_q AS MATERIALIZED (SELECT test_set, {prepared("q")} FROM {length.format(real)}),
{tag}_all AS MATERIALIZED (SELECT dataset_id, side, key, v FROM {tag}_p UNION ALL
  SELECT dataset_id, side, key, v FROM (SELECT DISTINCT dataset_id, test_set FROM {tag}_p) JOIN {tag}_q USING (test_set)),
{tag}_k AS (SELECT dataset_id, least(greatest(round(least(count(*) FILTER (WHERE side = 'p'), count(*) FILTER (WHERE side = 'q')) / 10), 2), {max_bins}) AS k
  FROM {tag}_all GROUP BY 1 HAVING count(DISTINCT side) = 2),
{tag}_c0 AS MATERIALIZED (SELECT dataset_id, bin, v AS c FROM (SELECT dataset_id, v, row_number() OVER (PARTITION BY dataset_id ORDER BY key, v) - 1 AS bin FROM {tag}_all) JOIN {tag}_k USING (dataset_id) WHERE bin < k)"""]
    for i in range(rounds + 1):
        out.append(f"""{tag}_a{i} AS MATERIALIZED (SELECT dataset_id, side, key, any_value(v) AS v, min({{'d': list_inner_product(c, c) - 2 * list_inner_product(v, c), 'bin': bin}}).bin AS bin
  FROM {tag}_all JOIN {tag}_c{i} USING (dataset_id) GROUP BY 1, 2, 3)""")
        if i < rounds:
            out.append(f"""{tag}_m{i} AS (SELECT dataset_id, bin, list(m ORDER BY dim) AS c FROM (SELECT dataset_id, bin, dim, floor(sum(x) / count(*) + 0.5) AS m
  FROM (SELECT dataset_id, bin, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM {tag}_a{i}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
{tag}_c{i + 1} AS MATERIALIZED (SELECT dataset_id, bin, coalesce(m.c, o.c) AS c FROM {tag}_c{i} o LEFT JOIN {tag}_m{i} m USING (dataset_id, bin))""")
    out.append(f"""{tag}_n AS (SELECT dataset_id, bin, count(*) FILTER (WHERE side = 'p') AS np, count(*) FILTER (WHERE side = 'q') AS nq FROM {tag}_a{rounds} GROUP BY 1, 2),
{tag}_shares AS (SELECT dataset_id, np / sum(np) OVER (PARTITION BY dataset_id) AS p, nq / sum(nq) OVER (PARTITION BY dataset_id) AS q FROM {tag}_n),
{frontier_sql(f"{tag}_shares", f"{tag}_")}, {score_sql(f"{tag}_points", f"{tag}_")}""")
    return ",\n".join(out)


@query("mauve_histogram", f"WITH {SHARES} SELECT dataset_id, bin, round(p, 6) AS p, round(q, 6) AS q FROM shares")
def mauve_histogram(spark, sf):
    return rounded(mauve.histogram(_bins(spark, sf)))


@query("mauve_frontier", f"WITH {FRONTIER} SELECT dataset_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(y, 6) AS y FROM points")
def mauve_frontier(spark, sf):
    return rounded(mauve.frontier(mauve.histogram(_bins(spark, sf))))


@query("mauve_score", f"WITH {FRONTIER}, {score_sql('points')} SELECT dataset_id, round(mauve, 6) AS mauve FROM score")
def mauve_score(spark, sf):
    return rounded(mauve.mauve(_bins(spark, sf)))


@query("mauve_embeddings", f"""WITH own AS (SELECT CAST(label AS VARCHAR) AS dataset_id, 0 AS test_set, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE label <> 0),
base AS (SELECT 0 AS test_set, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE label = 0),
{match_sql("e", "own", "base")} SELECT dataset_id, round(mauve, 6) AS mauve FROM e_score""")
def mauve_embeddings(spark, sf):
    """Each embedding label against label 0."""
    v = embedded(spark, sf)
    return rounded(mauve.mauve(mauve.quantise(v.filter("dataset_id <> '0'"), v.filter("dataset_id = '0'"))))


_BASE_SQL = """own AS (SELECT CAST(label AS VARCHAR) AS dataset_id, 0 AS test_set, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE label <> 0),
base AS (SELECT 0 AS test_set, vec_id AS row_id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE label = 0)"""
_SEEDS = [mauve.SEED, f"{mauve.SEED}1", f"{mauve.SEED}2"]


def _seeded_sql() -> str:
    parts, tried = [], []
    for i, seed in enumerate(_SEEDS):
        parts.append(match_sql(f"s{i}", "own", "base", seed=seed))
        tried.append(f"""SELECT dataset_id, {i} AS draw, any_value(mauve) AS mauve, sum(list_inner_product(v, v) + list_inner_product(c, c) - 2 * list_inner_product(v, c)) AS inertia
  FROM s{i}_a10 JOIN s{i}_c10 USING (dataset_id, bin) JOIN s{i}_score USING (dataset_id) GROUP BY 1""")
    return f"""WITH {_BASE_SQL}, {", ".join(parts)}, tried AS ({" UNION ALL ".join(tried)})
SELECT dataset_id, round(arg_min(mauve, {{'i': inertia, 'd': draw}}), 6) AS mauve FROM tried GROUP BY 1"""


@query("mauve_seedings", _seeded_sql())
def mauve_seedings(spark, sf):
    """The match from the best of three seedings."""
    v = embedded(spark, sf)
    return rounded(mauve.mauve(mauve.quantise(v.filter("dataset_id <> '0'"), v.filter("dataset_id = '0'"), seedings=len(_SEEDS))))


@query("mauve_pca")
def mauve_pca(spark, sf):
    """The match in the principal axes that explain 90 % of the variance; tested against plain numpy."""
    v = embedded(spark, sf)
    return rounded(mauve.mauve(mauve.quantise(v.filter("dataset_id <> '0'"), v.filter("dataset_id = '0'"), explained=0.9, seedings=2)))


@query("mauve_spectrum", f"""WITH {_BASE_SQL},
f AS (SELECT *, sqrt(list_inner_product(vector, vector)) AS l FROM (SELECT dataset_id, row_id, vector FROM own UNION ALL
  SELECT d, row_id, vector FROM base, (SELECT DISTINCT dataset_id AS d FROM own))),
x AS MATERIALIZED (SELECT dataset_id, CASE WHEN l > 0 THEN list_transform(vector, lambda c: floor(c / l * 1000000 + 0.5)) ELSE vector END AS v FROM f),
e AS (SELECT dataset_id, row_number() OVER () AS r, v FROM x),
c AS MATERIALIZED (SELECT dataset_id, r, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e),
m AS (SELECT dataset_id, i, avg(x) AS mean FROM c GROUP BY 1, 2),
z AS MATERIALIZED (SELECT dataset_id, r, i, x - mean AS x FROM c JOIN m USING (dataset_id, i)),
g AS (SELECT a.dataset_id, a.i, b.i AS j, sum(a.x * b.x) / count(*) AS v, count(*) AS n FROM z a JOIN z b ON a.dataset_id = b.dataset_id AND a.r = b.r GROUP BY 1, 2, 3)
SELECT dataset_id, any_value(n) AS n, round(sum(v) FILTER (WHERE i = j) / 1e12, 6) AS variance, round(sqrt(sum(v * v)) / 1e12, 6) AS strength FROM g GROUP BY 1""")
def mauve_spectrum(spark, sf):
    """The spectrum of every dataset with its real set: the sum of its variances and the root of the sum of their squares."""
    v = embedded(spark, sf)
    blocks = mauve.Blocks(v.filter("dataset_id <> '0'"), v.filter("dataset_id = '0'"), 400, 8192, 16)
    axes = stored(blocks.axes(0.9), "axes")
    blocks.close()
    total = F.aggregate("variances", F.lit(0.0), lambda acc, x: acc + x)
    squares = F.aggregate("variances", F.lit(0.0), lambda acc, x: acc + x * x)
    return rounded(axes.select("dataset_id", "n", (total / 1e12).alias("variance"), (F.sqrt(squares) / 1e12).alias("strength")))
