"""Classifier transfer between datasets and the combined evaluation."""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgauge.catalog.base import CONFIGS, DS, GEN, REAL, WORDS_SQL, TOKENS_SQL, datasets, generated, key_number_sql, query, real, rounded, run_configs, table
from quillgauge.catalog.diversity import _STOP, _lemma_sql, rarefied_sql
from quillgauge.catalog.rows import _KEY, PARTS
from quillgauge.catalog.vectors import hash_sql, match_sql
from quillgauge.functions.text import WHITESPACE, word_array
from quillgauge.operators import classify, logistic, metrics, report, sampling
from quillgauge.plans import evaluate
from quillgauge.session import scratch_path
from quillgauge.sources import stores


def model_sql(name: str, train: str, words: str = WORDS_SQL) -> str:
    """Likelihoods and priors of the models trained on (model, row_id, text, label)."""
    return f"""
{name}_tt AS (SELECT model, label, unnest({words}) AS token FROM {train}),
{name}_cnt AS (SELECT model, label, token, count(*) AS c FROM {name}_tt GROUP BY 1, 2, 3),
{name}_voc AS (SELECT model, count(DISTINCT token) AS v FROM {name}_tt GROUP BY 1),
{name}_cls AS (SELECT model, label, ln(count(*) / sum(count(*)) OVER (PARTITION BY model)) AS prior FROM {train} GROUP BY 1, 2),
{name}_csz AS (SELECT model, label, CAST(sum(c) AS BIGINT) AS nc FROM {name}_cnt GROUP BY 1, 2),
{name}_lik AS (SELECT t.model, t.token, k.label, ln((coalesce(c, 0) + 1) / (coalesce(nc, 0) + v)) AS lp
  FROM (SELECT DISTINCT model, token FROM {name}_tt) t JOIN {name}_cls k ON t.model = k.model JOIN {name}_voc o ON t.model = o.model
  LEFT JOIN {name}_cnt n ON n.model = t.model AND n.label = k.label AND n.token = t.token
  LEFT JOIN {name}_csz z ON z.model = t.model AND z.label = k.label)"""


def predict_sql(name: str, train: str, test: str, shared: bool, words: str = WORDS_SQL) -> str:
    """Predictions (model, row_id, truth, predicted, confidence) for (model?, row_id, text, label)."""
    own = "model, " if shared else ""
    on = "AND h.model = l.model" if shared else ""
    match = "ON t.model = k.model" if shared else "ON true"
    return f"""{model_sql(name, train, words)},
{name}_kt AS (SELECT {own}row_id, token, count(*) AS k FROM (SELECT {own}row_id, unnest({words}) AS token FROM {test}) GROUP BY ALL),
{name}_hit AS (SELECT l.model, h.row_id, l.label, sum(k * lp) AS s FROM {name}_kt h JOIN {name}_lik l ON h.token = l.token {on} GROUP BY 1, 2, 3),
{name}_sc AS (SELECT k.model, t.row_id, t.label AS truth, k.label, round(k.prior + coalesce(s, 0), 9) AS s
  FROM {test} t JOIN {name}_cls k {match} LEFT JOIN {name}_hit h ON h.model = k.model AND h.row_id = t.row_id AND h.label = k.label),
{name}_top AS (SELECT *, max(s) OVER (PARTITION BY model, row_id) AS top, row_number() OVER (PARTITION BY model, row_id ORDER BY s DESC, label) AS place FROM {name}_sc),
{name} AS (SELECT model, row_id, any_value(truth) AS label, max(label) FILTER (WHERE place = 1) AS predicted, 1 / sum(exp(s - top)) AS confidence
  FROM {name}_top GROUP BY 1, 2)"""


def scores_sql(name: str, predictions: str) -> str:
    """accuracy, f1 and complexity_abs per model."""
    return f"""
{name}_side AS (SELECT model, label AS class, CAST(label = predicted AS INTEGER) * 2 AS tp2 FROM {predictions} UNION ALL SELECT model, predicted, 0 FROM {predictions}),
{name}_f1 AS (SELECT model, avg(f) AS f1 FROM (SELECT model, class, sum(tp2) / count(*) AS f FROM {name}_side GROUP BY 1, 2) GROUP BY 1),
{name} AS (SELECT model, avg(CAST(label = predicted AS INTEGER)) AS accuracy, any_value(f1) AS f1, avg(1 - confidence) AS complexity_abs
  FROM {predictions} JOIN {name}_f1 USING (model) GROUP BY 1)"""


# Every dataset's first half trains, its second half tests.
HALVES = f"""{DS}, hv AS (SELECT *, dataset_id AS model, row_number() OVER (PARTITION BY dataset_id ORDER BY row_id) AS p, count(*) OVER (PARTITION BY dataset_id) AS size FROM ds),
tr AS (SELECT * FROM hv WHERE p <= size // 2), te AS (SELECT * FROM hv WHERE p > size // 2)"""
HALF_PRED = f"{HALVES}, {predict_sql('pred', 'tr', 'te', True)}"


def _half_predictions(spark, sf) -> DataFrame:
    split = sampling.halves(datasets(spark, sf))
    model = classify.train(split.filter("half = 1"), ["dataset_id"])
    return classify.predict(model, split.filter("half = 2"), ["row_id"])


@query("nb_model", f"""WITH {HALVES}, {model_sql("m", "tr")}
SELECT model AS dataset_id, token, label, round(lp, 6) AS weight FROM m_lik UNION ALL SELECT model, '', label, round(prior, 6) FROM m_cls""")
def nb_model(spark, sf):
    train = sampling.halves(datasets(spark, sf)).filter("half = 1")
    model = classify.train(train, ["dataset_id"])
    return rounded(classify.likelihoods(model))


@query("nb_predict", f"WITH {HALF_PRED} SELECT model AS dataset_id, row_id, label, predicted, round(confidence, 6) AS confidence FROM pred")
def nb_predict(spark, sf):
    return rounded(_half_predictions(spark, sf))


@query("confusion_matrix", f"WITH {HALF_PRED} SELECT model AS dataset_id, label, predicted, count(*) AS n, round(sum(1 - confidence), 6) AS doubt FROM pred GROUP BY 1, 2, 3")
def confusion_matrix(spark, sf):
    return rounded(classify.confusion(_half_predictions(spark, sf), ["dataset_id"]))


@query("clf_accuracy", f"WITH {HALF_PRED}, {scores_sql('s', 'pred')} SELECT model AS dataset_id, round(accuracy, 6) AS accuracy FROM s")
def clf_accuracy(spark, sf):
    return rounded(classify.transfer_scores(_half_predictions(spark, sf), ["dataset_id"]).select("dataset_id", "accuracy"))


@query("clf_macro_f1", f"WITH {HALF_PRED}, {scores_sql('s', 'pred')} SELECT model AS dataset_id, round(f1, 6) AS f1 FROM s")
def clf_macro_f1(spark, sf):
    cells = classify.confusion(_half_predictions(spark, sf), ["dataset_id"])
    return rounded(classify.macro_f1(cells, ["dataset_id"]))


@query("clf_complexity", f"WITH {HALF_PRED}, {scores_sql('s', 'pred')} SELECT model AS dataset_id, round(complexity_abs, 6) AS complexity_abs FROM s")
def clf_complexity(spark, sf):
    return rounded(classify.transfer_scores(_half_predictions(spark, sf), ["dataset_id"]).select("dataset_id", "complexity_abs"))


_PAIR_WORDS = f"list_concat(list_transform({WORDS_SQL}, lambda w: 'a:' || w), list_transform({WORDS_SQL.replace('text', 'other_text')}, lambda w: 'b:' || w))"


@query("nb_pairs", f"""WITH pr AS (SELECT u.conv_id * 1000 + u.turn AS row_id, u.text, a.text AS other_text, 'turn' || CAST(u.turn AS VARCHAR) AS label, u.conv_id % 2 AS half, 'pairs' AS model
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'),
tr AS (SELECT * FROM pr WHERE half = 0), te AS (SELECT * FROM pr WHERE half = 1), {predict_sql("pred", "tr", "te", True, _PAIR_WORDS)}
SELECT row_id, label, predicted, round(confidence, 6) AS confidence FROM pred""")
def nb_pairs(spark, sf):
    turns = table(spark, sf, "conversations")
    answers = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("other_text"))
    rows = turns.filter("role = 'user'").join(answers, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"),
        "text",
        "other_text",
        F.concat(F.lit("turn"), F.col("turn").cast("string")).alias("label"),
        (F.col("conv_id") % 2).alias("half"),
        F.lit("pairs").alias("model"),
    )
    words = classify.pair_words()
    model = classify.train(rows.filter("half = 0"), ["model"], words)
    return rounded(classify.predict(model, rows.filter("half = 1"), ["row_id"], words).drop("model"))


def folds_sql(source: str) -> str:
    """Fold parts of a dataset CTE, named so that its (dataset, run) is the model."""
    return f"""{PARTS.replace("FROM ds", f"FROM {source}")},
tr AS (SELECT *, dataset_id || '|' || CAST(run AS VARCHAR) AS model FROM parts WHERE side = 'train'),
va AS (SELECT *, dataset_id || '|' || CAST(run AS VARCHAR) AS model FROM parts WHERE side = 'valid')"""


_RUN_KEY = "split_part(model, '|', 1) AS dataset_id, CAST(split_part(model, '|', 2) AS BIGINT) AS run"
_SCORES = "round(accuracy, 6) AS accuracy, round(f1, 6) AS f1, round(complexity_abs, 6) AS complexity_abs"


@query("fake_to_real", f"""WITH {GEN}, {REAL}, {folds_sql("gen")}, {predict_sql("pred", "tr", "real_set", False)}, {scores_sql("s", "pred")}
SELECT {_RUN_KEY}, {_SCORES} FROM s""")
def fake_to_real(spark, sf):
    return rounded(evaluate.fake_to_real(evaluate.make_folds(generated(spark, sf), real(spark, sf))))


@query("fake_to_fake", f"""WITH {GEN}, {folds_sql("gen")}, {predict_sql("pred", "tr", "va", True)}, {scores_sql("s", "pred")}
SELECT {_RUN_KEY}, {_SCORES} FROM s""")
def fake_to_fake(spark, sf):
    return rounded(evaluate.fake_to_fake(evaluate.make_folds(generated(spark, sf), real(spark, sf))))


REAL_HALVES = f"""{REAL}, rh AS (SELECT *, row_number() OVER (ORDER BY row_id) AS p, count(*) OVER () AS size FROM real_set),
h1 AS (SELECT dataset_id, row_id, text, label FROM rh WHERE p <= size // 2), h2 AS (SELECT dataset_id, row_id, text, label FROM rh WHERE p > size // 2)"""
REAL_TRAIN = f"""ho AS (SELECT *, 'real' AS model, row_number() OVER (ORDER BY {_KEY}) AS p, count(*) OVER () AS size FROM h1),
rtr AS (SELECT * FROM ho WHERE p > ceil(size * 0.3::DOUBLE))"""


# Some generated rows get a label that the real set lacks; they must not be scored.
_STRANGE = "CASE WHEN row_id % 10 = 0 THEN 'strange' ELSE label END"
KNOWN_GEN = f"""{GEN.replace("gen AS", "all_gen AS")},
gen AS (SELECT dataset_id, row_id, text, {_STRANGE} AS label FROM all_gen WHERE {_STRANGE} IN (SELECT label FROM real_set))"""


@query("real_to_fake", f"""WITH {REAL_HALVES}, {KNOWN_GEN}, {REAL_TRAIN}, {predict_sql("pred", "rtr", "gen", False)},
byset AS (SELECT dataset_id AS model, p.row_id, p.label, predicted, confidence FROM pred p JOIN gen USING (row_id)), {scores_sql("s", "byset")}
SELECT model AS dataset_id, {_SCORES} FROM s""")
def real_to_fake(spark, sf):
    fake = generated(spark, sf).withColumn("label", F.expr(_STRANGE))
    return rounded(evaluate.real_to_fake(fake, real(spark, sf)))


@query("real_baseline", f"""WITH {REAL_HALVES}, {folds_sql("h1")}, {predict_sql("pred", "tr", "h2", False)}, {scores_sql("s", "pred")}
SELECT {_RUN_KEY}, {_SCORES} FROM s""")
def real_baseline(spark, sf):
    first, second = evaluate.real_halves(real(spark, sf))
    return rounded(evaluate.fake_to_real(evaluate.make_folds(first, second)))


def _long_sql(scores: str, prefix: str) -> str:
    return " UNION ALL ".join(
        f"SELECT {_RUN_KEY}, '{prefix}.{m}' AS metric, {m} AS value FROM {scores}" for m in ("accuracy", "f1", "complexity_abs")
    )


@query("kfold_summary", f"""WITH {GEN}, {folds_sql("gen")}, {predict_sql("pred", "tr", "va", True)}, {scores_sql("s", "pred")}, l AS ({_long_sql("s", "fake")})
SELECT dataset_id, metric, round(avg(value), 6) AS mean, round(stddev_pop(value) / count(value), 6) AS std, round(stddev_pop(value) / sqrt(count(value)), 6) AS stderr FROM l GROUP BY 1, 2""")
def kfold_summary(spark, sf):
    scores = evaluate.fake_to_fake(evaluate.make_folds(generated(spark, sf), real(spark, sf)))
    return rounded(metrics.kfold_summary(metrics.wide_to_long(scores, evaluate.KEY, "fake.")))


def _match_cte(tag: str, train: str, test: str) -> str:
    """CTE {tag}_match_score: the match of hashed texts of every fold with the test set."""
    own, real = f"{tag}_own", f"{tag}_base"
    return f"""{hash_sql(own, f"(SELECT model AS dataset_id, row_id, text FROM {train})", test, "dataset_id, 0 AS test_set, row_id")},
{hash_sql(real, test, test, "0 AS test_set, row_id")},
{match_sql(f"{tag}_match", own, real)}"""


def _fold_parts_sql(tag: str, source: str) -> str:
    """``folds_sql`` with ``tag`` before the names of its CTEs."""
    parts = folds_sql(source)
    for cte in ("folds", "sizes", "rest", "parts", "tr", "va"):
        parts = re.sub(rf"\b{cte}\b(?= AS \()", f"{tag}_{cte}", parts)
        parts = re.sub(rf"\b(FROM|JOIN) {cte}\b", rf"\1 {tag}_{cte}", parts)
    return parts


def _all_sql(tag: str, source: str, test: str) -> str:
    """Fold values of every measure for one dataset CTE against one test CTE."""
    parts = _fold_parts_sql(tag, source)
    tr, va = f"{tag}_tr", f"{tag}_va"
    return f"""{parts},
{tag}_tokens AS (SELECT model AS dataset_id, unnest({TOKENS_SQL}) AS token FROM {tr}),
{tag}_plain AS (SELECT dataset_id, count(DISTINCT token) / count(*) AS d FROM {tag}_tokens GROUP BY 1),
{tag}_counts AS (SELECT dataset_id, token, count(*) AS n FROM {tag}_tokens GROUP BY 1, 2), {rarefied_sql(f"{tag}_counts", f"{tag}_rare")},
{tag}_words AS (SELECT dataset_id, regexp_replace(w, '^[\\p{{P}}\\p{{S}}]+|[\\p{{P}}\\p{{S}}]+$', '', 'g') AS word
  FROM (SELECT model AS dataset_id, unnest(regexp_split_to_array(lower(text), '[{WHITESPACE}]+')) AS w FROM {tr})),
{tag}_lemmas AS (SELECT dataset_id, regexp_replace({_lemma_sql("word")}, '[^a-zA-Z]', '', 'g') AS token FROM {tag}_words WHERE word <> '' AND word NOT IN ({_STOP})),
{tag}_lcounts AS (SELECT dataset_id, token, count(*) AS n FROM {tag}_lemmas GROUP BY 1, 2), {rarefied_sql(f"{tag}_lcounts", f"{tag}_lrare")},
{_match_cte(tag, tr, test)},
{predict_sql(f"{tag}_pr", tr, test, False)}, {scores_sql(f"{tag}_sr", f"{tag}_pr")},
{predict_sql(f"{tag}_pf", tr, va, True)}, {scores_sql(f"{tag}_sf", f"{tag}_pf")},
{tag}_long AS (
  SELECT {_RUN_KEY.replace("model", "dataset_id")}, 'average_distinctness.3' AS metric, coalesce(value, d) AS value FROM {tag}_plain LEFT JOIN {tag}_rare USING (dataset_id)
  UNION ALL SELECT {_RUN_KEY.replace("model", "dataset_id")}, 'distinctness.3', d FROM {tag}_plain
  UNION ALL SELECT {_RUN_KEY.replace("model", "dataset_id")}, 'average_distinctness_spacy.1', coalesce(value, d) FROM {tag}_plain LEFT JOIN {tag}_lrare USING (dataset_id)
  UNION ALL SELECT {_RUN_KEY.replace("model", "dataset_id")}, 'mauve', mauve FROM {tag}_match_score
  UNION ALL {_long_sql(f"{tag}_sr", "finetune_temporal_fake_to_real")}
  UNION ALL {_long_sql(f"{tag}_sf", "finetune_temporal_fake_to_fake")})"""


EVERY = f"""WITH {GEN}, {REAL_HALVES}, {REAL_TRAIN}, {_all_sql("g", "gen", "real_set")}, {_all_sql("r", "h1", "h2")},
{predict_sql("rf", "rtr", "gen", False)}, rfset AS (SELECT dataset_id AS model, p.row_id, p.label, predicted, confidence FROM rf p JOIN gen USING (row_id) WHERE p.label IN (SELECT label FROM real_set)), {scores_sql("rfs", "rfset")},
summary AS (SELECT dataset_id, metric, avg(value) AS value, stddev_pop(value) / count(value) AS std FROM (SELECT * FROM g_long UNION ALL SELECT * FROM r_long) GROUP BY 1, 2),
every AS (SELECT * FROM summary
  UNION ALL SELECT model, 'finetune_temporal_real_to_fake.accuracy', accuracy, NULL FROM rfs
  UNION ALL SELECT model, 'finetune_temporal_real_to_fake.f1', f1, NULL FROM rfs
  UNION ALL SELECT model, 'finetune_temporal_real_to_fake.complexity_abs', complexity_abs, NULL FROM rfs
  UNION ALL SELECT dataset_id, replace(metric, '_fake_to_fake', '_real_to_fake'), value, std FROM summary WHERE dataset_id = 'real' AND metric LIKE 'finetune_temporal_fake_to_fake%')"""


@query("evaluate_all", f"""{EVERY}
SELECT dataset_id, metric, round(value, 6) AS value, round(std, 6) AS std FROM every""")
def evaluate_all(spark, sf):
    return rounded(evaluate.evaluate_all(generated(spark, sf), real(spark, sf), exclude=()))


# Half the sources first, one of them with a value of its own.
_STEPWISE = """long_rows AS (SELECT dataset_id, metric, value FROM every UNION ALL SELECT dataset_id, metric || '_std', std FROM every WHERE std IS NOT NULL)
SELECT dataset_id, metric, CASE WHEN dataset_id = 'src5' AND metric = 'distinctness.3' THEN -1 ELSE round(value, 6) END AS value
FROM long_rows WHERE NOT (dataset_id = 'src5' AND metric = 'distinctness.3_std')"""


@query("evaluate_incremental", f"{EVERY}, {_STEPWISE}")
def evaluate_incremental(spark, sf):
    """A store filled in two steps: the second takes only what the first left out."""
    path = scratch_path(spark, "metrics")
    fake, true = generated(spark, sf), real(spark, sf)
    stores.write_store(spark.createDataFrame([("src5", "distinctness.3", -1.0)], stores.STORE), path, 1)
    evaluate.evaluate_into(path, fake.filter(F.col("dataset_id").rlike("[02468]$")), true, exclude=())
    return rounded(evaluate.evaluate_into(path, fake, true, exclude=()))


_STD_MEASURES = ", ".join(
    f"{'1 - ' if m == 'complexity' else ''}max({v}) FILTER (WHERE metric = '{n}') AS {m}{suffix}"
    for v, suffix in (("value", ""), ("std", "_std")) for m, n in report.MEASURES.items()
).replace("1 - max(std)", "max(std)")
_TABLE_COLUMNS = [f"{m}{suffix}" for suffix in ("", "_std") for m in report.MEASURES]


@query("experiment_table_std", f"""{EVERY}, {CONFIGS}, settings AS (SELECT DISTINCT * EXCLUDE (task) FROM configs),
wide AS (SELECT dataset_id, {_STD_MEASURES} FROM every GROUP BY 1)
SELECT position, model, temperature, top_p, {", ".join(f"round({c}, 6) AS {c}" for c in _TABLE_COLUMNS)} FROM wide JOIN settings USING (dataset_id)
UNION ALL SELECT -1, 'real', 1.0, 1.0, {", ".join(f"round({c}, 6)" for c in _TABLE_COLUMNS)} FROM wide WHERE dataset_id = 'real'""")
def experiment_table_std(spark, sf):
    """From documents to the table of runs, every measure computed, with its spread."""
    path = scratch_path(spark, "metrics")
    store = evaluate.evaluate_into(path, generated(spark, sf), real(spark, sf), exclude=())
    runs = report.run_flags(run_configs(spark, sf)).drop("task").distinct()
    by_run = store.join(runs.select("dataset_id", "position"), "dataset_id")
    out = report.experiment_table(by_run, runs, store.filter("dataset_id = 'real'"), key=("position",), include_std=True)
    return rounded(out.select("position", "model", "temperature", "top_p", *_TABLE_COLUMNS))


@query("mauve_documents", f"""WITH {GEN}, {REAL_HALVES}, {_fold_parts_sql("g", "gen")}, {_match_cte("g", "g_tr", "real_set")},
{_fold_parts_sql("r", "h1")}, {_match_cte("r", "r_tr", "h2")},
l AS (SELECT {_RUN_KEY.replace("model", "dataset_id")}, mauve FROM (SELECT * FROM g_match_score UNION ALL SELECT * FROM r_match_score))
SELECT dataset_id, 'mauve' AS metric, round(avg(mauve), 6) AS value, round(stddev_pop(mauve) / count(mauve), 6) AS std FROM l GROUP BY 1""")
def mauve_documents(spark, sf):
    """Distribution match of hashed text vectors alone."""
    exclude = tuple(m for m in evaluate.MEASURES if m != "mauve")
    return rounded(evaluate.evaluate_all(generated(spark, sf), real(spark, sf), exclude=exclude))


@query("lr_eval")
def lr_eval(spark, sf):
    """The same transfer with logistic regression on hashed words: real trains, every generated set tests."""
    fake, true = generated(spark, sf), real(spark, sf)
    hashing = HashingTF(inputCol="words", outputCol="features", numFeatures=4096)
    indexer = StringIndexer(inputCol="label", outputCol="code", stringOrderType="alphabetAsc").fit(true)
    train = indexer.transform(hashing.transform(true.withColumn("words", word_array("text"))))
    model = LogisticRegression(labelCol="code", maxIter=20, regParam=0.01).fit(train)
    known = fake.filter(F.col("label").isin(list(indexer.labels)))
    scored = model.transform(hashing.transform(known.withColumn("words", word_array("text"))))
    names = F.array(*[F.lit(v) for v in indexer.labels])
    guesses = scored.select(
        "dataset_id",
        "label",
        F.element_at(names, F.col("prediction").cast("int") + 1).alias("predicted"),
        F.array_max(vector_to_array("probability")).alias("confidence"),
    )
    return rounded(classify.transfer_scores(guesses, ["dataset_id"]))


def logistic_sql(name: str, train: str, test: str, steps: int, rate: float = 4.0, penalty: float = 0.001, dim: int = 256) -> str:
    """Predictions of logistic regression trained on (model, row_id, text, label), for test rows of the same models."""

    def features(tag: str, rows: str) -> str:
        return f"""{tag}_b AS (SELECT model, row_id, label, list_transform({WORDS_SQL}, lambda w: {key_number_sql("md5(w)")} % {dim}) AS b FROM {rows}),
{tag}_c AS (SELECT model, row_id, j, CAST(count(*) AS DOUBLE) AS c FROM (SELECT model, row_id, unnest(b) AS j FROM {tag}_b) GROUP BY 1, 2, 3),
{tag} AS MATERIALIZED (SELECT model, row_id, j, c / sqrt(sum(c * c) OVER (PARTITION BY model, row_id)) AS x FROM {tag}_c
  UNION ALL SELECT model, row_id, {dim}, 1.0::DOUBLE FROM {tag}_b)"""

    def scores(tag: str, rows: str, weights: str) -> str:
        return f"""{tag}_s AS (SELECT model, row_id, class, sum(x * w) AS s FROM {rows} JOIN {weights} USING (model, j) GROUP BY 1, 2, 3),
{tag} AS MATERIALIZED (SELECT model, row_id, class, exp(s - max(s) OVER r) / sum(exp(s - m)) OVER r AS p
  FROM (SELECT *, max(s) OVER (PARTITION BY model, row_id) AS m FROM {tag}_s) WINDOW r AS (PARTITION BY model, row_id))"""

    out = [f"""{features(f"{name}_x", train)}, {features(f"{name}_y", test)},
{name}_n AS (SELECT model, count(*) AS n FROM {name}_x_b GROUP BY 1), {name}_k AS (SELECT DISTINCT model, label AS class FROM {name}_x_b),
{name}_w0 AS MATERIALIZED (SELECT model, class, unnest(range({dim + 1})) AS j, 0.0::DOUBLE AS w FROM {name}_k)"""]
    for i in range(steps):
        out.append(f"""{scores(f"{name}_p{i}", f"{name}_x", f"{name}_w{i}")},
{name}_g{i} AS (SELECT model, class, j, sum((p - CAST(label = class AS INTEGER)) * x) AS g FROM {name}_p{i} JOIN {name}_x USING (model, row_id) JOIN {name}_x_b USING (model, row_id) GROUP BY 1, 2, 3),
{name}_w{i + 1} AS MATERIALIZED (SELECT model, class, j, w - {rate} * (coalesce(g, 0) / n + {penalty} * w) AS w FROM {name}_w{i} JOIN {name}_n USING (model) LEFT JOIN {name}_g{i} USING (model, class, j))""")
    out.append(f"""{scores(f"{name}_q", f"{name}_y", f"{name}_w{steps}")},
{name} AS (SELECT model, row_id, label, arg_min(class, {{'p': -round(p, 9), 'c': class}}) AS predicted, max(p) AS confidence FROM {name}_q JOIN {name}_y_b USING (model, row_id) GROUP BY 1, 2, 3)""")
    return ",\n".join(out)


@query("lr_folds", f"""WITH {GEN}, {folds_sql("gen")}, {logistic_sql("pred", "tr", "va", 6)}, {scores_sql("s", "pred")}
SELECT {_RUN_KEY}, {_SCORES} FROM s""")
def lr_folds(spark, sf):
    """Logistic regression of every dataset and fold at once, judged on the fold's validation rows."""
    folds = evaluate.make_folds(generated(spark, sf), real(spark, sf))
    weights = logistic.train(folds.train, evaluate.KEY, steps=6)
    return rounded(classify.transfer_scores(logistic.predict(weights, folds.valid, evaluate.KEY), evaluate.KEY))
