"""Queries over features, training, scoring, detectors and streams."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import grams, linear, metrics, naive_bayes, sampling, stacked
from tongueprint.operators.scorers import ProfileDetector, PythonScorer
from tongueprint.plans import jobs
from tongueprint.plans.catalog import (
    SQL_DOCS, SQL_LABEL_SCORES, SQL_PAGES, codes_of, conversation_turns, documents, labels_only, query, rounded, rounded_doubles, sql_bucket,
    sql_fraction, sql_grams, sql_key, table, web_pages,
)
from tongueprint.plans.queries_sampling import _SQL_DETECTOR, french_detector_data
from tongueprint.session import shared_dir, spread
from tongueprint.sources import runs
from tongueprint.sources.corpus import LANG, TEXT, constant_corpus, labelled_corpus
from tongueprint.streaming import incremental

# Buckets by md5, so that SQL can repeat them; VOCABULARY keeps the grams themselves.
HASHED = GramSpec(portable=True)
VOCABULARY = GramSpec(buckets=None)


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = sampling.split_by_hash(documents(spark, sf_dir))
    return rows.where("part = 'train'").drop("part"), rows.where("part = 'test'").drop("part")


_SQL_SPLIT = f"""
{SQL_DOCS}, parts AS (
  SELECT *, {sql_fraction(sql_key(42, 'split'))} < 0.2 AS is_test FROM docs),
train_rows AS (SELECT row_id, sentence, lang FROM parts WHERE NOT is_test),
test_rows AS (SELECT row_id, sentence, lang FROM parts WHERE is_test)
"""


def _feature(spec: GramSpec) -> str:
    return "gram" if spec.buckets is None else sql_bucket("gram", spec.buckets)


def sql_counts(prefix: str, train: str, spec: GramSpec, label: str = "lang") -> str:
    return f"""
{sql_grams(train, f'{label} AS lang', spec.lo, spec.hi, prefix + '_g').replace(f'SELECT {label} AS lang, unnest(list', 'SELECT lang, unnest(list').replace(f"SELECT {label} AS lang, ' '", "SELECT lang, ' '")},
{prefix}_counts AS (SELECT lang, {_feature(spec)} AS feature, count(*) AS n FROM {prefix}_g GROUP BY ALL),
{prefix}_rows AS (SELECT {label} AS lang, count(*) AS n_rows FROM {train} GROUP BY ALL)
"""


def sql_predict(prefix: str, test: str, spec: GramSpec, alpha: float = 0.01, extra: str = "lang") -> str:
    """CTEs from ``<prefix>_counts`` to ``<prefix>_preds``: the textbook sums over every feature and label."""
    size = f"(SELECT count(DISTINCT feature) FROM {prefix}_counts)" if spec.buckets is None else str(spec.buckets)
    seen = f"WHERE feature IN (SELECT feature FROM {prefix}_counts)" if spec.buckets is None else ""
    return f"""
{sql_grams(test, 'row_id', spec.lo, spec.hi, prefix + '_t')},
{prefix}_tf AS (
  SELECT * FROM (SELECT row_id, {_feature(spec)} AS feature, count(*) AS tf FROM {prefix}_t GROUP BY ALL) {seen}),
{prefix}_labels AS (
  SELECT r.lang AS label, ln(r.n_rows / sum(r.n_rows) OVER ()) AS prior, coalesce(g.grams, 0) + {alpha} * {size} AS mass
  FROM {prefix}_rows r LEFT JOIN (SELECT lang, sum(n) AS grams FROM {prefix}_counts GROUP BY lang) g USING (lang)),
{prefix}_sums AS (
  SELECT row_id, label, sum(tf * ln((coalesce(n, 0) + {alpha}) / mass)) AS s
  FROM {prefix}_tf CROSS JOIN {prefix}_labels l LEFT JOIN {prefix}_counts c ON c.lang = l.label AND c.feature = {prefix}_tf.feature
  GROUP BY row_id, label),
{prefix}_scores AS (
  SELECT t.row_id, l.label, l.prior + coalesce(s.s, 0) AS score
  FROM (SELECT row_id FROM {test}) t CROSS JOIN {prefix}_labels l
  LEFT JOIN {prefix}_sums s ON s.row_id = t.row_id AND s.label = l.label),
{prefix}_best AS (
  SELECT row_id, label AS pred, row_number() OVER (PARTITION BY row_id ORDER BY round(score, 6) DESC, label) AS rn,
         1.0 / sum(exp(score - top)) OVER (PARTITION BY row_id) AS confidence
  FROM (SELECT *, max(score) OVER (PARTITION BY row_id) AS top FROM {prefix}_scores)),
{prefix}_preds AS (
  SELECT t.row_id, {extra}, b.pred, b.confidence FROM {test} t JOIN {prefix}_best b ON b.row_id = t.row_id AND b.rn = 1)
"""


def sql_overall(source: str, model: str) -> str:
    """SELECT of the overall scores of ``source(lang, pred)``."""
    return f"""
SELECT '{model}' AS model, sum(support) AS n, count(*) AS n_languages, round(sum(hits) / sum(support), 6) AS accuracy,
       round(avg(2.0 * hits / (support + predicted)), 6) AS macro_f1
FROM (SELECT lang, count(*) AS support, count(*) FILTER (lang = pred) AS hits FROM {source} GROUP BY lang) g
LEFT JOIN (SELECT pred, count(*) AS predicted FROM {source} GROUP BY pred) p ON g.lang = p.pred
""".replace("support + predicted", "support + coalesce(predicted, 0)")


@query("ngram_counts", f"""
WITH {SQL_DOCS}, {sql_grams('docs', 'row_id', 2, 4)}
SELECT row_id, gram AS feature, count(*) AS tf FROM grams GROUP BY ALL
""")
def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.gram_counts(documents(spark, sf_dir), VOCABULARY, ["row_id"])


@query("hashed_counts", f"""
WITH {SQL_DOCS}, {sql_grams('docs', 'row_id', 2, 4)}
SELECT row_id, {sql_bucket('gram')} AS feature, count(*) AS tf FROM grams GROUP BY ALL
""")
def hashed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grams.gram_counts(documents(spark, sf_dir), HASHED, ["row_id"])


_SQL_TFIDF = f"""
{SQL_DOCS}, {sql_grams('docs', 'row_id', 2, 5)}, tf AS (SELECT row_id, gram AS feature, count(*) AS tf FROM grams GROUP BY ALL),
idf AS (
  SELECT feature, ln((1.0 + (SELECT count(*) FROM docs)) / (1.0 + count(*))) + 1.0 AS idf FROM tf GROUP BY feature HAVING count(*) >= 2),
raw AS (SELECT row_id, feature, tf, tf * idf AS w FROM tf JOIN idf USING (feature)),
weights AS (SELECT row_id, feature, tf, w / sqrt(sum(w * w) OVER (PARTITION BY row_id)) AS weight FROM raw)
"""


@query("tfidf_weights", f"WITH {_SQL_TFIDF} SELECT row_id, feature, tf, round(weight, 6) AS weight FROM weights")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded_doubles(grams.tfidf(documents(spark, sf_dir), GramSpec(2, 5, None)), "weight")


@query("tfidf_top", f"""
WITH {_SQL_TFIDF}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY round(weight, 6) DESC, feature) AS place FROM weights)
SELECT row_id, place, feature, round(weight, 6) AS weight FROM placed WHERE place <= 5
""")
def tfidf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = rounded_doubles(grams.tfidf(documents(spark, sf_dir), GramSpec(2, 5, None), most=5), "weight")
    place = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("weight"), "feature"))
    return weights.withColumn("place", place).where("place <= 5").select("row_id", "place", "feature", "weight")


@query("nb_model", f"WITH {_SQL_SPLIT}, {sql_counts('m', 'train_rows', HASHED)} SELECT lang, feature, n FROM m_counts")
def nb_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes.fit(_split(spark, sf_dir)[0], HASHED).counts


@query("nb_class_totals", f"""
WITH {_SQL_SPLIT}, {sql_counts('m', 'train_rows', VOCABULARY)}
SELECT lang, n_rows, sum(n) AS n_grams, count(*) AS n_features FROM m_rows JOIN m_counts USING (lang) GROUP BY lang, n_rows
""")
def nb_class_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naive_bayes.class_totals(naive_bayes.fit(_split(spark, sf_dir)[0], VOCABULARY))


def _predictions(spark: SparkSession, sf_dir: str, spec: GramSpec) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return naive_bayes.fit(train, spec).predict(test)


_SQL_HASHED = f"{_SQL_SPLIT}, {sql_counts('m', 'train_rows', HASHED)}, {sql_predict('m', 'test_rows', HASHED)}"
_SQL_VOCABULARY = f"{_SQL_SPLIT}, {sql_counts('m', 'train_rows', VOCABULARY)}, {sql_predict('m', 'test_rows', VOCABULARY)}"


@query("nb_predict", f"WITH {_SQL_HASHED} SELECT row_id, lang, pred FROM m_preds")
def nb_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predictions(spark, sf_dir, HASHED).select("row_id", LANG, "pred")


@query("nb_confidence", f"WITH {_SQL_HASHED} SELECT row_id, pred, round(confidence, 6) AS confidence FROM m_preds")
def nb_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_predictions(spark, sf_dir, HASHED).select("row_id", "pred", "confidence"), "confidence")


@query("nb_scores", f"WITH {_SQL_HASHED} SELECT row_id, label AS lang, round(score, 4) AS score FROM m_scores")
def nb_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return rounded(naive_bayes.fit(train, HASHED).score_table(test), "score", digits=4)


# So small that most gains of a model have to be joined and cannot be sent.
SMALL_LIMIT = 2**18


@query("nb_predict_large_model", f"WITH {_SQL_HASHED} SELECT row_id, pred, round(confidence, 6) AS confidence FROM m_preds")
def nb_predict_large_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for models too large to send: frequent features as lists, the rest by joins."""
    train, test = _split(spark, sf_dir)
    found = naive_bayes.fit(train, HASHED).predict(test, broadcast_limit=SMALL_LIMIT)
    return rounded(found.select("row_id", "pred", "confidence"), "confidence")


@query("nb_scores_large_vocabulary", f"WITH {_SQL_VOCABULARY} SELECT row_id, label AS lang, round(score, 4) AS score FROM m_scores")
def nb_scores_large_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    return rounded(naive_bayes.fit(train, VOCABULARY).score_table(test, broadcast_limit=SMALL_LIMIT), "score", digits=4)


@query("nb_predict_vocabulary", f"WITH {_SQL_VOCABULARY} SELECT row_id, lang, pred, round(confidence, 6) AS confidence FROM m_preds")
def nb_predict_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_predictions(spark, sf_dir, VOCABULARY).drop("raw_output"), "confidence")


@query("nb_per_language", f"""
WITH {_SQL_HASHED}, preds AS (SELECT lang, pred FROM m_preds), {SQL_LABEL_SCORES}
SELECT label AS lang, CASE label WHEN 'deu' THEN 'German' WHEN 'eng' THEN 'English' WHEN 'fra' THEN 'French' ELSE 'Spanish' END AS name,
       CAST(support AS BIGINT) AS support, round(recall, 6) AS recall, round(precision, 6) AS precision, round(f1, 6) AS f1
FROM scores WHERE support > 0
""")
def nb_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on 80%, label the rest, score each language: the headline job."""
    scores = metrics.per_language(_predictions(spark, sf_dir, HASHED), codes_of(spark))
    return rounded(scores, "recall", "precision", "f1")


@query("nb_merge_language", f"WITH {_SQL_SPLIT}, {sql_counts('m', 'train_rows', HASHED)} SELECT lang, feature, n FROM m_counts")
def nb_merge_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model without Spanish, then Spanish added: the counts of a model trained on everything."""
    train, _ = _split(spark, sf_dir)
    base = naive_bayes.fit(train.where(F.col(LANG) != "spa"), HASHED)
    return jobs.add_language(base, train.where(F.col(LANG) == "spa")).counts


def _sql_f1(prefix: str) -> str:
    return f"""
{prefix}_f1 AS (
  SELECT g.lang, support, 2.0 * hits / (support + coalesce(predicted, 0)) AS f1
  FROM (SELECT lang, count(*) AS support, count(*) FILTER (lang = pred) AS hits FROM {prefix}_preds GROUP BY lang) g
  LEFT JOIN (SELECT pred, count(*) AS predicted FROM {prefix}_preds GROUP BY pred) p ON g.lang = p.pred)
"""


@query("add_language_report", f"""
WITH {_SQL_SPLIT}, train_without AS (SELECT * FROM train_rows WHERE lang <> 'spa'),
{sql_counts('b', 'train_without', HASHED)}, {sql_predict('b', 'test_rows', HASHED)}, {_sql_f1('b')},
{sql_counts('a', 'train_rows', HASHED)}, {sql_predict('a', 'test_rows', HASHED)}, {_sql_f1('a')}
SELECT lang, round(b_f1.f1, 6) AS f1_before, round(a_f1.f1, 6) AS f1_after, round(a_f1.f1 - b_f1.f1, 6) AS f1_change,
       b_f1.support AS support_before, a_f1.support AS support_after
FROM b_f1 FULL JOIN a_f1 USING (lang)
""")
def add_language_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    codes = codes_of(spark)
    base = naive_bayes.fit(train.where(F.col(LANG) != "spa"), HASHED)
    extended = jobs.add_language(base, train.where(F.col(LANG) == "spa"))
    before = metrics.per_language(base.predict(test), codes)
    after = metrics.per_language(extended.predict(test), codes)
    return rounded(jobs.before_after(before, after), "f1_before", "f1_after", "f1_change")


SWEEP = {"bigrams": GramSpec(2, 2, None), "trigrams": GramSpec(2, 3, None), "fourgrams": GramSpec(2, 4, None)}


def _sql_sweep() -> str:
    steps = [
        f"{sql_counts(name, 'train_rows', spec)}, {sql_predict(name, 'test_rows', spec)}" for name, spec in SWEEP.items()
    ]
    return f"{_SQL_SPLIT}, {', '.join(steps)}"


@query("nb_model_sweep", f"WITH {_sql_sweep()} {' UNION ALL '.join(sql_overall(f'{m}_preds', m) for m in SWEEP)}")
def nb_model_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all models of the sweep; it fails if one of them does, as a missing row would look like a result."""
    train, test = _split(spark, sf_dir)
    result = jobs.sweep(test, stacked.fit_many(train, SWEEP), codes_of(spark))
    return rounded(metrics.overall(result.whole(), ["model"]), "accuracy", "macro_f1")


class WithoutWeights:
    """A model whose weights are missing, as a sweep over many models meets it."""

    name = "without-weights"

    def predict(self, df: DataFrame, **_: object) -> DataFrame:
        return df.withColumn("pred", F.raise_error(F.lit("the weights are missing")).cast("string"))


@query("sweep_outcomes", f"""
WITH {_SQL_SPLIT}, {sql_counts('bigrams', 'train_rows', SWEEP['bigrams'])}, {sql_predict('bigrams', 'test_rows', SWEEP['bigrams'])},
{sql_counts('hashed', 'train_rows', HASHED)}, {sql_predict('hashed', 'test_rows', HASHED)}
SELECT 'bigrams' AS model, lang, pred, count(*) AS n_rows, CAST(NULL AS BOOLEAN) AS failed FROM bigrams_preds GROUP BY ALL
UNION ALL SELECT 'hashed', lang, pred, count(*), NULL FROM hashed_preds GROUP BY ALL
UNION ALL SELECT 'without-weights', NULL, NULL, 0, true
""")
def sweep_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels that models with grams and with buckets give, side by side, and the model that failed among them."""
    train, test = _split(spark, sf_dir)
    models = stacked.fit_many(train, {"bigrams": SWEEP["bigrams"], "hashed": HASHED})
    result = jobs.sweep(test, {**models, "without-weights": WithoutWeights()}, codes_of(spark))
    given = result.predictions.groupBy("model", LANG, "pred").agg(F.count("*").alias("n_rows"))
    failed = jobs.outcomes(result, test).where("error IS NOT NULL")
    none = F.lit(None).cast("string")
    return given.withColumn("failed", F.lit(None).cast("boolean")).unionByName(
        failed.select("model", none.alias(LANG), none.alias("pred"), "n_rows", F.col("error").contains("weights are missing").alias("failed"))
    )


@query("cross_domain_overall", f"""
WITH {_SQL_SPLIT}, {SQL_PAGES}, {sql_counts('m', 'docs', HASHED)}, {sql_predict('m', 'page_docs', HASHED)}
{sql_overall('m_preds', 'charngram-nb')}
""")
def cross_domain_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the documents, evaluate on the pages."""
    model = naive_bayes.fit(documents(spark, sf_dir), HASHED, name="charngram-nb")
    return rounded(jobs.evaluate(web_pages(spark, sf_dir), model, codes_of(spark)).overall, "accuracy", "macro_f1")


@query("multilingual_report", f"""
WITH {_SQL_SPLIT}, sampled AS (SELECT * FROM train_rows WHERE {sql_fraction(sql_key(42, 'fraction'))} < 0.15),
{sql_counts('m', 'sampled', HASHED)}, {sql_predict('m', 'test_rows', HASHED)},
preds AS (SELECT lang, pred FROM m_preds), {SQL_LABEL_SCORES}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM scores
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM scores
""")
def multilingual_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fraction of the training split, a model over all languages, and its report on held-out rows."""
    rows = documents(spark, sf_dir)
    corpus = sampling.split_by_hash(rows).withColumnRenamed("part", "split")
    model = jobs.train_multilingual(corpus, 0.15, HASHED)
    report = metrics.classification_report(model.predict(corpus.where(F.col("split") == "test")))
    return rounded(report, "precision", "recall", "f1")


@query("profile_detector", f"""
WITH {_SQL_SPLIT}, chat AS (SELECT conv_id || '-' || turn AS row_id, text AS sentence, 'und' AS lang FROM conversations),
{sql_counts('m', 'train_rows', HASHED)}, {sql_predict('m', 'chat', HASHED)}
SELECT row_id, CASE WHEN sentence IS NULL OR trim(sentence) = '' THEN 'und' ELSE pred END AS pred,
       round(CASE WHEN trim(sentence) <> '' THEN confidence END, 6) AS confidence
FROM m_preds JOIN chat USING (row_id)
""")
def profile_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of the unlabelled conversation turns by a ready model."""
    detector = ProfileDetector(naive_bayes.fit(_split(spark, sf_dir)[0], HASHED))
    found = detector.predict(conversation_turns(spark, sf_dir), keep=[])
    return rounded(found.select("row_id", "pred", "confidence"), "confidence")


@query("detector_scores", f"""
WITH {_SQL_DETECTOR}, {sql_counts('m', 'det_train', HASHED, 'label')}, {sql_predict('m', 'det_test', HASHED, extra='lang, is_target')},
c AS (
  SELECT count(*) AS n, count(*) FILTER (pred = 'fra' AND is_target) AS tp, count(*) FILTER (pred = 'fra') AS said,
         count(*) FILTER (is_target) AS pos, count(*) FILTER ((pred = 'fra') = is_target) AS good FROM m_preds)
SELECT 'charngram-nb' AS model, n, round(tp / said, 6) AS precision, round(tp / pos, 6) AS recall, round(2.0 * tp / (said + pos), 6) AS f1,
       round(good / n, 6) AS accuracy FROM c
""")
def detector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = jobs.train_detector(french_detector_data(spark, sf_dir), codes_of(spark), spec=HASHED)
    return rounded(scores, "precision", "recall", "f1", "accuracy")


@query("logreg_detector")
def logreg_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An iterative fit: what it reached is in ``logreg_optimality``."""
    _, scores = jobs.train_detector(french_detector_data(spark, sf_dir), codes_of(spark), "logreg")
    return rounded(scores, "precision", "recall", "f1", "accuracy", digits=3)


@query("svm_detector")
def svm_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, scores = jobs.train_detector(french_detector_data(spark, sf_dir), codes_of(spark), "linear_svm")
    return rounded(scores, "precision", "recall", "f1", "accuracy", digits=3)


_SQL_OPTIMAL = f"""
WITH {_SQL_DETECTOR}
SELECT 'other' AS label, count(*) AS rows, TRUE AS in_range, TRUE AS weights_match, TRUE AS within_tolerance FROM det_train
"""


@query("logreg_optimality", _SQL_OPTIMAL)
def logreg_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What has to hold of a fit with the default settings, worked out from its tables: no slope above the tolerance."""
    model = linear.train_logreg(french_detector_data(spark, sf_dir).train)
    found = linear.optimality(model, "logistic")
    good = (F.col("gradient") <= 1e-4) & (F.col("gap") >= -1e-12)
    return found.select("label", "rows", "in_range", "weights_match", good.alias("within_tolerance"))


@query("svm_certificate", _SQL_OPTIMAL)
def svm_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the hinge loss: the objective is within 1e-4 of its optimum."""
    model = linear.train_linear_svm(french_detector_data(spark, sf_dir).train)
    found = linear.optimality(model, "hinge")
    good = (F.col("gap") <= 1e-4) & (F.col("gap") >= -1e-12)
    return found.select("label", "rows", "in_range", "weights_match", good.alias("within_tolerance"))


_MARKERS = {
    "deu": ["der", "die", "und", "ein"], "eng": ["the", "and", "of", "to"], "fra": ["le", "et", "les", "des"],
    "spa": ["el", "los", "las", "y"],
}


def _marker_words() -> Callable[[list[str]], list[tuple]]:
    """A small model of a caller's own: the language with most of its marker words."""
    owner = {word: code for code, words in _MARKERS.items() for word in words}

    def run(texts: list[str]) -> list[tuple]:
        out = []
        for text in texts:
            hits = [owner[w] for w in text.lower().split() if w in owner]
            best = min(set(hits), key=lambda code: (-hits.count(code), code)) if hits else "und"
            out.append((best, hits.count(best) / len(hits) if hits else None, str(len(hits))))
        return out

    return run


@query("pandas_scorer", f"""
WITH {SQL_DOCS}, words AS (
  SELECT row_id, unnest(regexp_split_to_array(lower(sentence), '\\s+')) AS w FROM docs),
owner(w, code) AS (VALUES {', '.join(f"('{w}', '{c}')" for c, ws in _MARKERS.items() for w in ws)}),
hits AS (SELECT row_id, code, count(*) AS n FROM words JOIN owner USING (w) GROUP BY ALL),
best AS (
  SELECT row_id, code, n, sum(n) OVER (PARTITION BY row_id) AS total,
         row_number() OVER (PARTITION BY row_id ORDER BY n DESC, code) AS rn FROM hits)
SELECT d.row_id, d.lang, coalesce(code, 'und') AS pred, round(n / total, 6) AS confidence, coalesce(CAST(total AS VARCHAR), '0') AS raw_output
FROM docs d LEFT JOIN best b ON b.row_id = d.row_id AND b.rn = 1
""")
def pandas_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's Python model on Arrow batches of every document."""
    return rounded(PythonScorer(_marker_words, "markers").predict(documents(spark, sf_dir)), "confidence")


def _landed(spark: SparkSession, rows: DataFrame, batches: int = 4, files: int = 8) -> tuple[DataFrame, str]:
    """The rows as files in a new folder of the shared storage, and a stream that takes some per batch."""
    folder = f"{shared_dir(spark)}/tongueprint/stream-{uuid.uuid4().hex}"
    rows.repartition(batches * files, "row_id").write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in"), folder


@query("stream_nb_counts", f"WITH {SQL_DOCS}, {sql_counts('m', 'docs', HASHED)} SELECT lang, feature, n FROM m_counts")
def stream_nb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept current over micro-batches equal those of one batch."""
    stream, folder = _landed(spark, documents(spark, sf_dir))
    incremental.count_stream(stream, f"{folder}/model", f"{folder}/offsets", HASHED).awaitTermination()
    return incremental.streamed_model(spark, f"{folder}/model", HASHED).counts


@query("stream_compacted_model", f"WITH {SQL_DOCS}, {sql_counts('m', 'docs', HASHED)} SELECT lang, feature, n FROM m_counts")
def stream_compacted_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the files counted and compacted, then the rest counted and compacted onto that."""
    rows = documents(spark, sf_dir)
    stream, folder = _landed(spark, rows.where(F.col("row_id") % 2 == 0), batches=2)
    incremental.count_stream(stream, f"{folder}/model", f"{folder}/offsets", HASHED).awaitTermination()
    incremental.compact(spark, f"{folder}/model", HASHED)
    rest = rows.where(F.coalesce(F.col("row_id") % 2, F.lit(1)) != 0)
    rest.repartition(8, "row_id").write.mode("append").parquet(f"{folder}/in")
    incremental.count_stream(stream, f"{folder}/model", f"{folder}/offsets", HASHED).awaitTermination()
    return incremental.compact(spark, f"{folder}/model", HASHED).counts


@query("stream_predict", f"WITH {_SQL_HASHED} SELECT row_id, lang, pred FROM m_preds")
def stream_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    model = naive_bayes.fit(train, HASHED)
    stream, folder = _landed(spark, test)
    incremental.label_stream(stream, model, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("row_id", LANG, "pred")


def _documents_with_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source").withColumnRenamed("doc_id", "row_id")
    return labelled_corpus(spread(raw, "row_id"), codes_of(spark), LANG, "text")


@query("stream_latest_model", f"""
WITH {_SQL_SPLIT}, {SQL_PAGES}, {sql_counts('m', 'page_docs', HASHED)}, {sql_predict('m', 'docs', HASHED)}
SELECT p.row_id, d.text AS sentence, d.source, p.lang, p.pred, round(confidence, 6) AS confidence FROM m_preds p JOIN documents d ON d.doc_id = p.row_id
""")
def stream_latest_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled as they land, by the last compacted model of a stream of pages, with text and source."""
    pages, counted = _landed(spark, web_pages(spark, sf_dir), batches=2)
    incremental.count_stream(pages, f"{counted}/model", f"{counted}/offsets", HASHED).awaitTermination()
    incremental.compact(spark, f"{counted}/model", HASHED)
    stream, folder = _landed(spark, _documents_with_source(spark, sf_dir), batches=2)
    latest = incremental.LatestModel(f"{counted}/model", HASHED)
    incremental.label_stream(stream, latest, f"{folder}/out", f"{folder}/offsets").awaitTermination()
    found = spark.read.parquet(f"{folder}/out").select("row_id", TEXT, "source", LANG, "pred", "confidence")
    return rounded(found, "confidence")


@query("saved_predictions", f"""
WITH {_SQL_SPLIT}, {SQL_PAGES}, {sql_counts('m', 'page_docs', HASHED)}, {sql_predict('m', 'docs', HASHED)}
SELECT p.row_id, d.text AS sentence, d.source, p.lang, p.pred, round(confidence, 6) AS confidence, pred AS raw_output,
       (SELECT count(*) FROM docs) AS logged_rows
FROM m_preds p JOIN documents d ON d.doc_id = p.row_id
""")
def saved_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluated run read back: every row with its text, its other columns and its answer, beside the row count of its log line."""
    model = naive_bayes.fit(web_pages(spark, sf_dir), HASHED, name="charngram-nb")
    root = f"{shared_dir(spark)}/tongueprint/results-{uuid.uuid4().hex}"
    result, _ = jobs.evaluate_job(_documents_with_source(spark, sf_dir), model, codes_of(spark), "documents", root)
    logged = runs.published_log(spark, root).where(F.col("run_id") == result.run_id).select(F.col("n").alias("logged_rows"))
    return rounded(runs.read_predictions(spark, root, result.run_id), "confidence").join(F.broadcast(logged))


@query("evaluate_job", f"""
WITH {SQL_DOCS}, {SQL_PAGES}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {sql_key(4, 'fewshot')}, row_id) AS rn, {sql_key(4, 'fewshot')} AS h FROM docs),
demos AS (SELECT row_id FROM ranked ORDER BY rn > 1, h, row_id LIMIT 5),
pool AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {sql_key(4, 'sample')}, row_id) AS k FROM docs
  WHERE lang IN ('fra', 'deu', 'eng') AND row_id NOT IN (SELECT row_id FROM demos)),
chosen AS (SELECT row_id, sentence, lang FROM pool WHERE k <= 50),
{sql_counts('m', 'page_docs', HASHED)}, {sql_predict('m', 'chosen', HASHED)}
{sql_overall('m_preds', 'charngram-nb')}
""")
def evaluate_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hold out demonstrations, sample per language, score a model made from the pages, save, and report."""
    model = naive_bayes.fit(web_pages(spark, sf_dir), HASHED, name="charngram-nb")
    root = f"{shared_dir(spark)}/tongueprint/results-{uuid.uuid4().hex}"
    result, _ = jobs.evaluate_job(
        documents(spark, sf_dir), model, codes_of(spark), "documents", root, n=50, shot=5, languages="French, de, eng", seed=4
    )
    return rounded(result.overall, "accuracy", "macro_f1")


@query("evaluate_job_all", f"""
WITH {SQL_DOCS}, {SQL_PAGES}, {sql_counts('m', 'page_docs', HASHED)}, {sql_predict('m', 'docs', HASHED)}
{sql_overall('m_preds', 'charngram-nb')}
""")
def evaluate_job_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same job over every row of every language: no demonstrations, no sample."""
    model = naive_bayes.fit(web_pages(spark, sf_dir), HASHED, name="charngram-nb")
    root = f"{shared_dir(spark)}/tongueprint/results-{uuid.uuid4().hex}"
    result, _ = jobs.evaluate_job(documents(spark, sf_dir), model, codes_of(spark), "documents", root, n=0)
    return rounded(result.overall, "accuracy", "macro_f1")
