"""Queries over scores, confusions and saved runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.operators import compare, metrics
from tongueprint.plans.catalog import (
    NOISE_MODELS, SQL_DOCS, SQL_LABEL_SCORES, SQL_NOISY, codes_of, labels_only, noisy_label, noisy_predictions, query, rounded, sql_noise,
)
from tongueprint.session import materialize, shared_dir
from tongueprint.sources import runs as run_store
from tongueprint.sources.corpus import LANG

_NAMES = "CASE lang WHEN 'deu' THEN 'German' WHEN 'eng' THEN 'English' WHEN 'fra' THEN 'French' WHEN 'spa' THEN 'Spanish' ELSE lang END"
_SCORED = f"WITH {SQL_NOISY}, {SQL_LABEL_SCORES}"
_STAMP = "20240101_T000000"


@query("accuracy", f"WITH {SQL_NOISY} SELECT round(avg(CASE WHEN lang = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.accuracy(noisy_predictions(spark, sf_dir)), "accuracy")


@query("per_language", f"""
{_SCORED}
SELECT lang, {_NAMES} AS name, support, recall, precision, f1 FROM (
  SELECT label AS lang, CAST(support AS BIGINT) AS support, round(recall, 6) AS recall, round(precision, 6) AS precision,
         round(f1, 6) AS f1 FROM scores WHERE support > 0)
""")
def per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.per_language(noisy_predictions(spark, sf_dir), codes_of(spark)), "recall", "precision", "f1")


@query("macro_f1", f"{_SCORED} SELECT round(avg(f1), 6) AS macro_f1 FROM scores WHERE support > 0")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.macro_f1(noisy_predictions(spark, sf_dir)), "macro_f1")


@query("overall", f"""
{_SCORED}
SELECT CAST(sum(support) AS BIGINT) AS n, count(*) AS n_languages, round(sum(hits) / sum(support), 6) AS accuracy,
       round(avg(f1), 6) AS macro_f1 FROM scores WHERE support > 0
""")
def overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.overall(noisy_predictions(spark, sf_dir)), "accuracy", "macro_f1")


@query("confusion_long", f"WITH {SQL_NOISY} SELECT lang, pred, count(*) AS n FROM preds GROUP BY ALL")
def confusion_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pair_counts(noisy_predictions(spark, sf_dir))


@query("confusion_grid", f"""
WITH {SQL_NOISY}, gold AS (SELECT DISTINCT lang FROM preds), cols AS (SELECT lang AS pred FROM preds UNION SELECT pred FROM preds)
SELECT g.lang, c.pred, count(p.row_id) AS n FROM gold g CROSS JOIN cols c LEFT JOIN preds p ON p.lang = g.lang AND p.pred = c.pred
GROUP BY ALL
""")
def confusion_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_cells(noisy_predictions(spark, sf_dir))


@query("confusion_matrix", f"""
WITH {SQL_NOISY}
SELECT lang, {', '.join(f"count(*) FILTER (pred = '{x}') AS {x}" for x in ('deu', 'eng', 'fra', 'spa', 'ita', 'und'))} FROM preds GROUP BY lang
""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_grid(noisy_predictions(spark, sf_dir))


_SUMMARY = """
SELECT 'macro avg' AS label, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1,
       CAST(sum(support) AS BIGINT) AS support FROM wanted
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM wanted
UNION ALL
SELECT label, round(precision, 6), round(recall, 6), round(f1, 6), CAST(support AS BIGINT) FROM wanted
"""


@query("classification_report", f"""
{_SCORED}, wanted AS (SELECT * FROM scores) {_SUMMARY}
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM wanted
""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.classification_report(noisy_predictions(spark, sf_dir)), "precision", "recall", "f1")


@query("classification_report_labels", f"""
{_SCORED}, wanted AS (
  SELECT * FROM scores WHERE label IN ('fra', 'spa', 'ita')
  UNION ALL SELECT 'kab', 0.0, 0.0, 0.0, 0.0, 0.0, 0.0) {_SUMMARY}
UNION ALL SELECT 'micro avg', round(sum(hits) / sum(predicted), 6), round(sum(hits) / sum(support), 6),
  round(2.0 * sum(hits) / (sum(predicted) + sum(support)), 6), CAST(sum(support) AS BIGINT) FROM wanted
""")
def classification_report_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = metrics.classification_report(noisy_predictions(spark, sf_dir), ["fra", "spa", "ita", "kab"])
    return rounded(report, "precision", "recall", "f1")


@query("worst_languages", f"""
{_SCORED}
SELECT row_number() OVER (ORDER BY f1, label) AS rank, label AS lang, round(f1, 6) AS f1, round(precision, 6) AS precision,
       round(recall, 6) AS recall, CAST(support AS BIGINT) AS support
FROM scores WHERE support >= 20 ORDER BY f1, label LIMIT 3
""")
def worst_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    worst = metrics.worst_languages(metrics.pair_counts(noisy_predictions(spark, sf_dir)), 3, 20)
    return rounded(worst, "f1", "precision", "recall")


_SHARES = f"""
WITH {SQL_NOISY}, {SQL_LABEL_SCORES}, pairs AS (SELECT lang, pred, count(*) AS n FROM preds GROUP BY ALL),
shares AS (
  SELECT lang, pred, n, sum(n) OVER w AS total, round(n / sum(n) OVER w, 6) AS share,
         round(sum(CASE WHEN lang = pred THEN n ELSE 0 END) OVER w / sum(n) OVER w, 6) AS correct_share, lang = pred AS is_correct,
         row_number() OVER (PARTITION BY lang ORDER BY n DESC, pred) AS place
  FROM pairs WINDOW w AS (PARTITION BY lang))
"""


@query("confusions_of", f"""
{_SHARES} SELECT lang, pred, n, CAST(total AS BIGINT) AS total, share, correct_share, is_correct FROM shares WHERE lang = 'fra' AND place <= 4
""")
def confusions_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = metrics.pair_counts(noisy_predictions(spark, sf_dir))
    return rounded(metrics.confusions_of(pairs, "fra", 4), "share", "correct_share")


@query("batch_diagnosis", f"""
{_SHARES}, worst AS (
  SELECT label AS lang, row_number() OVER (ORDER BY f1, label) AS rank FROM scores WHERE support >= 20 ORDER BY f1, label LIMIT 3)
SELECT rank, lang, place, pred, n, CAST(total AS BIGINT) AS total, share, correct_share, is_correct
FROM shares JOIN worst USING (lang) WHERE place <= 3
""")
def batch_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.batch_diagnosis(metrics.pair_counts(noisy_predictions(spark, sf_dir)), 3, 20, 3)
    return rounded(found, "share", "correct_share")


def _stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of several models on the same rows, stacked, from one scan."""
    stacks = [F.struct(F.lit(m).alias("model"), noisy_label(F.col(LANG), m, keep).alias("pred")) for m, keep in NOISE_MODELS.items()]
    return labels_only(spark, sf_dir).select("row_id", LANG, F.inline(F.array(*stacks)))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored runs, one row each, written once as stored runs are."""
    return materialize(run_store.runs_table(_stacked(spark, sf_dir), codes_of(spark), "docs/all", _STAMP, "noise"), "runs")


_SQL_STACKED = " UNION ALL ".join(f"SELECT row_id, lang, '{m}' AS model, {sql_noise(m, keep)} AS pred FROM docs" for m, keep in NOISE_MODELS.items())


def _sql_long(source: str) -> str:
    return f"""
gold AS (SELECT model, lang, count(*) AS support, count(*) FILTER (lang = pred) AS hits FROM {source} GROUP BY ALL),
said AS (SELECT model, pred, count(*) AS predicted FROM {source} GROUP BY ALL),
long AS (
  SELECT g.model, g.lang, {_NAMES} AS name, support, hits, hits / support AS recall,
         CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision, 2.0 * hits / (support + coalesce(predicted, 0)) AS f1
  FROM gold g LEFT JOIN said s ON s.model = g.model AND s.pred = g.lang),
runs AS (
  SELECT model, model || '_docs_all_{_STAMP}' AS run_id, 'docs/all' AS dataset, CAST(sum(support) AS BIGINT) AS n, count(*) AS n_languages,
         sum(hits) / sum(support) AS accuracy, avg(f1) AS macro_f1 FROM long GROUP BY model)
"""


_RUNS = f"WITH {SQL_DOCS}, stacked AS ({_SQL_STACKED}), {_sql_long('stacked')}"
_OVERVIEW = "SELECT model, dataset, n, n_languages, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, run_id FROM runs"


@query("runs_overview", f"{_RUNS} {_OVERVIEW}")
def runs_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(compare.overview(_runs(spark, sf_dir)), "accuracy", "macro_f1")


@query("runs_pivot", f"""
{_RUNS} SELECT name, lang, max(support) AS support,
  {', '.join(f"round(avg(f1) FILTER (model = '{m}'), 6) AS {m}" for m in NOISE_MODELS)} FROM long GROUP BY ALL
""")
def runs_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = compare.per_language_long(_runs(spark, sf_dir))
    return rounded(compare.per_language_pivot(long, compare.model_labels(long)), *NOISE_MODELS)


@query("runs_disagreement", f"""
{_RUNS} SELECT name, lang, round(max(recall), 6) AS best, round(min(recall), 6) AS worst, round(max(recall) - min(recall), 6) AS spread
FROM long GROUP BY ALL ORDER BY max(recall) - min(recall) DESC, lang LIMIT 3
""")
def runs_disagreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = compare.disagreement(compare.per_language_long(_runs(spark, sf_dir)), "recall", 3)
    return rounded(found, "best", "worst", "spread")


@query("runs_comparable", f"""
WITH {SQL_DOCS}, stacked AS ({_SQL_STACKED}
  UNION ALL SELECT row_id, lang, 'delta', {sql_noise('delta', 0.3)} FROM docs WHERE lang <> 'spa'
  UNION ALL SELECT doc_id, l.lang, 'epsilon', l.lang FROM labels JOIN docs l ON l.row_id = doc_id), {_sql_long('stacked')},
ranked AS (SELECT *, row_number() OVER (ORDER BY macro_f1 DESC, run_id) AS place FROM runs),
lists AS (SELECT model, list(lang ORDER BY lang) AS langs, list(support ORDER BY lang) AS supports FROM long GROUP BY model),
first AS (SELECT model AS ref, langs AS ref_langs, supports AS ref_supports FROM ranked JOIN lists USING (model) WHERE place = 1)
SELECT '*' AS run_id, 'n' AS "check", string_agg(CAST(n AS VARCHAR), ', ' ORDER BY n) AS detail
FROM (SELECT DISTINCT n FROM runs) HAVING count(*) > 1
UNION ALL
SELECT run_id, CASE WHEN langs <> ref_langs THEN 'languages' ELSE 'support' END, model || ' vs ' || ref
FROM ranked JOIN lists USING (model), first WHERE place > 1 AND (langs <> ref_langs OR supports <> ref_supports)
""")
def runs_comparable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three comparable runs, one that lacks a language, one over the labelled documents only."""
    rows = labels_only(spark, sf_dir)
    delta = rows.where(F.col(LANG) != "spa").select(
        "row_id", LANG, F.lit("delta").alias("model"), noisy_label(F.col(LANG), "delta", 0.3).alias("pred")
    )
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("row_id"))
    epsilon = labelled.join(rows, "row_id").select("row_id", LANG, F.lit("epsilon").alias("model"), F.col(LANG).alias("pred"))
    preds = _stacked(spark, sf_dir).unionByName(delta).unionByName(epsilon)
    return compare.check_comparable(run_store.runs_table(preds, codes_of(spark), "docs/all", _STAMP))


@query("model_wins", f"""
WITH {SQL_DOCS}, both_preds AS (
  SELECT row_id, {sql_noise('alpha', NOISE_MODELS['alpha'])} AS a, {sql_noise('gamma', NOISE_MODELS['gamma'])} AS b FROM docs WHERE lang = 'fra')
SELECT count(*) FILTER (a = 'fra' AND b <> 'fra') AS wins, count(*) AS total,
       round(count(*) FILTER (a = 'fra' AND b <> 'fra') / count(*), 6) AS share FROM both_preds
""")
def model_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = noisy_predictions(spark, sf_dir, "alpha", NOISE_MODELS["alpha"])
    gamma = noisy_predictions(spark, sf_dir, "gamma", NOISE_MODELS["gamma"])
    return rounded(compare.model_wins(alpha, gamma, "fra"), "share")


@query("lang_page", f"""
{_RUNS}, pivoted AS (SELECT name, lang, max(support) AS support FROM long GROUP BY ALL)
SELECT name, lang, support, CAST(floor((row_number() OVER (ORDER BY support DESC, lang) - 1) / 3) AS INTEGER) AS page FROM pivoted
""")
def lang_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = compare.per_language_long(_runs(spark, sf_dir))
    pivot = compare.per_language_pivot(long, list(NOISE_MODELS)).select("name", LANG, "support")
    return compare.pages(pivot, 3, "-support", LANG)


def _saved(spark: SparkSession, sf_dir: str) -> str:
    root = f"{shared_dir(spark)}/tongueprint/results-{uuid.uuid4().hex}"
    for model in NOISE_MODELS:
        preds = _stacked(spark, sf_dir).where(F.col("model") == model).drop("model")
        run_store.save_run(root, preds, codes_of(spark), model, "docs/all", "noise", _STAMP)
    return root


@query("saved_runs", f"{_RUNS} {_OVERVIEW}")
def saved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs written and read back, best first."""
    stored = run_store.read_runs(spark, _saved(spark, sf_dir))
    return rounded(compare.overview(run_store.load_runs(stored, dataset="docs/all")), "accuracy", "macro_f1")


@query("saved_run_ids", f"{_RUNS} SELECT run_id FROM runs")
def saved_run_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark)}/tongueprint/results-{uuid.uuid4().hex}"
    run_store.save_runs(root, _runs(spark, sf_dir))
    return run_store.discover_runs(run_store.read_runs(spark, root))


@query("json_runs", f"{_RUNS} {_OVERVIEW}")
def json_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs exported as JSON records, one folder each, and loaded from there."""
    root = f"{shared_dir(spark)}/tongueprint/results-{uuid.uuid4().hex}"
    table = _runs(spark, sf_dir)
    for model in NOISE_MODELS:
        run_store.export_run_json(table, root, run_store.make_run_id(model, "docs/all", _STAMP))
    return rounded(compare.overview(run_store.read_json_runs(spark, root)), "accuracy", "macro_f1")


@query("run_log", f"{_RUNS} SELECT run_id, model, dataset, '{_STAMP}' AS timestamp, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, n, n_languages FROM runs")
def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tongueprint/log-{uuid.uuid4().hex}"
    run_store.append_run_log(_runs(spark, sf_dir), path)
    return rounded(run_store.read_run_log(spark, path), "accuracy", "macro_f1")


@query("comparison_table", f"""
{_RUNS} SELECT name, lang, max(support) AS support,
  {', '.join(f"round(avg(precision) FILTER (model = '{m}'), 6) AS {m}" for m in NOISE_MODELS)} FROM long GROUP BY ALL
""")
def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A per-language comparison written as CSV and read back."""
    path = f"{shared_dir(spark)}/tongueprint/table-{uuid.uuid4().hex}"
    pivot = compare.per_language_pivot(compare.per_language_long(_runs(spark, sf_dir)), list(NOISE_MODELS), "precision")
    run_store.write_table(pivot, path)
    columns = ", ".join(f"{m} double" for m in NOISE_MODELS)
    return rounded(spark.read.csv(path, header=True, schema=f"name string, lang string, support bigint, {columns}"), *NOISE_MODELS)


@query("gold_counts", f"WITH {SQL_DOCS} SELECT lang, count(*) AS support FROM docs GROUP BY lang")
def gold_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.gold_counts(labels_only(spark, sf_dir))


@query("aligned_predictions", f"WITH {SQL_NOISY} SELECT row_id, lang, pred FROM preds")
def aligned_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions made elsewhere put back on their rows, 1:1 or not at all."""
    elsewhere = noisy_predictions(spark, sf_dir).select("row_id", "pred")
    return compare.aligned(labels_only(spark, sf_dir), elsewhere)
