"""End-to-end jobs: evaluate a model, train a detector, train and extend a multi-language model, sweep."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import linear, metrics, naive_bayes, sampling, stacked
from tongueprint.operators.prompts import run_label
from tongueprint.operators.scorers import Scorer, with_predictions
from tongueprint.session import materialize
from tongueprint.sources.codes import CodeTable
from tongueprint.sources.corpus import LANG, TEXT
from tongueprint.sources.runs import read_predictions, save_run

# Fixed value: the label of every row that is not the target language.
OTHER = "other"


@dataclass(frozen=True)
class Evaluation:
    overall: DataFrame
    per_language: DataFrame
    predictions: DataFrame
    run_id: str | None = None


def evaluate(
    df: DataFrame, scorer: Scorer, codes: CodeTable, id_col: str = "row_id", root: str | None = None, dataset: str = "",
    label: str | None = None, experiment: str = "",
) -> Evaluation:
    """Score rows with a gold ``lang``: the predictions, beside all columns of ``df``, are written once and all metrics read that table.

    With ``root`` they are written as a saved run, published with its scores and its log line.
    """
    preds = metrics.normalize_predictions(with_predictions(df, scorer, id_col), codes)
    run_id = None
    if root is None:
        preds = materialize(preds, "predictions")
    else:
        run_id = save_run(root, preds, codes, label or scorer.name, dataset, experiment)
        preds = read_predictions(df.sparkSession, root, run_id)
    summary = metrics.overall(preds).withColumn("model", F.lit(scorer.name))
    return Evaluation(
        summary.select("model", "n", "n_languages", "accuracy", "macro_f1"), metrics.per_language(preds, codes), preds, run_id
    )


def evaluate_job(
    corpus: DataFrame, scorer: Scorer, codes: CodeTable, dataset: str, root: str | None = None, n: int = 0, shot: int = 0,
    languages: str | Sequence[str] | None = None, seed: int = 0, id_col: str = "row_id",
) -> tuple[Evaluation, DataFrame]:
    """Hold out demonstrations, then sample, score and save; returns the evaluation and the demonstrations.

    Demonstrations leave before sampling, so none can be evaluated on. ``n=0`` uses every row.
    """
    if shot > 0:
        picked = materialize(sampling.fewshot_pick(corpus, shot, seed, id_col), "demonstrations")
        rows = sampling.hold_out(corpus, picked, id_col)
    else:
        picked, rows = corpus.limit(0), corpus
    if n > 0:
        rows = sampling.sample_per_language(rows, n, codes, languages, seed, id_col)
    elif languages is not None:
        rows = sampling.filter_languages(rows, languages, codes)
    return evaluate(rows, scorer, codes, id_col, root, dataset, run_label(scorer.name, shot)), picked


@dataclass(frozen=True)
class DetectorData:
    """``train(row_id, sentence, label)`` and ``test(row_id, sentence, lang, is_target)``."""

    train: DataFrame
    test: DataFrame
    target: str


def detector_data(
    positives: DataFrame, background: DataFrame, language: str, codes: CodeTable, n_train: int | None = None,
    n_neg: int | None = None, seed: int = 0, test_size: float = 0.2, id_col: str = "row_id",
) -> DetectorData:
    """Balanced yes/no data for one language.

    Positives are split (the test part is never capped), the training part optionally capped.
    Negatives mirror both parts; when they run short the test part is served first.
    """
    target = codes.resolve(language)
    total = positives.count()
    n_test = math.ceil(test_size * total)
    left = total - n_test
    n_pos = min(left, n_train) if n_train is not None else left
    parts = sampling.rank_segments(positives, [n_test, n_test + n_pos], seed, "split", id_col)
    others = background.where(~F.col(LANG).eqNullSafe(F.lit(target)) & F.col(TEXT).isNotNull())
    n_neg_train = n_pos if n_neg is None else n_neg
    drawn = sampling.rank_segments(others, [n_test, n_test + n_neg_train], seed, "negative", id_col)

    def part(df: DataFrame, segment: int, label: str) -> DataFrame:
        return df.where(F.col("segment") == segment).select(id_col, TEXT, LANG, F.lit(label).alias("label"))

    train = part(parts, 1, target).unionByName(part(drawn, 1, OTHER)).select(id_col, TEXT, "label")
    test = part(parts, 0, target).unionByName(part(drawn, 0, OTHER)).select(id_col, TEXT, LANG)
    return DetectorData(train, test.withColumn("is_target", F.col(LANG).eqNullSafe(F.lit(target))), target)


def train_detector(
    data: DetectorData, codes: CodeTable, kind: str = "naive_bayes", spec: GramSpec = GramSpec(), id_col: str = "row_id", **settings
) -> tuple[Scorer, DataFrame]:
    """Fit a detector and score it on its test rows: ``(model, n, precision, recall, f1, accuracy)``."""
    if kind == "naive_bayes":
        model: Scorer = naive_bayes.fit(data.train, spec, label_col="label", name="charngram-nb", **settings)
    elif kind == "logreg":
        model = linear.train_logreg(data.train, **settings)
    elif kind == "linear_svm":
        model = linear.train_linear_svm(data.train, **settings)
    else:
        raise ValueError("kind must be naive_bayes, logreg or linear_svm")
    preds = model.predict(data.test, id_col=id_col, keep=[LANG, "is_target"])
    scores = metrics.detector_scores(preds, data.target, codes=codes)
    return model, scores.select(F.lit(model.name).alias("model"), "*")


def train_multilingual(
    corpus: DataFrame, fraction: float | None = None, spec: GramSpec = GramSpec(), alpha: float = 0.01, seed: int = 42,
    id_col: str = "row_id", name: str = "local",
) -> naive_bayes.NaiveBayesModel:
    """Naive Bayes over all languages of the ``train`` split, optionally on a fraction of each split."""
    rows = corpus if fraction is None else sampling.split_fraction(corpus, fraction, seed, id_col)
    return naive_bayes.fit(rows.where(F.col("split") == "train"), spec, alpha, name=name)


def add_language(
    model: naive_bayes.NaiveBayesModel, addition: DataFrame, name: str | None = None
) -> naive_bayes.NaiveBayesModel:
    """Extend a model by new rows: their counts are made and added; the old corpus is not read again."""
    extra = naive_bayes.fit(addition, model.spec, model.alpha)
    return naive_bayes.merge(model, extra, name=name)


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per-language F1 of two evaluations side by side; a language only one of them has keeps a null."""
    old = before.select(LANG, F.col("f1").alias("f1_before"), F.col("support").alias("support_before"))
    new = after.select(LANG, F.col("f1").alias("f1_after"), F.col("support").alias("support_after"))
    return old.join(new, LANG, "full").withColumn("f1_change", F.col("f1_after") - F.col("f1_before"))


@dataclass(frozen=True)
class Sweep:
    """Predictions of all models stacked with a ``model`` column, and what failed."""

    predictions: DataFrame | None
    failures: list[tuple[str, str]]

    def whole(self) -> DataFrame:
        """The predictions, if no model failed; a sweep that lacks a model is an error here, which names each with its cause."""
        if self.failures or self.predictions is None:
            raise RuntimeError("; ".join(["models of the sweep failed", *(f"{name}: {error}" for name, error in self.failures)]))
        return self.predictions


def sweep(rows: DataFrame, scorers: Mapping[str, Scorer], codes: CodeTable, id_col: str = "row_id", keep: Sequence[str] = (LANG,)) -> Sweep:
    """Run every model on the same rows: all naive Bayes models in one pass over the texts, any other one by itself.

    Predictions are written as they end. A model that fails is noted and skipped; naive Bayes models that fail
    together are tried again one by one, so that one of them does not take the others along.
    """
    done: list[DataFrame] = []
    failures: list[tuple[str, str]] = []

    def attempt(make: Callable[[], DataFrame]) -> str | None:
        try:
            done.append(materialize(metrics.normalize_predictions(make(), codes), "sweep"))
        except Exception as error:
            return str(error).partition("\n")[0] or type(error).__name__
        return None

    bayes = {name: scorer for name, scorer in scorers.items() if isinstance(scorer, naive_bayes.NaiveBayesModel)}
    together = bool(bayes) and attempt(lambda: stacked.predict_many(bayes, rows, id_col, keep)) is None
    for name, scorer in scorers.items():
        if together and name in bayes:
            continue
        if error := attempt(lambda: scorer.predict(rows, id_col=id_col, keep=list(keep)).withColumn(stacked.MODEL, F.lit(name))):
            failures.append((name, error))
    predictions = done[0] if done else None
    for more in done[1:]:
        predictions = predictions.unionByName(more)
    return Sweep(predictions, failures)


def failures_table(result: Sweep, rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame(result.failures, "model string, error string")


def outcomes(result: Sweep, rows: DataFrame) -> DataFrame:
    """``(model, n_rows, error)``: a row per model of the sweep; one that failed has no rows and its error."""
    failed = failures_table(result, rows).select("model", F.lit(0).cast("long").alias("n_rows"), "error")
    if result.predictions is None:
        return failed
    scored = result.predictions.groupBy("model").agg(F.count("*").alias("n_rows"))
    return scored.select("model", "n_rows", F.lit(None).cast("string").alias("error")).unionByName(failed)
