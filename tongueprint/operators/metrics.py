"""Scores per language and overall. Predictions are counted once per (gold, predicted) pair; every
metric is then arithmetic on that small table, whatever the number of rows or labels.

``by`` names extra grouping columns (a model, a run), so many runs are scored in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.session import materialize
from tongueprint.sources.codes import UND, CodeTable
from tongueprint.sources.corpus import LANG


def ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def pair_counts(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., lang, pred, n)``."""
    return preds.groupBy(*by, LANG, "pred").agg(F.count("*").alias("n"))


def label_scores(pairs: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Support, predictions, hits, precision, recall and F1 of every gold or predicted label."""
    none = F.lit(0).cast("bigint")
    hit = F.when(F.col(LANG).eqNullSafe(F.col("pred")), F.col("n")).otherwise(none)
    as_gold = F.struct(F.col(LANG).alias("label"), F.col("n").alias("support"), none.alias("predicted"), hit.alias("hits"))
    as_pred = F.struct(F.col("pred").alias("label"), none.alias("support"), F.col("n").alias("predicted"), none.alias("hits"))
    sums = (
        pairs.select(*by, F.inline(F.array(as_gold, as_pred))).where(F.col("label").isNotNull())
        .groupBy(*by, "label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    )
    return with_rates(sums)


def with_rates(df: DataFrame) -> DataFrame:
    recall, precision = ratio(F.col("hits"), F.col("support")), ratio(F.col("hits"), F.col("predicted"))
    return df.withColumns({
        "recall": recall, "precision": precision,
        "f1": ratio(2.0 * F.col("hits"), F.col("support") + F.col("predicted")),
    })


def per_language(preds: DataFrame, codes: CodeTable, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., lang, name, support, recall, precision, f1)`` for the languages of the gold labels."""
    scores = label_scores(pair_counts(preds, by), by).where("support > 0").withColumnRenamed("label", LANG)
    return codes.with_name(scores).select(*by, LANG, "name", "support", "recall", "precision", "f1")


def overall(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(by..., n, n_languages, accuracy, macro_f1)``; the macro mean is over gold languages only."""
    gold = label_scores(pair_counts(preds, by), by).where("support > 0")
    n, hits = F.coalesce(F.sum("support"), F.lit(0)), F.sum("hits")
    return gold.groupBy(*by).agg(
        n.alias("n"), F.count("*").alias("n_languages"), ratio(hits, n).alias("accuracy"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"),
    )


def accuracy(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.avg(F.col(LANG).eqNullSafe(F.col("pred")).cast("int"))
    return preds.groupBy(*by).agg(F.coalesce(right, F.lit(0.0)).alias("accuracy"))


def macro_f1(preds: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return overall(preds, by).select(*by, "macro_f1")


def detector_scores(preds: DataFrame, target: str, by: Sequence[str] = (), codes: CodeTable | None = None) -> DataFrame:
    """Precision, recall, F1 and accuracy of *is this the target language?* against ``is_target``."""
    if codes is not None:
        preds = codes.normalize(preds, "pred")
    said, truth = F.col("pred") == target, F.col("is_target")
    counts = preds.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(said & truth).alias("hits"), F.count_if(said).alias("predicted"),
        F.count_if(truth).alias("support"), F.count_if(said == truth).alias("_right"),
    )
    scored = with_rates(counts).withColumn("accuracy", ratio(F.col("_right"), F.col("n")))
    return scored.select(*by, "n", "precision", "recall", "f1", "accuracy")


def class_balance(df: DataFrame, label_col: str = "label", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, label_col).agg(F.count("*").alias("rows"))


def sample_report(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.count_distinct(LANG).alias("languages"))


def gold_counts(preds: DataFrame) -> DataFrame:
    return preds.where(F.col(LANG).isNotNull()).groupBy(LANG).agg(F.count("*").alias("support"))


def _known_pairs(preds: DataFrame) -> DataFrame:
    return materialize(pair_counts(preds).where(F.col(LANG).isNotNull() & F.col("pred").isNotNull()), "pairs")


def confusion_grid(preds: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Wide confusion table: a row per gold label, a column for each of ``columns``, zeros filled in.

    Without ``columns`` every gold label gets one, then every label that was only predicted. Column names live on the
    driver whatever is done, so with very many labels name the columns or take ``confusion_cells``.
    """
    pairs = _known_pairs(preds)
    if columns is None:
        gold = _labels(pairs, LANG)
        columns = gold + [label for label in _labels(pairs, "pred") if label not in set(gold)]
    return pairs.groupBy(LANG).pivot("pred", list(columns)).agg(F.sum("n")).na.fill(0)


def confusion_cells(preds: DataFrame, part: int = 1_000) -> DataFrame:
    """The whole grid in long form, ``(lang, pred, n)``: a row per gold label and gold or predicted label, empty cells included.

    Labels are a table: they are kept as lists of about ``part`` by hash, each gold label meets every list by its number,
    and the counts are joined to the cells. No label reaches the driver.
    """
    pairs = _known_pairs(preds)
    labels = materialize(pairs.select(F.col(LANG).alias("pred")).union(pairs.select("pred")).distinct(), "labels")
    parts = max(1, -(-labels.count() // part))
    lists = labels.groupBy(F.pmod(F.xxhash64("pred"), F.lit(parts)).alias("_part")).agg(F.collect_list("pred").alias("_labels"))
    gold = pairs.select(LANG).distinct().withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    cells = gold.join(lists, "_part").select(LANG, F.explode("_labels").alias("pred"))
    return cells.join(pairs, [LANG, "pred"], "left").select(LANG, "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _labels(pairs: DataFrame, column: str) -> list[str]:
    return [r[0] for r in pairs.select(column).distinct().orderBy(column).collect()]


def classification_report(preds: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """``(label, precision, recall, f1, support)`` over gold and predicted labels, with average rows.

    Rows ``accuracy`` (its value in f1), ``macro avg`` and ``weighted avg`` follow. With ``labels`` only
    those are reported, and unless they cover everything ``micro avg`` takes the place of accuracy.
    """
    scores = label_scores(pair_counts(preds))
    if labels is None:
        scores = scores.withColumn("_wanted", F.lit(True))
    else:
        asked = scores.sparkSession.createDataFrame([(label,) for label in dict.fromkeys(labels)], "label string")
        asked = F.broadcast(asked.withColumn("_wanted", F.lit(True)))
        scores = scores.join(asked, "label", "full").na.fill(0).na.fill(False, ["_wanted"])
    kept, support = F.col("_wanted"), F.col("support")

    def over(expr: Column) -> Column:
        return F.when(kept, expr)

    rates = ("precision", "recall", "f1")
    totals = scores.groupingSets([["label", "_wanted"], []], "label", "_wanted").agg(
        F.grouping("label").alias("_total"),
        *[F.sum(over(F.col(c))).alias(c) for c in ("support", "predicted", "hits")],
        F.sum("support").alias("_all"),
        *[F.avg(over(F.col(c))).alias(f"_macro_{c}") for c in rates],
        *[ratio(F.sum(over(F.col(c) * support)), F.sum(over(support))).alias(f"_weighted_{c}") for c in rates],
    )
    rates_of = with_rates(totals)
    covers = (F.col("support") == F.col("_all")) & (F.col("predicted") == F.col("_all"))
    null = F.lit(None).cast("double")

    def line(label: Column, values: list[Column]) -> Column:
        fields = [v.alias(c) for v, c in zip(values, rates, strict=True)]
        return F.struct(label.alias("label"), *fields, F.col("support").alias("support"))

    own = [F.col(c) for c in rates]
    micro = line(
        F.when(covers, F.lit("accuracy")).otherwise(F.lit("micro avg")),
        [F.when(covers, null).otherwise(c) for c in own[:2]] + [own[2]],
    )
    summary = F.array(
        micro,
        line(F.lit("macro avg"), [F.col(f"_macro_{c}") for c in rates]),
        line(F.lit("weighted avg"), [F.col(f"_weighted_{c}") for c in rates]),
    )
    single = F.array(line(F.col("label"), own))
    return (
        rates_of.where((F.col("_total") == 1) | kept)
        .select(F.inline(F.when(F.col("_total") == 1, summary).otherwise(single)))
    )


def worst_languages(pairs: DataFrame, n: int = 20, min_support: int = 50) -> DataFrame:
    """The ``n`` labels of lowest F1 among those with enough rows, ranked from 1."""
    low = (
        label_scores(pairs).where(F.col("support") >= min_support).withColumnRenamed("label", LANG)
        .orderBy("f1", LANG).limit(n).withColumn("_all", F.lit(0))
    )
    rank = F.row_number().over(Window.partitionBy("_all").orderBy("f1", LANG))
    return low.select(rank.alias("rank"), LANG, "f1", "precision", "recall", "support")


def confusions_of(pairs: DataFrame, language: str, top_n: int = 10) -> DataFrame:
    """What the rows of one gold language were taken for, most frequent first; no rows, no result."""
    return _shares(pairs.where(F.col(LANG) == language)).orderBy(F.desc("n"), "pred").limit(top_n)


def batch_diagnosis(pairs: DataFrame, n_worst: int = 5, min_support: int = 50, top_n: int = 5) -> DataFrame:
    """The most frequent predictions for each of the worst languages, in one job.

    The pairs are used twice, so they are written first: a row per pair, instead of two scans of predictions.
    """
    pairs = materialize(pairs, "pairs")
    worst = worst_languages(pairs, n_worst, min_support).select("rank", LANG)
    shares = _shares(pairs.join(F.broadcast(worst), LANG))
    place = F.row_number().over(Window.partitionBy(LANG).orderBy(F.desc("n"), "pred"))
    return shares.withColumn("place", place).where(F.col("place") <= top_n)


def _shares(pairs: DataFrame) -> DataFrame:
    """Pairs with ``total`` and the share of each prediction; windows over one row per pair."""
    per_label = Window.partitionBy(LANG)
    hits = F.sum(F.when(F.col("pred") == F.col(LANG), F.col("n")).otherwise(0)).over(per_label)
    return (
        pairs.withColumn("total", F.sum("n").over(per_label))
        .withColumns({
            "share": F.col("n") / F.col("total"), "correct_share": hits / F.col("total"),
            "is_correct": F.coalesce(F.col("pred") == F.col(LANG), F.lit(False)),
        })
    )


def normalize_predictions(preds: DataFrame, codes: CodeTable) -> DataFrame:
    """Bring ``pred`` to ISO-639-3; a missing prediction is ``und``, never a lost row."""
    return codes.normalize(preds.na.fill({"pred": UND}), "pred")
