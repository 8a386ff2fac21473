"""Comparing runs: overview, per-language tables, disagreement, comparability, wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.sources.corpus import LANG

METRICS = ("f1", "precision", "recall")


def overview(runs: DataFrame) -> DataFrame:
    """One row per run, best macro-F1 first; runs without a score come last."""
    score = F.nanvl(F.coalesce("macro_f1", F.lit(-1.0)), F.lit(-1.0))
    return runs.orderBy(score.desc(), "run_id").select(
        "model", "dataset", "n", "n_languages", "accuracy", "macro_f1", "run_id"
    )


def per_language_long(runs: DataFrame) -> DataFrame:
    """``(run_id, model, lang, name, support, recall, precision, f1)`` of all runs."""
    return runs.select("run_id", "model", F.inline("per_language"))


def per_language_pivot(long: DataFrame, models: Sequence[str], metric: str = "f1") -> DataFrame:
    """Languages by models; runs with one model label average, ``support`` is the largest seen."""
    _check_metric(metric)
    cells = [F.avg(F.when(F.col("model") == m, F.col(metric))).alias(m) for m in models]
    return long.groupBy("name", LANG).agg(F.max("support").alias("support"), *cells).orderBy(F.desc("support"), LANG)


def disagreement(long: DataFrame, metric: str = "f1", top: int = 15) -> DataFrame:
    """Languages with the widest gap between the best and the worst model."""
    _check_metric(metric)
    if long.select("model").distinct().limit(2).count() < 2:
        raise ValueError("disagreement needs at least two models")
    per_model = long.groupBy("name", LANG, "model").agg(F.avg(metric).alias("_value"))
    spread = per_model.groupBy("name", LANG).agg(
        F.max("_value").alias("best"), F.min("_value").alias("worst"), (F.max("_value") - F.min("_value")).alias("spread")
    )
    return spread.orderBy(F.desc("spread"), LANG).limit(top)


def model_labels(long: DataFrame) -> list[str]:
    """Distinct model labels in order, to name the columns of a pivot by; the long table itself needs none of them."""
    return [r[0] for r in long.select("model").distinct().orderBy("model").collect()]


def check_comparable(runs: DataFrame) -> DataFrame:
    """``(run_id, check, detail)``; empty when all runs share dataset, size, languages and supports.

    The best run by macro-F1 is the one others are compared with, the order runs load in. Works on
    one row per run and language.
    """
    score = F.nanvl(F.coalesce("macro_f1", F.lit(-1.0)), F.lit(-1.0))
    supports = F.array_sort(F.transform("per_language", lambda p: F.struct(p["lang"].alias("lang"), p["support"].alias("support"))))
    facts = runs.select("run_id", "model", "dataset", "n", score.alias("_score"), supports.alias("_supports"))
    everyone = Window.partitionBy(F.lit(0))
    first = everyone.orderBy(F.desc("_score"), "run_id")
    seen = facts.select(
        "*", F.row_number().over(first).alias("_place"), F.first("_supports").over(first).alias("_ref"),
        F.first("model").over(first).alias("_ref_model"),
        F.array_sort(F.collect_set("dataset").over(everyone)).alias("_datasets"),
        F.array_sort(F.collect_set("n").over(everyone)).alias("_sizes"),
    )
    langs, ref_langs = F.col("_supports.lang"), F.col("_ref.lang")
    other = F.col("_place") > 1
    overall = F.col("_place") == 1

    def warning(when, run_id, check: str, detail) -> F.Column:
        return F.when(when, F.struct(run_id.alias("run_id"), F.lit(check).alias("check"), detail.alias("detail")))

    all_runs = F.lit("*")
    found = F.array(
        warning(overall & (F.size("_datasets") > 1), all_runs, "dataset", F.array_join("_datasets", ", ")),
        warning(overall & (F.size("_sizes") > 1), all_runs, "n", F.array_join(F.col("_sizes").cast("array<string>"), ", ")),
        warning(other & (langs != ref_langs), F.col("run_id"), "languages", F.concat(F.col("model"), F.lit(" vs "), F.col("_ref_model"))),
        warning(
            other & (langs == ref_langs) & (F.col("_supports") != F.col("_ref")), F.col("run_id"), "support",
            F.concat(F.col("model"), F.lit(" vs "), F.col("_ref_model")),
        ),
    )
    return seen.select(F.inline(F.array_compact(found)))


def model_wins(winner: DataFrame, loser: DataFrame, target: str, id_col: str = "row_id") -> DataFrame:
    """Rows of the target language that one model finds and the other misses: ``(wins, total)``."""
    both = aligned(winner, loser.select(id_col, F.col("pred").alias("_other")), id_col).where(F.col(LANG) == target)
    won = (F.col("pred") == target) & ~F.col("_other").eqNullSafe(F.lit(target))
    return both.agg(F.count_if(won).alias("wins"), F.count("*").alias("total"), F.avg(won.cast("int")).alias("share"))


def aligned(rows: DataFrame, predictions: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Attach predictions made elsewhere, one per row; a duplicate, missing or stray id fails the job."""
    once = predictions.groupBy(id_col).agg(
        F.count("*").alias("_times"),
        *[F.first(c).alias(c) for c in predictions.columns if c != id_col],
    )
    joined = rows.withColumn("_row", F.lit(True)).join(once, id_col, "full")
    ok = F.col("_row").isNotNull() & (F.col("_times") == 1)
    message = F.concat(F.lit("predictions do not match rows 1:1 at id "), F.col(id_col).cast("string"))
    checked = F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return joined.where(checked).drop("_row", "_times")


def pages(table: DataFrame, size: int, *order: str) -> DataFrame:
    """Number the pages of a sorted per-language table (a row per language, so one small window)."""
    keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*keys))
    return table.withColumn("page", F.floor((place - 1) / F.lit(size)).cast("int"))


def _check_metric(metric: str) -> None:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
