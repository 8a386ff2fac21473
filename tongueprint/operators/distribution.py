"""Label distributions, label sets, and unions of corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.sources.corpus import LANG, TEXT


def language_counts(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy(LANG).agg(F.count("*").alias("rows"))


def merge_histogram(histogram: DataFrame) -> DataFrame:
    """Counts of codes that normalise to the same language, summed."""
    return histogram.groupBy(LANG).agg(F.sum("sentence").alias("rows"))


def compare_distributions(first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """``(lang, dataset, rows, frequency, both)`` of two count tables, absent languages as zero.

    ``both`` is the sum of the two frequencies, the order of the report.
    """
    tagged = first.select(LANG, F.col("rows").alias("a"), F.lit(0).cast("bigint").alias("b")).unionByName(
        second.select(LANG, F.lit(0).cast("bigint").alias("a"), F.col("rows").alias("b"))
    )
    counts = tagged.groupBy(LANG).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Totals over one row per language: a window of a few hundred rows, and the corpora are read once.
    everything = Window.partitionBy(F.lit(0))
    share_a = F.try_divide("a", F.sum("a").over(everything))
    share_b = F.try_divide("b", F.sum("b").over(everything))
    parts = counts.select(LANG, "a", "b", share_a.alias("fa"), share_b.alias("fb"))
    long = parts.select(
        LANG, (F.col("fa") + F.col("fb")).alias("both"),
        F.inline(F.array(
            F.struct(F.lit(names[0]).alias("dataset"), F.col("a").alias("rows"), F.col("fa").alias("frequency")),
            F.struct(F.lit(names[1]).alias("dataset"), F.col("b").alias("rows"), F.col("fb").alias("frequency")),
        )),
    )
    return long.orderBy(F.desc("both"), LANG, "dataset")


def label_sets(first: DataFrame, second: DataFrame) -> DataFrame:
    """Every label of either corpus with its side: ``both``, ``first`` or ``second``."""
    sides = first.select(LANG, F.lit(1).alias("side")).unionByName(second.select(LANG, F.lit(2).alias("side")))
    flags = sides.groupBy(LANG).agg(F.max(F.col("side") == 1).alias("a"), F.max(F.col("side") == 2).alias("b"))
    where = F.when(F.col("a") & F.col("b"), F.lit("both")).when(F.col("a"), F.lit("first")).otherwise(F.lit("second"))
    return flags.select(LANG, where.alias("found_in"))


def shared_labels(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(LANG).intersect(second.select(LANG))


def labels_only_in(first: DataFrame, second: DataFrame) -> DataFrame:
    return first.select(LANG).subtract(second.select(LANG))


def augment(corpus: DataFrame, *additions: DataFrame) -> DataFrame:
    """Corpus plus further rows (bag union), on the two columns all corpora share."""
    out = corpus.select(TEXT, LANG)
    for more in additions:
        out = out.unionByName(more.select(TEXT, LANG))
    return out
