"""Character n-gram counts, hashed counts and TF-IDF weights as tables."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.functions.counting import (
    BEGINS, GramCounter, Vocabulary, group_frequencies, grouped_counts, grouped_weights, lowered,
)
from tongueprint.functions.hashing import GramSpec
from tongueprint.functions.text import explode_grams, explode_tokens
from tongueprint.operators.lookup import BROADCAST_LIMIT
from tongueprint.session import cluster, materialize
from tongueprint.sources.corpus import TEXT


def gram_counts(df: DataFrame, spec: GramSpec, keys: Sequence[str], text_col: str = TEXT) -> DataFrame:
    """``(keys, feature, tf)``: the feature matrix of a corpus in long form. ``keys`` starts with the row id.

    Texts are clustered by row id and lie together by key, so the counts are finished where they are made and never shuffled.
    """
    counts = grouped_counts(_by_key(df, keys, text_col), spec, "_lower")
    if spec.buckets is None or GramCounter.hashes(spec):
        return counts
    return counts.groupBy(*keys, spec.feature(F.col("feature")).alias("feature")).agg(F.sum("tf").alias("tf"))


def _by_key(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """Lower-cased texts, those of a key one after the other."""
    apart = Window.partitionBy(*keys).orderBy(F.lit(0))
    rows = cluster(df.select(*keys, lowered(text_col).alias("_lower")), keys[0])
    return rows.withColumn(BEGINS, F.row_number().over(apart) == 1)


def document_counts(df: DataFrame, spec: GramSpec, id_col: str, text_col: str = TEXT) -> DataFrame:
    """``(feature, df)``: in how many rows, told apart by id, a feature is. Tasks add up before they pass anything on."""
    if spec.buckets is None or GramCounter.hashes(spec):
        return group_frequencies(_by_key(df, [id_col], text_col), spec, "_lower").groupBy("feature").agg(F.sum("df").alias("df"))
    return gram_counts(df, spec, [id_col], text_col).groupBy("feature").agg(F.count("*").alias("df"))


def sent_vocabulary(kept: DataFrame, value: str, spec: GramSpec, limit: int) -> Vocabulary | None:
    """The n-grams of a materialised table ``(feature, value, ...)`` by number, if they fit ``limit`` and have few enough letters."""
    # On its way an n-gram takes its own bytes besides the two numbers kept of it.
    if spec.buckets is not None or kept.count() * (48 + 16 * len(kept.columns)) > limit:
        return None
    found = kept.select("feature", value).toArrow()
    vocabulary = Vocabulary(found.column("feature").to_pylist(), np.asarray(found.column(value)), spec.hi)
    return vocabulary if vocabulary.packable else None


def label_gram_counts(df: DataFrame, spec: GramSpec, label_col: str, text_col: str = TEXT) -> DataFrame:
    """``(label, feature, n)`` over a whole corpus.

    Words are counted first: n-grams never cross a word, so each distinct word of a label is cut into
    grams once and weighted by its count. Both groupings combine on the map side, so a label or
    word that holds a third of the corpus leaves its task as one row. Only distinct n-grams are hashed.
    """
    words = explode_tokens(df, text_col, [label_col]).groupBy(label_col, "token").agg(F.count("*").alias("times"))
    grams = explode_grams(words, spec.lo, spec.hi, [label_col, "times"])
    counts = grams.groupBy(label_col, "gram").agg(F.sum("times").alias("n"))
    if spec.buckets is None:
        return counts.withColumnRenamed("gram", "feature")
    return counts.groupBy(label_col, spec.feature(F.col("gram")).alias("feature")).agg(F.sum("n").alias("n"))


def tfidf(
    df: DataFrame, spec: GramSpec, id_col: str = "row_id", text_col: str = TEXT, min_df: int = 2, limit: int = BROADCAST_LIMIT,
    most: int | None = None,
) -> DataFrame:
    """``(id, feature, tf, weight)``: tf * (ln((1 + rows) / (1 + df)) + 1), each row scaled to length 1.

    Features found in fewer than ``min_df`` rows are dropped. A row without features gives nothing.

    Texts are cut twice: to count rows per feature, and to weight. The counts of a corpus take several times its own size, so reading the
    texts again beats storing or shuffling them. While the n-grams that count fit ``limit``, each task has them all, and an id's
    counts become weights where they are made. ``most`` is for callers that keep an id's largest weights only: smaller ones
    may be missing, but none that is among the ``most`` largest when rounded to 6 decimals.

    For more n-grams or letters, and for buckets, texts are cut three times, once for the lengths. Values of the most frequent features, as many as fit
    ``limit``, are sent; only n-grams of rarer ones are shuffled, each of which has few rows. Lengths join the texts, not their n-grams.
    """
    rows = df.count()
    seen = document_counts(df, spec, id_col, text_col).withColumnRenamed("df", "_df")
    idf = (F.log(F.lit(1.0 + rows) / (F.col("_df") + 1)) + 1).alias("_idf")
    kept = materialize(seen.where(F.col("_df") >= min_df).select("feature", "_df", idf), "idf")
    if (vocabulary := sent_vocabulary(kept, "_idf", spec, limit)) is not None:
        shipped = df.sparkSession.sparkContext.broadcast(vocabulary)
        return grouped_weights(_by_key(df, [id_col], text_col), spec, "_lower", shipped, most)
    # A row per class of frequency reaches the driver; classes are sent from the top down while they fit.
    rank = F.floor(F.log2("_df") * 8)
    room, cut, whole = limit // (48 + 16 * len(kept.columns)), float("inf"), True
    for row in kept.groupBy(rank.alias("rank")).agg(F.count("*").alias("n")).orderBy(F.desc("rank")).collect():
        room -= row["n"]
        if room < 0:
            whole = False
            break
        cut = row["rank"]
    heavy, light = (kept.where(c).select("feature", "_idf") for c in (rank >= F.lit(cut), rank < F.lit(cut)))
    raw = F.col("tf") * F.col("_idf")
    met = gram_counts(df, spec, [id_col], text_col).join(F.broadcast(heavy), "feature", "inner" if whole else "left")
    feature = dict(kept.dtypes)["feature"]
    rare = F.lit(None).cast(feature) if whole else F.when(F.col("_idf").isNull(), F.col("feature"))
    parts = materialize(
        met.groupBy(id_col, rare.alias("_rare")).agg(F.sum(raw * raw).alias("_square"), F.sum("tf").alias("tf")), "tfidf-parts"
    )
    tail = parts.where(F.col("_rare").isNotNull()).select(id_col, F.col("_rare").alias("feature"), "tf").join(light, "feature")
    squares = parts.where(F.col("_rare").isNull()).select(id_col, "_square").unionByName(tail.select(id_col, (raw * raw).alias("_square")))
    lengths = materialize(squares.groupBy(F.col(id_col).alias("_of")).agg(F.sqrt(F.sum("_square")).alias("_norm")), "tfidf-lengths")

    def measured(part: DataFrame) -> DataFrame:
        return part.join(lengths, F.col(id_col).eqNullSafe(F.col("_of"))).drop("_of")

    sent = gram_counts(measured(df.select(id_col, text_col)), spec, [id_col, "_norm"], text_col).join(F.broadcast(heavy), "feature")
    weight = (raw / F.col("_norm")).alias("weight")
    weighted = sent.select(id_col, "feature", "tf", weight)
    return weighted if whole else weighted.unionByName(measured(tail).select(id_col, "feature", "tf", weight))
