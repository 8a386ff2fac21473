"""Multinomial naive Bayes over character n-grams; the model is two tables of counts.

log P(label) = ln(rows of label / rows); log P(feature | label) = ln((n + alpha) / (N + alpha * V)), with
n the count of the feature under the label, N the label's total and V the number of features: all
buckets when hashing, the features seen in training when keeping grams (unseen grams are then ignored).

Most features never occur under most labels, so a text's score is written as
``prior + L * ln(alpha / (N + alpha * V)) + sum(ln((n + alpha) / alpha))``: the sum runs over the counted
features only, and L is the number of n-grams that count.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.functions.counting import GramCounter, lowered, text_counts
from tongueprint.functions.hashing import GramSpec
from tongueprint.functions.text import WHITESPACE, explode_grams, explode_tokens
from tongueprint.operators.grams import label_gram_counts
from tongueprint.operators.lookup import BROADCAST_LIMIT, salted_by_count
from tongueprint.session import materialize
from tongueprint.sources.corpus import LANG, TEXT

# Labels whose sums are columns of one row: few enough for generated code.
LABEL_BLOCK = 40
# Words scored ahead where not all fit.
MOST_WORDS = 200_000


@dataclass(frozen=True)
class LabelConstants:
    """What scoring needs to know of one label: ln prior and the score of an n-gram it never had."""

    label: str
    prior: float
    unseen: float


@dataclass(frozen=True)
class NaiveBayesModel:
    """``counts(lang, feature, n)`` and ``classes(lang, n_rows)``, with the settings they were made with."""

    counts: DataFrame
    classes: DataFrame
    spec: GramSpec
    alpha: float = 0.01
    name: str = "naive-bayes"

    def constants(self) -> list[LabelConstants]:
        """Per-label constants on the driver: one small row per label, never per text or feature."""
        totals = self.counts.groupBy(LANG).agg(F.sum("n").alias("grams"))
        rows = self.classes.join(totals, LANG, "left").orderBy(LANG).collect()
        if not rows:
            raise ValueError("the model has no label")
        features = self.spec.buckets or self.counts.select("feature").distinct().count()
        texts = sum(r["n_rows"] for r in rows)
        return [
            LabelConstants(
                r[LANG], math.log(r["n_rows"] / texts),
                math.log(self.alpha) - math.log((r["grams"] or 0) + self.alpha * features),
            )
            for r in rows
        ]

    def gain(self, n: Column) -> Column:
        """How much more a feature with count ``n`` adds than an unseen one."""
        return F.log((n + F.lit(self.alpha)) / F.lit(self.alpha))

    def predict(
        self, df: DataFrame, id_col: str = "row_id", keep: Sequence[str] = (LANG,), text_col: str = TEXT,
        with_scores: bool = False, label_block: int = LABEL_BLOCK, broadcast_limit: int = BROADCAST_LIMIT,
    ) -> DataFrame:
        """``(id, keep..., pred, confidence, raw_output)``: one row out for every row in, empty texts included.

        ``keep`` columns ride along as grouping keys, so no join back is needed to score predictions. Rows of equal id stay
        apart: the text's hash is a key too, and rows equal in all keys are counted and given back as often.
        Equal scores (to 6 decimals) go to the smaller label. While features times labels fit ``broadcast_limit``, each text
        meets its sums in place (``Prepared``); a larger model is joined feature by feature (``_sparse_scores``).
        """
        if self.dense_bytes() <= broadcast_limit:
            return self.prepare(broadcast_limit).apply(df, id_col, keep, text_col, with_scores, label_block)
        keys, constants = [id_col, *keep], self.constants()
        own = [*keys, "_text", "_copies"]
        scored = self._sparse_scores(df, keys, text_col, constants, broadcast_limit)
        best = scored.select(*own, *_decide(F.col("scores")), *(["scores"] if with_scores else []))
        return _answers(best, keys, with_scores)

    def prepare(self, broadcast_limit: int = BROADCAST_LIMIT) -> Prepared:
        """The model ready to score any number of frames: its gains are tabled once, here."""
        return Prepared(self, broadcast_limit)

    def score_table(self, df: DataFrame, id_col: str = "row_id", text_col: str = TEXT, broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
        """``(id, lang, score)``: the joint log-likelihood of every label for every row."""
        scored = self.predict(df, id_col, (), text_col, with_scores=True, broadcast_limit=broadcast_limit)
        return scored.select(id_col, F.inline("scores")).withColumnsRenamed({"label": LANG})

    def dense_bytes(self) -> int:
        """Size of the gains with a number for every feature and label; with few labels, its bound by the number of buckets."""
        if self.spec.buckets and (bound := self.spec.buckets * (64 + 8 * self.classes.count())) <= BROADCAST_LIMIT // 4:
            return bound
        features, labels = (self.counts.select(c).distinct().count() for c in ("feature", LANG))
        return features * (64 + 8 * labels)

    def _counted(self, df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
        """``(keys, _text, feature, _tf, _first)``: how often a text has a feature, in a row or a few; ``_text`` is the text's hash.

        A row with a null feature, and only that one, stands for the text: ``_first`` is true there.
        """
        texts = df.select(*keys, F.xxhash64(text_col).alias("_text"), lowered(text_col).alias("_lower"))
        counts = text_counts(texts, [self.spec], "_lower")
        feature = F.col("feature") if GramCounter.hashes(self.spec) else self.spec.feature(F.col("feature"))
        return counts.select(*keys, "_text", feature.alias("feature"), "_tf", F.col("feature").isNull().alias("_first"))

    def _features(self, words: DataFrame, own: list[str], carry: Sequence[str] = ()) -> DataFrame:
        """``(own, carry, feature, _tf, _first)``, a row per n-gram of ``token``; a null token keeps one row, with a null feature.

        ``_first`` is true in one of the rows of each text.
        """
        grams = explode_grams(words, self.spec.lo, self.spec.hi, [*own, *carry, "_word"], outer=True, first="_begins")
        first = F.col("_begins") & (F.col("_word") == 0)
        return grams.select(*own, *carry, self.spec.feature(F.col("gram")).alias("feature"), F.lit(1).alias("_tf"), first.alias("_first"))

    def _sparse_scores(
        self, df: DataFrame, keys: list[str], text_col: str, constants: list[LabelConstants], limit: int
    ) -> DataFrame:
        """``(keys, _text, _copies, scores)`` for a model too large to send: gains stay lists of the labels that have any.

        The most frequent features, as many as fit ``limit``, are sent as lists and met in place; they make up most of any text.
        N-grams of the rest are added up per text and shuffled to their lists, which are short, as a rare feature
        was seen under few labels. A feature of so many texts that it would fill a task is spread over as many salts as its
        own count asks for. The texts are read once.
        """
        spark, own, hashed = df.sparkSession, [*keys, "_text"], self.spec.buckets is not None
        places = spark.createDataFrame([(c.label, i) for i, c in enumerate(constants)], f"{LANG} string, _place int")
        entries = materialize(
            self.counts.join(F.broadcast(places), LANG).groupBy("feature").agg(
                F.sum("n").alias("_total"), F.collect_list(F.struct("_place", self.gain(F.col("n")).alias("_gain"))).alias("_list")
            ), "nb-sparse",
        )
        # Frequency classes from the top down while their lists fit the limit: a row per class reaches the driver.
        rank = F.floor(F.log2("_total") * 8)
        sizes = entries.groupBy(rank.alias("rank")).agg(F.sum(64 + 16 * F.size("_list")).alias("bytes")).orderBy(F.desc("rank")).collect()
        room, cut, whole = limit, float("inf"), True
        for row in sizes:
            room -= row["bytes"]
            if room < 0:
                whole = False
                break
            cut = row["rank"]
        heavy = entries.where(rank >= F.lit(cut)).select("feature", "_list")
        met = self._counted(df, keys, text_col).join(F.broadcast(heavy), "feature", "left")
        unfolded = met.select(*own, "_first", "_tf", "feature", F.col("_list").isNull().alias("_rare"), F.posexplode_outer("_list").alias("_pos", "_entry"))
        once = F.coalesce("_pos", F.lit(0)) == 0
        rare = F.when(F.col("_rare"), F.col("feature")) if not whole else F.lit(None).cast(dict(entries.dtypes)["feature"])
        counts = F.col("feature").isNotNull() if hashed else ~F.col("_rare")
        parts = materialize(
            unfolded.groupBy(*own, F.col("_entry._place").alias("_place"), rare.alias("_tail")).agg(
                F.sum(F.col("_entry._gain") * F.col("_tf")).alias("_sum"), F.sum(F.when(once & counts, F.col("_tf")).otherwise(0)).alias("_grams"),
                F.count_if(once & F.col("_first")).alias("_firsts"), F.sum(F.when(once & F.col("feature").isNotNull(), F.col("_tf")).otherwise(0)).alias("_times"),
            ), "nb-parts",
        )
        sums = parts.select(*own, "_place", "_sum", "_grams", "_firsts")
        if not whole:
            tail = salted_by_count(parts.where(F.col("_tail").isNotNull()).select(*own, "_tail", "_times"),
                                   entries.where(rank < F.lit(cut)).select(F.col("feature").alias("_tail"), "_list"), "_tail", own)
            each = tail.select(*own, "_times", F.posexplode("_list").alias("_pos", "_entry"))
            known = F.lit(0) if hashed else F.when(F.col("_pos") == 0, F.col("_times")).otherwise(0)
            sums = sums.unionByName(each.select(
                *own, F.col("_entry._place").alias("_place"), (F.col("_times") * F.col("_entry._gain")).alias("_sum"),
                known.cast("long").alias("_grams"), F.lit(0).cast("long").alias("_firsts"),
            ))
        per_label = sums.groupBy(*own, "_place").agg(*[F.sum(c).alias(c) for c in ("_sum", "_grams", "_firsts")])
        entry = F.struct("_place", (F.col("_sum")).alias("_sum"))
        per_text = per_label.groupBy(*own).agg(
            F.sum("_firsts").alias("_copies"), F.sum("_grams").alias("_grams"),
            F.map_from_entries(F.collect_list(F.when(F.col("_place").isNotNull(), entry))).alias("_gained"),
        )
        labels = _label_array(spark, constants)
        scores = F.transform("_labels", lambda c: F.struct(
            c["label"].alias("label"),
            (c["prior"] + (F.col("_grams") * c["unseen"] + F.coalesce(F.try_element_at("_gained", c["_at"]), F.lit(0.0))) / F.col("_copies")).alias("score"),
        ))
        return per_text.join(F.broadcast(labels)).select(*own, "_copies", scores.alias("scores"))


class Prepared:
    """A model whose gains fit in memory, ready to score frame after frame; ``predict`` only declares a plan.

    ``gains(feature, gains)`` has one number per label for each feature. Words that recur need not be unfolded each time:
    ``words_of`` scores the most frequent words of a frame once, and the frame's other words are unfolded.
    """

    def __init__(self, model: NaiveBayesModel, limit: int = BROADCAST_LIMIT):
        self.model, self.limit, self.name = model, limit, model.name
        self.constants = model.constants()
        spark, places = model.counts.sparkSession, list(range(len(self.constants)))
        placed = spark.createDataFrame([(c.label, i) for i, c in enumerate(self.constants)], f"{LANG} string, _place int")
        # The labels came from the driver, a small row each, so sending them to every task adds nothing unbounded.
        table = (
            model.counts.join(F.broadcast(placed), LANG, "left").select("feature", "_place", model.gain(F.col("n")).alias("_gain"))
            .groupBy("feature").pivot("_place", places).agg(F.sum("_gain"))
        )
        self.gains = materialize(
            table.select("feature", F.array(*[F.coalesce(F.col(str(i)), F.lit(0.0)) for i in places]).alias("gains")), "nb-gains"
        )

    def words_of(self, df: DataFrame, text_col: str = TEXT, label_block: int = LABEL_BLOCK) -> DataFrame:
        """``(token, _wgains, _wgrams)``: sums of gains and number of known n-grams of the most frequent words of ``df``.

        As many words as fit the limit; the cut is by count, so no more than those pass through a sort.
        """
        room = max(1, self.limit // (96 + 8 * len(self.constants)))
        counted = materialize(explode_tokens(df, text_col, []).groupBy("token").agg(F.count("*").alias("_times")), "nb-vocabulary")
        if counted.count() > room:
            counted = counted.orderBy(F.desc("_times"), "token").limit(min(room, MOST_WORDS))
        words = counted.select("token", F.lit(0).alias("_word"), F.col("token").alias("_own"))
        sums = self._sums(self.model._features(words, ["_own"]).join(F.broadcast(self.gains), "feature", "left"), ["_own"], label_block)
        if len(self.constants) > label_block:
            entry = F.struct("_block", "_gained")
            sums = sums.groupBy("_own").agg(F.max("_grams").alias("_grams"), F.array_sort(F.collect_list(entry)).alias("_parts"))
            sums = sums.select("_own", "_grams", F.flatten(F.col("_parts._gained")).alias("_gained"))
        return materialize(sums.select(F.col("_own").alias("token"), F.col("_gained").alias("_wgains"), F.col("_grams").alias("_wgrams")), "nb-words")

    def predict(
        self, df: DataFrame, id_col: str = "row_id", keep: Sequence[str] = (LANG,), text_col: str = TEXT, with_scores: bool = False,
        label_block: int = LABEL_BLOCK,
    ) -> DataFrame:
        """As ``NaiveBayesModel.predict``, after scoring the words of ``df`` that recur most.

        It counts the words of ``df`` first, a pass of its own, and pays where words recur often: with some ten occurrences of a word or more.
        """
        return self.apply(df, id_col, keep, text_col, with_scores, label_block, self.words_of(df, text_col, label_block))

    def apply(
        self, df: DataFrame, id_col: str = "row_id", keep: Sequence[str] = (LANG,), text_col: str = TEXT, with_scores: bool = False,
        label_block: int = LABEL_BLOCK, words: DataFrame | None = None,
    ) -> DataFrame:
        """Only a plan: nothing is run or written, so it suits the batches of a stream. ``words`` are words scored ahead."""
        keys = [id_col, *keep]
        own = [*keys, "_text"]
        if words is None:
            joined = self.model._counted(df, keys, text_col).join(F.broadcast(self.gains), "feature", "left")
            sums = self._sums(joined, own, label_block)
        else:
            tokens = _words(df, keys, text_col).join(F.broadcast(words), "token", "left")
            # A word that is already scored is not unfolded: without a token it stays one row.
            tokens = tokens.withColumn("token", F.when(F.col("_wgrams").isNull(), F.col("token")))
            joined = self.model._features(tokens, own, ["_wgains", "_wgrams"]).join(F.broadcast(self.gains), "feature", "left")
            sums = self._sums(joined.withColumn("gains", F.coalesce("_wgains", "gains")), own, label_block, F.col("_wgrams"))
        of_block = _label_array(df.sparkSession, self.constants, label_block)
        # Sums over equal texts are as many times too large.
        scores = F.transform("_labels", lambda c: F.struct(
            c["label"].alias("label"),
            (c["prior"] + (F.col("_grams") * c["unseen"] + F.get("_gained", c["_at"])) / F.col("_copies")).alias("score"),
        ))
        scored = sums.join(F.broadcast(of_block), "_block").select(*own, "_copies", scores.alias("scores"))
        kept = [*own, "_copies"]
        parts = scored.select(*kept, *_decide(F.col("scores")), *(["scores"] if with_scores else []))
        best = parts if len(self.constants) <= label_block else _best_of_blocks(parts, kept, with_scores)
        return _answers(best, keys, with_scores)

    def _sums(self, joined: DataFrame, own: list[str], size: int, ready: Column | None = None) -> DataFrame:
        """``(own, _block, _copies, _grams, _gained)`` of rows that carry an array of gains and how often it counts.

        Sums of ``size`` labels are columns of one aggregation; a row goes on once per block of labels. The gains travel as
        one array: dozens of separate columns would make a method too long for the JIT.
        """
        blocks = -(-len(self.constants) // size)
        block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0)
        joined = joined.withColumn("_block", block)
        widest = min(size, len(self.constants))
        known = (F.col("feature") if self.model.spec.buckets else F.col("gains")).isNotNull() & F.col("feature").isNotNull()
        grams = F.when(known, F.col("_tf")).otherwise(0)
        grams = grams if ready is None else F.coalesce(ready, grams)
        each = [F.coalesce(F.sum(F.get("gains", F.col("_block") * size + i) * F.col("_tf")), F.lit(0.0)).alias(f"_s{i}") for i in range(widest)]
        sums = joined.groupBy(*own, "_block").agg(F.count_if("_first").alias("_copies"), F.sum(grams).cast("long").alias("_grams"), *each)
        # The last block may be shorter than the others.
        length = F.least(F.lit(widest), F.lit(len(self.constants)) - F.col("_block") * size)
        gained = F.slice(F.array(*[F.col(f"_s{i}") for i in range(widest)]), F.lit(1), length)
        return sums.select(*own, "_block", "_copies", "_grams", gained.alias("_gained"))


def _words(df: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """``(keys, _text, _word, token)``: a row per word with its place; ``_text`` is the text's hash.

    The first word may be empty, before leading blanks or in a text without words: its row stands for the text, with a null token.
    """
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), WHITESPACE)
    tokens = df.select(*keys, F.xxhash64(text_col).alias("_text"), F.posexplode(words).alias("_word", "token"))
    return tokens.withColumn("token", F.nullif(F.col("token"), F.lit("")))


def _label_array(spark: SparkSession, constants: list[LabelConstants], size: int | None = None) -> DataFrame:
    """``(_block, _labels)``: what scoring needs of the labels, in one row per block of ``size`` labels (one block if None)."""
    size = size or len(constants)
    rows = [(i // size, i % size, c.label, c.prior, c.unseen) for i, c in enumerate(constants)]
    labels = spark.createDataFrame(rows, "_block int, _at int, label string, prior double, unseen double")
    return labels.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_at", "label", "prior", "unseen"))).alias("_labels"))


def _answers(best: DataFrame, keys: list[str], with_scores: bool) -> DataFrame:
    once_each = best.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    pred = F.col("_best.label")
    return once_each.select(
        *keys, pred.alias("pred"), (F.exp(F.col("_best.score") - F.col("_top")) / F.col("_mass")).alias("confidence"),
        pred.alias("raw_output"), *(["scores"] if with_scores else []),
    )


def fit(
    train: DataFrame, spec: GramSpec = GramSpec(), alpha: float = 0.01, label_col: str = LANG,
    text_col: str = TEXT, name: str = "naive-bayes", path: str | None = None,
) -> NaiveBayesModel:
    """Count a labelled corpus into a model, written to ``path`` or the shared folder."""
    counts = label_gram_counts(train, spec, label_col, text_col).withColumnRenamed(label_col, LANG)
    classes = class_rows(train, label_col).withColumnRenamed(label_col, LANG)
    if path is None:
        return NaiveBayesModel(materialize(counts, "nb-counts"), materialize(classes, "nb-classes"), spec, alpha, name)
    model = NaiveBayesModel(counts, classes, spec, alpha, name)
    save(model, path)
    return load(train.sparkSession, path)


def class_rows(train: DataFrame, label_col: str = LANG) -> DataFrame:
    return train.groupBy(label_col).agg(F.count("*").alias("n_rows"))


def class_totals(model: NaiveBayesModel) -> DataFrame:
    """``(lang, n_rows, n_grams, n_features)`` per label."""
    grams = model.counts.groupBy(LANG).agg(F.sum("n").alias("n_grams"), F.count("*").alias("n_features"))
    return model.classes.join(grams, LANG, "left").na.fill(0, ["n_grams", "n_features"])


def merge(model: NaiveBayesModel, *others: NaiveBayesModel, name: str | None = None) -> NaiveBayesModel:
    """One model from several: counts add up, so nothing is refitted."""
    for other in others:
        if other.spec != model.spec:
            raise ValueError("models count different features")
    counts, classes = model.counts, model.classes
    for other in others:
        counts, classes = counts.unionByName(other.counts), classes.unionByName(other.classes)
    return replace(
        model,
        counts=materialize(counts.groupBy(LANG, "feature").agg(F.sum("n").alias("n")), "nb-counts"),
        classes=materialize(classes.groupBy(LANG).agg(F.sum("n_rows").alias("n_rows")), "nb-classes"),
        name=name or model.name,
    )


def save(model: NaiveBayesModel, path: str) -> None:
    spark = model.counts.sparkSession
    model.counts.write.parquet(f"{path}/counts")
    model.classes.write.parquet(f"{path}/classes")
    spec = model.spec
    settings = [(model.name, model.alpha, spec.lo, spec.hi, spec.buckets, spec.portable)]
    schema = "name string, alpha double, lo int, hi int, buckets int, portable boolean"
    spark.createDataFrame(settings, schema).coalesce(1).write.json(f"{path}/settings")


def load(spark: SparkSession, path: str) -> NaiveBayesModel:
    schema = "name string, alpha double, lo int, hi int, buckets int, portable boolean"
    row = spark.read.schema(schema).json(f"{path}/settings").first()
    spec = GramSpec(row["lo"], row["hi"], row["buckets"], row["portable"])
    return NaiveBayesModel(
        spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/classes"), spec, row["alpha"], row["name"]
    )


def _decide(scores: Column) -> list[Column]:
    """Of ``array<struct<label, score>>``: the best entry, the top score, and the softmax mass relative to it."""
    ranked = F.transform(
        scores, lambda s: F.struct((-F.round(s["score"], 6)).alias("rank"), s["label"].alias("label"), s["score"].alias("score"))
    )
    top = F.array_max(F.transform(scores, lambda s: s["score"]))
    mass = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s["score"] - top))
    return [F.array_min(ranked).alias("_best"), top.alias("_top"), mass.alias("_mass")]


def _best_of_blocks(parts: DataFrame, keys: list[str], with_scores: bool) -> DataFrame:
    """Combine a text's blocks: the least rank wins and the masses add up on one scale."""
    entry = F.struct("_best", "_top", "_mass", *(["scores"] if with_scores else []))
    rows = parts.groupBy(*keys).agg(F.collect_list(entry).alias("_parts"))
    top = F.array_max(F.transform("_parts", lambda p: p["_top"]))
    mass = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["_mass"] * F.exp(p["_top"] - top))
    best = F.array_min(F.transform("_parts", lambda p: p["_best"]))
    scores = [F.array_sort(F.flatten(F.transform("_parts", lambda p: p["scores"]))).alias("scores")] if with_scores else []
    return rows.select(*keys, best.alias("_best"), top.alias("_top"), mass.alias("_mass"), *scores)
