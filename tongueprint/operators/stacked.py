"""Several naive Bayes models over one corpus: fitted in one pass and scored in one pass.

The model is a dimension of every table: counts are ``(model, lang, feature, n)`` and gains ``(model, feature, gains)``. The texts
are cut once, into the n-grams of the widest range; a model takes those of its own lengths and buckets them its own way.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tongueprint.functions.counting import GramCounter, lowered, text_counts
from tongueprint.functions.hashing import GramSpec
from tongueprint.functions.text import explode_grams, explode_tokens
from tongueprint.operators.lookup import BROADCAST_LIMIT
from tongueprint.operators.naive_bayes import LABEL_BLOCK, NaiveBayesModel, _answers, _best_of_blocks, _decide, _label_array, class_rows
from tongueprint.session import materialize
from tongueprint.sources.corpus import LANG, TEXT

MODEL = "model"


def belongs(gram: Column, spec: GramSpec) -> Column:
    """Whether an n-gram of a wider range is one of ``spec``: by its length, or as a whole padded token shorter than that."""
    # No word is empty, so a padded one has three characters at least; a blank alone is a piece of one.
    whole = F.length(gram).between(3, spec.lo - 1) & gram.startswith(" ") & gram.endswith(" ")
    return F.length(gram).between(spec.lo, spec.hi) | whole


def feature_type(specs: Sequence[GramSpec]) -> str:
    """Buckets are numbers and grams are strings; where both kinds are stacked, numbers are written out."""
    return "bigint" if all(spec.buckets for spec in specs) else "string"


def features(gram: Column, specs: Sequence[GramSpec], kind: str) -> Column:
    """``array<struct<_model, feature>>``: the features an n-gram makes, null where a model does not count it."""
    def entry(place: int, spec: GramSpec) -> Column:
        return F.when(belongs(gram, spec), F.struct(F.lit(place).alias("_model"), spec.feature(gram).cast(kind).alias("feature")))

    return F.array(*[entry(place, spec) for place, spec in enumerate(specs)])


def fit_many(
    train: DataFrame, specs: Mapping[str, GramSpec], alpha: float = 0.01, label_col: str = LANG, text_col: str = TEXT
) -> dict[str, NaiveBayesModel]:
    """A model per name, equal to those of ``naive_bayes.fit``, from one pass over the corpus.

    Words are counted per label, the distinct ones cut once into the widest range of n-grams, and those counted before
    they are dealt to the models, so what is multiplied by the number of models is one row per label and gram.
    """
    if not specs:
        return {}
    names, settings = list(specs), list(specs.values())
    words = explode_tokens(train, text_col, [label_col]).groupBy(label_col, "token").agg(F.count("*").alias("_times"))
    lo, hi = min(s.lo for s in settings), max(s.hi for s in settings)
    cut = explode_grams(words, lo, hi, [label_col, "_times"]).groupBy(label_col, "gram").agg(F.sum("_times").alias("_times"))
    kind = feature_type(settings)
    dealt = cut.select(F.col(label_col).alias(LANG), "_times", F.explode(features(F.col("gram"), settings, kind)).alias("_entry"))
    dealt = dealt.where(F.col("_entry").isNotNull()).select(LANG, "_entry.*", "_times")
    counts = materialize(dealt.groupBy("_model", LANG, "feature").agg(F.sum("_times").alias("n")), "nb-stacked")
    classes = materialize(class_rows(train, label_col).withColumnRenamed(label_col, LANG), "nb-classes")

    def own(place: int, spec: GramSpec) -> DataFrame:
        feature = F.col("feature").cast("bigint" if spec.buckets else "string").alias("feature")
        return counts.where(F.col("_model") == place).select(LANG, feature, "n")

    return {
        name: NaiveBayesModel(own(place, spec), classes, spec, alpha, name) for place, (name, spec) in enumerate(zip(names, settings))
    }


def predict_many(
    models: Mapping[str, NaiveBayesModel], df: DataFrame, id_col: str = "row_id", keep: Sequence[str] = (LANG,), text_col: str = TEXT,
    label_block: int = LABEL_BLOCK, broadcast_limit: int = BROADCAST_LIMIT,
) -> DataFrame:
    """``(id, keep..., pred, confidence, raw_output, model)``: what each model's ``predict`` gives, by one scan of the texts.

    Models may differ in range, buckets, smoothing and labels. Those whose gains would not fit ``broadcast_limit`` with the ones before
    are scored by themselves.
    """
    if not models:
        raise ValueError("no models")
    room, together, alone = broadcast_limit, {}, {}
    for name, model in models.items():
        size = model.dense_bytes()
        (together if size <= room else alone)[name] = model
        room -= size if size <= room else 0
    parts = [_scored_together(together, df, id_col, keep, text_col, label_block)] if together else []
    parts += [m.predict(df, id_col, keep, text_col, broadcast_limit=broadcast_limit).withColumn(MODEL, F.lit(n)) for n, m in alone.items()]
    stacked = parts[0]
    for more in parts[1:]:
        stacked = stacked.unionByName(more)
    return stacked


def _scored_together(
    models: Mapping[str, NaiveBayesModel], df: DataFrame, id_col: str, keep: Sequence[str], text_col: str, label_block: int
) -> DataFrame:
    spark, names, members = df.sparkSession, list(models), list(models.values())
    specs, constants = [m.spec for m in members], [m.constants() for m in members]
    kind, widest = feature_type(specs), max(len(of) for of in constants)
    places = spark.createDataFrame(
        [(k, c.label, i) for k, of in enumerate(constants) for i, c in enumerate(of)], f"_model int, {LANG} string, _place int"
    )
    gained = None
    for place, model in enumerate(members):
        one = model.counts.select(F.lit(place).alias("_model"), LANG, F.col("feature").cast(kind).alias("feature"), model.gain(F.col("n")).alias("_gain"))
        gained = one if gained is None else gained.unionByName(one)
    # A small row for each label of each model, all of which came from the driver.
    table = gained.join(F.broadcast(places), ["_model", LANG]).groupBy("_model", "feature").pivot("_place", list(range(widest))).agg(F.sum("_gain"))
    array = F.array(*[F.coalesce(F.col(str(i)), F.lit(0.0)) for i in range(widest)])
    gains = materialize(table.select("_model", "feature", array.alias("gains")), "nb-gains")

    keys = [id_col, *keep]
    text = [*keys, "_text"]
    # A null feature of each model stands for the text itself: one per copy, also of texts without words.
    counts = text_counts(df.select(*keys, F.xxhash64(text_col).alias("_text"), lowered(text_col).alias("_lower")), specs, "_lower")
    feature = F.col("feature")
    for place, spec in enumerate(specs):
        if spec.buckets and not GramCounter.hashes(spec):
            feature = F.when(F.col("_model") == place, spec.feature(F.col("feature")).cast("string")).otherwise(feature)
    each = counts.withColumn("feature", feature.cast(kind))
    joined = each.join(F.broadcast(gains), ["_model", "feature"], "left")

    own, size = [*text, "_model"], min(label_block, widest)
    blocks = -(-widest // size)
    joined = joined.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
    hashed = F.col("_model").isin([k for k, spec in enumerate(specs) if spec.buckets])
    known = F.col("feature").isNotNull() & (hashed | F.col("gains").isNotNull())
    sums = joined.groupBy(*own, "_block").agg(
        F.count_if(F.col("feature").isNull()).alias("_copies"), F.sum(F.when(known, F.col("_tf")).otherwise(0)).alias("_grams"),
        *[F.coalesce(F.sum(F.get("gains", F.col("_block") * size + i) * F.col("_tf")), F.lit(0.0)).alias(f"_s{i}") for i in range(size)],
    )
    sums = sums.select(*own, "_block", "_copies", "_grams", F.array(*[F.col(f"_s{i}") for i in range(size)]).alias("_gained"))

    labels = None
    for place, of in enumerate(constants):
        rows = _label_array(spark, of, size).select(F.lit(place).alias("_model"), "*")
        labels = rows if labels is None else labels.unionByName(rows)
    scores = F.transform("_labels", lambda c: F.struct(
        c["label"].alias("label"),
        (c["prior"] + (F.col("_grams") * c["unseen"] + F.get("_gained", c["_at"])) / F.col("_copies")).alias("score"),
    ))
    kept = [*own, "_copies"]
    # Models with fewer labels have no row for the last blocks: those drop out here.
    parts = sums.join(F.broadcast(labels), ["_model", "_block"]).select(*kept, scores.alias("scores")).select(*kept, *_decide(F.col("scores")))
    best = parts if blocks == 1 else _best_of_blocks(parts, kept, False)
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_model") + 1)
    return _answers(best, [*keys, "_model"], False).select(*keys, "pred", "confidence", "raw_output", named.alias(MODEL))
