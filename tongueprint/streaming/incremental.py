"""Structured Streaming forms: keep model counts current as files land, and label a stream of texts.

What a batch or a compaction writes counts only once a record of it is in ``root/commits``, written last. Data lie in a
folder of their own per attempt, so a crash leaves an attempt that nothing refers to, and a replay of a recorded batch does nothing.
Every reader takes its list of folders from one look at the records: a batch that lands meanwhile is simply not in it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import naive_bayes
from tongueprint.operators.grams import label_gram_counts
from tongueprint.operators.scorers import Scorer, with_predictions
from tongueprint.sources.corpus import LANG

RECORD = "kind string, batch_id bigint, path string"
# Kinds of records. A stream writes its first one when it starts, so there always is one to read.
START, BATCH, COMPACTED = "start", "batch", "compacted"


@dataclass(frozen=True)
class Snapshot:
    """What was recorded at one moment: the last compaction, if any, and the batches after it."""

    compacted: str | None
    covers: int
    batches: dict[int, str]

    @property
    def last(self) -> int:
        return max(self.batches, default=self.covers)


def commit(spark: SparkSession, root: str, kind: str, batch_id: int, path: str) -> None:
    """One record, one file: it is there or it is not."""
    record = spark.createDataFrame([(kind, batch_id, path)], RECORD).coalesce(1)
    record.write.mode("overwrite").parquet(f"{root}/commits/{kind}-{batch_id}")


def snapshot(spark: SparkSession, root: str, last: int | None = None) -> Snapshot:
    """The records up to batch ``last``: one small row per batch since the last compaction reaches the driver."""
    records = spark.read.schema(RECORD).option("recursiveFileLookup", True).parquet(f"{root}/commits")
    if last is not None:
        records = records.where(F.col("batch_id") <= last)
    base = records.where(F.col("kind") == COMPACTED).orderBy(F.desc("batch_id")).first()
    covers = base["batch_id"] if base else -1
    batches = records.where((F.col("kind") == BATCH) & (F.col("batch_id") > covers)).collect()
    return Snapshot(base["path"] if base else None, covers, {r["batch_id"]: r["path"] for r in batches})


def recorded(spark: SparkSession, root: str, batch_id: int) -> bool:
    return batch_id <= (seen := snapshot(spark, root)).covers or batch_id in seen.batches


def write_batch(batch: DataFrame, batch_id: int, root: str, spec: GramSpec) -> str:
    """The counts of a batch in a new folder; they count once they are recorded."""
    path = f"{root}/data/{BATCH}-{batch_id}-{uuid.uuid4().hex}"
    label_gram_counts(batch, spec, LANG).write.parquet(f"{path}/counts")
    naive_bayes.class_rows(batch).write.parquet(f"{path}/classes")
    return path


def count_stream(
    texts: DataFrame, root: str, checkpoint: str, spec: GramSpec = GramSpec(), trigger: dict | None = None
) -> StreamingQuery:
    """Count each micro-batch and record it."""
    commit(texts.sparkSession, root, START, -1, "")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not recorded(spark, root, batch_id):
            commit(spark, root, BATCH, batch_id, write_batch(batch, batch_id, root, spec))

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def streamed_model(
    spark: SparkSession, root: str, spec: GramSpec = GramSpec(), alpha: float = 0.01, last: int | None = None
) -> naive_bayes.NaiveBayesModel:
    """The model as of the batches recorded so far, up to ``last`` if given: counts add up, so it equals one batch fit."""
    return model_of(spark, snapshot(spark, root, last), spec, alpha)


def model_of(spark: SparkSession, seen: Snapshot, spec: GramSpec, alpha: float) -> naive_bayes.NaiveBayesModel:
    paths = [*([seen.compacted] if seen.compacted else []), *seen.batches.values()]

    def read(kind: str, schema: str) -> DataFrame:
        reader = spark.read.schema(schema)
        return reader.parquet(*[f"{path}/{kind}" for path in paths]) if paths else spark.createDataFrame([], schema)

    feature = "string" if spec.buckets is None else "bigint"
    counts = read("counts", f"lang string, feature {feature}, n bigint").groupBy(LANG, "feature").agg(F.sum("n").alias("n"))
    classes = read("classes", "lang string, n_rows bigint").groupBy(LANG).agg(F.sum("n_rows").alias("n_rows"))
    return naive_bayes.NaiveBayesModel(counts, classes, spec, alpha, f"streamed-{seen.last}")


def compact(spark: SparkSession, root: str, spec: GramSpec = GramSpec(), alpha: float = 0.01) -> naive_bayes.NaiveBayesModel:
    """Fold the last compaction and the batches after it into one, and record it as covering the last of them.

    The folders it covers are no longer read by anyone who looks afterwards, and may be dropped once no earlier reader is at work.
    """
    seen = snapshot(spark, root)
    if not seen.batches:
        if seen.compacted is None:
            raise ValueError(f"no finished batch below {root}")
        return model_of(spark, seen, spec, alpha)
    model = model_of(spark, seen, spec, alpha)
    path = f"{root}/data/{COMPACTED}-{seen.last}-{uuid.uuid4().hex}"
    model.counts.write.parquet(f"{path}/counts")
    model.classes.write.parquet(f"{path}/classes")
    commit(spark, root, COMPACTED, seen.last, path)
    return model_of(spark, Snapshot(path, seen.last, {}), spec, alpha)


class LatestModel:
    """The model of a counted stream, prepared anew only when a later compaction was recorded since."""

    def __init__(self, root: str, spec: GramSpec = GramSpec(), alpha: float = 0.01):
        self.root, self.spec, self.alpha = root, spec, alpha
        self.version, self.ready = None, None

    def current(self, spark: SparkSession) -> Scorer:
        seen = snapshot(spark, self.root)
        if seen.compacted is None:
            raise ValueError(f"no compacted model below {self.root}")
        if seen.compacted != self.version:
            only = Snapshot(seen.compacted, seen.covers, {})
            self.ready, self.version = Lazy(model_of(spark, only, self.spec, self.alpha).prepare()), seen.compacted
        return self.ready


class Lazy:
    """A prepared model that only ever declares plans."""

    def __init__(self, prepared: naive_bayes.Prepared):
        self.prepared, self.name = prepared, prepared.name

    def predict(self, df: DataFrame, id_col: str = "row_id", keep: Sequence[str] = (LANG,), text_col: str = "sentence") -> DataFrame:
        return self.prepared.apply(df, id_col, keep, text_col)


def label_stream(
    texts: DataFrame, scorer: Scorer | LatestModel, out: str, checkpoint: str, id_col: str = "row_id", trigger: dict | None = None
) -> StreamingQuery:
    """Label a stream of texts batch by batch into ``out/batch_id=<n>``, with all columns the stream has.

    A naive Bayes model small enough to be sent is prepared once; a ``LatestModel`` is asked for its version with every batch. A batch owns its
    folder, so a replay overwrites it.
    """
    if isinstance(scorer, naive_bayes.NaiveBayesModel) and scorer.dense_bytes() <= naive_bayes.BROADCAST_LIMIT:
        scorer = Lazy(scorer.prepare())

    def write(batch: DataFrame, batch_id: int) -> None:
        ready = scorer.current(batch.sparkSession) if isinstance(scorer, LatestModel) else scorer
        with_predictions(batch, ready, id_col).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    writer = texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
