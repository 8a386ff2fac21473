"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Tokens are words and single other characters, case kept. Each token and each pair of neighbours is hashed to one of
``buckets`` features, and a pair of equal tokens also counts for one feature of all such pairs; a feature's value is ``1 + ln(count)``, scaled so that a text has length one. Training goes through the
sample row by row: every coordinate keeps its summed gradients and squared gradients, and its weight is what minimises
their linearised loss under L1 and L2 penalties, so most weights stay exactly zero. A score is the logistic of one sparse
dot product. The weights are one array of fixed size, so shipping them to every task is bounded.

Training rows are bounded by ``max_rows`` (a uniform sample by hash of the id); everything else reads all rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tongueprint.llm.common import map_rows, text_or_empty

TOKEN = re.compile(r"\w+|[^\w\s]")


@dataclass(frozen=True)
class Settings:
    buckets: int = 2**18
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.02
    epochs: int = 3
    max_rows: int = 20_000


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float


class Hashes(dict):
    """Hash of each token met; it starts over when large, so its memory is bounded."""

    def __missing__(self, token: str) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return value


def features(text: str, hashes: Hashes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of a whole text and their values; none for a text without tokens."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return np.zeros(0, dtype=np.int64), np.zeros(0)
    single = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    pairs = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    repeats = np.zeros(np.count_nonzero(single[:-1] == single[1:]), dtype=np.uint64)
    mixed = np.concatenate([single * np.uint64(0xD6E8FEB86659FD93), pairs, repeats])
    places, counts = np.unique((mixed >> np.uint64(32)) % np.uint64(buckets), return_counts=True)
    values = 1.0 + np.log(counts)
    return places.astype(np.int64), values / np.sqrt(np.dot(values, values))


def train_rows(rows: Iterator[tuple[str, int]], settings: Settings) -> Model:
    """Weights after ``epochs`` passes over (text, label) in the order given."""
    hashes = Hashes()
    sample = [(*features(text, hashes, settings.buckets), label) for text, label in rows]
    gathered, squares = np.zeros(settings.buckets + 1), np.zeros(settings.buckets + 1)
    bias = np.array([settings.buckets])

    def weight(at: np.ndarray) -> np.ndarray:
        z = gathered[at]
        rate = (settings.beta + np.sqrt(squares[at])) / settings.alpha + settings.l2
        return np.where(np.abs(z) <= settings.l1, 0.0, (np.sign(z) * settings.l1 - z) / rate)

    for _ in range(settings.epochs):
        for places, values, label in sample:
            at, x = np.concatenate([places, bias]), np.concatenate([values, [1.0]])
            w = weight(at)
            gradient = (logistic(np.dot(w, x)) - label) * x
            grown = squares[at] + gradient * gradient
            gathered[at] += gradient - (np.sqrt(grown) - np.sqrt(squares[at])) / settings.alpha * w
            squares[at] = grown
    final = weight(np.arange(settings.buckets + 1))
    return Model(final[:-1], float(final[-1]))


def logistic(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-np.clip(x, -500.0, 500.0))))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows no label may be learnt from: CRC-32 of the id as text is a multiple of five (a null id counts as empty)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality",
) -> Model:
    """Fit on at most ``max_rows`` labelled rows that are not held out. Rows with a null id or label are not used.

    A label given twice to one id counts once, the larger one. Without any row the model scores 0.5 everywhere.
    """
    rows = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    rows = rows.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    rows = rows.withColumn("_at", F.xxhash64("_id")).orderBy("_at", "_id").limit(settings.max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), text_or_empty(text_col).alias("_text"))
    sample = texts.join(F.broadcast(rows), "_id")  # at most max_rows small rows

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = train_rows(((t, y) for f in frames for t, y in zip(f["_text"], f["_label"])), settings)
        used = np.flatnonzero(model.weights)
        yield pd.DataFrame({"places": [used], "values": [model.weights[used]], "bias": [model.bias]})

    # The sample is bounded, so one task holds it; its order does not depend on partitions.
    ordered = sample.select("_at", "_id", "_text", "_label").repartition(1).sortWithinPartitions("_at", "_id", "_text")
    row = ordered.mapInPandas(fit, "places array<long>, values array<double>, bias double").first()
    weights = np.zeros(settings.buckets)
    if row is not None:
        weights[np.asarray(row["places"], dtype=np.int64)] = row["values"]
    return Model(weights, row["bias"] if row is not None else 0.0)


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``, the probability of label 1, to every row. Null and empty texts get the score of the bias."""
    df = df.drop(score_col)
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes), f"`{score_col}` double"])
    place, shipped = df.columns.index(text_col), df.sparkSession.sparkContext.broadcast(model)

    def make():
        hashes, weights, bias = Hashes(), shipped.value.weights, shipped.value.bias

        def one(text: str | None) -> float:
            places, values = features(text or "", hashes, len(weights))
            return logistic(bias + float(np.dot(weights[places], values)))

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = pa.array([one(text.as_py()) for text in batch.column(place)], pa.float64())
            return pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, score_col])

        return step

    return map_rows(df, make, schema)
