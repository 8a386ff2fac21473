"""Toxicity by class-conditional Kneser-Ney models of characters within words.

Two models, one of toxic and one of ordinary texts, predict each character of a word from the ``order - 1`` characters
before it. Counts of the highest order belong to a class; both classes back off to the same lower orders, which count in how
many contexts a run of characters was met in either class. So a form that was met in one class only is told apart by
its own counts, and a rare or new form leans on what all texts share.

``P_c(x | h) = max(n_c(hx) - D_c, 0) / n_c(h) + D_c * kinds_c(h) / n_c(h) * P(x | h')`` with h' the context less its first
character, and ``P`` the same with continuation counts, down to single characters. A context that a class never had leaves P alone.
The log-ratio of the two models needs one number for each run met in training and one for each context, so the model is one table
``(key, ratio)``. A word's ratio is the sum over its characters.

A text is scored by two numbers: its ratio divided by its number of characters, that is the difference of the
length-normalised log-likelihoods, and the ratio of its most toxic word. A logistic regression on both, fitted on labelled
rows that were not counted, gives the score.

All counts are taken over every labelled row that may be learnt from, as Spark groupings, and grow with them. Only the logistic
regression is fitted on at most ``max_rows`` rows. The table of ratios is sent to every task while it has at most ``ship_rows``
rows, which bounds what is sent; beyond that the distinct words of the texts are scored by joins (``score_words``). Both ways give the same scores up
to rounding in the last digits of a sum.

Defined results: null and empty texts have ratio zero; a null label or id is not learnt from; of labels given twice to an id the larger counts;
texts of repeated ids all count. Without any rows of a class every text scores the share of toxic rows among the labelled
ones, or 0.5 without any label.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tongueprint.llm.common import WORD, map_rows, text_or_empty
from tongueprint.llm.quality import held_out
from tongueprint.session import materialize

# Fixed value: what separates words.
BLANK = r"[\x20\x09-\x0D]+"
# Labels of up to this many rows are sent to the texts; beyond that the texts are shuffled to them.
SENT_LABELS = 4_000_000


@dataclass(frozen=True)
class Settings:
    order: int = 5
    calibrate: int = 4
    max_rows: int = 20_000
    ship_rows: int = 2_000_000


@dataclass(frozen=True)
class Model:
    """``ratios(key, ratio)`` and the weights of (ratio per character, ratio of the most toxic word, one).

    ``sent`` is the table as a broadcast variable, where it is small enough to be one.
    """

    ratios: DataFrame
    settings: Settings
    weights: tuple[float, float, float]
    sent: Broadcast | None = None


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BLANK), lambda w: w != "")


def runs_of(words: DataFrame, order: int, keep: Sequence[str]) -> DataFrame:
    """``(keep..., run)``: each character of ``word`` and its end with the characters before it, filled up with blanks."""
    padded = F.concat(F.lit(" " * (order - 1)), F.col("word"), F.lit(" "))
    places = words.select(*keep, padded.alias("_p"), F.explode(F.sequence(F.lit(1), F.length("word") + 1)).alias("_i"))
    return places.select(*keep, F.substring("_p", F.col("_i"), F.lit(order)).alias("run"))


def discount(counts: DataFrame, column: str) -> float:
    """Ney's estimate from how many counts are one and two."""
    row = counts.agg(F.count_if(F.col(column) == 1).alias("one"), F.count_if(F.col(column) == 2).alias("two")).first()
    return row["one"] / (row["one"] + 2 * row["two"]) if row["one"] else 0.5


def context(run: str = "run") -> Column:
    return F.substring(run, F.lit(1), F.length(run) - 1)


def shorter(run: str = "run") -> Column:
    return F.substring(run, F.lit(2), F.length(run))


def shared(runs: DataFrame, order: int) -> DataFrame:
    """``(run, p)`` of the next lower order, by continuation counts, from the distinct runs of ``order`` characters."""
    levels, at = [], runs.select("run")
    for _ in range(order - 1):
        at = materialize(at.groupBy(shorter().alias("run")).agg(F.count("*").alias("n")), "toxic-order")
        levels.append(at)
    single = levels.pop()
    whole = single.agg(F.sum("n")).first()[0] or 1
    p = single.select("run", (F.col("n") / F.lit(float(whole))).alias("p"))
    while levels:
        level = levels.pop()
        d = discount(level, "n")
        sums = level.groupBy(context().alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        below = p.select(F.col("run").alias("tail"), F.col("p").alias("below"))
        met = level.withColumn("context", context()).join(sums, "context").withColumn("tail", shorter()).join(below, "tail")
        p = met.select("run", ((F.col("n") - d) / F.col("total") + F.lit(d) * F.col("kinds") / F.col("total") * F.col("below")).alias("p"))
    return p


def ratios(counts: DataFrame, order: int) -> DataFrame:
    """``(key, ratio)`` from ``(run, n0, n1)``: log of the toxic over the ordinary probability of every run met, and for each
    context that of a run never met after it."""
    d = [discount(counts, f"n{c}") for c in (0, 1)]
    keyed = counts.withColumn("context", context())
    sums = materialize(keyed.groupBy("context").agg(*[
        made for c in (0, 1) for made in (F.sum(f"n{c}").alias(f"total{c}"), F.count_if(F.col(f"n{c}") > 0).alias(f"kinds{c}"))
    ]), "toxic-contexts")
    lower = shared(counts, order).select(F.col("run").alias("tail"), "p")
    met = keyed.join(sums, "context").withColumn("tail", shorter()).join(lower, "tail")

    def left(c: int) -> Column:
        return F.lit(d[c]) * F.col(f"kinds{c}") / F.col(f"total{c}")

    def probability(c: int) -> Column:
        own = F.greatest(F.col(f"n{c}") - d[c], F.lit(0.0)) / F.col(f"total{c}") + left(c) * F.col("p")
        return F.when(F.col(f"total{c}") > 0, own).otherwise(F.col("p"))

    def unmet(c: int) -> Column:
        return F.when(F.col(f"total{c}") > 0, left(c)).otherwise(F.lit(1.0))

    of_runs = met.select(F.col("run").alias("key"), (F.log(probability(1)) - F.log(probability(0))).alias("ratio"))
    of_contexts = sums.select(F.col("context").alias("key"), (F.log(unmet(1)) - F.log(unmet(0))).alias("ratio"))
    return of_runs.unionByName(of_contexts)


def learnable(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """``(id, toxic, part)`` of the labels that may be learnt from; ``part`` is a hash of the id."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    return known.withColumn("part", F.xxhash64(F.lit("part"), "id"))


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """``(id, text, toxic)`` of the rows that may be learnt from; each carries ``part``, a hash of its id."""
    known = learnable(labels, id_col, label_col)
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    small = known.count() <= SENT_LABELS
    return texts.join(F.broadcast(known) if small else known, "id")


def train(
    docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "toxic",
) -> Model:
    """Count the labelled rows that are not held out, then fit the logistic regression on those left out of the counts."""
    rows = labelled(docs, labels, id_col, text_col, label_col)
    aside = F.pmod("part", F.lit(settings.calibrate)) == 0
    words = rows.where(~aside).select("toxic", F.explode(words_of(F.col("text"))).alias("word"))
    counted = words.groupBy("word").agg(*[F.count_if(F.col("toxic") == c).alias(f"n{c}") for c in (0, 1)])
    runs = runs_of(counted, settings.order, ["n0", "n1"]).groupBy("run").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = materialize(runs, "toxic-counts")
    table = materialize(ratios(counts, settings.order), "toxic-ratios")

    # What the regression sees is bounded by max_rows. The ids are chosen among the labels, so that the texts stay where they are
    # and only their two numbers travel; the second limit is for ids that repeat.
    first = learnable(labels, id_col, label_col).where(aside).select("part").orderBy("part").limit(settings.max_rows)
    last = first.agg(F.max("part")).first()[0]
    sample = rows.where(aside & (F.col("part") <= F.lit(last)))
    bare = Model(table, settings, (0.0, 0.0, 0.0), send(table) if table.count() <= settings.ship_rows else None)
    numbers = measure(sample.select("part", "text", "toxic"), bare).select("part", "per_char", "top", "toxic")
    seen = numbers.orderBy("part", "per_char", "top").limit(settings.max_rows).toPandas()
    return replace(bare, weights=logistic(seen[["per_char", "top"]].to_numpy(dtype=float), seen["toxic"].to_numpy(dtype=float)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.1, rounds: int = 100) -> tuple[float, float, float]:
    """Weights of the two numbers and the constant by Newton steps under a small L2 penalty."""
    if len(np.unique(y)) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return 0.0, 0.0, float(np.log(share / (1 - share)))
    scale = np.maximum(x.std(0), 1e-9)
    rows, w = np.c_[x / scale, np.ones(len(x))], np.zeros(3)
    ridge = np.diag([penalty, penalty, 1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -500, 500)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge, rows.T @ (p - y) + ridge @ w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale[0]), float(w[1] / scale[1]), float(w[2])


class Ratios(dict):
    """Ratio of each word met, from those of its runs; it starts over when large, so its memory is bounded."""

    def __init__(self, table: dict[str, float], order: int):
        self.table, self.order = table, order

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
        order, found = self.order, self.table.get
        padded, total = " " * (order - 1) + word + " ", 0.0
        for i in range(len(word) + 1):
            run = padded[i:i + order]
            ratio = found(run)
            total += found(run[:-1], 0.0) if ratio is None else ratio
        self[word] = total
        return total


def send(table: DataFrame) -> Broadcast:
    """The ratios to every task, once for all texts that are scored with them; as Arrow arrays they stay small on the driver."""
    rows = table.toArrow()
    return table.sparkSession.sparkContext.broadcast((rows["key"].combine_chunks(), rows["ratio"].combine_chunks()))


def measure(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """Add ``per_char`` and ``top`` to every row; columns of these names are replaced."""
    settings = model.settings
    df = df.drop("per_char", "top")
    if model.sent is None or model.ratios.count() > settings.ship_rows:
        return by_joins(df, model, text_col)
    shipped = model.sent
    lowered = next(name for name in (f"_lowered{i}" for i in range(len(df.columns) + 1)) if name not in df.columns)
    wide = df.withColumn(lowered, F.lower(text_or_empty(text_col)))
    schema = ", ".join([*(f"`{c.replace('`', '``')}` {t}" for c, t in df.dtypes), "per_char double", "top double"])

    def make():
        keys, values = shipped.value
        ratio, find = Ratios(dict(zip(keys.to_pylist(), values.to_pylist())), settings.order), re.compile(WORD).findall

        def one(text: str) -> tuple[float, float]:
            words = find(text)
            if not words:
                return 0.0, 0.0
            found = [ratio[w] for w in words]
            return sum(found) / (sum(map(len, words)) + len(words)), max(found)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            *own, texts = batch.columns
            pairs = [one(text.as_py()) for text in texts]
            made = [pa.array([pair[i] for pair in pairs], pa.float64()) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([*own, *made], names=[*batch.schema.names[:-1], "per_char", "top"])

        return step

    return map_rows(wide, make, schema)


def score_words(words: DataFrame, model: Model) -> DataFrame:
    """``(word, ratio)`` for distinct words, by joins with the table of ratios."""
    runs = runs_of(words, model.settings.order, ["word"]).withColumn("context", context())
    of_run = model.ratios.select(F.col("key").alias("run"), F.col("ratio").alias("_met"))
    of_context = model.ratios.select(F.col("key").alias("context"), F.col("ratio").alias("_unmet"))
    met = runs.join(of_run, "run", "left").join(of_context, "context", "left")
    return met.groupBy("word").agg(F.sum(F.coalesce("_met", "_unmet", F.lit(0.0))).alias("ratio"))


def by_joins(df: DataFrame, model: Model, text_col: str) -> DataFrame:
    """The same two numbers without sending the model: equal texts are scored once, by their distinct words."""
    keys = [f"_key{i}" for i in range(len(df.columns) + 1)]
    key = next(name for name in keys if name not in df.columns)
    text = F.col(text_col)
    hashed = F.sha2(F.coalesce(text, F.lit("")), 256)
    texts = df.select(hashed.alias("id"), words_of(F.coalesce(text, F.lit(""))).alias("words"))
    once = materialize(texts.groupBy("id").agg(F.first("words").alias("words")), "toxic-texts")
    words = materialize(once.select("id", F.explode("words").alias("word")).groupBy("id", "word").agg(F.count("*").alias("n")), "toxic-words")
    vocabulary = materialize(score_words(words.select("word").distinct(), model), "toxic-vocabulary")
    found = words.join(vocabulary, "word").groupBy("id").agg(
        (F.sum(F.col("n") * F.col("ratio")) / F.sum(F.col("n") * (F.length("word") + 1))).alias("per_char"), F.max("ratio").alias("top")
    ).withColumnRenamed("id", key)
    joined = df.withColumn(key, hashed).join(found, key, "left")
    return joined.select(*df.columns, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("per_char", "top")])


def score(df: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add ``score_col``, the probability that a text is toxic, to every row. Columns ``per_char`` and ``top`` are added too."""
    a, b, c = model.weights
    linear = F.lit(a) * F.col("per_char") + F.lit(b) * F.col("top") + F.lit(c)
    bounded = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), linear))
    return measure(df.drop(score_col), model, text_col).withColumn(score_col, 1 / (1 + F.exp(-bounded)))
