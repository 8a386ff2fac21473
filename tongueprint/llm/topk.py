"""Exact top-k inner products by pivot-table elimination.

An inner product is a distance in disguise: give each candidate one more component that lifts it to the common length M,
and each query a zero there; then ``|q - c|^2 = |q|^2 + M^2 - 2 q.c``, and the largest product is the nearest point. For
each candidate the distances to a fixed set of pivots are tabled once. By the triangle inequality
``max_p |d(q, p) - d(c, p)|`` bounds the distance from below and so the product from above. Candidates are evaluated in
order of that bound and a query stops once its k-th product beats every bound that is left; ties stay exact, since
it only stops on strictly better products. Components are whole numbers held as doubles: products are exact as doubles where they
stay below 2^52, and are worked out in Python integers beyond. Bounds that are lost in rounding eliminate nothing. Scores beyond 64
bits are held to the largest (smallest) such number.

Queries meet candidates in blocks of bounded size: rows are dealt to blocks by hash, each query block meets each
candidate block in one task, and the k best of every pair of blocks are merged. Only the pivots (``pivots`` vectors
from a sample of at most ``sample`` rows) and M go through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


PIVOTS = 32
SAMPLE = 2_000
QUERY_BLOCK = 2_048
CANDIDATE_BLOCK = 16_384
STEP = 512
LEAST, MOST = -(2**63), 2**63 - 1


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``(id, vector array<double>)`` with each component as the whole number ``floor(scale * x)``, x as double.

    Rows with a null vector, or with a component that is null, NaN, infinite or infinite once multiplied, take no part; nor
    do rows with a null id. ``scale`` is a power of two, so that nothing is rounded but downwards to the whole number.
    """
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x) != F.lit(float("inf")))

    def down(x: Column) -> Column:
        # From 2^53 on all doubles are whole numbers; floor would turn them into a long.
        return F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)

    doubled = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("_v"))
    kept = doubled.where(F.col("id").isNotNull() & F.col("_v").isNotNull() & F.forall("_v", finite))
    return kept.select("id", F.transform("_v", lambda x: down(F.lit(float(scale)) * x)).alias("vector"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Rows of the sample far from each other: each next one maximises the distance to those before it."""
    if not len(sample):
        return sample
    chosen = [int(np.argmax((sample**2).sum(1)))]
    gap = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        if gap.max() <= 0:
            break
        chosen.append(int(np.argmax(gap)))
    return sample[chosen]


def lift(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Candidates with the component that gives all of them the length ``sqrt(longest)``."""
    extra = np.sqrt(np.maximum(0.0, longest - (vectors**2).sum(1)))
    return np.concatenate([vectors, extra[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2.0 * a @ b.T
    return np.sqrt(np.maximum(0.0, squared))


def block_top(
    query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, longest: float, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of this block for each query, as (query row, id, score)."""
    lengths = np.sqrt((queries**2).sum(1))
    most = float(np.sqrt((vectors**2).sum(1)).max(initial=0.0))
    reach = longest + lengths**2
    to_pivots = distances(lift(vectors, longest), pivots)
    from_pivots = distances(np.concatenate([queries, np.zeros((len(queries), 1))], axis=1), pivots)
    rows, found, scores = [], [], []
    for row in range(len(queries)):
        lower = np.abs(to_pivots - from_pivots[row]).max(1) if pivots.size else np.zeros(len(ids))
        # Rounding in the distances must not eliminate a tie: a little slack only costs evaluations.
        upper = np.nan_to_num((reach[row] - lower**2) / 2.0 + 1e-6 * max(1.0, reach[row]), nan=np.inf, posinf=np.inf)
        small = lengths[row] * most < 1 << 52
        order = np.argsort(-upper, kind="stable")
        best_ids, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for start in range(0, len(order), STEP):
            # Python compares a float with an integer exactly. A score held to the least one may be any below.
            if len(best) == k and best[-1] > LEAST and float(upper[order[start]]) < int(best[-1]):
                break
            some = order[start:start + STEP]
            some = some[ids[some] != query_ids[row]]
            best_ids = np.concatenate([best_ids, ids[some]])
            scored = (vectors[some] @ queries[row]).astype(np.int64) if small else whole_scores(queries[row], vectors[some])
            best = np.concatenate([best, scored])
            # The complement turns the order round and, unlike the negative, holds for the least number too.
            first = np.lexsort((best_ids, ~best))[:k]
            best_ids, best = best_ids[first], best[first]
        rows.append(np.full(len(best), row))
        found.append(best_ids)
        scores.append(best)
    join = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts])
    return join(rows), join(found), join(scores)


def whole_scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Products of whole numbers of any size, exactly, held to 64 bits."""
    used = [(i, int(x)) for i, x in enumerate(query) if x]
    sums = (sum(x * int(row[i]) for i, x in used) for row in rows)
    return np.array([min(MOST, max(LEAST, total)) for total in sums], dtype=np.int64)


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 5, pivots: int = PIVOTS, query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``(query_id, rank, id, score)`` from two tables ``(id long, vector array<double>)`` of whole-number vectors.

    A row is no candidate for the query with its own id. Equal scores rank by smaller id; fewer than k candidates give
    fewer rows. A vector shorter than the longest counts as filled with zeros. A candidate id given twice
    counts twice; a query id given twice is answered once, by the best products of both vectors.
    """
    candidates, queries = candidates.select("id", "vector"), queries.select("id", "vector")
    square = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    facts = candidates.agg(F.count("*").alias("n"), F.max(square).alias("longest"), F.max(F.size("vector")).alias("width")).first()
    asked = queries.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width = max(facts["width"] or 0, asked["width"] or 0)
    longest = float(facts["longest"] or 0)
    picked = candidates.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    with np.errstate(over="ignore", invalid="ignore"):
        anchors = lift(choose_pivots(matrix(picked["vector"], width), pivots), longest) if len(picked) else np.zeros((0, width + 1))
    parts, sides = -(-facts["n"] // candidate_block) or 1, -(-asked["n"] // query_block) or 1

    def dealt(df: DataFrame, own: str, blocks: int, other: str, times: int) -> DataFrame:
        keyed = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        return keyed.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(times - 1))))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        with np.errstate(over="ignore", invalid="ignore"):
            rows, ids, scores = block_top(
                left["id"].to_numpy(), matrix(left["vector"], width), right["id"].to_numpy(), matrix(right["vector"], width),
                anchors, longest, k,
            )
        return pd.DataFrame({"query_id": left["id"].to_numpy()[rows], "vec_id": ids, "score": scores})

    asking = dealt(queries, "_side", sides, "_part", parts).groupBy("_side", "_part")
    there = dealt(candidates, "_part", parts, "_side", sides).groupBy("_side", "_part")
    near = asking.cogroup(there).applyInPandas(meet, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for row, vector in enumerate(vectors):
        out[row, :len(vector)] = vector
    return out
