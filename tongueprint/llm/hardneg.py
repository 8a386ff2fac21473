"""Hard-negative mining by threshold joins over a partial inverted index.

An anchor's positives are its best rows of the same label; its hard negatives are the best rows of other labels whose
score lies in a window below each positive's. Both are threshold joins: find every candidate that reaches a threshold,
and lower the threshold until each window has as many as it wants or its lower end is reached.

A join with threshold t works on a block of candidates and a group of anchors. By the Cauchy-Schwarz bound a candidate
whose first dimensions have a norm below t / |anchor| cannot reach t by them alone, so these dimensions are left out of
the index (the posting of a run of dimensions holds only the candidates that need it). Partial scores are added up over the
postings; a pair is pruned when its partial score plus the product of the norms of what was left out stays below t, and the rest
are scored in full. Bounds have slack for rounding, and scores are whole numbers computed exactly: as doubles where all
products and sums stay below 2^53, else as Python integers.

Anchors meet candidates in blocks of bounded size, each pair of blocks in one task, and every task returns at
most ``most`` rows per window, so a vector that is very common makes no more rows than any other.

Defined results: rows with a null id or label, a null vector, or a component that is null, NaN, infinite or infinite once
multiplied by the scale take no part. Missing components of shorter vectors count as zero. A row is no candidate for an anchor of its
own id. Rows of equal id are candidates each; equal anchor rows are answered once, unlike ones each. Scores beyond 64
bits are returned as the largest (smallest) such number. A positive with a negative score has no negatives (its window is empty).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.llm.common import workers

ANCHOR_BLOCK = 65_536
CANDIDATE_BLOCK = 65_536
# Dimensions in one posting, anchors joined at once, thresholds tried, pairs scored at once.
RUN, GROUP, ROUNDS, PIECE = 8, 128, 4, 50_000
LEAST, MOST = -(2**63), 2**63 - 1

FOUND = "anchor_id long, anchor_key long, place int, positive_id long, positive_score long, candidate_id long, score long"


@dataclass(frozen=True)
class Want:
    """One window of an anchor: scores from ``low`` to ``high``, for the positive ``positive_id`` (null when looking for positives)."""

    place: int
    positive_id: int | None
    positive_score: int | None
    low: int
    high: int


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = 256) -> DataFrame:
    """``(id, label, vector array<double>)`` of the rows that take part; components are not scaled yet."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x * F.lit(float(scale))) != F.lit(float("inf")))

    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull() & F.forall("vector", finite))


def matrix(column: pa.ChunkedArray, scale: float, width: int) -> np.ndarray:
    """Scaled whole numbers, still as doubles: scaling by a power of two and rounding down are exact."""
    out = np.zeros((len(column), width))
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(lists.value_lengths())
    values = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        out[:] = values.reshape(len(sizes), width)
    elif len(values):
        rows = np.repeat(np.arange(len(sizes)), sizes)
        out[rows, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return np.floor(out * scale)


def prefix_norms(rows: np.ndarray) -> np.ndarray:
    """Norm of the first 0, 1, ... runs of dimensions, the last column being that of the whole row."""
    runs = -(-rows.shape[1] // RUN)
    squares = np.zeros((len(rows), runs + 1))
    for run in range(runs):
        squares[:, run + 1] = squares[:, run] + (rows[:, run * RUN:(run + 1) * RUN] ** 2).sum(1)
    return np.sqrt(squares)


def join_above(
    anchors: np.ndarray, anchor_norms: np.ndarray, rows: np.ndarray, row_norms: np.ndarray, least: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (anchor, row, score) with a score of at least ``least`` of the anchor."""
    runs = row_norms.shape[1] - 1
    lengths = np.maximum(anchor_norms[:, -1], 1e-300)
    reach = np.where(least > 0, least / lengths, 0.0).min() * (1 - 1e-9)
    # Runs left out of a row's index: as many first ones as stay below the reach together.
    cut = (row_norms[:, 1:] < reach).sum(1) if reach > 0 else np.zeros(len(rows), dtype=np.int64)
    order = np.argsort(cut, kind="stable")
    cut, indexed = cut[order], rows[order]
    partial = np.zeros((len(anchors), len(rows)))
    for run in range(runs - 1, -1, -1):
        posted = int(np.searchsorted(cut, run, side="right"))
        if posted:
            part = slice(run * RUN, (run + 1) * RUN)
            partial[:, :posted] += anchors[:, part] @ indexed[:posted, part].T
    bound = partial + anchor_norms[:, cut] * row_norms[order, cut][None, :]
    slack = 1e-9 * lengths[:, None] * row_norms[order, -1][None, :] + 0.5
    at, of = np.nonzero(bound + slack >= least[:, None])
    scores = np.empty(len(at))
    for start in range(0, len(at), PIECE):
        some = slice(start, start + PIECE)
        scores[some] = np.einsum("ij,ij->i", anchors[at[some]], indexed[of[some]])
    kept = scores >= least[at]
    return at[kept], order[of[kept]], scores[kept]


def whole_scores(anchor: np.ndarray, rows: np.ndarray) -> list[int]:
    """Products of any size, exactly, held to 64 bits."""
    numbers = [int(x) for x in anchor]
    return [min(MOST, max(LEAST, sum(a * int(x) for a, x in zip(numbers, row) if a and x))) for row in rows]


def best(found: list[tuple[int, int]], want: Want, most: int) -> list[tuple[int, int]]:
    """The first ``most`` of (score, id) within the window, best first."""
    return sorted(((s, i) for s, i in found if want.low <= s <= want.high), key=lambda pair: (-pair[0], pair[1]))[:most]


def search(
    anchors: np.ndarray, wants: list[list[Want]], rows: np.ndarray, ids: np.ndarray, allowed: Callable[[int, np.ndarray], np.ndarray], most: int
) -> list[list[list[tuple[int, int]]]]:
    """For each anchor and window the first ``most`` (score, id) of the allowed rows.

    ``allowed(anchor, row numbers)`` says which rows may count.
    """
    safe = float(np.floor(np.sqrt(2.0**52 / max(1, rows.shape[1]))))
    small_rows, small_anchors = (np.flatnonzero((np.abs(x) <= safe).all(1)) for x in (rows, anchors))
    large_rows = np.setdiff1d(np.arange(len(rows)), small_rows)
    results: list = [[[] for _ in own] for own in wants]
    plain = rows[small_rows]
    row_norms, anchor_norms = prefix_norms(plain), prefix_norms(anchors[small_anchors])
    longest = float(row_norms[:, -1].max(initial=0.0))

    # From the highest score a window can hold down to the lowest, in equal steps; the last one finds all that is left.
    tops, lows = np.zeros(len(small_anchors)), np.zeros(len(small_anchors))
    for n, at in enumerate(small_anchors):
        peak = float(np.ceil(anchor_norms[n, -1] * longest)) + 1
        some = [w for w in wants[at] if w.low <= w.high]
        tops[n] = min(peak, max((w.high for w in some), default=0))
        lows[n] = max(-peak, min((w.low for w in some), default=0))
    open_ = [n for n, at in enumerate(small_anchors) if any(w.low <= w.high for w in wants[at])] if len(plain) else []
    for turn in range(1, ROUNDS + 1):
        least = tops + (lows - tops) * turn / ROUNDS
        least = np.floor(least) if turn < ROUNDS else lows
        reach = least / np.maximum(anchor_norms[:, -1], 1e-300)
        open_ = sorted(open_, key=lambda n: reach[n])
        left = []
        for start in range(0, len(open_), GROUP):
            group = np.asarray(open_[start:start + GROUP])
            at, of, scores = join_above(
                anchors[small_anchors[group]], anchor_norms[group], plain, row_norms, least[group]
            )
            edges = np.searchsorted(at, np.arange(len(group) + 1))
            for k, n in enumerate(group):
                own, numbers = int(small_anchors[n]), of[edges[k]:edges[k + 1]]
                mine = scores[edges[k]:edges[k + 1]].astype(np.int64)
                may = allowed(own, small_rows[numbers])
                mine, theirs = mine[may], ids[small_rows[numbers[may]]]
                filled = True
                for w, want in enumerate(wants[own]):
                    inside = np.flatnonzero((mine >= want.low) & (mine <= want.high))
                    first = inside[np.lexsort((theirs[inside], -mine[inside]))[:most]]
                    results[own][w] = list(zip(mine[first].tolist(), theirs[first].tolist()))
                    filled &= len(first) == most or want.low >= least[n] or want.low > want.high
                if not filled:
                    left.append(int(n))
        open_ = left
        if not open_:
            break

    # Numbers too large for doubles are scored one by one, without bounds.
    small = set(small_anchors.tolist())
    for at in range(len(anchors)):
        others = large_rows if at in small else np.arange(len(rows))
        others = others[allowed(at, others)] if len(others) else others
        if len(others) and wants[at]:
            extra = list(zip(whole_scores(anchors[at], rows[others]), ids[others].tolist()))
            results[at] = [best(results[at][w] + extra, want, most) for w, want in enumerate(wants[at])]
    return results


def grid(anchors: DataFrame, candidates: DataFrame, n_anchors: int, n_rows: int, anchor_block: int, candidate_block: int) -> tuple:
    """Both sides grouped by (side, part): every block of anchors with every block of candidates."""
    sides = max(1, -(-n_anchors // anchor_block))
    parts = max(1, -(-n_rows // candidate_block), min(workers(candidates), -(-n_rows // 1024)))
    asking = anchors.withColumn("side", F.pmod("anchor_key", F.lit(sides)).cast("int"))
    asking = asking.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    there = candidates.select(*[F.col(c).alias(c) for c in candidates.columns]).withColumn("part", F.pmod(F.xxhash64("id", "vector"), F.lit(parts)).cast("int"))
    there = there.withColumn("side", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    asking = asking.select(*[F.col(c).alias(c) for c in asking.columns])
    return asking.groupBy("side", "part"), there.groupBy("side", "part")


def as_table(rows: list[tuple]) -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [part.split()[0] for part in FOUND.split(", ")]
    return pa.table([pa.array([row[i] for row in rows], kind) for i, kind in enumerate(types)], names=names)


def mine(
    rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    anchor_block: int = ANCHOR_BLOCK, candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` from tables as ``usable`` gives them.

    A positive's negatives are the first ``negatives`` rows of another label with a score between ``low`` and ``high`` hundredths of
    the positive's.
    """
    rows, anchors = rows.select("id", "label", "vector"), anchors.select("id", "label", "vector")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    asked = anchors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    width, factor = max(facts["width"] or 0, asked["width"] or 0, 1), float(scale)
    keyed = anchors.withColumn("anchor_key", F.xxhash64("id", "label", "vector")).dropDuplicates(["id", "anchor_key"])

    def sides(left: pa.Table, right: pa.Table) -> tuple:
        numbers = [np.asarray(t.column(c).combine_chunks()) for t in (left, right) for c in ("id", "label")]
        return *numbers, matrix(left.column("vector"), factor, width), matrix(right.column("vector"), factor, width)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return as_table([])
        own, own_labels, ids, labels, a, c = sides(left, right)
        keys, out = left.column("anchor_key").to_pylist(), []
        for label in np.unique(own_labels):
            mine, theirs = np.flatnonzero(own_labels == label), np.flatnonzero(labels == label)
            other = ids[theirs]
            wants = [[Want(0, None, None, LEAST, MOST)] for _ in mine]
            found = search(a[mine], wants, c[theirs], other, lambda at, some: other[some] != own[mine[at]], positives)
            for at, (scored,) in zip(mine, found):
                out += [(int(own[at]), keys[at], 0, None, None, i, s) for s, i in scored]
        return as_table(out)

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return as_table([])
        own, own_labels, ids, labels, a, c = sides(left, right)
        keys, wants = left.column("anchor_key").to_pylist(), []
        for those in left.column("wanted").to_pylist():
            wants.append([
                Want(w["place"], w["positive_id"], w["score"], -((-low * w["score"]) // 100), high * w["score"] // 100) for w in those
            ])
        found = search(a, wants, c, ids, lambda at, some: (labels[some] != own_labels[at]) & (ids[some] != own[at]), negatives)
        return as_table([
            (int(own[at]), keys[at], want.place, want.positive_id, want.positive_score, i, s)
            for at, lists in enumerate(found) for want, scored in zip(wants[at], lists) for s, i in scored
        ])

    def blocks(asking: DataFrame) -> tuple:
        return grid(asking, rows, asked["n"], facts["n"], anchor_block, candidate_block)

    asking, there = blocks(keyed)
    near = asking.cogroup(there).applyInArrow(find_positives, FOUND)
    nearest = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.col("score").desc(), "candidate_id")
    places = near.withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives)
    wanted = places.groupBy("anchor_id", "anchor_key").agg(
        F.array_sort(F.collect_list(F.struct("place", F.col("candidate_id").alias("positive_id"), "score"))).alias("wanted")
    )  # at most ``positives`` entries each
    own = wanted.select(F.col("anchor_id").alias("_id"), F.col("anchor_key").alias("_key"), "wanted")
    wanting = keyed.join(own, (F.col("id") == F.col("_id")) & (F.col("anchor_key") == F.col("_key"))).drop("_id", "_key")
    asking, there = blocks(wanting)
    far = asking.cogroup(there).applyInArrow(find_negatives, FOUND)
    order = Window.partitionBy("anchor_id", "anchor_key", "place").orderBy(F.col("score").desc(), "candidate_id")
    return far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", F.col("candidate_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
