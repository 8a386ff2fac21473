"""Mixing sources to target weights along a time-varying curriculum, all as DataFrame operations.

Every source has a share of the training words and a schedule that says how its weight changes while training goes on.
Steps:

1. Shares become targets in words, none above ``most`` times what the source holds; what is cut off goes to the others
   by weight. The end of that sharing is ``min(cap, level * weight)`` for one level, found from running sums over the
   sources ordered by cap per weight.
2. The documents of a source stand in a fixed random order (hash of id). Their running sum of words, times
   target over size, is the cumulative demand; a document takes what the demand grows by, rounded down at both ends, so
   the words taken add up to the target and a document never takes more than ``most`` times its size.
3. The integral of the schedule up to time t is the share of the target consumed by then. Inverting it at the middle of
   a document's demand gives its training position in [0, 1).
4. ``range_sort`` orders documents by position, one range a partition.

Running sums go through fixed hash cells: sums of cells first, then within a cell. A source with a third of all rows is
spread over all cells, and only small rows (id, size, hash) move; no text does.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.llm.common import WORD, text_or_empty, workers

# Source weights in order of name, repeating.
WEIGHTS = (5, 2, 1)
# Time and relative weight at it, linear in between; one schedule for each weight class. The first class fades, the
# last one comes late. They need no common scale: each is divided by its own integral.
SCHEDULES = (((0.0, 1.0), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 1.75)))
# Leading digits of the hash that make a cell for running sums, 4096 in each source; the number only spreads work.
CELL_DIGITS = 3


def word_count(text_col: str) -> Column:
    return F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long")


def source_targets(
    sizes: DataFrame, source_col: str = "source", share: float = 1.5, most: float = 2.0, weights: Sequence[int] = WEIGHTS
) -> DataFrame:
    """``(source, source_size, weight, place, target)`` from ``(source, source_size)``: a row per source, null included.

    Works on one row per source, never on documents. Sources without words get target 0.
    """
    by_name = Window.orderBy(F.col(source_col).asc_nulls_last())
    placed = sizes.withColumn("place", ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    listed = F.array(*[F.lit(float(w)) for w in weights])
    placed = placed.withColumn("weight", F.get(listed, F.col("place")))
    cap = F.lit(float(most)) * F.col("source_size")
    by_level = Window.orderBy((cap / F.col("weight")).asc(), F.col(source_col).asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    leveled = placed.select(
        "*", cap.alias("_cap"), F.coalesce(F.sum(cap).over(before), F.lit(0.0)).alias("_filled"),
        (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("_open"),
        (F.lit(float(share)) * F.sum("source_size").over(whole)).alias("_wanted"),
    )
    # If this source and all after it share what is left by weight, this is the level. The first one within its own
    # cap is the common level; those after it only fall.
    level = (F.col("_wanted") - F.col("_filled")) / F.col("_open")
    fits = F.when(level * F.col("weight") <= F.col("_cap"), level)
    common = F.coalesce(F.max(fits).over(whole), F.lit(float("inf")))
    return leveled.withColumn("_level", common).select(
        source_col, "source_size", "weight", "place", F.least("_cap", F.col("_level") * F.col("weight")).alias("target")
    )


def invert(consumed: Column, schedule: Sequence[tuple[float, float]]) -> Column:
    """Time at which a share ``consumed`` of the schedule's integral is reached."""
    pieces = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in pairwise(schedule)]
    total = sum(piece[-1] for piece in pieces)
    wanted, done, out = consumed * F.lit(total), 0.0, None
    for t0, w0, t1, w1, area in pieces:
        rest = F.greatest(F.lit(0.0), wanted - F.lit(done))
        slope = (w1 - w0) / (t1 - t0)
        # Root of w0*x + slope*x^2/2 = rest, in the form that is stable and also right for slope 0.
        root = F.sqrt(F.greatest(F.lit(0.0), F.lit(w0 * w0) + F.lit(2.0 * slope) * rest))
        time = F.lit(t0) + F.when(rest > 0, F.lit(2.0) * rest / (F.lit(w0) + root)).otherwise(F.lit(0.0))
        here = F.least(F.lit(t1), time)
        out = F.when(wanted <= F.lit(done + area), here) if out is None else out.when(wanted <= F.lit(done + area), here)
        done += area
    return out.otherwise(F.lit(schedule[-1][0]))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", share: float = 1.5,
    most: float = 2.0, weights: Sequence[int] = WEIGHTS, schedules: Sequence[Sequence[tuple[float, float]]] = SCHEDULES,
    seed: int = 7,
) -> DataFrame:
    """``(id, source, size, source_size, target, taken, position)`` for every row of ``docs``.

    Null texts have size 0 and take nothing, so does every text without words; a null source is a source. Rows of
    equal id stand next to each other by size, and each takes its own part; rows of equal size too are interchangeable. Columns that
    are not named are ignored. Reruns give the same rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(text_col).alias("size"), key.alias("_key")
    ).withColumn("_cell", F.substring("_key", 1, CELL_DIGITS))
    cells = rows.groupBy("_source", "_cell").agg(F.sum("size").alias("_words"))
    sizes = cells.groupBy("_source").agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, "_source", share, most, weights)
    in_order = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select("_source", "_cell", F.coalesce(F.sum("_words").over(in_order), F.lit(0)).alias("_before"))
    offsets = offsets.withColumnRenamed("_source", "_s").join(targets, F.col("_s").eqNullSafe(F.col("_source"))).drop("_s")
    offsets = offsets.withColumnsRenamed({"_source": "_s", "_cell": "_c"})
    placed = rows.join(offsets, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c"))).drop("_s", "_c")
    within = Window.partitionBy("_source", "_cell").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("size").over(within)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    demand = placed.select("*", upto.alias("_upto"), rate.alias("_rate"))
    last, first = F.col("_upto") * F.col("_rate"), (F.col("_upto") - F.col("size")) * F.col("_rate")
    middle = F.when(F.col("target") > 0, (first + last) / (F.lit(2.0) * F.col("target"))).otherwise(F.lit(0.0))
    position = F.lit(0.0)
    for place in range(len(weights)):
        position = F.when(F.col("place") == place, invert(middle, schedules[place % len(schedules)])).otherwise(position)
    return demand.select(
        F.col("_id").alias(id_col), F.col("_source").alias(source_col), "size", "source_size", "target",
        (F.floor(last) - F.floor(first)).cast("long").alias("taken"), position.alias("position"),
    )


def range_sort(df: DataFrame, position_col: str = "position", *ties: str) -> DataFrame:
    """Rows in order of position: each partition holds a range, the partitions follow each other."""
    return df.repartitionByRange(workers(df), position_col, *ties).sortWithinPartitions(position_col, *ties)


def copies(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", position_col: str = "position") -> DataFrame:
    """The mix as whole documents: each as many times as ``taken`` holds its size, the rest by a fair draw on the id.

    ``docs`` must have unique ids, one of which may be null. Documents drawn zero times go; a document taken twice stands twice. Repeats keep the
    words of a source near its target on average, without cutting texts. All columns of ``docs`` stay, whatever their names;
    ``position_col`` is added, or replaced where ``docs`` has it.
    """
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    count = (F.floor(times) + F.when(draw < times - F.floor(times), 1).otherwise(0)).cast("int")
    wanted = mixed.select(F.col(id_col).alias("id"), count.alias("times"), F.col("position").alias("at")).where("times > 0")
    kept = docs if position_col == id_col else docs.drop(position_col)
    # The columns of ``docs`` travel as one, so that no name of theirs can meet one of these.
    rows = kept.select(F.struct("*").alias("doc"), F.col(id_col).alias("own"))
    met = rows.join(wanted, F.col("own").eqNullSafe(F.col("id"))).select("doc", "at", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return met.select("doc.*", F.col("at").alias(position_col))
