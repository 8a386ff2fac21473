"""Sampling, splitting and holdout on one reproducible row order.

Every operator orders rows by ``shuffle_key(seed, salt, row_id)``, ties by ``row_id``. Exact sizes
come from a *rank cut*: the key of the k-th row of each group is found from histograms of key
prefixes, and rows are then kept by comparing keys. The data is read three times (twice only the
key columns; once more for each division of a cell that is too large to rank), the wide rows are never sorted, nor shuffled
while the groups are few, and no group lands in one task. The cuts are found at once and stored, so frames made from them do not find them again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tongueprint.functions.hashing import key_fraction, shuffle_key
from tongueprint.functions.text import has_text
from tongueprint.session import materialize
from tongueprint.sources.codes import CodeTable
from tongueprint.sources.corpus import LANG, TEXT

_PREFIX = 4  # hex digits: at most 65,536 histogram rows per group
_DIGITS = 32
# Rows of a cell up to which it is ranked; a larger one is divided by further digits of the key first.
CELL = 200_000


def rank_cuts(
    df: DataFrame, sizes: Sequence[Column | int], seed: int, salt: str, id_col: str, group: Sequence[str] = (), cell: int = CELL
) -> DataFrame:
    """One row per group with ``_cut0, _cut1, ...``: the sort key of the row at each of the given ranks, as a stored table.

    A size may use ``total``, the rows of the group. A rank beyond the group means its last row, and a
    rank below 1 gives null. Groups may be of any kind and number: their stored tables are sent to every task only
    while Spark finds the files small.

    Radix selection: a histogram of key prefixes finds the cell of each rank, cells of more than ``cell`` rows are divided
    by four more digits at a time, and at last the distinct keys of a cell are ranked by their counts, so rows of equal id
    are one key, however many they are.
    """
    spare = "_all" if not group else None
    keys = df.select(
        *group, *([F.lit(0).alias(spare)] if spare else []),
        shuffle_key(seed, salt, id_col).alias("_key"), F.col(id_col).alias("_id"),
    )
    by = list(group) or [spare]
    histogram = keys.groupBy(*by, _prefix(_PREFIX)).agg(F.count("*").alias("_rows"))
    counted = _with_bounds(histogram, by, ["_prefix"]).withColumn("total", F.sum("_rows").over(Window.partitionBy(*by)))
    ranks = F.array(*[
        F.struct(F.lit(i).alias("_cut"), F.least(_as_column(size).cast("bigint"), F.col("total")).alias("_nth"))
        for i, size in enumerate(sizes)
    ])
    cells = _stored_cells(counted.withColumn("_want", F.explode(ranks)).select(*by, "_prefix", "_rows", "_before", "_want.*"), by)
    digits = _PREFIX
    while digits < _DIGITS and (cells.agg(F.max("_rows")).first()[0] or 0) > cell:
        inside = _inside(keys, cells, by, digits)
        digits += _PREFIX
        histogram = inside.groupBy(*by, "_cut", "_nth", _prefix(digits)).agg(F.count("*").alias("_rows"))
        cells = _stored_cells(_with_bounds(histogram, [*by, "_cut"], ["_prefix"]), by)
    distinct = _inside(keys, cells, by, digits).groupBy(*by, "_cut", "_nth", "_key", "_id").agg(F.count("*").alias("_rows"))
    found = _holding(_with_bounds(distinct, [*by, "_cut"], ["_key", "_id"]))
    point = F.struct("_key", "_id")
    cuts = found.groupBy(*by).agg(
        *[F.max(F.when(F.col("_cut") == i, point)).alias(f"_cut{i}") for i in range(len(sizes))]
    )
    return materialize(cuts, "rank-cuts")


def _prefix(digits: int) -> Column:
    return F.substring("_key", 1, digits).alias("_prefix")


def _with_bounds(histogram: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """Add ``_before``: the rows of all smaller entries of the group."""
    upto = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return histogram.withColumn("_before", F.sum("_rows").over(upto) - F.col("_rows"))


def _holding(counted: DataFrame) -> DataFrame:
    """The entries in which the wanted rank lies."""
    return counted.where((F.col("_nth") > F.col("_before")) & (F.col("_nth") <= F.col("_before") + F.col("_rows")))


def _stored_cells(counted: DataFrame, by: list[str]) -> DataFrame:
    """``(by, _cut, _prefix, _rows, _nth)``: the cell of each rank, with its rows and the rank within it."""
    nth = (F.col("_nth") - F.col("_before")).alias("_nth")
    return materialize(_holding(counted).select(*by, "_cut", "_prefix", "_rows", nth), "rank-cells")


def _inside(keys: DataFrame, cells: DataFrame, by: list[str], digits: int) -> DataFrame:
    """The keys that lie in a cell, once for each rank in it. A null id has a null key, which is a cell of its own."""
    wanted = cells.select(*[F.col(c).alias(f"_of{i}") for i, c in enumerate(by)], F.col("_prefix").alias("_start"), "_cut", "_nth")
    same = F.col("_prefix").eqNullSafe(F.col("_start"))
    for i, name in enumerate(by):
        same = same & (F.col(name) == F.col(f"_of{i}"))
    return keys.select("*", _prefix(digits)).join(wanted, same).select(*by, "_key", "_id", "_cut", "_nth")


def rank_segments(
    df: DataFrame, sizes: Sequence[Column | int], seed: int, salt: str, id_col: str, group: Sequence[str] = ()
) -> DataFrame:
    """Add ``segment``: 0 for ranks up to ``sizes[0]``, 1 up to ``sizes[1]``, ..., then the remainder.

    Sizes are cumulative ranks within the group. Rows whose group is null are dropped.
    """
    cuts = rank_cuts(df, sizes, seed, salt, id_col, group)
    names = [f"_cut{i}" for i in range(len(sizes))]
    if group:
        ready = df.join(cuts, list(group), "left")
        for name in group:
            ready = ready.where(F.col(name).isNotNull())
        ready = ready.withColumn("_cuts", F.struct(*names))
    else:
        ready = df.withColumn("_cuts", cuts.select(F.struct(*names)).scalar())
    point = F.struct(shuffle_key(seed, salt, id_col).alias("_key"), F.col(id_col).alias("_id"))
    segment = F.lit(len(sizes))
    for i in range(len(sizes) - 1, -1, -1):
        segment = F.when(F.coalesce(point <= F.col(f"_cuts._cut{i}"), F.lit(False)), F.lit(i)).otherwise(segment)
    return ready.withColumn("segment", segment).drop("_cuts", *names)


def take_ranked(
    df: DataFrame, size: Column | int, seed: int, salt: str, id_col: str, group: Sequence[str] = ()
) -> DataFrame:
    """The first ``size`` rows (per group) in shuffle order."""
    return rank_segments(df, [size], seed, salt, id_col, group).where("segment = 0").drop("segment")


def filter_languages(df: DataFrame, languages: str | Sequence[str], codes: CodeTable) -> DataFrame:
    """Keep rows of the given languages, named in any form, as a list or comma-separated."""
    names = languages.split(",") if isinstance(languages, str) else languages
    return df.where(F.col(LANG).isin(codes.resolve_all(n.strip() for n in names)))


def sample_per_language(
    df: DataFrame, n: int, codes: CodeTable | None = None, languages: str | Sequence[str] | None = None,
    seed: int = 0, id_col: str = "row_id",
) -> DataFrame:
    """Up to ``n`` rows per language; ``n=-1`` keeps all rows."""
    if languages is not None:
        df = filter_languages(df, languages, codes)
    if n == -1:
        return df.where(F.col(LANG).isNotNull())
    return take_ranked(df, n, seed, "sample", id_col, [LANG])


def fewshot_pick(df: DataFrame, shot: int, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """``shot`` demonstration rows: the first of each language in shuffle order, then further rows.

    The candidates are one row per language (a rank cut) and the first ``shot`` rows overall (a top-k
    on each partition), so nothing is sorted as a whole.
    """
    firsts = take_ranked(df, 1, seed, "fewshot", id_col, [LANG]).withColumn("pick_round", F.lit(0))
    keyed = df.withColumn("pick_key", shuffle_key(seed, "fewshot", id_col))
    overall = keyed.orderBy("pick_key", id_col).limit(shot).withColumn("pick_round", F.lit(1))
    both = firsts.withColumn("pick_key", shuffle_key(seed, "fewshot", id_col)).unionByName(overall)
    # A language's first row may also be among the overall rows; it keeps its priority.
    once = both.groupBy(id_col).agg(F.min_by(F.struct(*both.columns), "pick_round").alias("_row")).select("_row.*")
    return once.orderBy("pick_round", "pick_key", id_col).limit(shot)


def hold_out(df: DataFrame, picked: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Rows not picked. Spark sends ``picked`` to every task only while its size allows."""
    return df.join(picked.select(id_col), id_col, "left_anti")


def split_exact(
    df: DataFrame, test_size: float = 0.2, seed: int = 0, id_col: str = "row_id"
) -> DataFrame:
    """Add ``part`` = test for ceil(test_size * rows) rows, else train."""
    size = F.ceil(F.lit(test_size) * F.col("total"))
    cut = rank_segments(df, [size], seed, "split", id_col)
    return cut.withColumn("part", F.when(F.col("segment") == 0, F.lit("test")).otherwise(F.lit("train"))).drop("segment")


def split_by_hash(
    df: DataFrame, test_size: float = 0.2, seed: int = 42, id_col: str = "row_id", split_key: str | None = None
) -> DataFrame:
    """One-pass split by key threshold (sizes approximate).

    ``split_key='sentence'`` sends all copies of a text to the same side, so none leaks into the test.
    """
    fraction = key_fraction(shuffle_key(seed, "split", split_key or id_col))
    return df.withColumn("part", F.when(fraction < test_size, F.lit("test")).otherwise(F.lit("train")))


def split_fraction(
    df: DataFrame, fraction: float = 0.15, seed: int = 42, id_col: str = "row_id", exact_by: Sequence[str] = ()
) -> DataFrame:
    """Keep a fraction of rows: a key threshold, or the exact rounded share of each ``exact_by`` group."""
    if exact_by:
        size = F.rint(F.lit(fraction) * F.col("total"))
        return take_ranked(df, size, seed, "fraction", id_col, exact_by)
    return df.where(key_fraction(shuffle_key(seed, "fraction", id_col)) < fraction)


def stratified_fraction(
    df: DataFrame, by: str, max_rows: int, seed: int = 0, id_col: str = "row_id"
) -> DataFrame:
    """The same fraction of every ``by`` group, chosen so that about ``max_rows`` rows stay."""
    total = df.count()
    fraction = min(1.0, max_rows / total) if total else 1.0
    return take_ranked(df, F.rint(F.lit(fraction) * F.col("total")), seed, "stratified", id_col, [by])


def take_uniform(df: DataFrame, k: int, seed: int = 0, id_col: str = "row_id") -> DataFrame:
    """A uniform sample of exactly ``min(k, rows)`` rows."""
    return take_ranked(df, k, seed, "uniform", id_col)


def drop_blank(df: DataFrame, text_col: str = TEXT) -> DataFrame:
    return df.where(has_text(F.col(text_col)))


def language_presence(df: DataFrame, language: str, codes: CodeTable) -> DataFrame:
    """Rows the corpus already has for a language; none means it is new."""
    code = codes.resolve(language)
    return df.agg(
        F.lit(code).alias("lang"), F.count_if(F.col(LANG) == code).alias("rows"),
        (F.count_if(F.col(LANG) == code) == 0).alias("is_new"),
    )


def top_k(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(k)


def _as_column(size: Column | int) -> Column:
    return size if isinstance(size, Column) else F.lit(size)
