"""Helpers shared by the operators: tables, digests and stable document order."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words in the contracts of the queries.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def free_name(columns: Iterable[str], stem: str) -> str:
    """``stem``, after as many underscores as it takes to be none of ``columns``; Spark does not tell case apart."""
    taken = {c.lower() for c in columns}
    while stem.lower() in taken:
        stem = f"_{stem}"
    return stem


def sha(column: Column) -> Column:
    """Lower-case hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(column, 256)


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a batch function built once per task, so its tables and caches are made there and not shipped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                yield step(batch.slice(start, 2000))

    return df.mapInArrow(run, schema)


def workers(df: DataFrame) -> int:
    """Partitions for a shuffle of small rows: what the session asks for, at least one a core."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
