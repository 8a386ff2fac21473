"""Session settings and materialisation in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Lets Spark remove the shuffle files of a query when it ends; otherwise they stay until the driver happens to collect its garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "tongueprint", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the jobs rely on. They replace what was submitted; those in ``conf`` replace them."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tongueprint-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as a parquet table in the shared folder and read it back.

    Unlike a cached frame it survives lost executors, cuts the lineage, and gives later joins
    true sizes and column pruning.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tongueprint/{label}-{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored = path
    return stored


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Queries that run in here leave no shuffle files behind: each plan ends with its query, so nothing reads them again."""
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` returned, once all that reads them has been written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._stored)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Split a scan with fewer partitions than cores; a scan that already fills them is left alone.

    Meant for frames straight from a file reader, where asking for the partition count runs nothing.
    Hash-partitioning by the row key also lets a later aggregation by that key skip its shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted, *keys)


def cluster(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle rows by key ahead of a step that multiplies them and groups them by the same key.

    Moving a text once is far cheaper than moving all of its n-grams; the grouping then needs no shuffle.
    The count is explicit, as adaptive coalescing would size partitions by the text alone.
    """
    spark = df.sparkSession
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(wanted, *keys)
