"""Joining a long table of features to a table of per-feature values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.session import materialize

BROADCAST_LIMIT = 256 * 1024 * 1024
SALTS = 32


def lookup_join(
    left: DataFrame, values: DataFrame, key: str, spread_by: str, how: str = "left", limit: int = BROADCAST_LIMIT
) -> DataFrame:
    """Join ``left`` to a materialised table with one row per ``key``.

    Its rows are counted, and it is broadcast only while rows x row size stays under ``limit``; past
    that the join is salted.
    """
    width = 48 + 16 * len(values.columns)
    if values.count() * width <= limit:
        return left.join(F.broadcast(values), key, how)
    return salted_join(left, values, key, spread_by, how)


def salted_join(left: DataFrame, values: DataFrame, key: str, spread_by: str, how: str = "left") -> DataFrame:
    """Shuffle both sides on the key and a salt taken from ``spread_by``.

    A feature that occurs in nearly every text spreads over many tasks, at the price of ``SALTS``
    copies of the value table.
    """
    salted = values.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(F.col(spread_by)), F.lit(SALTS)).cast("int")
    return left.withColumn("_salt", salt).join(salted, [key, "_salt"], how).drop("_salt")


def salted_by_count(left: DataFrame, values: DataFrame, key: str, spread_by: list[str], pieces: int = 4) -> DataFrame:
    """Inner join on ``key`` of a materialised ``left`` with one row per key in ``values``.

    A key with more rows than a task's ``pieces``-th share of ``left`` is dealt to as many salts as such shares it fills, and
    its value copied as often. There are at most ``pieces`` x tasks such keys, which bounds what is sent.
    """
    spark = left.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    share = max(1, -(-left.count() // (pieces * tasks)))
    hot = left.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > share)
    hot = materialize(hot.select(key, F.ceil(F.col("_n") / share).cast("int").alias("_salts")), "hot-keys")
    salts = F.coalesce("_salts", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), salts).cast("int")).drop("_salts")
    copied = values.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"]).drop("_salt")
