"""Connected components of a table of links, by rounds of joins and groupings.

Each round lets every node point to the smallest node it knows of: first larger neighbours are moved to the smallest
neighbour of their node, then each node's smaller ones are moved to their own smallest. Links shrink to stars in a
number of rounds that grows with the logarithm of the longest chain. A round's links are written to the shared folder, so
lost executors cost one round and lineage stays short; only two sums over the links reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tongueprint.session import materialize, release, shuffles_freed


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node that has a link: the smallest node it can reach.

    Links have no direction; loops and repeats change nothing, links with a null end are ignored.
    """
    pairs = links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    stars = materialize(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    while (mark := digest(stars)) != seen:
        both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = attach(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = attach(large)
        rest = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, stars = stars, materialize(rest.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        release(last)
        seen = mark
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def digest(links: DataFrame) -> tuple:
    """Count and sum of hashes of the links: the same for a round that changed nothing."""
    with shuffles_freed(links.sparkSession):
        return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def attach(links: DataFrame) -> DataFrame:
    """Each link with ``m``, the smallest of its node and the node's neighbours.

    The minimum is grouped with a partial sum on the map side and joined back, so a node with very many links is not
    gathered in one task; adaptive execution splits its side of the join.
    """
    least = links.groupBy("u").agg(F.min("v").alias("_v")).select(F.col("u").alias("_u"), F.least("u", "_v").alias("m"))
    return links.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")
