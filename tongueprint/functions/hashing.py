"""Reproducible row order and feature buckets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed: int, salt: str, id_col: str) -> Column:
    """Pseudo-random sort key of a row: the same at any parallelism, unlike ``rand`` or ``sample``."""
    return F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col(id_col).cast("string")))


def key_fraction(key: Column) -> Column:
    """The sort key as a number in [0, 1)."""
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))


@dataclass(frozen=True)
class GramSpec:
    """Which grams are counted and how they become features.

    ``buckets=None`` keeps the grams themselves (an open vocabulary). ``portable`` buckets by md5,
    which other engines can repeat; the default hash is the JVM-side one and much cheaper.
    """

    lo: int = 2
    hi: int = 4
    buckets: int | None = 2**18
    portable: bool = False

    def feature(self, gram: Column) -> Column:
        if self.buckets is None:
            return gram
        if self.portable:
            digits = F.conv(F.substring(F.md5(gram), 1, 8), 16, 10).cast("bigint")
        else:
            digits = F.xxhash64(gram)
        return F.when(gram.isNotNull(), F.pmod(digits, F.lit(self.buckets).cast("bigint")))
