"""The language-code table and label normalisation."""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.functions.text import first_token, strip
from tongueprint.sources.extra_languages import EXTRA_LANGUAGES

# The undetermined label, and the marker some label files put before a code.
UND = "und"
LABEL_PREFIX = "__label__"

SCHEMA = "iso639_3 string, name string, iso639_1 string, bcp47 string"


@dataclass(frozen=True)
class CodeTable:
    """Rows ``(iso639_3, name, iso639_1 or None, bcp47)``, one per language.

    A few hundred rows, so it is always safe to broadcast. ``default`` derives them from the ICU
    data that ships with Spark plus the ISO 639-3 names ICU lacks; ``from_csv`` takes any table.
    """

    rows: tuple[tuple[str, str | None, str | None, str | None], ...]

    @classmethod
    def default(cls, spark: SparkSession) -> CodeTable:
        return cls(_icu_rows(spark))

    @classmethod
    def from_csv(cls, spark: SparkSession, path: str, max_rows: int = 20_000) -> CodeTable:
        """Read ``name, iso639_3, iso639_1, bcp47`` columns; others are ignored, empty cells are null.

        There are under 8,000 ISO 639-3 codes; a longer file is not a code table and is refused.
        """
        table = spark.read.csv(path, header=True)
        picked = table.select("iso639_3", "name", "iso639_1", "bcp47").limit(max_rows + 1).collect()
        if len(picked) > max_rows:
            raise ValueError(f"{path} has more than {max_rows} rows")
        return cls(tuple(tuple(row) for row in picked))

    @cached_property
    def exact(self) -> dict[str, str]:
        return {iso3: iso3 for iso3, *_ in self.rows}

    @cached_property
    def aliases(self) -> dict[str, str]:
        """Lower-cased spelling to code: two-letter codes, then names, then tags and the codes themselves.

        The order matters: ``ga`` is Irish although another language is named Ga.
        """
        index: dict[str, str] = {}
        for column in (2, 1, 3, 0):
            for row in self.rows:
                if row[column]:
                    index.setdefault(row[column].lower(), row[0])
        return index

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), SCHEMA).coalesce(1)

    def resolve(self, value: str | None) -> str:
        """ISO-639-3 code of one literal given by the caller; columns go through ``normalize``."""
        text = (value or "").strip().removeprefix(LABEL_PREFIX).partition("_")[0]
        lowered = text.lower()
        head = lowered.partition("-")[0]
        fallback = head if re.fullmatch("[a-z]{3}", head) else UND
        return self.exact.get(text) or self.aliases.get(lowered) or self.aliases.get(head) or fallback

    def resolve_all(self, values: Iterable[str]) -> list[str]:
        return sorted({self.resolve(v) for v in values})

    def normalize(self, df: DataFrame, in_col: str, out_col: str | None = None) -> DataFrame:
        """Replace a column of codes, tags or names by ISO-639-3 codes; unknown and null become ``und``.

        Three left joins with small broadcast tables, so one pass over ``df`` and no shuffle.
        """
        spark = df.sparkSession
        bare = F.regexp_replace(strip(F.col(in_col).cast("string")), f"^{LABEL_PREFIX}", "")
        bare = F.substring_index(bare, "_", 1)
        lowered = F.lower(F.col("_bare"))
        head = F.substring_index(lowered, "-", 1)

        def lookup(pairs: dict[str, str], step: str) -> DataFrame:
            table = spark.createDataFrame(list(pairs.items()), f"_key{step} string, _hit{step} string")
            return F.broadcast(table.coalesce(1))

        joined = (
            df.withColumn("_bare", bare)
            .join(lookup(self.exact, "1"), F.col("_bare") == F.col("_key1"), "left")
            .join(lookup(self.aliases, "2"), lowered == F.col("_key2"), "left")
            .join(lookup(self.aliases, "3"), head == F.col("_key3"), "left")
        )
        code = F.coalesce("_hit1", "_hit2", "_hit3", F.when(head.rlike("^[a-z]{3}$"), head), F.lit(UND))
        helpers = ["_bare", "_key1", "_hit1", "_key2", "_hit2", "_key3", "_hit3"]
        return joined.withColumn(out_col or in_col, code).drop(*helpers)

    def attributes(self, df: DataFrame, code_col: str = "lang") -> DataFrame:
        """Add ``name`` (else the code), ``iso639_1`` (or null) and ``bcp47`` (else the code)."""
        table = self.frame(df.sparkSession).select(
            F.col("iso639_3").alias("_code"), F.col("name").alias("_name"), "iso639_1", F.col("bcp47").alias("_tag")
        )
        return (
            df.join(F.broadcast(table), F.col(code_col) == F.col("_code"), "left")
            .withColumn("name", F.coalesce("_name", code_col))
            .withColumn("bcp47", F.coalesce("_tag", code_col))
            .drop("_code", "_name", "_tag")
        )

    def with_name(self, df: DataFrame, code_col: str = "lang") -> DataFrame:
        names = self.frame(df.sparkSession).select(F.col("iso639_3").alias("_code"), F.col("name").alias("_name"))
        return (
            df.join(F.broadcast(names), F.col(code_col) == F.col("_code"), "left")
            .withColumn("name", F.coalesce("_name", code_col))
            .drop("_code", "_name")
        )

    def normalize_first_known(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        """Normalise the whole text; where that fails, its first whitespace token."""
        whole = self.normalize(df, text_col, "_whole")
        both = self.normalize(whole.withColumn("_first", first_token(F.col(text_col))), "_first")
        known = F.when(F.col("_whole") != UND, F.col("_whole")).otherwise(F.col("_first"))
        return both.withColumn(out_col, known).drop("_whole", "_first")


def display_label(name: Column, code: Column, support: Column | None = None) -> Column:
    """``name (code, n=support)``; the code stands in for a null name, and ``n=`` needs a support."""
    head = F.concat(F.coalesce(name, code), F.lit(" ("), code)
    count = F.lit("") if support is None else F.coalesce(
        F.concat(F.lit(", n="), support.cast("bigint").cast("string")), F.lit("")
    )
    return F.concat(head, count, F.lit(")"))


_icu_cache: list[tuple[tuple[str, str | None, str | None, str | None], ...]] = []


def _icu_rows(spark: SparkSession) -> tuple[tuple[str, str | None, str | None, str | None], ...]:
    if _icu_cache:
        return _icu_cache[0]
    locale = spark._jvm.com.ibm.icu.util.ULocale
    rows: dict[str, tuple[str, str | None, str | None, str | None]] = {}
    for code in locale.getISOLanguages():
        entry = locale(code)
        iso3, name = entry.getISO3Language(), entry.getDisplayLanguage(locale.ENGLISH)
        if iso3 and name != code:
            rows.setdefault(iso3, (iso3, name, code if len(code) == 2 else None, code))
    for line in EXTRA_LANGUAGES.strip().splitlines():
        iso3, name = line.split(" ", 1)
        rows[iso3] = (iso3, name, None, iso3)
    _icu_cache.append(tuple(rows[iso3] for iso3 in sorted(rows)))
    return _icu_cache[0]
