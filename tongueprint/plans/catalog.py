"""Registry of runnable queries: each Spark plan next to the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.functions.hashing import key_fraction, shuffle_key
from tongueprint.functions.text import WHITESPACE
from tongueprint.session import spread
from tongueprint.sources.codes import CodeTable
from tongueprint.sources.corpus import LANG, TEXT, constant_corpus, labelled_corpus

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its statement over the same tables, if SQL can say it."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


def codes_of(spark: SparkSession) -> CodeTable:
    return CodeTable.default(spark)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, sentence, lang)`` of the documents table."""
    raw = table(spark, sf_dir, "documents", "doc_id", "text", "lang").withColumnRenamed("doc_id", "row_id")
    return labelled_corpus(spread(raw, "row_id"), codes_of(spark), LANG, "text")


def labels_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows without the texts, for reports that never look at them."""
    raw = table(spark, sf_dir, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "row_id")
    return codes_of(spark).normalize(raw, LANG)


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(row_id, sentence, lang)`` of the pages: visible text, language as the page declares it."""
    raw = spread(table(spark, sf_dir, "pages", "page_id", "html").withColumnRenamed("page_id", "row_id"), "row_id")
    bare = F.regexp_replace("html", PAGE_CODE, " ")
    parts = raw.select(
        "row_id", F.regexp_replace(bare, PAGE_TAG, " ").alias(TEXT), F.regexp_extract("html", PAGE_LANG, 1).alias(LANG)
    )
    return codes_of(spark).normalize(parts, LANG)


def conversation_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    keyed = raw.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("row_id"), "text")
    return constant_corpus(keyed, codes_of(spark), "und", "text")


def noisy_label(lang: Column, model: str, keep: float, id_col: str = "row_id") -> Column:
    """A label that is right for a share of rows and otherwise drawn from a list, by row hash.

    It stands for a predictor of known quality, so error reports have errors to show.
    """
    key = shuffle_key(7, model, id_col)
    drawn = F.element_at(
        F.array(*[F.lit(x) for x in NOISE_LABELS]), (F.conv(F.substring(key, 9, 4), 16, 10).cast("int") % len(NOISE_LABELS)) + 1
    )
    return F.when(key_fraction(key) < keep, lang).otherwise(drawn)


def noisy_predictions(spark: SparkSession, sf_dir: str, model: str = "noisy", keep: float = 0.7) -> DataFrame:
    return labels_only(spark, sf_dir).withColumn("pred", noisy_label(F.col(LANG), model, keep))


NOISE_LABELS = ["deu", "eng", "fra", "spa", "ita", "und"]
NOISE_MODELS = {"alpha": 0.9, "beta": 0.7, "gamma": 0.5}
PAGE_LANG = r'<html[^>]*lang="([^"]*)"'
PAGE_CODE = r"(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
PAGE_TAG = r"<[^>]*>"

# SQL fragments shared by the statements. The code rows are those of the languages in the tables.
SQL_CODES = """
codes(iso639_3, name, iso639_1, bcp47) AS (VALUES
  ('deu', 'German', 'de', 'de'), ('eng', 'English', 'en', 'en'), ('fra', 'French', 'fr', 'fr'),
  ('ita', 'Italian', 'it', 'it'), ('nor', 'Norwegian', 'no', 'no'), ('spa', 'Spanish', 'es', 'es'), ('kab', 'Kabyle', NULL, 'kab'))
"""
SQL_DOCS = """
docs AS (
  SELECT doc_id AS row_id, text AS sentence, c.iso639_3 AS lang
  FROM documents d JOIN (VALUES ('deu', 'de'), ('eng', 'en'), ('fra', 'fr'), ('spa', 'es')) c(iso639_3, iso1) ON d.lang = c.iso1)
"""
SQL_PAGES = rf"""
page_docs AS (
  SELECT page_id AS row_id,
         regexp_replace(regexp_replace(html, '{PAGE_CODE}', ' ', 'g'), '{PAGE_TAG}', ' ', 'g') AS sentence,
         c.iso639_3 AS lang
  FROM pages p JOIN (VALUES ('deu', 'de'), ('eng', 'en'), ('fra', 'fr'), ('spa', 'es')) c(iso639_3, iso1)
    ON regexp_extract(p.html, '{PAGE_LANG}', 1) = c.iso1)
"""


def sql_key(seed: int, salt: str, id_expr: str = "row_id") -> str:
    return f"md5('{seed}:{salt}:' || {id_expr})"


def sql_hex(expr: str, start: int, digits: int) -> str:
    return f"CAST('0x' || substr({expr}, {start}, {digits}) AS BIGINT)"


def sql_fraction(key: str) -> str:
    return f"({sql_hex(key, 1, 8)} / 4294967296.0)"


def sql_noise(model: str, keep: float) -> str:
    key = sql_key(7, model)
    labels = ", ".join(f"'{x}'" for x in NOISE_LABELS)
    return (
        f"CASE WHEN {sql_fraction(key)} < {keep} THEN lang "
        f"ELSE list_extract([{labels}], CAST({sql_hex(key, 9, 4)} % {len(NOISE_LABELS)} + 1 AS INTEGER)) END"
    )


SQL_NOISY = f"{SQL_DOCS}, preds AS (SELECT row_id, lang, {sql_noise('noisy', 0.7)} AS pred FROM docs)"

SQL_LABEL_SCORES = """
scores AS (
  SELECT label, support, predicted, hits,
         CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
         CASE WHEN predicted > 0 THEN hits / predicted ELSE 0.0 END AS precision,
         2.0 * hits / (support + predicted) AS f1
  FROM (
    SELECT label, CAST(sum(support) AS DOUBLE) AS support, CAST(sum(predicted) AS DOUBLE) AS predicted,
           CAST(sum(hits) AS DOUBLE) AS hits
    FROM (
      SELECT lang AS label, 1 AS support, 0 AS predicted, CASE WHEN lang = pred THEN 1 ELSE 0 END AS hits FROM preds
      UNION ALL
      SELECT pred, 0, 1, 0 FROM preds)
    GROUP BY label))
"""


def sql_grams(source: str, columns: str, lo: int, hi: int, out: str = "grams") -> str:
    """CTEs giving one row per n-gram of ``source.sentence`` with the given columns."""
    sizes = ", ".join(f"({n})" for n in range(lo, hi + 1))
    return rf"""
{out}_words AS (
  SELECT {columns}, ' ' || w || ' ' AS p FROM (
    SELECT {columns}, unnest(regexp_split_to_array(lower(coalesce(sentence, '')), '{WHITESPACE}')) AS w FROM {source})
  WHERE w <> ''),
{out} AS (
  SELECT {columns}, unnest(list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n))) AS gram
  FROM {out}_words, (VALUES {sizes}) sizes(n) WHERE length(p) >= n)
"""


def sql_bucket(gram: str, buckets: int = 2**18) -> str:
    return f"{sql_hex(f'md5({gram})', 1, 8)} % {buckets}"


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def rounded_doubles(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """What ``rounded`` gives, for very many doubles: ``F.round`` makes a decimal of each, here only of those close to a tie."""
    scale = 10.0**digits

    def short(c: str) -> Column:
        scaled = F.col(c) * scale
        whole = F.floor(scaled + 0.5)
        clear = (F.abs(scaled) < 2.0**50) & (F.abs(whole - scaled) < 0.499999)
        return F.when(clear, whole / scale).otherwise(F.round(c, digits))

    return df.withColumns({c: short(c) for c in columns})
