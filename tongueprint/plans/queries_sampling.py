"""Queries over sampling, splitting and holdout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.operators import sampling
from tongueprint.plans.catalog import SQL_DOCS, codes_of, documents, labels_only, query, sql_fraction, sql_key, table
from tongueprint.plans.jobs import detector_data
from tongueprint.sources.corpus import LANG


def _sql_ranked(salt: str, partition: str = "", seed: int = 0, where: str = "TRUE") -> str:
    part = f"PARTITION BY {partition} " if partition else ""
    return f"""
{SQL_DOCS}, ranked AS (
  SELECT *, row_number() OVER ({part}ORDER BY {sql_key(seed, salt)}, row_id) AS rn,
         count(*) OVER ({part}) AS total
  FROM docs WHERE {where})
"""


@query("sample_per_lang", f"""
WITH {_sql_ranked('sample', 'lang')} SELECT row_id, sentence, lang FROM ranked WHERE rn <= 60
""")
def sample_per_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_language(documents(spark, sf_dir), 60)


@query("sample_some_langs", f"""
WITH {_sql_ranked('sample', 'lang', 11, "lang IN ('eng', 'spa')")} SELECT row_id, sentence, lang FROM ranked WHERE rn <= 25
""")
def sample_some_langs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_per_language(documents(spark, sf_dir), 25, codes_of(spark), ["English", "es"], seed=11)


_SQL_FEWSHOT = f"""
{_sql_ranked('fewshot', 'lang')}, picked AS (
  SELECT row_id, sentence, lang FROM ranked ORDER BY rn > 1, {sql_key(0, 'fewshot')}, row_id LIMIT 7)
"""


@query("fewshot_pick", f"WITH {_SQL_FEWSHOT} SELECT * FROM picked")
def fewshot_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.fewshot_pick(documents(spark, sf_dir), 7).select("row_id", "sentence", LANG)


@query("fewshot_remaining", f"""
WITH {_SQL_FEWSHOT} SELECT row_id, sentence, lang FROM docs WHERE row_id NOT IN (SELECT row_id FROM picked)
""")
def fewshot_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    return sampling.hold_out(rows, sampling.fewshot_pick(rows, 7))


@query("split_exact", f"""
WITH {_sql_ranked('split')}
SELECT row_id, sentence, lang, CASE WHEN rn <= ceil(0.2 * total) THEN 'test' ELSE 'train' END AS part FROM ranked
""")
def split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_exact(documents(spark, sf_dir))


@query("split_by_text", f"""
WITH {SQL_DOCS}
SELECT row_id, lang, CASE WHEN {sql_fraction(sql_key(42, 'split', 'sentence'))} < 0.2 THEN 'test' ELSE 'train' END AS part FROM docs
""")
def split_by_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_by_hash(documents(spark, sf_dir), split_key="sentence").select("row_id", LANG, "part")


@query("split_fraction", f"""
WITH {SQL_DOCS} SELECT row_id, sentence, lang FROM docs WHERE {sql_fraction(sql_key(42, 'fraction'))} < 0.15
""")
def split_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.split_fraction(documents(spark, sf_dir))


@query("split_fraction_exact", f"""
WITH ranked AS (
  SELECT doc_id AS row_id, source, row_number() OVER (PARTITION BY source ORDER BY {sql_key(42, 'fraction', 'doc_id')}, doc_id) AS rn,
         count(*) OVER (PARTITION BY source) AS total FROM documents)
SELECT row_id, source FROM ranked WHERE rn <= round_even(0.15 * total, 0)
""")
def split_fraction_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents", "doc_id", "source").withColumnRenamed("doc_id", "row_id")
    return sampling.split_fraction(rows, exact_by=["source"])


@query("cap_positives", f"""
WITH {_sql_ranked('uniform', where="lang = 'fra'")} SELECT row_id, sentence, lang FROM ranked WHERE rn <= 15
""")
def cap_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.take_uniform(documents(spark, sf_dir).where(F.col(LANG) == "fra"), 15)


@query("neg_sample", f"""
WITH {_sql_ranked('negative', where="lang <> 'fra'")}
SELECT row_id, lang, CASE WHEN rn <= 20 THEN 'test' ELSE 'train' END AS part FROM ranked WHERE rn <= 70
""")
def neg_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    others = labels_only(spark, sf_dir).where(F.col(LANG) != "fra")
    cut = sampling.rank_segments(others, [20, 70], 0, "negative", "row_id").where("segment < 2")
    return cut.select("row_id", LANG, F.when(F.col("segment") == 0, F.lit("test")).otherwise(F.lit("train")).alias("part"))


@query("stratified_frac", f"""
WITH {SQL_DOCS}, ranked AS (
  SELECT row_id, lang, lang = 'fra' AS is_target,
         row_number() OVER (PARTITION BY lang = 'fra' ORDER BY {sql_key(0, 'stratified')}, row_id) AS rn,
         count(*) OVER (PARTITION BY lang = 'fra') AS total, count(*) OVER () AS everything FROM docs)
SELECT row_id, lang, is_target FROM ranked WHERE rn <= round_even(least(1.0, 300.0 / everything) * total, 0)
""")
def stratified_frac(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labels_only(spark, sf_dir).withColumn("is_target", F.col(LANG) == "fra")
    return sampling.stratified_fraction(rows, "is_target", 300)


_SQL_DETECTOR = f"""
{SQL_DOCS}, pos AS (
  SELECT *, row_number() OVER (ORDER BY {sql_key(0, 'split')}, row_id) AS rn, count(*) OVER () AS total,
         ceil(0.2 * count(*) OVER ()) AS n_test FROM docs WHERE lang = 'fra'),
sizes AS (SELECT max(n_test) AS n_test, max(total - n_test) AS n_train FROM pos),
neg AS (
  SELECT *, row_number() OVER (ORDER BY {sql_key(0, 'negative')}, row_id) AS rn FROM docs WHERE lang <> 'fra'),
det_train AS (
  SELECT row_id, sentence, 'fra' AS label FROM pos WHERE rn > n_test
  UNION ALL SELECT row_id, sentence, 'other' FROM neg, sizes WHERE rn > n_test AND rn <= n_test + n_train),
det_test AS (
  SELECT row_id, sentence, lang, TRUE AS is_target FROM pos WHERE rn <= n_test
  UNION ALL SELECT row_id, sentence, lang, FALSE FROM neg, sizes WHERE rn <= n_test)
"""


def french_detector_data(spark: SparkSession, sf_dir: str):
    rows = documents(spark, sf_dir)
    return detector_data(rows.where(F.col(LANG) == "fra"), rows, "French", codes_of(spark))


@query("detector_train_rows", f"WITH {_SQL_DETECTOR} SELECT row_id, sentence, label FROM det_train")
def detector_train_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return french_detector_data(spark, sf_dir).train


@query("detector_test_rows", f"WITH {_SQL_DETECTOR} SELECT row_id, sentence, lang, is_target FROM det_test")
def detector_test_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return french_detector_data(spark, sf_dir).test


@query("class_balance", f"""
WITH {_SQL_DETECTOR}
SELECT 'train' AS part, label, count(*) AS rows FROM det_train GROUP BY label
UNION ALL
SELECT 'test', CASE WHEN is_target THEN 'fra' ELSE 'other' END, count(*) FROM det_test GROUP BY is_target
""")
def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tongueprint.operators.metrics import class_balance as balance

    data = french_detector_data(spark, sf_dir)
    test = data.test.withColumn("label", F.when(F.col("is_target"), F.lit(data.target)).otherwise(F.lit("other")))
    both = data.train.select("label", F.lit("train").alias("part")).unionByName(test.select("label", F.lit("test").alias("part")))
    return balance(both, "label", ["part"])
