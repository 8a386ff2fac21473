"""Saved evaluation runs: one summary row, per-language scores and predictions per run.

Layout below a root: ``predictions/run_id=<id>/``, ``log/<id>/`` and ``runs/run_id=<id>/``, written in this order. Each run owns
its folders, so a repeated save replaces exactly that run, and reading all runs is one partitioned scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.operators import metrics
from tongueprint.session import materialize
from tongueprint.sources.codes import CodeTable
from tongueprint.sources.corpus import LANG

# Fixed value: run ids end in this UTC time format.
TIMESTAMP_FORMAT = "%Y%m%d_T%H%M%S"

PER_LANGUAGE = (
    "array<struct<lang:string,name:string,support:bigint,recall:double,precision:double,f1:double>>"
)
RUN_SCHEMA = (
    "model string, dataset string, timestamp string, experiment string, accuracy double, macro_f1 double, "
    f"n bigint, n_languages bigint, per_language {PER_LANGUAGE}, run_id string"
)
JSON_SCHEMA = (
    "model string, dataset string, timestamp string, accuracy double, macro_f1 double, n bigint, "
    f"n_languages bigint, per_language {PER_LANGUAGE}"
)

LOG_SCHEMA = (
    "run_id string, model string, dataset string, timestamp string, accuracy double, macro_f1 double, "
    "n bigint, n_languages bigint"
)
LOG_COLUMNS = [part.split()[0] for part in LOG_SCHEMA.split(", ")]


def make_run_id(model: str, dataset: str, timestamp: str) -> str:
    return f"{model}_{dataset.replace('/', '_')}_{timestamp}"


def runs_table(
    preds: DataFrame, codes: CodeTable, dataset: str, timestamp: str, experiment: str = "", by: str = "model"
) -> DataFrame:
    """One run row per value of ``by`` in a table of predictions, scored in one pass over it."""
    scores = metrics.label_scores(metrics.pair_counts(preds, [by]), [by]).where("support > 0")
    named = codes.with_name(scores.withColumnRenamed("label", LANG))
    ordered = F.array_sort(F.collect_list(F.struct(LANG, "name", "support", "recall", "precision", "f1")))
    runs = named.groupBy(F.col(by).alias("model")).agg(
        metrics.ratio(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"),
        F.sum("support").alias("n"), F.count("*").alias("n_languages"), ordered.alias("per_language"),
    )
    run_id = F.concat_ws("_", "model", F.lit(dataset.replace("/", "_")), F.lit(timestamp))
    return runs.select(
        "model", F.lit(dataset).alias("dataset"), F.lit(timestamp).alias("timestamp"), F.lit(experiment).alias("experiment"),
        "accuracy", "macro_f1", "n", "n_languages", "per_language", run_id.alias("run_id"),
    )


def save_run(
    root: str, preds: DataFrame, codes: CodeTable, model: str, dataset: str, experiment: str = "",
    timestamp: str | None = None, fmt: str = "parquet",
) -> str:
    """Write predictions, log line and the scored run; returns the run id.

    Predictions are written first, with all their columns, and scored from the written table, so the model runs once. The run row comes last
    and publishes the rest: readers look only at runs that have one, so a run that broke off is not seen.
    """
    spark = preds.sparkSession
    timestamp = timestamp or datetime.now(UTC).strftime(TIMESTAMP_FORMAT)
    run_id = make_run_id(model, dataset, timestamp)
    path = f"{root}/predictions/run_id={run_id}"
    preds.write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
    reader = spark.read.schema(preds.schema)
    written = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    row = materialize(runs_table(written.withColumn("model", F.lit(model)), codes, dataset, timestamp, experiment), "run")
    row.select(*LOG_COLUMNS).coalesce(1).write.mode("overwrite").json(f"{root}/log/{run_id}")
    row.drop("run_id").coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/run_id={run_id}")
    return run_id


def read_predictions(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """The predictions of a published run (saved as parquet), with every column they were saved with."""
    load_run(read_runs(spark, root), run_id).first()
    return spark.read.parquet(f"{root}/predictions/run_id={run_id}")


def published_log(spark: SparkSession, root: str) -> DataFrame:
    """The log lines of all published runs."""
    lines = spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", True).json(f"{root}/log")
    return lines.join(read_runs(spark, root).select("run_id").distinct(), "run_id", "left_semi").select(*LOG_COLUMNS)


def save_runs(root: str, runs: DataFrame) -> None:
    """Write many run rows at once, each replacing its own folder only."""
    (
        runs.repartition("run_id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("run_id").parquet(f"{root}/runs")
    )


def export_run_json(runs: DataFrame, root: str, run_id: str) -> None:
    """The run as a JSON record below ``root/run_id/metrics.json``, readable by ``read_json_runs``."""
    one = runs.where(F.col("run_id") == run_id).drop("run_id", "experiment")
    one.coalesce(1).write.mode("overwrite").json(f"{root}/{run_id}/metrics.json")


def append_run_log(runs: DataFrame, path: str) -> None:
    """Summary lines, one JSON object per run."""
    runs.select(*LOG_COLUMNS).coalesce(1).write.mode("append").json(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).json(path)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    return with_defaults(spark.read.schema(RUN_SCHEMA).parquet(f"{root}/runs"))


def read_json_runs(spark: SparkSession, root: str) -> DataFrame:
    """Runs saved as ``root/<run_id>/metrics.json``, a file or a folder of part files."""
    files = (
        spark.read.schema(JSON_SCHEMA).option("multiLine", True).option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json").json(root)
    )
    run_id = F.regexp_extract(F.input_file_name(), r"/([^/]+)/metrics\.json(?:/[^/]*)?$", 1)
    named = files.withColumn("run_id", run_id).where(F.col("run_id") != "")
    return with_defaults(named.withColumn("experiment", F.lit("")))


def with_defaults(runs: DataFrame) -> DataFrame:
    """What an incomplete run record stands for."""
    nan = F.lit(float("nan"))
    langs = F.array_distinct(F.col("per_language.lang"))
    return runs.withColumns({
        "model": F.coalesce("model", F.substring_index("run_id", "_", 1)),
        "dataset": F.coalesce("dataset", F.lit("")),
        "timestamp": F.coalesce("timestamp", F.lit("")),
        "accuracy": F.coalesce("accuracy", nan),
        "macro_f1": F.coalesce("macro_f1", nan),
        "n": F.coalesce("n", F.size("per_language").cast("bigint")),
        "n_languages": F.coalesce("n_languages", F.size(langs).cast("bigint")),
    })


def discover_runs(runs: DataFrame, by: str = "name") -> DataFrame:
    """Run ids in descending order of the id itself, or of the run's time."""
    if by not in ("name", "timestamp"):
        raise ValueError("by must be 'name' or 'timestamp'")
    order = [F.desc("run_id")] if by == "name" else [F.desc("timestamp"), F.desc("run_id")]
    return runs.select("run_id", "timestamp").distinct().orderBy(*order).select("run_id")


def load_runs(runs: DataFrame, run_ids: Sequence[str] | None = None, dataset: str | None = None) -> DataFrame:
    """Chosen runs, best macro-F1 first (no score last). An id that does not exist raises."""
    if run_ids is not None:
        runs = runs.where(F.col("run_id").isin(list(run_ids)))
        found = {r[0] for r in runs.select("run_id").distinct().collect()}
        missing = sorted(set(run_ids) - found)
        if missing:
            raise ValueError(f"no saved run(s) {missing}")
    if dataset is not None:
        runs = runs.where(F.col("dataset") == dataset)
    score = F.nanvl(F.coalesce("macro_f1", F.lit(-1.0)), F.lit(-1.0))
    return runs.orderBy(score.desc(), F.col("run_id").desc())


def load_run(runs: DataFrame, run_id: str) -> DataFrame:
    return load_runs(runs, [run_id])


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A table as files, as many as it has partitions."""
    df.write.mode("overwrite").format(fmt).options(**({"header": True} if fmt == "csv" else {})).save(path)
