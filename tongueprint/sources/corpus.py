"""Readers that bring any table or folder of text to ``(..., sentence, lang)`` with ISO-639-3 labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.functions.text import LINE_BREAK, has_text
from tongueprint.sources.codes import CodeTable

# Column names shared by every corpus.
TEXT = "sentence"
LANG = "lang"


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing column(s) {missing}; found {df.columns}")
    return df


def rename_strict(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename columns, refusing a target name that another column already carries."""
    require_columns(df, list(mapping))
    moved = {old: new for old, new in mapping.items() if old != new}
    clash = [new for new in moved.values() if new in df.columns and new not in moved]
    if clash:
        raise ValueError(f"column(s) {clash} exist beside the ones renamed to them; drop or rename them first")
    return df.withColumnsRenamed(moved)


def labelled_corpus(
    df: DataFrame, codes: CodeTable, lang_col: str = "tag", text_col: str = TEXT
) -> DataFrame:
    """Any labelled frame as a corpus: two columns renamed, the label normalised, the rest kept."""
    return codes.normalize(rename_strict(df, {lang_col: LANG, text_col: TEXT}), LANG)


def constant_corpus(df: DataFrame, codes: CodeTable, language: str, text_col: str = TEXT) -> DataFrame:
    """An unlabelled frame whose rows all share one language."""
    return rename_strict(df, {text_col: TEXT}).withColumn(LANG, F.lit(codes.resolve(language)))


def place_id(fmt: str) -> Column:
    """Id of a row by its file and place, for a frame straight from a reader: nothing is hashed but the path, nothing moves.

    In Parquet the place is the number of the row in its file, so ids are the same at every read. Other formats only know
    where a block begins; there the place is the block and the row's number in its task, so ids are the same for the
    same files, split settings and cores, also when a lost task is run again.
    """
    if fmt == "parquet":
        place = [F.col("_metadata.row_index").cast("string")]
    else:
        place = [F.col("_metadata.file_block_start").cast("string"), F.monotonically_increasing_id().cast("string")]
    return F.concat_ws(":", F.md5("_metadata.file_path"), *place)


def read_table(
    spark: SparkSession, path: str | list[str], fmt: str = "parquet", schema: str | None = None, id_col: str | None = None, **options
) -> DataFrame:
    """One distributed read of parquet, json, orc or delimited files; with ``id_col`` each row gets its ``place_id``.

    Delimited files keep the text ``nan`` as it is: it is the code of Min Nan Chinese, not a null.
    """
    if fmt == "tsv":
        fmt, options = "csv", {"sep": "\t", "quote": "", **options}
    if fmt == "csv":
        options = {"header": True, **options}
    reader = spark.read.format(fmt).options(**options)
    df = (reader.schema(schema) if schema else reader).load(path)
    if id_col is None:
        return df
    if id_col.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the files have a column {id_col} already")
    return df.select(place_id(fmt).alias(id_col), "*")


def read_benchmark(spark: SparkSession, path: str, codes: CodeTable, fmt: str = "parquet", **options) -> DataFrame:
    """Benchmark layout ``text, tag, line_id``."""
    return labelled_corpus(read_table(spark, path, fmt, **options), codes, "tag", "text")


def read_training(
    spark: SparkSession, path: str, codes: CodeTable, split: str | None = None, fmt: str = "parquet", **options
) -> DataFrame:
    """Training layout ``sentence, lang, split``; a split filter reaches the scan or prunes partitions."""
    df = read_table(spark, path, fmt, **options)
    if split is not None:
        df = df.where(F.col("split") == split)
    return labelled_corpus(df, codes, LANG, TEXT)


def read_corpus(
    spark: SparkSession, path: str, codes: CodeTable, lang_col: str = "tag", text_col: str = TEXT,
    fmt: str = "parquet", **options,
) -> DataFrame:
    """Bring-your-own table with a text and a label column."""
    return labelled_corpus(read_table(spark, path, fmt, **options), codes, lang_col, text_col)


def read_single_language(
    spark: SparkSession, path: str, codes: CodeTable, language: str, text_col: str = TEXT,
    fmt: str = "parquet", **options,
) -> DataFrame:
    return constant_corpus(read_table(spark, path, fmt, **options), codes, language, text_col)


def read_lines(
    spark: SparkSession, path: str | list[str], codes: CodeTable, language: str,
    drop_blank: bool = True, glob: str = "*.txt", id_col: str | None = None,
) -> DataFrame:
    """Every line of every text file below ``path`` (globs allowed), labelled with one language.

    Lines keep their own spaces. ``drop_blank=False`` keeps empty lines as rows. With ``id_col`` each line gets an id
    by its file and place (``place_id``).
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(path)
    own = [place_id("text").alias("_place")] if id_col else []
    raw = files.select(F.col("_metadata.file_path").alias("file"), *own, F.posexplode(F.split("value", LINE_BREAK)).alias("_line", TEXT))
    number = [F.concat_ws(":", "_place", F.col("_line").cast("string")).alias(id_col)] if id_col else []
    raw = raw.select(*number, "file", TEXT)
    if drop_blank:
        raw = raw.where(has_text(F.col(TEXT)))
    return raw.withColumn(LANG, F.lit(codes.resolve(language)))


def number_copies(df: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Give rows without a key a stable ``row_id``: content hash plus the number of the copy.

    Equal rows are interchangeable, so they are counted (collapsing hot copies before the shuffle)
    and unfolded again. The unfolding goes in chunks, so one line repeated billions of times is
    spread over many tasks too.
    """
    columns = df.columns
    content = F.sha2(F.to_json(F.struct(*columns)), 256)
    folded = df.groupBy(*columns).agg(F.count("*").alias("_copies"))
    last = F.floor((F.col("_copies") - 1) / F.lit(chunk))
    chunks = folded.select(
        *columns, "_copies", content.alias("_content"), F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("_chunk")
    ).repartition("_content", "_chunk")
    first = F.col("_chunk") * F.lit(chunk)
    end = F.least(first + F.lit(chunk), F.col("_copies")) - 1
    unfolded = chunks.select("_content", *columns, F.explode(F.sequence(first, end)).alias("_copy"))
    return unfolded.select(F.concat_ws("-", "_content", F.col("_copy").cast("string")).alias("row_id"), *columns)


def write_corpus(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Corpus on disk, one folder per split where the corpus has splits."""
    writer = df.write.mode(mode)
    (writer.partitionBy("split") if "split" in df.columns else writer).parquet(path)


def read_histogram(spark: SparkSession, path: str) -> DataFrame:
    """Header row, then ``language, rows``."""
    return spark.read.csv(path, header=True, schema="lang string, sentence bigint")


def custom_corpus(loader: Callable[[SparkSession], DataFrame], spark: SparkSession, codes: CodeTable) -> DataFrame:
    """A caller's own loader: must give ``sentence`` and ``lang``; the label is normalised here."""
    return codes.normalize(require_columns(loader(spark), [TEXT, LANG]), LANG)
