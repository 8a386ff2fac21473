"""Queries over codes, corpora, prompts and label distributions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.functions.hashing import key_fraction, shuffle_key
from tongueprint.functions.text import LINE_BREAK, NOT_WHITESPACE, WHITESPACE_CHARS, explode_lines, one_line
from tongueprint.operators import distribution, metrics, prompts, sampling
from tongueprint.plans.catalog import (
    SQL_CODES, SQL_DOCS, SQL_NOISY, SQL_PAGES, codes_of, sql_fraction, conversation_turns, documents, labels_only, noisy_predictions, query, sql_hex,
    sql_key, table, web_pages,
)
from tongueprint.session import shared_dir
from tongueprint.sources.codes import display_label
from tongueprint.sources.corpus import (
    LANG, TEXT, constant_corpus, custom_corpus, number_copies, read_histogram, read_lines, read_single_language, read_table, read_training, write_corpus,
)

_FORMS = 12


def _form(salt: str) -> Column:
    """Which spelling of its language a row carries, by row hash."""
    return F.conv(F.substring(shuffle_key(3, salt, "row_id"), 1, 4), 16, 10).cast("int") % _FORMS


def _spelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its label written in one of many spellings."""
    raw = table(spark, sf_dir, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "row_id")
    known = codes_of(spark).attributes(codes_of(spark).normalize(raw, LANG, "gold"), "gold")
    two, three, name, form = F.col(LANG), F.col("gold"), F.col("name"), F.col("_form")
    spellings = [
        two, three, F.upper(two), F.concat(F.lit("__label__"), three, F.lit("_Latn")), F.concat(three, F.lit("_Latn")), name,
        F.lower(name), F.concat(two, F.lit("-AT")), F.concat(F.lit("  "), two, F.lit(" ")), F.upper(three), F.lit("qqqq-not-a-language"),
    ]
    tag = F.when(form == 0, spellings[0])
    for i, spelling in enumerate(spellings[1:], 1):
        tag = tag.when(form == i, spelling)
    return known.withColumn("_form", _form("tag")).select("row_id", tag.alias("tag"))


_SQL_SPELLED = f"""
{SQL_CODES}, spelled AS (
  SELECT doc_id AS row_id,
    CASE {sql_hex(sql_key(3, 'tag', 'doc_id'), 1, 4)} % {_FORMS}
      WHEN 0 THEN lang WHEN 1 THEN c.iso639_3 WHEN 2 THEN upper(lang) WHEN 3 THEN '__label__' || c.iso639_3 || '_Latn'
      WHEN 4 THEN c.iso639_3 || '_Latn' WHEN 5 THEN c.name WHEN 6 THEN lower(c.name) WHEN 7 THEN lang || '-AT'
      WHEN 8 THEN '  ' || lang || ' ' WHEN 9 THEN upper(c.iso639_3) WHEN 10 THEN 'qqqq-not-a-language' END AS tag
  FROM documents JOIN codes c ON lang = c.iso639_1)
"""


def _sql_normalize(source: str, column: str, out: str, name: str) -> str:
    """CTE ``name``: ``source`` with ``out``, the code of ``column``, in the order of the rules."""
    bare = rf"split_part(regexp_replace(regexp_replace({column}, '^[{WHITESPACE_CHARS}]+|[{WHITESPACE_CHARS}]+\z', '', 'g'), '^__label__', ''), '_', 1)"
    return f"""
{name} AS (
  SELECT s.* EXCLUDE (bare), coalesce(
      (SELECT max(iso639_3) FROM codes WHERE iso639_3 = s.bare),
      (SELECT max(iso639_3) FROM codes WHERE lower(s.bare) IN (iso639_1, bcp47, lower(name), iso639_3)),
      (SELECT max(iso639_3) FROM codes WHERE split_part(lower(s.bare), '-', 1) IN (iso639_1, bcp47, lower(name), iso639_3)),
      CASE WHEN regexp_matches(split_part(lower(s.bare), '-', 1), '^[a-z]{{3}}$') THEN split_part(lower(s.bare), '-', 1) END,
      'und') AS {out}
  FROM (SELECT *, {bare} AS bare FROM {source}) s)
"""


@query("normalize_lang", f"""
WITH {_SQL_SPELLED}, {_sql_normalize('spelled', 'tag', 'lang', 'normal')}
SELECT row_id, tag, lang FROM normal
""")
def normalize_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes_of(spark).normalize(_spelled(spark, sf_dir), "tag", LANG)


@query("lang_attributes", f"""
WITH {_SQL_SPELLED}, {_sql_normalize('spelled', 'tag', 'lang', 'normal')}
SELECT n.lang, coalesce(c.name, n.lang) AS name, c.iso639_1, coalesce(c.bcp47, n.lang) AS bcp47, count(*) AS rows
FROM normal n LEFT JOIN codes c ON n.lang = c.iso639_3 GROUP BY ALL
""")
def lang_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = codes_of(spark)
    counts = codes.normalize(_spelled(spark, sf_dir), "tag", LANG).groupBy(LANG).agg(F.count("*").alias("rows"))
    return codes.attributes(counts).select(LANG, "name", "iso639_1", "bcp47", "rows")


@query("benchmark_layout", r"""
SELECT item_id AS line_id, text AS sentence, 'eng' AS lang FROM benchmark
""")
def benchmark_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tongueprint.sources.corpus import labelled_corpus

    raw = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line_id"), "text", F.lit("English").alias("tag"))
    return labelled_corpus(raw, codes_of(spark), "tag", "text")


@query("line_corpus", rf"""
SELECT row_id, line_no, sentence, 'fra' AS lang FROM (
  SELECT doc_id AS row_id, unnest(lines) AS sentence, CAST(unnest(range(0, len(lines))) AS INTEGER) AS line_no
  FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAK}') AS lines FROM documents))
WHERE regexp_matches(sentence, '{NOT_WHITESPACE}')
""")
def line_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "row_id")
    lines = sampling.drop_blank(explode_lines(raw, "text", TEXT, ["row_id"]))
    return constant_corpus(lines, codes_of(spark), "French")


@query("single_language", """
SELECT conv_id, turn, role, text AS sentence, 'spa' AS lang FROM conversations
""")
def single_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return constant_corpus(table(spark, sf_dir, "conversations"), codes_of(spark), "es", "text")


@query("one_line_text", rf"""
SELECT doc_id AS row_id,
       regexp_replace(replace(text, chr(10), ' '), '^[{WHITESPACE_CHARS}]+|[{WHITESPACE_CHARS}]+\z', '', 'g') AS sentence
FROM documents
""")
def one_line_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), one_line(F.col("text")).alias(TEXT))


@query("lang_filter", f"""
WITH {SQL_DOCS} SELECT row_id, sentence, lang FROM docs WHERE lang IN ('fra', 'deu')
""")
def lang_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.filter_languages(documents(spark, sf_dir), "French, de", codes_of(spark))


@query("display_label", f"""
WITH {SQL_CODES}, {SQL_DOCS}
SELECT lang, c.name || ' (' || lang || ', n=' || count(*) || ')' AS label, c.name || ' (' || lang || ')' AS short_label
FROM docs JOIN codes c ON lang = c.iso639_3 GROUP BY lang, c.name
""")
def labels_for_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = codes_of(spark).with_name(metrics.gold_counts(labels_only(spark, sf_dir)))
    name, code = F.col("name"), F.col(LANG)
    return counts.select(LANG, display_label(name, code, F.col("support")).alias("label"), display_label(name, code).alias("short_label"))


@query("language_presence", f"""
WITH {SQL_DOCS}
SELECT 'lad' AS lang, count(*) FILTER (lang = 'lad') AS rows, count(*) FILTER (lang = 'lad') = 0 AS is_new FROM docs
""")
def language_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.language_presence(labels_only(spark, sf_dir), "lad", codes_of(spark))


@query("sample_report", f"""
WITH {SQL_DOCS} SELECT count(*) AS rows, count(DISTINCT lang) AS languages FROM docs
""")
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.sample_report(labels_only(spark, sf_dir))


_SQL_DEMOS = f"""
{SQL_DOCS}, demo_keys AS (
  SELECT *, {sql_key(0, 'fewshot')} AS h FROM docs),
demo_ranks AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, row_id) AS rn FROM demo_keys),
demos AS (
  SELECT * FROM demo_ranks ORDER BY rn > 1, h, row_id LIMIT 3)
"""


@query("prompt_table", f"""
WITH {_SQL_DEMOS}, places AS (
  SELECT row_number() OVER (ORDER BY rn > 1, h, row_id) AS k, sentence, lang FROM demos),
turns AS (
  SELECT 0 AS k, 0 AS part, 'system' AS role, '{prompts.SYSTEM_PROMPT.replace("'", "''")}' AS content
  UNION ALL SELECT k, 0, 'user', 'Text:' || chr(10) || sentence || chr(10) || chr(10) || 'ISO 639-3 code:' FROM places
  UNION ALL SELECT k, 1, 'assistant', lang FROM places),
fixed AS (SELECT row_number() OVER (ORDER BY k, part) - 1 AS place, role, content FROM turns)
SELECT conv_id || '-' || turn AS row_id, CAST(place AS INTEGER) AS place, fixed.role, content FROM conversations, fixed
UNION ALL
SELECT conv_id || '-' || turn, 7, 'user', 'Text:' || chr(10) || text || chr(10) || chr(10) || 'ISO 639-3 code:' FROM conversations
""")
def prompt_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sampling.fewshot_pick(documents(spark, sf_dir), 3).orderBy("pick_round", "pick_key", "row_id")
    examples = [(r[TEXT], r[LANG]) for r in picked.select(TEXT, LANG).collect()]
    chat = prompts.prompt_table(conversation_turns(spark, sf_dir), examples)
    return chat.select("row_id", F.posexplode("messages").alias("place", "m")).select("row_id", "place", "m.role", "m.content")


@query("parse_response", rf"""
WITH {SQL_CODES}, replies AS (
  SELECT doc_id AS row_id,
    CASE {sql_hex(sql_key(3, 'reply', 'doc_id'), 1, 4)} % {_FORMS}
      WHEN 0 THEN c.iso639_3 WHEN 1 THEN ' ' || c.iso639_3 || ' ' WHEN 2 THEN c.iso639_3 || '.'
      WHEN 3 THEN '"' || c.iso639_3 || '."' WHEN 4 THEN c.name || '.' WHEN 5 THEN c.iso639_3 || ' because of the words'
      WHEN 6 THEN '"' || c.iso639_3 || '".' WHEN 7 THEN '```' || lang || '```' WHEN 8 THEN '' WHEN 9 THEN 'no idea!'
      WHEN 10 THEN c.name || ' is my answer' END AS raw_output
  FROM documents JOIN codes c ON lang = c.iso639_1),
bare AS (
  SELECT *, regexp_replace(trim(regexp_replace(regexp_replace(trim(coalesce(raw_output, '')), '^`+|`+\z', '', 'g'),
      '^["'']+|["'']+\z', '', 'g')), '[.,;:!?]+\z', '') AS whole FROM replies),
words AS (SELECT *, split_part(trim(whole), ' ', 1) AS word FROM bare),
{_sql_normalize('words', 'whole', 'code_whole', 'step1')}, {_sql_normalize('step1', 'word', 'code_word', 'step2')}
SELECT row_id, raw_output, CASE WHEN code_whole <> 'und' THEN code_whole ELSE code_word END AS pred FROM step2
""")
def parse_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = codes_of(spark)
    raw = table(spark, sf_dir, "documents", "doc_id", "lang").withColumnRenamed("doc_id", "row_id")
    known = codes.attributes(codes.normalize(raw, LANG, "gold"), "gold").withColumn("_form", _form("reply"))
    two, three, name, form = F.col(LANG), F.col("gold"), F.col("name"), F.col("_form")
    replies = [
        three, F.concat(F.lit(" "), three, F.lit(" ")), F.concat(three, F.lit(".")), F.concat(F.lit('"'), three, F.lit('."')),
        F.concat(name, F.lit(".")), F.concat(three, F.lit(" because of the words")), F.concat(F.lit('"'), three, F.lit('".')),
        F.concat(F.lit("```"), two, F.lit("```")), F.lit(""), F.lit("no idea!"), F.concat(name, F.lit(" is my answer")),
    ]
    reply = F.when(form == 0, replies[0])
    for i, text in enumerate(replies[1:], 1):
        reply = reply.when(form == i, text)
    return prompts.parse_responses(known.select("row_id", reply.alias("raw_output")), codes)


@query("run_labels", f"""
WITH {SQL_DOCS}, shots AS (
  SELECT row_id, 'model-' || lang AS model, {sql_hex(sql_key(5, 'shot'), 1, 2)} % 3 AS shot FROM docs)
SELECT CASE WHEN shot > 0 THEN model || '-' || shot || 'shot' ELSE model END AS run_label,
       CASE WHEN model IN ('model-deu', 'model-eng') THEN 'LLM' ELSE 'standard' END AS kind, count(*) AS rows
FROM shots GROUP BY ALL
""")
def run_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    shot = F.conv(F.substring(shuffle_key(5, "shot", "row_id"), 1, 2), 16, 10).cast("bigint") % 3
    label = prompts.run_label_column(F.concat(F.lit("model-"), LANG), shot)
    rows = labels_only(spark, sf_dir).withColumn("run_label", label)
    kind = prompts.run_kind_column(F.col("run_label"), ["model-deu", "model-eng"])
    return rows.withColumn("kind", kind).groupBy("run_label", "kind").agg(F.count("*").alias("rows"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted label of every document: labels beyond those of the tables."""
    return noisy_predictions(spark, sf_dir).select("row_id", F.col("pred").alias(LANG))


@query("lang_distribution", f"""
WITH {SQL_NOISY}, a AS (SELECT lang, count(*) AS n FROM docs GROUP BY lang),
b AS (SELECT pred AS lang, count(*) AS n FROM preds GROUP BY pred),
joined AS (
  SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS an, coalesce(b.n, 0) AS bn FROM a FULL JOIN b ON a.lang = b.lang),
shares AS (SELECT lang, an, bn, an / (sum(an) OVER ()) AS fa, bn / (sum(bn) OVER ()) AS fb FROM joined)
SELECT lang, round(fa + fb, 6) AS both, 'documents' AS dataset, an AS rows, round(fa, 6) AS frequency FROM shares
UNION ALL
SELECT lang, round(fa + fb, 6), 'predicted', bn, round(fb, 6) FROM shares
""")
def lang_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = distribution.language_counts(labels_only(spark, sf_dir))
    second = distribution.language_counts(_predicted(spark, sf_dir))
    out = distribution.compare_distributions(first, second, ("documents", "predicted"))
    return out.withColumns({"both": F.round("both", 6), "frequency": F.round("frequency", 6)})


@query("histogram_merge", """
SELECT lang, sum(n) AS rows FROM (
  SELECT CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'spa' END AS lang, source, count(*) AS n
  FROM documents GROUP BY ALL) GROUP BY lang
""")
def histogram_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "documents", "lang", "source").groupBy("lang", "source").agg(F.count("*").alias("sentence"))
    return distribution.merge_histogram(codes_of(spark).normalize(counted, LANG))


@query("label_sets", f"""
WITH {SQL_NOISY}, {SQL_PAGES}, a AS (SELECT DISTINCT pred AS lang FROM preds), b AS (SELECT DISTINCT lang FROM page_docs)
SELECT coalesce(a.lang, b.lang) AS lang,
       CASE WHEN a.lang IS NULL THEN 'second' WHEN b.lang IS NULL THEN 'first' ELSE 'both' END AS found_in
FROM a FULL JOIN b ON a.lang = b.lang
""")
def label_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.label_sets(_predicted(spark, sf_dir), web_pages(spark, sf_dir))


@query("labels_shared", f"""
WITH {SQL_NOISY}, {SQL_PAGES}
SELECT pred AS lang FROM preds INTERSECT SELECT lang FROM page_docs
""")
def labels_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.shared_labels(_predicted(spark, sf_dir), web_pages(spark, sf_dir))


@query("labels_missing", f"""
WITH {SQL_NOISY}, {SQL_PAGES}
SELECT pred AS lang FROM preds EXCEPT SELECT lang FROM page_docs
""")
def labels_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distribution.labels_only_in(_predicted(spark, sf_dir), web_pages(spark, sf_dir))


@query("augment_corpus", f"""
WITH {SQL_DOCS}
SELECT sentence, lang FROM docs UNION ALL SELECT text, 'lad' FROM conversations
""")
def augment_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    addition = constant_corpus(table(spark, sf_dir, "conversations", "text"), codes_of(spark), "lad", "text")
    return distribution.augment(documents(spark, sf_dir), addition)


def _folder(spark: SparkSession) -> str:
    """A new folder in the shared storage, for queries that write and read back."""
    return f"{shared_dir(spark)}/tongueprint/files-{uuid.uuid4().hex}"


_SQL_LINES = rf"""
lines AS (
  SELECT doc_id || '-' || line_no AS row_id, sentence, lang, {sql_fraction(sql_key(8, 'part', "doc_id || '-' || line_no"))} AS u FROM (
    SELECT doc_id, lang, unnest(lines) AS sentence, unnest(range(0, len(lines))) AS line_no
    FROM (SELECT doc_id, lang, regexp_split_to_array(text, '{LINE_BREAK}') AS lines FROM documents))
  WHERE regexp_matches(sentence, '{NOT_WHITESPACE}'))
"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-blank lines of all documents: ``(row_id, sentence, lang)``, labels as stored."""
    raw = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    lines = sampling.drop_blank(explode_lines(raw, "text", TEXT, ["doc_id", LANG]))
    return lines.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.col("line_no").cast("string")).alias("row_id"), TEXT, LANG)


@query("tsv_split_sample", f"""
WITH {_SQL_LINES}, parts AS (SELECT *, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.85 THEN 'dev' ELSE 'test' END AS split FROM lines)
SELECT row_id, sentence, CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'spa' END AS lang FROM parts
WHERE split = 'train' AND {sql_fraction(sql_key(42, 'fraction'))} < 0.15
""")
def tsv_split_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delimited corpus read in one pass, sampled, written by split, and its training part read back."""
    folder = _folder(spark)
    u = key_fraction(shuffle_key(8, "part", "row_id"))
    split = F.when(u < 0.7, F.lit("train")).when(u < 0.85, F.lit("dev")).otherwise(F.lit("test"))
    whole = _lines(spark, sf_dir).withColumn("split", split)
    plain = {"sep": "\t", "quote": "", "escape": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    whole.write.csv(f"{folder}/all", header=True, **plain)
    rows = read_table(spark, f"{folder}/all", "tsv", "row_id string, sentence string, lang string, split string", escape="")
    write_corpus(sampling.split_fraction(rows), f"{folder}/sampled")
    return read_training(spark, f"{folder}/sampled", codes_of(spark), "train").select("row_id", TEXT, LANG)


@query("text_folder_lines", f"""
WITH {_SQL_LINES} SELECT sentence, 'spa' AS lang, count(*) AS copies FROM lines GROUP BY sentence
""")
def text_folder_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a folder of text files, each with its own id, copies included."""
    folder = _folder(spark)
    _lines(spark, sf_dir).select(TEXT).write.text(folder)
    lines = number_copies(read_lines(spark, folder, codes_of(spark), "Spanish"))
    return lines.groupBy(TEXT, LANG).agg(F.count_distinct("row_id").alias("copies"))


@query("raw_lines_with_blanks", rf"""
SELECT CAST(len(regexp_split_to_array(text, '{LINE_BREAK}')) AS BIGINT) AS lines, doc_id AS row_id FROM documents
""")
def raw_lines_with_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each text with blank ones kept."""
    raw = table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("doc_id", "row_id")
    return explode_lines(raw, "text", TEXT, ["row_id"]).groupBy("row_id").agg(F.count("*").alias("lines"))


_SQL_ALL_LINES = rf"SELECT lang, unnest(regexp_split_to_array(coalesce(text, ''), '{LINE_BREAK}')) AS sentence FROM documents"


@query("reader_keeps_blanks", f"SELECT sentence, 'spa' AS lang, count(*) AS copies FROM ({_SQL_ALL_LINES}) GROUP BY sentence")
def reader_keeps_blanks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text files read with their blank lines, each line with an id by its place."""
    folder = _folder(spark)
    table(spark, sf_dir, "documents", "text").write.text(folder)
    lines = read_lines(spark, folder, codes_of(spark), "es", drop_blank=False, id_col="row_id")
    return lines.groupBy(TEXT, LANG).agg(F.count_distinct("row_id").alias("copies"))


@query("reader_by_glob", f"""
SELECT sentence, 'lad' AS lang, count(*) AS copies FROM ({_SQL_ALL_LINES})
WHERE regexp_matches(lang, '^[de]') AND regexp_matches(sentence, '{NOT_WHITESPACE}') GROUP BY sentence
""")
def reader_by_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One folder of text files for each language, some of them chosen by a pattern."""
    folder = _folder(spark)
    table(spark, sf_dir, "documents", "lang", "text").write.partitionBy("lang").text(folder)
    lines = read_lines(spark, f"{folder}/lang=[de]*", codes_of(spark), "Ladino", id_col="row_id")
    return lines.groupBy(TEXT, LANG).agg(F.count_distinct("row_id").alias("copies"))


@query("rows_by_place", "SELECT text AS sentence, count(*) AS copies FROM documents GROUP BY text")
def rows_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table without a key: its rows get ids by file and place, the same at every read."""
    read = lambda: read_table(spark, f"{sf_dir}/documents.parquet", id_col="place").select("place", F.col("text").alias(TEXT))
    again = read().select("place", F.col(TEXT).alias("_again"))
    same = read().join(again, "place").where(F.col(TEXT).eqNullSafe(F.col("_again")))
    return same.groupBy(TEXT).agg(F.count_distinct("place").alias("copies"))


@query("single_column_source", "SELECT text AS sentence, 'lad' AS lang FROM conversations")
def single_column_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text column of a table with another name, as a corpus of one language."""
    folder = _folder(spark)
    table(spark, sf_dir, "conversations").select(F.col("text").alias("Ladino")).write.json(folder)
    return read_single_language(spark, folder, codes_of(spark), "lad", "Ladino", "json", schema="Ladino string").select(TEXT, LANG)


@query("language_histogram", """
SELECT CASE lang WHEN 'de' THEN 'deu' WHEN 'en' THEN 'eng' WHEN 'fr' THEN 'fra' ELSE 'spa' END AS lang, count(*) AS rows FROM documents GROUP BY 1
""")
def language_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram file with a header, written from the corpus and read back."""
    folder = _folder(spark)
    counts = table(spark, sf_dir, "documents", "lang").groupBy(LANG).agg(F.count("*").alias(TEXT))
    counts.coalesce(1).write.csv(folder, header=True)
    return distribution.merge_histogram(codes_of(spark).normalize(read_histogram(spark, folder), LANG))


@query("own_loader", f"WITH {SQL_PAGES} SELECT row_id, sentence, lang FROM page_docs")
def own_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's loader for a format of its own: pages labelled by their markup."""
    return custom_corpus(lambda s: web_pages(s, sf_dir), spark, codes_of(spark)).select("row_id", TEXT, LANG)
