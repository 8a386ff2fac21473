"""The operators as registered queries over whole tables, with the SQL that states a result where SQL can."""

from __future__ import annotations

import hashlib
from itertools import pairwise

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tongueprint.llm import (
    attribution, bpe, hardneg, imatch, lines, mixing, neardup, neighbours, quality, secrets, suffixes, topk, toxicity, trie,
)
from tongueprint.llm.common import sha, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register


@query("op1_lines")
def op1_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents", "doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_removed", sha(F.coalesce("text", F.lit(""))).alias("text_sha256"))


@query("op2_suffixes")
def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    cuts = suffixes.cut_texts(docs).select("key", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
    has_repeat = (F.col("n_removed") > 0).alias("has_repeat")
    return suffixes.attach(docs, cuts).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", has_repeat)


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality")
    scored = quality.score(docs, quality.train(docs, labels))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", neardup.hex_of("fingerprint").alias("fingerprint"), "component_id")


@query("op5_imatch")
def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    shipped = spark.sparkContext.broadcast(imatch.lexicon_of(docs))

    def make():
        terms, hashes, last = shipped.value.terms, imatch.Hashes(), {}

        def pair(text: str, following: str) -> tuple:
            # The next document's fingerprint is the one of the step to come.
            own = last.pop(text, None) or imatch.signature(text, terms, hashes)
            after = own if following == text else imatch.signature(following, terms, hashes)
            last.clear()
            last[following] = after
            half = len(text) // 2
            edited = text[:len(text) - half] + following[:half]
            changed = own if edited == text else imatch.signature(edited, terms, hashes)
            return (
                len(text), hashlib.sha256(edited.encode("utf-8")).hexdigest(), imatch.as_text(own), imatch.as_text(changed),
                imatch.likeness(own, changed), imatch.likeness(own, after),
            )

        return pair

    return neighbours.with_next(
        docs, "doc_id", "text", make,
        "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return attribution.section_tokens(docs, ranks, fields=("source", "lang", "text"), rule="start")


@query("op7_top_k", """
WITH vecs AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
""")
def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.whole_numbers(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), "vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("id") % 50 == 0))


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    coded = bpe.encode(table(spark, sf_dir, "documents", "doc_id", "text"), path).drop("text")
    back = bpe.decode(coded, path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"),
        sha(F.col("decoded")).alias("decoded_sha256"),
    )


def _sql_time(schedule: tuple) -> str:
    """SQL for the time at which the share ``u`` of a schedule's integral is reached, as ``mixing.invert`` says it."""
    pieces = [(t0, w0, t1, w1, (t1 - t0) * (w0 + w1) / 2) for (t0, w0), (t1, w1) in pairwise(schedule)]
    wanted, done, cases = f"(u * {sum(p[-1] for p in pieces)!r}::DOUBLE)", 0.0, []
    for t0, w0, t1, w1, area in pieces:
        rest = f"greatest(0.0::DOUBLE, {wanted} - {done!r}::DOUBLE)"
        root = f"sqrt(greatest(0.0::DOUBLE, {w0 * w0!r}::DOUBLE + {2 * (w1 - w0) / (t1 - t0)!r}::DOUBLE * {rest}))"
        time = f"{t0!r}::DOUBLE + CASE WHEN {rest} > 0 THEN 2.0::DOUBLE * {rest} / ({w0!r}::DOUBLE + {root}) ELSE 0 END"
        done += area
        cases.append(f"WHEN {wanted} <= {done!r}::DOUBLE THEN least({t1!r}::DOUBLE, {time})")
    return f"CASE {' '.join(cases)} ELSE {schedule[-1][0]!r}::DOUBLE END"


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    found = secrets.scan(docs, secrets.train(findings=secrets.weak_findings(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "model")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select(
        "doc_id", number("assign"), number("access"), number("hex"), sha(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


@query("op10_mix", f"""
WITH docs AS (
  SELECT doc_id, source, md5('7:' || doc_id) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS place
  FROM docs GROUP BY source),
weighed AS (SELECT *, CAST(list_extract([5, 2, 1], CAST(place + 1 AS INTEGER)) AS DOUBLE) AS w FROM sizes),
levels AS (
  SELECT *, CAST(2.0 * source_size AS DOUBLE) AS cap, (SELECT CAST(1.5 * sum(source_size) AS DOUBLE) FROM sizes) AS wanted,
         CAST(coalesce(sum(2.0 * source_size) OVER before, 0) AS DOUBLE) AS filled,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open
  FROM weighed WINDOW before AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT max((wanted - filled) / open) AS x FROM levels WHERE (wanted - filled) / open * w <= cap),
running AS (
  SELECT d.doc_id, d.size, l.source_size, l.place, least(l.cap, level.x * l.w) AS target,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto
  FROM docs d JOIN levels l ON d.source IS NOT DISTINCT FROM l.source, level),
demand AS (
  SELECT *, upto * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS last,
         (upto - size) * (CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS first
  FROM running),
shares AS (SELECT *, CASE WHEN target > 0 THEN (first + last) / (2.0::DOUBLE * target) ELSE 0 END AS u FROM demand)
SELECT doc_id, size, source_size, target, CAST(floor(last) - floor(first) AS BIGINT) AS taken,
       CASE place WHEN 0 THEN {_sql_time(mixing.SCHEDULES[0])} WHEN 1 THEN {_sql_time(mixing.SCHEDULES[1])}
       ELSE {_sql_time(mixing.SCHEDULES[2])} END AS position
FROM shares
""")
def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents", "doc_id", "text", "source"))
    return mixing.range_sort(mixed, "position", "doc_id").select(
        "doc_id", "size", "source_size", "target", "taken", "position"
    )


@query("op11_hard_negatives", """
WITH vecs AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT vec_id, label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vecs),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(sum(a.x * c.x) AS BIGINT) AS score
  FROM parts a JOIN parts c ON a.i = c.i AND a.vec_id <> c.vec_id
  WHERE a.vec_id % 100 = 0 GROUP BY ALL),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
  WHERE 30 * p.positive_score <= 100 * n.score AND 100 * n.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hardneg.usable(vectors.withColumn("label", label), "vec_id", "embedding", "label")
    return hardneg.mine(rows, rows.where(F.col("id") % 100 == 0))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted")
    )


# Fixed value: the reversed polynomial of CRC-32.
_SQL_CRC = """
crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
crcs AS (
  SELECT conv_id, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(1, len(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(conv_id AS VARCHAR), i, 1)) AS BIGINT))),
    lambda a, b: xor(a >> 8, list_extract(t, CAST((xor(a, b) & 255) + 1 AS INTEGER))))) AS crc
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table)
"""


@query("op13_prefix_trie", f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                            md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
{_SQL_CRC},
lengths AS (SELECT conv_id, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS parent, crc % 6 AS h, least(crc % 6, coalesce(n, 0)) AS taken
  FROM crcs c LEFT JOIN lengths l ON l.conv_id = c.conv_id - c.conv_id % 100),
rebuilt AS (
  SELECT c.conv_id, place AS pos, role, text FROM convs c JOIN turns t ON t.conv_id = parent AND place <= h
  UNION ALL SELECT c.conv_id, taken + place - h, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND place > h),
sequences AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN rebuilt r USING (conv_id) GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, len(s) AS n, d, s[1:d] AS node
  FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM sequences)),
found AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sum(CASE WHEN n = d THEN 0 ELSE 1 END) = 0 AS is_leaf,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d), '') AS ends
  FROM prefixes GROUP BY node, d),
below AS (
  SELECT node[1:e] AS top, e, sum((n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(node[d].text) END) AS saved,
         sum(CASE WHEN is_leaf THEN 1 ELSE 0 END) AS leaves, sum(CASE WHEN d = e + 1 THEN 1 ELSE 0 END) AS children
  FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM found) GROUP BY 1, 2)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, f.n_convs, CAST(b.children AS BIGINT) AS n_children,
       CAST(b.leaves AS BIGINT) AS n_leaves, CAST(b.saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM found f JOIN below b ON b.top = f.node AND b.e = f.d LEFT JOIN found p ON f.d > 0 AND p.d = f.d - 1 AND p.node = f.node[1:f.d - 1]
""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = trie.ordered_turns(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    return trie.nodes(trie.rebuilt(turns))
