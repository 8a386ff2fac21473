"""Input columns named like the operators' own, and vectors of very large components."""

import re
from pathlib import Path

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tongueprint.llm import attribution, lines, mixing, neardup, quality, suffixes, topk

FOLDER = Path(lines.__file__).parent
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BASE = {"doc_id": "long", "text": "string", "source": "string"}


def names_in(*modules: str) -> list[str]:
    """Every quoted word of the modules that could be the name of a column."""
    words = {w for m in modules for w in re.findall(r'"([A-Za-z_][A-Za-z_0-9]*)"', (FOLDER / f"{m}.py").read_text())}
    seen = {}
    for word in sorted(words):
        seen.setdefault(word.lower(), word)
    return [w for low, w in seen.items() if low not in BASE]


def words(seed: int, count: int) -> str:
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(["an", "er", "ti", "on", "re", "es", "th"], draw.integers(2, 5))) for _ in range(count))


TEXTS = [words(1, 12) + "\n" + words(2, 90), words(3, 9) + "\n" + words(2, 90), words(1, 12), None, "", words(4, 60), words(4, 60)]


def crowded(spark, names):
    """Rows with an extra column of each name; every one holds its own name and the number of the row."""
    plain = spark.createDataFrame([(i, t, "ab"[i % 2]) for i, t in enumerate(TEXTS)], ", ".join(f"{k} {v}" for k, v in BASE.items()))
    return plain, plain.select("*", *[F.concat(F.lit(f"{n}-"), F.coalesce(F.col("doc_id"), F.lit(-1)).cast("string")).alias(n) for n in names])


def untouched(rows, names):
    return all(r[n] == f"{n}-{r['doc_id']}" for r in rows for n in names)


def test_line_dedup_keeps_columns_of_any_name(spark):
    names = ["_key", *(n for n in names_in("lines", "components", "common") if n not in ("n_lines", "n_removed"))]
    assert {"_row", "_cut", "node", "own", "doc"} <= set(names)
    plain, wide = crowded(spark, names)
    expected = {r["doc_id"]: (r["text"], r["n_removed"]) for r in lines.dedup_lines(plain).collect()}
    found = lines.dedup_lines(wide).collect()
    assert {r["doc_id"]: (r["text"], r["n_removed"]) for r in found} == expected and untouched(found, names)
    assert sum(n for _, n in expected.values()) == 3


def test_mix_keeps_columns_of_any_name(spark):
    names = names_in("mixing", "common")
    assert {"position", "size", "_id", "taken"} <= set(names)
    plain, wide = crowded(spark, names)
    mixed = mixing.mix(wide)
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mixing.mix(plain).collect()))
    found = mixing.copies(wide, mixed, position_col="place_in_mix").collect()
    assert untouched(found, names)
    plainly = mixing.copies(plain, mixing.mix(plain)).collect()
    assert sorted((r["doc_id"], r["position"]) for r in plainly) == sorted((r["doc_id"], r["place_in_mix"]) for r in found)


def test_repeated_strings_next_to_columns_of_any_name(spark):
    added = ["n_bytes", "n_removed", "n_spans", "spans", "kept"]
    names = [n for n in names_in("suffixes", "common") if n not in added]
    assert "key" in names
    plain, wide = crowded(spark, [*names, *added])
    expected = sorted((r["doc_id"], *(r[c] for c in added)) for r in suffixes.attach(plain, suffixes.cut_texts(plain)).collect())
    found = suffixes.attach(wide, suffixes.cut_texts(wide)).collect()
    assert sorted((r["doc_id"], *(r[c] for c in added)) for r in found) == expected and untouched(found, names)
    assert sum(row[2] for row in expected) > 0


def test_token_counts_by_an_id_of_any_name(spark):
    plain, _ = crowded(spark, [])
    expected = sorted(map(tuple, attribution.section_tokens(plain, RANKS).collect()))
    for name in (*attribution.COLUMNS, "id", "f0"):
        found = attribution.section_tokens(plain.withColumnRenamed("doc_id", name), RANKS, id_col=name)
        assert found.columns[0] == (f"{name}_id" if name in attribution.COLUMNS else name)
        assert sorted(map(tuple, found.collect())) == expected


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    names = [n for n in names_in("neardup", "mixing", "quality", "lines", "components", "common") if n not in ("n_chars", "label")]
    _, wide = crowded(spark, names)
    spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for stage in (corpus_pipeline.keep_quality, corpus_pipeline.dedup_lines, corpus_pipeline.dedup_documents, corpus_pipeline.mix_sources):
        out = stage(spark, wide, str(tmp_path))
        assert out.columns == wide.columns and untouched(out.collect(), names), stage


def test_near_duplicates_and_scores_ignore_other_columns(spark):
    plain, wide = crowded(spark, names_in("neardup", "quality", "components"))
    assert sorted(map(tuple, neardup.near_duplicates(wide).collect())) == sorted(map(tuple, neardup.near_duplicates(plain).collect()))
    model = quality.train(plain, spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int"))
    assert sorted(r["score"] for r in quality.score(wide, model).collect()) == sorted(r["score"] for r in quality.score(plain, model).collect())


def test_top_k_of_very_large_components_is_exact(spark):
    draw = np.random.default_rng(3)
    vectors = [(i, [float(x) for x in draw.normal(0, 10.0 ** (i % 8), 6)]) for i in range(120)]
    vectors += [(200, [1e20, 0.0, 0.0, 0.0, 0.0, 1.5]), (201, [-1e20, 1.0, 0.0, 0.0, 0.0, 0.0]), (250, [1e300] + [0.25] * 5), (251, [0.0, 0.0, 1e-9])]
    vectors += [(300, [1e308] * 6), (350, [1000003.7, 1000001.3, 999999.1, 1.0, 2.0, 3.0]), (351, [1000002.9, 999998.2, 1000004.4, 1.0, 1.0, 1.0])]
    whole = {i: [int(np.floor(256 * x)) for x in v] for i, v in vectors if i != 300}
    expected = set()
    for q in [i for i in whole if i % 50 == 0]:
        scores = {c: min(topk.MOST, max(topk.LEAST, sum(a * b for a, b in zip(whole[q], whole[c])))) for c in whole if c != q}
        ranked = sorted(scores, key=lambda c: (-scores[c], c))[:5]
        expected |= {(q, rank, c, scores[c]) for rank, c in enumerate(ranked, 1)}
    table = topk.whole_numbers(spark.createDataFrame(vectors, "id long, v array<double>").repartition(3), "id", "v")
    for block in (16384, 30):
        found = topk.top_k(table, table.where("id % 50 = 0"), query_block=3, candidate_block=block)
        assert {tuple(r) for r in found.collect()} == expected
    assert topk.whole_scores(np.array([1000003.0, 3.0]), np.array([[655360010021.0, 1.0]]))[0] == 1000003 * 655360010021 + 3
