import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tongueprint.operators import sampling


def key(seed, salt, row_id):
    return hashlib.md5(f"{seed}:{salt}:{row_id}".encode()).hexdigest(), row_id


@pytest.fixture(scope="module")
def skewed(spark):
    """1,200 rows, a third of them in one language, one language with a single row."""
    rng = random.Random(5)
    langs = ["eng"] * 400 + ["fra"] * 300 + ["deu"] * 1 + rng.choices(["spa", "ita", "kab"], k=499)
    rows = [(i, f"text {i}", lang) for i, lang in enumerate(langs)]
    return rows, spark.createDataFrame(rows, "row_id bigint, sentence string, lang string")


def ids(df):
    return sorted(r["row_id"] for r in df.select("row_id").collect())


def expected(rows, n, seed, salt):
    by_lang = {}
    for i, _, lang in rows:
        by_lang.setdefault(lang, []).append(key(seed, salt, i))
    return sorted(i for keys in by_lang.values() for _, i in sorted(keys)[:n])


@pytest.mark.parametrize("n", [0, 1, 7, 300, 400, 5000])
def test_sample_matches_brute_force(skewed, n):
    rows, df = skewed
    assert ids(sampling.sample_per_language(df, n, seed=3)) == expected(rows, n, 3, "sample")


def test_sample_small_fixture(spark, codes):
    rows = [(i, "x", lang) for i, lang in enumerate(["eng"] * 5 + ["fra"] * 2 + ["deu"])]
    df = spark.createDataFrame(rows, "row_id bigint, sentence string, lang string")
    counts = {r["lang"]: r["count"] for r in sampling.sample_per_language(df, 2).groupBy("lang").count().collect()}
    assert counts == {"eng": 2, "fra": 2, "deu": 1}
    assert sampling.sample_per_language(df, -1).count() == 8
    only = sampling.sample_per_language(df, 3, codes, ["English"]).select("lang").collect()
    assert [r[0] for r in only] == ["eng"] * 3
    assert sampling.sample_per_language(df.where("false"), 2).count() == 0
    assert sampling.filter_languages(df, "de, French", codes).count() == 3


@pytest.mark.parametrize("shot, langs", [(0, 0), (2, 2), (5, 3), (8, 3), (20, 3)])
def test_fewshot(spark, shot, langs):
    rows = [(i, f"t{i}", lang) for i, lang in enumerate(["eng"] * 5 + ["fra"] * 2 + ["deu"])]
    df = spark.createDataFrame(rows, "row_id bigint, sentence string, lang string")
    picked = sampling.fewshot_pick(df, shot, seed=1)
    order = sorted(rows, key=lambda r: key(1, "fewshot", r[0]))
    firsts, seen = [], set()
    for row in order:
        if row[2] not in seen:
            seen.add(row[2])
            firsts.append(row[0])
    want = (firsts + [r[0] for r in order if r[0] not in firsts])[:shot]
    assert ids(picked) == sorted(want)
    assert picked.select("lang").distinct().count() == langs
    rest = sampling.hold_out(df, picked)
    assert sorted(ids(picked) + ids(rest)) == list(range(8))


@pytest.mark.parametrize("size", [0.2, 0.333, 0.0, 1.0])
def test_split_exact(skewed, size):
    rows, df = skewed
    out = sampling.split_exact(df, size, seed=9)
    test = ids(out.where("part = 'test'"))
    assert test == sorted(i for _, i in sorted(key(9, "split", r[0]) for r in rows)[: math.ceil(size * len(rows))])
    assert out.count() == len(rows)


def test_partitioning_does_not_matter(skewed):
    _, df = skewed
    for fn in (
        lambda d: sampling.sample_per_language(d, 50), lambda d: sampling.take_uniform(d, 77), lambda d: sampling.fewshot_pick(d, 9),
        lambda d: sampling.split_fraction(d, 0.3), lambda d: sampling.split_exact(d).where("part = 'test'"),
        lambda d: sampling.stratified_fraction(d, "lang", 100),
    ):
        assert ids(fn(df.repartition(1))) == ids(fn(df.repartition(8, "sentence")))


def test_segments_cover_everything(skewed):
    rows, df = skewed
    counts = {r["segment"]: r["count"] for r in sampling.rank_segments(df, [100, 250], 0, "x", "row_id").groupBy("segment").count().collect()}
    assert counts == {0: 100, 1: 150, 2: len(rows) - 250}


def test_fraction_exact_sizes(skewed):
    rows, df = skewed
    out = sampling.split_fraction(df, 0.15, exact_by=["lang"]).groupBy("lang").count().collect()
    totals = {}
    for _, _, lang in rows:
        totals[lang] = totals.get(lang, 0) + 1
    assert {r["lang"]: r["count"] for r in out} == {k: round(0.15 * v) for k, v in totals.items() if round(0.15 * v)}


def test_same_texts_stay_together(spark):
    df = spark.createDataFrame([(i, f"text {i % 10}") for i in range(200)], "row_id bigint, sentence string")
    sides = sampling.split_by_hash(df, 0.5, split_key="sentence").groupBy("sentence").agg(F.count_distinct("part").alias("n"))
    assert sides.where("n > 1").count() == 0


def test_hot_keys_with_equal_text_ids(spark):
    """String ids, rows that share a key prefix, and a cut inside one histogram cell."""
    rows = [(f"id-{i:05d}", "eng") for i in range(3000)]
    df = spark.createDataFrame(rows, "row_id string, lang string")
    want = sorted((hashlib.md5(f"0:sample:{i}".encode()).hexdigest(), i) for i, _ in rows)[:1234]
    got = sampling.sample_per_language(df, 1234).select("row_id").collect()
    assert sorted(r[0] for r in got) == sorted(i for _, i in want)


def test_drop_blank_and_presence(spark, codes):
    df = spark.createDataFrame([("a", "eng"), (" ", "eng"), (None, "fra"), ("　", "fra")], "sentence string, lang string")
    assert sampling.drop_blank(df).count() == 1
    assert sampling.language_presence(df, "French", codes).first()[:] == ("fra", 2, False)
    assert sampling.language_presence(df, "lad", codes).first()[:] == ("lad", 0, True)


@pytest.mark.parametrize("cell", [0, 3, 10**6])
def test_cells_are_divided_until_they_fit(skewed, cell):
    """Cuts by cells of one key, of a few and without any division are those of a plain sort."""
    rows, df = skewed
    sizes = [1, 7, F.ceil(F.col("total") / 3), 10**9]
    cuts = {r["lang"]: r for r in sampling.rank_cuts(df, sizes, 4, "s", "row_id", ["lang"], cell).collect()}
    by_lang = {}
    for i, _, lang in rows:
        by_lang.setdefault(lang, []).append(key(4, "s", i))
    assert set(cuts) == set(by_lang)
    for lang, keys in by_lang.items():
        keys.sort()
        for i, size in enumerate([1, 7, -(-len(keys) // 3), 10**9]):
            assert tuple(cuts[lang][f"_cut{i}"]) == keys[min(size, len(keys)) - 1], (lang, i)


def test_rows_of_one_id_are_one_key(spark):
    """A third of the rows has one id, others have none: cuts do not divide such rows, and every row is kept or left whole."""
    rows = [(7,)] * 400 + [(None,)] * 300 + [(i,) for i in range(100, 600)]
    df = spark.createDataFrame(rows, "row_id bigint")
    order = sorted((i for (i,) in rows if i is not None), key=lambda i: key(0, "s", i))
    for size in (250, 500, 900, 1200):
        for cell in (1, 10**6):
            cut = sampling.rank_cuts(df, [size], 0, "s", "row_id", cell=cell).first()["_cut0"]
            # Rows without an id come first.
            assert tuple(cut) == ((None, None) if size <= 300 else key(0, "s", order[size - 301])), (size, cell)


def test_as_many_groups_as_rows(spark):
    df = spark.range(3000).select(F.col("id").alias("row_id"), F.col("id").cast("string").alias("lang"))
    assert sampling.take_ranked(df, 1, 0, "s", "row_id", ["lang"]).count() == 3000
    assert sampling.take_ranked(df.limit(0), 1, 0, "s", "row_id", ["lang"]).count() == 0
