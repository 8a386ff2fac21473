import math
import random
from collections import Counter
from itertools import product

import pytest
from pyspark.sql import functions as F

from tests.test_text import plain_grams
from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import grams, naive_bayes
from tongueprint.operators.lookup import BROADCAST_LIMIT
from tongueprint.session import materialize
from tongueprint.operators.scorers import ProfileDetector

ROWS = "row_id int, lang string, sentence string"
TRAIN = [(1, "eng", "the cat"), (2, "eng", "a cat"), (3, "spa", "el gato")]
TEST = [(1, "x", "the gato"), (2, "x", "a cat"), (3, "x", "xyz"), (4, "x", ""), (5, "x", None)]
SHAPES = [(80, BROADCAST_LIMIT), (80, 0), (1, BROADCAST_LIMIT), (1, 0)]


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame(TRAIN, ROWS), spark.createDataFrame(TEST, ROWS)


@pytest.mark.parametrize("block, limit", SHAPES)
def test_hashed_by_hand(small, block, limit):
    model = naive_bayes.fit(small[0], GramSpec())
    out = {r["row_id"]: r for r in model.predict(small[1], with_scores=True, label_block=block, broadcast_limit=limit).collect()}
    scores = {i: {s["label"]: s["score"] for s in r["scores"]} for i, r in out.items()}
    assert scores[1] == pytest.approx({"eng": -215.814671, "spa": -207.870503}, abs=1e-5)
    assert scores[2] == pytest.approx({"eng": -88.6867, "spa": -146.285399}, abs=1e-5)
    assert scores[3] == pytest.approx({"eng": -112.79772, "spa": -113.450042}, abs=1e-5)
    assert [out[i]["pred"] for i in range(1, 6)] == ["spa", "eng", "eng", "eng", "eng"]
    assert [out[i]["confidence"] for i in range(1, 6)] == pytest.approx([0.999645, 1.0, 0.657534, 0.666667, 0.666667], abs=1e-6)
    assert all(r["raw_output"] == r["pred"] and r["lang"] == "x" for r in out.values())


@pytest.mark.parametrize("block, limit", SHAPES)
def test_vocabulary_by_hand(small, block, limit):
    model = naive_bayes.fit(small[0], GramSpec(buckets=None))
    out = {r["row_id"]: r for r in model.predict(small[1], with_scores=True, label_block=block, broadcast_limit=limit).collect()}
    scores = {i: {s["label"]: s["score"] for s in r["scores"]} for i, r in out.items()}
    assert scores[1] == pytest.approx({"eng": -121.964124, "spa": -103.562265}, abs=1e-5)
    assert scores[2] == pytest.approx({"eng": -35.057816, "spa": -86.680691}, abs=1e-5)
    assert scores[3] == pytest.approx({"eng": -0.405465, "spa": -1.098612}, abs=1e-5)


def test_class_totals(small):
    totals = {r["lang"]: r[1:] for r in naive_bayes.class_totals(naive_bayes.fit(small[0], GramSpec(buckets=None))).collect()}
    assert totals == {"eng": (2, 30, 21), "spa": (1, 18, 18)}


@pytest.mark.parametrize("block", [200, 50])
def test_many_labels_match_plain_python(spark, block):
    """120 labels of random words against the formulas written out, in one block and in three."""
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    train = [(i, f"l{i % 120:03d}", " ".join(rng.choices(words, k=5))) for i in range(360)]
    test = [(i, "?", " ".join(rng.choices(words + ["zzz"], k=4))) for i in range(40)]
    model = naive_bayes.fit(spark.createDataFrame(train, ROWS), GramSpec(buckets=None), alpha=0.1)
    out = model.predict(spark.createDataFrame(test, ROWS), label_block=block, with_scores=True).collect()

    counts, rows = {}, {}
    for _, lang, text in train:
        rows[lang] = rows.get(lang, 0) + 1
        own = counts.setdefault(lang, {})
        for g in plain_grams(text, 2, 4):
            own[g] = own.get(g, 0) + 1
    vocabulary = {g for own in counts.values() for g in own}
    texts = {i: text for i, _, text in test}
    for row in out:
        known = [g for g in plain_grams(texts[row["row_id"]], 2, 4) if g in vocabulary]
        want = {}
        for lang, own in counts.items():
            mass = sum(own.values()) + 0.1 * len(vocabulary)
            want[lang] = math.log(rows[lang] / 360) + sum(math.log((own.get(g, 0) + 0.1) / mass) for g in known)
        assert {s["label"]: s["score"] for s in row["scores"]} == pytest.approx(want, abs=1e-6)
        assert row["pred"] == min(want, key=lambda c: (-round(want[c], 6), c))


def test_merge_equals_refit(small, spark):
    train, test = small
    parts = [naive_bayes.fit(train.where(F.col("row_id") == i), GramSpec()) for i in (1, 2, 3)]
    merged, whole = naive_bayes.merge(*parts), naive_bayes.fit(train, GramSpec())
    assert sorted(merged.counts.collect()) == sorted(whole.counts.collect())
    assert sorted(merged.classes.collect()) == sorted(whole.classes.collect())
    with pytest.raises(ValueError):
        naive_bayes.merge(whole, naive_bayes.fit(train, GramSpec(2, 3)))


def test_save_and_load(small, spark, tmp_path):
    model = naive_bayes.fit(small[0], GramSpec(2, 3, None), alpha=0.5, name="kept", path=str(tmp_path / "m"))
    again = naive_bayes.load(spark, str(tmp_path / "m"))
    assert (again.spec, again.alpha, again.name) == (GramSpec(2, 3, None), 0.5, "kept")
    assert sorted(again.predict(small[1]).collect()) == sorted(model.predict(small[1]).collect())


def test_any_partitioning_gives_the_same(small):
    train, test = small
    one, many = (naive_bayes.fit(train.repartition(n), GramSpec()).predict(test.repartition(n)).collect() for n in (1, 8))
    rounded = [sorted((r["row_id"], r["pred"], round(r["confidence"], 9)) for r in rows) for rows in (one, many)]
    assert rounded[0] == rounded[1]


def test_word_counts_equal_gram_counts(spark):
    rows = [(1, "a", "the the cat"), (2, "a", "The cat"), (3, "b", "cat")]
    df = spark.createDataFrame(rows, ROWS)
    spec = GramSpec(buckets=None)
    direct = grams.gram_counts(df, spec, ["row_id", "lang"]).groupBy("lang", "feature").agg(F.sum("tf").alias("n"))
    assert sorted(direct.collect()) == sorted(grams.label_gram_counts(df, spec, "lang").collect())


def test_profile_detector_has_no_opinion_on_nothing(small):
    out = {r["row_id"]: r for r in ProfileDetector(naive_bayes.fit(small[0])).predict(small[1]).collect()}
    assert [out[i]["pred"] for i in range(1, 6)] == ["spa", "eng", "eng", "und", "und"]
    assert out[4]["confidence"] is None and out[1]["confidence"] > 0.99


def test_hash_of_a_feature_is_stable(spark):
    df = spark.createDataFrame([("the",), (None,)], "gram string")
    values = [r[0] for r in df.select(GramSpec(portable=True).feature(F.col("gram"))).collect()]
    import hashlib

    assert values == [int(hashlib.md5(b"the").hexdigest()[:8], 16) % 2**18, None]


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, "b")], "row_id int, sentence string")
    rows = grams.tfidf(df, GramSpec(2, 2, None)).collect()
    idf = {" a": math.log(4 / 3) + 1, "ab": math.log(4 / 3) + 1, "b ": math.log(4 / 4) + 1}
    norm = math.sqrt(sum(v * v for v in idf.values()))
    want = {(i, g): v / norm for i in (1, 2) for g, v in idf.items()} | {(3, "b "): 1.0}
    assert {(r["row_id"], r["feature"]): r["weight"] for r in rows} == pytest.approx(want)


def test_salted_lookup_equals_broadcast(spark):
    df = spark.createDataFrame([(i, f"ab cd{i % 5}") for i in range(50)], "row_id int, sentence string")
    from tongueprint.operators.lookup import lookup_join

    counts = grams.gram_counts(df, GramSpec(buckets=None), ["row_id"])
    values = counts.groupBy("feature").agg(F.count("*").alias("df"))
    results = [sorted(lookup_join(counts, values, "feature", "row_id", "left", limit).collect()) for limit in (0, 2**30)]
    assert results[0] == results[1] and len(results[0]) == counts.count()


def test_one_row_out_for_every_row_in(spark):
    """Repeated and null ids, rows equal in everything, blank and null texts: nothing merges, and copies score alike."""
    train = spark.createDataFrame(TRAIN, ROWS)
    rows = [(7, "eng", "the cat"), (7, "eng", "el gato"), (7, "eng", "the cat"), (None, "eng", " the  cat"), (None, "eng", ""),
            (None, "eng", None), (8, None, "  "), (8, None, "  "), (8, None, None)]
    test = spark.createDataFrame(rows * 3, ROWS).repartition(4)
    for buckets, block, limit in product((None, 2**18), (1, 40), (0, BROADCAST_LIMIT)):
        model = naive_bayes.fit(train, GramSpec(buckets=buckets))
        out = model.predict(test, label_block=block, broadcast_limit=limit).collect()
        assert len(out) == len(rows) * 3
        counted = Counter((r["row_id"], r["lang"], r["pred"], round(r["confidence"], 9)) for r in out)
        apart = spark.createDataFrame([(i, lang, text) for i, (_, lang, text) in enumerate(rows)], ROWS)
        wanted = Counter()
        for r in model.predict(apart).collect():
            wanted[rows[r["row_id"]][0], r["lang"], r["pred"], round(r["confidence"], 9)] += 3
        assert counted == wanted


def text_scans(df):
    """Scans in the plan that read sentences; paths may be shortened there, the schema read is not."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("FileScan" in line and "ReadSchema" in line and "sentence" in line.split("ReadSchema")[1] for line in plan.splitlines())


def test_many_labels_read_the_texts_once(spark, tmp_path):
    train = [(i, f"l{i:03d}", f"w{i:03d} common") for i in range(120)]
    model = naive_bayes.fit(spark.createDataFrame(train, ROWS), GramSpec())
    spark.createDataFrame(train, ROWS).write.parquet(str(tmp_path / "texts"))
    out = model.predict(spark.read.parquet(str(tmp_path / "texts")))
    assert text_scans(out) == 1
    assert all(r["pred"] == r["lang"] for r in out.collect())


def test_frequent_words_first(spark, monkeypatch):
    """Where not all words fit, the frequent ones are scored ahead and the others unfolded: the same scores."""
    train = spark.createDataFrame(TRAIN, ROWS)
    test = spark.createDataFrame([(i, "eng", f"the cat {'le' * (i % 3)} w{i} chat") for i in range(30)], ROWS)
    model = naive_bayes.fit(train)
    whole = sorted((r["row_id"], r["lang"], round(r["score"], 9)) for r in model.score_table(test).collect())
    ready = model.prepare()
    monkeypatch.setattr(ready, "limit", 600)
    assert 0 < ready.words_of(test).count() < 10
    few = ready.predict(test, keep=(), with_scores=True).select("row_id", F.inline("scores")).collect()
    assert sorted((r["row_id"], r["label"], round(r["score"], 9)) for r in few) == whole


def rows_of_tasks(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_model_too_large_to_send(spark):
    """300 labels: lists of gains, one scan, and no task with much more than the others though two n-grams are in every text."""
    import random

    rng = random.Random(3)
    train = [(i, f"l{i % 300:03d}", f"q{i % 300:03d} " + " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12))) for i in range(600)]
    model = naive_bayes.fit(spark.createDataFrame(train, ROWS), GramSpec())
    test = spark.createDataFrame([(i, label, text + " ##") for i, label, text in train], ROWS).repartition(8)
    dense = {(r["row_id"], r["lang"]): r["score"] for r in model.score_table(test).collect()}
    assert model.dense_bytes() > 2_000_000
    for limit in (0, 100_000, 2_000_000):
        sparse = {(r["row_id"], r["lang"]): r["score"] for r in model.score_table(test, broadcast_limit=limit).collect()}
        assert sparse.keys() == dense.keys() and len(sparse) == 180_000
        assert max(abs(sparse[k] - dense[k]) for k in dense) < 1e-6
    out = model.predict(test, broadcast_limit=100_000)
    assert sum(r["pred"] == r["lang"] for r in out.collect()) > 590


def test_hot_keys_are_salted_by_their_count(spark):
    from tongueprint.operators.lookup import salted_by_count

    left = materialize(spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, F.lit(-1)).otherwise(F.col("id") % 997).alias("k")), "test")
    values = spark.range(-1, 997).select(F.col("id").alias("k"), (F.col("id") * 3).alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = salted_by_count(left, values, "k", ["id"])
        tasks = rows_of_tasks(joined)
        assert joined.where("v = 3 * k").count() == 40_000
        assert tasks[-1] <= 3 * tasks[len(tasks) // 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
