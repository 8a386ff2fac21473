"""Counting n-grams by batches: against plain counting, over groups and pieces, and weights in both forms of the lookup."""

import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tongueprint.functions import counting
from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import grams, naive_bayes
from tongueprint.plans.catalog import rounded_doubles


def plain(text, lo, hi):
    found = Counter()
    for word in filter(None, counting.BLANK.split(text)):
        padded = f" {word} "
        if len(padded) < lo:
            found[padded] += 1
        else:
            found.update(padded[i:i + n] for n in range(lo, hi + 1) for i in range(len(padded) - n + 1))
    return found


@pytest.mark.parametrize("letters", ["ab \n", "aé ü😀 ", "".join(map(chr, range(0x4E00, 0x4E00 + 9000))) + " " * 3000])
@pytest.mark.parametrize("lo, hi", [(1, 1), (1, 3), (2, 4), (4, 6), (3, 12)])
def test_counts_are_those_of_every_window(lo, hi, letters):
    draw = random.Random(lo * hi)
    texts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 50))) for _ in range(60)]
    groups = sorted(draw.randint(0, 20) for _ in texts)
    wanted, hashed = Counter(), Counter()
    for text, group in zip(texts, groups):
        for gram, n in plain(text, lo, hi).items():
            wanted[group, gram] += n
            hashed[group, int(hashlib.md5(gram.encode()).hexdigest()[:8], 16) % 97] += n
    for counts, right in zip(counting.GramCounter([GramSpec(lo, hi, None), GramSpec(lo, hi, 97, True)]).count(texts, groups), (wanted, hashed)):
        found = list(zip(zip(counts.group.tolist(), counts.features().to_pylist()), counts.times.tolist()))
        assert len(found) == len(right) and dict(found) == dict(right)


def test_groups_over_pieces_and_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = [(i % 5 if i % 7 else None, f"word{i % 3} more {'long ' * (i % 4)}") for i in range(200)]
        df = spark.createDataFrame(rows, "row_id long, sentence string")
        found = grams.gram_counts(df, GramSpec(2, 4, None), ["row_id"]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    wanted = Counter()
    for i, text in rows:
        for gram, n in plain(text, 2, 4).items():
            wanted[i, gram] += n
    assert len(found) == len(wanted) and {(r["row_id"], r["feature"]): r["tf"] for r in found} == dict(wanted)
    monkeypatch.setattr(counting, "PIECE", 10)
    cut = list(counting.portions(["one two three four five", "", "x" * 30 + " y"]))
    assert len(cut) > 2 and [t.split() for _, t in (p for part in cut for p in part)] != []
    assert " ".join(t for part in cut for r, t in part if r == 0).split() == "one two three four five".split()


@pytest.mark.parametrize("limit", [2**28, 2000])
def test_weights_are_the_same_however_values_are_looked_up(spark, limit):
    texts = {i: " ".join(f"w{i * k % 17}" for k in range(1, 6)) for i in range(40)}
    df = spark.createDataFrame(list(texts.items()) + [(None, "w1 w2"), (None, "w3")], "row_id long, sentence string")
    found = {(r["row_id"], r["feature"]): r["weight"] for r in grams.tfidf(df, GramSpec(2, 3, None), limit=limit).collect()}
    counts = {i: plain(t, 2, 3) for i, t in texts.items()} | {None: plain("w1 w2 w3", 2, 3)}
    seen = Counter(g for c in counts.values() for g in c)
    raw = {i: {g: n * (math.log(43 / (seen[g] + 1)) + 1) for g, n in c.items() if seen[g] >= 2} for i, c in counts.items()}
    wanted = {(i, g): w / math.sqrt(sum(v * v for v in r.values())) for i, r in raw.items() for g, w in r.items()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-9 for k in wanted)


def test_weights_are_made_where_texts_are_counted(spark):
    draw = random.Random(7)
    texts = [(i, " ".join(draw.choice(["ab", "abc", "\u00e9t\u00e9", "\U00020000b", "zz\x00"]) for _ in range(draw.choice([0, 3, 40])))) for i in range(60)]
    texts += [(3, "ab zz"), (None, "ab"), (None, "abc ab"), (61, None), (62, " ".join(f"w{draw.randrange(3000)}" for _ in range(120_000)))]
    df = spark.createDataFrame(texts, "row_id long, sentence string").repartition(3)
    spec = GramSpec(2, 5, None)
    made = grams.tfidf(df, spec)
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString()
    by_join = {(r["row_id"], r["feature"]): r for r in grams.tfidf(df, spec, limit=2000).collect()}
    found = {(r["row_id"], r["feature"]): r for r in made.collect()}
    assert found.keys() == by_join.keys() and made.count() == len(found)
    assert all(r["tf"] == by_join[k]["tf"] and abs(r["weight"] - by_join[k]["weight"]) < 1e-12 for k, r in found.items())
    largest = {(r["row_id"], r["feature"]): r["weight"] for r in grams.tfidf(df, spec, most=2).collect()}
    for i in {i for i, _ in found}:
        own = sorted((round(r["weight"], 6) for (j, _), r in found.items() if j == i), reverse=True)
        due = {k for k, r in found.items() if k[0] == i and round(r["weight"], 6) >= own[min(1, len(own) - 1)]}
        assert due <= {k for k in largest if k[0] == i}
    assert all(largest[k] == found[k]["weight"] for k in largest) and len(largest) < len(found)


def test_too_many_letters_are_looked_up_by_joins(spark):
    many = "".join(chr(0x4E00 + i) for i in range(5000))
    df = spark.createDataFrame([(1, many), (2, many), (3, "a b")], "row_id long, sentence string")
    kept = grams.document_counts(df, GramSpec(2, 5, None), "row_id").where("df > 1")
    assert grams.sent_vocabulary(kept.withColumn("v", F.lit(1.0)), "v", GramSpec(2, 5, None), 2**28) is None
    assert grams.tfidf(df, GramSpec(2, 5, None)).count() == 2 * kept.count()


def test_rounding_is_that_of_spark(spark):
    values = [0.5, 1.0, 0.1234565, 0.12345650000000001, 2.5e-07, 5e-07, -5e-07, -0.3333335, 1 / 3, 1e12 + 0.3, 1e300, float("nan"), None, 0.0, -1e-9, 4503599627.3704955]
    df = spark.createDataFrame([(v,) for v in values] + [(random.Random(i).random(),) for i in range(2000)], "x double")
    both = df.select(F.round("x", 6).alias("a"), "x").transform(lambda d: rounded_doubles(d, "x"))
    assert both.where(~F.col("a").eqNullSafe(F.col("x"))).count() == 0


def test_scoring_sends_no_occurrence_through_the_plan(spark):
    df = spark.createDataFrame([(1, "ab " * 500, "eng"), (2, "cd " * 500, "fra")], "row_id long, sentence string, lang string")
    model = naive_bayes.fit(df, GramSpec(portable=True))
    counted = model._counted(df, ["row_id"], "sentence").where(F.col("feature").isNotNull())
    assert counted.count() == 12 and counted.agg(F.sum("_tf")).first()[0] == 2 * 500 * 6
    assert [r["pred"] for r in model.predict(df).orderBy("row_id").collect()] == ["eng", "fra"]
