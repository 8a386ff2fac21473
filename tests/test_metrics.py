import random

import pytest
from pyspark.sql import functions as F

from tongueprint.operators import distribution, metrics

PREDS = "lang string, pred string"


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([("eng", "eng"), ("eng", "fra"), ("fra", "fra"), ("deu", "und")], PREDS)


def test_per_language_by_hand(small, codes):
    rows = {r["lang"]: r for r in metrics.per_language(small, codes).collect()}
    assert set(rows) == {"deu", "eng", "fra"}
    assert rows["deu"][1:] == ("German", 1, 0.0, 0.0, 0.0)
    assert rows["eng"][1:] == pytest.approx(("English", 2, 0.5, 1.0, 2 / 3))
    assert rows["fra"][1:] == pytest.approx(("French", 1, 1.0, 0.5, 2 / 3))


def test_overall_by_hand(small):
    assert metrics.overall(small).first()[:] == pytest.approx((4, 3, 0.5, 4 / 9))
    assert metrics.accuracy(small).first()[0] == 0.5
    assert metrics.macro_f1(small).first()[0] == pytest.approx(0.444444, abs=1e-6)


def test_empty_input_scores_zero(small):
    none = small.where("false")
    assert metrics.overall(none).first()[:] == (0, 0, 0.0, 0.0)
    assert metrics.accuracy(none).first()[0] == 0.0


def test_classification_report_by_hand(small):
    rows = {r["label"]: r[1:] for r in metrics.classification_report(small).collect()}
    assert rows["und"] == (0.0, 0.0, 0.0, 0)
    assert rows["accuracy"] == (None, None, 0.5, 4)
    assert rows["macro avg"][2] == pytest.approx(0.333333, abs=1e-6)
    assert rows["weighted avg"] == pytest.approx(((1.0 * 2 + 0.5) / 4, (0.5 * 2 + 1) / 4, (2 / 3 * 2 + 2 / 3) / 4, 4))
    assert len(rows) == 7


def test_classification_report_of_some_labels(small):
    rows = {r["label"]: r[1:] for r in metrics.classification_report(small, ["eng", "kab"]).collect()}
    assert set(rows) == {"eng", "kab", "micro avg", "macro avg", "weighted avg"}
    assert rows["micro avg"] == pytest.approx((1.0, 0.5, 2 / 3, 2))
    assert rows["kab"] == (0.0, 0.0, 0.0, 0)
    everything = metrics.classification_report(small, ["deu", "eng", "fra", "und", "kab"]).collect()
    assert "accuracy" in {r["label"] for r in everything}


def test_confusion_grid_by_hand(small):
    grid = metrics.confusion_grid(small)
    assert grid.columns == ["lang", "deu", "eng", "fra", "und"]
    cells = metrics.confusion_cells(small).collect()
    assert len(cells) == 12 and sum(r["n"] for r in cells) == 4
    assert {(r["lang"], r["pred"]): r["n"] for r in cells}[("deu", "und")] == 1


def test_confusion_grid_of_named_columns(small):
    grid = metrics.confusion_grid(small, ["fra", "zzz"])
    assert grid.columns == ["lang", "fra", "zzz"] and grid.count() == 3
    assert all(r["zzz"] == 0 for r in grid.collect())


def test_confusion_cells_of_many_labels(spark):
    gold, said = 3, 5000
    rows = [(f"g{i % gold}", f"p{i:05d}") for i in range(said)] + [("g0", "p00000"), (None, "p1"), ("g1", None)]
    cells = metrics.confusion_cells(spark.createDataFrame(rows, PREDS))
    assert "Pivot" not in cells._jdf.queryExecution().optimizedPlan().toString()
    found = {(r["lang"], r["pred"]): r["n"] for r in cells.collect()}
    assert len(found) == gold * (said + gold)
    assert found["g0", "p00000"] == 2 and found["g1", "p00000"] == 0 and sum(found.values()) == said + 1
    assert metrics.confusion_cells(spark.createDataFrame([], PREDS)).count() == 0


def test_missing_prediction_counts_as_a_miss(spark, codes):
    df = spark.createDataFrame([("eng", None), ("eng", "en")], PREDS)
    assert metrics.overall(df).first()[:2] == (2, 1)
    fixed = metrics.normalize_predictions(df, codes)
    assert sorted(r["pred"] for r in fixed.collect()) == ["eng", "und"]


def test_random_predictions_match_plain_counting(spark, codes):
    rng = random.Random(11)
    labels = ["eng"] * 10 + ["fra", "deu", "spa", "kab", "lad"]
    rows = [(rng.choice(labels), rng.choice(labels + ["und"])) for _ in range(2000)]
    df = spark.createDataFrame(rows, PREDS).repartition(8)
    for r in metrics.per_language(df, codes).collect():
        gold = [p for g, p in rows if g == r["lang"]]
        hits, said = gold.count(r["lang"]), sum(p == r["lang"] for _, p in rows)
        assert r["support"] == len(gold)
        assert (r["recall"], r["precision"]) == pytest.approx((hits / len(gold), hits / said))
    total = metrics.overall(df).first()
    assert total["accuracy"] == pytest.approx(sum(g == p for g, p in rows) / 2000)
    assert metrics.label_scores(metrics.pair_counts(df)).agg(F.sum("support"), F.sum("hits")).first()[0] == 2000


def test_worst_and_confusions(small):
    pairs = metrics.pair_counts(small)
    worst = metrics.worst_languages(pairs, 2, 1).collect()
    assert [(r["rank"], r["lang"]) for r in worst] == [(1, "deu"), (2, "eng")]
    eng = metrics.confusions_of(pairs, "eng").collect()
    assert [(r["pred"], r["n"], r["share"], r["is_correct"]) for r in eng] == [("eng", 1, 0.5, True), ("fra", 1, 0.5, False)]
    assert metrics.confusions_of(pairs, "kab").count() == 0
    found = metrics.batch_diagnosis(pairs, 1, 1, 5).collect()
    assert [(r["lang"], r["pred"], r["total"]) for r in found] == [("deu", "und", 1)]


def test_detector_scores(spark, codes):
    df = spark.createDataFrame([("fr", True), ("fra", False), ("other", True), ("other", False)], "pred string, is_target boolean")
    assert metrics.detector_scores(df, "fra", codes=codes).first()[:] == (4, 0.5, 0.5, 0.5, 0.5)
    assert metrics.detector_scores(df.where("pred = 'other'"), "fra").first()[1:4] == (0.0, 0.0, 0.0)


def test_distributions(spark):
    a = spark.createDataFrame([("eng", 3), ("fra", 1)], "lang string, rows bigint")
    b = spark.createDataFrame([("eng", 1), ("kab", 1)], "lang string, rows bigint")
    rows = [r[:] for r in distribution.compare_distributions(a, b, ("A", "B")).collect()]
    assert rows == [
        ("eng", 1.25, "A", 3, 0.75), ("eng", 1.25, "B", 1, 0.5), ("kab", 0.5, "A", 0, 0.0), ("kab", 0.5, "B", 1, 0.5),
        ("fra", 0.25, "A", 1, 0.25), ("fra", 0.25, "B", 0, 0.0),
    ]
    assert {r[:] for r in distribution.label_sets(a, b).collect()} == {("eng", "both"), ("fra", "first"), ("kab", "second")}
    assert [r[0] for r in distribution.shared_labels(a, b).collect()] == ["eng"]
    assert [r[0] for r in distribution.labels_only_in(b, a).collect()] == ["kab"]
    hist = spark.createDataFrame([("eng", 3), ("eng", 4)], "lang string, sentence bigint")
    assert distribution.merge_histogram(hist).first()[:] == ("eng", 7)
