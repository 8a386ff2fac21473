import json

import pytest
from pyspark.sql import functions as F

from tongueprint.operators import compare
from tongueprint.sources import runs

STAMP = "20240102_T030405"


def preds_of(spark, pairs):
    return spark.createDataFrame([(i, g, p) for i, (g, p) in enumerate(pairs)], "row_id bigint, lang string, pred string")


GOOD = [("eng", "eng"), ("eng", "eng"), ("fra", "fra"), ("deu", "deu")]
POOR = [("eng", "eng"), ("eng", "fra"), ("fra", "fra"), ("deu", "und")]


@pytest.fixture(scope="module")
def saved(spark, codes, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("results"))
    for model, pairs, stamp in (("A", GOOD, "20240101_T000000"), ("B", POOR, STAMP), ("C", POOR[:3], STAMP)):
        runs.save_run(root, preds_of(spark, pairs), codes, model, "my/data", timestamp=stamp)
    return root


def test_round_trip(spark, saved):
    stored = runs.load_runs(runs.read_runs(spark, saved))
    rows = stored.collect()
    assert [r["run_id"] for r in rows] == [f"A_my_data_20240101_T000000", f"C_my_data_{STAMP}", f"B_my_data_{STAMP}"]
    assert rows[0]["accuracy"] == 1.0 and rows[2]["macro_f1"] == pytest.approx(4 / 9)
    assert [p["lang"] for p in rows[2]["per_language"]] == ["deu", "eng", "fra"]
    assert rows[2]["per_language"][1]["name"] == "English"
    preds = spark.read.parquet(f"{saved}/predictions").where(F.col("run_id") == rows[2]["run_id"])
    assert preds.count() == 4


def test_saving_again_replaces_one_run(spark, codes, saved):
    before = runs.read_runs(spark, saved).count()
    runs.save_run(saved, preds_of(spark, POOR), codes, "B", "my/data", timestamp=STAMP)
    assert runs.read_runs(spark, saved).count() == before
    table = runs.runs_table(preds_of(spark, POOR).withColumn("model", F.lit("B")), codes, "my/data", STAMP)
    runs.save_runs(saved, table)
    assert runs.read_runs(spark, saved).count() == before


def test_discover_and_pick(spark, saved):
    stored = runs.read_runs(spark, saved)
    by_name = [r[0] for r in runs.discover_runs(stored).collect()]
    assert by_name == sorted(by_name, reverse=True)
    assert [r[0] for r in runs.discover_runs(stored, by="timestamp").collect()][-1].startswith("A_")
    assert runs.load_run(stored, by_name[0]).count() == 1
    assert runs.load_runs(stored, dataset="elsewhere").count() == 0
    with pytest.raises(ValueError, match="nope"):
        runs.load_run(stored, "nope")


def test_json_runs_and_defaults(spark, codes, tmp_path):
    root = tmp_path / "results"
    (root / "full_x_1").mkdir(parents=True)
    per = [{"lang": "nan", "name": "Min Nan Chinese", "support": 2, "recall": 0.5, "precision": 1.0, "f1": 0.6}]
    full = {"model": "m", "n": 9, "n_languages": 1, "accuracy": 0.5, "macro_f1": 0.6, "dataset": "d", "timestamp": STAMP, "per_language": per}
    (root / "full_x_1" / "metrics.json").write_text(json.dumps(full, indent=2))
    (root / "bare_x_2").mkdir()
    (root / "bare_x_2" / "metrics.json").write_text(json.dumps({"per_language": per * 2}))
    rows = {r["run_id"]: r for r in runs.load_runs(runs.read_json_runs(spark, str(root))).collect()}
    assert list(rows) == ["full_x_1", "bare_x_2"]
    bare = rows["bare_x_2"]
    assert (bare["model"], bare["dataset"], bare["timestamp"], bare["n"], bare["n_languages"]) == ("bare", "", "", 2, 1)
    assert bare["macro_f1"] != bare["macro_f1"]
    assert rows["full_x_1"]["per_language"][0]["lang"] == "nan"
    table = runs.runs_table(preds_of(spark, GOOD).withColumn("model", F.lit("Z")), codes, "d", STAMP)
    runs.export_run_json(table, str(root), f"Z_d_{STAMP}")
    again = runs.read_json_runs(spark, str(root)).where(f"run_id = 'Z_d_{STAMP}'").first()
    assert (again["model"], again["accuracy"], len(again["per_language"])) == ("Z", 1.0, 3)


def test_run_log(spark, codes, tmp_path):
    table = runs.runs_table(preds_of(spark, GOOD).withColumn("model", F.lit("Z")), codes, "a/b", STAMP)
    for _ in range(2):
        runs.append_run_log(table, str(tmp_path / "runs.jsonl"))
    log = runs.read_run_log(spark, str(tmp_path / "runs.jsonl")).collect()
    assert len(log) == 2 and log[0]["run_id"] == f"Z_a_b_{STAMP}" and log[0]["n"] == 4


def table_of(spark, codes, **models):
    stacked = None
    for name, (dataset, pairs) in models.items():
        one = runs.runs_table(preds_of(spark, pairs).withColumn("model", F.lit(name)), codes, dataset, STAMP)
        stacked = one if stacked is None else stacked.unionByName(one)
    return stacked


def warnings(table):
    return sorted((r["run_id"].split("_")[0], r["check"]) for r in compare.check_comparable(table).collect())


def test_comparable(spark, codes):
    same = table_of(spark, codes, A=("d", GOOD), B=("d", POOR))
    assert warnings(same) == []
    assert warnings(table_of(spark, codes, A=("d", GOOD))) == []
    assert warnings(table_of(spark, codes, A=("d", GOOD), C=("d", POOR + [("eng", "und")]))) == [("*", "n"), ("C", "support")]
    other = [("eng", "fra"), ("eng", "eng"), ("fra", "fra"), ("fra", "und")]
    assert warnings(table_of(spark, codes, A=("d", GOOD), D=("d", other))) == [("D", "languages")]
    assert warnings(table_of(spark, codes, A=("d", GOOD), B=("e", POOR))) == [("*", "dataset")]


def test_pivot_averages_repeated_labels(spark, codes):
    first = table_of(spark, codes, A=("d", GOOD))
    second = table_of(spark, codes, A=("e", POOR + [("eng", "eng")]), B=("e", POOR))
    long = compare.per_language_long(first.unionByName(second))
    rows = {r["lang"]: r for r in compare.per_language_pivot(long, compare.model_labels(long)).collect()}
    assert rows["deu"]["A"] == 0.5 and rows["deu"]["B"] == 0.0
    assert rows["eng"]["support"] == 3
    assert list(rows)[0] == "eng"
    gap = compare.disagreement(long, "f1", 1).collect()
    assert len(gap) == 1 and gap[0]["spread"] == pytest.approx(max(abs(r["A"] - r["B"]) for r in rows.values()))
    with pytest.raises(ValueError):
        compare.disagreement(compare.per_language_long(first))
    with pytest.raises(ValueError):
        compare.per_language_pivot(long, ["A"], "bleu")


def test_overview_puts_missing_scores_last(spark):
    df = spark.createDataFrame(
        [("a", "d", 1, 1, 0.1, float("nan"), "r1"), ("b", "d", 1, 1, 0.1, 0.2, "r2"), ("c", "d", 1, 1, 0.1, None, "r3"), ("e", "d", 1, 1, 0.1, 0.9, "r4")],
        "model string, dataset string, n bigint, n_languages bigint, accuracy double, macro_f1 double, run_id string",
    )
    assert [r["run_id"] for r in compare.overview(df).collect()] == ["r4", "r2", "r1", "r3"]


def test_wins_and_alignment(spark):
    a, b = preds_of(spark, GOOD), preds_of(spark, POOR)
    assert compare.model_wins(a, b, "deu").first()[:] == (1, 1, 1.0)
    assert compare.model_wins(a, b, "eng").first()[:] == (1, 2, 0.5)
    other = b.select("row_id", F.col("pred").alias("_other"))
    assert compare.aligned(a, other).count() == 4
    for broken in (other.where("row_id > 0"), other.unionByName(other.limit(1)), other.withColumn("row_id", F.col("row_id") + 1)):
        with pytest.raises(Exception, match="1:1"):
            compare.aligned(a, broken).collect()


def test_pages(spark):
    df = spark.createDataFrame([(x, i) for i, x in enumerate("abcde")], "lang string, support int")
    assert {r["lang"]: r["page"] for r in compare.pages(df, 2, "-support", "lang").collect()} == {"e": 0, "d": 0, "c": 1, "b": 1, "a": 2}
