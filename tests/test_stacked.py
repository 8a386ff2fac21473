"""Models fitted and scored in one pass against the same models one by one."""

from pyspark.sql import functions as F

from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import naive_bayes, stacked
from tongueprint.plans import jobs

SPECS = {
    "two": GramSpec(2, 2, None), "wide": GramSpec(2, 4, None), "long": GramSpec(4, 5, None), "hashed": GramSpec(3, 4, 97),
    "portable": GramSpec(1, 3, 64, portable=True),
}
ROWS = "row_id int, lang string, sentence string"
TEXTS = [
    (1, "eng", "the cat sat on a mat"), (2, "eng", "a dog is a dog"), (3, "deu", "der Hund ist da"), (4, "deu", "ein Tag im Mai"),
    (5, "fra", "le chat est là"), (6, None, "x y z"), (7, "fra", None), (8, "eng", ""), (9, "deu", "  \n "), (10, "zho", "猫 在 𠀀𠀀𠀀"),
    (11, "eng", "a dog is a dog"), (11, "eng", "a dog is a dog"), (11, "eng", "another text"), (None, "fra", "le jour"),
]


def rows_of(df):
    return sorted(
        ((r["row_id"] or 0, r["lang"] or "", r["pred"], round(r["confidence"], 9)) for r in df.collect()), key=repr
    )


def test_counts_equal_those_of_single_fits(spark):
    train = spark.createDataFrame(TEXTS, ROWS)
    for specs in (SPECS, {"hashed": SPECS["hashed"]}, {k: SPECS[k] for k in ("hashed", "portable")}, {"long": SPECS["long"]}):
        for name, model in stacked.fit_many(train, specs).items():
            alone = naive_bayes.fit(train, specs[name])
            assert sorted(map(repr, model.counts.collect())) == sorted(map(repr, alone.counts.collect())), name
            assert model.counts.schema["feature"].dataType == alone.counts.schema["feature"].dataType
            assert sorted(map(repr, model.classes.collect())) == sorted(map(repr, alone.classes.collect()))


def test_predictions_equal_those_of_single_models(spark):
    df = spark.createDataFrame(TEXTS, ROWS)
    models = stacked.fit_many(df.where("lang is not null"), SPECS)
    few = naive_bayes.fit(df.where("lang in ('eng', 'deu')"), GramSpec(1, 2, None), alpha=0.5)
    models = {**models, "few": few}
    for settings in ({}, {"label_block": 2}, {"broadcast_limit": models["two"].dense_bytes()}):
        got = stacked.predict_many(models, df, **settings).cache()
        assert got.count() == len(TEXTS) * len(models)
        for name, model in models.items():
            assert rows_of(got.where(F.col("model") == name)) == rows_of(model.predict(df)), (name, settings)


def test_one_scan_of_the_texts(spark, tmp_path):
    df = spark.createDataFrame(TEXTS, ROWS)
    models = stacked.fit_many(df.where("lang is not null"), SPECS)
    df.write.parquet(str(tmp_path / "t"))
    plan = stacked.predict_many(models, spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan()
    scans = plan.toString().count("FileScan")
    assert scans == 2  # the texts and the gains


def test_no_model_no_rows(spark, codes):
    df = spark.createDataFrame(TEXTS, ROWS)
    assert stacked.fit_many(df, {}) == {}
    models = stacked.fit_many(df.where("lang is not null"), {"two": SPECS["two"]})
    assert stacked.predict_many(models, df.limit(0)).count() == 0
    untrained = stacked.fit_many(df.limit(0), {"none": SPECS["two"]})
    result = jobs.sweep(df, {**models, **untrained}, codes)
    assert {r["model"]: (r["n_rows"], r["error"]) for r in jobs.outcomes(result, df).collect()} == {
        "two": (len(TEXTS), None), "none": (0, "the model has no label"),
    }
