import pytest
from pyspark.sql import functions as F

from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import dual, linear, metrics, naive_bayes, prompts, stacked
from tongueprint.operators.scorers import ProfileDetector, PythonScorer
from tongueprint.plans import jobs, queries_models
from tongueprint.session import materialize
from tongueprint.sources import runs

WORDS = {"eng": "the cat and the dog", "fra": "le chat et le chien", "deu": "der hund und die katze"}


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i * 10 + k, f"{text} number {i}", lang) for i in range(12) for k, (lang, text) in enumerate(WORDS.items())]
    return spark.createDataFrame(rows, "row_id bigint, sentence string, lang string")


def sizes(data):
    train = {r["label"]: r["count"] for r in data.train.groupBy("label").count().collect()}
    test = {r["is_target"]: r["count"] for r in data.test.groupBy("is_target").count().collect()}
    return train, test


@pytest.mark.parametrize("caps, train, test", [
    ({}, {"lad": 8, "other": 5}, {True: 2, False: 2}),
    ({"n_train": 3}, {"lad": 3, "other": 3}, {True: 2, False: 2}),
    ({"n_neg": 1}, {"lad": 8, "other": 1}, {True: 2, False: 2}),
])
def test_detector_data_sizes(spark, codes, caps, train, test):
    schema = "row_id bigint, sentence string, lang string"
    positives = spark.createDataFrame([(i, f"p{i}", "lad") for i in range(10)], schema)
    background = spark.createDataFrame(
        [(100 + i, f"n{i}", "eng") for i in range(7)] + [(200, "own", "lad"), (201, None, "eng")], schema
    )
    data = jobs.detector_data(positives, background, "lad", codes, **caps)
    assert sizes(data) == (train, test)
    rows = [r["row_id"] for df in (data.train, data.test) for r in df.select("row_id").collect()]
    assert len(rows) == len(set(rows)) and not {200, 201} & set(rows)
    assert data.train.columns == ["row_id", "sentence", "label"]
    assert data.test.columns == ["row_id", "sentence", "lang", "is_target"]


@pytest.mark.parametrize("kind, settings", [("naive_bayes", {}), ("logreg", {}), ("linear_svm", {})])
def test_detectors_learn(corpus, codes, kind, settings):
    data = jobs.detector_data(corpus.where("lang = 'fra'"), corpus, "French", codes)
    model, scores = jobs.train_detector(data, codes, kind, **settings)
    row = scores.first()
    assert row["model"] == model.name and row["n"] == data.test.count() and row["f1"] == 1.0
    with pytest.raises(ValueError):
        jobs.train_detector(data, codes, "oracle")


def test_linear_models_tell_many_labels_apart(corpus):
    for train in (linear.train_logreg, linear.train_linear_svm):
        model = train(corpus, label_col="lang")
        preds = model.predict(corpus)
        assert metrics.accuracy(preds).first()[0] == 1.0
        assert preds.columns == ["row_id", "lang", "pred", "confidence", "raw_output"]
        sure = preds.agg(F.min("confidence")).first()[0]
        assert sure is None if train is linear.train_linear_svm else 1 / 3 < sure <= 1.0
        good = linear.optimality(model, "hinge" if sure is None else "logistic").collect()
        assert sorted(r["label"] for r in good) == ["deu", "eng", "fra"] and all(r["in_range"] and r["weights_match"] for r in good)


def test_linear_models_reach_the_optimum(spark, corpus):
    """One block or many: the same weights, and the ones that a dense solver finds."""
    import numpy as np

    train = corpus.where("lang <> 'deu'").withColumn("label", F.col("lang"))
    for fit, loss, tol, settings in ((linear.train_logreg, "logistic", 1e-2, {}), (linear.train_linear_svm, "hinge", 1e-3, {"alpha": 0.05})):
        models = [fit(train, lo=2, hi=3, block_entries=size, tol=tol, max_iter=80, **settings) for size in (10**9, 800)]
        values = []
        for model in models:
            row = linear.optimality(model, loss).first()
            assert row["in_range"] and row["weights_match"] and row["rows"] == 24
            assert row["gradient"] <= tol if loss == "logistic" else row["gap"] <= tol
            values.append(row["primal"])
        assert values[0] == pytest.approx(values[1], rel=2e-2)
        assert models[1].rows.agg(F.sum(F.size("ids"))).first()[0] > 800
        if loss == "logistic":
            rows = models[1].rows.orderBy("row_no").collect()
            places = {f: i for i, f in enumerate(sorted({f for r in rows for f in r["ids"]}))}
            x, y, c = np.zeros((len(rows), len(places))), np.array([1.0 if r["label"] else -1.0 for r in rows]), np.array([r["weight"] for r in rows])
            for i, r in enumerate(rows):
                x[i, [places[f] for f in r["ids"]]] = r["xs"]
            w, n = np.zeros(len(places)), len(rows)
            for _ in range(50):
                p = 1 / (1 + np.exp(y * (x @ w)))
                gradient = w / n - x.T @ (c * y * p) / n
                w -= np.linalg.solve(np.eye(len(w)) / n + (x * (c * p * (1 - p))[:, None]).T @ x / n, gradient)
            found = np.zeros(len(places))
            for r in models[1].solution.weights.collect():
                found[places[r["feature_id"]]] = r["w"][0]
            assert np.abs(found - w).max() < 0.1


def test_many_blocks_need_few_rounds(corpus):
    """The default tolerance of the logistic loss is met after a few rounds, although rows are dealt to several blocks."""
    train = corpus.where("lang <> 'deu'").withColumn("label", F.col("lang"))
    model = linear.train_logreg(train, lo=2, hi=3, block_entries=800, max_iter=8)
    row = linear.optimality(model, "logistic").first()
    assert row["in_range"] and row["weights_match"] and row["gradient"] <= 1e-4
    assert model.solution.certificate[0][1] < 8


def test_hinge_loss_needs_few_rounds_with_many_blocks(spark):
    """Rows beyond their margin are left out after the first round; the gap and the dual variables are still those of all rows."""
    import numpy as np

    draw = np.random.default_rng(1)
    true, rows = draw.normal(size=20), []
    for i in range(600):
        ids, xs = np.sort(draw.choice(20, 6, replace=False)), draw.normal(size=6)
        rows.append((i, int(xs @ true[ids] > 0), 1.0, ids.tolist(), (xs / np.linalg.norm(xs)).tolist()))
    table = spark.createDataFrame(rows, "row_no long, label int, weight double, ids array<bigint>, xs array<double>").repartition(4)
    found = dual.solve(materialize(table, "hinge-rows"), 2, "hinge", 1e-5, 600, 1e-4, 8, block_entries=600)
    w, a = np.zeros(20), np.zeros(600)
    for r in found.weights.collect():
        w[r["feature_id"]] = r["w"][0]
    duals = found.duals.collect()
    for r in duals:
        a[r["row_no"]] = r["a"][0]
    assert len(duals) == 600 and a.min() >= 0 and a.max() <= 1
    y, x = np.array([1.0 if r[1] else -1.0 for r in rows]), np.zeros((600, 20))
    for i, r in enumerate(rows):
        x[i, r[3]] = r[4]
    assert np.abs((a * y) @ x / (1e-5 * 600) - w).max() < 1e-6
    gap = 1e-5 * (w @ w) + np.maximum(0.0, 1 - y * (x @ w)).mean() - a.mean()
    assert -1e-12 <= gap <= 1e-4 and gap == pytest.approx(found.certificate[0][4], abs=1e-9)


def test_linear_models_keep_every_row(spark, corpus):
    model = linear.train_logreg(corpus.where("lang <> 'deu'").withColumn("label", F.col("lang")))
    odd = spark.createDataFrame([(1, "the cat", "a"), (1, "le chat", "a"), (1, "the cat", "a"), (None, None, "b"), (None, "", "b"), (2, "##", "c")], "row_id bigint, sentence string, lang string")
    found = sorted((str(r["row_id"]), r["lang"], r["pred"], round(r["confidence"], 6)) for r in model.predict(odd).collect())
    assert len(found) == 6 and len(set(found)) == 4 and {p for i, _, p, _ in found if i == "1"} == {"eng", "fra"}
    with pytest.raises(ValueError):
        linear.train_logreg(corpus.where("lang = 'deu'").withColumn("label", F.col("lang")))


def test_naive_bayes_agrees_with_ml(corpus, spark):
    """The table model takes the decisions of Spark's own naive Bayes on the same grams."""
    from pyspark.ml.classification import NaiveBayes
    from pyspark.ml.feature import HashingTF, StringIndexer

    grams = corpus.withColumn("grams", linear.gram_array(F.col("sentence"), 2, 4))
    vectors = HashingTF(inputCol="grams", outputCol="v", numFeatures=2**18).transform(grams)
    indexer = StringIndexer(inputCol="lang", outputCol="y", stringOrderType="alphabetAsc").fit(vectors)
    ready = indexer.transform(vectors)
    theirs = NaiveBayes(featuresCol="v", labelCol="y", smoothing=0.01).fit(ready).transform(ready).select("row_id", "prediction")
    ours = naive_bayes.fit(corpus).predict(corpus)
    both = ours.join(theirs, "row_id").collect()
    assert all(indexer.labels[int(r["prediction"])] == r["pred"] for r in both) and len(both) == 36


def test_evaluate_job(spark, codes, corpus, tmp_path):
    model = naive_bayes.fit(corpus, name="nb")
    result, picked = jobs.evaluate_job(corpus, model, codes, "my/set", str(tmp_path), n=4, shot=2, languages="English, fr", seed=1)
    held = {r["row_id"] for r in picked.collect()}
    used = {r["row_id"] for r in result.predictions.collect()}
    assert len(held) == 2 and not held & used and len(used) == 8
    assert result.overall.first()[:] == ("nb", 8, 2, 1.0, 1.0)
    assert {r["lang"] for r in result.per_language.collect()} == {"eng", "fra"}
    stored = runs.read_runs(spark, str(tmp_path)).first()
    assert stored["model"] == "nb-2shot" and stored["dataset"] == "my/set" and stored["n"] == 8
    kept = runs.read_predictions(spark, str(tmp_path), result.run_id)
    assert {"row_id", "sentence", "lang", "pred", "confidence", "raw_output"} <= set(kept.columns) and kept.count() == 8
    assert runs.published_log(spark, str(tmp_path)).first()["run_id"] == result.run_id
    whole, none = jobs.evaluate_job(corpus, model, codes, "d")
    assert whole.overall.first()["n"] == 36 and none.count() == 0


def test_sweep_notes_failures(spark, codes, corpus):
    def broken():
        raise RuntimeError("no such model")

    class Broken:
        name = "broken"

        def predict(self, df, **_):
            broken()

    result = jobs.sweep(corpus, {"nb": naive_bayes.fit(corpus), "broken": Broken()}, codes)
    assert result.failures == [("broken", "no such model")]
    assert jobs.failures_table(result, corpus).first()[:] == ("broken", "no such model")
    assert metrics.overall(result.predictions, ["model"]).first()[:] == ("nb", 36, 3, 1.0, 1.0)


def test_nb_model_sweep_fails_with_a_model(spark, tmp_path, monkeypatch):
    rows = [(i, lang, f"{text} number {i}") for i in range(40) for lang, text in (("eng", "the cat sat"), ("deu", "der Hund ist da"))]
    spark.createDataFrame([(2 * i + (lang == "deu"), lang, text) for i, lang, text in rows], "doc_id long, lang string, text string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    assert {r["model"] for r in queries_models.nb_model_sweep(spark, str(tmp_path)).collect()} == set(queries_models.SWEEP)
    predict = naive_bayes.NaiveBayesModel.predict

    def broken(self, *args, **settings):
        if self.name == "trigrams":
            raise RuntimeError("no room left")
        return predict(self, *args, **settings)

    def fails(*_, **__):
        raise RuntimeError("not together")

    monkeypatch.setattr(naive_bayes.NaiveBayesModel, "predict", broken)
    monkeypatch.setattr(stacked, "predict_many", fails)
    with pytest.raises(RuntimeError, match="trigrams: no room left"):
        queries_models.nb_model_sweep(spark, str(tmp_path))


def test_python_scorer_isolates_failures(spark, corpus):
    def load():
        def run(texts):
            if any("number 3" in t for t in texts):
                raise ValueError("bad text")
            return [("eng", 0.5, t[:3]) for t in texts]

        return run

    rows = {r["row_id"]: r for r in PythonScorer(load).predict(corpus).collect()}
    bad = [r for r in rows.values() if r["pred"] == "und"]
    assert len(rows) == 36 and {r["row_id"] // 10 for r in bad} == {3}
    assert all(r["confidence"] is None and r["raw_output"] == "bad text" for r in bad)
    wrong = PythonScorer(lambda: lambda texts: []).predict(corpus)
    assert wrong.where("pred <> 'und'").count() == 0 and wrong.count() == 36


def test_add_language(spark, codes, corpus):
    base = naive_bayes.fit(corpus.where("lang <> 'deu'"))
    more = jobs.add_language(base, corpus.where("lang = 'deu'"))
    assert sorted(more.counts.collect()) == sorted(naive_bayes.fit(corpus).counts.collect())
    report = jobs.before_after(metrics.per_language(base.predict(corpus), codes), metrics.per_language(more.predict(corpus), codes))
    german = report.where("lang = 'deu'").first()
    assert german["f1_before"] == 0.0 and german["f1_after"] == 1.0 and german["support_after"] == 12


def test_train_multilingual(codes, corpus):
    split = corpus.withColumn("split", F.when(F.col("row_id") < 60, "train").otherwise("dev"))
    model = jobs.train_multilingual(split)
    assert model.classes.agg(F.sum("n_rows")).first()[0] == 18
    assert metrics.accuracy(model.predict(split.where("split = 'dev'"))).first()[0] == 1.0
    assert ProfileDetector(model).predict(split).count() == 36


def test_prompts(spark):
    df = spark.createDataFrame([(1, "bonjour")], "row_id int, sentence string")
    turns = prompts.prompt_table(df, [("hello", "eng")]).first()["messages"]
    assert [t["role"] for t in turns] == ["system", "user", "assistant", "user"]
    assert turns[1]["content"] == "Text:\nhello\n\nISO 639-3 code:" and turns[2]["content"] == "eng"
    assert turns[3]["content"] == "Text:\nbonjour\n\nISO 639-3 code:"
    assert "ISO 639-3" in turns[0]["content"]
    many = prompts.prompt_table(df, [(f"x{i}", "eng") for i in range(40)]).first()["messages"]
    assert len(many) == 82 and many[79]["content"] == "Text:\nx39\n\nISO 639-3 code:"
    assert prompts.run_label("m", 0) == "m" and prompts.run_label("m", 2) == "m-2shot"


RESPONSES = [
    ("eng", "eng"), (" eng ", "eng"), ("eng.", "eng"), ('"eng."', "eng"), ("Standard Arabic.", "arb"), ("eng because of the words", "eng"),
    ('"eng".', "und"), ("", "und"), (None, "und"), ("`fra`", "fra"), ("```\nfra\n```", "und"), ("'German'!", "und"), ("German!?", "deu"), ("...", "und"),
]


def test_parse_responses(spark, codes):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(RESPONSES)], "i int, raw_output string")
    got = [r["pred"] for r in prompts.parse_responses(df, codes).orderBy("i").collect()]
    want = [code for _, code in RESPONSES]
    want[10] = "fra"  # the line breaks inside the backticks are stripped too
    assert got == want
