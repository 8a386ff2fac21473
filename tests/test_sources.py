import pytest
from pyspark.sql import functions as F

from tongueprint.sources import corpus


def test_layouts(spark, codes, tmp_path):
    bench = spark.createDataFrame([("hello", "en", 1), ("x", None, 2)], "text string, tag string, line_id int")
    bench.write.parquet(str(tmp_path / "bench"))
    rows = corpus.read_benchmark(spark, str(tmp_path / "bench"), codes).orderBy("line_id").collect()
    assert [(r["sentence"], r["lang"], r["line_id"]) for r in rows] == [("hello", "eng", 1), ("x", "und", 2)]
    train = spark.createDataFrame([("a", "fr", "train"), ("b", "nan", "dev")], "sentence string, lang string, split string")
    corpus.write_corpus(train, str(tmp_path / "train"))
    dev = corpus.read_training(spark, str(tmp_path / "train"), codes, "dev")
    assert [(r["sentence"], r["lang"]) for r in dev.collect()] == [("b", "nan")]
    assert "PartitionFilters: [isnotnull(split" in dev._jdf.queryExecution().toString()


@pytest.mark.parametrize("fmt, body", [
    ("csv", "id,body,code\n1,\"a, b\",nan\n2,c,English\n"), ("tsv", "id\tbody\tcode\n1\ta, b\tnan\n2\tc\tEnglish\n"),
    ("json", '{"id": 1, "body": "a, b", "code": "nan"}\n{"id": 2, "body": "c", "code": "English"}\n'),
])
def test_own_tables(spark, codes, tmp_path, fmt, body):
    path = tmp_path / f"t.{fmt}"
    path.write_text(body)
    rows = corpus.read_corpus(spark, str(path), codes, "code", "body", fmt).orderBy("id").collect()
    assert [(r["sentence"], r["lang"]) for r in rows] == [("a, b", "nan"), ("c", "eng")]
    single = corpus.read_single_language(spark, str(path), codes, "Ladino", "body", fmt)
    assert {r["lang"] for r in single.collect()} == {"lad"} and sorted(single.columns) == ["code", "id", "lang", "sentence"]


def test_clashing_and_missing_columns(spark, codes):
    df = spark.createDataFrame([("x", "en", "fr")], "sentence string, tag string, lang string")
    with pytest.raises(ValueError, match="lang"):
        corpus.labelled_corpus(df, codes)
    with pytest.raises(ValueError, match="nope"):
        corpus.labelled_corpus(df, codes, "nope")
    with pytest.raises(ValueError, match="sentence"):
        corpus.custom_corpus(lambda s: df.drop("sentence"), spark, codes)
    assert corpus.custom_corpus(lambda s: df.drop("tag"), spark, codes).first()["lang"] == "fra"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "one.txt").write_text(" first \n\n\t\nsecond\x0cthird\nfirst line\n", encoding="utf-8")
    (tmp_path / "a" / "b" / "two.txt").write_text("drei\n" * 5, encoding="utf-8")
    (tmp_path / "a" / "skip.md").write_text("no\n")
    return str(tmp_path)


def test_lines(spark, codes, folder):
    lines = corpus.read_lines(spark, folder, codes, "German")
    assert sorted(r["sentence"] for r in lines.collect()) == sorted([" first ", "second", "third", "first line"] + ["drei"] * 5)
    assert {r["lang"] for r in lines.collect()} == {"deu"}
    assert corpus.read_lines(spark, folder, codes, "de", drop_blank=False).count() == 11


def test_lines_get_ids_by_place(spark, codes, folder):
    def read(**more):
        return corpus.read_lines(spark, folder, codes, "deu", id_col="row_id", **more)

    first = sorted((r["row_id"], r["sentence"]) for r in read().collect())
    assert first == sorted((r["row_id"], r["sentence"]) for r in read().collect()) and len({i for i, _ in first}) == 9
    assert read(drop_blank=False).select("row_id").distinct().count() == 11
    assert read().columns == ["row_id", "file", "sentence", "lang"]
    assert "Exchange" not in read()._jdf.queryExecution().executedPlan().toString()
    assert [r["sentence"] for r in corpus.read_lines(spark, f"{folder}/a*/*", codes, "deu", glob="tw*.txt").collect()] == ["drei"] * 5
    assert read(glob="*.none").count() == 0


def test_rows_get_ids_by_place(spark, codes, tmp_path):
    rows = [(None, "en"), ("same", "en"), ("same", "en"), ("b", "fr")]
    frame = spark.createDataFrame(rows, "body string, code string").repartition(2)
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        frame.write.format(fmt).save(path)
        df = corpus.read_corpus(spark, path, codes, "code", "body", fmt, id_col="row_id")
        ids = [r["row_id"] for r in df.collect()]
        assert len(set(ids)) == 4 and sorted(ids) == sorted(r["row_id"] for r in df.select("row_id", "lang").collect())
    with pytest.raises(ValueError, match="Body"):
        corpus.read_table(spark, path, "orc", id_col="Body")


def test_copies_get_stable_ids(spark, codes, folder):
    def ids(parts):
        lines = corpus.read_lines(spark, folder, codes, "deu").repartition(parts)
        return sorted((r["row_id"], r["sentence"]) for r in corpus.number_copies(lines, chunk=2).collect())

    assert ids(1) == ids(8)
    assert len({i for i, _ in ids(1)}) == 9


def test_histogram(spark, tmp_path):
    (tmp_path / "h.csv").write_text("lang,sentence\nde,3\nnan,4\n")
    assert [r[:] for r in corpus.read_histogram(spark, str(tmp_path / "h.csv")).collect()] == [("de", 3), ("nan", 4)]
