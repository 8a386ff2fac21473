import pytest
from pyspark.sql import functions as F

from tongueprint.functions.hashing import GramSpec
from tongueprint.operators import naive_bayes
from tongueprint.streaming import incremental
from tongueprint.streaming.incremental import BATCH, LatestModel, commit, snapshot, write_batch

SCHEMA = "row_id bigint, sentence string, lang string, tags map<string,int>"
ROWS = [(i, f"{'the cat' if i % 3 else 'le chat'} {i}", "eng" if i % 3 else "fra", {"n": i}) for i in range(30)]


def land(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))


@pytest.fixture()
def landing(spark, tmp_path):
    for part in range(3):
        land(spark, ROWS[part * 10:part * 10 + 10], tmp_path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    return stream, tmp_path


def tables(model):
    return sorted(model.counts.collect()), sorted(model.classes.collect())


def whole(spark, rows, spec=GramSpec()):
    return tables(naive_bayes.fit(spark.createDataFrame(rows, SCHEMA), spec))


@pytest.mark.parametrize("spec", [GramSpec(), GramSpec(buckets=None)])
def test_streamed_counts_equal_batch_counts(spark, landing, spec):
    stream, path = landing
    root = str(path / "m")
    incremental.count_stream(stream, root, str(path / "cp"), spec).awaitTermination()
    assert len(snapshot(spark, root).batches) == 3
    assert tables(incremental.streamed_model(spark, root, spec)) == whole(spark, ROWS, spec)
    # After compaction, new files only add; a second compaction needs nothing but the first and what came after it.
    first = incremental.compact(spark, root, spec)
    assert tables(first) == whole(spark, ROWS, spec) == tables(incremental.compact(spark, root, spec))
    more = [(100 + i, "der hund", "deu", None) for i in range(4)]
    land(spark, more, path)
    incremental.count_stream(stream, root, str(path / "cp"), spec).awaitTermination()
    seen = snapshot(spark, root)
    assert list(seen.batches) == [3] and seen.covers == 2
    assert tables(incremental.streamed_model(spark, root, spec)) == whole(spark, ROWS + more, spec)
    assert tables(incremental.streamed_model(spark, root, spec, last=2)) == whole(spark, ROWS, spec)
    assert tables(incremental.compact(spark, root, spec)) == whole(spark, ROWS + more, spec)


def test_a_crash_between_two_writes(spark, landing, monkeypatch):
    """Counts without a record are not read; the replay writes and records them once."""
    stream, path = landing
    root, checkpoint = str(path / "m"), str(path / "cp")
    real = naive_bayes.class_rows

    def broken(batch, *rest):
        if batch.count() and batch.where("row_id = 15").count():
            raise RuntimeError("lost")
        return real(batch, *rest)

    monkeypatch.setattr(naive_bayes, "class_rows", broken)
    with pytest.raises(Exception, match="lost"):
        incremental.count_stream(stream, root, checkpoint).awaitTermination()
    done = len(snapshot(spark, root).batches)
    assert done < 3 and len(list((path / "m" / "data").iterdir())) == done + 1
    monkeypatch.undo()
    incremental.count_stream(stream, root, checkpoint).awaitTermination()
    assert tables(incremental.streamed_model(spark, root)) == whole(spark, ROWS)


def test_a_recorded_batch_counts_once_when_replayed(spark, landing):
    stream, path = landing
    root = str(path / "m")
    incremental.count_stream(stream, root, str(path / "cp")).awaitTermination()
    # A new checkpoint sends batches 0 to 2 again; so does it after they were compacted.
    incremental.count_stream(stream, root, str(path / "cp2")).awaitTermination()
    assert tables(incremental.compact(spark, root)) == whole(spark, ROWS)
    incremental.count_stream(stream, root, str(path / "cp3")).awaitTermination()
    assert tables(incremental.streamed_model(spark, root)) == whole(spark, ROWS)


def test_a_batch_that_lands_during_compaction(spark, landing, monkeypatch):
    stream, path = landing
    root = str(path / "m")
    incremental.count_stream(stream, root, str(path / "cp")).awaitTermination()
    late = [(200, "il gatto", "ita", None)]
    real = incremental.model_of

    def slow(session, seen, *rest):
        if 3 not in snapshot(spark, root).batches and not snapshot(spark, root).compacted:
            batch = spark.createDataFrame(late, SCHEMA)
            commit(spark, root, BATCH, 3, write_batch(batch, 3, root, GramSpec()))
        return real(session, seen, *rest)

    monkeypatch.setattr(incremental, "model_of", slow)
    assert tables(incremental.compact(spark, root)) == whole(spark, ROWS)
    monkeypatch.undo()
    assert list(snapshot(spark, root).batches) == [3]
    assert tables(incremental.streamed_model(spark, root)) == whole(spark, ROWS + late)


def test_nothing_to_compact(spark, tmp_path):
    commit(spark, str(tmp_path), "start", -1, "")
    with pytest.raises(ValueError):
        incremental.compact(spark, str(tmp_path))
    assert tables(incremental.streamed_model(spark, str(tmp_path))) == ([], [])


def test_labelled_stream_equals_batch(spark, landing, monkeypatch):
    """All columns stay, of any type, and the gains are tabled once for all batches."""
    stream, path = landing
    df = spark.createDataFrame(ROWS, SCHEMA)
    model = naive_bayes.fit(df)
    written = []
    monkeypatch.setattr(naive_bayes, "materialize", lambda frame, label, real=naive_bayes.materialize: written.append(label) or real(frame, label))
    incremental.label_stream(stream, model, str(path / "out"), str(path / "cp")).awaitTermination()
    assert written == ["nb-gains"]
    out = spark.read.parquet(str(path / "out")).drop("batch_id")
    assert set(out.columns) == {"row_id", "sentence", "lang", "tags", "pred", "confidence", "raw_output"}
    rounded = [sorted((r["row_id"], r["lang"], r["pred"], round(r["confidence"], 9)) for r in x.collect()) for x in (out, model.predict(df))]
    assert rounded[0] == rounded[1] and len(rounded[0]) == 30
    assert all(r["tags"] == {"n": r["row_id"]} and r["sentence"].endswith(str(r["row_id"])) for r in out.collect())
    assert out.where(F.col("pred") == F.col("lang")).count() == 30


def test_the_model_changes_between_batches(spark, landing):
    stream, path = landing
    root = str(path / "m")
    incremental.count_stream(stream, root, str(path / "cp")).awaitTermination()
    latest = LatestModel(root)
    with pytest.raises(ValueError):
        latest.current(spark)
    incremental.compact(spark, root)
    before = latest.current(spark)
    assert latest.current(spark) is before
    land(spark, [(300 + i, "der hund bellt", "deu", None) for i in range(9)], path)
    incremental.count_stream(stream, root, str(path / "cp")).awaitTermination()
    assert latest.current(spark) is before
    incremental.compact(spark, root)
    after = latest.current(spark)
    asked = spark.createDataFrame([(1, "der hund", "deu", None)], SCHEMA)
    assert after is not before and after.predict(asked).first()["pred"] == "deu" != before.predict(asked).first()["pred"]
