"""Secret scans: the recall constraint, and candidates of every form."""

import numpy as np
from pyspark.sql import functions as F

from tongueprint.llm import secrets


def test_recall_decides_the_threshold():
    # One true finding in ten, all of the same form: no calibrated score comes near a half.
    windows = np.stack([secrets.window(" " * 30 + "abcdefghijkl1" + " " * 10, 30, 43)] * 1000)
    labels = np.array([float(i % 10 == 0) for i in range(1000)])
    scanner = secrets.fit(windows, labels, secrets.Training(epochs=2))
    assert scanner.threshold < 0.5 and scanner.recall >= 0.99
    assert (scanner.scores(windows[:5]) >= scanner.threshold).all()


def test_runs_are_candidates_whole_and_in_every_form():
    mixed = "Zq7Rk" + "0123456789abcdef" + "Wm4Tp"
    text = f"the {mixed} and QwErTyZxCvBnMlKjHg end password=abcdefgh12345678 0123456789abcdef"
    spans = secrets.base_spans(text)
    found = [text[a:b] for a, b in secrets.candidates(text, spans)]
    assert found == [mixed, "QwErTyZxCvBnMlKjHg"]


def test_a_key_in_the_middle_of_a_long_run_is_seen():
    long = "docs/" * 20
    key = "Zq7RkWm4TpXy9LvB2nHc"
    plain, hidden = long + "e" * len(key) + long, long + key + long
    parts = secrets.pieces(0, len(hidden))
    assert parts[0][0] == 0 and parts[-1][1] == len(hidden)
    assert any(a <= len(long) and len(long) + len(key) <= b for a, b in parts)
    assert all(b - a == secrets.INSIDE for a, b in parts) and all(c <= b - secrets.INSIDE // 2 for (_, b), (c, _) in zip(parts, parts[1:]))
    assert any((secrets.window(plain, a, b) != secrets.window(hidden, a, b)).any() for a, b in parts)


def test_scan_reports_a_key_inside_a_path(spark):
    scanner = secrets.train(spark=spark)
    text = "see docs/the/report/Zq7RkWm4TpXy9LvB2nHcJd5Gs8Fa/server/order/client end"
    row = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), scanner).first()
    assert [text[s["start"]:s["end"]] for s in row["spans"]] == [text[4:-4]]
    made = secrets.made_findings(400, 77)
    kept = scanner.scores(np.stack([w for w, _ in made])) >= scanner.threshold
    assert kept[[y == 1 for _, y in made]].mean() > 0.95 and kept[[y == 0 for _, y in made]].mean() < 0.05


def test_training_sees_every_finding(spark):
    # The findings of the smallest hashes say the opposite of all others.
    mails = [f"see user{i}.name@corp{i % 7}.org now" for i in range(400)]
    at = F.xxhash64("text", F.lit(4))
    hashed = spark.createDataFrame([(m,) for m in mails], "text string").select("text", at.alias("at")).orderBy("at").collect()
    rows = [(r["text"], 4, len(r["text"]) - 4, int(i >= 60)) for i, r in enumerate(hashed)]
    findings = spark.createDataFrame(rows, "text string, start int, `end` int, label int")
    scanner = secrets.train(secrets.Training(rows=60, epochs=12), findings)
    windows = np.stack([secrets.window(t, s, e) for t, s, e, _ in rows])
    kept = scanner.scores(windows) >= scanner.threshold
    assert kept[60:].mean() > 0.9 and scanner.recall >= 0.99
    again = secrets.train(secrets.Training(rows=60, epochs=12), findings)
    assert np.allclose(again.scores(windows), scanner.scores(windows)) and np.isclose(again.threshold, scanner.threshold)
