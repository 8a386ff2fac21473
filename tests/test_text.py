import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tongueprint.functions.text import (
    explode_grams, explode_lines, explode_tokens, first_token, gram_total, has_text, one_line, strip,
)
from tongueprint.operators.linear import gram_array

# Characters whose lower case is one character in every engine.
TEXTS = st.text(alphabet="abcXYZ éß\t\n 　日本😀-'.", max_size=30)


def plain_grams(text, lo, hi):
    out = []
    for token in text.lower().split():
        padded = f" {token} "
        if len(padded) < lo:
            out.append(padded)
        for n in range(lo, hi + 1):
            out += [padded[i:i + n] for i in range(len(padded) - n + 1)]
    return sorted(out)


def spark_grams(spark, texts, lo, hi):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    rows = explode_grams(explode_tokens(df, "sentence", ["i"]), lo, hi, ["i"]).collect()
    found = {i: [] for i in range(len(texts))}
    for row in rows:
        found[row["i"]].append(row["gram"])
    return [sorted(found[i]) for i in range(len(texts))]


def test_known_grams(spark):
    the, two_words, twice, none = spark_grams(spark, ["the", "A b", "aa aa", ""], 2, 4)
    assert len(the) == 9
    assert two_words == sorted([" a", "a ", " a ", " b", "b ", " b "])
    assert len(twice) == 12
    assert none == []


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(TEXTS, min_size=1, max_size=20), st.sampled_from([(2, 4), (2, 5), (1, 3), (4, 6), (3, 3)]))
def test_grams_match_plain_python(spark, texts, sizes):
    expected = [plain_grams(t, *sizes) for t in texts]
    assert spark_grams(spark, texts, *sizes) == expected
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    arrays = df.orderBy("i").select(gram_array(F.col("sentence"), *sizes), gram_total("sentence", *sizes)).collect()
    assert [sorted(r[0]) for r in arrays] == expected
    assert [r[1] for r in arrays] == [len(e) for e in expected]


def test_outer_keeps_rows_without_grams(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, " \t"), (4, "a")], "i int, sentence string")
    grams = explode_grams(explode_tokens(df, "sentence", ["i"], outer=True), 2, 4, ["i"], outer=True)
    counts = {r["i"]: r["n"] for r in grams.groupBy("i").agg(F.count("gram").alias("n")).collect()}
    assert counts == {1: 0, 2: 0, 3: 0, 4: 3}


def test_whitespace_is_pythons(spark):
    chars = [chr(c) for c in range(0x3100) if chr(c).isspace()]
    df = spark.createDataFrame([(f"a{c}b",) for c in chars], "sentence string")
    assert explode_tokens(df, "sentence", []).where("token IN ('a', 'b')").count() == 2 * len(chars)
    blanks = spark.createDataFrame([(c,) for c in chars] + [("",), (None,)], "sentence string")
    assert blanks.where(has_text(F.col("sentence"))).count() == 0
    assert [r[0] for r in df.select(strip(F.concat(F.lit("　\n"), F.lit("x y"), F.lit("  ")))).distinct().collect()] == ["x y"]


def test_lines_are_pythons(spark):
    text = "one\ntwo\r\nthree\rfour\x0bfive\x0csix\x1cseven\x1deight\x1enine\x85ten eleven twelve"
    df = spark.createDataFrame([(1, text)], "i int, text string")
    lines = explode_lines(df, "text", "line", ["i"]).orderBy("line_no").collect()
    assert [r["line"] for r in lines] == text.splitlines()


def test_small_helpers(spark):
    df = spark.createDataFrame([("  two\nlines ",)], "t string")
    assert df.select(one_line(F.col("t")), first_token(F.col("t"))).first()[:] == ("two lines", "two")
    assert re.split(r"\s+", "two lines")[0] == "two"
