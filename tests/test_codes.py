import pytest
from pyspark.sql import functions as F

from tongueprint import CodeTable
from tongueprint.sources.codes import display_label

CASES = [
    (None, "und"), ("", "und"), ("  ", "und"), ("eng", "eng"), ("en", "eng"), ("EN", "eng"), ("English", "eng"),
    ("english", "eng"), ("__label__eng_Latn", "eng"), ("eng_Latn", "eng"), ("zh_CN", "zho"), ("Standard Arabic", "arb"),
    ("nan", "nan"), ("nb-NO", "nob"), ("ENG", "eng"), ("qqqq-not-a-language", "und"), (" fr\t", "fra"), ("zh-HK", "zho"),
    ("Gawar-Bati", "gwt"), ("Norwegian Bokmål", "nob"), ("other", "und"), ("Tem", "kdh"), ("xyz", "xyz"), ("luo", "luo"),
    ("Luo (Kenya and Tanzania)", "luo"), ("Old French", "fro"), ("ga", "gle"), ("GA", "gle"), ("gaa", "gaa"), ("__label__", "und"), ("_x", "und"),
]


@pytest.mark.parametrize("value, code", CASES)
def test_resolve(codes, value, code):
    assert codes.resolve(value) == code


def test_column_agrees_with_literal(spark, codes):
    values = [v for v, _ in CASES] + [r[1] for r in codes.rows] + [r[0] for r in codes.rows] + [r[2] for r in codes.rows]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, tag string")
    for row in codes.normalize(df, "tag", "lang").collect():
        assert row["lang"] == codes.resolve(row["tag"]), row


def test_every_listed_name_and_tag_finds_its_code(codes):
    for iso3, name, iso1, tag in codes.rows:
        assert codes.resolve(iso3) == iso3
        if iso1:
            assert codes.resolve(iso1.upper()) == iso3
        assert codes.resolve(tag) == iso3
        if len(name) > 3:
            assert codes.resolve(name) == iso3


def test_attributes(spark, codes):
    rows = {r["lang"]: r for r in codes.attributes(spark.createDataFrame([("eng",), ("kab",), ("zzz",)], "lang string")).collect()}
    assert (rows["eng"]["name"], rows["eng"]["iso639_1"], rows["eng"]["bcp47"]) == ("English", "en", "en")
    assert (rows["kab"]["name"], rows["kab"]["iso639_1"], rows["kab"]["bcp47"]) == ("Kabyle", None, "kab")
    assert (rows["zzz"]["name"], rows["zzz"]["iso639_1"], rows["zzz"]["bcp47"]) == ("zzz", None, "zzz")


def test_custom_table(spark, tmp_path):
    path = tmp_path / "codes.csv"
    path.write_text("name,iso639_3,iso639_1,bcp47,rows\nMin Nan Chinese,nan,,nan,3\nEnglish,eng,en,en,9\n")
    table = CodeTable.from_csv(spark, str(path))
    assert table.rows == (("nan", "Min Nan Chinese", None, "nan"), ("eng", "English", "en", "en"))
    assert table.resolve("min nan chinese") == "nan"
    with pytest.raises(ValueError):
        CodeTable.from_csv(spark, str(path), max_rows=1)


def test_display_label(spark):
    df = spark.createDataFrame([("English", "eng", 3), (None, "xyz", 2), ("French", "fra", None)], "name string, lang string, support bigint")
    labels = [r[0] for r in df.select(display_label(F.col("name"), F.col("lang"), F.col("support"))).collect()]
    assert labels == ["English (eng, n=3)", "xyz (xyz, n=2)", "French (fra)"]
