"""The registered queries on the smallest tables: against their SQL, or run over every document."""

import os

import pytest

import __spark_entry__ as entry_points
from check import connect, differences
from tongueprint.llm import queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert differences(spark, connect(SF_DIR), name, SF_DIR) is None


@pytest.mark.parametrize("name", ["op3_quality", "op4_simhash", "op8_bpe", "op9_secrets", "op12_toxicity"])
def test_query_answers_every_document(spark, name):
    ids = [r["doc_id"] for r in entry_points.queries()[name](spark, SF_DIR).collect()]
    asked = [r["doc_id"] for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect()]
    assert sorted(ids) == sorted(asked)
