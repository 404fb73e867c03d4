"""The operators that must stay in SQL have no Python in their plans."""

import os

import pytest

from lexloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", ["op6_rule_cascade", "op8_rendezvous_shards", "op10_boosted_pii"])
def test_no_python_in_the_plan(spark, name):
    df = QUERIES[name](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in text for node in ("Python", "Pandas", "Arrow", "ExistingRDD"))
    assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
