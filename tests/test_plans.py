"""Plans that must hold at any size: no joins without a key, pruned scans."""

import os

import pytest

from lexloom.plans.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_join_without_a_key(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


#: Queries that go to Python by nature: models, matrix products, sequences.
PYTHON = {"knn_topk", "knn_threshold_rerank", "contexts_by_seed", "rrf_fusion", "stuffed_prompt", "context_precision", "answer_relevancy", "graph_edit_distance", "ner_offline", "relations_offline", "embed_offline", "rouge_longest", "kw_filter_large_lexicon", "python_literals", "recursive_chunks", "failing_rows_alone", "retrieval_chain", "indexed_neighbours"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - PYTHON))
def test_stays_in_the_engine(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert not any(node in text for node in ("MapInArrow", "MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsIn"))


def test_filter_and_columns_reach_the_scan(spark):
    text = plan(table(spark, SF, "lineitem").where("l_quantity >= 50").select("l_orderkey"))
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThanOrEqual(l_quantity,50.0)]" in text
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text


@pytest.mark.parametrize("name", ["entity_join_clean", "spans_per_doc", "char_to_token", "span_contract", "relation_records", "kw_hits_by_term", "bm25_topk"])
def test_tokens_are_placed_before_they_are_dealt(spark, name):
    """Rows of all tokens never cross an exchange: what a window or an aggregate
    is dealt are texts, or the tokens wanted."""
    text = plan(QUERIES[name](spark, SF))
    for below in text.split("Exchange hashpartitioning")[1:]:
        first = next((x for x in below.split("\n")[1:] if "Generate" in x or "Scan" in x or "Exchange" in x), "")
        assert "posexplode" not in first


def test_union_arms_share_one_scan(spark):
    assert plan(QUERIES["kw_filter_multiset"](spark, SF)).count("FileScan parquet") == 1


@pytest.mark.parametrize("name", ["kw_filter_dedup", "dedup_keep_first", "length_trim_dedup"])
def test_long_texts_are_not_shuffled(spark, name):
    lines = plan(QUERIES[name](spark, SF)).split("\n")
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            below = "".join(lines[i + 1 : i + 2])
            assert "keys=[text" not in below and "text#" not in line.split("hashpartitioning", 1)[1]
