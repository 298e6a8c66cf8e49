"""Physical claims: pruned scans, pushed filters, group limits, no cross joins of large sides, no Python where none is needed."""

import pytest

from tarn.plans.catalog import QUERIES


def plan(frame):
    return frame._jdf.queryExecution().toString().split("== Physical Plan ==")[1]


def test_filters_and_columns_reach_the_scan(spark, sf):
    found = plan(QUERIES["inv_filter_pushdown"](spark, sf))
    assert "In(source, [src3,src4])" in found and "GreaterThanOrEqual(n_chars,100)" in found and "text" not in found.split("ReadSchema")[1].split("\n")[0]
    vectors = plan(QUERIES["vec_prefilter_topk"](spark, sf))
    assert "In(label, [1,3])" in vectors and "TakeOrderedAndProject" in vectors


@pytest.mark.parametrize("name", ["vec_diversify", "vec_batch_knn", "mem_best_per_unit"])
def test_ranks_are_cut_before_the_shuffle(spark, sf, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, sf))


@pytest.mark.parametrize("name", [n for n in sorted(QUERIES) if n.startswith(("text_", "inv_", "idx_", "sto_", "dia_", "xref_"))])
def test_no_python_in_relational_queries(spark, sf, name):
    found = plan(QUERIES[name](spark, sf))
    assert not any(word in found for word in ("MapInPandas", "ArrowEvalPython", "BatchEvalPython", "FlatMapGroupsInPandas"))


def test_symbols_are_looked_up(spark, sf):
    """A hop reads the postings of its names: the names reach the scan, texts are not read again, nothing is crossed."""
    found = plan(QUERIES["xref_hops"](spark, sf))
    assert "In(symbol, [" in found and "NestedLoop" not in found and "CartesianProduct" not in found and "regexp" not in found and found.count("Scan parquet") <= 2


def test_spans_meet_pages_by_key(spark, sf):
    found = plan(QUERIES["chunk_page_ranges"](spark, sf))
    assert "NestedLoop" not in found and "CartesianProduct" not in found


def test_an_offload_plan_is_made_once(spark, sf):
    """Its totals and its conflicts come from one aggregation: each row is ranked and grouped by destination once."""
    found = QUERIES["sto_offload_plan"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert found.count("count_if") + found.count("row_number()") > 0 and found.count("row_number() windowspecdefinition") == 1
