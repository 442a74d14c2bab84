"""Every registered query against its SQL check on the smallest tables, and plan rules."""

import pytest

import check
from termsheet.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_matches_check(spark, con, name):
    ok, note = check.compare(spark, con, SF, name)
    assert ok, note


def test_every_query_has_a_check_or_a_reason():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def _plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


STREAMS = {"t1_unique_filings_stream", "t2_live_spend_stream", "t3_action_stream_states", "t4_miss_counts_stream"}
PYTHON = {"e3_answer_parts", "e4_text_answers", "e5_flatten_answers", "h9_excerpts_of_document", "e6_clamp_confidence", "h2_key_terms_rows", "h3_label_value_rows", "e2_table_fields_from_html", "s4_index_rows", "s3_primary_document", "d6_rename_suggestions"}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_plan_has_no_cross_join_and_no_stray_python(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = _plan(spark, "u6_by_step")
    assert "l_returnflag" not in plan
    lookup = catalog.QUERIES["r1_status_snapshot"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in lookup and "ReadSchema: struct<o_orderkey:bigint>" in lookup
