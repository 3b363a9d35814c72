"""Physical-plan checks: the shapes the design promises."""

import pytest

import __spark_entry__ as E
from civicspark.plans import extraction
from conftest import SF_SMALL


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pending_cells_is_an_anti_join_without_nested_loops(spark):
    text = plan_text(E.q_pending_cells(spark, SF_SMALL))
    assert "LeftAnti" in text
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("key", ["yearly_pending", "loaded_cells"])
def test_the_plan_is_not_shuffled_by_loaded_cells(spark, key):
    text = plan_text(E.queries()[key](spark, SF_SMALL))
    assert "SortMergeJoin" not in text and "ShuffledHashJoin" not in text


def test_many_loaded_cells_are_not_broadcast(spark, monkeypatch):
    plan = spark.createDataFrame([("t", 1, "u1"), ("t", 1, "u2"), ("t", 2, "u3"), (None, 3, "u4")], "topic string, ano int, url string")
    loaded = spark.createDataFrame([("t", 1), ("t", 1), (None, 3), ("é", 9)], "topic string, ano int")
    for limit in (0, 1 << 20):
        monkeypatch.setattr(extraction, "BROADCAST_BYTES", limit)
        pending, known = extraction.pending_cells(plan, loaded, ("topic", "ano")), extraction.loaded_cells(plan, loaded, ("topic", "ano"))
        assert ("ResolvedHint" in pending._jdf.queryExecution().analyzed().toString()) == (limit > 0)
        assert sorted(r.url for r in pending.collect()) == ["u3", "u4"]
        assert sorted(r.url for r in known.collect()) == ["u1", "u2"]


@pytest.mark.parametrize("key", ["extraction_plan", "resume_plan", "retry_lookup", "merge_outer_common",
                                 "portal_coverage", "multi_employment", "price_outliers", "dedup_by_key"])
def test_no_cross_or_nested_loop_joins(spark, key):
    text = plan_text(E.queries()[key](spark, SF_SMALL))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("key", sorted(E._QUERIES))
def test_no_python_in_the_plan(spark, key):
    if key == "incremental_load":
        pytest.skip("runs its own stream; its batches use the same operators")
    text = plan_text(E.queries()[key](spark, SF_SMALL))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "PythonUDF" not in text


def test_scan_prunes_columns(spark):
    df = E.q_multi_employment(spark, SF_SMALL)
    text = plan_text(df)
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint,l_shipdate:timestamp_ntz>" in text


def test_dedup_aggregates_partially_before_the_shuffle(spark):
    text = plan_text(E.q_dedup_by_key(spark, SF_SMALL))
    assert "partial_min" in text


def test_merge_splits_full_outer_into_skew_splittable_joins(spark):
    text = plan_text(E.q_merge_outer_common(spark, SF_SMALL))
    assert "FullOuter" not in text
    assert "LeftAnti" in text and "Inner" in text


@pytest.mark.parametrize("key", ["json_rows", "scan_json_payload", "zip_columns_to_rows", "stamp_metadata", "table_profile"])
def test_no_round_robin(spark, key):
    assert "RoundRobinPartitioning" not in plan_text(E.queries()[key](spark, SF_SMALL))
