"""The physical plans keep the properties the library relies on at scale."""

import re

import __spark_entry__ as entry
from plumbline.bindings import audit as bound
from plumbline.operators import latest
from plumbline.plans import audit

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_basket_reaches_the_scan_and_only_needed_columns_are_read(spark):
    text = plan_of(entry.queries()["reported_counts"](spark, SF))
    assert re.search(r"PushedFilters: \[In\(event_type", text)
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string>" in text
    assert text.count("Exchange hashpartitioning") == 1


def test_the_dense_grid_is_never_shuffled(no_broadcast):
    text = plan_of(entry.queries()["attrition_flags"](no_broadcast, SF))
    above_grid = text.split("Generate explode")[0]
    assert "Exchange" not in above_grid.replace("Exchange SinglePartition", "")
    assert "Window" in above_grid and "SortAggregate" in above_grid


def test_latest_rows_are_reduced_before_the_shuffle(spark):
    events = bound.observations(spark, SF)
    text = plan_of(latest.latest_per_key(events, ["user_id"], ["ts"]))
    final, _, partial = text.partition("Exchange hashpartitioning")
    assert "partial_max" in partial and "partial_max" not in final


def test_the_indicator_filter_moves_below_the_second_shuffle(spark):
    staged = audit.staged(bound.observations(spark, SF), bound.N)
    detail = audit.impossibility_detail(staged, bound.indicators(spark), bound.denominators(spark, SF), bound.N)
    text = plan_of(detail)
    assert re.search(r"Exchange hashpartitioning\(user_id.*event_type IN", text, re.S)
    assert "BroadcastHashJoin [event_type" in text


def test_steady_records_take_one_exchange_and_a_pushed_filter(spark):
    text = plan_of(bound._detail(spark, SF))
    assert text.count("Exchange hashpartitioning") == 1
    assert re.search(r"PushedFilters: \[.*In\(event_type, \[click,purchase,signup\]", text)
