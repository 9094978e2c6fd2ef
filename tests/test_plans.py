"""Physical plans: what is read, shuffled and reused."""

import re
from pathlib import Path

import pytest

from checks import QUERIES
from perilscope.operators import rules

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not there")


def initial(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("Final Plan") :]


def test_leading_causes_are_cut_before_the_shuffle(spark):
    plan = initial(QUERIES["cause_share_top3"](spark, FOLDER))
    assert plan.count("WindowGroupLimit") == 2


def test_top_list_reads_two_columns_and_never_sorts_globally(spark):
    plan = initial(QUERIES["top20_causes"](spark, FOLDER))
    read = re.search(r"ReadSchema: struct<(l_[^>]*)>", plan)
    assert set(re.findall(r"(\w+):", read.group(1))) == {"l_partkey", "l_linenumber"}
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_filters_reach_the_scan(spark):
    plan = initial(QUERIES["filtered_slice"](spark, FOLDER))
    assert "In(n_name" in plan.replace("[", "(") or "n_name IN" in plan
    plan = initial(QUERIES["value_counts"](spark, FOLDER))
    assert "IsNotNull(event_type)" in plan and "ReadSchema: struct<event_type:string>" in plan


def test_one_shuffle_of_the_rows_serves_shares_and_impacts(spark):
    plan = final(QUERIES["area_risk_summary"](spark, FOLDER))
    assert "ReusedExchange" in plan


def test_crosstab_is_one_aggregate(spark):
    plan = initial(QUERIES["theme_crosstab"](spark, FOLDER))
    assert plan.count("Exchange hashpartitioning") == 1


def test_row_functions_do_not_shuffle(spark):
    for name in ("clean_strings", "coerce_numeric", "duration_months", "era_date",
                 "clock_hour_period", "rule_first_contains", "round_clip_ratio"):
        assert "Exchange" not in initial(QUERIES[name](spark, FOLDER)), name


def test_rule_tables_are_literals(spark, frame):
    df = frame(t=["a", "b"])
    label = rules.label_of("t", [(f"p{i}", "x") for i in range(50)])
    plan = df.select(label.alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan


@pytest.mark.parametrize("name", ["area_risk_summary", "attach_detail", "kpis", "yoy_trend"])
def test_area_queries_work_on_counts(spark, name):
    """The rows are read once, to be counted; nothing but counts is left for the query itself."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = initial(QUERIES[name](spark, FOLDER))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "lineitem" not in plan and "FileScan" not in plan


def test_personalised_output_joins_no_rows(spark):
    plan = initial(QUERIES["personalised_output"](spark, FOLDER))
    assert plan.count("lineitem.parquet") == 1
