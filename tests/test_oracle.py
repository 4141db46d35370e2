"""Every registered query: its plan, and its result against its SQL over the given tables."""

import re

import oracle
import pytest

import __spark_entry__ as contract

# Queries whose rows go through Python.
IN_PYTHON: set[str] = set()
# The offsets of files, one row each.
NUMBERS_PARTITIONS = {"srt_global_numbers"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


def check_plan(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    python = re.findall(r"MapInPandas|ArrowEvalPython|BatchEvalPython|FlatMapGroups|MapInArrow", plan)
    assert bool(python) == (name in IN_PYTHON)
    unpartitioned = re.findall(r"windowspecdefinition\([^,]*(?: ASC| DESC)", plan)
    assert not unpartitioned or name in NUMBERS_PARTITIONS
    assert plan.count("regexp_extract_all(coalesce(text") <= 4


# Times that a given table may be scanned by a plan; what is written between is scanned once.
SCANS = {"agg_describe_numeric": 1, "agg_price_positioning": 1, "mth_value_score": 2, "top_value": 2, "bin_price_histogram": 2,
         "brd_brand_report": 1, "brd_marketing_suggestions": 1, "brd_benchmark": 1, "snk_brand_export": 1, "jon_image_positive_ratio": 1}


def check_scans(name, df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    for table in oracle.TABLES:
        assert len(re.findall(rf"Location: [^\n]*/{table}\.parquet", plan)) <= SCANS[name]


@pytest.mark.parametrize("name", list(contract.LIBRARY))
def test_query(spark, con, name):
    df = contract.queries()[name](spark, oracle.SF_DIR)
    check_plan(name, df)
    if name in SCANS:
        check_scans(name, df)
    sql = contract.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.differences(df, con, sql) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_text_is_read_without_other_columns(spark):
    df = contract.queries()["brd_positioning"](spark, oracle.SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [s for s in re.findall(r"ReadSchema: (struct<[^>]*>)", plan) if "text" in s]
    assert scans == ["struct<doc_id:bigint,text:string,source:string>"]
