"""Queries over the smallest tables against their SQL, and properties of results and plans.

QUICK=1 compares a selection instead of all.
"""

import os

import compare
import pytest

import __spark_entry__ as entry
from wattledger.operators import distribution, report, summarise
from wattledger.plans import catalog, oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SELECTED = (
    "scan_logs", "legacy_logs", "parse_duration", "job_rollup", "enriched", "daily", "overall", "filter_job_ids_semi",
    "factor_lists", "mem_efficiency_hist", "labels", "dq_violations",
)
CHECKED = SELECTED if os.environ.get("QUICK") else sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    return compare.oracle_connection(SF_DIR)


@pytest.fixture(scope="module")
def stages(spark):
    inputs = catalog._Inputs(spark, SF_DIR)
    jobs = inputs.enriched().cache()
    daily = summarise.daily_summary(jobs).cache()
    yield jobs, daily, summarise.overall_summary(daily).cache()


def test_every_query_has_sql():
    assert set(catalog.catalog()) == set(oracle.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_sql(spark, duck, name):
    assert compare.differences(entry.queries()[name](spark, SF_DIR), duck, entry.oracle_sql()[name]) == []


def test_profile_of_the_derived_jobs(stages):
    jobs, _, _ = stages
    row = jobs.selectExpr(
        "count(*)", "count_if(PartitionTypeX = 'GPU')", "sum(StateX)", "count_if(memOverallocationFactorX IS NULL)",
        "min(memOverallocationFactorX)", "count(DISTINCT UserX)", "round(sum(energy), 3)").first()
    assert tuple(row) == (1268, 254, 738, 13, 1.0, 40, 13187.934)


def test_sums_agree_between_levels(stages):
    jobs, daily, overall = stages
    for column in ("energy", "carbonFootprint", "cost", "driving"):
        totals = [df.selectExpr(f"sum({column})").first()[0] for df in (jobs, daily, overall)]
        assert totals[1:] == [pytest.approx(totals[0])] * 2
    assert jobs.count() == daily.selectExpr("sum(n_jobs)").first()[0] == overall.selectExpr("sum(n_jobs)").first()[0]


def test_shares_and_parts_add_up(stages):
    jobs, daily, overall = stages
    shares = summarise.with_share_within(daily, ["UserX"]).groupBy("UserX").agg({"share_carbonFootprint": "sum"}).collect()
    assert [r[1] for r in shares] == [pytest.approx(1.0)] * 40
    assert summarise.with_share_of_all(overall).selectExpr("sum(share_carbonFootprint)").first()[0] == pytest.approx(1.0)
    for row in report.energy_breakdown(overall).collect():
        assert row.energy_CPUs + row.energy_GPUs + row.energy_memory + row.energy_overheads == pytest.approx(row.energy)
    assert jobs.filter("memOverallocationFactorX < 1").count() == 0
    assert jobs.filter("NeededMemX <= ReqMemX AND carbonFootprint_memoryNeededOnly > carbonFootprint * (1 + 1e-12)").count() == 0


def test_factor_values_are_complete(stages):
    jobs, _, _ = stages
    values = distribution.factor_values(jobs)
    counts = {r.scope: r.n for r in values.groupBy("scope").agg({"n_jobs": "sum"}).withColumnRenamed("sum(n_jobs)", "n").collect()}
    assert counts == {"user": 1268, "overall": 1268}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.catalog()))
def test_plans_stay_distributed(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython", "collect_list"):
        assert unwanted not in text


def test_job_filter_reaches_the_rows_below_the_roll_up(spark):
    text = plan(entry.queries()["filter_job_ids"](spark, SF_DIR))
    assert text.rindex("substring_index") > text.rindex("Exchange hashpartitioning(single_jobID")


def test_roll_up_is_combined_before_its_only_shuffle(spark, params):
    from wattledger.operators import rollup, steps
    from wattledger.schemas import LOG_SEQ, RAW_FIELDS

    log = spark.range(1000).selectExpr(f"id AS {LOG_SEQ}", *[f"CAST(id % 3 AS STRING) AS `{f}`" for f in RAW_FIELDS])
    text = plan(rollup.rollup_jobs(steps.clean_steps(log, params)))
    assert text.count("Exchange") == 1
    before_shuffle = text[text.index("Exchange"):]
    assert "partial_max" in before_shuffle and "partial_min_by" in before_shuffle
