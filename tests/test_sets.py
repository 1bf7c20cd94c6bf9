"""Several groupings in one pass, and job tables of other schedulers up to the report."""

import pytest

from wattledger.operators import distribution, enrich, quality, summarise
from wattledger.plans import pipeline
from wattledger.schemas import JOBS_SCHEMA, LOG_SEQ, RAW_FIELDS
from wattledger.sources import sinks
from wattledger.sources.jobs import jobs_from_table

SETS = [("UserX", "SubmitDate"), ("Account_",)]


@pytest.fixture
def jobs(make_log, params):
    rows = [{"JobID": str(j), "User": u, "Account": a, "Submit": f"2024-03-0{1 + j % 3}T00:00:00", "Elapsed": f"0{1 + j % 4}:00:00"}
            for j, (u, a) in enumerate([("ann", "x"), ("bob", "x"), ("ann", None), (None, "y"), ("eve", "")] * 3)]
    return pipeline.enriched_jobs(make_log(*rows), params, keep=("Account_",))


def test_sets_equal_single_groupings(jobs):
    sets = summarise.summarise_sets(jobs, SETS).cache()
    for keys in [*SETS, ()]:
        label = ",".join(keys) or "all"
        want = summarise.summarise_jobs(jobs, keys)
        got = sets.filter(f"grouping = '{label}'").select(want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), label
    shares = summarise.with_share_in_sets(sets).groupBy("grouping").agg({"share_carbonFootprint": "sum"}).collect()
    assert {r[0] for r in shares} == {"UserX,SubmitDate", "Account_", "all"} and all(r[1] == pytest.approx(1.0) for r in shares)


def test_sets_of_nothing_and_twice(jobs):
    whole = summarise.summarise_sets(jobs, []).collect()
    assert len(whole) == 1 and whole[0].grouping == "all" and whole[0].n_jobs == 12
    empty = summarise.summarise_sets(jobs.limit(0), SETS)
    assert summarise.with_share_in_sets(empty).filter("grouping <> 'all'").count() == 0
    with pytest.raises(ValueError, match="twice"):
        summarise.summarise_sets(jobs, [("UserX", "SubmitDate"), ("SubmitDate", "UserX")])
    with pytest.raises(ValueError, match="grouping"):
        summarise.summarise_sets(jobs, [("grouping",)])


def test_one_roll_up_and_one_summary_shuffle(spark, params):
    log = spark.range(1000).selectExpr(f"id AS {LOG_SEQ}", *[f"CAST(id % 3 AS STRING) AS `{f}`" for f in RAW_FIELDS])
    sets = summarise.summarise_sets(pipeline.enriched_jobs(log, params, keep=("Account_",)), [*SETS, ("PartitionX",)])
    text = sets._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 == text.count("Exchange ") - text.count("BroadcastExchange ")
    assert "Expand" in text and "partial_sum" in text[text.index("Exchange hashpartitioning"):]


def foreign(jobs, **changes):
    columns = [f"{changes.get(c, f'CAST({c} AS STRING)')} AS {c}" for c in reversed(JOBS_SCHEMA.names)]
    return jobs_from_table(jobs.selectExpr("single_jobID", *columns), ("single_jobID",))


@pytest.fixture
def table(make_log, params):
    log = make_log({"JobID": "1"}, {"JobID": "2", "Partition": "gpu-a", "AllocTRES": "gres/gpu=2"}, {"JobID": "3", "Partition": "nope", "UID": None})
    return pipeline.jobs_table(log, params, keep=("single_jobID",))


def test_power_is_looked_up_for_a_job_table(table, params):
    want = enrich.enrich_jobs(table, params)
    got = enrich.enrich_jobs(foreign(table), params).select(want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert {r.single_jobID: r.energy for r in got.collect()}["3"] is None


def test_rules_on_a_job_table(table, params):
    bad = foreign(
        table, TotalGPUtime2useX="CASE single_jobID WHEN '1' THEN '5' WHEN '2' THEN '0' END", PartitionTypeX="CASE WHEN single_jobID <> '1' THEN 'GPU' ELSE 'CPU' END")
    found = {(r.rule, r.jobID): (r.severity, r.detail) for r in quality.job_violations(bad, params, "single_jobID").collect()}
    assert found == {
        ("R9", "1"): ("error", "TotalGPUtime2useX=5"), ("R8", "2"): ("error", "TotalGPUtime2useX=0"), ("R8", "3"): ("error", "TotalGPUtime2useX=NULL"),
        ("R5", "3"): ("error", "PartitionX=nope"), ("R11", "3"): ("warning", "UID=NULL User=ann")}
    wrong = foreign(table.filter("single_jobID = '2'"), PartitionTypeX="'CPU'", TotalGPUtime2useX="'0'")
    assert [tuple(r) for r in quality.job_violations(wrong, params).collect()] == [("R5", "error", None, "PartitionX=gpu-a PartitionTypeX=CPU")]
    text = quality.job_violations(bad, params)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1  # the roll-up that made the table


def test_strict_stops_without_an_id(table, params):
    with pytest.raises(Exception, match="data quality: R5 PartitionX=nope"):
        quality.job_violations(foreign(table), params, strict=True).count()
    fine = foreign(table.filter("single_jobID = '1'"))
    assert quality.job_violations(fine, params, strict=True).count() == 0 and quality.job_violations(fine.limit(0), params).count() == 0


# Distribution in the days

def test_quantiles_lie_in_their_bins(spark, jobs):
    import math
    import random

    rng = random.Random(1)
    values = [1.0] * 20 + [round(1 / rng.uniform(0.01, 1), 4) for _ in range(300)] + [100.0, 20.0, 20.0001, 1 / 0.95]
    rows = [(None if i % 7 == 0 else f"u{i % 2}", v) for i, v in enumerate(values)] + [("u0", None), ("none", None)]
    base = jobs.limit(1).drop("UserX", "memOverallocationFactorX", "SubmitDate")
    factors = spark.createDataFrame([(u, v, f"2024-03-{1 + i % 9:02d}") for i, (u, v) in enumerate(rows)], "UserX string, memOverallocationFactorX double, SubmitDate string")
    table = base.crossJoin(factors)
    days = distribution.daily_with_bins(table).cache()
    want = distribution.memory_efficiency_histogram(table)
    assert sorted(map(str, distribution.histogram_of_days(days).select(want.columns).collect())) == sorted(map(str, want.collect()))
    shares = (0.01, 0.5, 0.9, 0.99, 1.0)
    for by in (("UserX",), ()):
        for r in distribution.factor_quantiles(days, by, shares).collect():
            mine = sorted(v for u, v in rows if v is not None and (not by or u == r.UserX))
            true = mine[math.ceil(r.quantile * len(mine)) - 1]
            # The bound: within the bin, so less than five percent of the request in efficiency.
            assert r.factor_low - 1e-9 <= true and (r.factor_high is None or true <= r.factor_high + 1e-9) and r.n_jobs == len(mine)
            assert abs(100 / r.factor - 100 / true) < 5
    assert distribution.factor_quantiles(days, quantiles=shares).filter("UserX = 'none'").count() == 0
    with pytest.raises(ValueError, match="above 0"):
        distribution.factor_quantiles(days, quantiles=[0.0])


def test_factor_values_take_one_shuffle(spark):
    jobs = spark.range(10).selectExpr("CAST(id % 3 AS STRING) AS UserX", "CAST(id AS DOUBLE) AS memOverallocationFactorX")
    text = distribution.factor_values(jobs)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "partial_count" in text[text.index("Exchange hashpartitioning"):]


# Runs

class Stopped(Exception):
    pass


@pytest.mark.parametrize("stop_at", ["daily", "overall", "factor_values", "labels"])
def test_a_run_that_stops_is_taken_up_again(spark, tmp_path, jobs, params, monkeypatch, stop_at):
    directory = str(tmp_path / "report")
    record = sinks.record_table

    def stopping(table, run, name):
        if name == stop_at:
            raise Stopped
        return record(table, run, name)

    monkeypatch.setattr(sinks, "record_table", stopping)
    with pytest.raises(Stopped):
        pipeline.write_report(jobs, params, directory, run="one")
    with pytest.raises(LookupError, match="no finished run"):
        sinks.read_run(spark, directory)
    recorded = []
    monkeypatch.setattr(sinks, "record_table", lambda table, run, name: recorded.append(name) or record(table, run, name))
    before = set(sinks.finished_tables(spark, f"{directory}/one"))
    paths = pipeline.write_report(jobs, params, directory, run="one", resume=True)
    assert before | set(recorded) == set(paths) and not before & set(recorded) and stop_at in recorded
    tables = sinks.read_run(spark, directory, "one")
    assert set(tables) == set(paths) and tables["daily"].count() == sinks.finished_runs(spark, directory)["one"]["daily"] == jobs.select("UserX", "SubmitDate").distinct().count()


def test_only_whole_runs_are_read(spark, tmp_path, jobs, params):
    directory = str(tmp_path / "with space")
    assert sinks.finished_runs(spark, directory) == {}
    pipeline.write_report(jobs, params, directory, run="a")
    pipeline.write_report(jobs.limit(3), params, directory, run="b")
    sinks.record_table(jobs.limit(1), f"{directory}/c", "daily")
    assert list(sinks.finished_runs(spark, directory)) == ["a", "b"]
    assert sinks.read_run(spark, directory)["usage_summary"].agg({"n_jobs": "sum"}).first()[0] <= 3
    with pytest.raises(LookupError, match="'c'"):
        sinks.read_run(spark, directory, "c")
