import datetime

import pytest
from conftest import step
from pyspark.sql import functions as F

from wattledger.operators import derive, enrich, filters, rollup, steps, summarise
from wattledger.params import ClusterParams, Partition
from wattledger.plans import pipeline
from wattledger.sources.sinks import write_table


def rolled(log, params, custom=()):
    return {r.single_jobID: r for r in rollup.rollup_jobs(steps.clean_steps(log, params, custom)).collect()}


def full(log, params, **choice):
    return {r.single_jobID: r for r in pipeline.jobs_full(log, params, pipeline.JobChoice(**choice)).collect()}


def test_roll_up_takes_extremes_and_the_first_logged_text(make_log, params):
    job = rolled(make_log(
        {"JobID": "7", "Account": None, "Submit": "2024-03-01T10:00:09"},
        step(7, MaxRSS="5M", ReqMem="9G", Account="first", Submit="2024-03-01T10:00:07"),
        step(7, MaxRSS="7M", Account="second", Elapsed="bad", NCPUS="8", Submit="2024-03-01T10:00:08"),
    ), params)["7"]
    assert (job.ReqMemX, job.UsedMem_, job.NCPUS_, job.WallclockTimeX) == (9.0, pytest.approx(0.007), 8, 3600000)
    assert (job.Account_, job.JobName_, job.UserX, job.PartitionX) == ("first", "job", "ann", "cpu-std")
    assert job.SubmitDatetimeX == datetime.datetime(2024, 3, 1, 10, 0, 7)


def test_partition_texts_by_one_rule_for_any_number(make_log, params):
    log = make_log(
        {"JobID": "0", "Partition": None}, {"JobID": "1", "Partition": "cpu-std"},
        {"JobID": "2", "Partition": "cpu-"}, {"JobID": "2", "Partition": None}, {"JobID": "2", "Partition": "std"},
        *[{"JobID": "9", "Partition": f"p{i},q"} for i in range(50)],
    )
    jobs = rolled(log, params)
    assert {j: (r.PartitionX, r.n_partitions_, r.last_partition_) for j, r in jobs.items()} == {
        "0": ("", 0, None), "1": ("cpu-std", 1, "cpu-std"), "2": ("cpu-", 2, "std"), "9": ("p0", 50, "p49")}
    assert {j: r.PartitionTypeX for j, r in full(log, params).items()} == {"0": None, "1": "CPU", "2": None, "9": None}
    texts = rollup.partition_rows(steps.clean_steps(log, params)).filter("single_jobID = '9'").orderBy("position").collect()
    assert [r.PartitionX for r in texts] == [f"p{i}" for i in range(50)]


def test_states_over_the_steps_of_a_job(make_log, params):
    log = make_log(
        {"JobID": "1"}, step(1, State="FAILED"),
        {"JobID": "2", "State": "TIMEOUT"}, step(2, State="FAILED"),
        {"JobID": "3"}, step(3, State="RUNNING"),
        {"JobID": "4"}, step(4),
    )
    assert {k: v.StateX for k, v in full(log, params).items()} == {"1": 0, "2": 0, "4": 1}
    assert {k: v.StateX for k, v in full(log, params, success_states=["TIMEOUT"]).items()} == {"1": 0, "2": 1, "4": 1}


def test_result_does_not_depend_on_partitioning(make_log, params):
    log = make_log(*[row for j in range(40) for row in (
        {"JobID": str(j), "Account": None if j % 3 else "x"}, step(j, Account="late", MaxRSS=f"{j}M"), step(j, Account="later"))])
    want = sorted(map(str, rolled(log, params).values()))
    for n in (1, 3, 7):
        assert sorted(map(str, rolled(log.repartition(n, "Account", "JobID"), params).values())) == want


@pytest.mark.parametrize("requested, used, needed, factor", [
    (10.0, 6.0, 10.0, 1.0), (20.0, 6.0, 12.0, 20 / 12), (4.0, 5.0, 6.0, 1.0), (100.0, 0.0, 6.0, 100 / 6), (0.0, 0.0, 0.0, None),
    (102.6, 0.003016, 6.0, 17.1),
])
def test_needed_memory(spark, requested, used, needed, factor):
    df = spark.createDataFrame([(requested, used)], "ReqMemX double, UsedMem2_ double")
    row = df.selectExpr("*", f"{derive.needed_memory('UsedMem2_', 6)} AS NeededMemX").selectExpr(
        "NeededMemX", derive.OVERALLOCATION_FACTOR).first()
    assert row[0] == needed
    assert row[1] == (None if factor is None else pytest.approx(factor))


def test_gpu_and_cpu_jobs(make_log, params):
    jobs = full(make_log(
        {"JobID": "1", "TotalCPU": "00:00:00"},
        {"JobID": "2", "Partition": "gpu-a", "AllocTRES": "gres/gpu=3"},
        {"JobID": "3", "Partition": "nope"},
    ), params)
    cpu, gpu, unknown = (jobs[j] for j in "123")
    assert (cpu.TotalCPUtime2useX, cpu.TotalGPUtime2useX, cpu.CPUhoursChargedX, cpu.GPUhoursChargedX) == (7200000, 0, 2.0, 0.0)
    assert (gpu.TotalCPUtime2useX, gpu.TotalGPUtime2useX, gpu.CPUhoursChargedX, gpu.GPUhoursChargedX) == (1800000, 10800000, 0.0, 3.0)
    assert (unknown.PartitionTypeX, unknown.CPUhoursChargedX) == (None, None)


def test_old_logs(make_log, params):
    log = make_log({"JobID": "1"}, {"JobID": "2", "Partition": "gpu-a"}, without=("CPUTime", "AllocTRES", "Account"))
    jobs = full(log, params)
    assert [(jobs[j].CPUwallclocktime_, jobs[j].NGPUS_, jobs[j].Account_) for j in "12"] == [(7200000, 0, ""), (7200000, 1, "")]
    with pytest.raises(ValueError, match="MaxRSS"):
        pipeline.jobs_full(log.drop("MaxRSS"), params)


def test_energy_of_a_worked_example(make_log, params):
    log = make_log({
        "Elapsed": "00:13:03", "NCPUS": "15", "TotalCPU": "00:00.508", "CPUTime": "03:15:45", "ReqMem": "6840Mc", "MaxRSS": "3016K",
        "State": "FAILED"})
    job = pipeline.enriched_jobs(log, params).first()
    assert job.CPUhoursChargedX == 3.2625
    assert job.energy_CPUs == pytest.approx(0.508 / 3600 * 12 / 1000)
    assert job.energy_memory == pytest.approx(0.00831252375)
    assert job.energy == pytest.approx(0.012471325625)
    assert job.carbonFootprint == pytest.approx(0.012471325625 * 231.12)
    assert job.energy_failedJobs == job.energy
    assert job.cost == pytest.approx(job.energy * 0.34)


def test_choice_of_jobs(spark, make_log, params):
    log = make_log(
        {"JobID": "10_1", "Submit": "2024-03-01T00:00:00"}, step("10_1", Submit="2024-03-03T00:00:00"),
        {"JobID": "10_2", "Submit": "2024-03-02T23:59:59", "WorkDir": "/a"},
        {"JobID": "11", "Submit": "2024-03-03T00:00:00", "Account": "other"},
    )
    assert set(full(log, params, start="2024-03-01", end="2024-03-02")) == {"10_1", "10_2"}
    assert set(full(log, params, directory="/a")) == {"10_2"}
    assert set(full(log, params, account="other")) == {"11"}
    assert set(full(log, params, job_ids="10,12")) == {"10_1", "10_2"}
    assert set(full(log, params, job_ids=["11"])) == {"11"}
    ids = spark.createDataFrame([(10,), (10,)], "id int")
    chosen = filters.with_ids_from(pipeline.jobs_full(log, params), ids, "id")
    assert {r.single_jobID for r in chosen.collect()} == {"10_1", "10_2"}
    with pytest.raises(LookupError, match="account: nobody"):
        choice = pipeline.JobChoice(account="nobody")
        pipeline.require_jobs(pipeline.jobs_full(log, params, choice), choice)


@pytest.mark.parametrize("start, end", [("2024-13-01", "2024-12-01"), ("2024-02-02", "2024-02-01"), ("x", "y")])
def test_bad_periods(start, end):
    with pytest.raises(ValueError):
        pipeline.JobChoice(start=start, end=end)


def test_parameters_are_checked(params):
    base = {"granularity_memory_request": 6, "PUE": 1.5, "CI": 100, "energy_cost": {"cost": 0.2, "currency": "$"},
            "partitions": {"p": {"type": "CPU", "TDP": 10}}}
    built = ClusterParams.from_mappings(base, {"tree_month": 900})
    assert (built.constants.electricity_cost, built.currency, built.constants.tree_month) == (0.2, "$", 900.0)
    for change in ({"PUE": 0.5}, {"PUE": "<1.67>"}, {"granularity_memory_request": 0}, {"default_unit_RSS": "T"},
                   {"partitions": {}}, {"partitions": {"g": {"type": "GPU", "TDP": 300}}}, {"partitions": {"g": {"type": "TPU", "TDP": 1}}}):
        with pytest.raises(ValueError):
            ClusterParams.from_mappings({**base, **change})


def test_no_job_is_lost_in_summaries_and_sums_hold(spark, make_log, params):
    log = make_log(
        {"JobID": "1"}, {"JobID": "2", "User": None}, {"JobID": "3", "Submit": "Unknown"}, {"JobID": "4", "Account": None},
        {"JobID": "5", "Partition": "nope"})
    jobs = pipeline.enriched_jobs(log, params, keep=("Account_",))
    daily = summarise.daily_summary(jobs)
    tables = [daily, summarise.overall_summary(daily), summarise.summarise_jobs(jobs, ["Account_"]), summarise.summarise_jobs(jobs)]
    for column in ("energy", "wallclockTime"):
        totals = {round(float(t.agg({column: "sum"}).first()[0]), 6) for t in tables}
        assert len(totals) == 1
    assert None in {r.Account_ for r in tables[2].collect()} and None in {r.UserX for r in daily.collect()}
    # Far more milliseconds than a BIGINT holds.
    many = jobs.filter("single_jobID = '1'").withColumn("WallclockTimeX", F.lit(2**62)).crossJoin(spark.range(6))
    assert int(summarise.overall_summary(summarise.daily_summary(many)).first()["wallclockTime"]) == 6 * 2**62


def test_id_tables_and_days_reach_the_rows(spark, make_log, params, tmp_path):
    log = make_log({"JobID": "1_2"}, step("1_2"), {"JobID": "3"}, {"JobID": "4"})
    ids = spark.createDataFrame([(1,), (4,)], "order int")
    chosen = pipeline.jobs_full(log, params, pipeline.JobChoice(id_table=ids, id_column="order"))
    assert {r.single_jobID for r in chosen.collect()} == {"1_2", "4"}
    text = chosen._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Aggregate [single_jobID") < text.index("LeftSemi")
    with pytest.raises(ValueError):
        pipeline.JobChoice(id_table=ids)
    path = str(tmp_path / "jobs")
    write_table(pipeline.enriched_jobs(log, params), path)
    read = filters.in_period(spark.read.parquet(path), "2024-02-01", "2024-02-28")
    assert "PartitionFilters: [isnotnull(SubmitDate" in read._jdf.queryExecution().executedPlan().toString() and read.count() == 0
