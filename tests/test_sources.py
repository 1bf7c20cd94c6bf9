import os

import pytest
from conftest import step
from pyspark.sql.utils import AnalysisException

from wattledger.plans import pipeline
from wattledger.schemas import JOBS_SCHEMA
from wattledger.sources.jobs import jobs_from_table
from wattledger.sources.logs import land_logs, read_landed, read_logs

HEADER = "UID|User|JobID|JobName|Submit|Elapsed|Partition|NNodes|NCPUS|TotalCPU|ReqMem|MaxRSS|WorkDir|State|Account"


def line(job, name="n", user="ann", account="lab"):
    return f"1|{user}|{job}|{name}|2024-03-01T10:00:00|01:00:00|cpu-std|1|2|00:30:00|8G||/w|COMPLETED|{account}"


def write(path, lines, header=HEADER):
    path.write_text("\n".join([header, *lines]) + "\n")
    return str(path)


def test_read_log_text(spark, tmp_path):
    path = write(tmp_path / "log.txt", [line("1", name="a\\b"), line("2", name='"x|""y"""'), line("3", user="NaN", account="")])
    rows = read_logs(spark, path).orderBy("JobID").collect()
    assert [r.JobName for r in rows] == ["a\\b", 'x|"y"', "n"]
    assert [r.User for r in rows] == ["ann", "ann", None]
    assert (rows[2].Account, rows[0].MaxRSS) == (None, None)
    assert "CPUTime" not in rows[0]


def test_log_order_survives_splitting_a_file(spark, tmp_path, params):
    # The account of a job is the first one in the file; every split holds rows of every job.
    lines = [line(str(j), account=f"a{k:04d}") for k in range(300) for j in range(5)]
    path = write(tmp_path / "log.txt", lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        log = read_logs(spark, path)
        assert log.rdd.getNumPartitions() > 4
        jobs = pipeline.jobs_full(log.repartition(6), params).select("single_jobID", "Account_").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.Account_ for r in jobs} == {"a0000"} and len(jobs) == 5


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "a.txt", [line("1")])
    write(tmp_path / "b.txt", [line("2")], HEADER.replace("UID|User", "User|UID"))
    with pytest.raises(Exception, match="(?i)header"):
        read_logs(spark, str(tmp_path)).collect()
    with pytest.raises(ValueError, match="ReqMem"):
        read_logs(spark, write(tmp_path / "c.txt", ["1"], "UID"))
    with pytest.raises(AnalysisException):
        read_logs(spark, str(tmp_path / "missing.txt"))


def test_landed_log_reads_back_and_skips_days(spark, tmp_path, make_log, params):
    days = [f"2024-03-{d:02d}T12:00:00" for d in range(1, 21)]
    log = make_log(*[row for j, day in enumerate(days) for row in ({"JobID": str(j), "Submit": day}, step(
        j, Submit=f"2024-03-{j + 2:02d}T01:00:00", MaxRSS="3G"))], {"JobID": "x", "Submit": "bad"})
    path = str(tmp_path / "landed")
    land_logs(log, path)
    back = read_landed(spark, path)
    assert sorted(map(str, back.select(log.columns).collect())) == sorted(map(str, log.collect()))

    choice = pipeline.JobChoice(start="2024-03-05", end="2024-03-07")
    pruned = read_landed(spark, path, choice.start, choice.end, max_span_days=1)
    assert pruned.count() < log.count()
    want = sorted(map(str, pipeline.jobs_table(log, params, choice).collect()))
    assert sorted(map(str, pipeline.jobs_table(pruned, params, choice).collect())) == want and len(want) == 3
    assert "PartitionFilters: [(isnull(SubmitDay" in pruned._jdf.queryExecution().executedPlan().toString()

    text = str(tmp_path / "text")
    land_logs(log, text, fmt="csv")
    again = read_logs(spark, text).select(log.columns)
    assert sorted(map(str, again.collect())) == sorted(map(str, log.collect()))


def test_job_table_of_another_scheduler(spark, make_log, params):
    table = pipeline.jobs_table(make_log({"JobID": "1"}), params)
    foreign = table.selectExpr(*[f"CAST({c} AS STRING) AS {c}" for c in reversed(JOBS_SCHEMA.names)], "1 AS more")
    got = jobs_from_table(foreign)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in JOBS_SCHEMA]
    assert got.first() == table.select(*JOBS_SCHEMA.names).first()
    with pytest.raises(ValueError, match="UserX"):
        jobs_from_table(foreign.drop("UserX"))


def test_report_is_written(spark, tmp_path, make_log, params):
    jobs = pipeline.enriched_jobs(make_log(*[{"JobID": str(j), "Submit": f"2024-03-{j + 1:02d}T00:00:00"} for j in range(4)]), params)
    paths = pipeline.write_report(jobs, params, str(tmp_path / "report"), run="first")
    again = pipeline.write_report(jobs, params, str(tmp_path / "report"))
    assert set(paths) == set(again) == set(pipeline.report_tables(jobs, params)) and not set(paths.values()) & set(again.values())
    daily = spark.read.parquet(paths["daily"]).collect()
    assert len(daily) == 4 and not [d for d in os.listdir(paths["daily"]) if d.startswith("SubmitDate=")]
    assert [r.SubmitDate for r in daily] == sorted(r.SubmitDate for r in daily)
    assert spark.read.parquet(paths["labels"]).first().n_jobs == "4"
    with pytest.raises(AnalysisException):
        pipeline.write_report(jobs, params, str(tmp_path / "report"), run="first")
