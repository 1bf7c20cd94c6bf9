import pytest
from conftest import step

from wattledger.operators import quality
from wattledger.plans import pipeline

BAD = {
    "R1": [{"MaxRSS": "5T"}, {"ReqMem": "5Tn"}],
    "R2": [{"ReqMem": "12X"}, {"ReqMem": "5T"}],
    "R4": [{"Partition": "cpu-std,cpu-himem"}],
    "R5": [{"Partition": "nope"}, {"Partition": None}],
    "R6": [{"Elapsed": "1-2-3"}, {"TotalCPU": "bad"}, {"CPUTime": "1:2:3:4"}],
    "R7": [{"TotalCPU": "03:00:00"}],
    "R8": [{"Partition": "gpu-a"}],
    "R9": [{"AllocTRES": "gres/gpu=1"}],
    "R10": [{"JobID": "1_2_3"}],
    "R11": [{"UID": None, "User": None}, {"User": None}],
    "R13": [{"Submit": "2022-02-30T00:00:00"}, {"Submit": "Unknown"}],
    "R14": [{"NCPUS": "x"}, {"NNodes": None}],
}


def found(df):
    return sorted((r.rule, r.jobID) for r in df.collect())


def test_each_rule_alone(make_log, params):
    rows, want = [], []
    for rule, changes in BAD.items():
        for i, change in enumerate(changes):
            job = change.get("JobID", f"{rule}-{i}")
            rows.append({"JobID": job, **change})
            want.append((rule, job))
    rows += [{"JobID": "fine"}, step("fine", MaxRSS="5M"), {"JobID": "queued", "State": "PENDING", "Partition": "nope", "User": None}]
    assert found(quality.violations(make_log(*rows), params)) == sorted(want)


def test_default_unit_several_users_and_counts(make_log, params):
    log = make_log({"JobID": "1", "MaxRSS": "154264"}, step(1, MaxRSS="99"), {"JobID": "2", "User": "bob", "MaxRSS": "0"}, {"JobID": "3", "User": None})
    strict_unit = params.with_(default_unit_rss=None)
    rows = quality.violations(log, strict_unit).collect()
    assert [(r.rule, r.jobID, r.detail) for r in rows if r.rule == "R3"] == [("R3", "1", "MaxRSS=154264")]
    assert not [r for r in quality.violations(log, params).collect() if r.rule == "R3"]
    jobs = pipeline.jobs_full(log, params)
    assert [r.detail for r in quality.several_users(jobs).collect()] == ["users=2"]
    assert quality.several_users(jobs.filter("UserX = 'bob'")).count() == 0
    assert quality.summary(jobs).first().asDict() == {
        "n_jobs": 3, "n_users": 2, "n_missing_uid": 0, "n_missing_user": 1, "several_users": 1}
    counts = {r.rule: r.n_jobs for r in quality.violations_by_rule(quality.violations(log, strict_unit)).collect()}
    assert counts == {"R3": 1, "R11": 1}


def test_strict(make_log, params):
    assert quality.violations(make_log({"UID": None}), params, strict=True).count() == 1
    bad = quality.violations(make_log({"Partition": "nope"}), params, strict=True)
    for act in (bad.collect, bad.count, bad.select("jobID").collect, bad.select().count):
        with pytest.raises(Exception, match="data quality: R5"):
            act()


def test_several_users_come_with_the_violations(make_log, params):
    log = make_log({"JobID": "1"}, {"JobID": "2", "User": "bob"}, {"JobID": "3", "User": None, "UID": None})
    rows = {(r.rule, r.jobID, r.detail) for r in quality.violations(log, params, users=True).collect()}
    assert ("R12", None, "users=2") in rows and ("R11", "3", "UID=NULL User=NULL") in rows
    assert not quality.violations(make_log({"JobID": "1"}), params, users=True).filter("rule = 'R12'").count()
    plan = quality.violations(log, params, users=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(single_jobID") == 1


def test_quality_is_counted_while_jobs_are_written(spark, tmp_path, make_log, params):
    from wattledger.plans import pipeline
    from wattledger.sources.jobs import refused_jobs, trusted_jobs

    logs = make_log(
        {"JobID": "1"}, step(1, MaxRSS="3G"), {"JobID": "2", "ReqMem": "12X"}, {"JobID": "3", "UID": None}, {"JobID": "4", "State": "RUNNING"},
        {"JobID": "5", "State": "RUNNING", "NCPUS": "x"}, {"JobID": "6", "Partition": "nope"}, {"JobID": "7", "State": "TIMEOUT"})
    path = str(tmp_path / "jobs")
    counts = pipeline.write_jobs_with_quality(logs, params, path, success_states=["TIMEOUT"])
    by_rule = {r.rule: r.n_jobs for r in quality.violations_by_rule(quality.violations(logs, params, ["TIMEOUT"])).collect()}
    assert counts.pop("n_jobs") == 7 and {r: n for r, n in counts.items() if n} == by_rule == {"R2": 1, "R5": 1, "R11": 1, "R14": 1}
    good = trusted_jobs(spark, path)
    want = pipeline.jobs_table(logs, params, pipeline.JobChoice(success_states=["TIMEOUT"]), keep=("single_jobID",)).filter("single_jobID IN (1, 3, 7)")
    columns = [c for c in want.columns if not c.startswith("_")]
    assert sorted(map(str, good.select(columns).collect())) == sorted(map(str, want.select(columns).collect()))
    assert {(r.single_jobID, r.broken_rules[0].rule) for r in refused_jobs(spark, path).collect()} == {("2", "R2"), ("5", "R14"), ("6", "R5")}
    assert "PartitionFilters: [isnotnull(trusted" in good._jdf.queryExecution().executedPlan().toString()


def test_findings_take_one_read_and_one_shuffle(spark, params):
    from wattledger.schemas import LOG_SEQ, RAW_FIELDS

    log = spark.range(1000).selectExpr(f"id AS {LOG_SEQ}", *[f"CAST(id % 3 AS STRING) AS `{f}`" for f in RAW_FIELDS])
    text = quality.with_findings(log, params)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and text.count("Range (0, 1000") == 1
