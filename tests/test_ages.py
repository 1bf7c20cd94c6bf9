"""Logs of different age, landed logs with jobs over many days, and roll-ups in slices."""

import datetime

import pytest
from conftest import RAW_DEFAULTS, step

from wattledger.operators import quality, rollup
from wattledger.plans import pipeline
from wattledger.schemas import LOG_LACKS, LOG_SEQ, RAW_FIELDS
from wattledger.sources.logs import headers, land_logs, read_landed, read_logs, read_mixed_logs, spans_path
from wattledger.sources.states import read_slices, write_slice

OLD = [f for f in RAW_FIELDS if f not in ("CPUTime", "AllocTRES", "Account")]


def write_file(path, fields, *rows, sep="|"):
    lines = [sep.join((RAW_DEFAULTS | row).get(f) or "" for f in fields) for row in rows]
    path.write_text("\n".join([sep.join(fields), *lines]) + "\n")
    return path


def aged_logs(tmp_path):
    """Job 1 in the old file and the new one, 2 in the old one alone, 3 without an account in a file that has them."""
    gpu = {"Partition": "gpu-a"}
    write_file(tmp_path / "2019.txt", OLD, {"JobID": "1", **gpu}, {"JobID": "2", **gpu}, {"JobID": "5", "CPUTime": "x"})
    write_file(
        tmp_path / "2020.txt", [*reversed(RAW_FIELDS), "Cluster"],
        step(1, AllocTRES="cpu=2,gres/gpu=3", Account="physics", Cluster="c1"), {"JobID": "3", "Account": None, **gpu}, {"JobID": "4", "CPUTime": "bad"})
    write_file(tmp_path / "2021.txt", [f for f in RAW_FIELDS if f != "AllocTRES"], {"JobID": "6", **gpu})
    (tmp_path / "2022.txt").write_text("")
    return str(tmp_path)


@pytest.mark.parametrize("in_order", [False, True])
def test_defaults_by_the_age_of_a_rows_file(spark, tmp_path, params, in_order):
    logs = read_mixed_logs(spark, aged_logs(tmp_path), in_order=in_order)
    lacks = {(r.JobID, tuple(r[LOG_LACKS])) for r in logs.collect()}
    assert {("1", ("CPUTime", "Account", "AllocTRES")), ("1.batch", ()), ("6", ("AllocTRES",))} < lacks and len(lacks) == 7
    assert {r.JobID: r.Cluster for r in logs.collect()}["1.batch"] == "c1"

    jobs = {r.single_jobID: r for r in pipeline.jobs_full(logs, params).collect()}
    # Another row of the job is in a file that tells; else one GPU on a GPU partition, and no account.
    assert (jobs["1"].NGPUS_, jobs["1"].Account_) == (3, "physics")
    assert (jobs["2"].NGPUS_, jobs["2"].Account_) == (1, "") and (jobs["6"].NGPUS_, jobs["6"].Account_) == (1, "lab")
    assert (jobs["3"].NGPUS_, jobs["3"].Account_) == (0, None)
    # Core time from wallclock and cores where the field is not there, unreadable where it is and cannot be read.
    assert (jobs["2"].CPUwallclocktime_, jobs["5"].CPUwallclocktime_, jobs["4"].CPUwallclocktime_) == (7_200_000, 7_200_000, None)


def test_a_field_that_a_file_lacks_is_no_violation(spark, tmp_path, params):
    found = quality.violations(read_mixed_logs(spark, aged_logs(tmp_path)), params).collect()
    assert sorted((r.rule, r.jobID, r.detail) for r in found if r.rule in ("R6", "R8")) == [("R6", "4", "CPUTime=bad"), ("R8", "3", "GPUs=0")]


def test_one_age_reads_as_before(spark, tmp_path, params):
    write_file(tmp_path / "a.txt", RAW_FIELDS, {"JobID": "1"}, step(1))
    write_file(tmp_path / "b.txt", RAW_FIELDS, {"JobID": "2"})
    plain, mixed = read_logs(spark, str(tmp_path)), read_mixed_logs(spark, str(tmp_path))
    rows = [sorted(map(str, pipeline.jobs_full(df, params).collect())) for df in (plain, mixed)]
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_headers_are_searched_for(spark, tmp_path, monkeypatch):
    files = [str(write_file(tmp_path / f"{n:02d}.txt", RAW_FIELDS if n < 23 else OLD)) for n in range(40)]
    looked = []
    from wattledger.sources import logs

    plain = logs._header_of
    monkeypatch.setattr(logs, "_header_of", lambda spark, paths, sep: looked.append(paths) or plain(spark, paths, sep))
    want = {f: tuple(RAW_FIELDS) if n < 23 else tuple(OLD) for n, f in enumerate(files)}
    assert headers(spark, files, in_order=True) == want and len(looked) < 12
    assert headers(spark, files) == want and headers(spark, [], in_order=True) == {} == headers(spark, [])


def test_wrong_claims_about_files_are_noticed(spark, tmp_path):
    for n, fields in enumerate((RAW_FIELDS, OLD, RAW_FIELDS)):
        write_file(tmp_path / f"{n}.txt", fields, {"JobID": str(n)})
    with pytest.raises(Exception, match="(?i)header"):  # not in order: the file between has another header
        read_mixed_logs(spark, str(tmp_path), in_order=True).collect()
    write_file(tmp_path / "3.txt", [LOG_SEQ, *RAW_FIELDS], {LOG_SEQ: "1", "JobID": "9"})
    with pytest.raises(ValueError, match="order"):
        read_mixed_logs(spark, str(tmp_path))
    write_file(tmp_path / "4.txt", ["UID", "User"])
    with pytest.raises(ValueError, match="JobID"):
        read_mixed_logs(spark, str(tmp_path / "4.txt"))
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.txt").write_text("")
    with pytest.raises(ValueError, match="header"):
        read_mixed_logs(spark, str(tmp_path / "none"))


# Directory and account

def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("choice", [{"directory": "/b"}, {"account": "bio"}, {"directory": "/b", "account": "bio"}, {"account": ""}])
def test_rows_are_cut_before_the_roll_up(spark, make_log, params, choice):
    # The first directory of job 2 is another one, a step of job 3 names it first; job 4's account is in a step.
    logs = make_log(
        {"JobID": "1", "WorkDir": "/b", "Account": "bio"}, {"JobID": "2", "WorkDir": "/a"}, step(2, WorkDir="/b", Account="bio"),
        {"JobID": "3", "WorkDir": None, "Account": None}, step(3, WorkDir="/b", Account="bio"), {"JobID": "4", "Account": None}, step(4, Account="bio"),
        {"JobID": "5", "Account": ""}, {"JobID": "6"})
    for log in (logs, logs.drop("Account")):
        narrow, wide = (pipeline.jobs_full(log, params, pipeline.JobChoice(**choice, narrow=n)) for n in (True, False))
        want = sorted(map(str, wide.collect()))
        assert sorted(map(str, narrow.collect())) == want
    if choice != {"account": ""}:
        text = plan(pipeline.jobs_full(logs, params, pipeline.JobChoice(**choice)))
        assert text.index("Exchange hashpartitioning(single_jobID") < text.index("LeftSemi")


# Landed logs

def spread_log(make_log):
    day = datetime.date(2024, 3, 1)
    rows = []
    for j in range(30):
        start = day + datetime.timedelta(days=j)
        rows.append({"JobID": str(j), "Submit": f"{start}T12:00:00"})
        for k in (0, j * 4 % 41, -(j % 5)):
            rows.append(step(j, Submit=f"{start + datetime.timedelta(days=k)}T13:00:00", MaxRSS=f"{k + 50}M", TotalCPU=f"00:{j:02d}:00"))
    return make_log(*rows, {"JobID": "x", "Submit": "bad"}, {"JobID": "7", "Submit": None, "MaxRSS": "9G"}, {"JobID": None, "Submit": "2024-03-09T00:00:00"})


@pytest.mark.parametrize("period", [("2024-03-05", "2024-03-07"), ("2024-03-30", "2024-05-30"), ("2024-02-01", "2024-02-28"), ("2030-01-01", "2030-01-01")])
def test_period_of_a_landed_log_is_exact(spark, tmp_path, make_log, params, period):
    log, path = spread_log(make_log), str(tmp_path / "landed")
    land_logs(log, path)
    choice = pipeline.JobChoice(*period)
    want = sorted(map(str, pipeline.jobs_full(log, params, choice).collect()))
    read = read_landed(spark, path, *period)
    assert sorted(map(str, pipeline.jobs_full(read, params, choice).collect())) == want
    assert "PartitionFilters" in plan(read) and read.count() < log.count()


def test_claims_about_a_landed_log(spark, tmp_path, make_log):
    path = str(tmp_path / "landed")
    land_logs(spread_log(make_log), path)
    assert spark.read.parquet(spans_path(path)).selectExpr("max(date_diff(last_day, first_day))").first()[0] == 40
    assert read_landed(spark, path, max_span_days=40).count() == 123
    with pytest.raises(ValueError, match="40 days"):
        read_landed(spark, path, "2024-03-05", "2024-03-07", max_span_days=39)
    for one in ({"start": "2024-03-05"}, {"end": "2024-03-05"}):
        with pytest.raises(ValueError, match="both"):
            read_landed(spark, path, **one)


def test_landed_log_without_spread_or_rows(spark, tmp_path, make_log, params):
    for n, log in enumerate((make_log({"JobID": "1"}), make_log({"JobID": "1"}).limit(0))):
        path = str(tmp_path / str(n))
        land_logs(log, path)
        if n == 0:
            assert read_landed(spark, path, "2024-03-01", "2024-03-01", max_span_days=0).count() == 1
        assert spark.read.schema("job string").parquet(spans_path(path)).count() == 0


# Slices

def test_slices_of_different_age_in_any_order(spark, tmp_path, params, make_log):
    rows = [
        {"JobID": "1", "Partition": "gpu-a", "Account": None}, step(1, AllocTRES="gres/gpu=2"), {"JobID": "2", "Partition": "gpu-a"},
        step(2, State="FAILED", MaxRSS="3G"), {"JobID": "3", "Partition": "cpu-std", "User": None}, step(3, Partition="cpu-himem", User="eve"), {"JobID": "4", "State": "RUNNING"}]
    log = make_log(*rows)
    want = sorted(map(str, pipeline.jobs_full(log, params).select("single_jobID", "NGPUS_", "Account_", "UserX", "StateX", "n_partitions_", "last_partition_", "NeededMemX").collect()))
    path = str(tmp_path / "states")
    for n in (1, 0, 2):
        pipeline.add_slice(log.filter(f"{LOG_SEQ} % 3 = {n}"), params, path, f"s{n}")
    pipeline.add_slice(log.filter(f"{LOG_SEQ} % 3 = 1"), params, path, "s1")  # again
    got = pipeline.jobs_of_slices(spark, path, params)
    assert sorted(map(str, got.select("single_jobID", "NGPUS_", "Account_", "UserX", "StateX", "n_partitions_", "last_partition_", "NeededMemX").collect())) == want

    # A slice from before accounts and GPUs were logged.
    pipeline.add_slice(make_log({"JobID": "9", "Partition": "gpu-a"}, {"JobID": "2", "Partition": None}, without=("AllocTRES", "Account", "CPUTime")), params, path, "old")
    jobs = {r.single_jobID: r for r in pipeline.jobs_of_slices(spark, path, params).collect()}
    assert (jobs["9"].NGPUS_, jobs["9"].Account_, jobs["2"].NGPUS_, jobs["2"].Account_) == (1, "", 0, "lab")
    some = pipeline.jobs_of_slices(spark, path, params, names=["old"]).collect()
    assert {r.single_jobID for r in some} == {"2", "9"}
    assert "slice#" in plan(read_slices(spark, path, ["old"])).split("PartitionFilters: ")[1].split("]")[0]


def test_merging_twice_changes_nothing(spark, tmp_path, params, make_log):
    from wattledger.operators import steps

    log = make_log({"JobID": "1"}, step(1), {"JobID": "2"}, step(2, Partition="gpu-a"))
    state = rollup.rollup_state(steps.clean_steps(log, params))
    once = rollup.merge_states(state)
    assert sorted(map(str, rollup.merge_states(once).collect())) == sorted(map(str, state.collect()))
    want = rollup.rollup_jobs(steps.clean_steps(log, params))
    assert sorted(map(str, rollup.jobs_of_states(state).select(want.columns).collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="name"):
        write_slice(state, str(tmp_path), "a/b")


# Several clusters

def test_clusters_have_their_own_parameters_and_job_ids(spark, params, make_log):
    from pyspark.sql import functions as F

    from wattledger.params import Clusters, Partition

    other = params.with_(partitions=(Partition("cpu-std", "CPU", 24.0),), pue=2.0, carbon_intensity=10.0, granularity_memory_request=2.0, default_unit_rss="M")
    log = make_log({"JobID": "1", "MaxRSS": "3000"}, {"JobID": "2", "Partition": "gpu-a"}, step(1, Elapsed="02:00:00"))
    both = log.withColumn("Cluster", F.lit("a")).unionByName(log.withColumn("Cluster", F.lit("b"))).unionByName(log.withColumn("Cluster", F.lit(None).cast("string")))
    clusters = Clusters({"a": params, "b": other, "unused": params})
    got = pipeline.enriched_jobs(both, clusters, keep=("single_jobID",))
    assert not [c for c in got.columns if c.startswith("_")]
    for name, one in (("a", params), ("b", other)):
        want = pipeline.enriched_jobs(log, one, keep=("single_jobID",))
        mine = got.filter(F.col("Cluster") == name).select(want.columns)
        assert sorted(map(str, mine.collect())) == sorted(map(str, want.collect()))
    unknown = got.filter("Cluster IS NULL").collect()
    assert len(unknown) == 2 and all(r.energy is None and r.PartitionTypeX is None for r in unknown)
    with pytest.raises(ValueError, match="Cluster"):
        pipeline.enriched_jobs(log, clusters)
    with pytest.raises(ValueError, match="names"):
        Clusters({})


def test_slices_of_several_clusters(spark, tmp_path, params, make_log):
    from pyspark.sql import functions as F

    from wattledger.params import Clusters

    clusters = Clusters({"a": params, "b": params.with_(granularity_memory_request=2.0)})
    log = make_log({"JobID": "1"}, step(1, MaxRSS="3G")).withColumn("Cluster", F.lit("a"))
    both = log.unionByName(log.withColumn("Cluster", F.lit("b")))
    for n in (0, 1):
        pipeline.add_slice(both.filter(f"{LOG_SEQ} = {n}"), clusters, str(tmp_path / "s"), f"s{n}")
    got = pipeline.jobs_of_slices(spark, str(tmp_path / "s"), clusters).select("Cluster", "NeededMemX").collect()
    assert sorted(map(tuple, got)) == [("a", 6.0), ("b", 4.0)]


# Buckets

def test_roll_up_of_a_bucketed_log_needs_no_shuffle(spark, make_log, params):
    import uuid

    from wattledger.operators import steps
    from wattledger.sources.logs import land_bucketed

    rows = [row for j in range(40) for row in ({"JobID": f"{j}_1"}, step(f"{j}_1", MaxRSS=f"{j}M"))]
    log, table = make_log(*rows, {"JobID": None}), f"landed_{uuid.uuid4().hex}"
    land_bucketed(log.repartition(3), table, 4)
    try:
        stored = spark.table(table)
        assert stored.rdd.getNumPartitions() == 4 and sorted(map(str, stored.select(log.columns).collect())) == sorted(map(str, log.collect()))
        rolled = rollup.rollup_jobs(steps.clean_steps(stored, params))
        assert "Exchange" not in plan(rolled)
        want = rollup.rollup_jobs(steps.clean_steps(log, params))
        assert sorted(map(str, rolled.collect())) == sorted(map(str, want.collect()))
        assert pipeline.jobs_full(stored, params).count() == 41
        with pytest.raises(ValueError, match="bucket"):
            land_bucketed(log, f"{table}_0", 0)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_buckets_grow_with_the_log(spark, make_log, monkeypatch):
    import uuid

    from wattledger.sources import logs

    monkeypatch.setattr(logs, "ROWS_PER_BUCKET", 10)
    log = make_log(*[{"JobID": str(j)} for j in range(57)])
    for least, expected in ((4, 6), (8, 8)):
        table = f"grown_{uuid.uuid4().hex}"
        logs.land_bucketed(log, table, least)
        try:
            found = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect()}
            assert int(found["Num Buckets"]) == expected
            assert spark.table(table).count() == 57
        finally:
            spark.sql(f"DROP TABLE {table}")


def test_index_of_days_has_few_files(spark, tmp_path, make_log):
    path = str(tmp_path / "landed")
    land_logs(spread_log(make_log), path)
    spans = spark.read.parquet(spans_path(path))
    n_days = spans.select("SubmitDay").distinct().count()
    assert n_days > 30
    assert spans.select("_metadata.file_path").distinct().count() < n_days / 4
