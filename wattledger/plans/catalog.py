"""Every operator as a query over the log derived from the order tables.

A query takes (spark, directory of the tables) and returns a DataFrame. Sums of
doubles depend on the order of their terms, so the queries round what they
return; the operators do not.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing as P
from ..functions.sql import name, quoted, string
from ..operators import derive, distribution, enrich, filters, quality, report, rollup, steps, summarise
from ..params import CLUSTER, ClusterParams, Clusters, Constants, Partition
from ..schemas import JOBS_SCHEMA, LOG_LACKS, LOG_SEQ, RAW_FIELDS
from ..session import scratch_path, tune
from ..sources.dimensions import if_small, partition_dim
from ..sources.jobs import jobs_from_table, trusted_jobs
from ..sources.logs import land_bucketed, land_logs, parse_lines, read_landed, read_mixed_logs, to_line
from ..sources.sinks import stored
from ..sources.states import read_slices
from ..sources.orders_log import ORDERS_CLUSTER, orders_log
from . import pipeline

CUSTOM_SUCCESS = ("TIMEOUT", "OUT_OF_MEMORY")
PERIOD = ("1996-03-01", "1997-06-30")
DIRECTORY = "/home/user7/proj1"
ACCOUNT = "machinery"
JOB_IDS = ("15", "30", "45", "60", "75", "7", "1000")


def rounded(value: str, decimals: int) -> str:
    """Round in a way two engines agree on: the offset keeps exact ties away from the edge."""
    return f"floor({value} * 1e{decimals}D + 0.5017D) / 1e{decimals}D"


def _rounded(df: DataFrame, decimals: int = 6, **other: int) -> DataFrame:
    """Round every double column, the named ones to other decimals."""
    return df.selectExpr(*[
        f"{rounded(name(f.name), other.get(f.name, decimals))} AS {name(f.name)}" if isinstance(f.dataType, T.DoubleType) else name(f.name)
        for f in df.schema
    ])


class _Inputs:
    """The tables of one run, as the stages of the pipeline see them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = tune(spark), sf_dir
        self.params: ClusterParams = ORDERS_CLUSTER
        self.logs = orders_log(spark, sf_dir)

    def steps(self, custom=()) -> DataFrame:
        return steps.clean_steps(self.logs, self.params, custom)

    def rolled(self) -> DataFrame:
        return rollup.rollup_jobs(self.steps())

    def full(self, **choice) -> DataFrame:
        return pipeline.jobs_full(self.logs, self.params, pipeline.JobChoice(**choice))

    def table(self, keep=()) -> DataFrame:
        return pipeline.jobs_table(self.logs, self.params, keep=keep)

    def enriched(self, keep=()) -> DataFrame:
        return pipeline.enriched_jobs(self.logs, self.params, keep=keep)

    def daily(self) -> DataFrame:
        return summarise.daily_summary(self.enriched())

    def overall(self) -> DataFrame:
        return summarise.overall_summary(self.daily())


_QUERIES: dict[str, Callable[[_Inputs], DataFrame]] = {}


def _query(fn: Callable[[_Inputs], DataFrame]):
    _QUERIES[fn.__name__] = fn
    return fn


# Sources

@_query
def scan_logs(i):
    # Missing values take turns in all the texts that stand for them.
    tokens = f"element_at(array({quoted(P.NA_TOKENS)}), 1 + CAST(crc32(CAST(JobID AS BINARY)) % {len(P.NA_TOKENS)} AS INT))"
    lines = i.logs.selectExpr(LOG_SEQ, f"{to_line(RAW_FIELDS, tokens)} AS line")
    return parse_lines(lines, RAW_FIELDS)


@_query
def legacy_logs(i):
    old = i.logs.drop("CPUTime", "AllocTRES", "Account")
    return _rounded(pipeline.jobs_full(old, i.params).select(
        "single_jobID", "CPUwallclocktime_", "NGPUS_", "Account_", "PartitionTypeX",
        "TotalGPUtime2useX", "CPUhoursChargedX", "GPUhoursChargedX",
    ))


# Number of the job that a log row belongs to.
_JOB_NUMBER = f"CAST(replace({P.job_id('JobID')}, '_', '') AS BIGINT)"


def _mixed_files(i) -> str:
    """The log as files of three ages: fields missing, in another order, one more. Jobs have rows in two of them."""
    path = scratch_path(i.spark, "mixed-logs")
    age = f"({_JOB_NUMBER} + CASE WHEN {LOG_SEQ} >= 2 THEN 1 ELSE 0 END) % 3"
    for n, rows in enumerate((
        i.logs,
        i.logs.select(LOG_SEQ, *[name(f) for f in reversed(RAW_FIELDS) if f not in ("CPUTime", "AllocTRES")]),
        i.logs.drop("Account").withColumn("Cluster", F.lit("c1")),
    )):
        land_logs(rows.filter(f"{age} = {n}"), f"{path}/{n}", fmt="csv", by_day=False)
    return f"{path}/*"


@_query
def scan_mixed_logs(i):
    return read_mixed_logs(i.spark, _mixed_files(i)).withColumn(LOG_LACKS, F.concat_ws(",", LOG_LACKS))


@_query
def jobs_mixed_logs(i):
    logs = read_mixed_logs(i.spark, _mixed_files(i), in_order=True)
    return _rounded(pipeline.jobs_full(logs, i.params).select(
        "single_jobID", "CPUwallclocktime_", "NGPUS_", "Account_", "PartitionTypeX",
        "TotalGPUtime2useX", "CPUhoursChargedX", "GPUhoursChargedX",
    ))


@_query
def landed_period(i):
    # Some jobs' steps were submitted up to 40 days later or earlier.
    moved = " ".join(
        f"WHEN {LOG_SEQ} >= 2 AND {_JOB_NUMBER} % 9 = {rest} THEN CAST({move}(CAST(left(Submit, 10) AS DATE), CAST({_JOB_NUMBER} % 41 AS INT)) AS STRING) "
        "|| substring(Submit, 11)" for rest, move in ((4, "date_add"), (5, "date_sub")))
    path = scratch_path(i.spark, "landed")
    land_logs(i.logs.withColumn("Submit", F.expr(f"CASE {moved} ELSE Submit END")), path)
    logs = read_landed(i.spark, path, *PERIOD)
    jobs = pipeline.jobs_full(logs, i.params, pipeline.JobChoice(*PERIOD))
    return _rounded(jobs.select("single_jobID", "SubmitDatetimeX", "WallclockTimeX", "UsedMem2_", "TotalCPUtime2useX", "UserX"), 9)


def _other_scheduler(jobs: DataFrame) -> DataFrame:
    """A job table as another scheduler may deliver it: other types, another order, more columns."""
    return jobs.selectExpr("single_jobID", *[f"CAST({c} AS STRING) AS {c}" for c in reversed(JOBS_SCHEMA.names)])


@_query
def jobs_from_other_table(i):
    return _rounded(jobs_from_table(_other_scheduler(i.full())))


@_query
def daily_from_table(i):
    # The job table has no power draws: they are looked up.
    jobs = jobs_from_table(_other_scheduler(i.full()))
    return _rounded(summarise.daily_summary(enrich.enrich_jobs(jobs, i.params)))


@_query
def partition_dimension(i):
    used = i.logs.selectExpr(f"{P.first_partition('`Partition`')} AS partition").groupBy("partition").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return used.join(if_small(partition_dim(i.spark, i.params), i.params), "partition")


# Fields of the log

@_query
def parse_duration(i):
    # Besides the texts as logged, every shorter and some unreadable forms of them.
    tail2, tail1 = "right(Elapsed, 5)", "right(Elapsed, 2)"
    return _fields(
        i,
        elapsed_ms=P.duration_ms("Elapsed"),
        total_cpu_ms=P.duration_ms("TotalCPU"),
        cpu_time_ms=P.duration_ms("CPUTime"),
        min_sec_ms=P.duration_ms(tail2),
        sec_ms=P.duration_ms(tail1),
        day_sec_ms=P.duration_ms(f"('3-' || {tail1})"),
        fraction_ms=P.duration_ms(f"({tail2} || '.508123')"),
        too_many_ms=P.duration_ms("('1:' || Elapsed || ':2')"),
        two_days_ms=P.duration_ms("('1-' || CPUTime)"),
        large_ms=P.duration_ms(f"('90000000' || {tail1} || ':05')"),
        long_fraction_ms=P.duration_ms(f"({tail1} || '.1300000000')"),
    )


def _fields(i, *plain: str, **parsed: str) -> DataFrame:
    """Identity of each log row with the given raw and parsed fields."""
    return i.logs.selectExpr("JobID", LOG_SEQ, *plain, *[f"{text} AS {column}" for column, text in parsed.items()])


@_query
def req_mem(i):
    memory = P.requested_memory_gb("ReqMem", P.integer("NNodes"), P.integer("NCPUS"))
    return _rounded(_fields(i, "ReqMem", ReqMemX=memory), 9)


@_query
def max_rss(i):
    return _rounded(_fields(i, "MaxRSS", UsedMem_=P.max_rss_gb("MaxRSS", i.params.default_unit_rss)), 9)


@_query
def gpu_count(i):
    return _fields(i, NGPUS_=P.gpu_count("AllocTRES"))


@_query
def clean_partition(i):
    return _fields(i, PartitionX=P.first_partition("`Partition`"))


@_query
def submit_ts(i):
    return _fields(i, SubmitDatetimeX=P.submit_timestamp("Submit"))


@_query
def state_code(i):
    return _fields(i, "State", StateX=P.state_code("State"))


@_query
def state_code_custom(i):
    rolled = rollup.rollup_jobs(i.steps(CUSTOM_SUCCESS))
    return rollup.finished_jobs(rolled).select("single_jobID", "StateX")


@_query
def job_ids(i):
    single = P.job_id("JobID")
    return _fields(i, single_jobID=single, parentJobID=P.parent_job_id(single))


# Jobs

@_query
def job_rollup(i):
    return _rounded(i.rolled(), 9)


@_query
def rollup_bucketed(i):
    table = f"landed_{uuid.uuid4().hex}"
    land_bucketed(i.logs, table, 8)
    return _rounded(rollup.rollup_jobs(steps.clean_steps(i.spark.table(table), i.params)), 9)


@_query
def rollup_incremental(i):
    # Three slices, whose rows belong to the same jobs, kept one by one and merged.
    path = scratch_path(i.spark, "states")
    for n in (2, 0, 1):
        pipeline.add_slice(i.logs.filter(f"crc32(CAST(JobID || {LOG_SEQ} AS BINARY)) % 3 = {n}"), i.params, path, f"s{n}")
    some = rollup.merge_states(read_slices(i.spark, path, ["s2", "s1"]))
    every = rollup.merge_states(some.unionByName(read_slices(i.spark, path, ["s0"])))
    return _rounded(rollup.jobs_of_states(every).drop(steps.LACKS_GPUS), 9)


@_query
def finished_jobs(i):
    return rollup.finished_jobs(i.rolled()).select("single_jobID", "StateX", "UserX")


@_query
def partition_type(i):
    jobs = derive.attach_hardware(rollup.finished_jobs(i.rolled()), i.params)
    return jobs.select(
        "single_jobID", "PartitionX", "PartitionTypeX", F.col("_tdp").alias("tdp"), F.col("_tdp_cpu").alias("tdp_cpu")
    )


@_query
def cpu_gpu_time(i):
    return i.full().select("single_jobID", "TotalCPUtime2useX", "TotalGPUtime2useX")


@_query
def core_hours(i):
    return _rounded(i.full().select("single_jobID", "CPUhoursChargedX", "GPUhoursChargedX"))


@_query
def mem_needed(i):
    return _rounded(i.full().select("single_jobID", "ReqMemX", "UsedMem2_", "NeededMemX"), 9)


@_query
def mem_overalloc(i):
    return _rounded(i.full().select("single_jobID", "memOverallocationFactorX"))


@_query
def jobs(i):
    return _rounded(i.table().select(*JOBS_SCHEMA.names))


@_query
def energy(i):
    jobs = enrich.add_energy(i.full(), i.params)
    return _rounded(jobs.select("single_jobID", *[c for c in jobs.columns if c.startswith("energy")]))


@_query
def enriched(i):
    jobs = i.enriched(keep=("single_jobID",))
    return _rounded(jobs.drop(*[c for c in JOBS_SCHEMA.names]))


# Choice of jobs

@_query
def period_filter(i):
    return i.full(start=PERIOD[0], end=PERIOD[1]).select("single_jobID", "SubmitDatetimeX")


@_query
def filter_workdir(i):
    return i.full(directory=DIRECTORY).select("single_jobID", "WorkingDir_")


@_query
def filter_job_ids(i):
    return i.full(job_ids=JOB_IDS).select("single_jobID", "parentJobID", "UserX")


@_query
def filter_job_ids_semi(i):
    urgent = i.spark.read.parquet(f"{i.sf_dir}/orders.parquet").filter(F.col("o_orderpriority") == "1-URGENT")
    return i.full(id_table=urgent, id_column="o_orderkey").select("single_jobID", "parentJobID", "UserX")


@_query
def filter_account(i):
    return i.full(account=ACCOUNT).select("single_jobID", "Account_")


# Several clusters

SOUTH = ClusterParams(
    partitions=(Partition("cpu-std", "CPU", 24.0), Partition("gpu-a", "GPU", 600.0, tdp_cpu=20.0)),
    pue=1.2, carbon_intensity=52.5, granularity_memory_request=4.0, default_unit_rss="M",
    constants=Constants(electricity_cost=0.21),
)


@_query
def daily_by_cluster(i):
    # Both clusters count their jobs from the same number on, so ids are unique within a cluster only.
    logs = i.logs.withColumns({
        CLUSTER: F.expr(f"CASE {_JOB_NUMBER} % 2 WHEN 0 THEN 'north' ELSE 'south' END"),
        "JobID": F.expr(f"({_JOB_NUMBER} DIV 2) || substring(JobID, length({P.job_id('JobID')}) + 1)"),
    })
    return _rounded(pipeline.daily_footprint(logs, Clusters({"north": i.params, "south": SOUTH})))


# Summaries

@_query
def daily(i):
    return _rounded(i.daily())


@_query
def overall(i):
    return _rounded(i.overall(), 3)


@_query
def by_account(i):
    return _rounded(summarise.summarise_jobs(i.enriched(keep=("Account_",)), ["Account_"]), 3)


@_query
def by_partition(i):
    return _rounded(summarise.summarise_jobs(i.enriched(), ["PartitionX"]), 3)


@_query
def whole_set(i):
    daily = summarise.daily_summary(i.enriched(), by=())
    return _rounded(summarise.summarise_summaries(daily), 2)


@_query
def share(i):
    out = summarise.with_share_within(i.daily(), ["UserX"])
    return _rounded(out.select("UserX", "SubmitDate", "share_carbonFootprint"))


SETS = (("UserX", "SubmitDate"), ("Account_",), ("PartitionX",))


def _sets(i) -> DataFrame:
    """All groupings from one pass over the jobs, with shares of the whole set."""
    summary = stored(summarise.summarise_sets(i.enriched(keep=("Account_",)), SETS), "summary-sets")
    return summarise.with_share_in_sets(summary)


@_query
def summary_sets(i):
    return _rounded(_sets(i), 2, share_carbonFootprint=6).withColumn("SubmitDate", F.col("SubmitDate").cast("string"))


@_query
def share_by_account(i):
    by_account = _sets(i).filter(F.col(summarise.GROUPING) == "Account_").drop(summarise.GROUPING, "UserX", "SubmitDate", "PartitionX")
    return _rounded(by_account, 3, share_carbonFootprint=6)


# Distributions and chart tables

@_query
def factor_lists(i):
    return _rounded(distribution.factor_values(
        i.table().withColumn("memOverallocationFactorX", F.expr(rounded("memOverallocationFactorX", 6)))
    ))


@_query
def mem_efficiency_hist(i):
    return distribution.memory_efficiency_histogram(i.table())


@_query
def mem_efficiency_of_days(i):
    return distribution.histogram_of_days(distribution.daily_with_bins(i.enriched()))


@_query
def factor_quantiles(i):
    daily = distribution.daily_with_bins(i.enriched())
    return _rounded(distribution.factor_quantiles(daily, quantiles=(0.25, 0.5, 0.9, 1.0)))


@_query
def daily_rates_long(i):
    return _rounded(distribution.daily_rates(i.daily()))


@_query
def success_split(i):
    return distribution.success_split(i.overall())


@_query
def daily_series(i):
    return _rounded(distribution.daily_series(i.daily()))


# Report

@_query
def energy_breakdown(i):
    return _rounded(report.energy_breakdown(i.overall()), 4)


@_query
def waste(i):
    return _rounded(report.waste(i.overall()), 3)


@_query
def usage_summary(i):
    return _rounded(report.usage_summary(i.overall()), 3)


@_query
def labels(i):
    return report.report_labels(summarise.with_share_within(i.overall(), ["UserX"]), i.params)


@_query
def labels_html(i):
    with_share = summarise.with_share_within(i.overall(), ["UserX"])
    return report.report_labels(with_share, i.params, html=True).select(
        "UserX", "carbonFootprint", "carbonFootprint_failedJobs", "carbonFootprint_wasted_memoryOverallocation"
    )


# Data quality

def dirty(logs: DataFrame) -> DataFrame:
    """The log with one thing wrong in most job rows, which one depending on the job id."""
    case = f"CASE {LOG_SEQ} WHEN 0 THEN CAST(replace({P.job_id('JobID')}, '_', '') AS BIGINT) % 25 END"
    changes = {
        "MaxRSS": {0: "5T", 1: "1.2.3K"},
        "ReqMem": {2: "12X", 3: "5Tn"},
        "Partition": {4: "cpu-std,cpu-himem", 5: "nope", 6: None, 7: "gpu-a", 8: "cpu-std"},
        "Elapsed": {9: "1-2-3", 10: "bad", 11: "1:2:3:4", 4: "00:10:00"},
        "TotalCPU": {12: "900-00:00:00"},
        "AllocTRES": {7: "billing=1,cpu=1,node=1", 8: "cpu=1,gres/gpu=1"},
        "UID": {13: None, 14: None},
        "User": {14: None},
        "Submit": {15: "2022-02-30T00:00:00", 16: "Unknown"},
        "NCPUS": {17: "x"},
    }
    new = {
        column: f"CASE {case} " + " ".join(f"WHEN {n} THEN {string(t)}" for n, t in cases.items()) + f" ELSE {name(column)} END"
        for column, cases in changes.items()
    }
    job = f"CAST(replace({P.job_id('JobID')}, '_', '') AS BIGINT) % 25"
    # Steps that name a partition as well: two texts, many, and two that would make up a real name.
    new["Partition"] = (
        f"CASE WHEN {LOG_SEQ} = 1 AND {job} = 20 THEN 'cpu-himem' WHEN {LOG_SEQ} > 0 AND {job} = 21 THEN 'cpu-' || {LOG_SEQ} "
        f"WHEN {LOG_SEQ} = 0 AND {job} = 22 THEN 'cpu-' WHEN {LOG_SEQ} = 1 AND {job} = 22 THEN 'std' ELSE {new['Partition']} END"
    )
    new["Account"] = f"CASE WHEN {job} <> 19 THEN Account END"
    new["JobID"] = f"CASE {case} WHEN 18 THEN '1_' || JobID || '_2' ELSE JobID END"
    return logs.selectExpr(*[f"{new[c]} AS {name(c)}" if c in new else name(c) for c in logs.columns])


@_query
def rollup_dirty(i):
    return _rounded(rollup.rollup_jobs(steps.clean_steps(dirty(i.logs), i.params)), 9)


def _enriched_dirty(i, keep=()):
    return pipeline.enriched_jobs(dirty(i.logs), i.params, keep=keep)


@_query
def daily_dirty(i):
    return _rounded(summarise.daily_summary(_enriched_dirty(i)))


@_query
def overall_dirty(i):
    return _rounded(summarise.overall_summary(summarise.daily_summary(_enriched_dirty(i))), 3)


@_query
def by_account_dirty(i):
    return _rounded(summarise.summarise_jobs(_enriched_dirty(i, keep=("Account_",)), ["Account_"]), 3)


@_query
def dq_violations(i):
    return quality.violations(dirty(i.logs), i.params.with_(default_unit_rss=None), users=True)


@_query
def dq_by_rule(i):
    return quality.violations_by_rule(quality.violations(dirty(i.logs), i.params))


@_query
def dq_observed(i):
    # Counted while the job table is written; rules that nothing breaks have no row.
    path = scratch_path(i.spark, "jobs-with-quality")
    counts = pipeline.write_jobs_with_quality(dirty(i.logs), i.params, path)
    rows = [f"struct('{rule}' AS rule, '{quality.RULES[rule]}' AS severity, {n}L AS n_jobs)" for rule, n in counts.items() if rule in quality.RULES]
    return i.spark.range(1).selectExpr(f"inline(array({', '.join(rows)}))").filter("n_jobs > 0")


@_query
def jobs_trusted(i):
    path = scratch_path(i.spark, "jobs-with-quality")
    pipeline.write_jobs_with_quality(dirty(i.logs), i.params, path)
    return _rounded(trusted_jobs(i.spark, path).select("single_jobID", *JOBS_SCHEMA.names))


@_query
def dq_jobs(i):
    # A table with some GPU time on CPU partitions and some types that are not the cluster's.
    n = "CAST(replace(single_jobID, '_', '') AS BIGINT)"
    jobs = _other_scheduler(pipeline.jobs_full(dirty(i.logs), i.params)).withColumns({
        "TotalGPUtime2useX": F.expr(f"CASE WHEN {n} % 25 = 3 THEN '1000' WHEN {n} % 25 = 5 THEN '0' ELSE TotalGPUtime2useX END"),
        "PartitionTypeX": F.expr(f"CASE WHEN {n} % 50 = 1 THEN 'CPU' ELSE PartitionTypeX END"),
    })
    return quality.job_violations(jobs_from_table(jobs, ("single_jobID",)), i.params, "single_jobID")


@_query
def dq_summary(i):
    return quality.summary(pipeline.jobs_full(dirty(i.logs), i.params))


def _runner(fn: Callable[[_Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_Inputs(spark, sf_dir))

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


# Keys where the name of the operator is already the name of a module function.
_KEYS = {"jobs_from_other_table": "jobs_from_table", "partition_dimension": "partition_dim"}


def catalog() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {_KEYS.get(name, name): _runner(fn) for name, fn in _QUERIES.items()}
