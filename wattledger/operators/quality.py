"""Data quality: rules over log rows and jobs, as a table of violations.

Nothing stops because of a bad row. A report can be refused by the caller, or
with ``strict`` by the action that reads the violations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.sql import name, string
from ..params import CPU, GPU, ClusterParams
from ..schemas import LOG_LACKS
from ..sources.dimensions import partition_lookup
from . import derive, rollup, steps

# Rule -> severity.
RULES = {
    "R1": "error",  # memory unit is K, M or G
    "R2": "error",  # requested memory is readable
    "R3": "error",  # memory use without unit needs a default unit
    "R4": "warning",  # one partition on a job that ran
    "R5": "error",  # partition is known
    "R6": "error",  # durations are readable
    "R7": "error",  # CPU time is at most cores x wallclock
    "R8": "error",  # a GPU job that ran has GPUs
    "R9": "error",  # no GPUs on a CPU partition
    "R10": "error",  # a job id has at most one underscore
    "R11": "warning",  # UID and user are known
    "R12": "info",  # more than one user
    "R13": "error",  # submit time is readable
    "R14": "error",  # node and core counts are integers
}

_BARE_NUMBER = "^[0-9.]+$"
# A request per node or per core whose unit is not one of K, M, G.
_BAD_REQUEST_UNIT = "^[0-9.]+[A-Za-z&&[^KMG]][nc]$"


def _row_rules(logs: DataFrame, params: ClusterParams) -> dict[str, str]:
    """Rules on log rows: rule -> the offending text of a row, NULL when the row is fine."""
    columns = logs.columns

    def unreadable(column: str, parsed: str) -> str:
        return f"CASE WHEN {parsed} IS NULL THEN '{column}=' || coalesce({column}, 'NULL') END"

    bad_unit = f"coalesce(ReqMem RLIKE {string(_BAD_REQUEST_UNIT)}, false)"
    use = P.max_rss_gb("MaxRSS", params.default_unit_rss or "K")
    request = P.requested_memory_gb("ReqMem", "1L", "1L")
    durations = [unreadable(c, P.duration_ms(c)) for c in ("Elapsed", "TotalCPU", "CPUTime") if c in columns]
    if LOG_LACKS in columns:  # a field that the file does not have is not unreadable
        durations[2:] = [f"CASE WHEN NOT {steps.lacks(logs, 'CPUTime')} THEN {durations[2]} END"]
    rules = {
        "R1": f"CASE WHEN MaxRSS IS NOT NULL AND {use} IS NULL THEN 'MaxRSS=' || MaxRSS "
        f"WHEN {bad_unit} THEN 'ReqMem=' || ReqMem END",
        "R2": f"CASE WHEN NOT {bad_unit} THEN {unreadable('ReqMem', request)} END",
        "R4": f"CASE WHEN contains(`Partition`, ',') AND {P.duration_ms('Elapsed')} > 0 THEN 'Partition=' || `Partition` END",
        "R6": f"coalesce({', '.join(durations)})",
        "R13": unreadable("Submit", P.submit_timestamp("Submit")),
        "R14": f"coalesce({unreadable('NNodes', P.integer('NNodes'))}, {unreadable('NCPUS', P.integer('NCPUS'))})",
    }
    if params.default_unit_rss is None:
        rules["R3"] = (
            f"CASE WHEN MaxRSS RLIKE {string(_BARE_NUMBER)} AND MaxRSS <> '0' THEN 'MaxRSS=' || MaxRSS END"
        )
    return rules


# Rules on finished jobs, in the same form.
_JOB_RULES = {
    "R5": "CASE WHEN PartitionTypeX IS NULL THEN CASE WHEN n_partitions_ > 1 "
    "THEN 'partitions=' || n_partitions_ || ' first=' || PartitionX || ' last=' || last_partition_ ELSE 'PartitionX=' || PartitionX END END",
    "R7": "CASE WHEN TotalCPUtime_ > CPUwallclocktime_ THEN TotalCPUtime_ || ' > ' || CPUwallclocktime_ END",
    "R8": f"CASE WHEN PartitionTypeX = '{GPU}' AND NGPUS_ = 0 AND WallclockTimeX > 0 THEN 'GPUs=' || NGPUS_ END",
    "R9": f"CASE WHEN PartitionTypeX = '{CPU}' AND NGPUS_ <> 0 THEN 'GPUs=' || NGPUS_ END",
    "R10": "CASE WHEN single_jobID LIKE '%\\\\_%\\\\_%' THEN 'JobID=' || single_jobID END",
    "R11": "CASE WHEN UIDX IS NULL OR UserX IS NULL "
    "THEN 'UID=' || coalesce(UIDX, 'NULL') || ' User=' || coalesce(UserX, 'NULL') END",
}


def _flagged_jobs(logs: DataFrame, params: ClusterParams, custom_success: Sequence[str]) -> DataFrame:
    """One row per job: what the job rules need, and per row rule the smallest offending text.

    Reads the log once and shuffles it once: the findings on rows are aggregates
    of the same roll-up as the jobs. They are computed next to the typed columns,
    on the raw text.
    """
    findings = {f"_{rule}": text for rule, text in _row_rules(logs, params).items()}
    typed = steps.clean_steps(logs, params, custom_success, keep=[f"{t} AS {c}" for c, t in findings.items()])
    aggregates = {
        **{c: f"max({c})" for c in ("TotalCPUtime_", "CPUwallclocktime_", "WallclockTimeX", "NGPUS_")},
        "StateX": "min(StateX)",
        **{c: rollup.first_logged(c) for c in ("UIDX", "UserX")},
        **rollup.partition_texts(),
        **{c: f"min({c})" for c in findings},
        **{c: f"bool_and({c})" for c in (steps.LACKS_GPUS,) if c in typed.columns},
    }
    jobs = typed.groupBy("single_jobID").agg(*[F.expr(f"{text} AS {c}") for c, text in aggregates.items()])
    return derive.default_gpus(derive.attach_hardware(jobs, params), steps.has_gpu_counts(logs))


def violations(
    logs: DataFrame, params: ClusterParams, custom_success: Sequence[str] = (), strict: bool = False, users: bool = False
) -> DataFrame:
    """(rule, severity, jobID, detail), one row per violated rule and job.

    ``detail`` is the smallest offending text among the rows of the job. Rules
    on rows look at every job, rules on jobs at finished ones. With ``strict``
    the action fails at the first violation of severity error. With ``users``
    there is a row of rule R12 if finished jobs have more than one user; it comes
    from the same roll-up, at the price of one small shuffle of the violations.
    """
    jobs = _flagged_jobs(logs, params, custom_success)
    found = {rule: f"_{rule}" for rule in RULES if f"_{rule}" in jobs.columns}
    found |= {rule: f"CASE WHEN StateX <> {P.STATE_UNFINISHED} THEN {text} END" for rule, text in _JOB_RULES.items()}
    entries = [
        f"CASE WHEN ({text}) IS NOT NULL THEN struct('{rule}' AS rule, '{RULES[rule]}' AS severity, {text} AS detail) END"
        for rule, text in found.items()
    ]
    if users:
        entries.append(
            f"CASE WHEN StateX <> {P.STATE_UNFINISHED} AND UserX IS NOT NULL THEN struct('R12' AS rule, '{RULES['R12']}' AS severity, UserX AS detail) END")
    out = jobs.selectExpr(
        "single_jobID AS jobID", f"inline(array_compact(array({', '.join(entries)})))"
    ).select("rule", "severity", "jobID", "detail")
    if users:
        own = "rule <> 'R12'"
        out = out.selectExpr(
            "rule", "severity", f"CASE WHEN {own} THEN jobID END AS jobID", f"CASE WHEN {own} THEN detail END AS detail",
            f"CASE WHEN NOT {own} THEN detail END AS user",
        ).groupBy("rule", "severity", "jobID", "detail").agg(F.count_distinct("user").alias("n")).filter(f"{own} OR n > 1").selectExpr(
            "rule", "severity", "jobID", f"CASE WHEN {own} THEN detail ELSE 'users=' || n END AS detail")
    return _stopping(out) if strict else out


# The rules that a job table can be judged by, which has times of use instead of counts.
_TABLE_RULES = {
    "R5": "CASE WHEN _known IS NULL OR PartitionTypeX IS NULL OR PartitionTypeX <> _known THEN 'PartitionX=' || coalesce(PartitionX, 'NULL') "
    "|| CASE WHEN PartitionTypeX <> _known THEN ' PartitionTypeX=' || PartitionTypeX ELSE '' END END",
    "R8": f"CASE WHEN PartitionTypeX = '{GPU}' AND coalesce(TotalGPUtime2useX, 0L) = 0 AND WallclockTimeX > 0 "
    "THEN 'TotalGPUtime2useX=' || coalesce(CAST(TotalGPUtime2useX AS STRING), 'NULL') END",
    "R9": f"CASE WHEN PartitionTypeX = '{CPU}' AND TotalGPUtime2useX <> 0 THEN 'TotalGPUtime2useX=' || TotalGPUtime2useX END",
    "R11": _JOB_RULES["R11"],
}


def job_violations(jobs: DataFrame, params: ClusterParams, id_column: str | None = None, strict: bool = False) -> DataFrame:
    """(rule, severity, jobID, detail) of a job table, such as another scheduler delivers it, in place of a log.

    R5 also covers a type of partition that is not the cluster's; R8 and R9 go by GPU
    time, since a job table has no GPU counts. Without ``id_column`` the id is NULL.
    A broadcast lookup and a projection: no shuffle.
    """
    dim = partition_lookup(jobs.sparkSession, params).selectExpr("partition AS _partition", "type AS _known")
    found = jobs.join(dim, F.expr("PartitionX = _partition"), "left")
    job = f"CAST({name(id_column)} AS STRING)" if id_column else "CAST(NULL AS STRING)"
    return _listed(found, _TABLE_RULES, job, strict)


def _listed(jobs: DataFrame, rules: dict[str, str], job: str, strict: bool) -> DataFrame:
    """One row per rule whose text is not NULL."""
    entries = [
        f"CASE WHEN ({text}) IS NOT NULL THEN struct('{rule}' AS rule, '{RULES[rule]}' AS severity, {text} AS detail) END"
        for rule, text in rules.items()
    ]
    out = jobs.selectExpr(f"{job} AS jobID", f"inline(array_compact(array({', '.join(entries)})))").select(
        "rule", "severity", "jobID", "detail")
    return _stopping(out) if strict else out


def _stopping(found: DataFrame) -> DataFrame:
    """Fail the action at the first violation of severity error."""
    message = F.concat_ws(" ", F.lit("data quality:"), "rule", "jobID", "detail")
    # In a filter, which decides about rows, so no choice of columns can leave it out.
    return found.filter(F.when(F.col("severity") == "error", F.raise_error(message).cast("boolean")).otherwise(F.lit(True)))


# Rules that a job breaks, as a column of a job table, and whether one of them is an error.
BROKEN, TRUSTED = "broken_rules", "trusted"


def with_findings(logs: DataFrame, params: ClusterParams, custom_success: Sequence[str] = ()) -> DataFrame:
    """Finished and unfinished jobs with what their rows say and every rule they break.

    The roll-up to jobs and the findings on their rows come from one aggregation, so a
    job table and its quality cost one read and one shuffle of the log. ``broken_rules``
    holds (rule, severity, detail), at most one per rule; ``trusted`` is false if one of
    them is an error.
    """
    findings = {f"_{rule}": text for rule, text in _row_rules(logs, params).items()}
    typed = steps.clean_steps(logs, params, custom_success, keep=[f"{t} AS {c}" for c, t in findings.items()])
    rolled = rollup.rollup_jobs(typed, further={c: f"min({c})" for c in findings})
    jobs = derive.derive_jobs(rolled, params, steps.has_gpu_counts(logs))
    rules = {rule[1:]: rule for rule in findings}
    rules |= {rule: f"CASE WHEN StateX <> {P.STATE_UNFINISHED} THEN {text} END" for rule, text in _JOB_RULES.items()}
    entries = [
        f"CASE WHEN ({text}) IS NOT NULL THEN struct('{rule}' AS rule, '{RULES[rule]}' AS severity, {text} AS detail) END"
        for rule, text in rules.items()
    ]
    found = jobs.selectExpr("*", f"array_compact(array({', '.join(entries)})) AS {BROKEN}").drop(*findings)
    return found.selectExpr("*", f"NOT exists({BROKEN}, x -> x.severity = 'error') AS {TRUSTED}")


def observed(jobs: DataFrame, observation: Observation) -> DataFrame:
    """The same jobs; while they are written or counted, the number of jobs that break each rule is counted along."""
    counts = [F.expr(f"count_if(exists({BROKEN}, x -> x.rule = '{rule}'))").alias(rule) for rule in RULES if rule != "R12"]
    return jobs.observe(observation, F.count(F.lit(1)).alias("n_jobs"), *counts)


def several_users(jobs: DataFrame) -> DataFrame:
    """Rule R12 over the whole set: one row when jobs of more than one user are present."""
    users = jobs.groupBy().agg(F.count_distinct("UserX").alias("n")).filter(F.col("n") > 1)
    return users.select(
        F.lit("R12").alias("rule"),
        F.lit(RULES["R12"]).alias("severity"),
        F.lit(None).cast("string").alias("jobID"),
        F.concat(F.lit("users="), F.col("n").cast("string")).alias("detail"),
    )


def violations_by_rule(found: DataFrame) -> DataFrame:
    return found.groupBy("rule", "severity").agg(F.count(F.lit(1)).alias("n_jobs"))


def summary(jobs: DataFrame) -> DataFrame:
    """One row about a job table: jobs, distinct users, missing UIDs and users, several users or not."""
    return jobs.groupBy().agg(
        F.count(F.lit(1)).alias("n_jobs"),
        F.count_distinct("UserX").alias("n_users"),
        F.count_if(F.col("UIDX").isNull()).alias("n_missing_uid"),
        F.count_if(F.col("UserX").isNull()).alias("n_missing_user"),
    ).withColumn("several_users", (F.col("n_users") > 1).cast("int"))
