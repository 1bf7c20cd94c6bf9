"""Roll-up of step rows to one row per job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..schemas import LOG_SEQ
from .steps import LACKS_ACCOUNT, LACKS_GPUS

_LARGEST = (
    "TotalCPUtime_", "CPUwallclocktime_", "WallclockTimeX", "ReqMemX", "UsedMem_",
    "NCPUS_", "NGPUS_", "NNodes_",
)
_SMALLEST = ("SubmitDatetimeX", "StateX")
_FIRST = ("JobName_", "WorkingDir_", "Account_", "UIDX", "UserX")


def first_logged(column: str) -> str:
    """First non-null value in log order.

    An aggregate with a fixed-size state, so that it is combined before the
    shuffle like a ``min``.
    """
    return f"min_by({column}, CASE WHEN {column} IS NOT NULL THEN {LOG_SEQ} END)"


def partition_texts() -> dict[str, str]:
    """The partition texts of a job's rows: the first and the last in log order, and how many there are.

    Schedulers name the partition on one row per job. However many rows name
    one, the state has a fixed size and the rule is the same: a job with more
    than one text finds no hardware (operators.derive) and is reported by
    operators.quality. ``partition_rows`` lists all of them.
    """
    text = "nullif(PartitionX, '')"
    order = f"CASE WHEN PartitionX <> '' THEN {LOG_SEQ} END"
    return {
        "PartitionX": f"coalesce(min_by({text}, {order}), '')",
        "n_partitions_": f"count({text})",
        "last_partition_": f"max_by({text}, {order})",
    }


def partition_rows(steps: DataFrame) -> DataFrame:
    """(single_jobID, position, PartitionX): every partition text of every job, by its place in the log."""
    return steps.filter("PartitionX <> ''").select("single_jobID", F.col(LOG_SEQ).alias("position"), "PartitionX")


def rollup_jobs(steps: DataFrame, within: Sequence[str] = (), further: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """One row per ``single_jobID``, or per id ``within`` a cluster where each has ids of its own.

    The only shuffle of the raw rows. All aggregates have a bounded state and
    are combined on the map side, so a job that holds a large part of all rows
    sends one row per task. Array elements are jobs of their own. ``further`` are more
    aggregates of a fixed size, name -> expression. A log that is stored by job
    (``sources.logs.land_bucketed``) is not shuffled at all.
    """
    aggregates = {
        **{c: f"max({c})" for c in _LARGEST},
        **{c: f"min({c})" for c in _SMALLEST},
        **{c: first_logged(c) for c in _FIRST},
        **partition_texts(),
        **{c: f"bool_and({c})" for c in (LACKS_ACCOUNT, LACKS_GPUS) if c in steps.columns},
        **further,
    }
    return mixed_account(steps.groupBy(*within, "single_jobID").agg(*[F.expr(text).alias(c) for c, text in aggregates.items()]))


def mixed_account(jobs: DataFrame) -> DataFrame:
    """Account '' for jobs none of whose rows is from a file with accounts, in a log of files of different age."""
    if LACKS_ACCOUNT not in jobs.columns:
        return jobs
    return jobs.withColumn("Account_", F.expr(f"CASE WHEN {LACKS_ACCOUNT} THEN '' ELSE Account_ END")).drop(LACKS_ACCOUNT)


# State column -> how two states of a job become one. First and last values carry their place in the log.
_MERGE = {
    **{c: "max" for c in _LARGEST},
    **{c: "min" for c in _SMALLEST},
    **{c: "min" for c in _FIRST},
    "PartitionX": "min",
    "n_partitions_": "sum",
    "last_partition_": "max",
    LACKS_ACCOUNT: "bool_and",
    LACKS_GPUS: "bool_and",
}


def rollup_state(steps: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """``rollup_jobs`` of a slice of the log in a form that can be merged with that of other slices.

    One row per job, of bounded size: largest and smallest values, counts, and every
    first or last text together with its position. Whether the slice's log tells
    accounts and GPUs is part of it, so slices of different age can be merged.
    """
    def placed(condition: str, column: str) -> str:
        return f"CASE WHEN {condition} THEN struct({LOG_SEQ} AS position, {column} AS value) END"

    sources = {
        **{c: placed(f"{c} IS NOT NULL", c) for c in _FIRST},
        "PartitionX": placed("PartitionX <> ''", "PartitionX"),
        "n_partitions_": "CASE WHEN PartitionX <> '' THEN 1L ELSE 0L END",
        "last_partition_": placed("PartitionX <> ''", "PartitionX"),
        **{c: "false" for c in (LACKS_ACCOUNT, LACKS_GPUS) if c not in steps.columns},
    }
    aggregates = [F.expr(f"{how}({sources.get(c, c)})").alias(c) for c, how in _MERGE.items()]
    return steps.groupBy(*within, "single_jobID").agg(*aggregates)


def merge_states(states: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """One state per job from any number of them, in any order and however often merged before."""
    return states.groupBy(*within, "single_jobID").agg(*[F.expr(f"{how}({c})").alias(c) for c, how in _MERGE.items()])


def jobs_of_states(states: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """What ``rollup_jobs`` gives for all rows that merged states were made of; one state per job."""
    values = {**{c: f"{c}.value" for c in (*_FIRST, "last_partition_")}, "PartitionX": "coalesce(PartitionX.value, '')"}
    return mixed_account(states.selectExpr(*within, "single_jobID", *[f"{values.get(c, c)} AS {c}" for c in _MERGE]))


def finished_jobs(jobs: DataFrame) -> DataFrame:
    """Drop jobs with an unfinished step, count the caller's own success states as success."""
    return recoded(jobs.filter(f"StateX <> {P.STATE_UNFINISHED}"))


def recoded(jobs: DataFrame) -> DataFrame:
    state = f"CASE StateX WHEN {P.STATE_CUSTOM_SUCCESS} THEN {P.STATE_SUCCESS} ELSE StateX END"
    return jobs.withColumn("StateX", F.expr(state))
