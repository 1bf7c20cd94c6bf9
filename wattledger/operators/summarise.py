"""Summaries per day, per user or by any other keys."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from types import MappingProxyType

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sql import string
from .enrich import FOOTPRINT_VARIANTS

# Name in the summary -> column of the enriched job that is summed up.
_SUMS = {
    "energy": "energy",
    "energy_CPUs": "energy_CPUs",
    "energy_GPUs": "energy_GPUs",
    "energy_memory": "energy_memory",
    **{f"carbonFootprint{s}": f"carbonFootprint{s}" for s in FOOTPRINT_VARIANTS},
    "cpuTime": "TotalCPUtime2useX",
    "gpuTime": "TotalGPUtime2useX",
    "wallclockTime": "WallclockTimeX",
    "CPUhoursCharged": "CPUhoursChargedX",
    "GPUhoursCharged": "GPUhoursChargedX",
    "memoryRequested": "ReqMemX",
    "n_success": "StateX",
    **{f"treeMonths{s}": f"treeMonths{s}" for s in FOOTPRINT_VARIANTS},
    "driving": "driving",
    "flying_NY_SF": "flying_NY_SF",
    "flying_PAR_LON": "flying_PAR_LON",
    "flying_NYC_MEL": "flying_NYC_MEL",
    **{f"cost{s}": f"cost{s}" for s in FOOTPRINT_VARIANTS},
}

# Sums of milliseconds pass the range of a BIGINT at some billion jobs.
_MILLISECONDS = ("cpuTime", "gpuTime", "wallclockTime")


def _sum(column: str, source: str) -> str:
    return f"sum(CAST({source} AS DECIMAL(38, 0)))" if column in _MILLISECONDS else f"sum({source})"


# The 28 aggregates of a summary, in order.
SUMMARY_COLUMNS = (
    "n_jobs", "first_job_period", "last_job_period", *_SUMS, "memoryOverallocationFactor",
)


def _grouped(df: DataFrame, by: Sequence[str], aggregates: dict[str, str]) -> DataFrame:
    """Group by any number of keys; none means the whole set. A NULL key is a group of its own."""
    return _with_rates(df.groupBy(*by).agg(*[F.expr(f"{text} AS {column}") for column, text in aggregates.items()]))


def _with_rates(summary: DataFrame) -> DataFrame:
    return summary.selectExpr(
        "*", "try_divide(n_success, n_jobs) AS success_rate", "1D - try_divide(n_success, n_jobs) AS failure_rate"
    )


# Aggregates over enriched jobs.
_OF_JOBS = {
    "n_jobs": "count(UserX)",
    "first_job_period": "min(SubmitDatetimeX)",
    "last_job_period": "max(SubmitDatetimeX)",
    **{column: _sum(column, source) for column, source in _SUMS.items()},
    "memoryOverallocationFactor": "avg(memOverallocationFactorX)",
}

# Which of several groupings a row of ``summarise_sets`` belongs to, and the name of that of the whole set.
GROUPING = "grouping"
WHOLE = "all"


def summarise_sets(jobs: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """``summarise_jobs`` for several lists of keys at once, with one shuffle.

    Every job is sent once per list into the partial aggregation of its task; what is
    shuffled is one row per group and task. ``grouping`` has the keys of a row's list,
    joined by commas, or 'all' for the empty list; keys of other lists are NULL.
    The whole set is always among them, since its row has the totals that shares need.
    """
    lists = [tuple(keys) for keys in sets]
    lists += [()] * (() not in lists)
    if len({frozenset(keys) for keys in lists}) < len(lists):
        raise ValueError("a list of keys is given twice")
    keys = list(dict.fromkeys(key for each in lists for key in each))
    if GROUPING in keys:
        raise ValueError(f"{GROUPING!r} cannot be a key")
    # A key is aggregated away in a row if its bit is set, the first key having the highest.
    number = {each: sum(1 << (len(keys) - 1 - n) for n, key in enumerate(keys) if key not in each) for each in lists}
    cases = " ".join(f"WHEN {bits} THEN {string(','.join(each) or WHOLE)}" for each, bits in number.items())
    if not keys:
        summary = summarise_jobs(jobs)
        return summary.select(F.lit(WHOLE).alias(GROUPING), *summary.columns)
    grouped = jobs.groupingSets([[F.col(k) for k in each] for each in lists], *keys)
    summary = grouped.agg(
        F.grouping_id().alias("_set"), *[F.expr(f"{text} AS {column}") for column, text in _OF_JOBS.items()])
    return _with_rates(summary.selectExpr(f"CASE _set {cases} END AS {GROUPING}", *[c for c in summary.columns if c != "_set"]))


def with_share_in_sets(summary: DataFrame) -> DataFrame:
    """Share of each row of ``summarise_sets`` in the carbon footprint of the whole set.

    The total is the row of the whole set, a scalar subquery over the same table.
    Hand in a stored one, of which this reads one row more.
    """
    total = summary.filter(F.col(GROUPING) == WHOLE).select(F.max("carbonFootprint")).scalar()
    return summary.withColumn("share_carbonFootprint", F.try_divide(F.col("carbonFootprint"), total))


def summarise_jobs(jobs: DataFrame, by: Sequence[str] = (), further: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """28 aggregates of enriched jobs per group, with success and failure rates.

    Jobs without a user are part of every sum but not of ``n_jobs``; grouped by
    user they are a group of their own, so no job is lost. Plain partial
    aggregates: a hot user or day is combined before the shuffle. ``further`` are more
    aggregates of a fixed size, name -> expression.
    """
    return _grouped(jobs, by, {**_OF_JOBS, **further})


def summarise_summaries(summary: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summarise a summary further: sums of sums, extremes of extremes.

    The overallocation factor becomes the mean of the groups' means, as the
    report defines it, not the mean over jobs.
    """
    return _grouped(summary, by, {
        "n_jobs": "sum(n_jobs)",
        "first_job_period": "min(first_job_period)",
        "last_job_period": "max(last_job_period)",
        **{column: _sum(column, column) for column in _SUMS},
        "memoryOverallocationFactor": "avg(memoryOverallocationFactor)",
    })


def daily_summary(jobs: DataFrame, by: Sequence[str] = ("UserX",), further: Mapping[str, str] = MappingProxyType({})) -> DataFrame:
    """One row per submit day and ``by``."""
    return summarise_jobs(jobs, [*by, "SubmitDate"], further)


def overall_summary(daily: DataFrame, by: Sequence[str] = ("UserX",)) -> DataFrame:
    """One row per ``by``, from the daily table."""
    return summarise_summaries(daily, by)


def with_share_within(summary: DataFrame, within: Sequence[str] = ("UserX",)) -> DataFrame:
    """Share of each row in the carbon footprint of its group.

    For groups with few rows each, such as the days of a user.
    """
    total = F.sum("carbonFootprint").over(Window.partitionBy(*within))
    return summary.withColumn("share_carbonFootprint", F.try_divide(F.col("carbonFootprint"), total))


def with_share_of_all(summary: DataFrame) -> DataFrame:
    """Share of each row in the carbon footprint of the whole table.

    The total is a scalar subquery: the rows stay where they are, instead of
    going through the single task of a window without keys. It reads the
    summary a second time, so hand in a stored table where the summary is costly.
    """
    total = summary.agg(F.sum("carbonFootprint")).scalar()
    return summary.withColumn("share_carbonFootprint", F.try_divide(F.col("carbonFootprint"), total))
