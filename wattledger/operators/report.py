"""Figures and texts of a report, for all users at once.

All of these are projections of the overall summary, one row per user.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..params import ClusterParams

_PARTS = ("energy_CPUs", "energy_GPUs", "energy_memory")
# Measures for which the part due to memory that was not needed is reported.
_WASTED = ("carbonFootprint", "treeMonths", "cost")


def energy_breakdown(overall: DataFrame, ids=("UserX",)) -> DataFrame:
    """Energy of each component and of the overheads, in kWh and as shares."""
    total = F.col("energy")
    overheads = total - F.col("energy_CPUs") - F.col("energy_GPUs") - F.col("energy_memory")
    return overall.select(
        *ids,
        "energy",
        *_PARTS,
        overheads.alias("energy_overheads"),
        *[F.try_divide(F.col(p), total).alias(f"share_{p}") for p in _PARTS],
        F.try_divide(overheads, total).alias("share_energy_overheads"),
    )


def waste(overall: DataFrame, ids=("UserX",)) -> DataFrame:
    """What failed jobs and memory that was not needed account for."""
    return overall.select(
        *ids,
        "failure_rate",
        *[f"{m}_failedJobs" for m in _WASTED],
        F.try_divide(F.col("carbonFootprint_failedJobs"), F.col("carbonFootprint")).alias(
            "carbonFootprint_failedJobs_share"
        ),
        "memoryOverallocationFactor",
        *[
            (F.col(m) - F.col(f"{m}_memoryNeededOnly")).alias(f"{m}_wasted_memoryOverallocation")
            for m in _WASTED
        ],
    )


def usage_summary(overall: DataFrame, ids=("UserX",)) -> DataFrame:
    """Period covered, number of jobs, hours used and charged, memory requested."""
    return overall.select(
        *ids,
        F.to_date("first_job_period").alias("first_job_date"),
        F.to_date("last_job_period").alias("last_job_date"),
        "n_jobs",
        "n_success",
        "CPUhoursCharged",
        "GPUhoursCharged",
        (F.col("CPUhoursCharged") + F.col("GPUhoursCharged")).alias("hoursCharged"),
        "cpuTime",
        (F.col("cpuTime") / F.lit(3.6e6)).alias("cpuHours"),
        "gpuTime",
        (F.col("gpuTime") / F.lit(3.6e6)).alias("gpuHours"),
        "wallclockTime",
        "memoryRequested",
    )


def report_labels(overall: DataFrame, params: ClusterParams, ids=("UserX",), html: bool = False) -> DataFrame:
    """The texts of a report. Needs ``share_carbonFootprint`` in the overall summary."""
    def wasted(measure: str) -> str:
        return f"({measure} - {measure}_memoryNeededOnly)"

    texts = {
        "cpuTime": L.short_duration("cpuTime"),
        "gpuTime": L.short_duration("gpuTime"),
        "carbonFootprint": L.footprint("carbonFootprint", html),
        "carbonFootprint_failedJobs": L.footprint("carbonFootprint_failedJobs", html),
        "carbonFootprint_failedJobs_share": L.percent("try_divide(carbonFootprint_failedJobs, carbonFootprint)"),
        "carbonFootprint_wasted_memoryOverallocation": L.footprint(wasted("carbonFootprint"), html),
        "share_carbonFootprint": L.percent("share_carbonFootprint"),
        "trees": L.tree_months("treeMonths", split_years=False),
        "trees_split": L.tree_months("treeMonths"),
        "trees_failedJobs": L.tree_months("treeMonths_failedJobs"),
        "trees_wasted_memoryOverallocation": L.tree_months(wasted("treeMonths")),
        "driving": L.driving("driving"),
        "flying": L.flying(),
        "flying_number": L.flying_number(),
        "flying_trip": L.flying_trip(),
        "cost": L.cost("cost", params.currency),
        "cost_failedJobs": L.cost("cost_failedJobs", params.currency),
        "cost_wasted_memoryOverallocation": L.cost(wasted("cost"), params.currency),
        "n_jobs": L.grouped("n_jobs", 0),
        "failure_rate": L.percent("failure_rate", 1),
        "memoryOverallocationFactor": L.grouped("memoryOverallocationFactor", 1),
    }
    return overall.selectExpr(*ids, *[f"{text} AS {column}" for column, text in texts.items()])
