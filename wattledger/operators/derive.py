"""Per-job quantities: hardware, time used, core hours, memory needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.sql import double
from ..params import CPU, GPU, ClusterParams, Clusters
from ..schemas import JOBS_SCHEMA, conform
from ..sources.dimensions import POWER_COLUMNS, lookup_keys, partition_lookup, with_parameters, without_parameters
from .steps import LACKS_GPUS

MS_PER_HOUR = 3.6e6


def attach_hardware(jobs: DataFrame, params: ClusterParams | Clusters) -> DataFrame:
    """PartitionTypeX and the power draws by one equi-lookup; NULL for a partition the cluster does not have.

    A job whose rows name several partitions has none.
    """
    keys = lookup_keys(params)
    dim = partition_lookup(jobs.sparkSession, params).selectExpr(
        *[f"{key} AS _in_{key}" for key in keys], "partition AS _named", "type AS PartitionTypeX",
        *[f"{column} AS {hidden}" for column, hidden in POWER_COLUMNS.items()],
    )
    same = ["PartitionX = _named", *[f"{key} = _in_{key}" for key in keys], *["n_partitions_ = 1"] * ("n_partitions_" in jobs.columns)]
    return jobs.join(dim, F.expr(" AND ".join(same)), "left").drop("_named", *[f"_in_{key}" for key in keys])


def default_gpus(jobs: DataFrame, gpus_logged: bool) -> DataFrame:
    """One GPU per job on GPU partitions when the log cannot tell; in a mixed log, none of the files of the job's rows."""
    if gpus_logged and LACKS_GPUS not in jobs.columns:
        return jobs
    untold = LACKS_GPUS if LACKS_GPUS in jobs.columns else "true"
    told = jobs.withColumn("NGPUS_", F.expr(f"CASE WHEN PartitionTypeX = '{GPU}' AND {untold} THEN 1L ELSE NGPUS_ END"))
    return told.drop(LACKS_GPUS)


# CPU time, or all cores for the whole wallclock where no use was logged.
CPU_TIME_TO_USE = "CASE TotalCPUtime_ WHEN 0 THEN CPUwallclocktime_ ELSE TotalCPUtime_ END"
# GPUs count as fully used for the whole wallclock.
_GPU_TIME = "try_multiply(WallclockTimeX, NGPUS_)"
GPU_TIME_TO_USE = f"CASE PartitionTypeX WHEN '{GPU}' THEN {_GPU_TIME} ELSE 0L END"
# Hours are charged for the cores on CPU partitions, for the GPUs on GPU partitions.
CPU_HOURS_CHARGED = (
    f"CASE PartitionTypeX WHEN '{CPU}' THEN CPUwallclocktime_ / {MS_PER_HOUR}D WHEN '{GPU}' THEN 0D END"
)
GPU_HOURS_CHARGED = f"CASE PartitionTypeX WHEN '{GPU}' THEN {_GPU_TIME} / {MS_PER_HOUR}D WHEN '{CPU}' THEN 0D END"
# Memory used, or all that was requested where no use was logged.
USED_MEMORY = f"CASE UsedMem_ WHEN {P.RSS_NOT_LOGGED}D THEN ReqMemX ELSE UsedMem_ END"
# Memory requested over memory needed, at least 1; NULL for 0 over 0.
OVERALLOCATION_FACTOR = "CASE WHEN ReqMemX < NeededMemX THEN 1D ELSE try_divide(ReqMemX, NeededMemX) END"


def needed_memory(used: str, granularity: float) -> str:
    """Smallest multiple of ``granularity`` strictly above the use, at most the request.

    A request below the use is a logging error and does not cap the need.
    """
    step = double(granularity)
    above = f"((floor({used} / {step}) + 1) * {step})"
    return (
        f"CASE WHEN ReqMemX < {used} THEN {above} WHEN ReqMemX IS NOT NULL AND {used} IS NOT NULL "
        f"THEN least(ReqMemX, {above}) END"
    )


def derive_jobs(jobs: DataFrame, params: ClusterParams | Clusters, gpus_logged: bool = True) -> DataFrame:
    """Add partition type, time to use, hours charged, memory needed and its factor.

    A broadcast lookup and projections: no shuffle beyond the roll-up's.
    """
    typed = with_parameters(default_gpus(attach_hardware(jobs, params), gpus_logged), params)
    derived = (
        typed.selectExpr(
            "*",
            f"{USED_MEMORY} AS UsedMem2_",
            f"{CPU_TIME_TO_USE} AS TotalCPUtime2useX",
            f"{GPU_TIME_TO_USE} AS TotalGPUtime2useX",
            f"{CPU_HOURS_CHARGED} AS CPUhoursChargedX",
            f"{GPU_HOURS_CHARGED} AS GPUhoursChargedX",
            f"{P.parent_job_id('single_jobID')} AS parentJobID",
        )
        .selectExpr("*", f"{needed_memory('UsedMem2_', params.granularity_memory_request)} AS NeededMemX")
        .selectExpr("*", f"{OVERALLOCATION_FACTOR} AS memOverallocationFactorX")
    )
    return without_parameters(derived, params)


def job_contract(jobs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The 14 public columns, plus ``keep`` for grouping by something else later.

    Power draws that were looked up along with the partition type stay on board,
    which spares the energy estimate a second lookup.
    """
    power = tuple(c for c in POWER_COLUMNS.values() if c in jobs.columns and c not in keep)
    return conform(jobs, JOBS_SCHEMA, "the job table", (*keep, *power))
