"""Cleaning: raw log rows to typed step rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions import parsing as P
from ..functions.sql import quoted, string
from ..params import ClusterParams, Clusters
from ..schemas import LOG_LACKS, LOG_SEQ, OPTIONAL_RAW_FIELDS, RAW_FIELDS, require_columns
from ..sources.dimensions import lookup_keys, with_parameters

# Whether the file of a row lacked a field whose default can only be decided for a whole job; in mixed logs only.
LACKS_ACCOUNT, LACKS_GPUS = "lacks_Account_", "lacks_AllocTRES_"


def clean_steps(
    logs: DataFrame, params: ClusterParams | Clusters, custom_success: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Type every field of the log and add the id of the job each row belongs to.

    A narrow projection: no shuffle, and columns nobody asks for later are
    never read. Logs from before CPUTime, AllocTRES or Account existed are
    recognised by their columns: core time becomes wallclock x cores, GPUs 0,
    account ''. In a log of files of different age that is decided by row: core
    time at once, GPUs and account once all rows of a job are together, since
    another row's file may tell. Of several clusters, every row keeps its cluster. ``keep`` are further expressions over the raw row.
    """
    require_columns(logs, [f for f in RAW_FIELDS if f not in OPTIONAL_RAW_FIELDS] + [LOG_SEQ], "the log")
    has = set(logs.columns)
    logs = with_parameters(logs, params)
    nodes, cores, wallclock = P.integer("NNodes"), P.integer("NCPUS"), P.duration_ms("Elapsed")
    core_wallclock = f"try_multiply({wallclock}, {cores})"
    if "CPUTime" in has:
        logged = P.duration_ms("CPUTime")
        core_wallclock = f"CASE WHEN {lacks(logs, 'CPUTime')} THEN {core_wallclock} ELSE {logged} END" if LOG_LACKS in has else logged
    fields = {
        # A log that is stored by job has the id already, and Spark knows that its rows lie together by it.
        "single_jobID": "single_jobID" if "single_jobID" in has else P.job_id("JobID"),
        "ReqMemX": P.requested_memory_gb("ReqMem", nodes, cores),
        "UsedMem_": P.max_rss_gb("MaxRSS", params.default_unit_rss),
        "WallclockTimeX": wallclock,
        "TotalCPUtime_": P.duration_ms("TotalCPU"),
        "CPUwallclocktime_": core_wallclock,
        "NGPUS_": P.gpu_count("AllocTRES") if "AllocTRES" in has else "0L",
        "PartitionX": P.first_partition("`Partition`"),
        "SubmitDatetimeX": P.submit_timestamp("Submit"),
        "NCPUS_": cores,
        "NNodes_": nodes,
        "JobName_": "JobName",
        "WorkingDir_": "WorkDir",
        "UIDX": "UID",
        "UserX": "`User`",
        "StateX": P.state_code("State", custom_success),
        "Account_": "Account" if "Account" in has else "CAST(NULL AS STRING)" if LOG_LACKS in has else "''",
    }
    if LOG_LACKS in has:
        fields |= {LACKS_ACCOUNT: lacks(logs, "Account"), LACKS_GPUS: lacks(logs, "AllocTRES")}
    return logs.selectExpr(LOG_SEQ, *lookup_keys(params), *[f"{text} AS {column}" for column, text in fields.items()], *keep)


def lacks(logs: DataFrame, field: str) -> str:
    """Condition: the log of a row does not have this optional field at all."""
    if field not in logs.columns:
        return "true"
    return f"array_contains({LOG_LACKS}, {string(field)})" if LOG_LACKS in logs.columns else "false"


def with_lacks(logs: DataFrame) -> DataFrame:
    """A log that says of every row what its file lacks; logs of one age get what their columns say."""
    if LOG_LACKS in logs.columns:
        return logs
    absent = quoted([f for f in OPTIONAL_RAW_FIELDS if f not in logs.columns])
    return logs.selectExpr("*", f"CAST(array({absent}) AS ARRAY<STRING>) AS {LOG_LACKS}")


def has_gpu_counts(logs: DataFrame) -> bool:
    """Whether the log can tell how many GPUs a job had; old ones cannot. Mixed ones tell by job, see LACKS_GPUS."""
    return "AllocTRES" in logs.columns
