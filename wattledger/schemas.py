"""Column contracts between the stages of the pipeline.

Durations are BIGINT milliseconds, memory is DOUBLE gigabytes, timestamps carry
no zone. A column whose name ends in ``X`` is public, one ending in ``_`` is
only used while a job is being cleaned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .functions.sql import name

# Fields of a raw accounting log, one row per job and per job step.
RAW_FIELDS = (
    "UID", "User", "JobID", "JobName", "Submit", "Elapsed", "Partition", "NNodes", "NCPUS",
    "TotalCPU", "CPUTime", "ReqMem", "MaxRSS", "WorkDir", "State", "Account", "AllocTRES",
)

# Older logs lack these; see operators.steps for what stands in for them.
OPTIONAL_RAW_FIELDS = ("CPUTime", "Account", "AllocTRES")

# Position of a row in the log. Any orderable type will do.
LOG_SEQ = "log_seq"

# Optional fields that the file of a row lacks, where files of different age are read together.
LOG_LACKS = "log_lacks"

RAW_SCHEMA = T.StructType([T.StructField(f, T.StringType()) for f in RAW_FIELDS])

# One row per finished job: the hand-over between cleaning and footprint
# estimation, and the table that other schedulers have to supply.
JOBS_SCHEMA = T.StructType([
    T.StructField("WallclockTimeX", T.LongType()),
    T.StructField("ReqMemX", T.DoubleType()),
    T.StructField("PartitionX", T.StringType()),
    T.StructField("SubmitDatetimeX", T.TimestampNTZType()),
    T.StructField("StateX", T.IntegerType()),
    T.StructField("UIDX", T.StringType()),
    T.StructField("UserX", T.StringType()),
    T.StructField("PartitionTypeX", T.StringType()),
    T.StructField("TotalCPUtime2useX", T.LongType()),
    T.StructField("TotalGPUtime2useX", T.LongType()),
    T.StructField("CPUhoursChargedX", T.DoubleType()),
    T.StructField("GPUhoursChargedX", T.DoubleType()),
    T.StructField("NeededMemX", T.DoubleType()),
    T.StructField("memOverallocationFactorX", T.DoubleType()),
])


def require_columns(df: DataFrame, names, what: str) -> None:
    """Raise when a plan lacks columns; looks at the schema only, runs no job."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {missing}")


def conform(df: DataFrame, schema: T.StructType, what: str, extra=()) -> DataFrame:
    """Project to ``schema`` (plus ``extra`` columns as they are), casting where needed."""
    require_columns(df, [*schema.names, *extra], what)
    casts = [f"CAST({name(f.name)} AS {f.dataType.simpleString()}) AS {name(f.name)}" for f in schema]
    return df.selectExpr(*casts, *[name(c) for c in extra])
