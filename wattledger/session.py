"""Session settings the pipeline is tuned for."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Runtime settings, applied unless the session sets them itself.
# HotSpot never compiles a method of more than 8000 bytes of bytecode. Reading a
# log row is one large projection; past that size Spark is told to use
# projections split into small methods, which run several times faster than one
# large method that is interpreted for good.
_RUNTIME = {
    "spark.sql.codegen.hugeMethodLimit": ("65535", "8000"),
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings above where the session still has Spark's defaults."""
    for key, (default, value) in _RUNTIME.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, value)
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table in the folder that all executors share.

    That is the session's ``spark.checkpoint.dir``. Where it is not set, only a
    session whose tasks all run in this process gets a temporary folder instead;
    on a cluster that would be a folder of one machine, so it is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="run-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
