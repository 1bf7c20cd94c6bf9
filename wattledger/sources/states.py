"""States of the roll-up, kept by slice of the log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE = "slice"


def write_slice(state: DataFrame, path: str, name: str) -> None:
    """Keep the state of one slice; a slice of the same name is replaced, others are not touched."""
    if not name or "/" in name or "=" in name:
        raise ValueError(f"not a usable name of a slice: {name!r}")
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{SLICE}={name}")


def read_slices(spark: SparkSession, path: str, names: Sequence[str] | None = None) -> DataFrame:
    """The states of all slices, or of the named ones, whose folders alone are read."""
    states = spark.read.option("basePath", path).parquet(path)
    if names is not None:
        states = states.filter(F.col(SLICE).cast("string").isin(*names))
    return states.drop(SLICE)
