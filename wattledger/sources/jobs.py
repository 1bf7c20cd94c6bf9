"""Job tables of other schedulers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schemas import JOBS_SCHEMA, conform


def jobs_from_table(table: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Take a table of finished jobs as it is, in place of cleaning a log.

    It must have the 14 columns of the job contract (durations in milliseconds,
    memory in GB); types are cast, other columns dropped unless kept. The table
    may come from any source Spark reads.
    """
    return conform(table, JOBS_SCHEMA, "the job table", keep)


def trusted_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Jobs without an error from a table that ``plans.pipeline.write_jobs_with_quality`` wrote; only their files are read."""
    return spark.read.parquet(path).filter("CAST(trusted AS BOOLEAN)").drop("trusted", "broken_rules")


def refused_jobs(spark: SparkSession, path: str) -> DataFrame:
    """The others, with the rules they break."""
    return spark.read.parquet(path).filter("NOT CAST(trusted AS BOOLEAN)").drop("trusted")
