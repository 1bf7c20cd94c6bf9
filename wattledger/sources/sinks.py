"""Writing results."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from ..functions.sql import string
from ..session import scratch_path

DAY = "SubmitDate"


def write_table(df: DataFrame, path: str, mode: str = "errorifexists", fmt: str = "parquet") -> None:
    """Write one result table, laid out by submit day where it has one.

    Rows are rebalanced by day, so that a day is a few files of sensible size
    and a busy day is split over several tasks.
    """
    if DAY in df.columns:
        df.hint("rebalance", DAY).write.mode(mode).partitionBy(DAY).format(fmt).save(path)
    else:
        df.write.mode(mode).format(fmt).save(path)


def write_sorted(df: DataFrame, path: str, keys: Sequence[str] = ("UserX", DAY), fmt: str = "parquet", mode: str = "errorifexists") -> DataFrame:
    """Write a small result table in the order of its keys, without folders by day, and read it back."""
    df.orderBy(*[key for key in keys if key in df.columns]).write.mode(mode).format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the folder that all executors share and read it back.

    It is computed once, Spark knows its size from then on, and its lineage ends there.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_directory(directory: str, run: str | None = None) -> str:
    """A directory for one run: the given name, or the time in UTC and a few random characters."""
    name = run or f"{datetime.datetime.now(datetime.timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:6]}"
    return f"{directory.rstrip('/')}/{name}"


# Records of the tables that a run has finished, and the manifest of all of them, which it writes last.
_RECORDS, MANIFEST = "records", "manifest"
_RECORD = "table string, n_rows bigint"


def _small(spark: SparkSession, rows: dict[str, int]) -> DataFrame:
    entries = ", ".join(f"struct({string(name)} AS table, {n}L AS n_rows)" for name, n in rows.items())
    return spark.range(1, numPartitions=1).selectExpr(f"inline(array({entries}))")


def record_table(table: DataFrame, run: str, name: str) -> int:
    """Note that a table of a run is complete, with the number of rows that can be read from it."""
    n = table.count()
    _small(table.sparkSession, {name: n}).write.mode("overwrite").parquet(f"{run}/{_RECORDS}/{name}")
    return n


def _read_records(spark: SparkSession, path: str) -> list:
    try:
        return spark.read.schema(_RECORD).parquet(path).select("table", "n_rows", "_metadata.file_path").collect()
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise


def finished_tables(spark: SparkSession, run: str) -> dict[str, int]:
    """Table -> number of rows, of the tables that an unfinished or finished run completed."""
    return {row["table"]: row["n_rows"] for row in _read_records(spark, f"{run}/{_RECORDS}/*")}


def write_manifest(spark: SparkSession, run: str, rows: dict[str, int]) -> None:
    """Make a run visible: all its tables with their numbers of rows."""
    _small(spark, rows).coalesce(1).write.mode("overwrite").parquet(f"{run}/{MANIFEST}")


def finished_runs(spark: SparkSession, directory: str) -> dict[str, dict[str, int]]:
    """Run -> table -> number of rows, of all runs with a manifest, by name and so by time."""
    runs: dict[str, dict[str, int]] = {}
    for row in _read_records(spark, f"{directory.rstrip('/')}/*/{MANIFEST}"):
        runs.setdefault(unquote(row["file_path"]).split("/")[-3], {})[row["table"]] = row["n_rows"]
    return dict(sorted(runs.items()))


def read_run(spark: SparkSession, directory: str, run: str | None = None) -> dict[str, DataFrame]:
    """The tables of a finished run, the last one by name unless named; a run without a manifest is none."""
    runs = finished_runs(spark, directory)
    if not runs or (run is not None and run not in runs):
        named = "" if run is None else f" {run!r}"
        raise LookupError(f"no finished run{named} in {directory}")
    run = run or list(runs)[-1]
    return {name: spark.read.parquet(f"{directory.rstrip('/')}/{run}/{name}") for name in runs[run]}
