"""Choice of jobs: period, directory, ids, account."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import job_id, parent_job_id
from ..functions.sql import name, string
from ..schemas import LOG_LACKS


def parse_period(start: str, end: str) -> tuple[datetime.date, datetime.date]:
    """Check two YYYY-MM-DD days and their order, before anything is planned."""
    days = []
    for text in (start, end):
        try:
            days.append(datetime.datetime.strptime(text, "%Y-%m-%d").date())
        except ValueError:
            raise ValueError(f"not a day in the form YYYY-MM-DD: {text!r}") from None
    if days[0] > days[1]:
        raise ValueError(f"the period starts on {start}, after its end on {end}")
    return days[0], days[1]


def in_period(jobs: DataFrame, start: str, end: str) -> DataFrame:
    """Jobs submitted from the first to the last day, both included.

    On jobs, not on log rows: a job's submit time is the earliest of its rows,
    and cutting rows at a day boundary would cut jobs in two.
    """
    first, last = parse_period(start, end)
    submitted = F.col("SubmitDatetimeX")
    upper = last + datetime.timedelta(days=1)
    if "SubmitDate" in jobs.columns:  # stored job tables are laid out by it, so that only these days are read
        day = F.col("SubmitDate")
        jobs = jobs.filter((day >= F.lit(first.isoformat()).cast("date")) & (day <= F.lit(last.isoformat()).cast("date")))
    return jobs.filter(
        (submitted >= F.lit(first.isoformat()).cast("timestamp_ntz"))
        & (submitted < F.lit(upper.isoformat()).cast("timestamp_ntz"))
    )


def in_directory(jobs: DataFrame, directory: str) -> DataFrame:
    """Jobs launched from exactly this directory (text comparison)."""
    return jobs.filter(F.col("WorkingDir_") == directory)


def charged_to(jobs: DataFrame, account: str) -> DataFrame:
    return jobs.filter(F.col("Account_") == account)


def with_job_ids(jobs: DataFrame, ids: str | Sequence[str]) -> DataFrame:
    """Jobs and array elements of the given ids; ``'all'`` keeps everything.

    Works on step rows as well. The predicate only depends on the grouping key,
    so Spark moves it below the roll-up by itself.
    """
    if isinstance(ids, str):
        if ids == "all":
            return jobs
        ids = ids.split(",")
    return jobs.filter(F.expr(parent_job_id("single_jobID")).isin(*ids))


def with_ids_from(jobs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """The same for a table of ids of any size.

    No broadcast hint: Spark broadcasts the ids when their measured size allows
    it, and otherwise joins by shuffle and splits a hot array. Meant for step rows:
    Spark does not move a join below the roll-up by itself.
    """
    wanted = ids.select(F.col(name(id_column)).cast("string").alias("_wanted_id"))
    return jobs.join(wanted, F.expr(f"{parent_job_id('single_jobID')} = _wanted_id"), "left_semi")


def rows_of_jobs_naming(logs: DataFrame, directory: str | None = None, account: str | None = None) -> DataFrame:
    """Log rows of the jobs that can pass ``in_directory`` and ``charged_to``: some row of theirs names the value.

    A job's directory and account are the first logged ones, so a job passes only if
    one of its rows has the text. A first read of three columns collects the ids of
    such jobs; the semi-join with them cuts the log before it is typed and rolled up.
    Which of the jobs really pass is still decided after the roll-up. The ids carry
    no hint: Spark sends them to every task if their measured size allows.
    The empty account also stands for logs without accounts, which no row names.
    """
    wanted = {} if directory is None else {"WorkDir": directory}
    if account is not None and "Account" in logs.columns and (account or LOG_LACKS not in logs.columns):
        wanted["Account"] = account
    if not wanted:
        return logs
    names = [f"coalesce({column} = {string(value)}, false)" for column, value in wanted.items()]
    flags = [f"_names_{n}" for n in range(len(names))]
    found = logs.filter(" OR ".join(names)).selectExpr(
        f"{job_id('JobID')} AS _named", *[f"{text} AS {flag}" for text, flag in zip(names, flags, strict=True)])
    ids = found.groupBy("_named").agg(*[F.bool_or(flag).alias(flag) for flag in flags]).filter(" AND ".join(flags)).select("_named")
    return logs.join(ids, F.expr(f"{job_id('JobID')} <=> _named"), "left_semi")
