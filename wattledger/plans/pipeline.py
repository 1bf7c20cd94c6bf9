"""From a raw log to the tables of a report."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession

from ..functions import parsing as P
from ..operators import derive, distribution, enrich, filters, quality, report, rollup, steps, summarise
from ..params import ClusterParams, Clusters
from ..sources import sinks, states
from ..sources.dimensions import lookup_keys

# Step columns that jobs may be grouped by, besides the public ones.
GROUPING_COLUMNS = ("single_jobID", "Account_")


@dataclass(frozen=True)
class JobChoice:
    """Which jobs a report is about; the default is all of them.

    ``narrow``: look up the jobs of a directory or an account first, so that only
    their rows are typed and rolled up, at the price of reading three columns of the
    log once more. Turn it off where most jobs are chosen anyway.
    """

    start: str | None = None
    end: str | None = None
    directory: str | None = None
    job_ids: str | Sequence[str] = "all"
    account: str | None = None
    id_table: DataFrame | None = None
    id_column: str | None = None
    success_states: Sequence[str] = ()
    narrow: bool = True

    def __post_init__(self):
        if (self.start is None) != (self.end is None):
            raise ValueError("a period needs both a start and an end day")
        if self.start is not None:
            filters.parse_period(self.start, self.end)
        if (self.id_table is None) != (self.id_column is None):
            raise ValueError("a table of job ids needs the name of its column")

    def describe(self) -> str:
        """The restrictions in words, for messages about an empty result."""
        parts = {
            "submitted": None if self.start is None else f"{self.start} to {self.end}",
            "directory": self.directory,
            "job ids": None if self.job_ids == "all" else self.job_ids,
            "job id table": self.id_column,
            "account": self.account,
        }
        return ", ".join(f"{what}: {value}" for what, value in parts.items() if value is not None)


ALL_JOBS = JobChoice()


def jobs_full(logs: DataFrame, params: ClusterParams | Clusters, choice: JobChoice = ALL_JOBS) -> DataFrame:
    """Finished jobs with every cleaned and derived column.

    With the parameters of several clusters, a job is known by its cluster and its id.
    """
    if choice.narrow:
        logs = filters.rows_of_jobs_naming(logs, choice.directory, choice.account)
    typed = steps.clean_steps(logs, params, choice.success_states)
    if choice.id_table is not None:
        typed = filters.with_ids_from(typed, choice.id_table, choice.id_column)
    finished = rollup.finished_jobs(rollup.rollup_jobs(typed, lookup_keys(params)))
    jobs = derive.derive_jobs(finished, params, steps.has_gpu_counts(logs))
    return choose_jobs(jobs, choice)


def write_jobs_with_quality(
    logs: DataFrame, params: ClusterParams, path: str, success_states: Sequence[str] = ()
) -> dict[str, int]:
    """Write the job table of a log under ``path`` and count what is wrong with it on the way; returns rule -> jobs.

    One read of the log, one shuffle and one write. Finished jobs that break no rule of
    severity error go to ``path``/trusted=true, the others, with every rule they break,
    to ``path``/trusted=false. Unfinished jobs are counted, since rules on rows cover
    them, and not written unless they break a rule. ``sources.jobs.trusted_jobs`` reads
    the first.
    """
    counted = Observation("quality")
    jobs = quality.observed(quality.with_findings(logs, params, success_states), counted)
    recoded = rollup.recoded(jobs).filter(f"StateX <> {P.STATE_UNFINISHED} OR NOT {quality.TRUSTED}")
    contract = derive.job_contract(recoded, ("single_jobID", "Account_", "WorkingDir_", quality.BROKEN, quality.TRUSTED))
    contract.write.mode("errorifexists").partitionBy(quality.TRUSTED).parquet(path)
    return counted.get


def add_slice(logs: DataFrame, params: ClusterParams | Clusters, path: str, name: str, success_states: Sequence[str] = ()) -> None:
    """Roll up one slice of a log, such as a day's rows, and keep the state of its jobs under ``path``.

    Only this slice is read. Run again, for instance after a failure, it takes the place of what it wrote.
    """
    typed = steps.clean_steps(steps.with_lacks(logs), params, success_states)
    states.write_slice(rollup.rollup_state(typed, lookup_keys(params)), path, name)


def jobs_of_slices(
    spark: SparkSession, path: str, params: ClusterParams | Clusters, choice: JobChoice = ALL_JOBS, names: Sequence[str] | None = None
) -> DataFrame:
    """``jobs_full`` from the slices kept under ``path``, all or the named ones, without the log.

    Rows of a job may be in any of them. Success states were decided when the slices
    were made, so ``choice`` does not change them.
    """
    keys = lookup_keys(params)
    merged = rollup.merge_states(states.read_slices(spark, path, names), keys)
    jobs = derive.derive_jobs(rollup.finished_jobs(rollup.jobs_of_states(merged, keys)), params)
    if choice.id_table is not None:
        jobs = filters.with_ids_from(jobs, choice.id_table, choice.id_column)
    return choose_jobs(jobs, choice)


def choose_jobs(jobs: DataFrame, choice: JobChoice) -> DataFrame:
    if choice.start is not None:
        jobs = filters.in_period(jobs, choice.start, choice.end)
    if choice.directory is not None:
        jobs = filters.in_directory(jobs, choice.directory)
    jobs = filters.with_job_ids(jobs, choice.job_ids)
    if choice.account is not None:
        jobs = filters.charged_to(jobs, choice.account)
    return jobs


def jobs_table(
    logs: DataFrame, params: ClusterParams | Clusters, choice: JobChoice = ALL_JOBS, keep: Sequence[str] = ()
) -> DataFrame:
    """The public job table, plus ``keep`` for other groupings, and the cluster if there are several."""
    further = [key for key in lookup_keys(params) if key not in keep]
    return derive.job_contract(jobs_full(logs, params, choice), (*keep, *further))


def enriched_jobs(
    logs: DataFrame, params: ClusterParams | Clusters, choice: JobChoice = ALL_JOBS, keep: Sequence[str] = ()
) -> DataFrame:
    """Jobs with energy, carbon, cost and equivalents."""
    return enrich.enrich_jobs(jobs_table(logs, params, choice, keep), params)


def daily_footprint(logs: DataFrame, params: ClusterParams | Clusters, choice: JobChoice = ALL_JOBS) -> DataFrame:
    """One row per user and submit day, with the day's share in the user's footprint; users are those of a cluster."""
    by = [*lookup_keys(params), "UserX"]
    daily = summarise.daily_summary(enriched_jobs(logs, params, choice), by)
    return summarise.with_share_within(daily, by)


def _derived_tables(daily: DataFrame, overall: DataFrame, params: ClusterParams, html: bool) -> dict[str, DataFrame]:
    """Tables that need no more than the two summaries."""
    return {
        "daily_series": distribution.daily_series(daily),
        "daily_rates": distribution.daily_rates(daily),
        "success_split": distribution.success_split(overall),
        "energy_breakdown": report.energy_breakdown(overall),
        "waste": report.waste(overall),
        "usage_summary": report.usage_summary(overall),
        "labels": report.report_labels(overall, params, html=html),
    }


def _summaries(jobs: DataFrame) -> DataFrame:
    """The days of a report, with the distribution of memory efficiency and the shares."""
    return summarise.with_share_within(distribution.daily_with_bins(jobs), ["UserX"])


def report_tables(jobs: DataFrame, params: ClusterParams, html: bool = False) -> dict[str, DataFrame]:
    """All result tables of a report from enriched jobs.

    The tables share their input; ``write_report`` computes what they share once.
    """
    daily = _summaries(jobs)
    # Each user's report is about that user alone, whose share is therefore 1.
    overall = summarise.with_share_within(summarise.overall_summary(daily), ["UserX"])
    return {
        "daily": daily,
        "overall": overall,
        "factor_values": distribution.factor_values(jobs),
        "memory_efficiency": distribution.histogram_of_days(daily),
        "factor_quantiles": distribution.factor_quantiles(daily),
        **_derived_tables(daily, overall, params, html),
    }


def write_report(
    jobs: DataFrame, params: ClusterParams, directory: str, html: bool = False, run: str | None = None, resume: bool = False
) -> dict[str, str]:
    """Write every table of a report under a new directory of this run; returns table -> path.

    Reads the job table twice: for the days and for the list of factors. Hand in a
    stored one (see ``sources.sinks.write_table``). Everything else comes from the
    days as written. Tables are in the order of their keys. A manifest is written
    last; ``sinks.read_run`` takes only runs that have one. With ``resume`` a run that
    was interrupted goes on: tables that it finished are taken as they are, one that
    it was writing is written anew.
    """
    spark = jobs.sparkSession
    path = sinks.run_directory(directory, run)
    done = sinks.finished_tables(spark, path) if resume else {}
    paths = {}

    def write(name: str, df: DataFrame, sort: bool = True) -> DataFrame:
        paths[name] = f"{path}/{name}"
        if name in done:
            return spark.read.schema(df.schema).parquet(paths[name])
        mode = "overwrite" if resume else "errorifexists"
        if sort:
            out = sinks.write_sorted(df, paths[name], mode=mode)
        else:
            sinks.write_table(df, paths[name], mode=mode)
            out = spark.read.schema(df.schema).parquet(paths[name])
        done[name] = sinks.record_table(out, path, name)
        return out

    daily = write("daily", _summaries(jobs))
    overall = write("overall", summarise.with_share_within(summarise.overall_summary(daily), ["UserX"]))
    write("memory_efficiency", distribution.histogram_of_days(daily))
    write("factor_quantiles", distribution.factor_quantiles(daily))
    # As many rows as there are different factors, nearly one per job: not sorted.
    write("factor_values", distribution.factor_values(jobs), sort=False)
    for name, df in _derived_tables(daily, overall, params, html).items():
        write(name, df)
    sinks.write_manifest(spark, path, done)
    return paths


def require_jobs(jobs: DataFrame, choice: JobChoice = ALL_JOBS) -> DataFrame:
    """Stop with a plain message when a report has no jobs. Runs a job that looks for one row."""
    if jobs.isEmpty():
        restrictions = choice.describe()
        raise LookupError("no finished jobs" + (f" with {restrictions}" if restrictions else " in the log"))
    return jobs
