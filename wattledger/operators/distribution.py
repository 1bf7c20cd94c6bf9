"""Distributions and the long tables that charts are drawn from."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import summarise

OVERALL = "overall"


def factor_values(jobs: DataFrame) -> DataFrame:
    """Overallocation factors per user and over all jobs, as (scope, UserX, factor, n_jobs).

    The complete list of a scope, with equal values counted instead of repeated:
    nothing is gathered per user, however many jobs a user has. ``scope`` is
    'user' or 'overall'; jobs without a user are in 'overall' only. One shuffle for
    both scopes, of values counted within each task. Factors of different jobs are
    mostly different, so it moves about two rows per job; ``factor_quantiles`` needs
    no more than the days.
    """
    scopes = F.array(
        F.struct(F.lit("user").alias("scope"), F.col("UserX").alias("UserX")),
        F.struct(F.lit(OVERALL).alias("scope"), F.lit(None).cast("string").alias("UserX")),
    )
    return (
        jobs.select(F.explode(scopes).alias("s"), "memOverallocationFactorX")
        .select("s.scope", "s.UserX", "memOverallocationFactorX")
        .filter((F.col("scope") == OVERALL) | F.col("UserX").isNotNull())
        .groupBy("scope", "UserX", "memOverallocationFactorX")
        .agg(F.count(F.lit(1)).alias("n_jobs"))
    )


# Share of the requested memory that was needed, in percent.
MEMORY_EFFICIENCY = "1D / memOverallocationFactorX * 100D"


# Bins of equal width over 0 to 100 percent; 100 percent belongs to the last one.
BINS = 20
_WIDTH = 100.0 / BINS


def _bin(bins: int) -> str:
    number = f"least(width_bucket({MEMORY_EFFICIENCY}, 0D, 100D, {bins}L), {bins}L)"
    return f"CASE WHEN memOverallocationFactorX IS NOT NULL THEN CAST({number} AS INT) END"


def memory_efficiency_histogram(jobs: DataFrame, by: Sequence[str] = ("UserX",), bins: int = BINS) -> DataFrame:
    """Jobs per bin of memory efficiency, bins of equal width over 0 to 100 percent.

    Bin 1 starts at 0; 100 percent belongs to the last bin. Jobs without a
    factor are in no bin.
    """
    width = f"{100.0 / bins!r}D"
    return (
        jobs.filter("memOverallocationFactorX IS NOT NULL")
        .selectExpr(*by, f"{_bin(bins)} AS bin")
        .groupBy(*by, "bin")
        .agg(F.count(F.lit(1)).alias("n_jobs"))
        .selectExpr("*", f"(bin - 1) * {width} AS bin_from", f"bin * {width} AS bin_to")
    )


# Numbers of jobs by bin of memory efficiency, as a column of a daily table.
EFFICIENCY_BINS = "efficiency_bins"


def daily_with_bins(jobs: DataFrame, by: Sequence[str] = ("UserX",)) -> DataFrame:
    """The daily summary with the distribution of memory efficiency: BINS counts in each row.

    Part of the same aggregation, so it costs neither a shuffle nor a read. Its size
    is fixed and counts can be added up, so distributions over any days come from the
    days alone.
    """
    counts = [f"count_if(_bin = {n})" for n in range(1, BINS + 1)]
    # Evaluated once per job, before the aggregation.
    binned = jobs.withColumn("_bin", F.expr(_bin(BINS)))
    return summarise.daily_summary(binned, by, {EFFICIENCY_BINS: f"array({', '.join(counts)})"})


def histogram_of_days(daily: DataFrame, by: Sequence[str] = ("UserX",)) -> DataFrame:
    """``memory_efficiency_histogram`` from days that have their distribution."""
    counted = daily.select(*by, F.posexplode(EFFICIENCY_BINS).alias("bin", "n")).groupBy(*by, "bin").agg(F.sum("n").alias("n_jobs"))
    return counted.filter("n_jobs > 0").selectExpr(
        *by, "bin + 1 AS bin", "n_jobs", f"bin * {_WIDTH!r}D AS bin_from", f"(bin + 1) * {_WIDTH!r}D AS bin_to")


def factor_quantiles(daily: DataFrame, by: Sequence[str] = ("UserX",), quantiles: Sequence[float] = (0.5, 0.9, 0.99)) -> DataFrame:
    """Quantiles of the overallocation factor from days that have their distribution, as (by, quantile, n_jobs, factor, factor_low, factor_high).

    The quantile is the smallest factor that at least this share of the jobs with a
    factor does not exceed. It lies between ``factor_low`` and ``factor_high``, the
    ends of its bin; the last one is NULL in the lowest bin of efficiency, which has
    none. ``factor`` is the value in between by the rank within the bin, so the
    efficiency that belongs to it is off by less than the width of a bin, 5 percent
    of the request. The windows hold at most BINS rows per group.
    """
    if not all(0 < q <= 1 for q in quantiles):
        raise ValueError("quantiles lie above 0 and up to 1")
    # A high factor is a low efficiency: the bins are gone through from the last one down.
    whole = Window.partitionBy(*by)
    hist = histogram_of_days(daily, by).withColumns({
        "_n": F.sum("n_jobs").over(whole), "_to": F.sum("n_jobs").over(whole.orderBy(F.desc("bin")))})
    shares = F.array(*[F.lit(float(q)) for q in quantiles])
    ranked = hist.select("*", F.explode(shares).alias("quantile")).withColumn("_rank", F.ceil(F.col("quantile") * F.col("_n")))
    there = ranked.filter("_to - n_jobs < _rank AND _rank <= _to")
    return there.selectExpr(
        *by, "quantile", "_n AS n_jobs", f"100D / (bin_to - {_WIDTH!r}D * (_rank - (_to - n_jobs) - 0.5D) / n_jobs) AS factor",
        "100D / bin_to AS factor_low", "try_divide(100D, bin_from) AS factor_high")


def daily_rates(daily: DataFrame, ids=("UserX", "SubmitDate")) -> DataFrame:
    """Daily failure and success rates, one row per day and rate."""
    return daily.select(*ids, "failure_rate", "success_rate").unpivot(
        list(ids), ["failure_rate", "success_rate"], "variable", "value"
    )


def success_split(overall: DataFrame, ids=("UserX",)) -> DataFrame:
    """Number of successful and failed jobs, one row per status."""
    return overall.select(
        *ids, F.col("n_success").alias("Success"), (F.col("n_jobs") - F.col("n_success")).alias("Failure")
    ).unpivot(list(ids), ["Success", "Failure"], "Status", "n_jobs")


def daily_series(daily: DataFrame, ids=("UserX", "SubmitDate")) -> DataFrame:
    """The four series over time of a report."""
    return daily.select(*ids, "carbonFootprint", "n_jobs", "CPUhoursCharged", "memoryRequested")
