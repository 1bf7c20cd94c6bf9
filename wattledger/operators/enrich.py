"""Energy, carbon, cost and everyday equivalents of each job."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.sql import double
from ..params import CPU, GPU, ClusterParams, Clusters
from ..sources.dimensions import POWER_COLUMNS, lookup_keys, partition_lookup, with_parameters, without_parameters

# Which memory a variant of the footprint is computed with: the one requested
# or the one needed.
MEMORY_VARIANTS = {"": "ReqMemX", "_memoryNeededOnly": "NeededMemX"}
# All variants of energy, carbon, tree-months and cost.
FOOTPRINT_VARIANTS = ("", "_memoryNeededOnly", "_failedJobs")


def with_power(jobs: DataFrame, params: ClusterParams | Clusters) -> DataFrame:
    """Look up the power draws of each job's partition, unless the jobs already have them."""
    if all(hidden in jobs.columns for hidden in POWER_COLUMNS.values()):
        return jobs
    keys = lookup_keys(params)
    dim = partition_lookup(jobs.sparkSession, params).selectExpr(
        "partition AS PartitionX", *keys, *[f"{column} AS {hidden}" for column, hidden in POWER_COLUMNS.items()]
    )
    return jobs.join(dim, ["PartitionX", *keys], "left")


def add_energy(jobs: DataFrame, params: ClusterParams | Clusters) -> DataFrame:
    """kWh of CPUs, GPUs and memory, and their sum with data-centre overheads.

    The parts are without overheads. On GPU partitions the host processors are
    counted too. Unknown partitions give NULL. Jobs that come with their power
    draws are not looked up again.
    """
    jobs = with_parameters(with_power(jobs, params), params)
    tdp, tdp_cpu = POWER_COLUMNS["tdp"], POWER_COLUMNS["tdp_cpu"]
    watts_cpu = f"CASE PartitionTypeX WHEN '{CPU}' THEN {tdp} WHEN '{GPU}' THEN {tdp_cpu} END"
    watts_gpu = f"CASE PartitionTypeX WHEN '{CPU}' THEN 0D WHEN '{GPU}' THEN {tdp} END"
    per_gb = double(params.constants.power_memory_per_gb)
    parts = {
        "energy_CPUs": f"TotalCPUtime2useX / 1e3D / 3600D * {watts_cpu} / 1e3D",
        "energy_GPUs": f"TotalGPUtime2useX / 1e3D / 3600D * {watts_gpu} / 1e3D",
        **{
            f"energy_memory{suffix}": f"WallclockTimeX / 1e3D / 3600D * {memory} * {per_gb} / 1e3D"
            for suffix, memory in MEMORY_VARIANTS.items()
        },
    }
    totals = {
        f"energy{suffix}": f"(energy_CPUs + energy_GPUs + energy_memory{suffix}) * {double(params.pue)}"
        for suffix in MEMORY_VARIANTS
    }
    return without_parameters(_with(_with(jobs, parts), totals).drop(*POWER_COLUMNS.values()), params)


def _with(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.selectExpr("*", *[f"{text} AS {column}" for column, text in columns.items()])


def enrich_jobs(jobs: DataFrame, params: ClusterParams | Clusters) -> DataFrame:
    """Energy, and from it carbon, tree-months, cost, kilometres and flights."""
    const = params.constants
    energy = _with(with_parameters(add_energy(jobs, params), params), {"energy_failedJobs": "CASE StateX WHEN 0 THEN energy ELSE 0D END"})
    intensity = double(params.carbon_intensity)
    carbon = _with(energy, {f"carbonFootprint{s}": f"energy{s} * {intensity}" for s in FOOTPRINT_VARIANTS})
    return without_parameters(_with(carbon, {
        **{f"treeMonths{s}": f"carbonFootprint{s} / {double(const.tree_month)}" for s in FOOTPRINT_VARIANTS},
        **{f"cost{s}": f"energy{s} * {double(const.electricity_cost)}" for s in FOOTPRINT_VARIANTS},
        "driving": f"carbonFootprint / {double(const.car_eu_per_km)}",
        "flying_NY_SF": f"carbonFootprint / {double(const.flight_ny_sf)}",
        "flying_PAR_LON": f"carbonFootprint / {double(const.flight_par_lon)}",
        "flying_NYC_MEL": f"carbonFootprint / {double(const.flight_nyc_mel)}",
        "SubmitDate": "to_date(SubmitDatetimeX)",
    }), params)
