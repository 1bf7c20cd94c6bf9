"""Hardware, site and conversion parameters.

They come from the caller as plain Python values and enter the plans as literals
or as a small dimension table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from .functions.sql import Expr

CPU = "CPU"
GPU = "GPU"


@dataclass(frozen=True)
class Partition:
    """One partition of the cluster.

    ``tdp`` is in W per core on CPU partitions and in W per whole GPU on GPU
    partitions; ``tdp_cpu`` is the W per core of the host processors and is
    required on GPU partitions only.
    """

    name: str
    type: str
    tdp: float
    tdp_cpu: float | None = None
    model: str | None = None
    model_cpu: str | None = None

    def __post_init__(self):
        if self.type not in (CPU, GPU):
            raise ValueError(f"partition {self.name!r}: type must be CPU or GPU, not {self.type!r}")
        if not self.name:
            raise ValueError(f"not a usable partition name: {self.name!r}")
        _require_number(self.tdp, f"partition {self.name!r}: TDP", 0)
        if self.type == GPU:
            _require_number(self.tdp_cpu, f"partition {self.name!r}: TDP of the host CPUs", 0)


# Conversion constants of the footprint model.
@dataclass(frozen=True)
class Constants:
    power_memory_per_gb: float = 0.3725  # W/GB
    tree_month: float = 917.0  # gCO2e
    car_eu_per_km: float = 175.0  # gCO2e/km
    flight_ny_sf: float = 570000.0  # gCO2e
    flight_par_lon: float = 50000.0  # gCO2e
    flight_nyc_mel: float = 2310000.0  # gCO2e
    electricity_cost: float = 0.34  # per kWh


@dataclass(frozen=True)
class ClusterParams:
    """Everything the pipeline has to know about one cluster."""

    partitions: tuple[Partition, ...]
    pue: float  # power usage effectiveness of the facility, at least 1
    carbon_intensity: float  # gCO2e/kWh
    granularity_memory_request: float  # GB, smallest memory unit users can reserve
    default_unit_rss: str | None = "K"  # unit of MaxRSS values logged without one
    currency: str = "£"
    institution: str | None = None
    cluster_name: str | None = None
    texts_intro: Mapping[str, str] = field(default_factory=dict, hash=False)
    constants: Constants = field(default_factory=Constants)

    def __post_init__(self):
        object.__setattr__(self, "partitions", tuple(self.partitions))
        names = [p.name for p in self.partitions]
        if not names:
            raise ValueError("a cluster needs at least one partition")
        if len(set(names)) != len(names):
            raise ValueError("partition names must be unique")
        _require_number(self.pue, "PUE", 1)
        _require_number(self.carbon_intensity, "carbon intensity", 0)
        _require_number(self.granularity_memory_request, "memory granularity", 0)
        if self.granularity_memory_request == 0:
            raise ValueError("memory granularity must be above 0")
        if self.default_unit_rss not in (None, "K", "M", "G"):
            raise ValueError(f"default unit of MaxRSS must be K, M or G, not {self.default_unit_rss!r}")

    def with_(self, **changes) -> ClusterParams:
        return replace(self, **changes)

    @classmethod
    def from_mappings(cls, cluster: Mapping, constants: Mapping | None = None) -> ClusterParams:
        """Build from two plain mappings in the usual layout of a site's parameter files.

        ``cluster`` has the keys granularity_memory_request, partitions (name ->
        type, TDP, TDP_CPU, model, model_CPU), PUE, CI and optionally energy_cost
        (cost, currency), default_unit_RSS, institution, cluster_name and
        texts_intro. The site's own tariff takes the place of the default one
        when it is given.
        """
        values = dict(constants or {})
        tariff = dict(cluster.get("energy_cost") or {})
        cost = tariff.get("cost", values.get("electricity_cost"))
        renamed = {
            "power_memory_per_gb": values.get("power_memory_perGB"),
            "tree_month": values.get("tree_month"),
            "car_eu_per_km": values.get("passengerCar_EU_perkm"),
            "flight_ny_sf": values.get("flight_NY_SF"),
            "flight_par_lon": values.get("flight_PAR_LON"),
            "flight_nyc_mel": values.get("flight_NYC_MEL"),
            "electricity_cost": cost,
        }
        return cls(
            partitions=tuple(
                Partition(
                    name=str(name),
                    type=info["type"],
                    tdp=info["TDP"],
                    tdp_cpu=info.get("TDP_CPU"),
                    model=info.get("model"),
                    model_cpu=info.get("model_CPU"),
                )
                for name, info in cluster["partitions"].items()
            ),
            pue=cluster["PUE"],
            carbon_intensity=cluster["CI"],
            granularity_memory_request=cluster["granularity_memory_request"],
            default_unit_rss=cluster.get("default_unit_RSS"),
            currency=tariff.get("currency", "£"),
            institution=cluster.get("institution"),
            cluster_name=cluster.get("cluster_name"),
            texts_intro=dict(cluster.get("texts_intro") or {}),
            constants=Constants(**{k: float(v) for k, v in renamed.items() if v is not None}),
        )


# Column that names the cluster a log row or job belongs to, where several are worked on together.
CLUSTER = "Cluster"
_HIDDEN = "_of_cluster_"


@dataclass(frozen=True)
class Clusters:
    """Parameters of several clusters by name, for logs whose rows name theirs in the column ``Cluster``.

    Stands wherever ``ClusterParams`` does in cleaning, derivation and enrichment. Its
    values are not numbers but names of columns, which ``sources.dimensions.with_parameters``
    joins to the rows from a table with one row per cluster.
    """

    by_name: Mapping[str, ClusterParams]

    def __post_init__(self):
        if not self.by_name or not all(isinstance(name, str) and name for name in self.by_name):
            raise ValueError("clusters need names")

    @staticmethod
    def values(params: ClusterParams) -> dict[str, float | str | None]:
        """Hidden column -> value of one cluster."""
        plain = {name: getattr(params, name) for name in _BY_CLUSTER}
        constants = {f.name: float(getattr(params.constants, f.name)) for f in fields(Constants)}
        return {f"{_HIDDEN}{name}": value for name, value in {**plain, **constants}.items()}

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(self.values(next(iter(self.by_name.values()))))

    @property
    def constants(self) -> Constants:
        return Constants(**{f.name: Expr(f"{_HIDDEN}{f.name}") for f in fields(Constants)})

    def __getattr__(self, name: str) -> Expr:
        if name in _BY_CLUSTER:
            return Expr(f"{_HIDDEN}{name}")
        raise AttributeError(name)


# Parameters of a cluster that the formulas ask for, besides the constants.
_BY_CLUSTER = ("pue", "carbon_intensity", "granularity_memory_request", "default_unit_rss")


def _require_number(value, what: str, minimum: float) -> None:
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{what} must be a number, not {value!r}")
    if not value >= minimum:
        raise ValueError(f"{what} must be at least {minimum}, not {value!r}")
