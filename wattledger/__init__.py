"""Energy, carbon and cost of batch jobs, computed from scheduler accounting logs on Spark."""

from .params import ClusterParams, Constants, Partition

__all__ = ["ClusterParams", "Constants", "Partition"]
