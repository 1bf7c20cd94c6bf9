"""Parameters as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import double, string
from ..params import CLUSTER, GPU, ClusterParams, Clusters
from ..schemas import require_columns

# A dimension up to this size is sent to every executor; a larger one is joined
# by whatever strategy Spark picks. At 4 short columns a row stays well under
# 1 KB, so the bound is about 10 MB.
MAX_BROADCAST_PARTITIONS = 10_000
_MAX_NAME = 512

# Power draws in the dimension -> their names while they travel with the jobs.
POWER_COLUMNS = {"tdp": "_tdp", "tdp_cpu": "_tdp_cpu"}


def partition_dim(spark: SparkSession, params: ClusterParams) -> DataFrame:
    """One row per partition: partition, type, model, tdp, model_cpu, tdp_cpu."""
    rows = [
        f"struct({string(p.name)} AS partition, {string(p.type)} AS type, {string(p.model)} AS model, "
        f"{double(p.tdp)} AS tdp, {string(p.model_cpu)} AS model_cpu, "
        f"{double(p.tdp_cpu if p.type == GPU else None)} AS tdp_cpu)"
        for p in params.partitions
    ]
    return spark.range(1, numPartitions=1).selectExpr(f"inline(array({', '.join(rows)}))")


def cluster_dim(spark: SparkSession, clusters: Clusters) -> DataFrame:
    """One row per cluster: its name and its parameters, under the names the formulas use."""
    rows = []
    for cluster, params in clusters.by_name.items():
        values = [f"{(string if isinstance(v, str) or column.endswith('rss') else double)(v)} AS {column}" for column, v in clusters.values(params).items()]
        rows.append(f"struct({string(cluster)} AS {CLUSTER}, {', '.join(values)})")
    return spark.range(1, numPartitions=1).selectExpr(f"inline(array({', '.join(rows)}))")


def with_parameters(df: DataFrame, params: ClusterParams | Clusters) -> DataFrame:
    """Rows with the parameters of their cluster, for several clusters; rows of one cluster need none.

    A row whose cluster is NULL or unknown gets NULLs, and what is computed from them is NULL.
    """
    if not isinstance(params, Clusters) or set(params.columns) <= set(df.columns):
        return df
    require_columns(df, [CLUSTER], "a table of several clusters")
    dim = cluster_dim(df.sparkSession, params)
    return df.join(_if_few(dim, list(params.by_name)), CLUSTER, "left")


def without_parameters(df: DataFrame, params: ClusterParams | Clusters) -> DataFrame:
    return df.drop(*params.columns) if isinstance(params, Clusters) else df


def partition_lookup(spark: SparkSession, params: ClusterParams | Clusters) -> DataFrame:
    """The columns that jobs are joined with, and the cluster if there are several; broadcast if it is small."""
    if isinstance(params, ClusterParams):
        return if_small(_lookup_columns(partition_dim(spark, params)), params)
    parts = [
        _lookup_columns(partition_dim(spark, each)).withColumn(CLUSTER, F.lit(cluster)) for cluster, each in params.by_name.items()]
    return _if_few(reduce(DataFrame.unionByName, parts), [p.name for each in params.by_name.values() for p in each.partitions])


def lookup_keys(params: ClusterParams | Clusters) -> list[str]:
    """Columns of jobs and lookup that must agree besides the partition."""
    return [CLUSTER] if isinstance(params, Clusters) else []


def _lookup_columns(dim: DataFrame) -> DataFrame:
    return dim.select("partition", "type", "tdp", "tdp_cpu")


def if_small(dim: DataFrame, params: ClusterParams) -> DataFrame:
    """A dimension with a row per partition, marked for broadcast if there are few enough of them."""
    return _if_few(dim, [text or "" for p in params.partitions for text in (p.name, p.model, p.model_cpu)], 3)


def _if_few(dim: DataFrame, texts: list[str], texts_per_row: int = 1) -> DataFrame:
    small = len(texts) <= texts_per_row * MAX_BROADCAST_PARTITIONS and all(len(text) <= _MAX_NAME for text in texts)
    return F.broadcast(dim) if small else dim
