"""An accounting log derived from order tables.

Turns ``orders``, ``customer`` and ``lineitem`` into a raw scheduler log: an
order becomes a job, each of its lines a step. Every text form that the parser
has to cope with occurs. Two joins on the tables' keys and a union, nothing is
gathered per order, so the log grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sql import name
from ..params import ClusterParams, Partition
from ..schemas import LOG_SEQ, RAW_FIELDS

# Hardware of the cluster the derived jobs ran on.
ORDERS_CLUSTER = ClusterParams(
    partitions=(
        Partition("cpu-std", "CPU", 12.0, model="standard nodes"),
        Partition("cpu-himem", "CPU", 15.0, model="large-memory nodes"),
        Partition("gpu-a", "GPU", 300.0, tdp_cpu=10.0, model="accelerators", model_cpu="standard nodes"),
    ),
    pue=1.5,
    carbon_intensity=231.12,
    granularity_memory_request=6.0,
    default_unit_rss="K",
    cluster_name="orders",
)


# State of a job by the remainder of its key, COMPLETED beyond the list.
_STATES = ("FAILED", "TIMEOUT", "CANCELLED by 10001", "RUNNING", "PENDING", "OUT_OF_MEMORY")


def _two(value: str) -> str:
    return f"lpad(CAST({value} AS STRING), 2, '0')"


def _clock(seconds: str) -> str:
    """``[D-]HH:MM:SS``."""
    rest = f"({seconds}) % 86400"
    days = f"CASE WHEN ({seconds}) >= 86400 THEN ({seconds}) DIV 86400 || '-' ELSE '' END"
    return f"{days} || {_two(f'{rest} DIV 3600')} || ':' || {_two(f'{rest} % 3600 DIV 60')} || ':' || {_two(f'{rest} % 60')}"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the texts that its job row and its step rows share."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority"
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_mktsegment")
    states = " ".join(f"WHEN {i} THEN '{state}'" for i, state in enumerate(_STATES))
    return (
        orders.join(customer, orders["o_custkey"] == customer["c_custkey"])
        .selectExpr(
            "o_orderkey AS k",
            "o_custkey % 40 AS u",
            f"CASE o_orderkey % 13 {states} ELSE 'COMPLETED' END AS state",
            "CASE WHEN o_orderkey % 13 = 4 THEN 0L ELSE o_orderkey * 7919 % 180000 END AS w",
            "o_custkey % 32 + 1 AS n",
            "o_orderkey % 2 + 1 AS nn",
            "CASE WHEN o_orderkey % 15 < 5 THEN (o_orderkey - o_orderkey % 5) || '_' || o_orderkey % 5 "
            "ELSE CAST(o_orderkey AS STRING) END AS job_id",
            "CASE o_orderkey % 5 WHEN 0 THEN 'gpu-a' WHEN 1 THEN 'cpu-himem' ELSE 'cpu-std' END AS part",
            "CASE WHEN o_orderkey % 11 = 10 THEN NULL "
            "WHEN o_orderkey % 4 = 0 THEN (o_orderkey % 7 + 2) || 'Gn' "
            "WHEN o_orderkey % 4 = 1 THEN (o_orderkey % 3000 + 1000) || 'Mc' "
            "WHEN o_orderkey % 4 = 2 THEN (o_orderkey % 56 + 8) || 'G' "
            "ELSE (o_orderkey % 9000 + 4000000) || 'K' END AS request",
            f"to_date(o_orderdate) || 'T' || {_two('o_orderkey % 24')} || ':' || {_two('o_orderkey % 60')} AS minute",
            "'job-' || o_orderpriority AS job_name",
            "lower(c_mktsegment) AS account",
        )
        .selectExpr(
            "*",
            f"{_clock('w')} AS elapsed",
            f"{_clock('w * n')} AS core_time",
            f"CASE WHEN k % 7 = 0 OR w = 0 THEN '00:00:00' "
            f"ELSE {_clock('w * n * (k % 90 + 10) DIV 100')} || '.508' END AS cpu_used",
            "CASE WHEN state <> 'PENDING' THEN 'billing=' || n || ',cpu=' || n "
            "|| CASE WHEN part = 'gpu-a' THEN ',gres/gpu=' || (k % 4 + 1) ELSE '' END || ',node=' || nn END AS alloc",
        )
    )


def _row(values: dict[str, str]) -> list[str]:
    """Columns of the log; the fields that job and step rows have in common are filled in here."""
    common = {
        "Elapsed": "elapsed", "CPUTime": "core_time", "NNodes": "nn", "NCPUS": "n", "ReqMem": "request",
        "Account": "account", "AllocTRES": "alloc",
    }
    filled = common | values
    return [
        f"CAST({filled[LOG_SEQ]} AS BIGINT) AS {LOG_SEQ}",
        *[f"CAST({filled[field]} AS STRING) AS {name(field)}" for field in RAW_FIELDS],
    ]


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw log: ``log_seq`` and the 17 fields as text."""
    orders = _orders(spark, sf_dir)
    jobs = orders.selectExpr(*_row({
        LOG_SEQ: "0",
        "UID": "u + 10000",
        "User": "'user' || u",
        "JobID": "job_id",
        "JobName": "job_name",
        "Submit": "minute || ':07'",
        "Partition": "CASE state WHEN 'PENDING' THEN 'cpu-std,cpu-himem' ELSE part END",
        "TotalCPU": "cpu_used",
        "MaxRSS": "NULL",
        "WorkDir": "'/home/user' || u || '/proj' || k % 3",
        "State": "state",
    }))

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"
    )
    step = "CASE l_linenumber WHEN 1 THEN 'batch' WHEN 2 THEN 'extern' END"
    # Orders and lines both grow with the data: joined by shuffle, where Spark splits a hot order.
    started = orders.filter("state <> 'PENDING'").hint("merge")
    steps = lines.join(started, F.expr("l_orderkey = k")).selectExpr(*_row({
        LOG_SEQ: "l_linenumber",
        "UID": "NULL",
        "User": "NULL",
        "JobID": f"job_id || '.' || coalesce({step}, CAST(l_linenumber - 3 AS STRING))",
        "JobName": f"coalesce({step}, 'step')",
        "Submit": "minute || ':09'",
        "Partition": "NULL",
        "TotalCPU": "CASE l_linenumber WHEN 1 THEN cpu_used ELSE '00:00:00' END",
        "MaxRSS": "CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_linenumber = 2 THEN '0' "
        "WHEN l_suppkey % 9 = 0 THEN CAST(l_partkey * 7919 % 20000000 AS STRING) "
        "WHEN l_suppkey % 9 = 1 THEN l_partkey % 6000 || 'M' ELSE l_partkey * 7919 % 20000000 || 'K' END",
        "WorkDir": "NULL",
        "State": "CASE WHEN state <> 'RUNNING' AND l_partkey % 50 = 0 THEN 'FAILED' ELSE state END",
    }))
    return jobs.unionByName(steps)
