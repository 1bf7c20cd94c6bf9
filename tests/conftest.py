import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def params():
    from wattledger.sources.orders_log import ORDERS_CLUSTER

    return ORDERS_CLUSTER


RAW_DEFAULTS = {
    "UID": "1001", "User": "ann", "JobID": "1", "JobName": "job", "Submit": "2024-03-01T10:00:00", "Elapsed": "01:00:00",
    "Partition": "cpu-std", "NNodes": "1", "NCPUS": "2", "TotalCPU": "00:30:00", "CPUTime": "02:00:00", "ReqMem": "8G",
    "MaxRSS": None, "WorkDir": "/work", "State": "COMPLETED", "Account": "lab", "AllocTRES": "billing=2,cpu=2,node=1",
}


@pytest.fixture(scope="session")
def make_log(spark):
    """A log from rows that give only what differs from an ordinary job; rows are numbered in order."""
    from wattledger.schemas import RAW_FIELDS

    schema = "log_seq bigint, " + ", ".join(f"`{f}` string" for f in RAW_FIELDS)

    def make(*rows, without=()):
        data = [(i, *[{**RAW_DEFAULTS, **row}[f] for f in RAW_FIELDS]) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, schema).drop(*without)

    return make


def step(job, **values):
    """A step row: it has neither user nor partition of its own."""
    return {"JobID": f"{job}.batch", "UID": None, "User": None, "Partition": None, "WorkDir": None, "JobName": "batch", **values}
