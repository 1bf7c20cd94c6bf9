import datetime

import pytest

from wattledger.functions import parsing as P


def evaluate(spark, expression, values):
    """The expression over a column ``x`` of texts."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r[0] for r in df.orderBy("i").selectExpr(expression).collect()]


DURATIONS = {
    "04:00:25": 14425000, "4-00:16:00": 346560000, "00:00.508": 508, "03:15": 195000, "5": 5000, "1-5": 86405000,
    "1-02:03": 86400000 + 123000, "1.508123": 509123, "0.5": 5, "00:75:90": 75 * 60000 + 90000, "20:56:32": 75392000,
    "999999-00:00:00": 999999 * 86400000,
    "bad": None, "1-2-3": None, "1:2:3:4": None, "1.2.3": None, "": None, ":": None, "1:": None, ":5": None, "-5": None,
    "1-": None, "5.": None, "1:x:3": None, "99999999999": 99_999_999_999_000, None: None,
}


def test_duration(spark):
    assert evaluate(spark, P.duration_ms("x"), list(DURATIONS)) == list(DURATIONS.values())


MEMORY = {
    "6760Mc": 6.76 * 4, "250Gn": 500.0, "8G": 8.0, "4000000K": 4.0, "1.5G": 1.5, None: 0.0, "5T": None, "5Tn": None,
    "12X": None, "12": None, "G": None, "Gn": None, "1.2.3G": None, "-5G": None, "nG": None,
}


def test_requested_memory(spark):
    got = evaluate(spark, P.requested_memory_gb("x", "2L", "4L"), list(MEMORY))
    assert got == [None if v is None else pytest.approx(v) for v in MEMORY.values()]


def test_memory_use(spark):
    texts = [None, "0", "2745K", "154264", "5M", "1.5G", "5T", "1.2.3K", "x", "K"]
    want = [-1.0, 0.0, 0.002745, 0.154264, 0.005, 1.5, None, None, None, None]
    got = evaluate(spark, P.max_rss_gb("x", "K"), texts)
    assert got == [None if v is None else pytest.approx(v) for v in want]
    assert evaluate(spark, P.max_rss_gb("x", None), ["154264", "0", "5M"]) == [None, 0.0, pytest.approx(0.005)]
    assert evaluate(spark, P.max_rss_gb("x", "M"), ["154264"]) == [pytest.approx(154.264)]


def test_gpus(spark):
    texts = ["billing=32,gres/gpu=3,node=1", "gres/gpu:a100=4", "gres/gpu=,gres/gpu=2", "cpu=1", None, "gres/gpu=2x"]
    assert evaluate(spark, P.gpu_count("x"), texts) == [3, 0, 2, 0, 0, 2]


def test_partition_and_ids(spark):
    assert evaluate(spark, P.first_partition("x"), ["a,b", "a", None]) == ["a", "a", ""]
    assert evaluate(spark, P.job_id("x"), ["10_3.batch", "7", "7.0.1"]) == ["10_3", "7", "7"]
    assert evaluate(spark, P.parent_job_id("x"), ["10_3", "7"]) == ["10", "7"]


def test_state(spark):
    texts = ["CD", "COMPLETED", "TIMEOUT", "CANCELLED by 1", "RQ", "RUNNING", None, "completed"]
    assert evaluate(spark, P.state_code("x"), texts) == [1, 1, 0, 0, -2, -2, 0, 0]
    assert evaluate(spark, P.state_code("x", ["TIMEOUT", "RUNNING"]), texts) == [1, 1, -1, 0, -2, -2, 0, 0]
    assert evaluate(spark, P.state_code("x", ["it's"]), ["it's"]) == [-1]


def test_submit_time_does_not_depend_on_the_session_zone(spark):
    texts = ["2024-03-10T02:30:00", "2022-02-30T00:00:00", "Unknown", "2024-03-10 02:30:00", "2024-03-10T02:30:00Z", None]
    want = [datetime.datetime(2024, 3, 10, 2, 30), None, None, None, None, None]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert evaluate(spark, P.submit_timestamp("x"), texts) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_missing_values(spark):
    assert evaluate(spark, P.null_if_na("x"), ["NA", "nan", "null", "", "None", "NAN", " NA", "x"]) == [None] * 5 + ["NAN", " NA", "x"]


def test_durations_beyond_31_bits(spark):
    text = "VALUES ('3000000000:00'), ('5.1300000000'), ('9223372036854775807:00:00'), ('99999999999999999999'), ('1-00:00:3000000000') AS t(x)"
    got = [r[0] for r in spark.sql(f"SELECT {P.duration_ms('x')} FROM {text}").collect()]
    assert got == [180_000_000_000_000, 1_300_005_000, None, None, 3_000_086_400_000]
