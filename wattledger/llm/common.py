"""Small helpers shared by the operators."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path


# Bytes of rows that a Python worker gets at a time, beside Spark's bound on their number; one longer row is a batch of
# its own. Workers and the JVM hold a batch each, so this, not the length of texts, bounds their memory.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Set the bound above for the session, unless it has a smaller one. Results do not depend on it."""
    now = spark.conf.get(_BATCH_SETTING, None)
    size = re.fullmatch(r"(\d+)b?", (now or "").lower())
    if size is None or not 0 < int(size[1]) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write a DataFrame to the folder all executors share and read it back: it is computed once, its lineage ends here."""
    spark = df.sparkSession
    bound_batches(spark)
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows of two or three numbers that a join may send through the driver; about 10 MB there.
SENT_ROWS = 100_000


def unsent(df: DataFrame) -> DataFrame:
    """One side of a join of two tables that grow with the input: neither is broadcast, both are dealt out by the key.

    Spark judges a stored table by its compressed bytes, which can be a fiftieth of what its rows take in the driver.
    """
    return df.hint("merge")


def text_key():
    """A 64-bit hash of the column ``text``, to tell rows with one id but different texts apart."""
    return F.xxhash64("text")


def fold_of(id_column: str, folds: int):
    """crc32 of the id as text, modulo the number of folds."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds


def bit_filter(df: DataFrame, column: str, bits: int) -> np.ndarray:
    """One bit for each value of a bigint column modulo ``bits``, a power of two, as bytes.

    At most bits / 64 rows reach the driver, whatever the size of the table.
    """
    bit = F.col(column).bitwiseAND(bits - 1)
    words = df.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr(f"shiftleft(1L, cast((`{column}` & {bits - 1}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out.view(np.uint8)


def in_filter(may: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the bit of each value is set."""
    bit = values.view(np.uint64) & np.uint64(len(may) * 8 - 1)
    return (may[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0
