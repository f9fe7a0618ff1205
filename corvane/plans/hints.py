"""Broadcasting only what has been measured, and batches of a bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ROWS = 200_000


def small(df: DataFrame, limit: int = MAX_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; else Spark chooses (and may shuffle)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


SPREAD_BYTES = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table dealt to all cores, for costly work on its rows.

    A file with one row group is read by one task. Only tables estimated at SPREAD_BYTES at most are
    shuffled for that; larger ones have tasks enough as they are read.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SPREAD_BYTES else df


BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Arrow batches of at most ``rows`` rows or ``size`` bytes (one row at least) in the session.

    A worker's memory follows the size of a batch, so limits that are higher are lowered.
    """
    bytes_of = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, limit in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        name = f"spark.sql.execution.arrow.{name}"
        if not 0 < bytes_of(spark.conf.get(name)) <= limit:
            spark.conf.set(name, str(limit))
