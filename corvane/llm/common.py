"""Helpers that several training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.hints import spread
from ..storage import release, shared_root, stored

__all__ = ["release", "shared_root", "stored"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


BATCH_ROWS = 1000


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInPandas`` with batches of at most ``BATCH_ROWS`` rows.

    Rows here hold whole texts, and a worker's memory follows the size of a batch, so the
    session's limit is lowered if it is higher.
    """
    small_batches(df.sparkSession)
    return df.mapInPandas(run, schema)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole table; a small one is dealt to all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def doc_bucket(col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; -1 for a null id, so it is in no held-out fold."""
    return F.coalesce(F.crc32(F.col(col).cast("string")) % mod, F.lit(-1))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; the fast built-in serves strings that are pure ASCII."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def where_fenced(df: DataFrame, condition: Column) -> DataFrame:
    """``df.where(condition)``, evaluated above the projections of ``df``.

    A plain filter is pushed below them with their expressions written out, also inside
    lambdas, where they would run once for each array element. The id is not deterministic, so
    the optimizer leaves the filter where it is.
    """
    fenced = df.select("*", condition.alias("__keep"), F.monotonically_increasing_id().alias("__fence"))
    return fenced.where(F.col("__keep") & (F.col("__fence") >= 0)).drop("__keep", "__fence")
