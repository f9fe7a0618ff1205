"""Queries and documents that keep arriving.

The batch functions stay as they are: a stream of query files is answered batch by batch with a
checkpoint, and index statistics are kept by streaming aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import tokenize


def answer_stream(spark: SparkSession, queries_dir: str, out_dir: str, checkpoint: str, answer: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Answer each new file of queries (qid, text) once; a restart goes on where it stopped.

    A batch that is repeated after a failure replaces its own folder, so no answer is doubled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    stream = spark.readStream.schema("qid string, text string").parquet(queries_dir)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def term_frequencies(docs: DataFrame, tokenizer: str = "simple") -> DataFrame:
    """term, df over a stream of documents, for ``update`` or ``complete`` output."""
    tok = tokenize.build(tokenizer)
    return docs.select(F.explode_outer(F.array_distinct(tok.lowered(F.col("text")))).alias("term")).where("term is not null").groupBy("term").agg(F.count("*").alias("df"))


def event_windows(events: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """event_type, start, n, total by tumbling windows, for a stream or a table."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")


def latest(records: DataFrame, key: str = "qid", order: str = "latency_s") -> DataFrame:
    """The last record of each key among repeated ones."""
    r = records.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order))))
    return r.where("r = 1").drop("r")
