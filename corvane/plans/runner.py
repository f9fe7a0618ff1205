"""Resumable evaluation of a system on a task.

Records are Parquet files in ``<out>/<task>__<system>/records``; a run answers the queries
without a record as one batch and appends. There is no latency of single queries in a batch:
the batch's wall time is shared evenly among its queries and the card says so.
"""

from __future__ import annotations

import json
import os
import time
import traceback

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics
from ..sources.tasks import RECORD
from .systems import System
from .task import Task


def _padded(r: DataFrame) -> DataFrame:
    cols = [c.split(" ", 1) for c in RECORD.split(", ")]
    return r.select(*[(F.col(n) if n in r.columns else F.lit(None)).cast(t).alias(n) for n, t in cols])


def done(spark, path: str) -> DataFrame:
    try:
        return spark.read.schema(RECORD).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD)


def pending(queries: DataFrame, finished: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Queries without a record; failed ones count as done unless ``retry_failed``."""
    f = finished.where(F.col("error").isNull()) if retry_failed else finished
    return queries.join(f.select("qid"), "qid", "left_anti")


def run(system: System, task: Task, out_dir: str = "runs", limit: int | None = None, resume: bool = True, retry_failed: bool = False) -> dict:
    """Answer what is pending, then score all records on disk; returns the metrics."""
    spark = task.docs.sparkSession
    base = f"{out_dir}/{task.name}__{system.name}"
    path = f"{base}/records"
    queries = task.queries.orderBy("qid").limit(limit) if limit else task.queries
    todo = pending(queries, done(spark, path), retry_failed) if resume else queries
    todo = todo.persist()
    n, began = todo.count(), time.perf_counter()
    if n:
        try:
            r = _padded(system.answer(task, todo)).persist()
            r.count()
        except Exception as e:  # noqa: BLE001  the batch's queries are recorded as failed
            why = f"{type(e).__name__}: {str(e)[:500]}"
            r = _padded(todo.select("qid", F.lit(why).alias("error"), F.lit(traceback.format_exc(limit=3)).alias("traceback")))
        each = (time.perf_counter() - began) / n
        r.withColumn("latency_s", F.lit(each)).write.mode("append" if resume else "overwrite").parquet(path)
        r.unpersist()
    todo.unpersist()
    m = evaluate(done(spark, path), task.qrels(), system.name, task.name)
    m["latency"]["index_s"] = 0.0
    if "://" not in base:
        os.makedirs(base, exist_ok=True)
        with open(f"{base}/metrics.json", "w") as f:
            json.dump(m, f, indent=2)
        card = {k: m[k] for k in ("system", "task", "n_queries", "n_failed", "aggregate", "cost", "latency")}
        card |= {"n_docs": task.docs.count(), "limit": limit, "answered_now": n, "latency_is": "batch wall time over its queries", "task_meta": task.meta}
        with open(f"{base}/card.json", "w") as f:
            json.dump(card, f, indent=2)
    return m


def evaluate(records: DataFrame, qrels: DataFrame, system: str, task: str, names=metrics.DEFAULT) -> dict:
    """All metrics of one run, as plain values."""
    j = metrics.judged(records, qrels, names).persist()
    per = {r["qid"]: {m: r[m] for m in names} for r in j.where(F.size("gold") > 0).select("qid", *[F.col(f"`{m}`") for m in names]).toLocalIterator()}
    mean = {m: (sum(v[m] for v in per.values()) / len(per) if per else 0.0) for m in names}
    out = j.select("qid", F.col("was_correct").alias("correct"), "confidence", "abstained")
    risk = metrics.risk_summary(out).first().asDict() | {"curve": [[r["coverage"], r["risk"]] for r in metrics.risk_curve(out).orderBy("i").collect()]}
    lat = metrics.percentiles(j, "latency_s").first()
    failed = records.where(F.col("error").isNotNull() & (F.col("error") != "")).count()
    cost = metrics.costs(j).first().asDict()
    j.unpersist()
    return {"system": system, "task": task, "n_queries": len(per), "n_failed": failed, "aggregate": mean, "risk": risk, "cost": cost, "latency": lat.asDict() if lat else {}, "per_query": per}
