"""Reciprocal-rank fusion of ranked runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bm25 import top


def rrf(runs: list[DataFrame], k: float = 60.0, n: int = 10, digits: int = 9) -> DataFrame:
    """qid, rank, doc_id, score: the sum over runs of 1 / (k + rank), ranks from 1; scores are ignored."""
    legs = reduce(DataFrame.unionByName, [r.select("qid", "doc_id", "rank") for r in runs])
    return top(legs.groupBy("qid", "doc_id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score")), n, digits=digits)
