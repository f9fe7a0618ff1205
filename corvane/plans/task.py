"""A labelled task: documents and queries as DataFrames."""

from __future__ import annotations

import dataclasses
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from .hints import MAX_ROWS, small

DOCS = "doc_id string, text string, title string, meta map<string,string>"
QUERIES = "qid string, text string, gold array<string>, answer string, answerable boolean, scope string, meta map<string,string>"


@dataclasses.dataclass(frozen=True)
class Task:
    name: str
    docs: DataFrame
    queries: DataFrame
    meta: dict[str, Any] = dataclasses.field(default_factory=dict)

    def qrels(self) -> DataFrame:
        return self.queries.select("qid", "gold")

    def scoped_docs(self, scope: str | None) -> DataFrame:
        return self.docs if scope is None else self.docs.where(F.col("meta")["scope"] == scope)

    def by_id(self, doc_id: str) -> DataFrame:
        return self.docs.where(F.col("doc_id") == doc_id)

    def titled(self) -> DataFrame:
        """doc_id and the text that systems index: title and text."""
        full = F.when(F.coalesce(F.length("title"), F.lit(0)) > 0, F.concat_ws(". ", "title", "text")).otherwise(F.col("text"))
        return self.docs.select("doc_id", full.alias("text"))


def from_tables(docs: DataFrame, benchmark: DataFrame, name: str = "verbatim") -> Task:
    """Benchmark items as queries; gold documents hold the item's text verbatim.

    Candidate pairs share a hash of eight words with the item's first ones, so no item is
    compared with every document.
    """
    d = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    q = benchmark.select(F.col("item_id").cast("string").alias("qid"), F.col("text").alias("qtext"))
    return Task(name, d.withColumn("title", F.lit(None).cast("string")).withColumn("meta", F.lit(None).cast("map<string,string>")), _with_gold(d, q))


def _with_gold(d: DataFrame, q: DataFrame) -> DataFrame:
    n = 8
    # inner words of a text occur whole wherever the text occurs, its first and last may be longer there
    inner = F.filter(F.split("qtext", r"\s+"), lambda x: x != "")
    key = F.xxhash64(F.array_join(F.slice(inner, 2, n), " "))
    long = q.where(F.size(inner) >= n + 2).select("qid", "qtext", key.alias("k"))
    w = F.filter(F.split("text", r"\s+"), lambda x: x != "")
    keys = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(F.col("w"), i, n), " ")))
    keyed = d.withColumn("w", w).select("doc_id", "text", F.explode_outer(F.array_distinct(keys)).alias("k"))
    holds = F.contains("text", F.col("qtext"))
    if long.limit(MAX_ROWS + 1).count() <= MAX_ROWS:
        # a text stays with its windows up to the comparison, so that none is shuffled
        hit = keyed.join(F.broadcast(long), "k").where(holds).select("qid", "doc_id")
    else:
        pairs = stored(keyed.select("doc_id", "k").join(long, "k").select("doc_id", "qid", "qtext").distinct(), "pairs")
        hit = small(pairs).join(d, "doc_id").where(holds).select("qid", "doc_id")
    short = q.where(F.size(inner) < n + 2)
    if not short.isEmpty():
        hit = hit.unionByName(d.join(small(short), F.contains(d["text"], F.col("qtext"))).select("qid", "doc_id"))
    gold = hit.groupBy("qid").agg(F.array_sort(F.collect_set("doc_id")).alias("gold"))
    none = F.array().cast("array<string>")
    j = q.join(gold, "qid", "left").withColumn("gold", F.coalesce("gold", none))
    null = lambda t: F.lit(None).cast(t)
    return j.select("qid", F.col("qtext").alias("text"), "gold", null("string").alias("answer"), (F.size("gold") > 0).alias("answerable"), null("string").alias("scope"), null("map<string,string>").alias("meta"))
