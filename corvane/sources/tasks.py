"""Task sources: question sets with paragraphs, books with tables of contents, run records."""

from __future__ import annotations

import random
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.task import DOCS, QUERIES, Task
from ..storage import stored

HOTPOT = (
    "id string, question string, answer string, type string, level string, "
    "context struct<title:array<string>,sentences:array<array<string>>>, supporting_facts struct<title:array<string>>"
)


def hotpot(raw: DataFrame, name: str = "multi-hop", order: str | None = None, seed: int = 42, per_question_scope: bool = False, unanswerable_frac: float = 0.0) -> Task:
    """A task from rows of HOTPOT. Paragraphs of one title are one document, the first one in ``order`` wins.

    Without an ``order`` column rows count in the order of the files they are read from.
    """
    if order is None:
        order = "__at"
        raw = stored(raw.withColumn(order, F.monotonically_increasing_id()), "questions")
    did = F.concat(F.lit("wiki::"), F.replace("title", F.lit(" "), F.lit("_")))
    p = raw.select(F.col(order).alias("o"), "id", F.posexplode(F.arrays_zip("context.title", "context.sentences")).alias("at", "p"))
    p = p.select("o", "id", "at", F.col("p.title").alias("title"), F.trim(F.array_join("p.sentences", " ")).alias("text"))
    p = p.withColumn("doc_id", F.concat(did, F.lit("@"), "id") if per_question_scope else did)
    first = F.min_by(F.struct("text", "title", "id"), F.struct("o", "at")).alias("x")
    docs = p.groupBy("doc_id").agg(first).select(
        "doc_id", "x.text", "x.title", F.create_map(F.lit("scope"), F.col("x.id")).alias("meta") if per_question_scope else F.create_map().cast("map<string,string>").alias("meta")
    )
    gold_titles = raw.select("id", F.col("supporting_facts.title").alias("gt"))
    gold = p.join(gold_titles, "id").where(F.array_contains("gt", F.col("title"))).groupBy("id").agg(F.array_sort(F.collect_set("doc_id")).alias("gold"))
    q = raw.join(gold, "id", "left").select(
        F.col("id").alias("qid"),
        F.col("question").alias("text"),
        F.coalesce("gold", F.array().cast("array<string>")).alias("gold"),
        "answer",
        F.lit(True).alias("answerable"),
        (F.col("id") if per_question_scope else F.lit(None).cast("string")).alias("scope"),
        F.create_map(F.lit("type"), "type", F.lit("level"), "level").alias("meta"),
    )
    dropped: set[str] = set()
    if unanswerable_frac > 0:
        rows = [(r["qid"], frozenset(r["gold"])) for r in raw.select(F.col("id").alias("qid"), F.col(order).alias("o")).join(q, "qid").orderBy("o").select("qid", "gold").collect()]
        dropped = choose_unanswerable(rows, unanswerable_frac, seed)
        gone = {d for i, g in rows if i in dropped for d in g}
        spark = raw.sparkSession
        docs = docs.join(spark.createDataFrame([(d,) for d in sorted(gone)], "doc_id string"), "doc_id", "left_anti")
        lost = F.col("qid").isin(sorted(dropped)) if dropped else F.lit(False)
        q = q.withColumn("answerable", ~lost).withColumn("gold", F.when(lost, F.array().cast("array<string>")).otherwise(F.col("gold"))).withColumn("answer", F.when(~lost, F.col("answer")))
    meta = {"per_question_scope": per_question_scope, "n_unanswerable": len(dropped), "unanswerable_is_synthetic": True}
    return Task(name + ("-unans" if dropped else ""), docs, q, meta)


def choose_unanswerable(queries: list[tuple[str, frozenset[str]]], frac: float, seed: int = 42) -> set[str]:
    """Ids of queries whose gold no other still answerable query shares, in a seeded order.

    The choice depends on the ones before it, so it runs on the driver over one task's queries;
    counts of how many queries hold each document make it linear.
    """
    need, order = int(len(queries) * frac), list(range(len(queries)))
    random.Random(seed).shuffle(order)
    holders: dict[str, int] = {}
    for _, g in queries:
        for d in g:
            holders[d] = holders.get(d, 0) + 1
    out: set[str] = set()
    for i in order:
        if len(out) >= need:
            break
        qid, g = queries[i]
        if g and all(holders[d] == 1 for d in g):
            out.add(qid)
            for d in g:
                holders[d] -= 1
    return out


def books(spark: SparkSession, root: str, split: str = "test", name: str = "books") -> Task:
    """A task from ``<book>/toc.json`` trees and ``<book>/<split>.jsonl`` queries.

    Every node with a text is a document ``book::label``; gold that is in no tree makes a query
    unanswerable.
    """
    toc = spark.read.text(f"{root}/*/toc.json", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("book"), "value")

    @F.pandas_udf("array<struct<doc_id:string,text:string,title:string,path:string,depth:int>>")
    def leaves(book, value):
        import json

        import pandas as pd

        def walk(node: dict, own: str, path: list[str], depth: int, out: list) -> None:
            label = str(node.get("number") or node.get("title") or "")
            here = [*path, str(node.get("title") or "")] if node.get("title") else path
            body = next((node[x] for x in ("content", "text") if isinstance(node.get(x), str)), "")
            if body.strip():
                out.append({"doc_id": f"{own}::{label}", "text": body, "title": node.get("title"), "path": " > ".join(here), "depth": depth})
            for c in node.get("children") or []:
                walk(c, own, here, depth + 1, out)

        rows = []
        for b, v in zip(book, value, strict=True):
            out: list = []
            tree = json.loads(v)
            for node in tree if isinstance(tree, list) else [tree]:
                walk(node, b, [], 0, out)
            rows.append(out)
        return pd.Series(rows)

    docs = toc.select("book", F.explode_outer(leaves("book", "value")).alias("d")).where("d is not null").select(
        "d.doc_id", "d.text", "d.title", F.create_map(F.lit("scope"), "book", F.lit("path"), "d.path", F.lit("depth"), F.col("d.depth").cast("string")).alias("meta")
    )
    q = spark.read.schema("qid string, query string, gold_docid string, gold_number string").json(f"{root}/*/{split}.jsonl")
    q = q.withColumn("book", F.element_at(F.split(F.input_file_name(), "/"), -2))
    gold = F.when(F.contains("gold_docid", F.lit("::")), F.col("gold_docid")).otherwise(F.concat("book", F.lit("::"), F.coalesce("gold_number", "gold_docid")))
    q = q.withColumn("g", gold).join(docs.select(F.col("doc_id").alias("g"), F.lit(True).alias("known")).distinct(), "g", "left")
    none = F.array().cast("array<string>")
    q = q.select(
        "qid",
        F.col("query").alias("text"),
        F.when(F.col("known"), F.array("g")).otherwise(none).alias("gold"),
        F.lit(None).cast("string").alias("answer"),
        F.coalesce("known", F.lit(False)).alias("answerable"),
        F.col("book").alias("scope"),
        F.create_map().cast("map<string,string>").alias("meta"),
    )
    return Task(name, docs, q, {"split": split})


RECORD = (
    "qid string, ranked array<string>, answer string, abstained boolean, verdict string, confidence double, correct boolean, "
    "usage map<string,double>, error string, traceback string, latency_s double"
)


def load_records(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each qid of a JSON-lines file; broken lines are skipped."""
    if "://" not in path and not Path(path).exists():
        return spark.createDataFrame([], RECORD)
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.from_json("value", RECORD).alias("r"))
    good = lines.where(F.col("r.qid").isNotNull())
    return good.groupBy(F.col("r.qid").alias("k")).agg(F.max_by("r", "at").alias("r")).select("r.*")


def empty_task(spark: SparkSession, name: str) -> Task:
    return Task(name, spark.createDataFrame([], DOCS), spark.createDataFrame([], QUERIES))
