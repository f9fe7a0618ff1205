"""End-to-end systems: each maps a task to hits (qid, rank, doc_id, score), some with verdicts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bm25, dense, embed, fuse, judge, metrics, transform
from ..registry import REGISTRY
from ..storage import stored
from .hints import small
from .task import Task

#: Offline stand-in for a learned encoder; any embedder of the registry can take its place.
ENCODER = ("hashing", {"dim": 512})


@dataclass(frozen=True)
class System:
    name: str
    answer: Callable[[Task, DataFrame], DataFrame]  # (task, queries qid/text) -> records
    config: dict = field(default_factory=dict)


def records(hits: DataFrame, queries: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """qid, ranked, abstained, confidence, verdict of all queries, also of those without a hit."""
    r = queries.select("qid").join(metrics.ranked_lists(hits), "qid", "left")
    r = r.withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
    if extra is not None:
        return r.join(extra, "qid", "left")
    first = hits.where("rank = 1").select("qid", F.col("score").alias("confidence"))
    return r.join(first, "qid", "left").withColumn("abstained", F.lit(False)).withColumn("verdict", F.lit(None).cast("string"))


def dense_hits(task: Task, queries: DataFrame, k: int, encoder=ENCODER, metric: str = "cosine", vectors: DataFrame | None = None) -> DataFrame:
    d = vectors if vectors is not None else embed.embed(task.titled(), *encoder)
    q = embed.embed(queries.select("qid", "text"), *encoder)
    return dense.search(d, q, k, metric, "doc_id")


def naive(k: int = 10, encoder=ENCODER) -> System:
    return System("naive", lambda t, q: records(dense_hits(t, q, k, encoder), q))


def lexical(config=None, k: int = 10) -> System:
    """BM25 alone."""
    return System("bm25", lambda t, q: records(bm25.search(t.titled(), q, k, config), q))


def bm25_system(k: int = 10, tokenizer: str = "simple") -> System:
    return lexical({"tokenizer": tokenizer}, k)


def hashed(config=None, k: int = 10) -> System:
    """Hashing vectors alone."""
    return System("hashing", lambda t, q: records(dense_hits(t, q, k, ("hashing", config or {"dim": 256})), q))


def hybrid_rrf(k: int = 10, depth: int = 50, rrf_k: float = 60.0, encoder=ENCODER) -> System:
    def answer(t: Task, q: DataFrame) -> DataFrame:
        legs = [bm25.search(t.titled(), q, depth), dense_hits(t, q, depth, encoder)]
        return records(fuse.rrf(legs, rrf_k, k), q)

    return System("hybrid_rrf", answer)


def _shortlist(t: Task, q: DataFrame, depth: int, encoder) -> DataFrame:
    """The texts of the hits, stored: ``depth`` for each query, read more than once."""
    hits = small(dense_hits(t, q, depth, encoder))
    return stored(hits.join(t.titled(), "doc_id").join(q.select("qid", F.col("text").alias("query")), "qid"), "shortlist")


def reranked(k: int = 10, depth: int = 10, reranker: str | object | None = "lexical", encoder=ENCODER) -> System:
    def answer(t: Task, q: DataFrame) -> DataFrame:
        if reranker is None:
            return records(dense_hits(t, q, k, encoder), q)
        # scores count to six digits, as those of a search, so that equal texts keep their order
        s = _shortlist(t, q, depth, encoder)
        scored = judge.rerank_lexical(s) if reranker == "lexical" else judge.rerank_with(s, reranker)
        return records(judge.reordered(scored.withColumn("score", F.round("score", 6)), k), q)

    return System("reranked", answer)


def query_rewrite(k: int = 10, name: str = "rm3", config: dict | None = None, transformer=None, encoder=ENCODER) -> System:
    def answer(t: Task, q: DataFrame) -> DataFrame:
        tr = transformer or REGISTRY.build("transform", name, config)
        feedback = vectors = None
        if tr.uses_feedback:
            vectors = stored(embed.embed(t.titled(), *encoder).select("doc_id", "embedding"), "vectors")  # for both searches
            feedback = small(dense_hits(t, q, tr.config.feedback_docs, encoder, vectors=vectors)).join(t.titled(), "doc_id").select("qid", "rank", "text")
        if name == "rm3" and transformer is None:
            new = transform.rm3(q, feedback, config)
        elif name == "identity" and transformer is None:
            new = transform.identity(q)
        else:
            new = transform.apply(q, tr, feedback)
        # one text for each query: searched to k; several: each to 2 k, then fused
        new = stored(new.withColumn("part", F.concat_ws("\x1f", "qid", F.col("n").cast("string"))), "rewritten")
        counts = new.groupBy("qid").agg(F.count("*").alias("texts"))
        hits = dense_hits(t, new.select(F.col("part").alias("qid"), "text"), 2 * k, encoder, vectors=vectors).withColumnRenamed("qid", "part")
        hits = hits.join(new.select("part", "qid"), "part").join(counts, "qid")
        one = hits.where(f"texts = 1 and rank <= {k}").select("qid", "rank", "doc_id", "score")
        return records(one.unionByName(fuse.rrf([hits.where("texts > 1").select("qid", "rank", "doc_id")], 60.0, k)), q)

    return System(f"query_rewrite_{name}", answer)


def sure(verifier: str | object = "coverage", reranker: str | object | None = "lexical", min_confidence: float = 0.0, n_evidence: int = 5, k: int = 10, encoder=ENCODER) -> System:
    """Dense hits, one verdict over the first ``n_evidence``, those reranked and promoted, or abstention."""

    def answer(t: Task, q: DataFrame) -> DataFrame:
        s = _shortlist(t, q, k, encoder)
        evidence = s.where(F.col("rank") <= n_evidence)
        if verifier == "coverage":
            v = judge.verify_coverage(evidence.select("qid", "text"), q)
        else:
            v = judge.verify_with(evidence.select("qid", "rank", "text"), q, verifier)
        ranked = s.select("qid", "doc_id", "rank")
        if reranker is not None:
            scored = judge.rerank_lexical(evidence) if reranker == "lexical" else judge.rerank_with(evidence, reranker)
            ranked = judge.promote(ranked, scored.select("qid", "doc_id", F.round("score", 6).alias("score")))
        extra = v.select("qid", judge.abstains(min_confidence).alias("abstained"), "confidence", F.col("support").alias("verdict"))
        return records(ranked, q, extra)

    return System("sure", answer)


SYSTEMS: dict[str, Callable[..., System]] = {
    "naive": naive,
    "hybrid_rrf": hybrid_rrf,
    "bm25": bm25_system,
    "hashing": hashed,
    "reranked": reranked,
    "query_rewrite": query_rewrite,
    "sure": sure,
}
