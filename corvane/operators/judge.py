"""Rerankers and verifiers: by shared terms with built-ins, or by a typed HTTP judge."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import providers as P
from ..errors import ConfigError
from ..functions import tokenize
from ..registry import REGISTRY
from .bm25 import Bm25Config, idf, weight


@dataclass(frozen=True)
class LexicalConfig(Bm25Config):
    pass


@dataclass(frozen=True)
class CoverageConfig:
    tokenizer: object = "simple"
    threshold: float = 0.6
    min_term_len: int = 3

    def __post_init__(self) -> None:
        if not 0 <= self.threshold <= 1:
            raise ConfigError("threshold must be in [0, 1]")


@dataclass(frozen=True)
class TypedConfig:
    model: str = "judge"
    endpoint: str = "https://localhost/v1/judge"
    api_key_env: str = "JUDGE_API_KEY"
    max_chars: int = 1200
    requests_per_minute: float = 0.0
    timeout_secs: float = 60.0
    cache: str = "judge"
    retry: P.RetryPolicy = P.RetryPolicy()

    def __post_init__(self) -> None:
        if self.max_chars <= 0:
            raise ConfigError("max_chars must be positive")


@REGISTRY.register("reranker", "lexical", "BM25 whose collection is the shortlist", LexicalConfig)
def _lexical(c: LexicalConfig) -> LexicalConfig:
    return c


@REGISTRY.register("verifier", "coverage", "share of the question's terms that the evidence holds", CoverageConfig)
def _coverage(c: CoverageConfig) -> CoverageConfig:
    return c


def rerank_lexical(shortlist: DataFrame, config: dict | None = None) -> DataFrame:
    """``shortlist`` (qid, doc_id, query, text, ...) with a score from statistics of each qid's own candidates.

    Every candidate stays; one without a shared term scores 0.
    """
    c = REGISTRY.build("reranker", "lexical", config)
    tok = tokenize.build(c.tokenizer)
    s = shortlist.withColumn("__t", tok.lowered(F.col("text"))).withColumn("dl", F.size("__t"))
    per = W.partitionBy("qid")
    s = s.withColumn("n", F.count("*").over(per)).withColumn("avg", F.greatest(F.sum("dl").over(per) / F.col("n"), F.lit(1.0)))
    own = s.select("qid", "doc_id", "dl", "n", "avg", "query", F.explode("__t").alias("term"))
    tf = own.groupBy("qid", "doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"), F.first("n").alias("n"), F.first("avg").alias("avg"))
    tf = tf.withColumn("df", F.count("*").over(W.partitionBy("qid", "term")))
    q = shortlist.select("qid", "query").distinct().select("qid", F.explode(tok.lowered(F.col("query"))).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("qtf"))
    term_idf = idf(F.col("n"), F.col("df"))
    score = F.sum(F.col("qtf") * term_idf * weight(F.col("tf"), F.col("dl"), F.col("avg"), c.k1, c.b)).alias("score")
    scored = tf.join(q, ["qid", "term"]).groupBy("qid", "doc_id").agg(score)
    keep = [x for x in shortlist.columns if x != "score"]
    return shortlist.select(*keep).join(scored, ["qid", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def lexical_scores(query: str, candidates: list[str], config: dict | None = None) -> list[float]:
    """The same on the driver, for one query."""
    import math

    c = REGISTRY.build("reranker", "lexical", config)
    split = tokenize.build(c.tokenizer).split
    docs = [[t.lower() for t in split(x)] for x in candidates]
    n, avg = len(docs), max(sum(map(len, docs)) / max(len(docs), 1), 1.0)
    out = []
    for d in docs:
        s = 0.0
        for t in split(query):
            t = t.lower()
            df, tf = sum(t in x for x in docs), d.count(t)
            if tf:
                s += math.log((n + 1) / (df + 0.5)) * tf * (c.k1 + 1) / (tf + c.k1 * (1 - c.b + c.b * len(d) / avg))
        out.append(s)
    return out


def reordered(scored: DataFrame, k: int) -> DataFrame:
    """qid, rank, doc_id, score: by score, equal ones in their first order."""
    w = W.partitionBy("qid").orderBy(F.desc("score"), "first_rank")
    s = scored.withColumn("first_rank", F.col("rank")).withColumn("rank", F.row_number().over(w))
    return s.where(F.col("rank") <= k).select("qid", "rank", "doc_id", "score")


def verify_coverage(evidence: DataFrame, queries: DataFrame, config: dict | None = None) -> DataFrame:
    """qid, support, confidence, window from ``evidence`` (qid, text) and ``queries`` (qid, text)."""
    c = REGISTRY.build("verifier", "coverage", config)
    tok = tokenize.build(c.tokenizer)
    long = lambda t: F.length(t) >= c.min_term_len
    q = queries.select("qid", F.array_distinct(F.filter(tok.lowered(F.col("text")), long)).alias("asked"))
    e = evidence.select("qid", tok.lowered(F.col("text")).alias("terms"))
    window = e.groupBy("qid").agg(F.count("*").alias("window"))
    asked = q.select("qid", F.explode("asked").alias("term"))
    have = e.select("qid", F.explode("terms").alias("term")).join(asked, ["qid", "term"], "left_semi").distinct().groupBy("qid").agg(F.count("*").alias("have"))
    j = q.join(window, "qid", "left").join(have, "qid", "left")
    w, h, n = F.coalesce("window", F.lit(0)), F.coalesce("have", F.lit(0)), F.size("asked")
    share = h / F.greatest(n, F.lit(1))
    none = (n == 0) | (w == 0)
    support = F.when(none, "insufficient").when(share >= c.threshold, "supports").otherwise("insufficient")
    confidence = F.when(none, F.lit(1.0)).otherwise(F.least(F.abs(share - c.threshold), F.lit(1.0)))
    return j.select("qid", support.alias("support"), confidence.alias("confidence"), w.cast("long").alias("window"))


def should_answer(min_confidence: float) -> Column:
    return (F.col("support") == "supports") & (F.col("confidence") >= min_confidence)


def abstains(min_confidence: float) -> Column:
    """An evidence that refutes is still an answer."""
    return (F.col("support") == "insufficient") | (F.col("confidence") < min_confidence)


def promote(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Reranked evidence (qid, doc_id, score) first, then the rest of ``ranked`` in its order."""
    j = ranked.select("qid", "doc_id", F.col("rank").alias("first_rank")).join(evidence.select("qid", "doc_id", F.col("score").alias("s")), ["qid", "doc_id"], "left")
    w = W.partitionBy("qid").orderBy(F.col("s").isNull(), F.desc("s"), "first_rank")
    return j.select("qid", F.row_number().over(w).alias("rank"), "doc_id")


@dataclass
class TypedJudge:
    """A judge that answers typed questions about a state, in one request for each call."""

    config: TypedConfig
    http: P.HttpPost | None = None
    key: str | None = None

    def _ask(self, state: dict, questions: dict) -> dict:
        c = self.config
        http = P.shared_transport(c.cache, c.requests_per_minute, c.timeout_secs, self.http)
        return P.ask(http, c.endpoint, self.key or P.api_key(c.api_key_env), {"model": c.model, "state": state, "questions": questions}, c.retry).get("answers", {})

    def rerank(self, query: str, candidates: list[str]) -> list[float]:
        if not candidates:
            return []
        state = {"query": query, "candidates": [x[: self.config.max_chars] for x in candidates]}
        criteria = {"true": "it states something that the answer needs", "false": "it is off topic or only touches on the subject"}
        ask = {f"c{i}": {"type": "noul", "instructions": f"candidates[{i}] answers the query", "criteria": criteria} for i in range(len(candidates))}
        answers = self._ask(state, ask)
        return [float((answers.get(f"c{i}") or {}).get("noul") or 0.0) for i in range(len(candidates))]

    def verify(self, query: str, evidence: list[str]) -> tuple[str, float, int]:
        if not evidence:
            return "insufficient", 1.0, 0
        state = {"question": query, "evidence": [x[: self.config.max_chars] for x in evidence]}
        criteria = {"supports": "all passages together give an answer", "refutes": "together they contradict what is asked", "insufficient": "something is missing or they disagree"}
        question = dict(type="choice", instructions="Judge the passages as one set: is the question answered?", criteria=criteria)
        v = self._ask(state, dict(verdict=question)).get("verdict") or {}
        choice = v.get("choice") if v.get("choice") in ("supports", "refutes") else "insufficient"
        return choice, float(v.get("confidence") or 0.0), len(evidence)


REGISTRY.register("reranker", "typed", "probabilities from a typed HTTP judge", TypedConfig)(TypedJudge)
REGISTRY.register("verifier", "typed", "one verdict on the whole evidence from a typed HTTP judge", TypedConfig)(TypedJudge)


def rerank_with(shortlist: DataFrame, reranker) -> DataFrame:
    """``shortlist`` (qid, rank, doc_id, query, text) scored by a provider, one call for each qid.

    A shortlist is a search's top k, so a qid's group is bounded.
    """
    types = dict(shortlist.dtypes)

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rank")
        try:
            s, err = reranker.rerank(g["query"].iloc[0], list(g["text"])), None
        except Exception as e:  # noqa: BLE001  the failure is a column
            s, err = [0.0] * len(g), f"{type(e).__name__}: {e}"
        return g[["qid", "rank", "doc_id"]].assign(score=s, error=err)

    return shortlist.groupBy("qid").applyInPandas(run, f"qid {types['qid']}, rank int, doc_id {types['doc_id']}, score double, error string")


def verify_with(evidence: DataFrame, queries: DataFrame, verifier) -> DataFrame:
    """qid, support, confidence, window, error from a provider; evidence (qid, rank, text) is a bounded top k."""
    g = evidence.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("e"))
    j = queries.select("qid", "text").join(g, "qid", "left").select("qid", "text", F.transform("e", lambda x: x["text"]).alias("e"))

    @F.pandas_udf("struct<support:string,confidence:double,window:long,error:string>")
    def run(text: pd.Series, e: pd.Series) -> pd.DataFrame:
        out = []
        for t, x in zip(text, e, strict=True):
            try:
                out.append((*verifier.verify(t, list(x) if x is not None else []), None))
            except Exception as ex:  # noqa: BLE001
                out.append(("insufficient", 0.0, 0, f"{type(ex).__name__}: {ex}"))
        return pd.DataFrame(out, columns=["support", "confidence", "window", "error"])

    return j.select("qid", run("text", "e").alias("v")).select("qid", "v.*")
