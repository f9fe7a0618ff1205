"""Exact vector search.

Queries are blocks of a broadcast matrix, tables are streamed past them: each batch of vectors
is one matrix product, and only the best ``k`` of all its batches leave a task. No pair of a
vector and a query becomes a row. Query sets beyond ``BLOCK`` vectors are searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, DimensionMismatch
from ..plans.hints import small_batches
from ..registry import REGISTRY
from ..storage import stored
from .bm25 import top

BLOCK, CHUNK = 20_000, 2048


@dataclass(frozen=True)
class FlatConfig:
    dim: int
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ConfigError("dim must be positive")
        if self.metric not in ("cosine", "dot"):
            raise ConfigError("metric must be cosine or dot")


@REGISTRY.register("vector_store", "flat", "exact search over all vectors", FlatConfig)
def _build(c: FlatConfig) -> FlatConfig:
    return c


def norm(v: Column) -> Column:
    """Euclidean norm; 1 for a zero vector."""
    n = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(n == 0, F.lit(1.0)).otherwise(n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def add(vectors: DataFrame, dim: int, id_col: str = "id", vec: str = "embedding") -> DataFrame:
    """id, embedding, norm; a vector of another length raises when it is read."""
    ok = F.assert_true(F.size(vec) == dim, F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(vec).cast("string")))
    return vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("embedding"), norm(F.col(vec)).alias("norm")).where(ok.isNull())


def _matrix(rows: list, dim: int) -> np.ndarray:
    for r in rows:
        if len(r) != dim:
            raise DimensionMismatch(dim, len(r))
    return np.stack(rows).astype(float) if len(rows) else np.zeros((0, dim))


def best(held, ids: np.ndarray, scores: np.ndarray, k: int):
    """query, id and score of the ``k`` best of each query, from those held and a chunk with sorted ids."""
    if k <= 0:
        return None
    n = scores.shape[1]
    least = np.partition(scores, n - k, axis=1)[:, n - k] if n > k else np.full(len(scores), -np.inf)
    q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    d, s = ids[at], scores[q, at]
    if held is not None:
        q, d, s = (np.concatenate(x) for x in zip(held, (q, d, s), strict=True))
    by_id = np.argsort(d, kind="stable")
    q, d, s = q[by_id], d[by_id], s[by_id]
    order = np.lexsort((-s, q))  # stable: equal ones stay by id
    q, d, s = q[order], d[order], s[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, "int64")
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return q[rank < k], d[rank < k], s[rank < k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", id_col: str = "id", vec: str = "embedding", qid: str = "qid", exclude_self: bool = False) -> DataFrame:
    """qid, rank, doc_id, score of each query's best ``k`` vectors, by rounded score and then id."""
    spark = vectors.sparkSession
    small_batches(spark)
    q = queries.select(F.col(qid).alias("qid"), F.col(vec).alias("v"))
    out = None
    id_type, q_type = dict(vectors.dtypes)[id_col], dict(q.dtypes)["qid"]
    iterator = q.toLocalIterator(prefetchPartitions=False)
    while True:
        block = [r for _, r in zip(range(BLOCK), iterator, strict=False)]
        if not block:
            break
        dim = len(block[0]["v"])
        m = _matrix([r["v"] for r in block], dim)
        if metric == "cosine":
            length = np.sqrt((m * m).sum(1, keepdims=True))
            m = m / np.where(length == 0, 1.0, length)
        shared = spark.sparkContext.broadcast(([r["qid"] for r in block], m))  # at most BLOCK vectors

        def run(batches: Iterator[pd.DataFrame], shared=shared, dim=dim) -> Iterator[pd.DataFrame]:
            ids, mat = shared.value
            place = {x: i for i, x in enumerate(ids)}
            kept = None  # query, id, score of the best k of each query so far
            for b in batches:
                for at in range(0, len(b), CHUNK):
                    c = b.iloc[at : at + CHUNK]
                    v = _matrix(c["v"].to_numpy(), dim)
                    if metric == "cosine":
                        length = np.sqrt((v * v).sum(1, keepdims=True))
                        v = v / np.where(length == 0, 1.0, length)
                    own = c["id"].to_numpy()
                    order = np.argsort(own, kind="stable")
                    own, s = own[order], np.round(mat @ v[order].T, 6)
                    if exclude_self:
                        for j, x in enumerate(own):
                            if x in place:
                                s[place[x], j] = -np.inf
                    kept = best(kept, own, s, k)
            if kept is not None:
                q, d, score = kept
                yield pd.DataFrame({"qid": np.array(ids, object)[q], "doc_id": d, "score": score})

        if len(block) == BLOCK and out is None:
            vectors = stored(vectors.select(id_col, vec), "vectors")  # further blocks read them again
        part = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).mapInPandas(run, f"qid {q_type}, doc_id {id_type}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], f"qid {q_type}, doc_id {id_type}, score double")
    return stored(top(out, k), "hits")  # read more than once by most


def cosine(a: Column, b: Column) -> Column:
    """For joins where the pairs are known: everything stays built-in."""
    return dot(a, b) / (norm(a) * norm(b))
