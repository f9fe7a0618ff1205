"""Embedders as columns: signed feature hashing offline, and an HTTP provider."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import providers as P
from ..errors import ConfigError, DimensionMismatch, ProviderError
from ..functions import tokenize
from ..functions.hashing import HashingConfig, HashingEmbedder
from ..plans.hints import small_batches
from ..registry import REGISTRY


@REGISTRY.register("embedder", "hashing", "signed hashes of tokens and character windows, of unit length", HashingConfig)
def hashing(c: HashingConfig) -> HashingEmbedder:
    return HashingEmbedder(c, tokenize.build(c.tokenizer).split)


@dataclass(frozen=True)
class OpenAiConfig:
    model: str
    dim: int
    endpoint: str = "https://localhost/v1/embeddings"
    api_key_env: str = "EMBED_API_KEY"
    max_batch: int = 64
    requests_per_minute: float = 0.0
    timeout_secs: float = 60.0
    cache: str = "openai"
    retry: P.RetryPolicy = P.RetryPolicy()

    def __post_init__(self) -> None:
        if not self.model:
            raise ConfigError("model is empty")
        if self.dim <= 0 or self.max_batch <= 0:
            raise ConfigError("dim and max_batch must be positive")


@dataclass
class OpenAiEmbedder:
    config: OpenAiConfig
    http: P.HttpPost | None = None
    key: str | None = None
    usage: dict[str, float] = field(default_factory=lambda: {"requests": 0, "prompt_tokens": 0, "usd": 0.0})

    def embed_many(self, texts: list[str | None]) -> list[list[float]]:
        c, out = self.config, []
        http = P.shared_transport(c.cache, c.requests_per_minute, c.timeout_secs, self.http)
        key = self.key or P.api_key(c.api_key_env)
        for at in range(0, len(texts), c.max_batch):
            part = [t or "" for t in texts[at : at + c.max_batch]]
            reply = P.ask(http, c.endpoint, key, {"model": c.model, "input": part}, c.retry)
            rows = sorted(reply.get("data", []), key=lambda r: r["index"])
            if len(rows) != len(part):
                raise ProviderError("invalid", f"{len(rows)} vectors for {len(part)} texts")
            for r in rows:
                if len(r["embedding"]) != c.dim:
                    raise DimensionMismatch(c.dim, len(r["embedding"]))
                out.append(r["embedding"])
            u = reply.get("usage") or {}
            self.usage["requests"] += 1
            self.usage["prompt_tokens"] += u.get("prompt_tokens", 0)
            self.usage["usd"] += u.get("cost", 0.0) or 0.0
        return out


@REGISTRY.register("embedder", "openai", "vectors from an HTTP endpoint of the usual form", OpenAiConfig)
def openai(c: OpenAiConfig) -> OpenAiEmbedder:
    return OpenAiEmbedder(c)


def embed(df: DataFrame, name: str = "hashing", config: dict | None = None, text: str = "text", into: str = "embedding", component=None) -> DataFrame:
    """``df`` with a vector of each text; a batch of rows is one call of the embedder."""
    made = component or REGISTRY.build("embedder", name, config)
    small_batches(df.sparkSession)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = made if component else REGISTRY.build("embedder", name, config)
        for s in batches:
            yield pd.Series([np.asarray(v, "float32") for v in own.embed_many(list(s))])

    return df.withColumn(into, run(F.col(text)))


def usage(records: DataFrame) -> DataFrame:
    """Requests, prompt tokens and cost summed over rows with those columns."""
    return records.agg(*[F.sum(c).alias(c) for c in ("requests", "prompt_tokens", "usd")])
