"""Query transforms: one query to one or several."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import providers as P
from ..errors import ConfigError, RetryableError
from ..functions import tokenize
from ..registry import REGISTRY


@dataclass(frozen=True)
class IdentityConfig:
    pass


@dataclass(frozen=True)
class Rm3Config:
    tokenizer: object = "simple"
    expansion_terms: int = 10
    feedback_docs: int = 3
    min_term_len: int = 4

    def __post_init__(self) -> None:
        if self.feedback_docs <= 0:
            raise ConfigError("feedback_docs must be positive")


@dataclass(frozen=True)
class MultiQueryConfig:
    chat: P.ChatConfig = P.ChatConfig()
    variants: int = 3
    keep_original: bool = True

    def __post_init__(self) -> None:
        if self.variants <= 0:
            raise ConfigError("variants must be positive")


@dataclass(frozen=True)
class HydeConfig:
    chat: P.ChatConfig = P.ChatConfig()
    keep_original: bool = False


@dataclass(frozen=True)
class DecomposeConfig:
    chat: P.ChatConfig = P.ChatConfig()
    max_parts: int = 3
    keep_original: bool = True

    def __post_init__(self) -> None:
        if self.max_parts <= 0:
            raise ConfigError("max_parts must be positive")


def identity(queries: DataFrame) -> DataFrame:
    """qid, n, text."""
    return queries.select("qid", F.lit(0).alias("n"), "text")


def rm3(queries: DataFrame, feedback: DataFrame, config: Rm3Config | dict | None = None) -> DataFrame:
    """qid, n, text: the query with the best terms of its feedback texts appended.

    ``feedback``: qid, rank, text of a first search. A term scores its occurrences plus two for
    each feedback text that holds it; the query's own and short terms are left out.
    """
    c = REGISTRY.entry("transform", "rm3").build(config) if isinstance(config, Rm3Config) else REGISTRY.build("transform", "rm3", config).config
    tok = tokenize.build(c.tokenizer)
    f = feedback.where(F.col("rank") <= c.feedback_docs).select("qid", "rank", F.explode(tok.lowered(F.col("text"))).alias("term"))
    f = f.where(F.length("term") >= c.min_term_len)
    own = queries.select("qid", F.explode(tok.lowered(F.col("text"))).alias("term")).distinct()
    t = f.join(own, ["qid", "term"], "left_anti").groupBy("qid", "term").agg((F.count("*") + 2 * F.count_distinct("rank")).alias("score"))
    r = t.withColumn("r", F.row_number().over(W.partitionBy("qid").orderBy(F.desc("score"), "term"))).where(F.col("r") <= c.expansion_terms)
    more = r.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("r", "term"))).alias("x"))  # expansion_terms at most
    more = more.select("qid", F.array_join(F.transform("x", lambda v: v["term"]), " ").alias("more"))
    return queries.join(more, "qid", "left").select("qid", F.lit(0).alias("n"), F.concat_ws(" ", "text", "more").alias("text"))


def degrade(make: Callable[[], list[str]], query: str) -> list[str]:
    """Transient failures leave the query as it was; others propagate."""
    try:
        return make()
    except RetryableError:
        return [query]


def _same(a: str, b: str) -> bool:
    fold = lambda s: "".join(c.lower() if c.isascii() else c for c in s.strip())
    return fold(a) == fold(b)


@dataclass
class ChatTransform:
    """multi_query, hyde or decompose over a chat provider."""

    name: str
    config: object
    chat: P.Chat
    uses_feedback: bool = False
    prompts: dict[str, str] = field(
        default_factory=lambda: {
            "multi_query": "Write {n} other wordings of the question, one on each line and nothing else.",
            "hyde": "Answer the question with a short passage such as an encyclopedia would hold.",
            "decompose": "List up to {n} simpler questions whose answers together answer this one, one a line.",
        }
    )

    def transform(self, query: str, feedback: list[str] | None = None) -> list[str]:
        c = self.config
        n = getattr(c, "variants", getattr(c, "max_parts", 1))

        def make() -> list[str]:
            reply = self.chat.complete(self.prompts[self.name].format(n=n), query)
            new = [reply.strip()] if self.name == "hyde" else [x for x in P.parse_lines(reply, n) if not _same(x, query)]
            return ([query] if c.keep_original or not new else []) + new

        return degrade(make, query)


@dataclass
class Offline:
    name: str
    config: object
    uses_feedback: bool

    def transform(self, query: str, feedback: list[str] | None = None) -> list[str]:
        if self.name == "identity" or not feedback:
            return [query]
        c = self.config
        split = tokenize.build(c.tokenizer).split
        own = {t.lower() for t in split(query)}
        score: dict[str, int] = {}
        for text in feedback[: c.feedback_docs]:
            terms = [t.lower() for t in split(text)]
            for t in terms:
                score[t] = score.get(t, 0) + 1
            for t in set(terms):
                score[t] += 2
        best = sorted((t for t in score if len(t) >= c.min_term_len and t not in own), key=lambda t: (-score[t], t))
        return [" ".join([query, *best[: c.expansion_terms]])]


REGISTRY.register("transform", "identity", "the query as it is", IdentityConfig)(lambda c: Offline("identity", c, False))
REGISTRY.register("transform", "rm3", "terms of the best documents of a first search are appended", Rm3Config)(lambda c: Offline("rm3", c, True))
REGISTRY.register("transform", "multi_query", "paraphrases from a chat model", MultiQueryConfig)(lambda c: ChatTransform("multi_query", c, P.Chat(c.chat)))
REGISTRY.register("transform", "hyde", "a passage that a chat model invents", HydeConfig)(lambda c: ChatTransform("hyde", c, P.Chat(c.chat)))
REGISTRY.register("transform", "decompose", "simpler questions from a chat model", DecomposeConfig)(lambda c: ChatTransform("decompose", c, P.Chat(c.chat)))


def apply(queries: DataFrame, transformer, feedback: DataFrame | None = None) -> DataFrame:
    """qid, n, text for any transform; a query's failure becomes its ``error`` column."""

    @F.pandas_udf("struct<texts:array<string>,error:string>")
    def run(text: pd.Series, seen: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for t, f in zip(text, seen, strict=True):
            try:
                texts.append(transformer.transform(t or "", list(f) if f is not None else []))
                errors.append(None)
            except Exception as e:  # noqa: BLE001  one query must not end the job
                texts.append([t])
                errors.append(f"{type(e).__name__}: {e}")
        return pd.DataFrame({"texts": texts, "error": errors})

    q = queries.select("qid", "text")
    if feedback is not None and transformer.uses_feedback:
        n = transformer.config.feedback_docs
        f = feedback.where(F.col("rank") <= n).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("f"))
        q = q.join(f, "qid", "left").withColumn("f", F.transform("f", lambda x: x["text"]))
    else:
        q = q.withColumn("f", F.array().cast("array<string>"))
    r = q.select("qid", run("text", "f").alias("r"))
    return r.select("qid", F.posexplode("r.texts").alias("n", "text"), F.col("r.error").alias("error"))


def parse_lines_column(text, limit: int):
    """``parse_lines`` in built-ins only."""
    lines = F.split(F.coalesce(text, F.lit("")), r"\r?\n")
    bare = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"^[-*•]+\s*", ""))
    bare = F.transform(bare, lambda x: F.regexp_replace(F.regexp_replace(x, r"^[0-9]{1,2}[.)]\s*", ""), r"^[\"'`]+|[\"'`]+$", ""))
    bare = F.transform(bare, lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    return F.slice(F.filter(bare, lambda x: (F.octet_length(x) >= 3) & ~x.endswith(":")), 1, limit)
