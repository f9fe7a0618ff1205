"""Retrieval metrics, risk-coverage curves, percentiles and paired tests.

Records: qid, ranked array<string>, abstained, confidence, correct, usage map<string,double>,
latency_s, error. Qrels: qid, gold array<string>.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.hints import small
from ..storage import stored


def recall_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ranked, 1, k), gold)) / F.size(F.array_distinct(gold))).otherwise(F.lit(0.0))


def ndcg_at(ranked: Column, gold: Column, k: int) -> Column:
    gains = F.transform(F.slice(ranked, 1, k), lambda d, i: F.when(F.array_contains(gold, d), 1.0 / F.log2(i + F.lit(2.0))).otherwise(F.lit(0.0)))
    ideal = F.element_at(F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, k + 1)]), F.greatest(F.least(F.size(F.array_distinct(gold)), F.lit(k)), F.lit(1)))
    return F.when(F.size(gold) > 0, F.aggregate(gains, F.lit(0.0), lambda a, x: a + x) / ideal).otherwise(F.lit(0.0))


def mrr(ranked: Column, gold: Column) -> Column:
    first = F.array_min(F.filter(F.transform(ranked, lambda d, i: F.when(F.array_contains(gold, d), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / first, F.lit(0.0))


def hit_at(ranked: Column, gold: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(F.slice(ranked, 1, k), gold), F.lit(1.0)).otherwise(F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "recall@1": partial(recall_at, k=1),
    "recall@5": partial(recall_at, k=5),
    "recall@10": partial(recall_at, k=10),
    "ndcg@10": partial(ndcg_at, k=10),
    "mrr": mrr,
    "hit@1": partial(hit_at, k=1),
    "hit@5": partial(hit_at, k=5),
}
DEFAULT = tuple("recall@1 recall@5 ndcg@10 mrr hit@5".split())


def ranked_lists(hits: DataFrame, qid: str = "qid", id_col: str = "doc_id") -> DataFrame:
    """qid, ranked: a search's hits as one list; it has at most the search's k entries."""
    g = hits.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).cast("string").alias("d")))).alias("x"))
    return g.select(qid, F.transform("x", lambda x: x["d"]).alias("ranked"))


def judged(records: DataFrame, qrels: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """Records that did not fail, with a column for each metric (null without gold) and ``was_correct``."""
    none = F.array().cast("array<string>")
    r = records.where(F.col("error").isNull() | (F.col("error") == "")) if "error" in records.columns else records
    r = r.join(qrels.select("qid", "gold"), "qid", "left").withColumn("gold", F.coalesce("gold", none)).withColumn("ranked", F.coalesce("ranked", none))
    has = F.size("gold") > 0
    abstained = F.coalesce(F.col("abstained"), F.lit(False)) if "abstained" in r.columns else F.lit(False)
    given = F.col("correct") if "correct" in r.columns else F.lit(None).cast("boolean")
    own = F.coalesce(given, F.arrays_overlap(F.slice("ranked", 1, 1), F.col("gold")), F.lit(False))
    r = r.withColumn("abstained", abstained).withColumn("was_correct", F.when(has, own).otherwise(F.col("abstained")))
    return r.select("*", *[F.when(has, METRICS[m](F.col("ranked"), F.col("gold"))).alias(m) for m in metrics])


def per_query(records: DataFrame, qrels: DataFrame, metrics: Sequence[str] = DEFAULT) -> DataFrame:
    """qid, metric, value of all queries with gold."""
    j = judged(records, qrels, metrics).where(F.size("gold") > 0)
    return j.unpivot("qid", [F.col(f"`{m}`") for m in metrics], "metric", "value")


def aggregate(per: DataFrame) -> DataFrame:
    """metric, value, n: the mean of each metric."""
    return per.groupBy("metric").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def risk_curve(outcomes: DataFrame, order: str = "qid") -> DataFrame:
    """i, coverage, risk along falling confidence, equal ones by ``order``.

    ``outcomes``: correct, confidence, abstained and ``order``. The place of an outcome is its
    rank in its confidence block plus the outcomes of the blocks before, so the order over all
    of them is no single task's work; the table of blocks has one row for each distinct value
    of the rounded-down rank of confidence.
    """
    n = outcomes.select(F.count("*").alias("n"))
    a = outcomes.where(~F.col("abstained") & F.col("confidence").isNotNull()).select(F.col(order).alias("o"), F.col("confidence").alias("c"), (~F.col("correct")).cast("long").alias("e"))
    ranged = stored(a.repartitionByRange("c", "o").withColumn("p", F.spark_partition_id()), "ranged")  # so that all see the same parts
    inside = W.partitionBy("p").orderBy(F.desc("c"), "o")
    r = ranged.withColumn("i", F.row_number().over(inside)).withColumn("errors", F.sum("e").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    parts = r.groupBy("p").agg(F.max("i").alias("n_p"), F.sum("e").alias("e_p"))
    before = W.orderBy(F.desc("p")).rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    parts = parts.select("p", F.coalesce(F.sum("n_p").over(before), F.lit(0)).alias("i0"), F.coalesce(F.sum("e_p").over(before), F.lit(0)).alias("e0"))
    j = r.join(F.broadcast(parts), "p").withColumn("i", F.col("i") + F.col("i0")).withColumn("errors", F.col("errors") + F.col("e0"))
    return j.join(F.broadcast(n)).select("i", (F.col("i") / F.col("n")).alias("coverage"), (F.col("errors") / F.col("i")).alias("risk"))


def risk_summary(outcomes: DataFrame, order: str = "qid") -> DataFrame:
    """One row: coverage, risk and aurc (null without any confidence)."""
    answered = F.when(~F.col("abstained"), F.lit(1)).otherwise(F.lit(0))
    wrong = F.when(~F.col("abstained") & ~F.col("correct"), F.lit(1)).otherwise(F.lit(0))
    s = outcomes.agg(
        F.coalesce(F.sum(answered) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.sum(wrong) / F.nullif(F.sum(answered), F.lit(0)), F.lit(0.0)).alias("risk"),
    )
    return s.join(F.broadcast(risk_curve(outcomes, order).agg(F.avg("risk").alias("aurc"))))


PERCENTILES = (0.50, 0.95, 0.99)


def percentiles(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """by, p50, p95, p99, mean: the value at place min(n - 1, floor(q n)) of the sorted values.

    Places come from counts of distinct values in ranges of values, so no task has a whole group.
    """
    by = list(by)
    c = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    c = stored(c.repartitionByRange(*by, "v").withColumn("p", F.spark_partition_id()), "counts")
    parts = c.groupBy(*by, "p").agg(F.sum("c").alias("c_p"))  # a row for each group and partition
    w = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    parts = parts.withColumn("skip", F.sum("c_p").over(w.orderBy("p")) - F.col("c_p")).withColumn("n", F.sum("c_p").over(w))
    parts = parts.select(*[F.col(x).alias(f"_by{i}") for i, x in enumerate(by)], F.col("p").alias("_p"), "skip", "n")
    same = [F.col(x).eqNullSafe(F.col(f"_by{i}")) for i, x in enumerate(by)] + [F.col("p") == F.col("_p")]
    c = c.join(small(parts), reduce(lambda x, y: x & y, same))
    c = c.withColumn("upto", F.col("skip") + F.sum("c").over(W.partitionBy(*by, "p").orderBy("v")))
    at = [F.least(F.col("n") - 1, F.floor(F.lit(q) * F.col("n"))) for q in PERCENTILES]
    picks = [F.min(F.when(F.col("upto") > a, F.col("v"))).alias(f"p{int(q * 100)}") for q, a in zip(PERCENTILES, at, strict=True)]
    return c.groupBy(*by).agg(*picks, (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))


def costs(records: DataFrame) -> DataFrame:
    """One row: usd, tokens_in, tokens_out."""
    return records.agg(*[F.coalesce(F.sum(F.try_element_at("usage", F.lit(k))), F.lit(0.0)).alias(k) for k in ("usd", "tokens_in", "tokens_out")])


def randomization_test(a: Mapping[str, float], b: Mapping[str, float], n_samples: int = 10_000, seed: int = 42) -> dict[str, float]:
    """Paired two-sided test by random signs, with the standard library's generator.

    The stream of random numbers is drawn in the order of samples and sorted shared ids, so the
    p-values can be compared with published ones.
    """
    from random import Random

    import numpy as np

    ids = sorted(set(a) & set(b))
    if not ids:
        return dict.fromkeys(("p_value",), 1.0) | {"n": 0, "diff": 0.0}
    d = np.array([b[q] - a[q] for q in ids])
    observed = float(sum(d.tolist()) / len(d))
    draw, extreme = Random(seed).random, 0
    for _ in range(n_samples):
        signs = np.array([draw() for _ in d]) < 0.5
        s = float(np.where(signs, d, -d).sum())
        extreme += abs(s / len(d)) >= abs(observed) - 1e-12
    means = {f"mean_{name}": sum(map(m.__getitem__, ids)) / len(ids) for name, m in (("a", a), ("b", b))}
    return means | dict(n=len(ids), n_samples=n_samples, diff=observed, p_value=(extreme + 1) / (n_samples + 1))


def randomization_test_distributed(a: DataFrame, b: DataFrame, n_samples: int = 10_000, seed: int = 42) -> DataFrame:
    """One row n, diff, p_value for (qid, value) tables of any size.

    Signs are hash bits of (sample, qid): each task adds its pairs' signed differences into one
    vector of ``n_samples`` sums, and only these vectors are combined.
    """
    import numpy as np
    import pandas as pd

    pairs = a.select("qid", F.col("value").alias("va")).join(b.select("qid", F.col("value").alias("vb")), "qid")
    pairs = pairs.select(F.xxhash64("qid", F.lit(seed)).alias("h"), (F.col("vb") - F.col("va")).alias("d"))

    def run(batches):
        total, n, plain = np.zeros(n_samples), 0, 0.0
        words = -(-n_samples // 64)
        step = np.arange(1, words + 1, dtype="uint64") * np.uint64(0x9E3779B97F4A7C15)
        for g in batches:
            for h, d in zip(g["h"].to_numpy("int64").view("uint64"), g["d"], strict=True):
                x = step + h
                x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                bits = np.unpackbits((x ^ (x >> np.uint64(31))).view("uint8"))[:n_samples]
                total += np.where(bits, d, -d)
                n += 1
                plain += d
        yield pd.DataFrame({"i": np.arange(-2, n_samples), "s": np.concatenate(([n, plain], total))})

    sums = pairs.mapInPandas(run, "i long, s double").groupBy("i").agg(F.sum("s").alias("s"))
    flat = sums.agg(F.max(F.when(F.col("i") == -2, F.col("s"))).alias("n"), F.max(F.when(F.col("i") == -1, F.col("s"))).alias("d"))
    j = sums.where("i >= 0").join(F.broadcast(flat))
    hit = F.when(F.abs(F.col("s")) >= F.abs(F.col("d")) - 1e-12 * F.col("n"), F.lit(1)).otherwise(F.lit(0))
    return j.agg(F.max("n").cast("long").alias("n"), F.max(F.col("d") / F.col("n")).alias("diff"), ((F.sum(hit) + 1) / (F.count("*") + 1)).alias("p_value"))


def compare(a: DataFrame, b: DataFrame, metric: str = "recall@5", n_samples: int = 10_000, seed: int = 42) -> dict[str, float]:
    """``randomization_test`` of one metric of two per-query tables (qid, metric, value)."""
    own = lambda d: {r["qid"]: r["value"] for r in d.where(F.col("metric") == metric).collect()}  # noqa: E731  one evaluation's queries
    return randomization_test(own(a), own(b), n_samples, seed)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """metric, n, mean_a, mean_b, diff over the queries that both have."""
    j = a.select("qid", "metric", F.col("value").alias("va")).join(b.select("qid", "metric", F.col("value").alias("vb")), ["qid", "metric"])
    return j.groupBy("metric").agg(F.count("*").alias("n"), F.avg("va").alias("mean_a"), F.avg("vb").alias("mean_b"), F.avg(F.col("vb") - F.col("va")).alias("diff"))


def agreement(a: DataFrame, b: DataFrame, k: int = 10) -> DataFrame:
    """One row: queries, identical lists, equal first places, and the mean overlap at ``k`` of two runs (qid, ranked)."""
    j = a.select("qid", F.slice("ranked", 1, k).alias("x")).join(b.select("qid", F.slice("ranked", 1, k).alias("y")), "qid")
    one = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)))
    share = F.size(F.array_intersect("x", "y")) / F.greatest(F.size("x"), F.size("y"), F.lit(1))
    return j.agg(F.count("*").alias("n"), one(F.col("x") == F.col("y")).alias("identical"), one(F.get("x", F.lit(0)) == F.get("y", F.lit(0))).alias("same_first"), F.avg(share).alias("overlap"))
