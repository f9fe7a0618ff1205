"""LM scoring with a log-bilinear model trained by noise-contrastive estimation.

Tokens are lower-cased (A-Z) words and an end token for each text. Three passes over the
training texts and the whole table, all of them streaming:

1. token counts of all training texts (summed per task, then by word in the JVM);
2. counts of (previous, next) symbol pairs of all training texts. A symbol is one of the most
   common tokens, as many as the square root of the corpus' tokens (``frequent``), or one of
   ``CLASSES`` classes of rarer words by their letters, so a matrix of all pairs has about as
   many cells as the corpus has tokens;
3. scores of all texts.

The pair counts are a sufficient statistic of the contrastive objective with a context of one
token. Nothing is drawn: training takes the counts of all pairs and the expectation over all noise
tokens, of the smoothed unigram distribution. With one side's vectors fixed, each vector of the
other side is a logistic regression of its own, so the executors fit the vectors of previous and
of next symbols by turns, each from one row of counts, and send back only the vectors. The
log-probability of a symbol after a symbol is normalised over all symbols. A rare word's
probability is that of its class times its smoothed share of the class, so the probabilities of
all known words and one unseen word for each class sum to 1.

Counts of the ``HEAD`` most common tokens travel as a table of bounded size; rarer words are
joined by word, counted once for each document first.

Defined cases: null text is empty, and an empty text is the end token alone; a null doc_id is
not held out; repeated rows are scored one by one; without any training token all
probabilities come from the smoothing alone.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, map_texts, stored, table

FOLDS, HELD_OUT = 5, 1
LEAST, MOST = 1000, math.inf  # common tokens with a vector of their own; no limit above
CLASSES = 25
HEAD = 150_000
END = b""  # no word is empty
DIM, NOISE, STEPS = 24, 10, 10  # places of a vector, noise tokens for a pair, turns of both sides
CELLS = 1_000_000  # of a block of the matrix of pairs
TOKENS = 3_000_000  # whose pairs a task counts at a time
SYMBOL = 0xFFFFFFFF  # the low bits of a code
LN10 = math.log(10)


def tokens(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end token."""
    return [*(text or "").encode("utf-8", "surrogatepass").lower().split(), END]


def word_class(w: bytes) -> int:
    """One of ``CLASSES`` classes, by ASCII or not, length, last sign, and digits."""
    if not w:
        return CLASSES - 1
    if w.isalpha():
        kind = 0
    elif not w.isascii():
        kind = 1 if w[-1] not in b".,;:!?" else 2
    else:
        kind = 3 if w[-1] in b".,;:!?" else 4 if any(48 <= b <= 57 for b in w) else 5
    n = len(w)
    return kind * 4 + (0 if n <= 4 else 1 if n <= 7 else 2 if n <= 10 else 3)


def _held_out() -> Column:
    return doc_bucket("doc_id", FOLDS) == HELD_OUT


def token_counts(docs: DataFrame, limit: int = 300_000) -> DataFrame:
    """(word, n) over all texts of ``docs``; tasks send partial sums of at most ``limit`` words at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[bytes] = Counter()
        for b in batches:
            for t in b["text"]:
                c.update(tokens(t))
                if len(c) > limit:
                    yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                    c.clear()
        if c:
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    return map_texts(docs.select("text"), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The common tokens' counts and the classes' totals; of bounded size, or the square root of the tokens."""

    n: int  # training tokens
    v: int  # distinct training tokens
    head: dict[bytes, int]  # token -> place in counts; the first places are symbols
    counts: np.ndarray
    class_n: np.ndarray  # tokens of the class that are no symbols
    class_v: np.ndarray
    symbols: int  # common tokens with a vector of their own, and classes

    def totals(self) -> np.ndarray:
        """Training tokens of each symbol."""
        return np.concatenate([self.counts[: self.symbols - CLASSES], self.class_n])


def frequent(n: int) -> int:
    """The number of common tokens with a vector of their own, for ``n`` training tokens."""
    return min(max(LEAST, math.isqrt(n)), MOST)


def vocabulary(counts: DataFrame, head: int = HEAD) -> Vocabulary:
    total = counts.agg(F.sum("n"), F.count("*")).first()
    common = frequent(int(total[0] or 0))
    head = max(head, 2 * common)  # a step of the histogram may hold many words
    # the least count of the head comes from a histogram on a log scale, so that no task sends its own top
    steps = counts.groupBy(F.floor(F.log("n") * 32).alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect()
    least, held = 1 << 62, 0
    for r in steps:  # about a thousand rows
        if (held := held + r["words"]) > head:
            break
        least = r["step"]
    top = counts.where(F.floor(F.log("n") * 32) >= least).collect()  # at most ``head`` rows
    top.sort(key=lambda r: (-r["n"], bytes(r["word"])))
    words = [bytes(r["word"]) for r in top]
    freq = set(words[:common])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, v = np.zeros(CLASSES, "int64"), np.zeros(CLASSES, "int64")
        for b in batches:
            for w, k in zip(b["word"], b["n"], strict=True):
                if (w := bytes(w)) not in freq:
                    c = word_class(w)
                    n[c] += k
                    v[c] += 1
        yield pd.DataFrame({"c": range(CLASSES), "n": n, "v": v})

    by_class = counts.mapInPandas(run, "c int, n long, v long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    n, v = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by_class:
        n[r["c"]], v[r["c"]] = r["n"], r["v"]
    return Vocabulary(int(total[0] or 0), int(total[1]), {w: i for i, w in enumerate(words)}, np.array([r["n"] for r in top], "int64"), n, v, len(freq) + CLASSES)


class _Lookup:
    """Symbol and place of words, with the classes of the head's words computed once."""

    def __init__(self, vocab: Vocabulary):
        self.frequent = vocab.symbols - CLASSES
        self.codes = {w: (i << 32) | (i if i < self.frequent else self.frequent + word_class(w)) for w, i in vocab.head.items()}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        """place << 32 | symbol; a word out of the head has place -1."""
        get, f = self.codes.get, self.frequent
        return np.array([c if (c := get(w)) is not None else (-1 << 32) | (f + word_class(w)) for w in words], "int64")


_LOOKUPS: dict[str, _Lookup] = {}


def _lookup(key: str, shared) -> _Lookup:
    if key not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[key] = _Lookup(shared.value)
    return _LOOKUPS[key]


def pair_counts(docs: DataFrame, shared, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """The counts of all pairs over all texts, a row for each previous and for each next symbol.

    A row holds count * size + other symbol for all others. A text begins after an end.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _lookup(key, shared)
        end = look([END])[0] & SYMBOL
        held: list[np.ndarray] = []
        size_held = 0

        def flush() -> Iterator[pd.DataFrame]:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(pair), 200_000):
                at = pair[i : i + 200_000]
                yield pd.DataFrame({"prev": at // size, "next": at % size, "n": n[i : i + 200_000]})

        for b in batches:
            for t in b["text"]:
                s = look(tokens(t)) & SYMBOL
                held.append(np.concatenate(([end], s[:-1])) * size + s)
                size_held += len(s)
                if size_held > TOKENS:
                    yield from flush()
                    held, size_held = [], 0
        if held:
            yield from flush()

    parts = max(docs.sparkSession.sparkContext.defaultParallelism, size // 250)
    rows = map_texts(docs.select("text"), run, "prev int, next int, n long")
    rows = rows.groupBy("prev", "next").agg(F.sum("n").alias("n")).repartition(parts, "prev")  # summed first: at most ``size`` rows a symbol
    packed = lambda other: F.collect_list(F.col("n") * size + F.col(other)).alias("packed")
    by_prev = stored(rows.groupBy(F.col("prev").alias("symbol")).agg(packed("next")), "lm-prev")
    rows = by_prev.select(F.col("symbol").alias("prev"), F.explode("packed").alias("p"))
    rows = rows.select("prev", (F.col("p") % size).cast("int").alias("next"), F.expr(f"p div {size}").alias("n")).repartition(parts, "next")
    return by_prev, stored(rows.groupBy(F.col("next").alias("symbol")).agg(packed("prev")), "lm-next")


@dataclass
class Model:
    """ln P(next | previous) as a product of two matrices, ``left`` of previous and ``right`` of next symbols."""

    left: np.ndarray
    right: np.ndarray

    def __getitem__(self, at: tuple) -> np.ndarray:
        prev, nxt = at
        return (self.left[prev] * self.right[nxt]).sum(-1)

    def __array__(self, dtype=None, copy=None) -> np.ndarray:
        return np.asarray(self.left @ self.right.T, dtype)

    def astype(self, dtype) -> np.ndarray:
        return np.asarray(self, dtype)

    def total(self, prev: np.ndarray, nxt: np.ndarray) -> float:
        """The sum over pairs, 50,000 at a time."""
        return sum(float(self[prev[i : i + 50_000], nxt[i : i + 50_000]].sum(dtype=float)) for i in range(0, len(prev), 50_000))


@dataclass
class _Side:
    """What a fit of one side's vectors needs, apart from the counts."""

    vectors: np.ndarray  # of this side
    prior: np.ndarray
    fixed: np.ndarray  # of the other side
    own: np.ndarray  # noise tokens of a pair are own * others
    others: np.ndarray
    shift: np.ndarray  # added to the products, by symbol of this side
    shift_others: np.ndarray


def _fit(batches: Iterator[pd.DataFrame], side: _Side) -> Iterator[pd.DataFrame]:
    """A Newton step of the penalised logistic regression of each symbol of ``batches`` against all others."""
    size, d = side.fixed.shape
    up = np.triu_indices(d)
    outer = side.fixed[:, up[0]] * side.fixed[:, up[1]]
    rows = max(1, CELLS // size)
    for b in batches:
        for k in range(0, len(b), rows):
            at = b["symbol"].to_numpy()[k : k + rows]
            n = np.zeros((len(at), size), "float32")
            for i, p in enumerate(b["packed"].iloc[k : k + rows]):
                n[i, p % size] = p // size
            v = side.vectors[at]
            x = v.astype("float32") @ side.fixed.T + side.shift[at, None] + side.shift_others
            p = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
            w = (n + side.own[at, None] * side.others) * p
            slope = ((n - w) @ side.fixed).astype(float) - (v - side.prior[at])
            h = np.empty((len(at), d, d))
            h[:, up[0], up[1]] = h[:, up[1], up[0]] = (w * (1 - p)) @ outer
            h[:, range(d), range(d)] += 1
            step = np.linalg.solve(h, slope[:, :, None])[:, :, 0]
            step *= np.minimum(1, 2 / np.maximum(np.linalg.norm(step, axis=1, keepdims=True), 1e-9))
            yield pd.DataFrame({"symbol": at, "vector": list(v + step)})


def _turn(counts: DataFrame | pd.DataFrame, side: _Side) -> np.ndarray:
    """The side's vectors after a step; symbols without a pair keep theirs."""
    if isinstance(counts, pd.DataFrame):
        done = pd.concat(_fit(iter([counts]), side))
        at, new = done["symbol"].to_numpy(), np.stack(done["vector"])
    else:
        shared = counts.sparkSession.sparkContext.broadcast(side)
        table = counts.mapInPandas(lambda batches: _fit(batches, shared.value), "symbol int, vector array<double>").toArrow()
        at, new = table["symbol"].to_numpy(), table["vector"].combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        shared.destroy()
    out = side.vectors.copy()
    out[at] = new
    return out


def _rows(symbol: np.ndarray, other: np.ndarray, n: np.ndarray, size: int) -> pd.DataFrame:
    order = np.argsort(symbol, kind="stable")
    places, first = np.unique(symbol[order], return_index=True)
    return pd.DataFrame({"symbol": places, "packed": np.split((n * size + other)[order], first[1:])[: len(places)]})


def train(prev, nxt, n: np.ndarray, size: int, dim: int = DIM, noise: int = NOISE, steps: int = STEPS, seed: int = 5) -> Model:
    """ln P(next | previous) of a log-bilinear model q_prev . r_next + b_next, fitted by NCE on all pairs.

    The pairs and their counts are arrays, or ``prev`` and ``nxt`` are the tables of ``pair_counts``
    and ``n`` the tokens of each symbol. Each of ``steps`` turns fits all r and b, then all q.
    """
    before = after = n
    if isinstance(prev, np.ndarray):
        before, after = np.bincount(prev, n, size), np.bincount(nxt, n, size)
        prev, nxt = _rows(prev, nxt, n, size), _rows(nxt, prev, n, size)
    rng = np.random.default_rng(seed)
    uni = after + 0.5
    uni /= uni.sum()
    log_noise = np.log(noise * uni)
    q = rng.normal(0, 0.1, (size, dim)) * (before > 0)[:, None]
    first = np.concatenate([np.zeros((size, dim)), np.log(uni)[:, None]], 1)
    r, one, none = first, np.ones((size, 1)), np.zeros(size)
    small = lambda *arrays: [a.astype("float32") for a in arrays]
    for _ in range(steps if before.sum() else 0):
        r = _turn(nxt, _Side(r, first, *small(np.concatenate([q, one], 1), noise * uni, before, -log_noise, none)))
        q = _turn(prev, _Side(q, np.zeros_like(q), *small(r[:, :dim], noise * before, uni, none, r[:, dim] - log_noise)))
    norm = np.empty((size, 1))
    rows = max(1, CELLS // size)
    for i in range(0, size, rows):  # batched products, normalised by row
        s = q[i : i + rows] @ r[:, :dim].T + r[:, dim]
        top = s.max(1, keepdims=True)
        norm[i : i + rows] = top + np.log(np.exp(s - top).sum(1, keepdims=True))
    return Model(*small(np.concatenate([q, one, -norm], 1), np.concatenate([r, one], 1)))


def score(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    train_docs = docs.where(~_held_out())
    counts = stored(token_counts(train_docs), "token-counts")
    vocab = vocabulary(counts, head)
    size = vocab.symbols
    key = uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(vocab)  # at most ``head`` tokens, or twice the symbols
    model = spark.sparkContext.broadcast(train(*pair_counts(train_docs, shared, key, size), vocab.totals(), size))  # two vectors a symbol
    n, v = vocab.n, vocab.v
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        look = _lookup(key, shared)
        voc, logp = shared.value, model.value
        f = look.frequent
        base = np.log10((voc.counts + 0.5) / (n + 0.5 * (v + 1)))
        within = -np.log10(voc.class_n + 0.5 * (voc.class_v + 1))
        own = np.zeros(len(voc.counts))  # log10 share within the class, 0 for symbols
        for w, i in voc.head.items():
            if i >= f:
                own[i] = math.log10(voc.counts[i] + 0.5) + within[word_class(w)]
        end = look([END])[0] & SYMBOL
        for b in batches:
            out = []
            for uid, doc, held, text in zip(b["uid"], b["doc_id"], b["held_out"], b["text"], strict=True):
                words = tokens(text)
                code = look(words)
                sym, place = code & SYMBOL, code >> 32
                lm = logp.total(np.concatenate(([end], sym[:-1])), sym) / LN10
                known = place >= 0
                at = place[known]
                rest = Counter(words[i] for i in np.flatnonzero(~known)) if not known.all() else {}
                lm += float(own[at].sum()) + sum(k * within[word_class(w)] for w, k in rest.items())
                out.append((uid, doc, held, len(words), len(at), float(base[at].sum()), lm, list(rest), list(rest.values())))
            yield pd.DataFrame(out, columns=["uid", "doc_id", "held_out", "n_tokens", "n_head", "head_base", "head_lm", "rest", "rest_n"])

    schema = f"uid long, doc_id {id_type}, held_out boolean, n_tokens long, n_head long, head_base double, head_lm double, rest array<binary>, rest_n array<long>"
    d = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", _held_out().alias("held_out"), "text")
    parts = stored(map_texts(d, run, schema), "lm-parts")
    rare = parts.select("uid", F.explode(F.arrays_zip("rest", "rest_n")).alias("r")).select("uid", F.col("r.rest").alias("word"), F.col("r.rest_n").alias("k"))
    rare = rare.join(counts.select("word", F.col("n").alias("c")), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    floor = math.log10(n + 0.5 * (v + 1))
    share = F.log10(F.col("c") + 0.5)
    rare = rare.groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("rare_known"), F.sum(F.col("k") * share).alias("rare_log"), F.sum("k").alias("rare_n")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    j = parts.drop("rest", "rest_n").join(rare, "uid", "left")
    return j.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + zero(F.col("rare_known"))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("head_base") + zero(F.col("rare_log")) - zero(F.col("rare_n")) * F.lit(floor)).alias("base_score"),
        (F.col("head_lm") + zero(F.col("rare_log"))).alias("score"),
    )


def op10_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
