"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The score of a
word sums the products of its pieces' probabilities over all ways to cut it into pieces of the
vocabulary (the forward algorithm); a text's score is the product over its words, so words
are scored once for each batch of texts and kept in a bounded cache. Piece probabilities are
fitted by expectation-maximisation over all segmentations of the training words.

Training reads a sample of about ``MAX_DOCS`` labelled documents of each language, of all
languages (drawn by a hash of the id); words of more than ``TRAIN_LEN`` signs are learned in
parts of that length. Every text is scored whole.

Defined cases: null text, or text without a letter, gives ``und`` with score 0; a null lang is
never learned from; a null doc_id is not held out; repeated rows are scored one by one; a very
long word, such as a text without spaces, is cut into blocks whose sums are joined exactly; with
no labelled document, or an empty table, every text is ``und``; further columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, map_texts, table

FOLDS, HELD_OUT = 3, 1
MAX_DOCS, TRAIN_LEN, ROUNDS = 800, 24, 3
PIECE_LEN = 17  # the longest piece of the default vocabulary, with the word-begin sign
LONG, BLOCK = 2000, 512  # signs of a word that is taken in blocks
CACHE = 300_000
_BASE = np.uint64(1_099_511_628_211)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def words(text: str) -> list[str]:
    return text.lower().split()


class Pieces:
    """The vocabulary's pieces by a rolling hash of their characters; single unknown signs share one more id."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        texts = sorted({p for p in every if p})
        if len(max(texts, key=len)) > PIECE_LEN:
            raise ValueError(f"a piece of {path} is longer than {PIECE_LEN} signs")
        self.n = len(texts)  # id n: an unknown sign; n + 1: no piece
        self.hashes, self.ids = np.array([self.hash(p) for p in texts], "uint64"), np.arange(self.n, dtype="int32")
        self.tables = _place(self.hashes, self.ids)

    @staticmethod
    def hash(p: str) -> np.uint64:
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in p:
                h = h * _BASE + np.uint64(ord(c) + 1)
        return h

    def hits(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, ids) of the hashes that are pieces, from one table after the other."""
        for mult, keys, ids in self.tables:
            slot = (h * mult) >> _SHIFT
            at = np.flatnonzero(keys[slot] == h)
            yield at, ids[slot[at]]

    def find(self, h: np.ndarray, length: int) -> np.ndarray:
        """The id of each hash."""
        out = np.full(len(h), self.n if length == 1 else self.n + 1, "int32")
        for at, ids in self.hits(h):
            out[at] = ids
        return out


_SLOT_BITS = 19
_SHIFT = np.uint64(64 - _SLOT_BITS)


def _place(hashes: np.ndarray, ids: np.ndarray) -> list[tuple[np.uint64, np.ndarray, np.ndarray]]:
    """Hash tables without chains: what finds its slot taken goes to a further table."""
    out, mult = [], 0x9E3779B97F4A7C15
    while len(hashes):
        slot = (hashes * np.uint64(mult)) >> _SHIFT
        _, first = np.unique(slot, return_index=True)
        # a free slot holds a hash that belongs to another slot, so that nothing matches there
        keys, own = np.full(1 << _SLOT_BITS, np.uint64(0)), np.zeros(1 << _SLOT_BITS, "int32")
        keys[0] = np.uint64(0xFFFFFFFFFFFFFFFF)
        keys[slot[first]], own[slot[first]] = hashes[first], ids[first]
        out.append((np.uint64(mult), keys, own))
        rest = np.ones(len(hashes), bool)
        rest[first] = False
        hashes, ids = hashes[rest], ids[rest]
        mult = (mult * 0xD1342543DE82EF95 + 2) | 1
        mult &= 0xFFFFFFFFFFFFFFFF
    return out


def _prefix(batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of the words (with the word-begin sign), and their lengths."""
    marked = ["▁" + w for w in batch]
    size = np.array([len(w) for w in marked])
    codes = np.array(marked, f"U{size.max()}").view("uint32").reshape(len(batch), -1).astype("uint64")
    h = np.zeros((len(batch), codes.shape[1] + 1), "uint64")
    for i in range(codes.shape[1]):
        h[:, i + 1] = h[:, i] * _BASE + codes[:, i] + np.uint64(1)
    return h, size


_POW = np.ones(PIECE_LEN + 1, "uint64")
for _k in range(1, PIECE_LEN + 1):
    _POW[_k] = (int(_POW[_k - 1]) * int(_BASE)) & 0xFFFFFFFFFFFFFFFF


@dataclass
class Model:
    langs: list[str]
    probs: np.ndarray  # (pieces + 2) x languages; the last row is 0
    path: str


def forward(pieces: Pieces, probs: np.ndarray, batch: list[str]) -> np.ndarray:
    """ln of the words' probabilities, a row for each word and a column for each language."""
    out = np.empty((len(batch), probs.shape[1]))
    order = sorted(range(len(batch)), key=lambda i: len(batch[i]))
    at = 0
    while at < len(order):
        if len(batch[order[at]]) > LONG:
            out[order[at]] = _forward_long(pieces, probs, batch[order[at]])
            at += 1
            continue
        longest = len(batch[order[at]]) * 5 // 4 + 2  # words of similar length together, about 1M signs at once
        end = at + 1
        while end < len(order) and len(batch[order[end]]) <= min(longest, LONG) and (end - at) * len(batch[order[end]]) < 1_000_000:
            end += 1
        own = order[at:end]
        out[own] = _forward(pieces, probs, [batch[i] for i in own])
        at = end
    return out


def _forward(pieces: Pieces, probs: np.ndarray, batch: list[str]) -> np.ndarray:
    h, size = _prefix(batch)
    n, g = len(batch), probs.shape[1]
    window = np.zeros((PIECE_LEN, n, g))  # the sums at the last PIECE_LEN places, by place modulo PIECE_LEN
    window[0] = 1
    shift = np.zeros((n, g))
    out = np.zeros((n, g))
    known = np.zeros(n, bool)
    for i in range(1, h.shape[1]):
        new = np.zeros((n, g))
        for k in range(1, min(PIECE_LEN, i) + 1):
            before = window[(i - k) % PIECE_LEN]
            seen = 0
            for rows, ids in pieces.hits(h[:, i] - h[:, i - k] * _POW[k]):
                new[rows] += before[rows] * probs[ids]
                seen += len(rows)
                if k == 1:
                    known[rows] = True
            if k == 1 and seen < n:
                new[~known] += before[~known] * probs[pieces.n]
            if k == 1:
                known[:] = False
        window[i % PIECE_LEN] = new
        ends = size == i
        if ends.any():
            out[ends] = np.log(np.maximum(new[ends], 1e-300)) + shift[ends]
        if i % 8 == 0:  # keep the numbers in range
            top = np.maximum(window.max(0), 1e-300)
            window /= top
            shift += np.log(top)
    return out


def _transfer(ids: np.ndarray, probs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each block the linear map from the sums at the PIECE_LEN places up to its start to those up to
    its end, for each language, and ln of what it is scaled by. ``ids``: length of piece x block x place."""
    n, size, g = ids.shape[1], ids.shape[2], probs.shape[1]
    w = np.zeros((PIECE_LEN, n, PIECE_LEN, g))  # by place modulo PIECE_LEN, block, start
    for j in range(PIECE_LEN):
        w[-j % PIECE_LEN, :, j] = 1
    shift = np.zeros((n, g))
    for t in range(1, size + 1):
        new = np.zeros((n, PIECE_LEN, g))
        for k in range(1, PIECE_LEN + 1):
            p = probs[ids[k - 1, :, t - 1]]
            use = np.flatnonzero(p.any(1))
            if len(use):
                new[use] += w[(t - k) % PIECE_LEN, use] * p[use, None]
        w[t % PIECE_LEN] = new
        if t % 8 == 0 or t == size:
            top = np.maximum(w.max((0, 2)), 1e-300)
            w /= top[None, :, None]
            shift += np.log(top)
    return np.stack([w[(size - o) % PIECE_LEN] for o in range(PIECE_LEN)], 1), shift


def _forward_long(pieces: Pieces, probs: np.ndarray, word: str, chunk: int = 200_000) -> np.ndarray:
    """``forward`` of one long word, with many of its blocks at once."""
    c = np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), "uint32").astype("uint64") + np.uint64(1)
    state, shift = np.zeros((PIECE_LEN, probs.shape[1])), np.zeros(probs.shape[1])
    state[0] = 1
    for lo in range(0, len(c), chunk):
        hi = min(lo + chunk, len(c))
        h, ids = np.zeros(hi - lo, "uint64"), np.empty((PIECE_LEN, hi - lo), "int32")
        for k in range(1, PIECE_LEN + 1):  # the pieces of k signs that end at each place
            miss = min(max(0, k - 1 - lo), hi - lo)
            h[miss:] += c[max(0, lo - k + 1) : hi - k + 1] * _POW[k - 1] if hi - k + 1 > 0 else np.uint64(0)
            ids[k - 1] = pieces.find(h, k)
            ids[k - 1, :miss] = pieces.n + 1
        whole = (hi - lo) // BLOCK * BLOCK
        parts = [ids[:, :whole].reshape(PIECE_LEN, -1, BLOCK)] if whole else []
        parts += [ids[:, None, whole:]] if whole < hi - lo else []
        for part in parts:
            m, more = _transfer(part, probs)
            for b in range(len(m)):
                state = np.einsum("ojg,jg->og", m[b], state)
                top = np.maximum(state.max(0), 1e-300)
                state, shift = state / top, shift + more[b] + np.log(top)
    return np.log(np.maximum(state[0], 1e-300)) + shift


def fit(counts: dict[str, dict[str, int]], path: str, rounds: int = ROUNDS) -> Model:
    """EM over all segmentations of each language's words."""
    pieces = Pieces(path)
    langs = sorted(counts)
    probs = np.zeros((pieces.n + 2, len(langs)))
    for g, lang in enumerate(langs):
        p = np.full(pieces.n + 2, 1.0 / (pieces.n + 1))
        p[-1] = 0
        batch = sorted(counts[lang])
        weight = np.array([counts[lang][w] for w in batch], float)
        tables = []
        for at in range(0, len(batch), 20_000):
            h, size = _prefix(batch[at : at + 20_000])
            ids = np.full((h.shape[1], PIECE_LEN + 1, len(size)), pieces.n + 1, "int32")  # by end and length
            for i in range(1, h.shape[1]):
                for k in range(1, min(PIECE_LEN, i) + 1):
                    ids[i, k] = np.where(i <= size, pieces.find(h[:, i] - h[:, i - k] * _POW[k], k), pieces.n + 1)
            tables.append((ids, size, weight[at : at + 20_000]))
        for _ in range(rounds):
            total = np.zeros(pieces.n + 2)
            for ids, size, w in tables:
                m, n = ids.shape[0], len(size)
                alpha = np.zeros((m, n))
                alpha[0] = 1
                for i in range(1, m):
                    for k in range(1, min(PIECE_LEN, i) + 1):
                        alpha[i] += alpha[i - k] * p[ids[i, k]]
                beta = (np.arange(m)[:, None] == size[None, :]).astype(float)
                z = np.maximum(alpha[size, np.arange(n)], 1e-300)
                for i in range(m - 1, 0, -1):
                    for k in range(1, min(PIECE_LEN, i) + 1):
                        q = p[ids[i, k]] * beta[i]
                        total += np.bincount(ids[i, k], alpha[i - k] * q / z * w, pieces.n + 2)
                        beta[i - k] += q
            total[-1] = 0
            p = (total + 0.05) / (total.sum() + 0.05 * (pieces.n + 1))
            p[-1] = 0
        probs[:, g] = p
    return Model(langs, probs, path)


def train(docs: DataFrame, vocabulary: str | None = None, max_docs: int = MAX_DOCS) -> Model:
    """Fit on about ``max_docs`` documents of each language outside the held-out fold."""
    path = vocabulary or default_vocabulary()
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (doc_bucket("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in own.groupBy("lang").count().collect()}  # languages
    if not sizes:
        return Model([], np.zeros((1, 0)), path)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, max_docs / v)) for k, v in sizes.items()], "lang string, share double")
    sample = own.join(F.broadcast(shares), "lang")  # a row for each language
    sample = sample.where(F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1_000_003)) < F.col("share") * 1_000_003)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c: Counter[tuple[str, str]] = Counter()
        for b in batches:
            for lang, t in zip(b["lang"], b["text"], strict=True):
                c.update((lang, w[i : i + TRAIN_LEN]) for w in words(t) for i in range(0, len(w), TRAIN_LEN))
        yield pd.DataFrame([(a, w, n) for (a, w), n in c.items()], columns=["lang", "word", "n"])

    rows = map_texts(sample.select("lang", "text"), run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in rows.toPandas().itertuples(index=False):  # words of the sample
        counts.setdefault(lang, {})[word] = n
    return fit(counts, path) if counts else Model([], np.zeros((1, 0)), path)


class Scorer:
    def __init__(self, model: Model):
        self.pieces, self.model = Pieces(model.path), model
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, len(model.langs)))

    def learn(self, new: list[str]) -> None:
        if len(self.known) + len(new) > CACHE:
            self.known.clear()
        at = len(self.known)
        while at + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[at : at + len(new)] = forward(self.pieces, self.model.probs, new)
        self.known.update(zip(new, range(at, at + len(new)), strict=True))

    def score(self, texts: list[str]) -> np.ndarray:
        """ln probabilities of whole texts, taken together in groups of about a million signs."""
        out = np.zeros((len(texts), len(self.model.langs)))
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (size == 0 or size + len(texts[end]) < 1_000_000):
                size += len(texts[end])
                end += 1
            parts = [words(t) for t in texts[at:end]]
            found = [list(map(self.known.get, p)) for p in parts]
            new = {w for p, f in zip(parts, found, strict=True) if None in f for w, i in zip(p, f, strict=True) if i is None}
            if new:
                if len(self.known) + len(new) > CACHE:
                    self.known.clear()
                    new = {w for p in parts for w in p}
                    found = [[None]] * len(parts)
                self.learn(list(new))
                found = [list(map(self.known.get, p)) if None in f else f for p, f in zip(parts, found, strict=True)]
            for i, f in enumerate(found):
                out[at + i] = self.rows[np.array(f, "int64")].sum(0) if f else 0
            at = end
        return out


_SCORERS: dict[str, Scorer] = {}


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred and score (the probability of lang_pred) of every row."""
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex  # vocabulary x languages numbers
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        s = _SCORERS[key]
        langs = s.model.langs
        for b in batches:
            texts = [t or "" for t in b["text"]]
            pred, conf = ["und"] * len(b), [0.0] * len(b)
            use = [i for i, t in enumerate(texts) if langs and any(map(str.isalpha, t))]
            for i, row in zip(use, s.score([texts[i] for i in use]), strict=True):
                row = np.exp(row - row.max())
                k = int(row.argmax())
                pred[i], conf[i] = langs[k], float(row[k] / row.sum())
            yield pd.DataFrame({"doc_id": b["doc_id"], "held_out": b["held_out"], "lang_pred": pred, "score": conf})

    d = docs.select("doc_id", (doc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return map_texts(d, run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
