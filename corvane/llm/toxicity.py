"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities of a lexicon, the nearness of second-person words to its words, and
rates of capitals, punctuation and disguised words. The lexicon is learned, in whatever
languages the labels are: the log-odds of a word in toxic against other labelled texts,
smoothed and lowered by its standard error. It starts from a fixed list of insults, which
count as if they had been seen. A word's counts are of groups of like texts, so that a
passage or a text with many copies makes no lexicon of its words.

Trees are fitted in numpy on a sample of at most about ``MAX_LABELLED`` labelled documents
(drawn by a hash of the id). A sampled text's features come from a lexicon learned without
its own part of the sample, and the calibration uses predictions for documents that the trees
have not seen. Every text is scored whole, a batch at a time.

Defined cases: null text is empty, and an empty text has a score like any other; a very long
text is read whole, at a cost in proportion to its length; rows with a null label or id are
not learned from; repeated label rows of a document count once, the larger label; repeated
rows are scored one by one; a null doc_id is not held out; with fewer than two classes of
labels, or an empty table of either kind, the score is their mean (0 without labels) and an
empty table of documents gives an empty result; further columns, whatever their names, are
left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, map_texts, small_batches, stored, table

FOLDS, HELD_OUT = 5, 0
MAX_LABELLED = 20_000

INSULTS = frozenset(
    "idiot idiots moron morons stupid clown clowns loser losers pathetic worthless disgusting trash scum dumb dumbass fool fools "
    "imbecile imbeciles jerk jerks garbage filth filthy vermin parasite parasites coward cowards liar liars freak freaks creep "
    "ugly disgrace bastard bastards pig pigs rat rats dimwit halfwit lowlife sleazy crap shit bullshit fuck fucking fucker asshole "
    "bitch bitches whore slut retard retarded nazi subhuman degenerate ignorant brainless spineless useless sucks hate despise "
    "dumm dummkopf idioten trottel arschloch abschaum drecksack vollidiot versager widerlich schwachkopf hurensohn scheisse scheiße "
    "débile débiles crétin crétins imbécile imbéciles connard connards ordure ordures salaud abruti abrutis minable pourriture merde "
    "estúpido estúpida estúpidos tonto tontos basura imbécil imbéciles asqueroso asquerosa escoria inútil inútiles cabrón mierda payaso payasos".split()
)
SEVERE = frozenset(
    "kill die hang murder rape subhuman vermin scum fuck fucking fucker asshole bitch whore slut retard arschloch hurensohn connard salaud cabrón".split()
)
SECOND = frozenset("you your yours yourself youre u ur du dich dir dein deine ihr euch tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
_CLEAN = {i: " " for i in range(128) if not chr(i).isalnum()} | {ord(c): " " for c in "«»¡¿…–—“”„’‘"}
#: Starts are few and repeats possessive or bounded, so that no text costs more than its length.
_DISGUISED = re.compile(
    r"(?<![^\W_])(?:[0-9@$!]?[^\W\d_]++(?:[0-9@$!*_]++[^\W\d_]++)+|[0-9@$!][^\W\d_]{3,20}(?![^\W\d_]))|(?<!\b[^\W\d_][.\-_* ])\b(?:[^\W\d_][.\-_* ]){3,40}[^\W\d_]\b"
)
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
_DROP = str.maketrans("", "", ".-_* ")
FEATURES = (
    "n_hits hits_density distinct_hits max_in_20 weight_sum weight_max weight_density severe_density second_density near_second caps_rate caps_words "
    "exclaim_rate question_rate punct_rate disguised_rate disguised_hits log_words"
).split()
NEAR, CROWD = 5, 20
PARTS = 4  # of the sample, for lexicons that have not seen a text
#: A lexicon word is in this many groups of toxic texts, and its lowered log-odds are at least this.
MIN_GROUPS, MIN_ODDS = 3, 0.7
LEXICON = 50_000  # words


@dataclass(frozen=True)
class Lexicon:
    """Weights of words, and its words by their forms with one inner letter blotted out."""

    weights: dict[str, float]
    blotted: dict[str, str]

    @staticmethod
    def of(learned: dict[str, float]) -> Lexicon:
        w = dict.fromkeys(INSULTS, 2.0) | learned
        return Lexicon(w, {x[:i] + "*" + x[i + 1 :]: x for x in w if len(x) > 3 for i in range(1, len(x) - 1)})


def words(text: str | None) -> list[str]:
    return (text or "").lower().translate(_CLEAN).split()


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    low = text.lower()
    w = low.translate(_CLEAN).split()
    n = max(1, len(w))
    weights = lexicon.weights
    hits = [i for i, x in enumerate(w) if x in weights]
    disguised, hidden, found = 0, 0, set()
    for m in _DISGUISED.findall(low):
        disguised += 1
        forms = (m.translate(_LEET).translate(_DROP), m.translate(_DROP), lexicon.blotted.get(m.replace("_", "*"), ""))
        if word := next((x for x in forms if x in weights), None):
            hidden += 1
            found.add(word)
    second = sum(x in SECOND for x in w)
    near = sum(any(x in SECOND for x in w[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    crowd = low_end = 0
    for a, i in enumerate(hits):
        while hits[low_end] <= i - CROWD:
            low_end += 1
        crowd = max(crowd, a - low_end + 1)
    own = {w[i] for i in hits}
    found = [weights[x] for x in own | found]
    letters = max(1, len(text) - len(w))
    caps = sum(map(text.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    marks, asks = text.count("!"), text.count("?")
    others = sum(map(text.count, "#*$%&|<>.,;:"))
    return [
        len(hits),
        100 * len(hits) / n,
        len(own),
        crowd,
        sum(found),
        max(found, default=0.0),
        100 * sum(weights[w[i]] for i in hits) / n,
        100 * sum(w[i] in SEVERE for i in hits) / n,
        100 * second / n,
        near,
        caps / letters,
        caps / n,
        marks / n,
        asks / n,
        others / n,
        100 * disguised / n,
        hidden,
        float(np.log1p(len(w))),
    ]


@dataclass
class Trees:
    """Boosted trees of fixed depth over binned features: arrays by tree and node."""

    edges: list[np.ndarray]
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        depth = int(np.log2(self.leaf.shape[1]))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            out += leaf[node - (len(leaf) - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 32, lam: float = 2.0) -> Trees:
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    extra = [np.unique(col[col > 0]) for col in x.T]  # rare positive values get bins of their own
    edges = [np.unique(np.concatenate([[0.0], e, np.quantile(v, np.linspace(0, 1, 9)[:-1]) - 1e-9])) if len(v) else e for e, v in zip(edges, extra, strict=True)]
    binned = np.stack([np.searchsorted(e, col, "left") for e, col in zip(edges, x.T, strict=True)], 1)
    width = max(len(e) for e in edges) + 1
    p = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    score = np.full(len(y), np.log(p / (1 - p)))
    out = Trees(edges, np.zeros((rounds, 2**depth - 1), int), np.full((rounds, 2**depth - 1), np.inf), np.zeros((rounds, 2**depth)), float(score[0]))
    nf = x.shape[1]
    for t in range(rounds):
        q = 1 / (1 + np.exp(-score))
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(y), int)
        for level in range(depth):
            for own in range(2**level - 1, 2 ** (level + 1) - 1):
                at = np.flatnonzero(node == own)
                if len(at) < 20:
                    continue
                code = (binned[at] + np.arange(nf) * width).ravel()
                gs = np.bincount(code, np.repeat(g[at], nf), nf * width).reshape(nf, width).cumsum(1)
                hs = np.bincount(code, np.repeat(h[at], nf), nf * width).reshape(nf, width).cumsum(1)
                gt, ht = g[at].sum(), h[at].sum()
                gain = gs**2 / (hs + lam) + (gt - gs) ** 2 / (ht - hs + lam) - gt**2 / (ht + lam)
                gain[(hs < 0.3) | (ht - hs < 0.3)] = -1
                for f in range(nf):
                    gain[f, len(edges[f]) :] = -1
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-6:
                    out.feature[t, own], out.cut[t, own] = f, edges[f][b]
            f, c = out.feature[t][node], out.cut[t][node]
            node = 2 * node + 1 + (x[np.arange(len(y)), f] > c)
        leaf = node - (2**depth - 1)
        gs, hs = np.bincount(leaf, g, 2**depth), np.bincount(leaf, h, 2**depth)
        out.leaf[t] = rate * gs / (hs + lam)
        score += out.leaf[t][leaf]
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots of the non-decreasing fit of y on x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum, count, lowest x, highest x
    for a, b in zip(x[order], y[order], strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    return np.array([v for s, n, lo, hi in blocks for v in (lo, hi)]), np.array([s / n for s, n, _, _ in blocks for _ in (0, 1)])


@dataclass
class Model:
    trees: Trees | None
    knots: tuple[np.ndarray, np.ndarray] | None
    mean: float
    lexicon: Lexicon = Lexicon({}, {})

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.mean)
        raw = self.trees.raw(x)
        flat = np.interp(raw, *self.knots)
        # the calibrated value, with the trees' order kept inside its flat parts
        return np.clip(flat + 1e-3 * (1 / (1 + np.exp(-raw)) - 0.5), 0, 1)

    def score_texts(self, texts) -> np.ndarray:
        return self.score(np.array([features(t, self.lexicon) for t in texts], float).reshape(-1, len(FEATURES)))


def fit(x: np.ndarray, y: np.ndarray, folds: int = 3, part: np.ndarray | None = None, lexicon: Lexicon = Lexicon({}, {})) -> Model:
    if len(y) == 0 or y.min() == y.max():
        return Model(None, None, float(y.mean()) if len(y) else 0.0, lexicon)
    part = np.arange(len(y)) % folds if part is None else part
    raw = np.zeros(len(y))
    for k in np.unique(part):
        rest = part != k
        if rest.any():
            raw[~rest] = boost(x[rest], y[rest]).raw(x[~rest])
    return Model(boost(x, y), isotonic(raw, y), float(y.mean()), lexicon)


def _group(w: list[str]) -> int:
    """A number that like texts most often share: the least hash of three words in a row."""
    import xxhash

    return min((xxhash.xxh3_64_intdigest(" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))), default=0) >> 1


def learn_lexicon(rows: DataFrame) -> list[Lexicon]:
    """From ``rows`` (text, toxic): for each part of the groups a lexicon without it, and one of all last."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 50):
                out = []
                for t, y in zip(b["text"].iloc[at : at + 50], b["toxic"].iloc[at : at + 50], strict=True):
                    w = words(t)
                    g = _group(w)
                    out += [(x, g, int(y)) for x in {"", *w}]  # the empty word counts the groups
                yield pd.DataFrame(out, columns=["word", "grp", "toxic"])

    # a group is toxic if one of its texts is
    seen = map_texts(rows.select("text", "toxic"), run, "word string, grp long, toxic int")
    seen = seen.groupBy("word", "grp").agg(F.max("toxic").alias("toxic"))
    sums = [F.sum(F.when(F.pmod("grp", F.lit(PARTS)) == p, F.when(F.col("toxic") == y, 1)).otherwise(0)).alias(f"n{y}{p}") for y in (0, 1) for p in range(PARTS)]
    n = seen.groupBy("word").agg(*[F.coalesce(s, F.lit(0)).alias(f"c{i}") for i, s in enumerate(sums)])
    bad = sum((F.col(f"c{PARTS + p}") for p in range(PARTS)), F.lit(0))
    # a word that is no more common in toxic texts than in others is in no lexicon
    frame = n.where((bad >= MIN_GROUPS) | (F.col("word") == "")).orderBy(F.col("word") != "", F.desc(bad / sum((F.col(f"c{i}") for i in range(2 * PARTS)), F.lit(0))), F.desc(bad), "word").limit(LEXICON).toPandas()
    if not len(frame):
        return [Lexicon.of({})] * (PARTS + 1)
    c = frame[[f"c{i}" for i in range(2 * PARTS)]].to_numpy(float).reshape(-1, 2, PARTS)
    total = c[frame["word"].to_numpy() == ""][0]
    out = []
    for p in range(PARTS + 1):
        use = [k for k in range(PARTS) if k != p]
        clean, toxic = c[:, 0, use].sum(1), c[:, 1, use].sum(1)
        n_clean, n_toxic = total[0, use].sum(), total[1, use].sum()
        a, b = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
        odds = np.log(a / b) - np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
        keep = (toxic >= MIN_GROUPS) & (odds >= MIN_ODDS)
        out.append(Lexicon.of({w: float(o) for w, o, k in zip(frame["word"], odds, keep, strict=True) if k and w}))
    return out


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on labelled documents outside the held-out fold, about ``max_labelled`` at most."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (doc_bucket("doc_id", FOLDS) != HELD_OUT))
    own = own.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = own.count()
    if n > max_labelled:
        own = own.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < int(1_000_003 * max_labelled / n))
    # about max_labelled ids and flags, and as many texts
    d = stored(docs.select("doc_id", "text").join(F.broadcast(own), "doc_id"), "labelled")
    lexicons = learn_lexicon(d)
    shared = docs.sparkSession.sparkContext.broadcast(lexicons)  # LEXICON words at most

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            part = [_group(words(t)) % PARTS for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "part": part, "x": [features(t, shared.value[p]) for t, p in zip(b["text"], part, strict=True)]})

    rows = map_texts(d, run, f"doc_id {dict(docs.dtypes)['doc_id']}, toxic int, part int, x array<double>").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    rows["x"] = rows["x"].map(tuple)
    rows = rows.sort_values(["doc_id", "part", "x"], kind="stable")
    return fit(np.array(rows["x"].to_list(), float), rows["toxic"].to_numpy(float), part=rows["part"].to_numpy(), lexicon=lexicons[-1])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, score and predicted of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon's words and a few thousand numbers

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            s = shared.value.score_texts(b["__text"])
            yield b.drop(columns="__text").assign(score=s, predicted=(s >= 0.5).astype("int32"))

    d = docs.select(*keep, F.col("text").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in d.drop("__text").dtypes) + ", score double, predicted int"
    return map_texts(d, run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``; the input's columns."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score_texts(text))

    cols = docs.columns
    return docs.where(toxic(F.col("text")) < threshold).select(*[F.col(f"`{c}`") for c in cols])


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    d = docs.select("doc_id", (doc_bucket("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return score(d, train(docs, labels), ("doc_id", "held_out"))
