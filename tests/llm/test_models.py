"""Packing, near-dedup, secrets, toxicity, language and LM scoring: brute force, round trips, held-out rows."""

import math
import zlib
from collections import Counter, defaultdict
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import langid, lm, packing, secrets, simhash, toxicity

DOC = "doc_id long, text string, lang string, source string, key string"


def frame_of(spark, texts, lang="en"):
    return spark.createDataFrame([(i, t, lang, "s", "k") for i, t in enumerate(texts)], DOC)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- packing


def test_cut():
    assert packing.cut(5, 5) == [(0, 5)] and packing.cut(1, 5) == [(0, 1)]
    assert packing.cut(12, 5) == [(0, 2), (2, 5), (7, 5)] and packing.cut(10, 5) == [(0, 5), (5, 5)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    size = int(rng.integers(8, 60))
    h = {int(n): int(c) for n, c in zip(rng.choice(np.arange(1, size + 1), 7, replace=False), rng.integers(1, 400, 7), strict=True)}
    entries, n = packing.plan(h, size)
    ranks, places = defaultdict(list), defaultdict(list)
    for length, first, count, seq, offset in entries:
        ranks[length] += range(first, first + count)
        for k in range(count):
            places[seq + k].append((offset, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in h.items()}
    assert sorted(places) == list(range(n))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= size
    # never more than best-fit decreasing over single pieces
    rooms: list[int] = []
    for length in sorted(h, reverse=True):
        for _ in range(h[length]):
            fit = [r for r in rooms if r >= length]
            if fit:
                rooms.remove(min(fit))
                rooms.append(min(fit) - length)
            else:
                rooms.append(size - length)
    assert n == len(rooms)
    assert packing.plan({}, size) == ([], 0)


def test_encoder_equals_tokenizers():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_vocabulary())
    e = packing.Encoder(packing.default_vocabulary())
    texts = ["", "It's  a test\n\n of 12ab words'll", "Éauxtré ñ ß", "日本語 テスト ²Ⅷ", "<|endoftext|> a", "a <|endoftext|> b", "x<|endoftext|><|endoftext|>", "a\x1cb\x85c\xa0d", " \t\r\n x  ", "–—“q” €5 ¿no?", "x" * 5000, "\U0001f600 ok"]
    for s in texts:
        assert e.encode(s).tolist() == t.encode(s, add_special_tokens=False).ids


def test_pack_round_trip(spark, documents):
    e = packing.Encoder(packing.default_vocabulary())
    extra = documents.limit(0).unionByName(spark.createDataFrame([(900_001, None, "en", "s", 0), (900_002, "", "en", "s", 0), (7, "same", "en", "s", 4), (7, "same", "en", "s", 4)], documents.schema))
    d = documents.unionByName(extra)
    p = packing.pack(d, with_ids=True).toPandas()
    want = Counter((r.doc_id, (*e.encode(r.text or "").tolist(), 0)) for r in d.select("doc_id", "text").collect())
    whole, got = p[p.doc_id != 7], Counter()
    for doc, g in whole.groupby("doc_id"):
        g = g.sort_values("piece")
        ids = [x for v in g.ids for x in v]
        assert g.start.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and (g.length <= 2048).all()
        assert [zlib.crc32(np.array(v, "<u4").tobytes()) for v in g.ids] == g.ids_crc32.tolist()
        got[doc, tuple(ids)] += 1
    assert got == Counter({k: v for k, v in want.items() if k[0] != 7})
    assert len(p[p.doc_id == 7]) >= 3
    for _, g in p.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0, *g.length[:-1]]).tolist() and g.length.sum() <= 2048
    s = packing.sequences(packing.pack(d, with_ids=True))
    assert sum(len(r.ids) for r in s.collect()) == p.length.sum()
    assert packing.pack(documents.limit(0)).count() == 0


# --- near-dedup


def shingle_set(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(ids, texts):
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if a and b and len(a & b) >= 0.8 * len(a | b):
            root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i in range(len(texts)):
        low[find(i)] = min(low.get(find(i), ids[i]), ids[i])
    return {ids[i]: low[find(i)] for i in range(len(texts))}


def test_classes_equal_brute_force(spark, documents):
    rng = np.random.default_rng(1)
    words = [f"word{i}" for i in range(400)]
    base = [list(rng.choice(words, 120)) for _ in range(6)]
    texts = [" ".join(b) for b in base] + [None, "", " ", "tiny text", "Tiny TEXT", "other"]
    for b in base[:4]:  # a chain of small edits, each of an edited text
        for k in range(12):
            b = list(b)
            b[int(rng.integers(len(b)))] = f"new{k}"
            texts.append(" ".join(b))
    texts += [texts[0]] * 5
    d = frame_of(spark, texts)
    got = {r.doc_id: r.class_id for r in simhash.classes(d).collect()}
    assert got == brute_classes(list(range(len(texts))), texts)
    kept = simhash.dedup(d)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values())) and kept.columns == d.columns
    twice = simhash.dedup(d.unionByName(d))  # rows that are equal in all columns
    left = [r.doc_id for r in twice.collect()]
    # rows without words are classes of their own and all stay
    assert Counter(left) == Counter({i: 2 if i in (6, 7, 8) else 1 for i in set(got.values())})
    assert simhash.classes(d.limit(0)).count() == 0 and simhash.dedup(d.limit(0)).count() == 0


def test_classes_on_documents(documents):
    rows = documents.select("doc_id", "text").collect()
    want = brute_classes([r.doc_id for r in rows], [r.text for r in rows])
    assert {r.doc_id: r.class_id for r in simhash.classes(documents).collect()} == want


def test_components(spark):
    e = spark.createDataFrame([(i + 1, i) for i in range(40)] + [(101, 100), (100, 102)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(e).collect()}
    assert got == {**dict.fromkeys(range(1, 41), 0), 101: 100, 102: 100}


# --- secrets


def test_forest_on_unseen_findings():
    rows = secrets.labelled_findings(800, seed=99)
    p = secrets.train().predict(np.array([secrets.features(t, a, b) for t, a, b, _ in rows], float))
    assert np.mean((p >= 0.5) == np.array([r[3] for r in rows])) > 0.93


def test_secret_cases(spark):
    key = "3f9a1c77be024d5e86a1f0c2d4b59e7788aa01cd"
    texts = [None, "", "no secret in this prose at all", f'see token = "{key}" and go', f"commit {key} fixes it", "x " * 60_000 + f'api_key: "{key[::-1]}"']
    d = frame_of(spark, [*texts, texts[3]])
    got = {r.doc_id: r for r in secrets.scan(d).collect()}
    assert [got[i].n_secrets for i in range(7)] == [0, 0, 0, 1, 0, 1, 1]
    s = got[3].secrets[0]
    assert texts[3][s.start : s.end] == key
    red = {r.doc_id: r.text for r in secrets.redact(d).collect()}
    assert red[3] == f'see token = "{secrets.MASK}" and go' and red[0] is None and red[4] == texts[4]
    assert secrets.redact(d).columns == d.columns and secrets.scan(d.limit(0)).count() == 0
    plain = frame_of(spark, ["password=hunter2secret", "export TOKEN=abqdefzhijxlmnop", "the password: required field", "api_key = '" + key * 20 + "'", "token: string", "x" * 50_000 + "1"])
    assert [r.n_secrets for r in secrets.scan(plain).orderBy("doc_id").collect()] == [1, 1, 0, 1, 0, 0]
    own = spark.createDataFrame(secrets.labelled_findings(300), "text string, start int, end int, label int")
    assert secrets.train(own).trees


# --- toxicity


def test_isotonic_and_trees():
    x, y = np.array([3.0, 1, 2, 4, 4]), np.array([0.0, 1, 0, 1, 0])
    k, v = toxicity.isotonic(x, y)
    assert (np.diff(v) >= 0).all() and np.interp(4, k, v) == 0.5
    rng = np.random.default_rng(0)
    f = rng.random((2000, 3))
    t = (f[:, 1] > 0.7).astype(float)
    m = toxicity.fit(f, t)
    assert np.mean((m.score(f) >= 0.5) == t) > 0.99


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = toxicity.op6_toxicity(spark, sf).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    for one in ("de", "en", "es", "fr"):
        own = [r for r in held if lang[r.doc_id] == one]
        toxic = [r.predicted for r in own if labels[r.doc_id] == 1]
        clean = [r.predicted for r in own if labels[r.doc_id] == 0]
        assert sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.02 * len(clean)


def test_toxicity_features():
    lex = toxicity.Lexicon.of({"grzk": 3.0, "réeux": 1.5})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You grzk! " + "calm " * 30 + "réeux r3eux g.r.z.k gr*k", lex), strict=True))
    assert f["n_hits"] == f["distinct_hits"] == 2 and f["near_second"] == 1 and f["max_in_20"] == 1
    assert f["disguised_hits"] == 2 and f["weight_sum"] == 4.5 and f["second_density"] > 0
    assert toxicity.features(None, lex) == toxicity.features("", lex)
    crowded = dict(zip(toxicity.FEATURES, toxicity.features("grzk " * 500 + "calm", lex), strict=True))
    assert crowded["max_in_20"] == 20 and crowded["n_hits"] == 500


def test_lexicon_is_learned_from_groups_of_like_texts(spark):
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(300)]
    rows = [(" ".join(rng.choice(base, 40)), 0) for _ in range(80)]
    rows += [(" ".join([*rng.choice(base, 40), "grzk"]), 1) for _ in range(40)]
    rows += [("a passage with onlyhere that is copied " + " ".join(base[:30]), 1)] * 60
    lex = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, toxic int"))
    assert len(lex) == toxicity.PARTS + 1
    assert all("grzk" in x.weights and "onlyhere" not in x.weights for x in lex)
    assert toxicity.learn_lexicon(spark.createDataFrame([], "text string, toxic int"))[-1].weights.keys() == toxicity.INSULTS


def test_toxicity_cases(spark):
    d = frame_of(spark, [None, "", "you stupid idiot moron, you pathetic loser", "a calm page", "x" * 100_000, "a calm page"] + [f"page {i} of calm prose" for i in range(60)] + [f"you idiot {i} worthless scum" for i in range(30)])
    l = spark.createDataFrame([(i, 1, int(i >= 66)) for i in range(6, 96)] + [(7, 1, 0), (8, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in toxicity.drop_toxic(d, l).collect()}
    assert kept == {0, 1, 3, 4, 5, *range(6, 66)} and toxicity.drop_toxic(d, l).columns == d.columns
    assert toxicity.drop_toxic(d, l.limit(0)).count() == d.count() and toxicity.drop_toxic(d.limit(0), l).count() == 0


# --- language


def all_cuts(w):
    for cuts in product([0, 1], repeat=len(w) - 1):
        out, at = [], 0
        for i, c in enumerate(cuts, 1):
            if c:
                out.append(w[at:i])
                at = i
        yield [*out, w[at:]]


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(langid.default_vocabulary())
    rng = np.random.default_rng(2)
    probs = rng.random((pieces.n + 2, 2)) / 50
    probs[-1] = 0
    names = {int(h): int(i) for h, i in zip(pieces.hashes, pieces.ids, strict=True)}
    for w in ("the", "für", "añoß", "x日y", "z" * 9):
        total = np.zeros(2)
        for parts in all_cuts("▁" + w):
            ids = [names.get(int(langid.Pieces.hash(p)), pieces.n if len(p) == 1 else pieces.n + 1) for p in parts]
            total += np.prod(probs[ids], 0)
        assert langid.forward(pieces, probs, [w])[0] == pytest.approx(np.log(total))
    long = langid.forward(pieces, probs, ["ab" * 20_000, "a"])
    assert np.isfinite(long).all() and (long[0] < -1000).all()
    # blocks give what going through the word sign by sign gives
    words = ["".join(rng.choice(list("abdeinrst日ñ"), n)) for n in (3, 40, 700, 1999)] + ["relationship" * 90]
    for size in (7, 64, 512):
        langid.BLOCK = size
        for w in words:
            assert langid._forward_long(pieces, probs, w, 300) == pytest.approx(langid._forward(pieces, probs, [w])[0])
    assert np.isfinite(langid.forward(pieces, probs, ["日本語の" * 250_000])).all()  # a text of 1M signs without spaces


def test_many_languages_and_long_words(spark):
    """300 languages, each with its own letters; the rarest with long words only."""
    def text(k, n):
        rng = np.random.default_rng(k)
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6, replace=False)
        r = np.random.default_rng(1000 * k + n)
        return " ".join("".join(r.choice(letters, 30 if k == 0 else 6)) for _ in range(80))

    rows = [(10 * k + n, text(k, n), f"l{k}", "s", "k") for k in range(300) for n in range(4)]
    d = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in langid.identify(d, langid.train(d)).collect()}
    held = [(r.lang_pred, f"l{i // 10}") for i, r in got.items() if r.held_out]
    assert len(held) > 300 and np.mean([a == b for a, b in held]) > 0.9
    assert got[1].lang_pred == "l0"


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in langid.op8_language_id(spark, sf).collect()]
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def test_language_cases(spark):
    en, de = ["the house and the garden of water"] * 30, ["das haus und der garten mit wasser"] * 30
    rows = [(i, t, "en" if i < 30 else "de", "s", "k") for i, t in enumerate(en + de)] + [(100, None, "en", "", ""), (101, "", None, "", ""), (102, "12 !?", "de", "", ""), (None, "der garten", None, "", ""), (103, "the " * 50_000, None, "", "")]
    d = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in langid.identify(d, langid.train(d)).collect()}
    assert [got[i].lang_pred for i in (0, 40, 100, 101, 102, None, 103)] == ["en", "de", "und", "und", "und", "de", "en"]
    assert not got[None].held_out
    none = d.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(d, langid.train(none)).collect()} == {"und"}
    assert langid.identify(d.limit(0), langid.train(d.limit(0))).count() == 0


# --- LM scoring


def test_lm_base_and_normalisation(spark, documents):
    rows = documents.select("doc_id", "text").collect()
    extra = [(50_001, None), (50_002, ""), (50_003, "neverseen neverseen the"), (None, "the end"), (50_003, "neverseen neverseen the")]
    d = documents.select("doc_id", "text").unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter()
    every = [(r.doc_id, r.text) for r in rows] + extra
    for i, t in every:
        if not held(i):
            c.update(lm.tokens(t))
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for i, t in every:
        w = lm.tokens(t)
        want[i].append((len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), held(i)))
    for head in (lm.HEAD, 300):  # most words in the head, or most joined by word
        got = defaultdict(list)
        for r in lm.score(d, head).collect():
            assert r.train_tokens == n and r.score < 0
            got[r.doc_id].append((r.n_tokens, r.n_known, r.base_score, r.held_out))
        assert set(got) == set(want)
        for i in want:
            for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
                assert a[:2] == b[:2] and a[2] == pytest.approx(b[2]) and a[3] == b[3]
    assert lm.score(d.limit(0)).count() == 0


def test_lm_rows_sum_to_one():
    rng = np.random.default_rng(4)
    true = rng.dirichlet(np.full(40, 0.3), 40)
    pairs = np.stack([rng.multinomial(5000, p) for p in true])
    logp = lm.train(*np.nonzero(pairs), pairs[pairs > 0], 40, dim=16, steps=1500)
    none = np.zeros(0, "int64")
    assert np.exp(lm.train(none, none, none, 5).astype(float)).sum(1) == pytest.approx(np.ones(5), abs=1e-4)
    assert np.exp(logp.astype(float)).sum(1) == pytest.approx(np.ones(40), abs=1e-4)
    uni = pairs.sum(0) / pairs.sum()
    fit, base = (pairs * logp).sum() / pairs.sum(), (pairs * np.log(uni)).sum() / pairs.sum()
    assert fit > base + 0.3


def test_lm_beats_unigrams_on_held_out(spark):
    rows = [r for r in lm.op10_lm_scoring(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_scores_equal_brute_force(spark, monkeypatch, documents):
    """Scores of texts, sign by sign from the matrix of the trained model and the classes' shares."""
    d = documents.select("doc_id", "text").limit(60).unionByName(spark.createDataFrame([(90_001, None), (90_002, "neverseen the"), (90_002, "neverseen the"), (None, "")], "doc_id long, text string"))
    d = d.withColumn("source", F.lit("x")).withColumn("word", F.lit("y")).withColumn("n", F.lit(1))
    kept, fit = [], lm.train
    monkeypatch.setattr(lm, "train", lambda *a: kept.append(fit(*a, steps=30)) or kept[-1])
    monkeypatch.setattr(lm, "LEAST", 50)
    monkeypatch.setattr(lm, "MOST", 50)
    got = {(r.doc_id, r.n_tokens): r.score for r in lm.score(d, 120).collect()}
    every = [(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()]
    c = Counter(w for i, t in every if i is None or zlib.crc32(str(i).encode()) % 5 != 1 for w in lm.tokens(t))
    symbols = sorted(c, key=lambda w: (-c[w], w))[:50]
    n, v = Counter(), Counter()
    for w, k in c.items():
        if w not in symbols:
            n[lm.word_class(w)] += k
            v[lm.word_class(w)] += 1
    sym = lambda w: symbols.index(w) if w in symbols else 50 + lm.word_class(w)
    for i, t in every:
        total, before = 0.0, sym(lm.END)
        for w in lm.tokens(t):
            total += float(kept[0][before, sym(w)]) / math.log(10)
            if w not in symbols:
                total += math.log10((c[w] + 0.5) / (n[lm.word_class(w)] + 0.5 * (v[lm.word_class(w)] + 1)))
            before = sym(w)
        assert got[i, len(lm.tokens(t))] == pytest.approx(total, rel=1e-5)


def test_lm_common_tokens_grow_with_the_corpus():
    assert [lm.frequent(n) for n in (0, 10**6, 10**8, 10**10)] == [1000, 1000, 10_000, 100_000]


def test_lm_learns_from_every_pair():
    """Pairs that are too rare to be drawn among a billion others."""
    prev, nxt = np.arange(11), np.arange(11) + np.where(np.arange(11) > 0, 20, 0)
    logp = lm.train(prev, nxt, np.where(prev > 0, 400, 10**9), 40).astype(float)
    assert np.exp(logp).sum(1) == pytest.approx(np.ones(40), abs=1e-4)
    assert logp.argmax(1)[:11].tolist() == nxt.tolist()
    assert (logp[prev, nxt] > math.log(0.05)).all()


def test_lm_pairs_and_training_on_tables_equal_arrays(spark, monkeypatch, documents):
    d = documents.select("doc_id", "text").limit(50).unionByName(spark.createDataFrame([(90_001, None), (90_002, "the the")], "doc_id long, text string"))
    monkeypatch.setattr(lm, "TOKENS", 500)  # several counts a task
    monkeypatch.setattr(lm, "LEAST", 70)
    monkeypatch.setattr(lm, "MOST", 70)
    vocab = lm.vocabulary(lm.token_counts(d))
    size = vocab.symbols
    assert size == 70 + lm.CLASSES
    by_prev, by_next = lm.pair_counts(d, spark.sparkContext.broadcast(vocab), "tables", size)
    sym = lambda w: i if (i := vocab.head[w]) < 70 else 70 + lm.word_class(w)
    want = Counter()
    for r in d.select("text").collect():
        s = [sym(w) for w in (lm.END, *lm.tokens(r.text))]
        want.update(zip(s, s[1:], strict=False))
    for rows, flip in ((by_prev, False), (by_next, True)):
        got = [((p % size, r.symbol) if flip else (r.symbol, p % size), p // size) for r in rows.collect() for p in r.packed]
        assert len(got) == len(want) and dict(got) == want
    prev, nxt = np.array(list(want)).T
    n = np.array(list(want.values()))
    assert vocab.totals().tolist() == np.bincount(nxt, n, size).tolist() == np.bincount(prev, n, size).tolist()
    tables = lm.train(by_prev, by_next, vocab.totals(), size, steps=3).astype(float)
    assert tables == pytest.approx(lm.train(prev, nxt, n, size, steps=3).astype(float), abs=1e-3)
