"""Queries that SQL cannot express, and shared machinery, against independent small implementations."""

import functools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import providers as P
from corvane.functions import hashing, tokenize
from corvane.operators import bm25, dense, metrics
from corvane.plans import catalog
from corvane.sources import readers, tasks


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def recursive_spans(data, size, overlap):
    """Pieces by splitting ever finer, then greedy merging; written over lists of strings."""

    def split(piece, seps):
        if len(piece) <= size or not seps:
            return [piece] if piece else []
        parts = piece.split(seps[0])
        kept = [p + seps[0] for p in parts[:-1]] + [parts[-1]]
        return [x for p in kept for x in split(p, seps[1:])]

    parts = split(data, [b"\n\n", b"\n", b". ", b" "])
    ends = np.cumsum([len(p) for p in parts]).tolist()
    starts = [e - len(p) for e, p in zip(ends, parts, strict=True)]
    out, i = [], 0
    while i < len(parts):
        j = max([i, *[k for k in range(i + 1, len(parts)) if ends[k] - starts[i] <= size and ends[k - 1] - starts[i] <= size]])
        out.append((starts[i], ends[j] - starts[i]))
        if j + 1 == len(parts):
            break
        again = [k for k in range(i + 1, j + 1) if starts[k] >= ends[j] - overlap] if overlap else []
        # the kept tail is what directly precedes the next piece
        i = min(again) if again else j + 1
    return out


def test_chunk_recursive(spark, sf):
    got = defaultdict(list)
    for r in catalog.QUERIES["chunk_recursive"](spark, sf).orderBy("doc_id", "ordinal").collect():
        assert r.ordinal == len(got[r.doc_id])
        got[r.doc_id].append((r.start, r.len))
    want = {i: recursive_spans(t.encode(), 512, 64) for i, t in texts_of(spark, sf).items() if t}
    assert dict(got) == {i: s for i, s in want.items() if s}


def test_chunk_markdown(spark, sf):
    pages = {r.page_id: r.text for r in catalog.QUERIES["html_text"](spark, sf).collect()}
    want = set()
    for page, text in pages.items():
        at, heads = 0, []
        for line in text.split("\n"):
            if m := re.match(r"(#{1,6})[ \t]", line):
                heads.append((at, len(m[1]), line[m.end() :].strip()))
            at += len(line.encode()) + 1
        n, rows = len(text.encode()), []
        if (heads[0][0] if heads else n) > 0:
            rows.append((None, 0, 0, heads[0][0] if heads else n, None))
        for i, (start, level, title) in enumerate(heads):
            later = [s for s, lv, _ in heads[i + 1 :] if lv <= level]
            above = [k for k in range(i) if heads[k][1] < level]
            rows.append((above[-1] + len(rows) - i if above else None, level, start, (later or [n])[0] - start, title))
        want |= {(page, k, *r) for k, r in enumerate(rows)}
    got = {(r.doc_id, r.ordinal, r.parent, r.depth, r.start, r.len, r.label) for r in catalog.QUERIES["chunk_markdown"](spark, sf).collect()}
    assert got == want


def test_bm25_chunks(spark, sf):
    split = tokenize.build("simple").split
    chunks = {f"{i}#{k}": [w.lower() for w in split(t.encode()[s : s + n].decode())] for i, t in texts_of(spark, sf).items() if t for k, (s, n) in enumerate(recursive_spans(t.encode(), 512, 0))}
    avg, df = sum(map(len, chunks.values())) / len(chunks), Counter(w for c in chunks.values() for w in set(c))
    want = {}
    for q in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        asked, scores = Counter(w.lower() for w in split(q.text)), {}
        for c, words in chunks.items():
            tf = Counter(words)
            s = sum(k * math.log((len(chunks) + 1) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(words) / avg)) for w, k in asked.items() if tf[w])
            if any(tf[w] for w in asked):
                scores[c] = round(s, 6)
        for rank, (c, s) in enumerate(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:10], 1):
            want[q.item_id, rank] = (c, s)
    got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in catalog.QUERIES["bm25_chunks"](spark, sf).collect()}
    assert got.keys() == want.keys()
    assert all(got[k][1] == pytest.approx(want[k][1], abs=2e-6) for k in got)


def test_catalogue_names_every_component(spark, sf):
    rows = catalog.QUERIES["catalogue"](spark, sf).collect()
    assert {("text_index", "bm25"), ("vector_store", "flat"), ("embedder", "hashing"), ("chunker", "recursive"), ("reranker", "lexical"), ("verifier", "coverage"), ("transform", "rm3"), ("reader", "csv"), ("tokenizer", "unicode")} <= {(r.kind, r.name) for r in rows}
    assert all(r.schema_json.startswith("{") and r.summary for r in rows)


def test_randomization_agrees_with_all_signs(spark):
    rng = np.random.default_rng(6)
    a, b = rng.random(12), rng.random(12) + 0.2
    d = b - a
    sums = np.array([d @ [1 if m >> i & 1 else -1 for i in range(12)] for m in range(4096)])
    exact = np.mean(np.abs(sums) >= abs(d.sum()) - 1e-12)
    frames = [spark.createDataFrame([(str(i), float(v)) for i, v in enumerate(x)], "qid string, value double") for x in (a, b)]
    r = metrics.randomization_test_distributed(*frames).first()
    assert r.n == 12 and r["diff"] == pytest.approx(d.mean()) and abs(r.p_value - exact) < 0.02


def test_many_hashes_equal_single_ones():
    parts = [b"a", b"abc", "für".encode(), b"x" * 50]
    assert hashing.fnv1a_many(parts).tolist() == [hashing.fnv1a(p) for p in parts]
    e = hashing.HashingEmbedder(hashing.HashingConfig(dim=64), tokenize.build("simple").split, keep=3)
    one = hashing.HashingEmbedder(hashing.HashingConfig(dim=64), tokenize.build("simple").split)
    texts = ["a b c d e f", None, "ähnlich the the the", "a b"]
    assert np.allclose(e.embed_many(texts), [one.embed(t) for t in texts]) and not e.embed(None).any()


def test_dense_blocks_and_ties(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK", 7)
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (150, 3)).astype(float)  # many equal scores
    d = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, embedding array<double>")
    q = d.where("id < 20").withColumnRenamed("id", "qid")
    for own in (False, True):
        got = {(r.qid, r["rank"]): (r.doc_id, r.score) for r in dense.search(d, q, 6, "dot", exclude_self=own).collect()}
        for i in range(20):
            best = sorted((-round(float(v[i] @ v[j]), 6), j) for j in range(150) if not own or j != i)[:6]
            assert [got[i, k + 1] for k in range(6)] == [(j, -s) for s, j in best]


def test_percentiles_of_one_group_over_many_tasks(spark):
    rng = np.random.default_rng(1)
    values = rng.random(500).round(2)
    d = spark.createDataFrame([(float(x), "g" if i % 3 else None) for i, x in enumerate(values)], "v double, g string")
    pick = lambda x, p: sorted(x)[min(len(x) - 1, int(p * len(x)))]
    r = metrics.percentiles(d, "v").first()
    assert [r.p50, r.p95, r.p99] == [pick(values, p) for p in (0.5, 0.95, 0.99)]
    by = {r.g: r.p95 for r in metrics.percentiles(d, "v", ["g"]).collect()}
    assert by == {None: pick(values[::3], 0.95), "g": pick([x for i, x in enumerate(values) if i % 3], 0.95)}


def test_searches_of_two_configurations_share_a_pass(spark, monkeypatch):
    d = spark.createDataFrame([(1, "a b b c"), (2, "b c d"), (3, None), (4, "x")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "b c"), (2, "zzz")], "qid long, text string")
    both = bm25.search_configs(d, q, 5, [None, {"k1": 0.5}, {"tokenizer": {"name": "simple", "config": {"min_len": 2}}}])
    for got, config in zip(both, [None, {"k1": 0.5}], strict=False):
        assert got.collect() == bm25.search_index(bm25.index(d, config), q, 5).collect() != []
    assert both[2].count() == 0
    monkeypatch.setattr(bm25, "MAX_ROWS", 0)  # nothing is broadcast
    assert sorted(bm25.search(d, q, 5).collect()) == sorted(both[0].collect())


class Clock:
    def __init__(self):
        self.now, self.slept = 0.0, 0.0

    def sleep(self, s):
        self.now += s
        self.slept += s


def test_rate_limit_holds_over_calls(monkeypatch):
    clock = Clock()
    monkeypatch.setattr(P, "RateLimiter", functools.partial(P.RateLimiter, clock=lambda: clock.now, sleep=clock.sleep))

    class Net:
        calls = 0

        def post(self, url, headers, body):
            self.calls += 1
            return 200, '{"choices": [{"message": {"content": "yes"}}]}'

    net = Net()
    chat = P.Chat(P.ChatConfig(requests_per_minute=6, cache=""), net, "key")
    assert [chat.complete("s", f"u{i}") for i in range(3)] == ["yes"] * 3
    assert net.calls == 3 and clock.slept == pytest.approx(20)
    again = P.Chat(P.ChatConfig(requests_per_minute=6, cache=""), net, "key")  # the worker's limit, not the component's
    again.complete("s", "u")
    assert clock.slept == pytest.approx(30)
    assert P.shared_transport("c", 6, 1.0) is P.shared_transport("c", 6, 1.0) is not P.shared_transport("c", 7, 1.0)


def test_pointers_of_digits_and_quotes(spark):
    rows = ['{"0": "key"}', '["place"]', '{"it\'s": {"a/b": "deep"}}', '{"a": {"1": ["x", "y"]}}', '{"a": [["p", "q"], ["r", "s"]]}', "broken", None]
    d = spark.createDataFrame([(r,) for r in rows], "j string")
    get = lambda p: [r[0] for r in d.select(readers.pointer_column(F.col("j"), p)).collect()]
    assert get("/0") == ["key", "place", *[None] * 5]
    assert get("/it's/a~1b") == [None, None, "deep", *[None] * 4]
    assert get("/a/1/0") == [None, None, None, "x", "r", None, None]


def test_questions_keep_the_order_of_their_file(spark, tmp_path):
    rows = [(f"q{9 - i}", "?", "a", "t", "l", (["Same", f"T{i}"], [[f"text {i}"], ["other"]]), ([f"T{i}"],)) for i in range(5)]
    spark.createDataFrame(rows, tasks.HOTPOT).coalesce(1).write.parquet(str(tmp_path / "q"))
    task = tasks.hotpot(spark.read.parquet(str(tmp_path / "q")))
    assert task.by_id("wiki::Same").first().text == "text 0"
    assert tasks.hotpot(spark.read.parquet(str(tmp_path / "q")), order="id").by_id("wiki::Same").first().text == "text 4"
    assert task.scoped_docs(None).count() == 6
