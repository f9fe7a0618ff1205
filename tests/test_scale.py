"""What a step shuffles, and what a worker holds, must not grow with pairs of queries and documents."""

import time
import tracemalloc
import uuid

import numpy as np
import pytest

from corvane.functions import hashing, tokenize
from corvane.operators import bm25, chunk
from corvane.plans import catalog, hints, systems, task


def written(spark, run):
    """Bytes that ``run`` writes for shuffles."""
    sc = spark._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty()
        time.sleep(0.5)
        return sc.statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = total()
    run()
    return total() - before


def corpus(spark, n, words=6):
    common = " ".join(f"w{i}" for i in range(words))
    return spark.range(n).selectExpr("id AS doc_id", f"concat('{common} own', id, ' ', repeat(md5(string(id)), 20)) AS text")


def questions(spark, n, words=6):
    return spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(words)) + f" own{i}") for i in range(n)], "qid long, text string")


def test_search_shuffles_no_pairs(spark):
    q = questions(spark, 40)
    small, large = (written(spark, lambda d=corpus(spark, n): bm25.search(d, q, 5).collect()) for n in (500, 5000))
    assert large < small + 50_000
    hits = bm25.search(corpus(spark, 300), q, 3).collect()
    assert [r.doc_id for r in hits if r["rank"] == 1] == list(range(40)) and len(hits) == 120


def test_search_in_blocks_is_the_same(spark, monkeypatch):
    d = corpus(spark, 200).unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "w1 w1 w1")], "doc_id long, text string"))
    q = questions(spark, 9).unionByName(spark.createDataFrame([(50, "w1"), (51, None), (52, "none"), (50, "w1 own3")], "qid long, text string"))
    want = sorted(bm25.search(d, q, 7).collect())
    assert [r.doc_id for r in want if r.qid == 50][0] == 3  # both texts of a repeated id count
    monkeypatch.setattr(bm25, "BLOCK", 2)
    monkeypatch.setattr(bm25, "CELLS", 1)
    assert sorted(bm25.search(d, q, 7).collect()) == want
    assert sorted(bm25.search_index(bm25.index(d), q, 7).collect()) == want


def test_chunk_search_shuffles_no_pairs(spark):
    def run(n):
        c = chunk.chunk(corpus(spark, n), "recursive", {"size": 512})
        bm25.search(c.selectExpr("chunk_id AS doc_id", "text"), questions(spark, 40), 5).collect()

    small, large = (written(spark, lambda n=n: run(n)) for n in (500, 5000))
    assert large < small + 100_000


def counting(path):
    """An encoder that notes how many texts it embeds."""

    class Counting:
        def embed_many(self, texts):
            (path / uuid.uuid4().hex).write_text(str(len(texts)))
            return [[len(t or "") % 7 + 1.0, len(t or "") % 5, 1.0] for t in texts]

    return ("hashing", None, "text", "embedding", Counting()), lambda: sum(int(p.read_text()) for p in path.iterdir())


def labelled(spark, n, q):
    d = corpus(spark, n).selectExpr("string(doc_id) AS doc_id", "text", "string(null) AS title", "map('a', 'b') AS meta")
    return task.Task("t", d, questions(spark, q).selectExpr("string(qid) AS qid", "text"))


@pytest.mark.parametrize(("name", "times"), [("identity", 1), ("rm3", 2)])
def test_rewriting_embeds_each_document_once(spark, tmp_path, name, times):
    encoder, embedded = counting(tmp_path)
    t = labelled(spark, 60, 4)
    assert systems.query_rewrite(name=name, encoder=encoder).answer(t, t.queries).count() == 4
    assert embedded() == 60 + 4 * times


@pytest.mark.parametrize("make", [systems.hybrid_rrf, systems.reranked, systems.sure])
def test_systems_embed_each_text_once(spark, tmp_path, make):
    encoder, embedded = counting(tmp_path)
    t = labelled(spark, 60, 4)
    assert make(encoder=encoder).answer(t, t.queries).count() == 4
    assert embedded() == 64


def test_shortlists_shuffle_no_documents(spark):
    small, large = (written(spark, lambda t=labelled(spark, n, 4): systems._shortlist(t, t.queries, 5, systems.ENCODER).collect()) for n in (300, 6000))
    assert large < small + 100_000


def test_a_long_token_does_not_widen_all_others():
    split = tokenize.build("simple").split
    e = hashing.HashingEmbedder(hashing.HashingConfig(dim=64), split)
    texts = [" ".join(f"word{i}x{j}" for j in range(100)) for i in range(100)] + ["z" * 20_000]
    tracemalloc.start()
    got = e.embed_many(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # a table of all features as wide as the longest would take 4 GB
    h = np.zeros(64)
    for part in ["z" * 20_000] + [b for n in (3, 4, 5) for w in ["<" + "z" * 20_000 + ">"] for b in (w[i : i + n] for i in range(len(w) - n + 1))]:
        x = hashing.fnv1a(part.encode())
        h[x % 64] += -1 if x >> 63 else 1
    assert np.allclose(got[-1], h / np.sqrt(h @ h))


def test_signs_of_all_widths_are_hashed_by_their_bytes():
    e = hashing.HashingEmbedder(hashing.HashingConfig(dim=32, ngrams=(2,), token_weight=0.5), lambda t: t.split(), keep=2)
    texts = ["aé中𝒳 ΣΑΣ aé中𝒳", "x", None]
    for text, got in zip(texts, e.embed_many(texts), strict=True):
        h = np.zeros(32)
        for token in (text or "").split():
            low = "".join(c.lower() for c in token)
            for part, weight in [(low, 0.5)] + [(f"<{low}>"[i : i + 2], 1.0) for i in range(len(low) + 1)]:
                x = hashing.fnv1a(part.encode())
                h[x % 32] += -weight if x >> 63 else weight
        assert np.allclose(got, h / (np.sqrt(h @ h) or 1.0))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two folders, the second with ten times the documents of the first."""
    out = []
    for n in (300, 3000):
        p = str(tmp_path_factory.mktemp(f"t{n}"))
        corpus(spark, n, 12).repartition(4).write.parquet(f"{p}/documents.parquet")
        questions(spark, 40, 12).withColumnRenamed("qid", "item_id").write.parquet(f"{p}/benchmark.parquet")
        out.append(p)
    return out


#: Queries whose shuffles may hold the queries' hits, and nothing of a pair of a query and a document.
BOUNDED = [
    "compare_runs",
    "randomization_p_value",
    "rrf_fuse",
    "run_agreement",
    "bm25_topk_k1b",
    "rerank_lexical",
    "rm3_expand",
    "verify_coverage",
    "bm25_topk",
    "system_bm25",
    "metrics_per_query",
    "metrics_aggregate",
]


@pytest.mark.parametrize("name", BOUNDED)
def test_query_shuffles_no_pairs(spark, tables, monkeypatch, name):
    monkeypatch.setattr(catalog, "spread", lambda d: d)  # dealing a small table to all cores counts its texts
    small, large = (written(spark, lambda p=p: catalog.QUERIES[name](spark, p).collect()) for p in tables)
    assert large < small + 60_000


@pytest.mark.parametrize("name", ["unicode_tokens", "chunk_markdown"])
def test_batches_of_texts_are_bounded(spark, tmp_path, name):
    corpus(spark, 50).write.parquet(str(tmp_path / "documents.parquet"))
    corpus(spark, 50).selectExpr("doc_id AS page_id", "text AS html").write.parquet(str(tmp_path / "pages.parquet"))
    limits = [f"spark.sql.execution.arrow.max{x}PerBatch" for x in ("Records", "Bytes")]
    for c in limits:
        spark.conf.unset(c)
    assert catalog.QUERIES[name](spark, str(tmp_path)).count() == 50
    assert [int(spark.conf.get(c)) for c in limits] == [hints.BATCH_ROWS, hints.BATCH_BYTES]
    for c in limits:
        spark.conf.set(c, "7")
    hints.small_batches(spark)
    assert [int(spark.conf.get(c)) for c in limits] == [7, 7]  # lower ones stay
    for c in limits:
        spark.conf.unset(c)


def test_gold_of_many_items_is_the_same(spark, tables, monkeypatch):
    gold = lambda: sorted((r.qid, r.gold) for r in catalog._task(spark, tables[0]).qrels().collect())
    want = gold()
    assert dict(want)["3"] == sorted(str(i) for i in range(300) if str(i).startswith("3"))
    monkeypatch.setattr(task, "MAX_ROWS", 3)
    assert gold() == want
