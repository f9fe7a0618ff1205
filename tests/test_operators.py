import json

import pytest
from pyspark.sql import functions as F

from corvane import errors
from corvane.operators import bm25, dense, embed, fuse, judge, metrics, transform
from corvane.plans import runner, systems
from corvane.plans.task import DOCS, QUERIES, Task
from corvane.sources import readers, tasks
from corvane.streaming import resume


def df(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def docs(spark, *texts):
    return df(spark, [(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")


def ask(spark, *texts):
    return df(spark, [(i + 1, t) for i, t in enumerate(texts)], "qid long, text string")


def order(hits):
    return [r.doc_id for r in hits.orderBy("qid", "rank").collect()]


def test_bm25(spark):
    d = docs(spark, "the the the cat", "the aardvark", "the dog", None, "")
    assert order(bm25.search(d, ask(spark, "the aardvark")))[0] == 2
    assert order(bm25.search(docs(spark, "quantum", "quantum " + "pad " * 30), ask(spark, "quantum"))) == [1, 2]
    assert order(bm25.search(d, ask(spark, "zebra"))) == []
    assert order(bm25.search(d, ask(spark, "the"), 0)) == []
    assert order(bm25.search(d.limit(0), ask(spark, "the"))) == []
    one = {r.doc_id: r.score for r in bm25.search(d, ask(spark, "cat")).collect()}
    two = {r.doc_id: r.score for r in bm25.search(d, ask(spark, "cat cat")).collect()}
    assert two[1] == pytest.approx(2 * one[1], abs=2e-6)


def test_index_equals_search(spark, tmp_path):
    d, q = docs(spark, "a b c", "b c d", "c d e e", ""), ask(spark, "e b", "c")
    idx = bm25.index(d)
    want = [tuple(r) for r in bm25.search(d, q).orderBy("qid", "rank").collect()]
    assert [tuple(r) for r in bm25.search_index(idx, q).orderBy("qid", "rank").collect()] == want
    idx.save(str(tmp_path / "i"))
    assert [tuple(r) for r in bm25.search_index(bm25.load(spark, str(tmp_path / "i")), q).orderBy("qid", "rank").collect()] == want


def vecs(spark, rows):
    return df(spark, rows, "id long, embedding array<float>")


def test_flat(spark):
    v = vecs(spark, [(1, [10.0, 0.0]), (2, [0.0, 0.1])])
    q = df(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])], "qid long, embedding array<float>")
    assert order(dense.search(v, q, 1)) == [1, 2]
    assert order(dense.search(v, q.limit(1), 2, "dot")) == [1, 2]
    z = vecs(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0])])
    assert order(dense.search(z, q.limit(1))) == [2, 1]
    with pytest.raises(Exception, match="expected 2 dimensions, got 3"):
        dense.search(vecs(spark, [(1, [1.0, 2.0, 3.0])]), q).collect()
    with pytest.raises(Exception, match="expected 3 dimensions"):
        dense.add(v, 3).collect()
    assert dense.add(z, 2).orderBy("id").first().norm == 1.0


def test_rrf(spark):
    run = lambda *ids: df(spark, [(1, i, k + 1) for k, i in enumerate(ids)], "qid long, doc_id long, rank int")
    assert order(fuse.rrf([run(1, 2, 3), run(3, 2, 1)])) == [1, 3, 2]
    assert fuse.rrf([run(7), run(7)]).first().score == pytest.approx(2 / 61)
    assert order(fuse.rrf([run(1, 2, 3, 4), run(1, 2, 3, 4)], n=2)) == [1, 2]


def test_lexical_rerank_equals_python(spark):
    texts = ["who directed the film", "Sinister is a film", "nothing here", "film film directed"]
    s = df(spark, [(1, k + 1, k, "who directed Sinister", t) for k, t in enumerate(texts)], "qid long, rank int, doc_id long, query string, text string")
    got = {r.doc_id: r.score for r in judge.rerank_lexical(s).collect()}
    want = judge.lexical_scores("who directed Sinister", texts)
    assert [got[k] for k in range(4)] == pytest.approx(want) and got[2] == 0


def test_coverage(spark):
    e = df(spark, [(1, "Sinister was directed by someone, who knows"), (2, "unrelated"), (2, "x"), (2, "y")], "qid long, text string")
    v = {r.qid: r for r in judge.verify_coverage(e, ask(spark, "who directed Sinister", "who directed Sinister", "who")).collect()}
    assert (v[1].support, v[1].window) == ("supports", 1)
    assert (v[2].support, v[2].window) == ("insufficient", 3)
    assert (v[3].support, v[3].confidence, v[3].window) == ("insufficient", 1.0, 0)


def test_rm3_equals_python(spark):
    texts = ["a btree makes writes slow", "the btree page splits", "pages splits again"]
    f = df(spark, [(1, k + 1, t) for k, t in enumerate(texts)], "qid long, rank int, text string")
    q = ask(spark, "slow writes", "alone")
    from corvane.registry import REGISTRY

    got = {r.qid: r.text for r in transform.rm3(q, f).collect()}
    assert got == {1: REGISTRY.build("transform", "rm3").transform("slow writes", texts)[0], 2: "alone"}
    by_udf = {r.qid: r.text for r in transform.apply(q, REGISTRY.build("transform", "rm3"), f).collect()}
    assert by_udf == got


def test_metrics(spark):
    r = df(spark, [("a", ["x", "y", "z"]), ("b", ["z"]), ("c", [])], "qid string, ranked array<string>")
    q = df(spark, [("a", ["y", "q"]), ("b", ["z"]), ("c", ["x"])], "qid string, gold array<string>")
    got = {(x.qid, x.metric): x.value for x in metrics.per_query(r, q).collect()}
    assert got["a", "recall@1"] == 0 and got["a", "recall@5"] == 0.5 and got["a", "mrr"] == 0.5 and got["a", "hit@5"] == 1
    assert got["a", "ndcg@10"] == pytest.approx((1 / 1.584962500721156) / (1 + 1 / 1.584962500721156))
    assert got["b", "ndcg@10"] == 1 and got["c", "mrr"] == 0


def test_risk(spark):
    o = df(spark, [(1, True, 0.9, False), (2, False, 0.8, False), (3, True, 0.7, False), (4, False, 0.1, True)], "qid long, correct boolean, confidence double, abstained boolean")
    s = metrics.risk_summary(o).first()
    assert s.coverage == 0.75 and s.risk == pytest.approx(1 / 3) and s.aurc == pytest.approx((0 + 0.5 + 1 / 3) / 3)
    assert [(x.coverage, x.risk) for x in metrics.risk_curve(o).orderBy("i").collect()] == [(0.25, 0), (0.5, 0.5), (0.75, pytest.approx(1 / 3))]
    e = metrics.risk_summary(o.limit(0)).first()
    assert (e.coverage, e.risk, e.aurc) == (0, 0, None)


def test_randomization(spark):
    a, b = {f"q{i}": i % 3 / 2 for i in range(60)}, {f"q{i}": i % 4 / 3 for i in range(60)}
    exact = metrics.randomization_test(a, b)
    d = [b[q] - a[q] for q in sorted(a)]
    assert exact["diff"] == pytest.approx(sum(d) / 60)
    t = lambda m: df(spark, list(m.items()), "qid string, value double")
    far = metrics.randomization_test_distributed(t(a), t(b)).first()
    assert far.n == 60 and far.diff == pytest.approx(exact["diff"]) and far.p_value == pytest.approx(exact["p_value"], abs=0.02)
    assert metrics.randomization_test({}, b)["p_value"] == 1


def test_percentiles(spark):
    x = df(spark, [(float(v),) for v in [5, 1, 3, 2, 4]], "v double")
    p = metrics.percentiles(x, "v").first()
    assert (p.p50, p.p95, p.p99, p.mean) == (3, 5, 5, 3)


def test_readers(tmp_path):
    R = readers.Readers.standard()
    write = lambda name, data: (tmp_path / name).write_bytes(data) and readers.read_file(str(tmp_path / name), R)
    assert readers.decode(b"caf\xe9", "windows-1252")[:2] == ("café", "cp1252")
    assert readers.decode(b"caf\xe9") == ("caf�", "utf-8", True)
    m = write("a.md", b"---\ntitle: T\nauthor: 'A B'\n# c: d\n---\n# Head\nbody")
    assert m["text"].startswith("# Head") and m["meta"]["front_matter"] == {"title": "T", "author": "A B"} and m["meta"]["title"] == "Head"
    h = write("a.html", b"<html><head><title> T &amp; U </title><script>var x</script></head><body><h1>Big</h1><p>some <b>bold</b> text</p></body></html>")
    assert h["meta"]["title"] == "T &amp; U" and h["text"] == "# Big\nsome bold text"
    c = write("a.csv", b"name,role\nAda,eng\nBob,\n")
    assert c["text"] == "name: Ada\nrole: eng\n\nname: Bob\n\n" and c["meta"]["rows"] == 2
    assert "x: 1" in write("a.tsv", b"x\ty\n1\t2\n")["text"]
    only = readers.csv_(readers.CsvConfig(columns=("role", "gone")))
    assert only.read(b"name,role\nAda,eng\n", "a.csv")[0] == "role: eng\n\n"
    with pytest.raises(errors.ConfigError):
        readers.csv_(readers.CsvConfig(columns=("gone",))).read(b"name\nx\n", "a.csv")
    j = write("a.json", json.dumps([{"b": "two", "a": "one", "n": 3}, {"x": ["three"]}]).encode())
    assert j["text"] == "one\ntwo\n\nthree" and j["meta"]["records"] == 2
    assert write("a.jsonl", b'{"a":"x"}\n{"a":" "}\n')["meta"]["records"] == 2
    p = readers.json_(readers.JsonConfig(fields=("/a/b",), label_fields=True))
    assert p.read(b'{"a":{"b":"v"}}', "")[0] == "b: v"
    with pytest.raises(errors.EngineError, match="neither"):
        R.of("x.json").read(b"nope", "x.json")


def test_ingest(spark, tmp_path):
    (tmp_path / "nested").mkdir()
    for name, data in {"a.md": b"# A", "nested/b.csv": b"x\n1\n", ".hidden.md": b"h", "empty.md": b"  \n", "c.pyc": b"a\0b", "LICENSE": b"free", "bad.json": b"{"}.items():
        (tmp_path / name).write_bytes(data)
    got = readers.ingest(spark, str(tmp_path))
    rows = {r.uri: r for r in got.collect()}
    assert set(rows) == {"a.md", "nested/b.csv", "LICENSE", "bad.json"} and rows["bad.json"].error
    s = readers.ingest_stats(got).first()
    assert (s.files, s.errors) == (3, 1)
    assert readers.ingest(spark, str(tmp_path), max_bytes=3).count() == 2
    with pytest.raises(errors.EngineError):
        readers.from_lists(spark, ["a"], [])
    assert readers.from_lists(spark, ["a"], ["x"]).first().doc_id == 0


def small_task(spark):
    d = df(spark, [("d1", "slow writes in a btree", None, None), ("d2", "volcano erupts", "Lava", None), ("d3", "", None, None)], DOCS)
    q = df(spark, [("q1", "btree writes", ["d1"], None, True, None, None), ("q2", "lava volcano", ["d2"], None, True, None, None), ("q3", "zebra", [], None, False, None, None)], QUERIES)
    return Task("small", d, q)


def test_systems(spark):
    t = small_task(spark)
    q = t.queries.select("qid", "text")
    # feedback terms of the other document may outweigh a query in so small a task
    assert {x.qid for x in systems.query_rewrite().answer(t, q).collect()} == {"q1", "q2", "q3"}
    others = [m for n, m in systems.SYSTEMS.items() if n != "query_rewrite"]
    for make in (*others, lambda: systems.query_rewrite(name="identity"), lambda: systems.reranked(reranker=None)):
        r = {x.qid: x for x in make().answer(t, q).collect()}
        assert set(r) == {"q1", "q2", "q3"} and r["q1"].ranked[0] == "d1" and r["q2"].ranked[0] == "d2"
    assert r["q1"].abstained is False
    s = {x.qid: x for x in systems.sure().answer(t, q).collect()}
    assert s["q1"].verdict == "supports" and not s["q1"].abstained and s["q3"].abstained


def test_runner_resumes(spark, tmp_path):
    t, s = small_task(spark), systems.bm25_system()
    first = runner.run(s, t, str(tmp_path), limit=1)
    assert first["n_queries"] == 1
    full = runner.run(s, t, str(tmp_path))
    assert full["n_queries"] == 2 and full["aggregate"]["recall@1"] == 1
    card = json.loads((tmp_path / "small__bm25" / "card.json").read_text())
    assert card["answered_now"] == 2
    again = runner.run(s, t, str(tmp_path))
    assert again["aggregate"] == full["aggregate"] and json.loads((tmp_path / "small__bm25" / "card.json").read_text())["answered_now"] == 0

    def fail(t, q):
        raise RuntimeError("no model")

    broken = runner.run(systems.System("broken", fail), t, str(tmp_path))
    assert broken["n_failed"] == 3 and broken["n_queries"] == 0
    from corvane.operators import report

    runs = report.load_metrics(spark, str(tmp_path))
    assert {r.system for r in report.table(runs).collect()} == {"bm25", "broken"}


def test_hotpot(spark):
    def row(i, titles, gold):
        return (i, f"question {i}", "a", "bridge", "easy", (titles, [[f"about {t} ", "more"] for t in titles]), (gold,))

    raw = df(spark, [row("1", ["A b", "C"], ["A b"]), row("2", ["C", "D"], ["C", "D"]), row("3", ["E"], ["E"])], tasks.HOTPOT)
    t = tasks.hotpot(raw)
    assert {r.doc_id for r in t.docs.collect()} == {"wiki::A_b", "wiki::C", "wiki::D", "wiki::E"}
    assert {r.qid: r.gold for r in t.queries.collect()}["2"] == ["wiki::C", "wiki::D"]
    u = tasks.hotpot(raw, unanswerable_frac=0.4)
    q = {r.qid: r for r in u.queries.collect()}
    assert sum(not r.answerable for r in q.values()) == 1 and u.docs.count() < 4 and u.name.endswith("-unans")
    assert tasks.hotpot(raw, per_question_scope=True).docs.count() == 5


def test_books(spark, tmp_path):
    b = tmp_path / "bk"
    b.mkdir()
    (b / "toc.json").write_text(json.dumps({"title": "Top", "children": [{"number": "1", "title": "One", "content": "text one"}, {"number": "2", "title": "Two", "text": "text two"}]}))
    (b / "test.jsonl").write_text('{"qid":"a","query":"one?","gold_docid":"1"}\n{"qid":"b","query":"none?","gold_docid":"9"}\n')
    t = tasks.books(spark, str(tmp_path))
    assert {r.doc_id: r.meta["path"] for r in t.docs.collect()} == {"bk::1": "Top > One", "bk::2": "Top > Two"}
    assert {r.qid: (r.gold, r.answerable) for r in t.queries.collect()} == {"a": (["bk::1"], True), "b": ([], False)}


def test_load_records(spark, tmp_path):
    p = tmp_path / "records.jsonl"
    p.write_text('{"qid":"a","ranked":["x"]}\nbroken\n{"qid":"a","ranked":["y"]}\n{"qid":"b","ran')
    assert [(r.qid, r.ranked) for r in tasks.load_records(spark, str(p)).collect()] == [("a", ["y"])]
    assert tasks.load_records(spark, str(tmp_path / "none")).count() == 0


def test_streams(spark, tmp_path):
    d = docs(spark, "alpha beta", "beta gamma")
    ask(spark, "beta", "gamma").select(F.col("qid").cast("string").alias("qid"), "text").write.parquet(str(tmp_path / "q"))
    for _ in range(2):
        resume.answer_stream(spark, str(tmp_path / "q"), str(tmp_path / "out"), str(tmp_path / "cp"), lambda b: bm25.search(d, b)).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    d.write.parquet(str(tmp_path / "d"))
    s = resume.term_frequencies(spark.readStream.schema(d.schema).parquet(str(tmp_path / "d")))
    s.writeStream.format("memory").queryName("tf_now").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {r.term: r.df for r in spark.table("tf_now").collect()} == {"alpha": 1, "beta": 2, "gamma": 1}


def test_provider_columns(spark):
    class Fails:
        config, uses_feedback = None, False

        def transform(self, query, feedback=None):
            raise errors.ProviderError("auth", "no key")

    r = transform.apply(ask(spark, "q"), Fails()).first()
    assert r.text == "q" and "no key" in r.error
    e = embed.embed(docs(spark, "a b", None), "hashing", {"dim": 8}).collect()
    assert all(len(x.embedding) == 8 for x in e)
