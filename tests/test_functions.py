import json
import math

import numpy as np
import pytest

from corvane import components  # noqa: F401
from corvane import errors, providers
from corvane.functions import tokenize
from corvane.functions.hashing import fnv1a
from corvane.operators import chunk, judge, transform
from corvane.registry import REGISTRY, Registry, catalogue


def toks(text, **config):
    return REGISTRY.build("tokenizer", "simple", config or None).split(text)


def test_simple_tokens():
    assert toks("the quick, brown fox!") == "the quick brown fox".split()
    assert toks("united_states formula_1") == ["united_states", "formula_1"]
    assert toks("a_b", keep=[]) == ["a", "b"]
    assert toks("a an and ands", min_len=3, keep=[]) == ["and", "ands"]


def test_unicode_tokens():
    u = REGISTRY.build("tokenizer", "unicode").split
    assert u("don't") == ["don't"] and toks("don't") == ["don", "t"]
    assert len(u("café bar")) == 2
    assert len(u("שָׁלוֹם")) == 1
    assert tokenize.folded_words("A_b C") == ["a_b", "c"]


def test_column_tokens_equal_python(spark):
    texts = ["The quick_1 fóx", "", None, "ÀÉ z-9 日本", "x" * 30]
    t = tokenize.build("simple")
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["x"] for r in df.select("i", t.terms(df.t).alias("x")).collect()}
    assert got == {i: t.split(x or "") for i, x in enumerate(texts)}


def pieces(name, text, **config):
    data = text.encode()
    made = REGISTRY.build("chunker", name, config).pieces(data)
    return made, [data[p.start : p.start + p.len].decode() for p in made]


BOOK = "# Book\nintro\n## One\nfirst\n### One A\ndeep\n## Two\nlast\n"


def test_fixed_chunks():
    assert pieces("fixed", "abcdefghij", size=4)[1] == ["abcd", "efgh", "ij"]
    assert pieces("fixed", "abcdefghij", size=4, overlap=2)[1][:2] == ["abcd", "cdef"]
    assert pieces("fixed", "")[1] == []
    for size in range(2, 12):
        assert "".join(pieces("fixed", "héllo wörld ünïcode", size=size)[1]) == "héllo wörld ünïcode"


def test_fixed_column_equals_python(spark):
    texts = ["", "abc", "abcdefghij" * 7, "héllo wörld " * 9, None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    for size, overlap in ((4, 0), (7, 3), (100, 10)):
        got = chunk.chunk(df, "fixed", {"size": size, "overlap": overlap}).orderBy("doc_id", "ordinal").collect()
        want = [(i, p.ordinal, p.start, p.len, t) for i, x in enumerate(texts) if x for p, t in zip(*pieces("fixed", x, size=size, overlap=overlap), strict=True)]
        assert [(r.doc_id, r.ordinal, r.start, r.len, r.text) for r in got] == want


def test_recursive_chunks():
    text = "first part.\n\nsecond part here.\n\nthird"
    made = pieces("recursive", text, size=14)[1]
    assert "".join(made) == text and all(x.strip() for x in made)
    overlapping = pieces("recursive", "aaaa bbbb cccc dddddddddd eeee", size=15, overlap=6)[1]
    assert any(a.endswith(b) for a, b in zip(overlapping, overlapping[1:], strict=False))


def test_markdown_chunks():
    made, texts = pieces("markdown", BOOK)
    assert [p.label for p in made] == ["Book", "One", "One A", "Two"]
    assert [(p.depth, p.parent) for p in made] == [(1, None), (2, 0), (3, 1), (2, 0)]
    assert texts[1].endswith("deep\n")
    assert [p.label for p in pieces("markdown", BOOK, leaves_only=True)[0]] == ["One A", "Two"]
    assert [p.label for p in pieces("markdown", "#notaheading\ntext")[0]] == [None]


@pytest.mark.parametrize(
    ("kind", "name", "config"),
    [
        ("chunker", "fixed", {"size": 0}),
        ("chunker", "fixed", {"size": 4, "overlap": 4}),
        ("chunker", "recursive", {"separators": [""]}),
        ("chunker", "markdown", {"max_level": 7}),
        ("text_index", "bm25", {"b": 1.5}),
        ("text_index", "bm25", {"k1": float("nan")}),
        ("vector_store", "flat", {"dim": 0}),
        ("vector_store", "flat", {}),
        ("embedder", "hashing", {"ngrams": [0]}),
        ("embedder", "hashing", {"token_weight": -1.0}),
        ("transform", "rm3", {"feedback_docs": 0}),
        ("verifier", "coverage", {"threshold": 2.0}),
        ("reader", "html", {"width": 0}),
        ("reader", "csv", {"delimiter": "é"}),
        ("reader", "json", {"fields": ["a"]}),
        ("tokenizer", "simple", {"unknown": 1}),
        ("tokenizer", "simple", {"min_len": "x"}),
        ("reranker", "typed", {"max_chars": 0}),
    ],
)
def test_rejected_configurations(kind, name, config):
    with pytest.raises(errors.ConfigError):
        REGISTRY.build(kind, name, config)


def test_registry(spark):
    with pytest.raises(errors.UnknownComponent, match="fixed, markdown, recursive"):
        REGISTRY.build("chunker", "none")
    r = Registry()
    r.register("tokenizer", "x", "", tokenize.SimpleConfig)(lambda c: c)
    with pytest.raises(errors.DuplicateComponent):
        r.register("tokenizer", "x", "", tokenize.SimpleConfig)(lambda c: c)
    assert r.build("tokenizer", {"name": "x", "config": {"min_len": 2}}).min_len == 2
    rows = catalogue(spark).collect()
    assert {x.kind for x in rows} == {"tokenizer", "chunker", "text_index", "vector_store", "embedder", "reader", "transform", "reranker", "verifier"}


def cosine(a, b, **config):
    e = REGISTRY.build("embedder", "hashing", {"dim": 512} | config)
    return float(e.embed(a) @ e.embed(b))


def test_hashing_embedder():
    assert fnv1a(b"") == 0xCBF29CE484222325 and fnv1a(b"a") == 0xAF63DC4C8601EC8C
    assert cosine("writing", "writes") == pytest.approx(0.3441, abs=5e-5)
    assert cosine("index", "indexes") == pytest.approx(0.5923, abs=5e-5)
    assert cosine("sorted column", "sorting columns") == pytest.approx(0.5183, abs=5e-5)
    assert cosine("volcano", "database") == 0
    assert cosine("writing", "writes", ngrams=[]) == 0
    assert not np.any(REGISTRY.build("embedder", "hashing").embed(""))


def test_lexical_rerank_literals():
    got = judge.lexical_scores("volcano", ["a database page", "the volcano erupts"])
    assert got[0] == 0 and got[1] > 0


def test_parse_lines(spark):
    reply = "Here are some:\n1. first query\n- second one\n* 'third here'\n  12) fourth\nno\n"
    want = ["first query", "second one", "third here", "fourth"]
    assert providers.parse_lines(reply, 10) == want
    df = spark.createDataFrame([(reply,)], "t string")
    assert df.select(transform.parse_lines_column(df.t, 10).alias("x")).first().x == want
    assert providers.parse_lines(reply, 2) == want[:2]


def test_rm3_in_python():
    t = REGISTRY.build("transform", "rm3")
    out = t.transform("slow writes", ["a btree makes writes slow", "the btree page splits"])[0]
    assert out.startswith("slow writes btree")
    assert t.transform("slow writes", []) == ["slow writes"]


def test_errors():
    assert [errors.classify(s) for s in (429, 503, 401, 422, 408, None)] == ["rate_limited", "server", "auth", "invalid", "timeout", "invalid"]
    assert isinstance(errors.provider_error(503, ""), errors.RetryableError) and not isinstance(errors.provider_error(401, ""), errors.RetryableError)
    with pytest.raises(errors.UnalignedSpan):
        chunk.span_text("héllo", 0, 2)
    assert chunk.span_text("héllo", 1, 2) == "é"


def test_cache_keeps_only_success(tmp_path):
    http = providers.MockHttp([(429, "no"), (500, "no"), (200, "yes")])
    c = providers.CachedHttp(http, str(tmp_path))
    assert [c.post("u", {}, "b")[0] for _ in range(4)] == [429, 500, 200, 200]
    assert (c.hits, c.misses, c.writes, len(http.calls)) == (1, 3, 1, 3)
    assert c.hit_rate() == 0.25 and c.size_bytes() == 3 and c.clear() == 1


def test_rate_limit_and_retry():
    now, slept = [0.0], []
    r = providers.RateLimiter(60, lambda: now[0], slept.append)
    assert [r.wait() for _ in range(3)] == [0, 1, 2] and slept == [1, 2]
    assert providers.RateLimiter(0).wait() == 0
    tries = []

    def call(i):
        tries.append(i)
        if i < 2:
            raise errors.RetryableError("server", "again")
        return "ok"

    assert providers.RetryPolicy().run(call, lambda s: None) == "ok" and tries == [0, 1, 2]
    with pytest.raises(errors.ProviderError):
        providers.RetryPolicy().run(lambda i: (_ for _ in ()).throw(errors.provider_error(401, "x")), lambda s: None)


def chat(*bodies, config=None):
    return providers.Chat(config or providers.ChatConfig(retry=providers.RetryPolicy(1)), providers.MockHttp(list(bodies)), "k", lambda s: None)


def test_chat_chain_and_transforms():
    says = lambda text: json.dumps(dict(choices=[dict(message=dict(content=text))]))
    ok = says("1. Slow Writes\n2. why is it slow")
    assert chat((500, "x"), (200, ok)).complete("s", "u").startswith("1.")
    with pytest.raises(errors.ProviderError, match="empty"):
        chat((200, says(""))).complete("s", "u")
    t = transform.ChatTransform("multi_query", transform.MultiQueryConfig(), chat((200, ok)))
    assert t.transform("slow writes") == ["slow writes", "why is it slow"]
    t = transform.ChatTransform("hyde", transform.HydeConfig(), chat((200, ok)))
    assert len(t.transform("q")) == 1
    t = transform.ChatTransform("decompose", transform.DecomposeConfig(), chat((503, "x")))
    assert t.transform("q") == ["q"]


def test_typed_judge():
    j = judge.TypedJudge(judge.TypedConfig(), providers.MockHttp([(200, json.dumps(dict(answers=dict(c0=dict(noul=0.9)))))]), "k")
    assert j.rerank("q", ["a", "b"]) == [0.9, 0.0] and j.rerank("q", []) == []
    j = judge.TypedJudge(judge.TypedConfig(), providers.MockHttp([(200, json.dumps(dict(answers=dict(verdict=dict(choice="maybe", confidence=0.4)))))]), "k")
    assert j.verify("q", ["a"]) == ("insufficient", 0.4, 1) and j.verify("q", []) == ("insufficient", 1.0, 0)


def test_embedding_provider():
    from corvane.operators.embed import OpenAiConfig, OpenAiEmbedder

    vectors = [dict(index=i, embedding=v) for i, v in ((1, [0, 1]), (0, [1, 0]))]
    body = json.dumps(dict(data=vectors, usage=dict(prompt_tokens=4, cost=0.5)))
    e = OpenAiEmbedder(OpenAiConfig("m", 2), providers.MockHttp([(200, body)]), "k")
    assert e.embed_many(["a", "b"]) == [[1, 0], [0, 1]] and e.usage == {"requests": 1, "prompt_tokens": 4, "usd": 0.5}
    with pytest.raises(errors.DimensionMismatch):
        OpenAiEmbedder(OpenAiConfig("m", 3), providers.MockHttp([(200, body)]), "k").embed_many(["a", "b"])
    assert math.isfinite(e.usage["usd"])
