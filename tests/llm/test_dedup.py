"""Near-dedup where ids are null and where many texts are alike."""

import numpy as np

from corvane.llm import simhash

DOC = "doc_id long, text string"


def test_null_ids_keep_one_copy(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(None, " ".join(words))] * 3 + [(None, near), (None, "exact copies here"), (None, "exact copies here"), (7, "alone with an id")]
    left = [r.text for r in simhash.dedup(spark.createDataFrame(rows, DOC)).collect()]
    assert len(left) == 3 and len({*left} & {" ".join(words), near}) == 1
    assert {"exact copies here", "alone with an id"} < {*left}


def template_group(n, pairs, seed=3):
    """n texts of similarity 0.70 by a shared beginning; texts 2 i and 2 i + 1 of the first pairs have 0.83."""
    rng = np.random.default_rng(seed)
    start = " ".join(f"w{i}" for i in range(200))
    ends = [[f"x{k}" for k in rng.integers(10**9, size=42)] for _ in range(n)]
    for i in range(pairs):
        ends[2 * i + 1][:20] = ends[2 * i][:20]
    return [f"{start} {' '.join(e)}" for e in ends]


def test_pairs_in_a_template_group(spark):
    n, pairs = 600, 100
    texts = template_group(n, pairs)
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    same = [(i, j) for j in range(n) for i in range(j) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert same == [(2 * i, 2 * i + 1) for i in range(pairs)]
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(list(enumerate(texts)), DOC)).collect()}
    assert got == {i: i - i % 2 if i < 2 * pairs else i for i in range(n)}


def test_pairs_beyond_the_window(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 50)
    n, pairs = 300, 60
    docs = spark.createDataFrame(list(enumerate(template_group(n, pairs))), DOC)
    sig = simhash.stored(simhash.signatures(docs), "signatures")
    found = simhash.stored(simhash.candidates(sig, near=8), "links")
    ids = {bytes(r.key): r.doc_id for r in sig.collect()}
    planted = {(2 * i, 2 * i + 1) for i in range(pairs)}
    in_window = {tuple(sorted((ids[bytes(r.a)], ids[bytes(r.b)]))) for r in found.where("a != b").collect()}
    assert planted - in_window  # what the window alone loses
    crowd = found.where("a = b").selectExpr("a AS key", "a AS root")
    assert crowd.count() == n
    joined = {tuple(sorted((ids[bytes(r.a)], ids[bytes(r.b)]))) for r in simhash.crowded_links(crowd, docs).collect()}
    assert planted <= joined and len(joined) < 2 * pairs


def test_exact_and_hot_ways_give_the_same_classes(spark, monkeypatch):
    texts = template_group(120, 30) + ["a b c d e f g h", "a b c d e f g h i", "", None] + ["hot text of many rows"] * 1200 + [""] * 1100
    d = spark.createDataFrame(list(enumerate(texts)), DOC)
    want = {r.doc_id: (r.class_id, r.class_docs) for r in simhash.classes(d).collect()}
    assert want[121] == (120, 2) and want[124] == want[1323] == (124, 1200) and want[1400] == (1400, 1) and want[123] == (123, 1)
    assert {r.doc_id: (r.class_id, r.class_docs) for r in simhash.classes(d, exact=True).collect()} == want
    left = sorted(r.doc_id for r in simhash.dedup(d).collect())
    monkeypatch.setattr(simhash, "MAX_BROADCAST", 1)
    monkeypatch.setattr(simhash, "FEW_TEXTS", 1)
    assert {r.doc_id: (r.class_id, r.class_docs) for r in simhash.classes(d).collect()} == want
    assert sorted(r.doc_id for r in simhash.dedup(d).collect()) == left == sorted({c for c, _ in want.values()})


def test_rows_equal_in_text_and_id(spark):
    rows = [(1, "one two three four five six", x, "k") for x in "abc"] + [(2, "one two three four five six", "d", "k"), (3, "other words", "e", "k")]
    d = spark.createDataFrame(rows, DOC + ", source string, key string")
    left = {tuple(r) for r in simhash.dedup(d).collect()}
    assert len(left) == 2 and {r[0] for r in left} == {1, 3} and left == {tuple(r) for r in simhash.dedup(d.repartition(3, "source")).collect()}


def test_a_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(200_000))
    d = spark.createDataFrame([(1, long), (2, long + " more"), (3, "x" * 1_000_000), (4, "short")], DOC)
    assert {r.doc_id: r.class_id for r in simhash.classes(d).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
