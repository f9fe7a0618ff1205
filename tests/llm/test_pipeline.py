"""Every stage of the pipeline against what its operator says of the stage's own input."""

import corpus_pipeline as P
from corvane.llm import decontaminate, packing, secrets, simhash, toxicity
from corvane.llm.common import stored


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols = docs.columns
    assert [n for n, _ in P.STAGES] == ["toxicity", "simhash_dedup", "decontamination", "secret_scan", "best_fit_packing"]
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")

    one = stored(P.STAGES[0][1](spark, docs, sf), "t")
    assert ids(one) == sorted(r.doc_id for r in toxicity.score(docs, toxicity.train(docs, labels)).where("predicted = 0").collect())
    two = stored(P.STAGES[1][1](spark, one, sf), "t")
    assert ids(two) == sorted({r.class_id for r in simhash.classes(one).collect()})
    three = stored(P.STAGES[2][1](spark, two, sf), "t")
    assert ids(three) == sorted(r.doc_id for r in decontaminate.find_contamination(two, bench).where("not contaminated").collect())
    four = stored(P.STAGES[3][1](spark, three, sf), "t")
    assert ids(four) == ids(three) and secrets.scan(four).where("n_secrets > 0").count() == 0
    for d in (one, two, three, four):
        assert d.columns == cols
    five = P.STAGES[4][1](spark, four, sf).toPandas()
    e = packing.Encoder(packing.default_vocabulary())
    assert five.length.sum() == sum(len(e.encode(r.text)) + 1 for r in four.select("text").collect())
    assert len(P.run(spark, sf).collect()) == len(five)
    empty = docs.limit(0)
    for _, f in P.STAGES:
        empty_out = f(spark, empty, sf)
        assert empty_out.count() == 0


def test_stages_on_hard_rows(spark, sf):
    """Nulls in every column, repeated rows, a very long text and columns with the operators' own names."""
    types = "doc_id long, text string, lang string, source string, n_chars long, __row string, __key string, score double, key string, `a.b` string"
    more = (None, "k", 0.5, "x", "y")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("text is not null").first().text
    long = " ".join(f"w{i}" for i in range(60_000))
    secret = 'set token = "3f9a1c77be024d5e86a1f0c2d4b59e7788aa01cd" here and the rest of this text'
    rows = [(None, None, None, None, None, *more), (None, None, None, None, None, *more), (1, "", "en", "s", 0, *more), (2, long, None, "s", 1, *more), (3, long, "en", None, 1, *more)]
    rows += [(4, f"before {item} after", "en", "s", 1, *more), (5, secret, "en", "s", 1, *more), (5, secret, "en", "s", 1, *more), (None, "a text whose id is null", "en", "s", 1, *more), (None, "a text whose id is null", "en", "s", 1, *more)]
    docs = spark.createDataFrame(rows, types)
    for _, stage in P.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf), "t")
        assert docs.columns == [f.split(" ")[0].strip("`") for f in types.split(", ")]
    left = sorted((r.doc_id if r.doc_id is not None else -1, (r.text or "")[:30]) for r in docs.collect())
    assert left == [(-1, ""), (-1, ""), (-1, "a text whose id is null"), (1, ""), (2, long[:30]), (5, 'set token = "[SECRET]" here and'[:30])]
    packed = P.STAGES[-1][1](spark, docs, sf).collect()
    assert sum(r.piece == 0 for r in packed) == len(left) and max(r.piece for r in packed if r.doc_id == 2) > 20
