"""Registered queries over the test tables, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokenize
from ..operators import bm25, chunk, dense, embed, fuse, judge, metrics, transform
from ..registry import catalogue
from ..sources import readers
from ..storage import stored
from ..streaming import resume
from . import runner, systems
from .hints import small, small_batches, spread
from .task import Task, from_tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def wrap(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return wrap


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


# --- tokens and index statistics

_RE = r"[\p{L}\p{N}_]+"


def _terms(col: str, pattern: str = _RE, min_len: int = 1) -> str:
    found = f"list_transform(regexp_extract_all(coalesce({col}, ''), '{pattern}'), lambda x: lower(x))"
    return found if min_len == 1 else f"list_filter({found}, lambda x: octet_length(encode(x)) >= {min_len})"


def _index_sql(pattern: str = _RE, min_len: int = 1) -> str:
    return f"""toks AS (SELECT doc_id, {_terms("text", pattern, min_len)} AS terms FROM documents),
occ AS (SELECT doc_id, unnest(terms) AS term FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM occ GROUP BY ALL),
dl AS (SELECT doc_id, len(terms)::BIGINT AS dl FROM toks),
st AS (SELECT count(*) AS n, greatest(sum(dl) * 1.0 / count(*), 1.0) AS avg FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _search_sql(name: str, top: int, grow: float = 1.2, norm: float = 0.75, pattern: str = _RE, min_len: int = 1) -> str:
    return f"""{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_terms("text", pattern, min_len)}) AS term FROM benchmark) GROUP BY ALL),
{name}_s AS (SELECT qid, doc_id, round(sum(qtf * ln((n + 1) / (df + 0.5)) * (tf * ({grow} + 1)) / (tf + {grow} * (1 - {norm} + {norm} * dl / avg))), 6) AS score
  FROM {name}_q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (doc_id) CROSS JOIN st GROUP BY qid, doc_id),
{name} AS (SELECT qid, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {name}_s) WHERE rank <= {top})"""


@query("tokenize_counts", f"WITH {_index_sql()} SELECT (SELECT count(*) FROM toks) AS n_docs, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM occ")
def tokenize_counts(spark, d):
    t = bm25.tokens(docs(spark, d), tokenize.build("simple"))
    # distinct terms within a text go first, so that a frequent term is not shuffled for each occurrence
    per = t.select(F.size("terms").cast("long").alias("n"), F.array_distinct("terms").alias("u"))
    a = per.agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"))
    return a.join(F.broadcast(per.select(F.explode_outer("u").alias("t")).agg(F.count_distinct("t").alias("n_terms"))))


@query("term_df", f"WITH {_index_sql()} SELECT term, df FROM df")
def term_df(spark, d):
    return resume.term_frequencies(docs(spark, d))


@query("doc_len", f"WITH {_index_sql()} SELECT doc_id, dl FROM dl")
def doc_len(spark, d):
    return bm25.tokens(docs(spark, d), tokenize.build("simple")).select("doc_id", F.size("terms").cast("long").alias("dl"))


@query("corpus_stats", f"WITH {_index_sql()} SELECT count(*) AS n, sum(dl)::BIGINT AS total_len, round(sum(dl) * 1.0 / count(*), 6) AS avg_len FROM dl")
def corpus_stats(spark, d):
    return doc_len(spark, d).agg(F.count("*").alias("n"), F.sum("dl").alias("total_len"), F.round(F.sum("dl") / F.count("*"), 6).alias("avg_len"))


@query("postings_tf", f"WITH {_index_sql()} SELECT doc_id, term, tf FROM tf")
def postings_tf(spark, d):
    return bm25.postings(docs(spark, d), tokenize.build("simple")).select("doc_id", "term", "tf")


#: Signs that join letters, and signs that join digits, are no boundaries.
_JOINED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([\p{L}_])[''’.:·‧․‘]([\p{L}])', '\1\2', 'g'), '([\p{L}_])[''’.:·‧․‘]([\p{L}])', '\1\2', 'g'), '(\p{N})[.,;''’]([\p{N}])', '\1\2', 'g'), '(\p{N})[.,;''’]([\p{N}])', '\1\2', 'g')"""


@query("unicode_tokens", rf"SELECT doc_id, len(list_filter(regexp_extract_all({_JOINED}, '[\p{{L}}\p{{M}}\p{{N}}_]+'), lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')))::BIGINT AS n_tokens FROM documents")
def unicode_tokens(spark, d):
    return bm25.tokens(docs(spark, d), tokenize.build("unicode")).select("doc_id", F.size("terms").cast("long").alias("n_tokens"))


@query("folded_tokens", r"SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))::BIGINT AS n_tokens FROM documents")
def folded_tokens(spark, d):
    low = F.lower(F.coalesce("text", F.lit("")))
    return docs(spark, d).select("doc_id", F.size(F.regexp_extract_all(low, F.lit(r"[\p{IsAlphabetic}\p{N}_]+"), 0)).cast("long").alias("n_tokens"))


# --- lexical search


@query("bm25_topk", f"WITH {_index_sql()}, {_search_sql('r', 10)} SELECT * FROM r")
def bm25_topk(spark, d):
    return bm25.search(docs(spark, d), items(spark, d), 10)


@query("bm25_topk_k1b", f"WITH {_index_sql()}, {_search_sql('r', 10, 0.9, 0.4)} SELECT * FROM r")
def bm25_topk_k1b(spark, d):
    return bm25.search(docs(spark, d), items(spark, d), 10, {"k1": 0.9, "b": 0.4})


_PLAIN = r"[\p{L}\p{N}]+"


@query("bm25_min_len", f"WITH {_index_sql(_PLAIN, 3)}, {_search_sql('r', 10, pattern=_PLAIN, min_len=3)} SELECT * FROM r")
def bm25_min_len(spark, d):
    return bm25.search(docs(spark, d), items(spark, d), 10, {"tokenizer": dict(name="simple", config=dict(min_len=3, keep=[]))})


@query("bm25_index_search", f"WITH {_index_sql()}, {_search_sql('r', 10)} SELECT * FROM r")
def bm25_index_search(spark, d):
    return bm25.search_index(bm25.index(docs(spark, d)), items(spark, d), 10)


# --- vectors


def _vectors(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding", "label")
    return v, v.where(F.pmod("vec_id", F.lit(100)) == 0).select(F.col("vec_id").alias("qid"), "embedding", "label")


def _flat_sql(f: str) -> str:
    return f"""SELECT qid, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM
(SELECT q.vec_id AS qid, v.vec_id AS doc_id, round({f}(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
 FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0)) WHERE rank <= 10"""


@query("flat_cosine_topk", _flat_sql("list_cosine_similarity"))
def flat_cosine_topk(spark, d):
    v, q = _vectors(spark, d)
    return dense.search(v, q, 10, "cosine", "vec_id")


@query("flat_dot_topk", _flat_sql("list_inner_product"))
def flat_dot_topk(spark, d):
    v, q = _vectors(spark, d)
    return dense.search(v, q, 10, "dot", "vec_id")


@query("vector_norms", "SELECT vec_id, round(CASE WHEN s = 0 THEN 1 ELSE sqrt(s) END, 6) AS norm FROM (SELECT vec_id, list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) AS s FROM embeddings)")
def vector_norms(spark, d):
    v, _ = _vectors(spark, d)
    return dense.add(v, 64, "vec_id").select(F.col("id").alias("vec_id"), F.round("norm", 6).alias("norm"))


def _embed_sql(name: str, source: str, dim: int) -> str:
    """``name``(kind, id, pos, v): the vectors of ``source`` (kind, id, text), without zeros."""
    byte = "(instr('0123456789ABCDEF', x[2*i+1]) - 1) * 16 + instr('0123456789ABCDEF', x[2*i+2]) - 1"
    grams = " ".join(f"UNION ALL SELECT term, substr('<' || term || '>', i, {n}) FROM {name}_w, (SELECT unnest(range(1, 200)) AS i) WHERE i <= length(term) + {3 - n}" for n in (3, 4, 5))
    return f"""{name}_t AS MATERIALIZED (SELECT kind, id, term, count(*) AS times FROM (SELECT kind, id, unnest({_terms("text")}) AS term FROM {source}) GROUP BY ALL),
{name}_w AS MATERIALIZED (SELECT DISTINCT term FROM {name}_t),
{name}_g AS MATERIALIZED (SELECT term, term AS part FROM {name}_w {grams}),
{name}_h AS MATERIALIZED (SELECT part, list_reduce(list_concat([14695981039346656037::UBIGINT], list_transform(range(0, length(x) // 2), lambda i: ({byte})::UBIGINT)),
  lambda h, b: ((xor(h, b)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT) AS h FROM (SELECT DISTINCT part, hex(encode(part)) AS x FROM {name}_g)),
{name}_f AS MATERIALIZED (SELECT term, (h % {dim})::INT AS pos, sum(CASE WHEN h >= 9223372036854775808 THEN -1 ELSE 1 END) AS w FROM {name}_g JOIN {name}_h USING (part) GROUP BY ALL),
{name}_r AS MATERIALIZED (SELECT kind, id, pos, sum(times * w)::DOUBLE AS w FROM {name}_t JOIN {name}_f USING (term) GROUP BY ALL),
{name}_n AS (SELECT kind, id, sqrt(sum(w * w)) AS n FROM {name}_r GROUP BY ALL),
{name}_u AS (SELECT kind, id, pos, (w / n)::FLOAT::DOUBLE AS v FROM {name}_r JOIN {name}_n USING (kind, id) WHERE n > 0),
{name}_m AS (SELECT kind, id, sqrt(sum(v * v)) AS m FROM {name}_u GROUP BY ALL),
{name} AS MATERIALIZED (SELECT kind, id, pos, v / m AS v FROM {name}_u JOIN {name}_m USING (kind, id))"""


def _near_sql(name: str, emb: str, source: str, top: int, ids: str = "VARCHAR") -> str:
    """``name``(qid, rank, doc_id, score): the ``top`` documents of each query by cosine."""
    return f"""{name}_s AS (SELECT q.id AS qid, d.id AS doc_id, sum(q.v * d.v) AS s FROM {emb} q JOIN {emb} d USING (pos) WHERE q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
{name}_a AS (SELECT q.id::{ids} AS qid, d.id::{ids} AS doc_id, round(coalesce(s, 0), 6) AS score FROM {source} q JOIN {source} d ON q.kind = 'q' AND d.kind = 'd' LEFT JOIN {name}_s x ON x.qid = q.id AND x.doc_id = d.id),
{name} AS MATERIALIZED (SELECT qid, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM {name}_a) WHERE rank <= {top})"""


_TEXTS = "src AS MATERIALIZED (SELECT 'd' AS kind, doc_id::VARCHAR AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'q', item_id::VARCHAR, text FROM benchmark)"


@query("hashing_embed_topk", f"WITH {_TEXTS}, {_embed_sql('e', 'src', 256)}, {_near_sql('r', 'e', 'src', 10, 'BIGINT')} SELECT * FROM r")
def hashing_embed_topk(spark, d):
    own = ("hashing", {"dim": 256})
    return dense.search(embed.embed(docs(spark, d), *own), embed.embed(items(spark, d), *own), 10, "cosine", "doc_id")


# --- fusion, rewriting, reranking, verification


@query(
    "rrf_fuse",
    f"""WITH {_index_sql()}, {_search_sql("a", 50)}, {_search_sql("b", 50, 0.9, 0.4)},
f AS (SELECT qid, doc_id, round(sum(1.0 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, doc_id)
SELECT qid, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
)
def rrf_fuse(spark, d):
    return fuse.rrf(bm25.search_configs(docs(spark, d), items(spark, d), 50, [None, OTHER]), 60.0, 10)


def _short(spark, d, k=10):
    t, q = docs(spark, d), items(spark, d)
    s = small(bm25.search(t, q, k)).join(t, "doc_id").join(q.select("qid", F.col("text").alias("query")), "qid")
    return stored(s, "shortlist")  # k texts for each query, read more than once


@query(
    "rerank_lexical",
    f"""WITH {_index_sql()}, {_search_sql("r", 10)},
c AS (SELECT qid, r.rank AS first_rank, doc_id, toks.terms FROM r JOIN toks USING (doc_id)),
cs AS (SELECT qid, count(*) AS n, greatest(sum(len(terms)) * 1.0 / count(*), 1.0) AS avg FROM c GROUP BY qid),
ct AS (SELECT qid, doc_id, term, count(*) AS tf FROM (SELECT qid, doc_id, unnest(terms) AS term FROM c) GROUP BY ALL),
cd AS (SELECT qid, term, count(*) AS df FROM ct GROUP BY ALL),
x AS (SELECT qid, doc_id, sum(qtf * ln((n + 1) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avg))) AS s
  FROM ct JOIN cd USING (qid, term) JOIN r_q USING (qid, term) JOIN cs USING (qid) JOIN c USING (qid, doc_id) GROUP BY qid, doc_id),
y AS (SELECT qid, doc_id, first_rank, round(coalesce(s, 0), 6) AS score FROM c LEFT JOIN x USING (qid, doc_id))
SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank))::INT AS rank, doc_id, score FROM y""",
)
def rerank_lexical(spark, d):
    s = judge.rerank_lexical(_short(spark, d)).withColumn("score", F.round("score", 6))
    return judge.reordered(s, 10)


@query(
    "verify_coverage",
    f"""WITH {_index_sql()}, {_search_sql("r", 3)},
q AS (SELECT item_id AS qid, list_distinct(list_filter({_terms("text")}, lambda x: length(x) >= 3)) AS asked FROM benchmark),
e AS (SELECT qid, count(*) AS w FROM r GROUP BY qid),
h AS (SELECT qid, count(DISTINCT term) AS h FROM (SELECT qid, unnest(asked) AS term FROM q) JOIN (SELECT qid, unnest(terms) AS term FROM r JOIN toks USING (doc_id)) USING (qid, term) GROUP BY qid),
j AS (SELECT qid, len(asked) AS n, coalesce(w, 0) AS w, coalesce(h, 0) * 1.0 / greatest(len(asked), 1) AS share FROM q LEFT JOIN e USING (qid) LEFT JOIN h USING (qid))
SELECT qid, CASE WHEN n > 0 AND w > 0 AND share >= 0.6 THEN 'supports' ELSE 'insufficient' END AS support,
  round(CASE WHEN n = 0 OR w = 0 THEN 1.0 ELSE least(abs(share - 0.6), 1.0) END, 6) AS confidence, w AS "window",
  n > 0 AND w > 0 AND share >= 0.6 AND least(abs(share - 0.6), 1.0) >= 0.1 AS answers FROM j""",
)
def verify_coverage(spark, d):
    v = judge.verify_coverage(_short(spark, d, 3).select("qid", "text"), items(spark, d))
    v = v.withColumn("answers", judge.should_answer(0.1))
    return v.select("qid", "support", F.round("confidence", 6).alias("confidence"), "window", "answers")


@query(
    "rm3_expand",
    f"""WITH {_index_sql()}, {_search_sql("r", 3)},
o AS (SELECT qid, rank, term FROM (SELECT qid, rank, unnest(terms) AS term FROM r JOIN toks USING (doc_id)) WHERE length(term) >= 4),
p AS (SELECT o.* FROM o LEFT JOIN r_q USING (qid, term) WHERE qtf IS NULL),
s AS (SELECT qid, term, count(*) + 2 * count(DISTINCT rank) AS score FROM p GROUP BY qid, term),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS i FROM s),
m AS (SELECT qid, string_agg(term, ' ' ORDER BY i) AS more FROM k WHERE i <= 10 GROUP BY qid)
SELECT item_id AS qid, text || coalesce(' ' || more, '') AS text FROM benchmark LEFT JOIN m ON qid = item_id""",
)
def rm3_expand(spark, d):
    return transform.rm3(items(spark, d), _short(spark, d, 3).select("qid", "rank", "text")).select("qid", "text")


# --- evaluation


def _task(spark, d) -> Task:
    return from_tables(docs(spark, d), table(spark, d, "benchmark"))


OTHER = {"k1": 0.9, "b": 0.4}


def _runs(spark, d, *configs):
    runs = bm25.search_configs(docs(spark, d), items(spark, d), 10, list(configs) or [None])
    return [metrics.ranked_lists(r.withColumn("qid", F.col("qid").cast("string"))) for r in runs]


def _qrels(spark, d):
    return stored(_task(spark, d).qrels(), "qrels")


_GOLD = """gold AS (SELECT item_id AS qid, doc_id, count(*) OVER (PARTITION BY item_id) AS ng FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def _ideal(n: str, k: int) -> str:
    return "CASE " + " ".join(f"WHEN {n} = {i} THEN {sum(1 / math.log2(j + 2) for j in range(i))!r}" for i in range(1, k)) + f" ELSE {sum(1 / math.log2(j + 2) for j in range(k))!r} END"


def _metrics_sql(run: str, gold: str = _GOLD) -> str:
    return f"""{gold}, qs AS (SELECT DISTINCT qid, ng FROM gold),
hit AS (SELECT qid, rank FROM {run} JOIN gold USING (qid, doc_id)),
m AS (SELECT qs.qid, qs.ng, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, min(rank) AS r1,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM qs LEFT JOIN hit ON hit.qid = qs.qid GROUP BY qs.qid, qs.ng),
pq AS (SELECT qid, 'recall@1' AS metric, h1 * 1.0 / ng AS value FROM m UNION ALL SELECT qid, 'recall@5', h5 * 1.0 / ng FROM m
  UNION ALL SELECT qid, 'mrr', coalesce(1.0 / r1, 0) FROM m UNION ALL SELECT qid, 'hit@5', CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END FROM m
  UNION ALL SELECT qid, 'ndcg@10', dcg / ({_ideal("least(ng, 10)", 10)}) FROM m)"""


@query("metrics_per_query", f"WITH {_index_sql()}, {_search_sql('r', 10)}, {_metrics_sql('r')} SELECT qid::VARCHAR AS qid, metric, round(value, 6) AS value FROM pq")
def metrics_per_query(spark, d):
    (r,) = _runs(spark, d)
    return metrics.per_query(r, _qrels(spark, d)).withColumn("value", F.round("value", 6))


@query("metrics_aggregate", f"WITH {_index_sql()}, {_search_sql('r', 10)}, {_metrics_sql('r')} SELECT metric, round(avg(value), 6) AS value, count(*) AS n FROM pq GROUP BY metric")
def metrics_aggregate(spark, d):
    (r,) = _runs(spark, d)
    a = metrics.aggregate(metrics.per_query(r, _qrels(spark, d)))
    return a.select("metric", F.round("value", 6).alias("value"), "n")


_LABEL_GOLD = """gold AS (SELECT q.vec_id AS qid, v.vec_id AS doc_id, count(*) OVER (PARTITION BY q.vec_id) AS ng FROM embeddings q JOIN embeddings v ON q.label = v.label AND q.vec_id % 100 = 0)"""


@query("dense_metrics_label", f"WITH r AS ({_flat_sql('list_cosine_similarity')}), {_metrics_sql('r', _LABEL_GOLD)} SELECT metric, round(avg(value), 6) AS value, count(*) AS n FROM pq GROUP BY metric")
def dense_metrics_label(spark, d):
    v, q = _vectors(spark, d)
    r = metrics.ranked_lists(dense.search(v, q, 10, "cosine", "vec_id"))
    # only the vectors that a run returned, and the size of a label, decide; so no list of all of a label is made
    long = r.select("qid", F.posexplode("ranked").alias("i", "vec")).join(v.select(F.col("vec_id").cast("string").alias("vec"), "label"), "vec")
    own = q.select("qid", F.col("label").alias("own"))
    sizes = v.groupBy(F.col("label").alias("own")).agg(F.count("*").alias("ng"))
    h = long.join(own, "qid").where("label = own").groupBy("qid").agg(F.array_sort(F.collect_list("i")).alias("at"))  # at most 10
    j = own.join(sizes, "own").join(h, "qid", "left").withColumn("at", F.coalesce("at", F.array().cast("array<int>")))
    upto = lambda k: F.size(F.filter("at", lambda i: i < k))
    ideal = F.element_at(F.array(*[F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, 11)]), F.least("ng", F.lit(10)).cast("int"))
    dcg = F.aggregate("at", F.lit(0.0), lambda a, i: a + 1.0 / F.log2(i + F.lit(2.0)))
    cols = {"recall@1": upto(1) / F.col("ng"), "recall@5": upto(5) / F.col("ng"), "mrr": F.coalesce(1.0 / (F.array_min("at") + 1), F.lit(0.0)), "hit@5": F.when(upto(5) > 0, 1.0).otherwise(0.0), "ndcg@10": dcg / ideal}
    per = j.select("qid", *[c.alias(n) for n, c in cols.items()])
    return metrics.aggregate(per.unpivot("qid", [F.col(f"`{n}`") for n in cols], "metric", "value")).select("metric", F.round("value", 6).alias("value"), "n")


_OUT = """o AS (SELECT l.doc_id, l.quality = 1 AS correct, (n_chars % 1000) / 1000.0 AS confidence, l.doc_id % 10 = 0 AS abstained FROM labels l JOIN documents d USING (doc_id)),
a AS (SELECT row_number() OVER (ORDER BY confidence DESC, doc_id) AS i, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (ORDER BY confidence DESC, doc_id ROWS UNBOUNDED PRECEDING) AS e FROM o WHERE NOT abstained),
curve AS (SELECT i, i * 1.0 / (SELECT count(*) FROM o) AS coverage, e * 1.0 / i AS risk FROM a)"""


def _outcomes(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return j.select("doc_id", (F.col("quality") == 1).alias("correct"), ((F.col("n_chars") % 1000) / 1000.0).alias("confidence"), (F.col("doc_id") % 10 == 0).alias("abstained"))


@query("risk_coverage_curve", f"WITH {_OUT} SELECT i, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM curve")
def risk_coverage_curve(spark, d):
    c = metrics.risk_curve(_outcomes(spark, d), "doc_id")
    return c.select(F.col("i").cast("long").alias("i"), F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query("risk_coverage_summary", f"WITH {_OUT} SELECT round(avg(CASE WHEN abstained THEN 0.0 ELSE 1.0 END), 6) AS coverage, round(avg(CASE WHEN abstained THEN NULL WHEN correct THEN 0.0 ELSE 1.0 END), 6) AS risk, round((SELECT avg(risk) FROM curve), 6) AS aurc FROM o")
def risk_coverage_summary(spark, d):
    s = metrics.risk_summary(_outcomes(spark, d), "doc_id")
    return s.select(*[F.round(c, 6).alias(c) for c in ("coverage", "risk", "aurc")])


def _pick(q: float) -> str:
    return f"list_sort(list(value))[least(count(*) - 1, floor({q} * count(*)))::BIGINT + 1]"


@query("latency_percentiles", f"SELECT event_type, {_pick(0.5)} AS p50, {_pick(0.95)} AS p95, {_pick(0.99)} AS p99, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY event_type")
def latency_percentiles(spark, d):
    return metrics.percentiles(table(spark, d, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query(
    "compare_runs",
    f"""WITH {_index_sql()}, {_search_sql("a", 10)}, {_search_sql("b", 10, 0.9, 0.4)}, {_metrics_sql("a")},
hit_b AS (SELECT qid, rank FROM b JOIN gold USING (qid, doc_id)),
m_b AS (SELECT qs.qid, qs.ng, count(*) FILTER (rank <= 1) AS h1, count(*) FILTER (rank <= 5) AS h5, min(rank) AS r1,
  coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= 10), 0) AS dcg FROM qs LEFT JOIN hit_b ON hit_b.qid = qs.qid GROUP BY qs.qid, qs.ng),
pq_b AS (SELECT qid, 'recall@1' AS metric, h1 * 1.0 / ng AS value FROM m_b UNION ALL SELECT qid, 'recall@5', h5 * 1.0 / ng FROM m_b
  UNION ALL SELECT qid, 'mrr', coalesce(1.0 / r1, 0) FROM m_b UNION ALL SELECT qid, 'hit@5', CASE WHEN h5 > 0 THEN 1.0 ELSE 0.0 END FROM m_b
  UNION ALL SELECT qid, 'ndcg@10', dcg / ({_ideal("least(ng, 10)", 10)}) FROM m_b)
SELECT metric, count(*) AS n, round(avg(pq.value), 6) AS mean_a, round(avg(pq_b.value), 6) AS mean_b, round(avg(pq_b.value - pq.value), 6) + 0.0 AS diff
FROM pq JOIN pq_b USING (qid, metric) GROUP BY metric""",
)
def compare_runs(spark, d):
    (a, b), gold = _runs(spark, d, None, OTHER), _qrels(spark, d)
    x = metrics.differences(metrics.per_query(a, gold), metrics.per_query(b, gold))
    return x.select("metric", "n", *[(F.round(c, 6) + 0.0).alias(c) for c in ("mean_a", "mean_b", "diff")])


@query(
    "run_agreement",
    f"""WITH {_index_sql()}, {_search_sql("a", 10)}, {_search_sql("b", 10, 0.9, 0.4)},
x AS (SELECT qid, list(doc_id ORDER BY rank) AS xs FROM a GROUP BY qid), y AS (SELECT qid, list(doc_id ORDER BY rank) AS ys FROM b GROUP BY qid)
SELECT count(*) AS n, count(*) FILTER (xs = ys) AS identical, count(*) FILTER (xs[1] = ys[1]) AS same_first,
  round(avg(len(list_intersect(xs, ys)) * 1.0 / greatest(len(xs), len(ys), 1)), 6) AS overlap FROM x JOIN y USING (qid)""",
)
def run_agreement(spark, d):
    a, b = _runs(spark, d, None, OTHER)
    return metrics.agreement(a, b).withColumn("overlap", F.round("overlap", 6))


@query("randomization_p_value")
def randomization_p_value(spark, d):
    (a, b), gold = _runs(spark, d, None, OTHER), _qrels(spark, d)
    per = [metrics.per_query(x, gold).where("metric = 'ndcg@10'").select("qid", "value") for x in (a, b)]
    return metrics.randomization_test_distributed(*per)


# --- chunking and readers


def _fixed_sql(size: int, overlap: int) -> str:
    first = lambda at: f"list_filter(bs, lambda b: b >= least({at}, n))[1]"
    return f"""WITH RECURSIVE ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents WHERE text IS NOT NULL AND text <> ''),
bo AS (SELECT doc_id, i, sum(octet_length(encode(c))) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM ch),
bl AS (SELECT doc_id, list(b::BIGINT ORDER BY i) AS bs, max(b)::BIGINT AS n FROM bo GROUP BY doc_id),
w(doc_id, ordinal, s, e) AS (SELECT doc_id, 0, 0::BIGINT, {first(str(size))} FROM bl
  UNION ALL SELECT doc_id, ordinal + 1, s2, {first(f"s2 + {size}")} FROM (
    SELECT w.doc_id, ordinal, bs, n, CASE WHEN {first(f"w.e - {overlap}")} > w.s THEN {first(f"w.e - {overlap}")} ELSE w.e END AS s2 FROM w JOIN bl ON w.doc_id = bl.doc_id WHERE w.e < bl.n))
SELECT doc_id, ordinal::INT AS ordinal, s AS start, (e - s)::INT AS len, md5(array_to_string(list_filter(list_transform(string_split(text, ''), lambda c, i: CASE WHEN bs[i] > s AND bs[i] <= e THEN c END), lambda c: c IS NOT NULL), '')) AS text_md5
FROM w JOIN bl USING (doc_id) JOIN documents USING (doc_id)"""


def _fixed(spark, d, size, overlap):
    c = chunk.chunk(docs(spark, d), "fixed", {"size": size, "overlap": overlap})
    return c.select("doc_id", "ordinal", "start", "len", F.md5("text").alias("text_md5"))


@query("chunk_fixed", _fixed_sql(1024, 0))
def chunk_fixed(spark, d):
    return _fixed(spark, d, 1024, 0)


@query("chunk_fixed_overlap", _fixed_sql(512, 128))
def chunk_fixed_overlap(spark, d):
    return _fixed(spark, d, 512, 128)


@query("chunk_recursive")
def chunk_recursive(spark, d):
    return chunk.chunk(docs(spark, d), "recursive", {"size": 512, "overlap": 64}).drop("text")


@query("chunk_markdown")
def chunk_markdown(spark, d):
    pages = html_text(spark, d).select(F.col("page_id").alias("doc_id"), "text")
    return chunk.chunk(pages, "markdown").drop("text")


@query("bm25_chunks")
def bm25_chunks(spark, d):
    c = chunk.chunk(docs(spark, d), "recursive", {"size": 512})
    return bm25.search(c.select(F.col("chunk_id").alias("doc_id"), "text"), items(spark, d), 10)


@query("html_title", r"SELECT page_id, nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g'), '') AS title FROM pages")
def html_title(spark, d):
    return table(spark, d, "pages").select("page_id", readers.html_title(F.col("html")).alias("title"))


@query("html_text")
def html_text(spark, d):
    @F.pandas_udf("string")
    def plain(s):
        return s.map(lambda t: readers.html_text(t or ""))

    small_batches(spark)
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", plain("html").alias("text"))


@query("json_pointer", "SELECT event_id, json_extract_string(props, '/k') AS k FROM events")
def json_pointer(spark, d):
    return table(spark, d, "events").select("event_id", readers.pointer_column(F.col("props"), "/k").alias("k"))


@query(
    "parse_lines",
    r"""SELECT conv_id, turn, list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r?\n'), lambda x:
 regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), '^[-*•]+\s*', ''), '^[0-9]{1,2}[.)]\s*', ''), '^[\"''`]+|[\"''`]+$', '', 'g'), '^\s+|\s+$', '', 'g')),
 lambda x: octet_length(encode(x)) >= 3 AND NOT ends_with(x, ':'))[1:3] AS lines FROM conversations""",
)
def parse_lines(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", transform.parse_lines_column(F.col("text"), 3).alias("lines"))


@query("resume_pending", "SELECT item_id AS qid FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, d):
    finished = table(spark, d, "labels").select(F.col("doc_id").alias("qid"), F.lit(None).cast("string").alias("error"))
    return runner.pending(items(spark, d), finished).select("qid")


@query("event_windows", "SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return resume.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


@query("catalogue")
def registered(spark, d):
    return catalogue(spark)


# --- whole systems


def _system(name: str, make: Callable[[], systems.System], sql: str) -> None:
    @query(f"system_{name}", sql)
    def own(spark, d, make=make):
        t = _task(spark, d)
        return make().answer(t, t.queries.select("qid", "text")).withColumn("confidence", F.round("confidence", 6))


def _records_sql(hits: str) -> str:
    return f"""SELECT item_id::VARCHAR AS qid, coalesce(list(doc_id ORDER BY rank) FILTER (doc_id IS NOT NULL), []) AS ranked,
  round(max(score) FILTER (rank = 1), 6) AS confidence, false AS abstained, NULL::VARCHAR AS verdict FROM benchmark LEFT JOIN {hits} ON qid = item_id::VARCHAR GROUP BY item_id"""


def _dense_sql(dim: int, *tops: tuple[str, int]) -> str:
    return f"WITH {_TEXTS}, {_embed_sql('e', 'src', dim)}, " + ", ".join(_near_sql(n, "e", "src", k) for n, k in tops)


def _as_text(sql: str) -> str:
    """The same with ids as the tasks have them."""
    return sql.replace("FROM documents", "FROM (SELECT doc_id::VARCHAR AS doc_id, text FROM documents)").replace("item_id AS qid", "item_id::VARCHAR AS qid")


def _rerank_sql(name: str, short: str) -> str:
    """``name``(qid, doc_id, first_rank, score): BM25 of the documents in ``short`` among themselves."""
    return f"""{name}_q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id::VARCHAR AS qid, unnest({_terms("text")}) AS term FROM benchmark) GROUP BY ALL),
{name}_c AS (SELECT qid, s.rank AS first_rank, doc_id, toks.terms FROM {short} s JOIN toks USING (doc_id)),
{name}_n AS (SELECT qid, count(*) AS n, greatest(sum(len(terms)) * 1.0 / count(*), 1.0) AS avg FROM {name}_c GROUP BY qid),
{name}_t AS (SELECT qid, doc_id, term, count(*) AS tf FROM (SELECT qid, doc_id, unnest(terms) AS term FROM {name}_c) GROUP BY ALL),
{name}_d AS (SELECT qid, term, count(*) AS df FROM {name}_t GROUP BY ALL),
{name}_x AS (SELECT qid, doc_id, sum(qtf * ln((n + 1) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / avg))) AS s
  FROM {name}_t JOIN {name}_d USING (qid, term) JOIN {name}_q USING (qid, term) JOIN {name}_n USING (qid) JOIN {name}_c USING (qid, doc_id) GROUP BY qid, doc_id),
{name} AS (SELECT qid, doc_id, first_rank, round(coalesce(s, 0), 6) AS score FROM {name}_c LEFT JOIN {name}_x USING (qid, doc_id))"""


_TOKS = _as_text(_index_sql()).split(",\nocc")[0]
_NAIVE_SQL = f"{_dense_sql(512, ('r', 10))} {_records_sql('r')}"

_system("naive", systems.naive, _NAIVE_SQL)
_system(
    "hybrid_rrf",
    systems.hybrid_rrf,
    f"""{_dense_sql(512, ("v", 50))}, {_as_text(_index_sql())}, {_as_text(_search_sql("l", 50))},
f AS (SELECT qid, doc_id, round(sum(1.0 / (60.0 + rank)), 9) AS score FROM (SELECT * FROM l UNION ALL SELECT * FROM v) GROUP BY qid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10) {_records_sql("r")}""",
)
_system("bm25", systems.bm25_system, f"WITH {_as_text(_index_sql())}, {_as_text(_search_sql('r', 10))} {_records_sql('r')}")
_system("hashing", systems.hashed, f"{_dense_sql(256, ('r', 10))} {_records_sql('r')}")
_system(
    "reranked",
    systems.reranked,
    f"""{_dense_sql(512, ("v", 10))}, {_TOKS}, {_rerank_sql("x", "v")},
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, first_rank) AS rank FROM x) {_records_sql("r")}""",
)
_system(
    "query_rewrite_rm3",
    systems.query_rewrite,
    f"""{_dense_sql(512, ("v", 3))}, {_TOKS},
o AS (SELECT qid, rank, term FROM (SELECT qid, rank, unnest(terms) AS term FROM v JOIN toks USING (doc_id)) WHERE length(term) >= 4),
own AS (SELECT DISTINCT item_id::VARCHAR AS qid, unnest({_terms("text")}) AS term FROM benchmark),
s AS (SELECT qid, term, count(*) + 2 * count(DISTINCT rank) AS score FROM o ANTI JOIN own USING (qid, term) GROUP BY qid, term),
m AS (SELECT qid, string_agg(term, ' ' ORDER BY i) AS more FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, term) AS i FROM s) WHERE i <= 10 GROUP BY qid),
src2 AS MATERIALIZED (SELECT kind, id, text FROM src WHERE kind = 'd' UNION ALL SELECT 'q', id, text || coalesce(' ' || more, '') FROM src LEFT JOIN m ON qid = id WHERE kind = 'q'),
{_embed_sql("e2", "src2", 512)}, {_near_sql("r", "e2", "src2", 10)} {_records_sql("r")}""",
)
_system("query_rewrite_identity", lambda: systems.query_rewrite(name="identity"), _NAIVE_SQL)
_system(
    "sure",
    systems.sure,
    f"""{_dense_sql(512, ("v", 10))}, {_TOKS}, ev AS (SELECT * FROM v WHERE rank <= 5), {_rerank_sql("x", "ev")},
p AS (SELECT v.qid, v.doc_id, row_number() OVER (PARTITION BY v.qid ORDER BY x.score IS NULL, x.score DESC, v.rank) AS rank FROM v LEFT JOIN x ON v.qid = x.qid AND v.doc_id = x.doc_id),
q AS (SELECT item_id::VARCHAR AS qid, list_distinct(list_filter({_terms("text")}, lambda x: length(x) >= 3)) AS asked FROM benchmark),
e0 AS (SELECT qid, count(*) AS w FROM ev GROUP BY qid),
h AS (SELECT qid, count(DISTINCT term) AS h FROM (SELECT qid, unnest(asked) AS term FROM q) JOIN (SELECT qid, unnest(terms) AS term FROM ev JOIN toks USING (doc_id)) USING (qid, term) GROUP BY qid),
j AS (SELECT qid, len(asked) AS n, coalesce(w, 0) AS w, coalesce(h, 0) * 1.0 / greatest(len(asked), 1) AS share FROM q LEFT JOIN e0 USING (qid) LEFT JOIN h USING (qid)),
k AS (SELECT qid, CASE WHEN n > 0 AND w > 0 AND share >= 0.6 THEN 'supports' ELSE 'insufficient' END AS verdict,
  round(CASE WHEN n = 0 OR w = 0 THEN 1.0 ELSE least(abs(share - 0.6), 1.0) END, 6) AS confidence FROM j),
l AS (SELECT qid, list(doc_id ORDER BY rank) AS ranked FROM p GROUP BY qid)
SELECT qid, coalesce(ranked, []) AS ranked, verdict = 'insufficient' OR confidence < 0 AS abstained, confidence, verdict FROM k LEFT JOIN l USING (qid)""",
)
