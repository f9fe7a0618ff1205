"""Benchmark decontamination: a broadcast hash set of benchmark windows tested inside each row.

The windows' 64-bit hashes become one ``IN`` set that travels with the tasks; a document's
windows are hashed and tested in place, so documents without a hit never leave their task.
Hits are then verified exactly by the window's words, in place where only the verdict or the
places count, by a join where the items are asked for.

Beyond ``max_set`` windows the set is a table. The documents are stored with a row number, and
(row, place, hash) of their windows is joined with the hashes: a broadcast hash set up to
``MAX_BROADCAST`` of them, then an exchange in which a frequent window is dealt to ``SALTS``
tasks. Texts are in neither; they meet their places by the row number, and the words of each
place are compared then (same results).

Defined cases: null or word-free text has no words and no hits; a very long text is searched
whole; an item without words has no window; an item with a null id marks words as hit but is in
no item list; repeated rows are judged one by one; an empty benchmark marks nothing, and an
empty table of documents gives an empty result; clashing further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table, where_fenced

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
MAX_SET = 50_000
MAX_BROADCAST = 5_000_000  # hashes of 8 bytes
MAX_WINDOWS = 200_000  # windows with their words and items that a broadcast may hold
SALTS = 16


def words(text: str | Column) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    raw = F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS), "")
    return F.transform(raw, lambda w: ascii_lower(w))


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per distinct window: ``win`` (its words), ``len`` and ``items`` (ids that hold it)."""
    b = benchmark.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    b = b.withColumn("len", F.least(F.size("w"), F.lit(size)))
    starts = F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)
    b = b.select("item_id", "len", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(F.col("w"), i, F.col("len")), " "))).alias("win"))
    return b.groupBy("win", "len").agg(F.collect_set("item_id").alias("items"))


def _win_hash(win: Column, n: int) -> Column:
    """The hash that ``_candidates`` gives the words of ``win``."""
    parts = F.split(win, " ")
    return F.xxhash64(*[F.xxhash64(F.get(parts, k)) for k in range(n)])


def _hashed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __w, the words, and __h, their hashes, instead of ``text``."""
    d = docs.withColumn("__w", words(text)).drop(text)
    return d.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))


def _candidates(docs: DataFrame, text: str, lens: list[int], sets: dict[int, list[int]]) -> DataFrame:
    """__uid, __row, __n and __c: (pos, len, win) of the windows whose hash is in ``sets``."""
    d = _hashed(docs.select(F.monotonically_increasing_id().alias("__uid"), "__row", text), text).withColumn("__n", F.size("__w").cast("long"))
    found = []
    for k, n in enumerate(lens):
        gets = "".join(f", get(__h, i + {j})" for j in range(1, n))
        test = f"xxhash64(x{gets}) in ({', '.join(map(str, sets[n]))})"
        d = d.withColumn(f"__p{k}", F.expr(f"array_compact(transform(slice(__h, 1, greatest(size(__h) - {n - 1}, 0)), (x, i) -> case when {test} then i end))"))
        found.append(_cut(f"__p{k}", n))
    none = F.array().cast("array<struct<pos:int,len:int,win:string>>")
    return d.select("__uid", "__row", "__n", (F.concat(*found) if found else none).alias("__c"))


def _cut(places: str, n: int) -> Column:
    """The windows of ``n`` words that begin at ``places``."""
    return F.transform(
        places,
        lambda p: F.struct(p.alias("pos"), F.lit(n).alias("len"), F.array_join(F.slice(F.col("__w"), p + 1, F.lit(n)), " ").alias("win")),
    )


def _plan(win: DataFrame, max_set: int) -> tuple[list[int], dict[int, list[int]] | None]:
    """The windows' lengths (at most WINDOW values), and their hashes by length if they are few enough."""
    sizes = {r["len"]: r["count"] for r in win.groupBy("len").count().collect()}
    lens = sorted(sizes)
    if sum(sizes.values()) > max_set:
        return lens, None
    return lens, {n: [r["h"] for r in win.where(F.col("len") == n).select(_win_hash(F.col("win"), n).alias("h")).distinct().collect()] for n in lens}


def _salted(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join in which the rows of one key of ``left`` go to SALTS tasks."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return left.withColumn("__salt", F.pmod(F.xxhash64("__uid", "pos"), F.lit(SALTS)).cast("int")).join(right.withColumn("__salt", salts), [*on, "__salt"], how).drop("__salt")


def _by_join(base: DataFrame, win: DataFrame, lens: list[int]) -> DataFrame:
    """__uid, pos, len and items of the verified windows of ``base`` (__uid, __text), which is stored."""
    h = _hashed(base.select("__uid", "__text"), "__text")
    at = []
    for n in lens:
        part = F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - (n - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(F.col("__h"), i + k) for k in range(1, n)]))
        at.append(h.select("__uid", F.posexplode(part).alias("pos", "h")).withColumn("len", F.lit(n)))
    if not at:
        return base.select("__uid", F.lit(0).alias("pos"), F.lit(0).alias("len"), F.array().cast("array<long>").alias("items")).limit(0)
    found = at[0]
    for x in at[1:]:
        found = found.unionByName(x)
    own = F.coalesce(*[F.when(F.col("len") == n, _win_hash(F.col("win"), n)) for n in lens])
    hashes = win.select(own.alias("h"), "len").distinct()
    if hashes.count() <= MAX_BROADCAST:
        found = found.join(F.broadcast(hashes), ["h", "len"], "left_semi")
    else:
        found = _salted(found, hashes, ["h", "len"], "left_semi")
    places = found.groupBy("__uid").agg(F.collect_set(F.struct("pos", "len")).alias("__p"))
    t = base.select("__uid", "__text").join(places, "__uid").select("__uid", words("__text").alias("__w"), "__p")
    cut = F.transform("__p", lambda p: F.struct(p["pos"].alias("pos"), p["len"].alias("len"), F.array_join(F.slice(F.col("__w"), p["pos"] + 1, p["len"]), " ").alias("win")))
    e = t.select("__uid", F.explode(cut).alias("e")).select("__uid", "e.*")
    if win.count() <= MAX_WINDOWS:
        return e.join(F.broadcast(win), ["win", "len"]).select("__uid", "pos", "len", "items")
    return _salted(e, win, ["win", "len"], "inner").select("__uid", "pos", "len", "items")


_HITS = "array<struct<pos:int,len:int>>"


def _collected(e: DataFrame, *more: Column) -> DataFrame:
    """__uid, __hits (the distinct places with items) and __items of rows (__uid, pos, len, items)."""
    return e.groupBy("__uid").agg(
        *more,
        F.array_sort(F.collect_set(F.when(F.col("items").isNotNull(), F.struct("pos", "len")))).alias("__hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("__items"),
    )


def _stored_rows(docs: DataFrame) -> DataFrame:
    return stored(docs.select(F.monotonically_increasing_id().alias("__uid"), "__row", "__text"), "numbered")


def _hits(docs: DataFrame, win: DataFrame, max_set: int) -> DataFrame:
    """__row, __n, __hits (verified (pos, len) pairs) and __items, for each row of ``docs``, whose __row is small."""
    lens, sets = _plan(win, max_set)
    if sets is None:
        base = _stored_rows(docs)
        found = _collected(_by_join(base, win, lens))
        d = base.select("__uid", "__row", F.size(words("__text")).cast("long").alias("__n")).join(found, "__uid", "left")
        none = F.array().cast(dict(found.dtypes)["__items"])
        return d.withColumn("__hits", F.coalesce("__hits", F.array().cast(_HITS))).withColumn("__items", F.coalesce("__items", none))
    d = _candidates(docs, "__text", lens, sets)
    e = d.select("__uid", "__row", "__n", F.explode_outer("__c").alias("__e")).select("__uid", "__row", "__n", "__e.*")
    # at most max_set windows
    return _collected(e.join(F.broadcast(win), ["win", "len"], "left"), F.first("__row").alias("__row"), F.first("__n").alias("__n"))


def _covered(hits: str) -> Column:
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda a, p: F.struct(
        F.greatest(a["end"], p["pos"] + p["len"]).alias("end"),
        (a["n"] + F.greatest(F.lit(0), p["pos"] + p["len"] - F.greatest(a["end"], p["pos"]))).alias("n"),
    )
    return F.aggregate(hits, start, step, lambda a: a["n"]).cast("long")


def find_contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items."""
    packed = docs.select(F.struct("doc_id").alias("__row"), F.col("text").alias("__text"))
    h = _hits(packed, windows(benchmark, size), max_set)
    ids = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    return h.select(
        F.col("__row.doc_id").alias("doc_id"),
        F.col("__n").alias("n_words"),
        _covered("__hits").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (F.size("__hits") > 0).alias("contaminated"),
        F.col("__hits").alias("hits"),
        F.col("__items").alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """The rows of ``docs`` without any benchmark window; the input's columns."""
    return _act(docs, benchmark, size, max_set, False)


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, max_set: int = MAX_SET) -> DataFrame:
    """``docs`` with hit words, and what separates them from each other, cut from the text."""
    return _act(docs, benchmark, size, max_set, True)


def _act(docs: DataFrame, benchmark: DataFrame, size: int, max_set: int, spans: bool) -> DataFrame:
    cols = docs.columns
    win = windows(benchmark, size)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col("text").alias("__text"))
    lens, sets = _plan(win, max_set)
    if sets is not None:
        # only places are needed: the candidates' words are compared in place, nothing is shuffled
        listed = [r["win"] for r in win.select("win").collect()]  # at most max_set windows
        d = _candidates(packed, "__text", lens, sets)
        if not spans:
            hit = F.exists("__c", lambda c: c["win"].isin(listed)) if listed else F.lit(False)
            return where_fenced(d, ~hit).select("__row.*")
        hits = F.filter("__c", lambda c: c["win"].isin(listed)) if listed else F.array().cast(_HITS)
        h = d.select("__row", hits.alias("__hits"))
    else:
        base = _stored_rows(packed)
        found = _by_join(base, win, lens)
        if not spans:
            return base.join(found.select("__uid").distinct(), "__uid", "left_anti").select("__row.*")
        found = found.groupBy("__uid").agg(F.collect_set(F.struct("pos", "len")).alias("__hits"))
        h = base.select("__uid", "__row").join(found, "__uid", "left").withColumn("__hits", F.coalesce("__hits", F.array().cast(_HITS)))
    run = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    h = h.withColumn("__parts", F.regexp_extract_all(F.coalesce(F.col("__row.text"), F.lit("")), F.lit(run), 0))
    h = h.withColumn("__first", F.when(F.get("__parts", F.lit(0)).rlike("^" + SEPARATORS), F.lit(1)).otherwise(F.lit(0)))
    inside = lambda a, b: F.exists(F.col("__hits"), lambda p: (p["pos"] <= a) & (b < p["pos"] + p["len"]))
    word = lambda i: F.floor((i - F.col("__first")) / 2).cast("int")
    is_word = lambda i: F.pmod(i - F.col("__first"), F.lit(2)) == 0
    keep = F.filter("__parts", lambda x, i: ~F.when(is_word(i), inside(word(i), word(i))).otherwise(inside(word(i), word(i) + 1)))
    text = F.when(F.size("__hits") == 0, F.col("__row.text")).otherwise(F.array_join(keep, ""))
    return h.select(*[text.alias(c) if c == "text" else F.col(f"__row.`{c}`").alias(c) for c in cols])


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    docs, bench = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return find_contamination(docs, bench).drop("hits", "items")


_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, {_W} AS w FROM documents),
b AS (SELECT item_id, {_W} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS g
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl)),
ns AS (SELECT DISTINCT n FROM bl),
dw AS (SELECT u, n, i, list_aggregate(w[i:i+n-1], 'string_agg', ' ') AS g
       FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
h AS (SELECT u, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
hc AS (SELECT u, count(DISTINCT p) AS n_hit FROM (SELECT u, unnest(range(i, i + n)) AS p FROM h) GROUP BY u),
hi AS (SELECT u, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT u, item_id::VARCHAR AS s FROM h) GROUP BY u)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hc USING (u) LEFT JOIN hi USING (u)
"""
