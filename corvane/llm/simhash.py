"""SimHash near-dedup by random bit sampling.

A text's fingerprint is the sign of the sum of its hashed five-word shingles, ``BITS`` bits.
Each of ``TABLES`` tables reads 64 coordinates sampled at random and orders all texts by
them. Texts whose first sampled bits agree form a bucket, which is a run of that order; as
the order continues with the further bits, a bucket larger than ``NEAR`` texts is cut by
additional bits: each text meets the ``NEAR`` texts before it, those that share most bits. An
order ends with the text's key and can be cut anywhere, so neither a large bucket nor a large
group of copies becomes one task, and no pairs of a whole group are formed. (The first texts after a cut meet fewer; cuts
fall elsewhere in other tables.)

Candidates within ``DISTANCE`` bits are linked, the three closest of each text and table. The
Jaccard similarity of the shingle sets decides: first each text's closest link is verified, then
every remaining link whose ends are not yet in one class. A text with more than three such
predecessors in a table is crowded, and so are they. All crowded texts are joined on their
shingles by an exact prefix filter, and every pair that it leaves and whose ends are not yet in
one class is verified too. Byte-equal texts are one from the start. Classes are the connected
components of verified links, found by alternating star contraction.

Defined cases: texts without words (null, empty) are classes of their own; a text of fewer
than five words has one shingle, all of its words; words are split at ASCII white space,
A-Z lower-cased; a very long text is read whole, in memory of about 30 times its words; a class
id is the smallest doc_id in it, null if all are null; repeated rows are exact copies; an empty
table gives an empty result; further columns, whatever their names, are kept by ``dedup``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored, table

WORDS, SIMILARITY = 5, 0.8
BITS, TABLES, NEAR = 256, 32, 160
#: Of two sets with similarity 0.8 about 39 bits differ, with a deviation of 6.
DISTANCE = 58
#: Short texts differ in more bits, as a few shingles decide each.
SHORT, SHORT_DISTANCE = 8, 75
MAX_BROADCAST = 500_000  # keys of 16 bytes
HOT_TEXTS = 200_000  # texts of very many rows
FEW_TEXTS = 100_000  # texts with their class, about 100 bytes each
BLOCK = 1000  # texts with a common shingle that one join key holds
SKETCH = 1 << 18  # counts of shingles by their lowest bits, which order them

_P = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """64-bit hashes of words; bounded, and the same in every process."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(text: str | None, hashes: WordHash) -> np.ndarray:
    """Sorted distinct hashes of the shingles; none for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), "uint64", len(words))
    if not len(h):
        return h
    n = max(1, len(h) - WORDS + 1)
    out = np.zeros(n, "uint64")
    for k in range(min(WORDS, len(h))):
        out = (out ^ h[k : k + n]) * _P
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


def fingerprint(s: np.ndarray) -> np.ndarray:
    """BITS / 64 numbers of 64 bits: the signs of the sums over the shingles' hash bits."""
    lanes = []
    for k in range(BITS // 64):
        lane = _mix(s + np.uint64((k + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        by = lane.view("uint8").reshape(-1, 8)
        if len(s) > 512:  # counting byte values is cheaper than unpacking bits
            sums = np.concatenate([np.bincount(by[:, j], minlength=256) @ _BYTE_BITS for j in range(8)])
        else:
            sums = np.unpackbits(by, axis=1, bitorder="little").sum(0, dtype="int64")
        lanes.append(np.packbits(2 * sums > len(s), bitorder="little").view("uint64")[0])
    return np.array(lanes, "uint64")


_BYTE_BITS = np.unpackbits(np.arange(256, dtype="uint8")[:, None], axis=1, bitorder="little").astype("int64")


def coordinates(tables: int = TABLES, seed: int = 11) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.array([rng.choice(BITS, 64, replace=False) for _ in range(tables)])


def signatures(docs: DataFrame, tables: int = TABLES) -> DataFrame:
    """doc_id, key (md5 of the text), fp, codes (64 sampled bits for each table) and size (shingles) of every row."""
    id_type = dict(docs.dtypes)["doc_id"]
    at = coordinates(tables)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            fps, codes, sizes = [], [], []
            for t in b["text"]:
                s = shingles(t, hashes)
                sizes.append(len(s))
                if not len(s):
                    fps.append(None)
                    codes.append(None)
                    continue
                f = fingerprint(s)
                bits = np.unpackbits(f.view("uint8"), bitorder="little")
                fps.append(f.tobytes())
                codes.append(np.packbits(bits[at], axis=1).view(">u8").ravel().astype("uint64").view("int64"))
            yield pd.DataFrame({"doc_id": b["doc_id"], "key": b["key"], "fp": fps, "codes": codes, "size": sizes})

    d = docs.select("doc_id", "text", _key().alias("key"))
    return map_texts(d, run, f"doc_id {id_type}, key binary, fp binary, codes array<long>, size int")


def _key() -> Column:
    """Null text is like an empty one: both have no words."""
    return F.unhex(F.md5(F.coalesce("text", F.lit(""))))


def candidates(reps: DataFrame, near: int = NEAR, distance: int = DISTANCE) -> DataFrame:
    """Links a, b, bits between close fingerprints: for each text and table its closest
    predecessors in the order, three at most. A row a, a says that ``a`` is crowded: it is one of
    more than three that are close to each other's successor, or that successor."""
    e = reps.select(F.posexplode("codes").alias("t", "code"), "key", "fp", (F.col("size") < SHORT).alias("short")).withColumn("code", F.col("code").bitwiseXOR(F.lit(-(2**63))))
    # texts of one code are told apart by their keys, so a run of any length is cut
    e = e.repartitionByRange("t", "code", "key").sortWithinPartitions("t", "code", "key")

    def links(t: np.ndarray, key: np.ndarray, fp: np.ndarray, short: np.ndarray, first: int) -> list[tuple[bytes, bytes, int]]:
        n = len(t)
        dist = np.full((3, n - first), 999, "int32")
        back = np.zeros((3, n - first), "int64")
        close = np.zeros(n - first, "int64")
        pairs = []
        for d in range(1, min(near, n - 1) + 1):
            lo = max(first, d)
            x = np.bitwise_count(fp[lo:] ^ fp[lo - d : n - d]).sum(1, dtype="int32")
            x[t[lo:] != t[lo - d : n - d]] = 999
            most = np.where(short[lo:] | short[lo - d : n - d], max(distance, SHORT_DISTANCE), distance)
            cols = np.flatnonzero(x <= most)
            if not len(cols):
                continue
            x, y, c = x[cols], np.full(len(cols), d), cols + lo - first
            close[c] += 1
            pairs.append((d, c))
            for k in range(3):  # what is not among the three closest falls out
                was_x, was_y = dist[k, c], back[k, c]
                closer = x < was_x
                dist[k, c], back[k, c] = np.where(closer, x, was_x), np.where(closer, y, was_y)
                x, y = np.where(closer, was_x, x), np.where(closer, was_y, y)
        out = []
        for k in range(3):
            for i in np.flatnonzero(dist[k] < 999):
                out.append((key[first + i - back[k, i]], key[first + i], int(dist[k, i])))
        crowded = np.zeros(n, bool)
        crowded[first:] = close > 3
        for d, c in pairs:
            crowded[first + c[close[c] > 3] - d] = True
        out += [(key[i], key[i], 0) for i in np.flatnonzero(crowded)]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t0, k0, f0, s0 = np.zeros(0, "int64"), np.zeros(0, object), np.zeros((0, BITS // 64), "uint64"), np.zeros(0, bool)
        for c in joined(batches):
            t = np.concatenate([t0, c["t"].to_numpy("int64")])
            key = np.concatenate([k0, c["key"].to_numpy(object)])
            fp = np.concatenate([f0, np.frombuffer(b"".join(c["fp"]), "uint64").reshape(-1, BITS // 64)])
            short = np.concatenate([s0, c["short"].to_numpy(bool)])
            out = links(t, key, fp, short, len(t0))
            yield pd.DataFrame([(min(x, y), max(x, y), z) for x, y, z in out], columns=["a", "b", "bits"])
            t0, k0, f0, s0 = t[-near:], key[-near:], fp[-near:], short[-near:]

    def joined(batches: Iterator[pd.DataFrame], rows: int = 10_000) -> Iterator[pd.DataFrame]:
        """Batches of about ``rows`` rows: a comparison of many rows at once is what is fast here."""
        held: list[pd.DataFrame] = []
        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= rows:
                yield pd.concat(held)
                held = []
        if held:
            yield pd.concat(held)

    return e.mapInPandas(run, "a binary, b binary, bits int").groupBy("a", "b").agg(F.min("bits").alias("bits"))


def _texts_of(docs: DataFrame, keys: DataFrame, small: bool) -> DataFrame:
    """key, text of the ``keys``, each once. What is shuffled by a text is one row of each task."""
    texts = docs.select(_key().alias("key"), "text")
    if small:
        texts = texts.join(F.broadcast(keys), "key", "left_semi")
    texts = texts.groupBy("key").agg(F.min("text").alias("text"))
    return texts if small else texts.join(keys, "key", "left_semi")


def verify(links: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Of links a, b between text keys those with a Jaccard similarity of shingles that suffices."""
    ends = links.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = stored(_texts_of(docs, ends, links.count() <= MAX_BROADCAST // 2), "texts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHash()
        for b in batches:
            keep = []
            for x, y in zip(b["ta"], b["tb"], strict=True):
                x, y = shingles(x, hashes), shingles(y, hashes)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.loc[keep, ["a", "b"]]

    j = links.select("a", "b").join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    j = j.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")
    return map_texts(j.select("a", "b", "ta", "tb"), run, "a binary, b binary")


def prefixes(texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """h, key, root, n, pos: the rarest shingles of each text, so many that two texts of the
    similarity share one. n is the number of all shingles, pos the place from the rarest on.

    Any order that is the same for all texts is right; this one is by counts in a sketch.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, total = WordHash(), np.zeros(SKETCH, "int64")
        for b in batches:
            for t in b["text"]:
                total += np.bincount(shingles(t, hashes) & np.uint64(SKETCH - 1), minlength=SKETCH)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"at": at, "n": total[at]})

    counts = map_texts(texts.select("text"), count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most SKETCH rows
    sketch = np.zeros(SKETCH, "int64")
    sketch[counts["at"].to_numpy("int64")] = counts["n"]
    shared = texts.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, weight = WordHash(), shared.value
        for b in batches:
            for lo in range(0, len(b), 100):
                part = b.iloc[lo : lo + 100]
                first, n = [], []
                for t in part["text"]:
                    s = shingles(t, hashes)
                    s = s[np.lexsort((s, weight[s & np.uint64(SKETCH - 1)]))]
                    first.append(s[: len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1].view("int64"))
                    n.append(len(s))
                p = [len(x) for x in first]
                rows = {c: np.repeat(part[c].to_numpy(object), p) for c in ("key", "root")}
                yield pd.DataFrame({"h": np.concatenate(first), **rows, "n": np.repeat(n, p), "pos": np.concatenate([np.arange(k) for k in p])})

    return map_texts(texts.select("key", "root", "text"), run, "h long, key binary, root binary, n int, pos int")


def crowded_links(crowd: DataFrame, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Links a, b between texts key of ``crowd`` with different root, with none of the similarity left out.

    Texts that share a shingle of their prefixes meet, in blocks of ``BLOCK`` by ``BLOCK`` of them,
    unless their sizes or the places of that shingle rule the similarity out.
    """
    small = crowd.count() <= MAX_BROADCAST // 2
    texts = stored(_texts_of(docs, crowd.select("key"), small).join(F.broadcast(crowd) if small else crowd, "key"), "crowd")
    e = stored(prefixes(texts, similarity), "prefixes")
    # where all have one root, nothing is left to link
    shared = e.groupBy("h").agg(F.count("*").alias("m"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("h", "m")
    shared = stored(shared, "shared")
    e = e.join(F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared, "h")
    e = e.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("part", F.pmod(F.hash("key"), F.col("parts")))
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    l = e.select("h", F.col("part").alias("x"), others.alias("y"), F.col("key").alias("ka"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("pos").alias("pa"))
    r = e.select("h", others.alias("x"), F.col("part").alias("y"), F.col("key").alias("kb"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    share = similarity / (1 + similarity)
    fits = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= share * (F.col("na") + F.col("nb")) - 1e-6
    j = l.join(r, ["h", "x", "y"]).where((F.col("ra") < F.col("rb")) & fits)
    return j.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """node, root of the connected components of edges a, b; root is the smallest node.

    Alternating large-star and small-star contraction; each round is stored, and no node's
    neighbours are collected.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    e = stored(e, name)
    rows = e.count()
    # files and tasks follow the number of edges, and a node has one row in what is joined below
    parts = max(1, -(-rows // 100_000))
    send = F.broadcast if 2 * rows <= MAX_BROADCAST else (lambda d: d)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts), name)
        e = both.where("v > u").join(send(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        e = stored(e.coalesce(parts), name)
        low = stored(e.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), name)
        small = e.join(send(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.distinct().coalesce(parts), name)
        # done when all are stars: no node has two parents, or is both parent and child
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent"))
        ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        ends = ends.groupBy("x").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).coalesce(parts)
        if ends.where("child > 1 or child > 0 and parent > 0").isEmpty():
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root of the components ``comp`` after further edges a, b; roots are nodes too."""
    if edges.isEmpty():
        return comp
    stars = comp.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    comp = components(stars.unionByName(edges))
    return stored(comp.unionByName(comp.select(F.col("root").alias("node"), "root")).distinct(), "components")


def named_texts(docs: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and a row for each text: key, alone, low (smallest doc_id), n (rows),
    class_id, class_key (the text with it) and class_docs (rows in the class)."""
    sig = stored(signatures(docs, tables), "signatures")
    all_reps = sig.groupBy("key").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"), F.first("fp").alias("fp"), F.first("codes").alias("codes"), F.first("size").alias("size"))
    all_reps = stored(all_reps, "reps")
    reps = all_reps.where("fp is not null")
    if exact:
        crowd = reps.select("key", F.col("key").alias("root"))
        comp = components(stored(verify(stored(crowded_links(crowd, docs, similarity), "rest"), docs, similarity), "verified"))
        comp = comp.unionByName(comp.select(F.col("root").alias("node"), "root")).distinct()
    else:
        comp = _sampled_components(reps, docs, similarity)
    r = all_reps.select("key", "low", "n", F.col("fp").isNull().alias("alone")).join(comp.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    r = stored(r, "rooted")
    per = r.groupBy("root").agg(F.min("low").alias("class_id"), F.min(F.struct(F.col("low").isNull(), "low", "key")).alias("x"), F.sum("n").alias("class_docs"))
    named = r.join(per, "root").select("key", "alone", "low", "n", "class_id", F.col("x.key").alias("class_key"), "class_docs")
    return sig, stored(named, "named")


def _sampled_components(reps: DataFrame, docs: DataFrame, similarity: float) -> DataFrame:
    """node, root of the components of all verified links between candidates."""
    found = stored(candidates(reps), "links")
    links, crowd = found.where("a != b"), found.where("a = b").select(F.col("a").alias("key"))
    # each text's closest link first: most classes are whole then
    best = links.select(F.col("b").alias("node"), "a", "b", "bits").unionByName(links.select(F.col("a").alias("node"), "a", "b", "bits"))
    best = best.groupBy("node").agg(F.min(F.struct("bits", "a", "b")).alias("x")).select("x.a", "x.b").distinct()
    first = stored(verify(stored(best, "best"), docs, similarity), "verified")
    comp = components(first)
    comp = stored(comp.unionByName(comp.select(F.col("root").alias("node"), "root")).distinct(), "components")
    own = lambda c: comp.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    rest = links.join(own("a"), "a", "left").join(own("b"), "b", "left")
    rest = rest.where("coalesce(root_a, a) != coalesce(root_b, b)").select("a", "b")
    rest = rest.join(best, ["a", "b"], "left_anti")
    second = stored(verify(stored(rest, "rest"), docs, similarity), "verified")
    comp = linked(comp, second)
    if not crowd.isEmpty():
        crowd = crowd.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        third = stored(crowded_links(stored(crowd, "crowd"), docs, similarity), "rest")
        comp = linked(comp, stored(verify(third, docs, similarity), "verified"))
    return comp


def by_text(rows: DataFrame, named: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """``rows`` with ``cols`` of their text in ``named``, which has all their texts.

    Texts of very many rows are few, so they are broadcast and their rows stay where they are.
    """
    right = named.select(F.col("key").alias(key), *cols)
    texts, total = named.agg(F.count("*"), F.sum("n")).first()
    if texts <= FEW_TEXTS:
        return rows.join(F.broadcast(right), key)
    hot = F.col("n") > max(1000, total // HOT_TEXTS)  # so at most HOT_TEXTS texts
    many, few = named.where(hot).select(F.col("key").alias(key), *cols), named.where(~hot).select(F.col("key").alias(key), *cols)
    return rows.join(F.broadcast(many), key).unionByName(rows.join(F.broadcast(many.select(key)), key, "left_anti").join(few, key))


def classes(docs: DataFrame, similarity: float = SIMILARITY, tables: int = TABLES, exact: bool = False) -> DataFrame:
    """doc_id, key, class_id, class_key and class_docs (rows in the class) for every row of ``docs``.

    ``exact`` joins all texts, not only crowded ones, by prefixes of their shingles, so that no link is
    left to chance; it shuffles about a fifth of all shingles.
    """
    sig, named = named_texts(docs, similarity, tables, exact)
    j = by_text(sig.select("doc_id", "key"), named, "key", ["alone", "class_id", "class_key", "class_docs"])
    one = F.lit(1).cast("long")
    return j.select("doc_id", "key", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "class_key", F.when(F.col("alone"), one).otherwise(F.col("class_docs")).alias("class_docs"))


def dedup(docs: DataFrame, similarity: float = SIMILARITY, exact: bool = False) -> DataFrame:
    """One row of each class: of the text with the smallest doc_id; all texts without words stay.

    Of rows equal in text and id the one with the least hash of all columns stays.
    """
    cols = docs.columns
    sig, named = named_texts(docs, similarity, exact=exact)
    single = F.col("alone") | (F.col("class_docs") == 1)
    named = named.withColumn("keeps", F.when(single, F.lit("all")).when(F.col("key") == F.col("class_key"), F.lit("one")).otherwise("none"))
    named = named.withColumnRenamed("low", "__id").withColumnRenamed("keeps", "__keeps")
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), _key().alias("__key"), F.col("doc_id").alias("__doc"))
    doubled = named.where("__keeps != 'all'")
    if doubled.count() <= MAX_BROADCAST:
        j = d.join(F.broadcast(doubled.select(F.col("key").alias("__key"), "__keeps", "__id")), "__key", "left").withColumn("__keeps", F.coalesce("__keeps", F.lit("all")))
    else:
        j = by_text(d, named, "__key", ["__keeps", "__id"])
    j = j.where("__keeps = 'all' or (__keeps = 'one' and __doc <=> __id)")
    if sig.where("fp is not null").groupBy("key", "doc_id").count().where("count > 1").isEmpty():
        return j.select("__row.*")
    tie = F.xxhash64(*[F.col("__row").getField(c) for c, t in docs.dtypes if "map<" not in t])
    one = j.where("__keeps = 'one'").groupBy("__key").agg(F.min_by("__row", tie).alias("__row"))
    return j.where("__keeps = 'all'").select("__row.*").unionByName(one.select("__row.*"))


def op3_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    c = classes(table(spark, sf_dir, "documents"))
    return c.select("doc_id", "class_id", "class_docs", (F.col("doc_id") == F.col("class_id")).alias("is_representative"))
