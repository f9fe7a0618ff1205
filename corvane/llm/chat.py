"""Chat formatting: logged snapshots that are prefixes of longer conversations collapse first.

Each turn gets a rolling prefix hash: the xor of hashes of (position, role, text) of all turns
up to it, 2 x 64 bits. A conversation is a snapshot if the hash of its last turn is the hash of
an inner turn of another one; an anti-join on (hash, length) keeps the maximal ones. Of equal
conversations the smallest conv_id stays.

Positions and prefixes come in two levels, within blocks of turns and over blocks, so that a
conversation of any length is never sorted in one task; rendering joins at most ``BLOCK``
turns into one part, so a long conversation is several rows. A block with more than ``HOT``
rows, where turn numbers repeat, is cut further by turn, role and digest of the text.

Defined cases: null roles and texts count as values of their own and are rendered as ``user``
and empty; turns are ordered by (turn, role, MD5 of the text), nulls first, so repeated turns
stay; a very long text is hashed and rendered whole; ids may be of any type that has an order,
and rows with a null conv_id form one conversation; an empty table gives an empty result;
further columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK, HOT = 256, 10_000
MAX_BROADCAST = 500_000
TEMPLATE = ("<|im_start|>", "<|im_end|>")


def _id(turns: DataFrame) -> Column:
    """conv_id as a struct that equals itself also where it is null."""
    t = dict(turns.dtypes)["conv_id"]
    some = F.lit("" if t in ("string", "binary") else 0)
    plain = t in ("string", "binary", "tinyint", "smallint", "int", "bigint", "float", "double") or t.startswith("decimal")
    return F.struct(F.col("conv_id").isNull().alias("none"), (F.coalesce("conv_id", some.cast(t)) if plain else F.col("conv_id")).alias("id"))


def _before(parts: DataFrame, totals: dict, cut: bool) -> DataFrame:
    """conv, blk, sub and, for each column ``c`` of ``totals``, ``before_c``: its total over all earlier parts of conv.

    ``totals`` has for a column an aggregate and what combines two of its values.
    """
    earlier = W.partitionBy("conv").orderBy("blk").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    blocks = parts.groupBy("conv", "blk").agg(*[f(c).alias(c) for c, (f, _) in totals.items()]) if cut else parts
    before = blocks.select("conv", "blk", *([] if cut else ["sub"]), *[F.coalesce(f(c).over(earlier), zero).alias(f"before_{c}") for c, (f, _) in totals.items()])
    if not cut:
        return before
    inside = W.partitionBy("conv", "blk").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)
    own = parts.select("conv", "blk", "sub", *[F.coalesce(f(c).over(inside), zero).alias(c) for c, (f, _) in totals.items()])
    return own.join(before, ["conv", "blk"]).select("conv", "blk", "sub", *[both(F.col(f"before_{c}"), F.col(c)).alias(f"before_{c}") for c, (_, both) in totals.items()])


def positions(turns: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """conv, blk, sub, role, text, pos (from 1), h1, h2 (rolling prefix hashes), n (turns of conv)."""
    t = turns.select(_id(turns).alias("conv"), F.col("turn"), F.col("role"), F.col("text"), F.md5("text").alias("digest"))
    t = t.withColumn("b", F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block).cast("long"))
    # where turn numbers repeat, a block can be of any size: such blocks are cut in the order of their rows
    large = t.groupBy("conv", "b").count().where(F.col("count") > hot).select("conv", "b", F.lit(True).alias("large"))
    cut = not large.isEmpty()
    if cut:
        t = t.join(F.broadcast(large) if large.count() <= MAX_BROADCAST else large, ["conv", "b"], "left")
        # equal rows are counted, then dealt out again in parts
        same = t.groupBy("conv", "b", "large", "turn", "role", "text", "digest").agg(F.count("*").alias("m"))
        same = same.withColumn("k", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / hot))))
        t = same.withColumn("r", F.explode(F.sequence(F.lit(1), F.least(F.lit(hot).cast("long"), F.col("m") - F.col("k") * hot))))
        finer = F.when(F.col("large"), F.struct("turn", "role", F.substring("digest", 1, 3).alias("d")))
        sub = F.when(F.col("large"), F.struct("digest", "k"))
    else:
        finer = sub = F.lit(None).cast("int")
    t = t.select("conv", F.struct("b", finer.alias("f")).alias("blk"), F.struct(sub.alias("s")).alias("sub"), "turn", "role", "text", "digest")
    at = ["conv", "blk", "sub"]
    t = t.withColumn("in_blk", F.row_number().over(W.partitionBy(*at).orderBy("turn", "role", "digest")))
    sizes = t.groupBy(*at).agg(F.count("*").alias("size"))
    whole = sizes.groupBy("conv").agg(F.sum("size").alias("n"))
    skip = _before(sizes, {"size": (F.sum, lambda x, y: x + y)}, cut).join(whole, "conv")
    t = t.join(skip, at).withColumn("pos", F.col("in_blk") + F.col("before_size"))
    part = (F.col("role").isNull(), F.col("role"), F.col("text").isNull(), F.col("text"))
    t = t.withColumn("e1", F.xxhash64("pos", *part)).withColumn("e2", F.xxhash64(F.lit(13), *part, "pos"))
    upto = W.partitionBy(*at).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.withColumn("p1", F.bit_xor("e1").over(upto)).withColumn("p2", F.bit_xor("e2").over(upto))
    sums = t.groupBy(*at).agg(F.bit_xor("e1").alias("s1"), F.bit_xor("e2").alias("s2"))
    xor = (F.bit_xor, lambda x, y: x.bitwiseXOR(y))
    t = t.join(_before(sums, {"s1": xor, "s2": xor}, cut), at)
    h = [F.col(f"p{k}").bitwiseXOR(F.col(f"before_s{k}")).alias(f"h{k}") for k in (1, 2)]
    return t.select(*at, "role", "text", "pos", "n", *h)


def maximal(pos: DataFrame) -> DataFrame:
    """conv of the conversations that no longer one starts with; of equal ones the smallest id."""
    ends = pos.where("pos = n").groupBy("h1", "h2", "n").agg(F.min("conv").alias("conv"), F.count("*").alias("copies"))
    inner = pos.where("pos < n").select("h1", "h2", F.col("pos").alias("n")).distinct()
    return ends.join(inner, ["h1", "h2", "n"], "left_anti").select("conv", "copies")


def render(turns: DataFrame, block: int = BLOCK, template: tuple[str, str] = TEMPLATE) -> DataFrame:
    """conv_id, part (from 0), first_turn, n_turns, copies and the rendered text of maximal conversations."""
    pos = positions(turns, block)
    kept = pos.join(maximal(pos), "conv")
    body = F.concat(F.lit(template[0]), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(template[1] + "\n"))
    kept = kept.select("conv", "copies", ((F.col("pos") - 1) / block).cast("long").alias("part"), "pos", body.alias("body"))
    g = kept.groupBy("conv", "copies", "part").agg(F.array_sort(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    return g.select(
        F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"),
        F.col("part"),
        F.get("parts", F.lit(0))["pos"].cast("long").alias("first_turn"),
        F.size("parts").cast("long").alias("n_turns"),
        F.col("copies"),
        F.array_join(F.transform("parts", lambda p: p["body"]), "").alias("text"),
    )


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = f"""
WITH t AS MATERIALIZED (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos FROM conversations),
s AS (SELECT conv_id, pos, '{TEMPLATE[0]}' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '{TEMPLATE[1]}' || chr(10) AS body FROM t),
c AS MATERIALIZED (SELECT conv_id, count(*) AS n, string_agg(body, '' ORDER BY pos) AS whole FROM s GROUP BY conv_id),
p AS MATERIALIZED (SELECT conv_id, pos, string_agg(body, '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix FROM s),
u AS (SELECT min(conv_id) AS conv_id, whole, n, count(*) AS copies FROM c GROUP BY whole, n),
k AS (SELECT u.* FROM u WHERE NOT EXISTS (SELECT 1 FROM p JOIN c USING (conv_id) WHERE p.pos = u.n AND c.n > u.n AND p.prefix = u.whole))
SELECT conv_id, ((pos - 1) // {BLOCK})::BIGINT AS part, min(pos)::BIGINT AS first_turn, count(*)::BIGINT AS n_turns, copies::BIGINT AS copies,
  string_agg(body, '' ORDER BY pos) AS text FROM k JOIN s USING (conv_id) GROUP BY conv_id, copies, part
"""
