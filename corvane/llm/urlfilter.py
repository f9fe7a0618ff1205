"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join.

An entry is a canonical host with a path prefix; it fits its host and all subdomains when the
url's path starts with the entry's path. The suffixes of a url's host are tested in the filter
where the url is read; only a listed host's suffix is combined with the path prefixes of the
lengths that the list has, and those keys are tested too. Keys whose bits are all set reach
the exact join, which removes false positives. A url's keys are put together again by the
number of its row, so that a frequent or empty url is no hot key.

The rules of a list are matched against the url's host and path as they stand; blocked urls of
the list against the canonical host: without user, port and dots at the end. Paths are taken
as they are (percent escapes are not decoded).

Defined cases: a null url or one without ``://`` has an empty host and path and is allowed; a
very long url is cut at its dots and at the list's path lengths only; of entries that fit, the
longest wins (then the one with the longer host, then the greater string, then block);
repeated rows and null ids are kept; an empty list allows everything; an empty table of pages
gives an empty result; further columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Names of blocked sites; with 40 numbered mirrors and three top-level domains each they make the list.
SITES = tuple(f"{a}-{b}" for a in "casino free adult cheap spam ads loan pills slot bet fake virus".split() for b in "win bets x pills farm track fast shop city club".split())
MIRRORS, TOPS = 40, ("com", "net", "org")
BITS_PER_ENTRY = 16
BLOCK_BITS = 256
MAX_FILTER = 1_000_000  # blocks of 32 bytes that are sent to all tasks; more entries share them
MAX_BROADCAST = 500_000  # entries
SALTS = 16


def host_path(url: str = "url") -> tuple[Column, Column]:
    u = F.coalesce(F.col(url), F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    """``host`` in lower case without user, port and dots at the end."""
    return F.regexp_replace(F.translate(host, UPPER, LOWER), r"^.*@|:[0-9]*$|\.+$|\.*:[0-9]*$", "")


def listed_hosts(spark: SparkSession) -> DataFrame:
    """host and path of the built-in list."""
    sites = spark.createDataFrame([(x,) for x in SITES], "site string")
    mirror = F.explode(F.sequence(F.lit(0), F.lit(MIRRORS - 1)))
    names = sites.select("site", mirror.alias("m")).select(F.concat("site", F.when(F.col("m") > 0, F.col("m").cast("string")).otherwise("")).alias("name"))
    names = names.select("name", F.explode(F.array(*map(F.lit, TOPS))).alias("top"))
    return names.select(F.concat("name", F.lit(".example."), "top").alias("host"), F.lit("").alias("path"))


def entries(spark: SparkSession, rules=RULES, listed: DataFrame | None = None) -> DataFrame:
    """The list as a table: key, host, path, action, kind (``rule`` or ``list``); ``listed`` has host and path."""
    own = spark.createDataFrame([(h, p, a, "rule") for h, p, a in rules], "host string, path string, action string, kind string")
    blocked = listed_hosts(spark) if listed is None else listed
    blocked = blocked.where("host is not null").select(canonical_host(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lit("block").alias("action"), F.lit("list").alias("kind"))
    return own.unionByName(blocked.distinct()).withColumn("key", F.concat("host", "path"))


def _place(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    """Block number and the four 64-bit masks (two bits each) of a key."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(7))
    one = F.lit(1).cast("long")
    bit = lambda h, k: F.call_function("shiftleft", one, F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int"))
    return F.pmod(a, F.lit(blocks)).cast("int"), [bit(b, 2 * k).bitwiseOR(bit(b, 2 * k + 1)) for k in range(4)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row, ``bits``: four longs for each block, of the column ``key``."""
    block, masks = _place(F.col("key"), blocks)
    placed = keys.select(block.alias("block"), *[m.alias(f"m{k}") for k, m in enumerate(masks)])
    used = placed.groupBy("block").agg(F.array(*[F.bit_or(f"m{k}") for k in range(4)]).alias("lanes"))
    # at most MAX_FILTER blocks; the first entry of each row says which one it is
    used = used.agg(F.map_from_entries(F.collect_list(F.struct("block", "lanes"))).alias("m"))
    none = F.array(*[F.lit(0).cast("long")] * 4)
    return used.select(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.coalesce(F.element_at("m", i), none))).alias("bits"))


def passes(key: Column, bits: Column, blocks: int) -> Column:
    """Whether the filter ``bits`` may hold ``key``."""
    block, masks = _place(key, blocks)
    out = F.lit(True)
    for k, m in enumerate(masks):
        out = out & (F.get(bits, block * 4 + k).bitwiseAND(m) == m)
    return out


def match(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """``urls`` (host, path and further columns) with ``best``, the best rule, and ``listed``, whether a blocked url fits."""
    labels = F.size(F.split("host", r"\."))
    n, most = listed.agg(F.count("*"), F.max(labels)).first()
    lengths = [r[0] for r in listed.select(F.length("path").alias("n")).distinct().orderBy("n").collect()]  # lengths of paths
    if not n:
        best = F.lit(None).cast("struct<length:int,host:int,key:string,action:string>")
        return urls.select("*", best.alias("best"), F.lit(False).alias("listed"))
    blocks = min(MAX_FILTER, max(1, math.ceil(2 * n * BITS_PER_ENTRY / BLOCK_BITS)))
    # a host's own key has a sign that is in no other key
    keys = listed.select("key").unionByName(listed.select(F.concat(F.lit("\n"), "host").alias("key")))
    bits = bloom(keys, blocks).scalar()

    def suffixes(host: Column) -> Column:
        parts = F.split(host, r"\.")
        first = F.greatest(F.size(parts) - most + 1, F.lit(1))
        return F.transform(F.sequence(first, F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))

    cols = urls.columns
    u = urls.select(F.monotonically_increasing_id().alias("__uid"), F.struct(*cols).alias("__row"), canonical_host(F.col("host")).alias("__c"))
    host, path, none = F.col("__row.host"), F.col("__row.path"), F.array(F.lit(None).cast("string"))
    both = F.when(F.col("__c") == host, suffixes(host)).otherwise(F.array_union(suffixes(host), suffixes(F.col("__c"))))
    # a null suffix keeps the row, whatever the filter says of the others
    e = u.select("*", F.explode(F.concat(none, both)).alias("eh"))
    e = e.where(F.col("eh").isNull() | passes(F.concat(F.lit("\n"), "eh"), bits, blocks))
    heads = F.array_distinct(F.array(*[F.substring(path, 1, k) for k in lengths]))
    e = e.select("*", F.explode(F.when(F.col("eh").isNull(), none).otherwise(heads)).alias("ep"))
    e = e.where(F.col("eh").isNull() | passes(F.concat("eh", "ep"), bits, blocks))
    right = listed.select(F.col("host").alias("eh"), F.col("path").alias("ep"), "key", "action", "kind")
    if n <= MAX_BROADCAST:
        j = e.join(F.broadcast(right), ["eh", "ep"], "left")
    else:
        # a key that very many urls have is dealt to SALTS tasks, and what only keeps a row to all
        e = e.withColumn("salt", F.pmod("__uid", F.lit(SALTS))).withColumn("eh", F.coalesce("eh", F.concat(F.lit("\n"), F.col("__uid").cast("string"))))
        j = e.join(right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), ["eh", "ep", "salt"], "left")
    # the two kinds look at the host in their own ways
    fits = lambda h: (h == F.col("eh")) | F.endswith(h, F.concat(F.lit("."), F.col("eh")))
    best = F.struct(F.length("key").alias("length"), F.length("eh").alias("host"), F.col("key"), F.col("action"))
    g = j.groupBy("__uid").agg(
        F.first("__row").alias("__row"),
        F.max(F.when((F.col("kind") == "rule") & fits(host), best)).alias("best"),
        F.coalesce(F.max((F.col("kind") == "list") & fits(F.col("__c"))), F.lit(False)).alias("listed"),
    )
    return g.select("__row.*", "best", "listed")


def judge(pages: DataFrame, listed: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Per row of ``pages``: ``keep``, host, path, rule and verdict."""
    host, path = host_path()
    v = match(pages.select(*keep, host.alias("host"), path.alias("path")), listed)
    own = F.when(F.col("listed"), F.lit("block")).otherwise("allow")
    return v.select(*keep, "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.action", own).alias("verdict"))


def op9_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), entries(spark))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" for x in r) + ")" for r in rows)


ORACLE = rf"""
WITH p AS (SELECT row_number() OVER () AS u, page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
c AS (SELECT *, regexp_replace(host, '^.*@|:[0-9]*$|\.+$|\.*:[0-9]*$', '', 'g') AS own FROM p),
r(h, q, a) AS (VALUES {_values(RULES)}),
s(site) AS (VALUES {_values([(x,) for x in SITES])}),
l AS (SELECT site || CASE WHEN m > 0 THEN m::VARCHAR ELSE '' END || '.example.' || tld AS h
      FROM s, (SELECT unnest(range({MIRRORS})) AS m), (VALUES {_values([(x,) for x in TOPS])}) AS t(tld)),
fit AS (SELECT u, max_by(h || q, length(h || q)) AS rule, max_by(a, length(h || q)) AS a FROM p, r
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY u),
d AS (SELECT u, string_split(own, '.') AS ps FROM c),
bad AS (SELECT DISTINCT u FROM (SELECT u, array_to_string(ps[i:], '.') AS x FROM (SELECT u, ps, unnest(range(1, len(ps) + 1)) AS i FROM d)) JOIN l ON x = h)
SELECT page_id, host, path, rule, CASE WHEN rule IS NOT NULL THEN a WHEN bad.u IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM p LEFT JOIN fit USING (u) LEFT JOIN bad USING (u)
"""
