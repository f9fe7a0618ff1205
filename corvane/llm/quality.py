"""Quality rules: a threshold table compiled into one projection.

Everything is built-in expressions in one pass over the scan: no shuffle, no Python on the
executors. A text's repeated windows are found inside its own row by sorting window hashes,
so a frequent passage or source moves no rows.

Defined cases: null text has no words (all counts 0, base_failed true, kept false); an empty
table gives an empty result; repeated rows are judged one by one; further columns of the
input, whatever their names, are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, where_fenced

WS = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that it was for on with as be by this from are or an at not he "
    "der die und das den von zu mit sich ist im nicht ein eine als auch auf für des dem er "
    "de la le les et des en un une que est dans du qui pour pas au sur par avec il ce "
    "el los las y del se por con para su al lo como una no si más"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject when ``100 * measure  op  percent * base``; op is ``<`` or ``>``."""

    name: str
    measure: str
    op: str
    percent: int
    base: str

    def fails(self) -> Column:
        left, right = F.col(self.measure) * 100, F.col(self.base) * self.percent
        return left < right if self.op == "<" else left > right

    def sql(self) -> str:
        return f"100*{self.measure} {self.op} {self.percent}*{self.base}"


RULES = (
    Rule("short_words", "word_chars", "<", 150, "n_words"),
    Rule("long_words", "word_chars", ">", 2000, "n_words"),
    Rule("symbols", "n_symbols", ">", 20, "n_words"),
    Rule("stop_words", "n_stop_words", "<", 4, "n_words"),
    Rule("capitals", "n_capitals", ">", 40, "word_chars"),
    Rule("repeated_lines", "n_dup_lines", ">", 30, "n_lines"),
)


def measures(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row of ``docs``: ``keep``, the word, symbol, line and repetition counts."""
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*[F.col(c) for c in keep], t.alias("__t"))
    d = d.withColumn("__w", F.array_remove(F.split("__t", WS), "")).withColumn(
        "__l", F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    )
    d = d.select(
        *keep,
        F.size("__w").cast("long").alias("n_words"),
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("__t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace("__t", "[^A-Z]+", "")).cast("long").alias("n_capitals"),
        F.size(F.filter("__w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    gram = lambda x, i: F.xxhash64(x, *[F.get(F.col("__h"), i + k) for k in range(1, 5)])
    d = d.withColumn("__g", F.transform(F.slice("__h", 1, F.greatest(F.size("__h") - 4, F.lit(0))), gram))
    # only rows with an equal pair of windows pay for the sort
    d = d.withColumn(
        "__s",
        F.when(
            F.size(F.array_distinct("__g")) < F.size("__g"),
            F.sort_array(F.transform("__g", lambda g, i: F.struct(g.alias("g"), i.alias("i")))),
        ),
    )

    def twice(s, j):
        same = lambda k: F.coalesce(F.get(F.col("__s"), j + k)["g"] == s["g"], F.lit(False))
        return F.when(same(-1) | same(1), s["i"])

    places = F.array_sort(F.array_compact(F.transform("__s", twice)))
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    cover = F.aggregate(
        places,
        start,
        lambda a, p: F.struct(F.greatest(a["end"], p + 5).alias("end"), (a["n"] + p + 5 - F.greatest(a["end"], p)).alias("n")),
        lambda a: a["n"],
    )
    return d.withColumn("n_repeat_words", F.coalesce(cover, F.lit(0)).cast("long")).drop("__h", "__g", "__s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Measures, ``base_failed``, ``failed_rules`` (names) and ``kept`` of each row of ``docs``."""
    m = measures(docs, text, keep)
    names = F.array_compact(F.array(*[F.when(r.fails(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    m = m.withColumn("base_failed", base_failed()).withColumn("failed_rules", names)
    return m.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that every rule keeps, with the input's columns."""
    cols = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("__row"), F.col("text").alias("__text"))
    return where_fenced(apply_rules(packed, rules, "__text", ("__row",)), F.col("kept")).select("__row.*")


BASE_COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents")).select(*BASE_COLUMNS, "n_lines", "n_stop_words", "n_capitals")


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT u, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM d),
g AS (SELECT u, i, list_aggregate(ws[i:i+4], 'string_agg', ' ') AS g FROM
      (SELECT u, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT u, i FROM (SELECT u, i, count(*) OVER (PARTITION BY u, g) AS n FROM g) WHERE n > 1),
c AS (SELECT u, count(DISTINCT p) AS n FROM (SELECT u, unnest(range(i, i + 5)) AS p FROM r) GROUP BY u),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
        len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{s}'" for s in STOP_WORDS)})))::BIGINT AS n_stop_words,
        coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (u) LEFT JOIN c USING (u)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(r.sql() for r in RULES)}) AS kept, n_lines, n_stop_words, n_capitals FROM b
"""
