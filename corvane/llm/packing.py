"""Best-fit packing planned over a histogram of lengths.

A document's ids are cut into pieces of at most ``size``. Only the histogram of piece lengths
(at most ``size`` numbers) reaches the driver, where best-fit decreasing runs over counts:
equal sequences stay one group, so the plan's size depends on ``size`` and not on the
documents. Each plan entry gives a length, a range of ranks, a first sequence and an offset;
pieces take their slots by joining on their rank within their length.

Ranks are counted within salted parts of a length and shifted by the parts' sizes, so a
length that a third of all pieces share is no single task.

Defined cases: null text is empty, and an empty document is the single end id; a very long
text is encoded whole and cut into many pieces; repeated rows are packed one by one (equal
pieces may swap places); a null doc_id is kept; an empty table gives an empty result; further
columns, whatever their names, are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_texts, stored, table

SIZE = 2048
END_ID = 0
#: Characters whose classes (letter, digit, space, other) all regex engines agree on.
_PLAIN = frozenset(map(chr, [*range(9, 14), *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x250)])) | frozenset(
    "¡¿«»–—‘’“”…€"
)
_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of a byte-level vocabulary file, as arrays of unsigned 32-bit numbers.

    ``tokenizers`` defines them. Its ids for texts of plain characters are the same as those
    that tiktoken gives with the file's own ranks, several times faster; all other texts, and
    those that hold a special token literally, go through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.slow = Tokenizer.from_file(path)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        special = self.special = {t.content for t in self.slow.get_added_tokens_decoder().values()}
        ranks = {bytes(byte[c] for c in t): i for t, i in self.slow.get_vocab().items() if t not in special}
        self.fast = tiktoken.Encoding(os.path.basename(path), pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if (text.isascii() and text.isprintable() or _PLAIN.issuperset(text)) and not any(map(text.__contains__, self.special)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4")


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: all of ``size`` but perhaps the first."""
    first = n % size or size
    return [(0, first)] + [(s, size) for s in range(first, n, size)] if n > size else [(0, n)]


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ``ids``) of the pieces of all documents."""
    path = vocabulary or default_vocabulary()
    id_type = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        enc = _ENCODERS[path]
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.append(enc.encode(text or ""), np.uint32(END_ID))
                for k, (start, length) in enumerate(cut(len(ids), size)):
                    own = ids[start : start + length]
                    rows.append((doc, k, start, length, zlib.crc32(own.tobytes()), *([own.astype("int32")] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])])

    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return map_texts(docs.select("doc_id", "text"), run, schema)


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts.

    Entries (length, first rank, count, first sequence, offset): the ``count`` pieces of that
    length from ``first rank`` on take ``offset`` in as many consecutive sequences. Also the
    number of sequences.
    """
    open_: dict[int, list[list]] = {}  # remaining room -> groups [count, [(length, first rank, offset)]]
    rooms: list[int] = []

    def put(room: int, group: list) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append(group)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            k = bisect_left(rooms, length)
            if k < len(rooms):
                room = rooms[k]
                count, items = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(k)
            else:
                room, count, items = size, left, []
            # the tightest room stays the tightest until less than one length is left in it
            each = min(room // length, left)
            use = min(count, left // each)
            if not items:
                count = use
            elif use < count:
                put(room, [count - use, [(n, r + use, o) for n, r, o in items]])
            more = [(length, rank + i * use, size - room + i * length) for i in range(each)]
            put(room - each * length, [use, [*items, *more]])
            rank += each * use
            left -= each * use
    out, seq = [], 0
    for groups in open_.values():
        for count, items in groups:
            out += [(n, r, count, seq, o) for n, r, o in items]
            seq += count
    return out, seq


def assign(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` with sequence_id and offset; ``parts`` must be stored, as it is read twice."""
    spark = parts.sparkSession
    histogram = {r["length"]: r["count"] for r in parts.groupBy("length").count().collect()}  # at most ``size`` rows
    slots, _ = plan(histogram, size)
    salts = spark.createDataFrame(
        [(n, max(1, round(c / max(128, c**0.5)))) for n, c in histogram.items()], "length long, salts long"
    )
    p = parts.join(F.broadcast(salts), "length")  # at most ``size`` rows
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.rand(7)), F.col("salts"))).drop("salts")
    p = stored(p, "ranked")  # the salt is drawn once
    own = W.partitionBy("length", "salt").orderBy("doc_id", "piece")
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    skip = p.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("skip"))
    p = p.withColumn("in_salt", F.row_number().over(own)).join(skip, ["length", "salt"])
    p = p.withColumn("rank", F.col("in_salt") - 1 + F.col("skip"))
    s = spark.createDataFrame(slots, "length long, first long, count long, seq long, offset long")
    # the plan has a few entries for each length, whatever the number of documents
    j = p.join(F.broadcast(s), (p.length == s.length) & (p["rank"] >= s["first"]) & (p["rank"] < s["first"] + s["count"]))
    return j.select(*[p[c] for c in parts.columns], (s["seq"] + p["rank"] - s["first"]).alias("sequence_id"), s["offset"])


def pack(docs: DataFrame, size: int = SIZE, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids), sequence_id and offset of every piece."""
    return assign(stored(pieces(docs, size, vocabulary, with_ids), "pieces"), size)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids, from ``pack(..., with_ids=True)``; each has at most ``size`` ids."""
    g = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids"))).alias("p"))
    return g.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
