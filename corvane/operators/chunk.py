"""Chunkers: one document to many rows. Sizes and places are in bytes of UTF-8."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError, UnalignedSpan
from ..plans.hints import small_batches
from ..registry import REGISTRY


class Piece(NamedTuple):
    ordinal: int
    parent: int | None  # ordinal of the enclosing chunk of the same document
    depth: int
    start: int
    len: int
    label: str | None


SCHEMA = "array<struct<ordinal:int,parent:int,depth:int,start:long,len:int,label:string,text:string>>"


@dataclass(frozen=True)
class Chunker:
    name: str
    pieces: Callable[[bytes], list[Piece]]
    #: The same for texts of ASCII only, as a column of SCHEMA; None if there is no built-in way.
    ascii: Callable[[Column], Column] | None = None


@dataclass(frozen=True)
class FixedConfig:
    size: int = 1024
    overlap: int = 0

    def __post_init__(self) -> None:
        _check(self.size, self.overlap)


@dataclass(frozen=True)
class RecursiveConfig:
    size: int = 1024
    overlap: int = 0
    separators: tuple[str, ...] = tuple("\n\n|\n|. | ".split("|"))

    def __post_init__(self) -> None:
        _check(self.size, self.overlap)
        if "" in self.separators:
            raise ConfigError("a separator is empty")


@dataclass(frozen=True)
class MarkdownConfig:
    leaves_only: bool = False
    max_level: int = 6
    min_bytes: int = 0

    def __post_init__(self) -> None:
        if not 1 <= self.max_level <= 6:
            raise ConfigError("max_level must be 1 to 6")


def _check(size: int, overlap: int) -> None:
    if size <= 0:
        raise ConfigError("size must be positive")
    if not 0 <= overlap < size:
        raise ConfigError("overlap must be less than size")


def _up(data: bytes, at: int) -> int:
    """The next character boundary at or after ``at``."""
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return min(at, len(data))


@REGISTRY.register("chunker", "fixed", "windows of a fixed number of bytes", FixedConfig)
def fixed(c: FixedConfig) -> Chunker:
    def pieces(data: bytes) -> list[Piece]:
        out, start = [], 0
        while start < len(data):
            end = _up(data, start + c.size)
            out.append(Piece(len(out), None, 0, start, end - start, None))
            if end >= len(data):
                break
            following = _up(data, end - c.overlap)
            start = following if following > start else end
        return out

    def ascii_(text: Column) -> Column:
        n, step = F.length(text), c.size - c.overlap
        count = F.greatest(F.ceil((n - c.overlap) / step).cast("int"), F.lit(1))

        def piece(i: Column) -> Column:
            start = i * step
            return F.struct(
                i.alias("ordinal"),
                F.lit(None).cast("int").alias("parent"),
                F.lit(0).alias("depth"),
                start.cast("long").alias("start"),
                F.least(n - start, F.lit(c.size)).alias("len"),
                F.lit(None).cast("string").alias("label"),
                F.substring(text, start + 1, F.lit(c.size)).alias("text"),
            )

        return F.when(n == 0, F.array().cast(SCHEMA)).otherwise(F.transform(F.sequence(F.lit(0), count - 1), piece))

    return Chunker("fixed", pieces, ascii_)


@REGISTRY.register("chunker", "recursive", "splits at ever finer separators, then merges up to a size", RecursiveConfig)
def recursive(c: RecursiveConfig) -> Chunker:
    separators = [s.encode() for s in c.separators]

    def cut(data: bytes, lo: int, hi: int, depth: int, out: list[tuple[int, int]]) -> None:
        if hi - lo <= c.size or depth == len(separators):
            if hi > lo:
                out.append((lo, hi))
            return
        at, sep = lo, separators[depth]
        while (found := data.find(sep, at, hi)) >= 0:
            cut(data, at, found + len(sep), depth + 1, out)
            at = found + len(sep)
        cut(data, at, hi, depth + 1, out)

    def pieces(data: bytes) -> list[Piece]:
        parts: list[tuple[int, int]] = []
        cut(data, 0, len(data), 0, parts)
        out: list[Piece] = []
        i = 0
        while i < len(parts):
            start, j = parts[i][0], i + 1
            while j < len(parts) and parts[j][1] - start <= c.size:
                j += 1
            end = parts[j - 1][1]
            out.append(Piece(len(out), None, 0, start, end - start, None))
            if j == len(parts):
                break
            back = j
            if c.overlap:
                while back > i + 1 and parts[back - 1][0] >= end - c.overlap:
                    back -= 1
            i = back
        return out

    return Chunker("recursive", pieces)


_HEADING = re.compile(rb"^(#{1,6})[ \t](.*)$", re.M)


@REGISTRY.register("chunker", "markdown", "sections under headings, nested by level", MarkdownConfig)
def markdown(c: MarkdownConfig) -> Chunker:
    def pieces(data: bytes) -> list[Piece]:
        heads = [(m.start(), len(m[1]), m[2].decode().strip()) for m in _HEADING.finditer(data) if len(m[1]) <= c.max_level]
        out: list[Piece] = []
        first = heads[0][0] if heads else len(data)
        if first > 0 and len(data[:first].decode().strip().encode()) >= c.min_bytes:
            out.append(Piece(0, None, 0, 0, first, None))
        made: dict[int, int] = {}
        for k, (start, level, title) in enumerate(heads):
            end = next((s for s, lv, _ in heads[k + 1 :] if lv <= level), len(data))
            if c.leaves_only and k + 1 < len(heads) and heads[k + 1][1] > level:
                continue
            if len(data[start:end].decode().strip().encode()) < c.min_bytes:
                continue
            above = next((i for i in range(k - 1, -1, -1) if heads[i][1] < level), None)
            made[k] = len(out)
            out.append(Piece(len(out), made.get(above), level, start, end - start, title))
        return out

    return Chunker("markdown", pieces)


def _udf(chunker: Chunker, text: Column) -> Column:
    pieces = chunker.pieces

    @F.pandas_udf(SCHEMA)
    def run(s: pd.Series) -> pd.Series:
        out = []
        for t in s:
            data = (t or "").encode()
            out.append([p._asdict() | {"text": data[p.start : p.start + p.len].decode()} for p in pieces(data)])
        return pd.Series(out)

    return run(text)


def chunk(docs: DataFrame, name: str = "fixed", config: dict | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (id, chunk_id, ordinal, parent, depth, start, len, label, text) of all chunks.

    Where a chunker has a built-in form for ASCII texts those never enter Python. Null text has
    no chunks. ``parent`` is the ordinal of a chunk of the same document.
    """
    chunker = REGISTRY.build("chunker", name, config)
    small_batches(docs.sparkSession)
    d = docs.select(F.col(id_col), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    plain = F.octet_length("__text") == F.length("__text")

    def rows(part: DataFrame, made: Column) -> DataFrame:
        # the plain explode would add a filter that makes the chunks a second time
        return part.select(F.col(id_col), F.explode_outer(made).alias("c")).where("c is not null").select(id_col, "c.*")

    if chunker.ascii:
        out = rows(d.where(plain), chunker.ascii(F.col("__text"))).unionByName(rows(d.where(~plain), _udf(chunker, F.col("__text"))))
    else:
        out = rows(d, _udf(chunker, F.col("__text")))
    return out.select(id_col, F.concat_ws("#", F.col(id_col).cast("string"), F.col("ordinal").cast("string")).alias("chunk_id"), "ordinal", "parent", "depth", "start", "len", "label", "text")


def span_text(text: str, start: int, length: int) -> str:
    """The text of a byte span; a span that cuts a character is an error."""
    data = text.encode()
    try:
        return data[start : start + length].decode()
    except UnicodeDecodeError:
        raise UnalignedSpan(f"bytes {start} to {start + length} cut a character") from None
