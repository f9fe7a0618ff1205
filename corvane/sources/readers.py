"""Readers of single files, and the ingestion of folders through ``binaryFile``."""

from __future__ import annotations

import codecs
import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError, EngineError
from ..registry import REGISTRY

Extracted = tuple[str, dict[str, Any] | None]


@dataclass(frozen=True)
class TextConfig:
    fallback_encoding: str = ""

    def __post_init__(self) -> None:
        if self.fallback_encoding:
            try:
                codecs.lookup(self.fallback_encoding)
            except LookupError:
                raise ConfigError(f"no encoding {self.fallback_encoding!r}") from None


@dataclass(frozen=True)
class MarkdownReaderConfig:
    front_matter: bool = True


@dataclass(frozen=True)
class HtmlConfig:
    width: int = 10_000

    def __post_init__(self) -> None:
        if self.width <= 0:
            raise ConfigError("width must be positive")


@dataclass(frozen=True)
class CsvConfig:
    delimiter: str = ","
    has_headers: bool = True
    columns: tuple[str, ...] = ()
    max_rows: int = 0

    def __post_init__(self) -> None:
        if len(self.delimiter) != 1 or not self.delimiter.isascii():
            raise ConfigError("delimiter must be one ASCII character")


@dataclass(frozen=True)
class JsonConfig:
    fields: tuple[str, ...] = ()
    label_fields: bool = False

    def __post_init__(self) -> None:
        if any(not f.startswith("/") for f in self.fields):
            raise ConfigError("a pointer begins with /")


@dataclass(frozen=True)
class PdfConfig:
    pass


@dataclass(frozen=True)
class Reader:
    name: str
    extensions: tuple[str, ...]
    read: Callable[[bytes, str], Extracted]


_BOMS = ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16-le"), (codecs.BOM_UTF16_BE, "utf-16-be"))


def decode(data: bytes, fallback: str = "") -> tuple[str, str, bool]:
    """text, encoding and whether signs were replaced: valid UTF-8, else by a byte-order mark, else the fallback."""
    try:
        return data.decode("utf-8"), "utf-8", False
    except UnicodeDecodeError:
        pass
    for mark, name in _BOMS:
        if data.startswith(mark):
            text = data[len(mark) :].decode(name, "replace")
            return text, name, "�" in text
    if fallback:
        text = data.decode(fallback, "replace")
        return text, codecs.lookup(fallback).name, "�" in text
    return data.decode("utf-8", "replace"), "utf-8", True


@REGISTRY.register("reader", "text", "plain text in UTF-8 or a fallback encoding", TextConfig)
def text(c: TextConfig) -> Reader:
    def read(data: bytes, path: str) -> Extracted:
        t, enc, lossy = decode(data, c.fallback_encoding)
        return t, {"encoding": enc, "lossy": lossy}

    return Reader("text", ("txt", "text", "log", "rst"), read)


_PAIR = re.compile(r"^\s*([^:#\s][^:]*?)\s*:\s*(.*?)\s*$")


def split_front_matter(t: str) -> tuple[dict[str, str], str]:
    """The ``key: value`` lines between leading ``---`` lines, and the body after them."""
    if not t.startswith("---\n") or (end := t.find("\n---", 3)) < 0:
        return {}, t
    body = t[end + 4 :]
    pairs = {m[1]: m[2].strip("\"'") for line in t[4:end].split("\n") if (m := _PAIR.match(line))}
    return pairs, body.removeprefix("\n") if body.startswith("\n") else body


def first_h1(t: str) -> str | None:
    return next((line[2:].strip() for line in t.split("\n") if line.startswith("# ")), None)


@REGISTRY.register("reader", "markdown", "markdown as it is; front matter and title become metadata", MarkdownReaderConfig)
def markdown(c: MarkdownReaderConfig) -> Reader:
    def read(data: bytes, path: str) -> Extracted:
        t, enc, lossy = decode(data)
        meta: dict[str, Any] = {"encoding": enc, "lossy": lossy}
        if c.front_matter:
            pairs, t = split_front_matter(t)
            if pairs:
                meta["front_matter"] = pairs
        if title := first_h1(t):
            meta["title"] = title
        return t, meta

    return Reader("markdown", ("md", "markdown", "mdx"), read)


_BLOCKS = frozenset("p div section article header footer main aside ul ol table tr blockquote pre figure form fieldset address dl dt dd hr nav".split())


class _Plain(HTMLParser):
    """Visible text with headings marked by ``#`` and list items by ``*``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def _line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "template", "noscript", "title"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self._line()
            self.out.append("\n" * bool(self.out) + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self._line()
            self.out.append("* ")
        elif tag == "br" or tag in _BLOCKS:
            self._line()
        elif tag in ("td", "th"):
            self.out.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template", "noscript", "title"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in _BLOCKS or tag == "li":
            self._line()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.out.append(re.sub(r"\s+", " ", data))


def html_text(t: str, width: int = 10_000) -> str:
    import textwrap

    p = _Plain()
    p.feed(t)
    p.close()
    lines = [re.sub(r" +", " ", x).strip() for x in "".join(p.out).split("\n")]
    wrapped = [w for x in lines for w in (textwrap.wrap(x, width, break_long_words=False) or [""])]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(wrapped)).strip()


_TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.I | re.S)


def html_title(html: Column) -> Column:
    """The raw title of a page, null if there is none; entities stay as they are."""
    t = F.regexp_replace(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1), r"^\s+|\s+$", "")
    return F.when(t != "", t)


@REGISTRY.register("reader", "html", "visible text of a page, headings marked", HtmlConfig)
def html(c: HtmlConfig) -> Reader:
    def read(data: bytes, path: str) -> Extracted:
        t, enc, lossy = decode(data)
        meta: dict[str, Any] = {"encoding": enc, "lossy": lossy}
        if (m := _TITLE.search(t)) and m[1].strip():
            meta["title"] = m[1].strip()
        return html_text(t, c.width), meta

    return Reader("html", ("html", "htm", "xhtml"), read)


@REGISTRY.register("reader", "csv", "each row as lines of header and field", CsvConfig)
def csv_(c: CsvConfig) -> Reader:
    def read(data: bytes, path: str) -> Extracted:
        t, _, _ = decode(data)
        # a .tsv is split at tabs unless a delimiter was configured
        delimiter = "\t" if c.delimiter == "," and path.lower().endswith(".tsv") else c.delimiter
        rows = [r for r in csv.reader(io.StringIO(t, newline=""), delimiter=delimiter) if r]
        head = rows.pop(0) if c.has_headers and rows else []
        use = None
        if c.columns:
            use = {i for i, h in enumerate(head) if h in c.columns}
            if not use:
                raise ConfigError(f"none of the columns {', '.join(c.columns)} exists")
        rows = rows[: c.max_rows] if c.max_rows else rows
        out = []
        for r in rows:
            lines = []
            for i, v in enumerate(r):
                if v.strip() and (use is None or i in use):
                    lines.append(f"{head[i]}: {v}\n" if i < len(head) else f"{v}\n")
            out.append("".join(lines) + "\n")
        columns = [head[i] for i in sorted(use)] if use is not None else head
        return "".join(out), {"rows": len(rows), "columns": columns}

    return Reader("csv", ("csv", "tsv"), read)


def json_leaves(v: Any) -> Iterator[str]:
    """String leaves, depth first, keys in sorted order; blank ones are skipped."""
    if isinstance(v, str):
        if v.strip():
            yield v
    elif isinstance(v, list):
        for x in v:
            yield from json_leaves(x)
    elif isinstance(v, dict):
        for k in sorted(v):
            yield from json_leaves(v[k])


def json_pointer(v: Any, pointer: str) -> Any:
    """The value at an RFC 6901 pointer, None if there is none."""
    for part in pointer.split("/")[1:]:
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(v, dict) and part in v:
            v = v[part]
        elif isinstance(v, list) and part.isdigit() and int(part) < len(v):
            v = v[int(part)]
        else:
            return None
    return v


def pointer_column(json_text: Column, pointer: str) -> Column:
    """The same for a pointer known in advance: a string as it is, any other value as JSON.

    Built-in, but for keys with a quote or bracket, which paths cannot name. A step of digits is a
    place in an array or a key of an object.
    """
    parts = [p.replace("~1", "/").replace("~0", "~") for p in pointer.split("/")[1:]]
    if any(c in p for p in parts for c in "'[]*?") or "" in parts or sum(p.isdigit() for p in parts) > 4:

        @F.pandas_udf("string")
        def found(s: pd.Series) -> pd.Series:
            def one(t: str | None) -> str | None:
                try:
                    v = json_pointer(json.loads(t), pointer)
                except (TypeError, ValueError):
                    return None
                return v if v is None or isinstance(v, str) else json.dumps(v, separators=(",", ":"), ensure_ascii=False)

            return s.map(one)

        return found(json_text)
    paths = ["$"]
    for p in parts:
        paths = [x + y for x in paths for y in ([f"[{p}]", f"['{p}']"] if p.isdigit() else [f"['{p}']"])]
    return F.coalesce(*[F.get_json_object(json_text, x) for x in paths])


@REGISTRY.register("reader", "json", "string leaves of JSON or JSON-lines records", JsonConfig)
def json_(c: JsonConfig) -> Reader:
    def read(data: bytes, path: str) -> Extracted:
        t, _, _ = decode(data)
        try:
            whole = json.loads(t)
            records = whole if isinstance(whole, list) else [whole]
        except ValueError as first:
            try:
                records = [json.loads(line) for line in t.splitlines() if line.strip()]
            except ValueError as second:
                raise EngineError(f"neither one JSON value ({first}) nor one on each line ({second})") from None
        out = []
        for r in records:
            if c.fields:
                parts = [(f, leaf) for f in c.fields for leaf in json_leaves(json_pointer(r, f))]
                lines = [f"{f.rsplit('/', 1)[-1]}: {leaf}" if c.label_fields else leaf for f, leaf in parts]
            else:
                lines = list(json_leaves(r))
            if lines:
                out.append("\n".join(lines))
        return "\n\n".join(out), {"records": len(records)}

    return Reader("json", ("json", "jsonl", "ndjson"), read)


@REGISTRY.register("reader", "pdf", "the text layer of a PDF, if a PDF library is installed", PdfConfig)
def pdf(c: PdfConfig) -> Reader:
    def read(data: bytes, path: str) -> Extracted:
        try:
            import pypdf
        except ImportError:
            raise EngineError("reading PDF needs the pypdf package") from None
        t = "\n\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(data)).pages)
        return t, {"no_text_layer": not t.strip()}

    return Reader("pdf", ("pdf",), read)


class Readers:
    """Extension to reader; the last registration wins, unknown extensions are read as text."""

    def __init__(self) -> None:
        self.by_ext: dict[str, Reader] = {}
        self.fallback = text(TextConfig())

    def add(self, reader: Reader) -> Readers:
        self.by_ext.update(dict.fromkeys(reader.extensions, reader))
        return self

    def knows(self, path: str) -> bool:
        return extension(path) in self.by_ext

    def of(self, path: str) -> Reader:
        return self.by_ext.get(extension(path), self.fallback)

    @staticmethod
    def standard(front_matter: bool = True) -> Readers:
        r = Readers()
        for made in (text(TextConfig()), markdown(MarkdownReaderConfig(front_matter)), html(HtmlConfig()), csv_(CsvConfig()), json_(JsonConfig()), pdf(PdfConfig())):
            r.add(made)
        return r


def extension(path: str) -> str:
    name = path.replace("\\", "/").rsplit("/", 1)[-1]
    return name.rsplit(".", 1)[1].lower() if "." in name.lstrip(".") else ""


def read_file(path: str, readers: Readers | None = None) -> dict[str, Any]:
    """text and meta of one local file."""
    with open(path, "rb") as f:
        t, meta = (readers or Readers.standard()).of(path).read(f.read(), path)
    return {"text": t, "meta": meta}


def looks_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\x00"))


def ingest(
    spark: SparkSession,
    folder: str,
    max_bytes: int = 64 << 20,
    skip_hidden: bool = True,
    skip_empty: bool = True,
    skip_binary: bool = True,
    max_depth: int = 32,
    readers: Readers | None = None,
) -> DataFrame:
    """uri (relative), reader, text, meta (JSON), bytes and error of the files below a folder.

    Sizes and names are tested before any content is read; a file that cannot be read gives a
    row with an error. Spark's listing leaves out names that begin with a dot or underscore.
    """
    readers = readers or Readers.standard()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.col("length") <= max_bytes)
    root = folder.rstrip("/").split("://")[-1].replace("file:", "")
    uri = F.regexp_replace(F.col("path"), "^.*?" + re.escape(root) + "/+", "")
    files = files.select(uri.alias("uri"), F.col("length").alias("bytes"), "content")
    files = files.where(F.size(F.split("uri", "/")) <= max_depth)
    if skip_hidden:
        files = files.where(~F.col("uri").rlike(r"(^|/)\."))
    known = F.lower(F.regexp_extract("uri", r"[^/]\.([^./]+)$", 1)).isin(list(readers.by_ext))
    if skip_binary:
        files = files.where(known | ~looks_binary(F.col("content")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for u, n, data in zip(b["uri"], b["bytes"], b["content"], strict=True):
                r = readers.of(u)
                try:
                    t, meta = r.read(bytes(data), u)
                    rows.append((u, r.name, t, json.dumps(meta), n, None))
                except Exception as e:  # noqa: BLE001  collected as a row
                    rows.append((u, r.name, None, None, n, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["uri", "reader", "text", "meta", "bytes", "error"])

    out = files.mapInPandas(run, "uri string, reader string, text string, meta string, bytes long, error string")
    return out.where(F.col("error").isNotNull() | F.col("text").rlike(r"\S")) if skip_empty else out


def ingest_stats(ingested: DataFrame) -> DataFrame:
    """One row: files, bytes of their texts, errors."""
    ok = F.col("error").isNull()
    return ingested.agg(
        F.count(F.when(ok, 1)).alias("files"), F.coalesce(F.sum(F.when(ok, F.octet_length("text"))), F.lit(0)).alias("bytes"), F.count(F.when(~ok, 1)).alias("errors")
    )


def from_lists(spark: SparkSession, uris: list[str], texts: list[str], metas: list[str] | None = None) -> DataFrame:
    """doc_id (in the given order), uri, text, meta; the lists must be of one length."""
    if len(uris) != len(texts) or metas is not None and len(metas) != len(texts):
        raise EngineError(f"{len(uris)} uris for {len(texts)} texts")
    rows = [(i, u, t, (metas or [None] * len(texts))[i]) for i, (u, t) in enumerate(zip(uris, texts, strict=True))]
    return spark.createDataFrame(rows, "doc_id long, uri string, text string, meta string")
