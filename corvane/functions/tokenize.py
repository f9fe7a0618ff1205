"""Tokenizers, as column expressions and as Python twins for code inside Arrow functions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..registry import REGISTRY


@dataclass(frozen=True)
class SimpleConfig:
    min_len: int = 1
    keep: tuple[str, ...] = ("_",)

    def __post_init__(self) -> None:
        if any(len(c) != 1 for c in self.keep):
            raise ConfigError("keep: single characters are expected")


@dataclass(frozen=True)
class UnicodeConfig:
    min_len: int = 0


@dataclass(frozen=True)
class Tokenizer:
    """``terms(col)``: array of tokens as written; ``split(text)``: the same in Python."""

    name: str
    terms: Callable[[Column], Column]
    split: Callable[[str], list[str]]

    def lowered(self, text: Column) -> Column:
        """Lower-cased after splitting, so that one token never becomes two."""
        return F.transform(self.terms(text), lambda t: F.lower(t))


def _char_class(chars: tuple[str, ...]) -> str:
    return "".join("\\" + c if not c.isalnum() and c != "_" and ord(c) < 128 else c for c in chars)


@cache
def _compiled(pattern: str):
    import regex

    return regex.compile(pattern)


@REGISTRY.register("tokenizer", "simple", "maximal runs of letters, digits and kept characters", SimpleConfig)
def simple(config: SimpleConfig) -> Tokenizer:
    kept = _char_class(config.keep)
    pattern = rf"[\p{{IsAlphabetic}}\p{{N}}{kept}]+"

    def terms(text: Column) -> Column:
        found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 0)
        return found if config.min_len <= 1 else F.filter(found, lambda t: F.octet_length(t) >= config.min_len)

    def split(text: str) -> list[str]:
        return [t for t in _compiled(rf"[\p{{Alphabetic}}\p{{N}}{kept}]+").findall(text) if len(t.encode()) >= config.min_len]

    return Tokenizer("simple", terms, split)


def unicode_words(text: str) -> list[str]:
    """Word-boundary segments with a letter or digit in them (default Unicode word rules)."""
    try:
        import regex
    except ImportError:
        return re.findall(r"\w+(?:['’.]\w+)*", text)
    return [s for s in regex.split(r"(?V1w)\b", text) if any(c.isalnum() for c in s)]


@REGISTRY.register("tokenizer", "unicode", "segments between Unicode word boundaries that hold a letter or digit", UnicodeConfig)
def unicode(config: UnicodeConfig) -> Tokenizer:
    def split(text: str) -> list[str]:
        return [t for t in unicode_words(text) if len(t.encode()) >= config.min_len]

    def terms(text: Column) -> Column:
        @F.pandas_udf("array<string>")
        def segments(s: pd.Series) -> pd.Series:  # no built-in gives exact word boundaries
            return s.map(lambda t: split(t or ""))

        return segments(text)

    return Tokenizer("unicode", terms, split)


def sentence_words(text: Column) -> Column:
    """Approximation of ``unicode`` by built-ins only."""
    return F.flatten(F.sentences(F.coalesce(text, F.lit(""))))


_WORD = re.compile(r"\w+")


def folded_words(text: str) -> list[str]:
    """Lower-cased before splitting at non-word characters."""
    return _WORD.findall(text.lower())


def build(spec: str | dict) -> Tokenizer:
    return REGISTRY.build("tokenizer", spec)
