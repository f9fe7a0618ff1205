"""Signed feature hashing of tokens and character windows."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

from ..errors import ConfigError

_OFFSET, _PRIME, _MASK = 0xCBF29CE484222325, 0x100000001B3, 0xFFFFFFFFFFFFFFFF


@dataclass(frozen=True)
class HashingConfig:
    dim: int = 256
    tokenizer: str = "simple"
    ngrams: tuple[int, ...] = (3, 4, 5)
    token_weight: float = 1.0

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ConfigError("dim must be positive")
        if any(n <= 0 for n in self.ngrams):
            raise ConfigError("n-gram widths must be positive")
        if not math.isfinite(self.token_weight) or self.token_weight < 0:
            raise ConfigError("token_weight must be finite and not negative")


def fnv1a(data: bytes) -> int:
    """FNV-1a of 64 bits."""
    h = _OFFSET
    for b in data:
        h = ((h ^ b) * _PRIME) & _MASK
    return h


#: Longer byte strings are hashed one by one, so that one of them does not widen the table of all.
WIDE = 64


def fnv1a_many(parts: list[bytes]) -> np.ndarray:
    """FNV-1a of many byte strings at once; none may hold a zero byte."""
    if not parts:
        return np.zeros(0, "uint64")
    size = np.fromiter(map(len, parts), "int64", len(parts))
    if size.max() > WIDE:
        h = np.array([0 if n <= WIDE else fnv1a(p) for n, p in zip(size, parts, strict=True)], "uint64")
        h[size <= WIDE] = fnv1a_many([p for n, p in zip(size, parts, strict=True) if n <= WIDE])
        return h
    table = np.array(parts, "S")
    table = table.view("uint8").reshape(len(parts), -1)
    h = np.full(len(parts), _OFFSET, "uint64")
    for i in range(table.shape[1]):
        h = np.where(i < size, (h ^ table[:, i]) * np.uint64(_PRIME), h)
    return h


def _feed(h: np.ndarray, sign: np.ndarray, ascii_only: bool) -> np.ndarray:
    """``h`` with the UTF-8 bytes of one more sign each, given as code points."""
    prime = np.uint64(_PRIME)
    if ascii_only:
        return (h ^ sign) * prime
    lead = np.select([sign < 0x80, sign < 0x800, sign < 0x10000], [sign, 0xC0 | sign >> 6, 0xE0 | sign >> 12], 0xF0 | sign >> 18)
    h = (h ^ lead) * prime
    for shift, least in ((12, 0x10000), (6, 0x800), (0, 0x80)):
        h = np.where(sign >= least, (h ^ (0x80 | sign >> shift & 0x3F)) * prime, h)
    return h


#: Signs of tokens whose windows are made at once, and texts whose vectors are.
SIGNS, TEXTS = 1 << 17, 200


class HashingEmbedder:
    """Unit vectors of texts. The windows of a block of tokens are hashed together, and nothing is kept."""

    def __init__(self, config: HashingConfig, split, keep: int = SIGNS):
        self.config, self.split, self.keep = config, split, keep

    def _add(self, out: np.ndarray, tokens: list[str], text: np.ndarray, token: np.ndarray, times: np.ndarray) -> None:
        """Add the features of ``tokens``: pairs of a text's and a token's place with the times it occurs there."""
        # sign by sign, so that a final sigma stays one form
        low = [t.lower() if t.isascii() else "".join(c.lower() for c in t) for t in tokens]
        dim, n = self.config.dim, len(low)
        order = np.argsort(token, kind="stable")
        text, token, times = text[order], token[order], times[order]

        def spread(owner: np.ndarray | None, h: np.ndarray, weight: float) -> None:
            at = (h % np.uint64(dim)).astype("int64")
            value = np.where(h >> np.uint64(63), -weight, weight)
            if owner is None:
                cell, gain = text * dim + at[token], value[token] * times
            else:
                count = np.bincount(owner, minlength=n)
                first = np.cumsum(count) - count
                each = count[token]
                place = np.repeat(first[token] - np.cumsum(each) + each, each) + np.arange(each.sum())
                cell, gain = np.repeat(text * dim, each) + at[place], value[place] * np.repeat(times, each)
            out.reshape(-1)[:] += np.bincount(cell, gain, out.size)

        if self.config.token_weight > 0:
            spread(None, fnv1a_many([t.encode() for t in low]), self.config.token_weight)
        signs = np.frombuffer("".join(f"<{t}>" for t in low).encode("utf-32-le"), "uint32").astype("uint64")
        size = np.fromiter(map(len, low), "int64", n) + 2
        owner, left = np.repeat(np.arange(n), size), np.repeat(np.cumsum(size), size) - np.arange(size.sum())
        plain = bool(signs.max() < 0x80)
        for width in self.config.ngrams:
            start = np.flatnonzero(left >= width)
            h = np.full(len(start), _OFFSET, "uint64")
            for i in range(width if len(start) else 0):
                h = _feed(h, signs[start + i], plain)
            spread(owner[start], h, 1.0)

    def embed(self, text: str | None) -> np.ndarray:
        return self.embed_many([text])[0]

    def _rows(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), self.config.dim))
        place: dict[str, int] = {}
        text, token, times, signs = [], [], [], 0

        def flush() -> None:
            if token:
                self._add(out, list(place), np.array(text), np.array(token), np.array(times, float))
            for x in (place, text, token, times):
                x.clear()

        for i, t in enumerate(texts):
            for word, n in Counter(self.split(t or "")).items():
                text.append(i)
                token.append(place.setdefault(word, len(place)))
                times.append(n)
                signs += len(word)
                if signs >= self.keep:
                    flush()
                    signs = 0
        flush()
        norm = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(norm > 0, norm, 1.0)

    def embed_many(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        texts = list(texts)
        return [row for at in range(0, len(texts), TEXTS) for row in self._rows(texts[at : at + TEXTS])]
