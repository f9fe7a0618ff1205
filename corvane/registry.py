"""Components by kind and name, with strict configuration."""

from __future__ import annotations

import dataclasses
import json
import typing
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .errors import ConfigError, DuplicateComponent, UnknownComponent

KINDS = ("tokenizer", "chunker", "text_index", "vector_store", "embedder", "reader", "transform", "reranker", "verifier")
_TYPES = {int: "integer", float: "number", str: "string", bool: "boolean"}


def json_schema(config: type) -> dict[str, Any]:
    hints, props, required = typing.get_type_hints(config), {}, []
    for f in dataclasses.fields(config):
        t = hints[f.name]
        origin = typing.get_origin(t)
        props[f.name] = {"type": "array" if origin in (list, tuple) else _TYPES.get(t, "object" if origin is dict or dataclasses.is_dataclass(t) else "string")}
        if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING:
            required.append(f.name)
        elif f.default is not dataclasses.MISSING:
            props[f.name]["default"] = dataclasses.asdict(f.default) if dataclasses.is_dataclass(f.default) else f.default
    return {"type": "object", "properties": props, "required": required, "additionalProperties": False}


def parse_config(config: type, given: Any) -> Any:
    """None gives the defaults; unknown keys and wrong types are errors; then the component's own checks."""
    if given is None:
        given = {}
    if dataclasses.is_dataclass(given) and isinstance(given, config):
        return given
    if not isinstance(given, Mapping):
        raise ConfigError(f"{config.__name__}: an object is expected, got {type(given).__name__}")
    hints = typing.get_type_hints(config)
    if unknown := sorted(set(given) - {f.name for f in dataclasses.fields(config)}):
        raise ConfigError(f"{config.__name__}: unknown keys {', '.join(unknown)}")
    values = {}
    for k, v in given.items():
        t = hints[k]
        if t is float and isinstance(v, int) and not isinstance(v, bool):
            v = float(v)
        if typing.get_origin(t) is tuple and isinstance(v, list):
            v = tuple(v)
        if dataclasses.is_dataclass(t) and not dataclasses.is_dataclass(v):
            v = parse_config(t, v)
        plain = t if isinstance(t, type) else None
        if plain in _TYPES and (not isinstance(v, plain) or plain is int and isinstance(v, bool)):
            raise ConfigError(f"{config.__name__}.{k}: {_TYPES[plain]} expected, got {v!r}")
        values[k] = v
    try:
        return config(**values)
    except TypeError as e:
        raise ConfigError(f"{config.__name__}: {e}") from None


@dataclasses.dataclass(frozen=True)
class Entry:
    kind: str
    name: str
    summary: str
    config: type
    build: Callable[[Any], Any]


class Registry:
    def __init__(self) -> None:
        self._entries: dict[tuple[str, str], Entry] = {}

    def register(self, kind: str, name: str, summary: str, config: type) -> Callable:
        """Decorator of a function from a parsed configuration to the component."""

        def wrap(build: Callable[[Any], Any]) -> Callable[[Any], Any]:
            if kind not in KINDS:
                raise ConfigError(f"no such kind: {kind}")
            if (kind, name) in self._entries:
                raise DuplicateComponent(f"{kind} {name!r} is registered already")
            self._entries[kind, name] = Entry(kind, name, summary, config, build)
            return build

        return wrap

    def names(self, kind: str) -> list[str]:
        return sorted(n for k, n in self._entries if k == kind)

    def entry(self, kind: str, name: str) -> Entry:
        if (kind, name) not in self._entries:
            raise UnknownComponent(kind, name, self.names(kind))
        return self._entries[kind, name]

    def build(self, kind: str, spec: str | Mapping, config: Any = None) -> Any:
        """``spec``: a name, or ``{"name": ..., "config": ...}``."""
        if isinstance(spec, Mapping):
            if extra := set(spec) - {"name", "config"}:
                raise ConfigError(f"unknown keys {', '.join(sorted(extra))}")
            spec, config = spec["name"], spec.get("config")
        e = self.entry(kind, spec)
        return e.build(parse_config(e.config, config))

    def describe(self, kind: str, name: str) -> dict[str, Any]:
        e = self.entry(kind, name)
        return {"kind": kind, "name": name, "summary": e.summary, "schema": json_schema(e.config)}

    def catalogue(self) -> list[dict[str, Any]]:
        return [self.describe(k, n) for k, n in sorted(self._entries)]


REGISTRY = Registry()


def catalogue(spark: SparkSession) -> DataFrame:
    """kind, name, summary and schema_json of every registered component."""
    from . import components  # noqa: F401  registers everything

    rows = [(c["kind"], c["name"], c["summary"], json.dumps(c["schema"], sort_keys=True)) for c in REGISTRY.catalogue()]
    return spark.createDataFrame(rows, "kind string, name string, summary string, schema_json string")
