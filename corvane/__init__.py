"""Retrieval analytics and training-data operators on PySpark.

The names in ``_PUBLIC`` are the surface for applications; each takes DataFrames and returns one.
They are imported at first use, so that executors load only what a task needs.
"""

from importlib import import_module

_PUBLIC = {
    "catalogue": "registry.catalogue",
    "REGISTRY": "registry.REGISTRY",
    "ConfigError": "errors.ConfigError",
    "EngineError": "errors.EngineError",
    "RetryableError": "errors.RetryableError",
    "from_lists": "sources.readers.from_lists",
    "ingest": "sources.readers.ingest",
    "read_file": "sources.readers.read_file",
    "chunk": "operators.chunk.chunk",
    "bm25_index": "operators.bm25.index",
    "bm25_index_chunks": "operators.bm25.index_chunks",
    "bm25_search": "operators.bm25.search",
    "bm25_search_index": "operators.bm25.search_index",
    "embed": "operators.embed.embed",
    "flat_search": "operators.dense.search",
    "rrf": "operators.fuse.rrf",
    "rm3": "operators.transform.rm3",
    "transform": "operators.transform.apply",
    "rerank_lexical": "operators.judge.rerank_lexical",
    "rerank_with": "operators.judge.rerank_with",
    "verify_coverage": "operators.judge.verify_coverage",
    "verify_with": "operators.judge.verify_with",
    "Task": "plans.task.Task",
    "SYSTEMS": "plans.systems.SYSTEMS",
    "run": "plans.runner.run",
}
__all__ = list(_PUBLIC)


def __getattr__(name: str):
    if name not in _PUBLIC:
        raise AttributeError(name)
    import_module("corvane.components")
    module, _, attribute = _PUBLIC[name].rpartition(".")
    return getattr(import_module(f"corvane.{module}"), attribute)
