"""Importing this module registers all built-in components."""

from .functions import hashing, tokenize  # noqa: F401
from .operators import bm25, chunk, dense, embed, judge, transform  # noqa: F401
from .sources import readers  # noqa: F401
