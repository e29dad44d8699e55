"""Registered queries over the driver tables, each with the SQL that gives the same result."""

from palimpsest.checks import (  # noqa: F401  (importing registers the queries)
    curation,
    evaluation,
    generation,
    lexical,
    search,
    sources,
    text,
    vectors,
)
from palimpsest.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
