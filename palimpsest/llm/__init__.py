"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

from palimpsest.llm import (  # noqa: F401  (importing registers their queries)
    alignment,
    decontaminate,
    language,
    near_vectors,
    ngram_join,
    pieces,
    quality,
    secret_scans,
    token_counts,
    token_files,
    toxicity,
    url_filter,
    vector_codes,
)
from palimpsest.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
