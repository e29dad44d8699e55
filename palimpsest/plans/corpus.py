"""Corpus jobs: curated text with word statistics, and the train/validation corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.text import blank_if_null, strip
from palimpsest.operators.curate import TRAINING_RULE, first_per_key, length_filter, split_validation
from palimpsest.operators.lexical import cumulative_share, word_shares
from palimpsest.sources.writers import write_split


def curated_documents(documents: DataFrame, id_column: str = "doc_id", text: str = "text", low: int = 300, high: int = 2000) -> DataFrame:
    """Stripped texts inside the length bounds, the first of each set of copies."""
    cleaned = documents.select(id_column, strip(blank_if_null(F.col(text))).alias(text))
    inside = cleaned.filter(F.length(text).between(low, high))
    return first_per_key(inside, [text], id_column)


def top_word_report(documents: DataFrame, k: int = 20, **columns) -> DataFrame:
    """The ``k`` most common words of the curated texts with share and cumulative share."""
    return cumulative_share(word_shares(curated_documents(documents, **columns), columns.get("text", "text")), k)


def training_corpus(records: DataFrame, id_columns: list[str], validation_rows: int = 500, seed: int = 42) -> DataFrame:
    """Filtered rewrite records with a ``split`` column."""
    kept = length_filter(records, TRAINING_RULE, keep=tuple(id_columns))
    return split_validation(kept, validation_rows, seed, id_columns)


def write_training_corpus(records: DataFrame, id_columns: list[str], path: str, validation_rows: int = 500, seed: int = 42) -> None:
    write_split(training_corpus(records, id_columns, validation_rows, seed), path)
