"""Streams.

None of the operators here keeps state between micro-batches. The row-wise ones (the expressions in
``palimpsest.functions``, ``length_filter``, template rendering, and joins against a static table
such as ``keep_listed`` and ``drop_seen``) accept a streaming DataFrame as they are;
``curated_stream`` is that composition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from palimpsest.operators.curate import GENERAL_RULE, drop_seen, length_filter


def curated_stream(
    stream: DataFrame, seen: DataFrame | None = None, keys: tuple[str, ...] = ("original_text",), rule=GENERAL_RULE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Normalise and length-filter a stream of rewrite records and drop texts of a static table."""
    rows = length_filter(stream, rule, keep)
    return rows if seen is None else drop_seen(rows, seen, list(keys))
