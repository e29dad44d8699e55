"""Token counts of every prefix of a text, kept with it, so that truncation and budgets need no encoding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.bpe import PrefixCounts, tokenizer_path
from palimpsest.llm.common import Batches, kept_in_worker, list_array, map_texts
from palimpsest.llm.registry import query, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def prefix_token_counts(df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, n_bytes, prefix_tokens`` per row: ``prefix_tokens[k]`` is the token count of the first k + 1 characters.

    A null text counts as empty: no bytes, an empty list. Special strings inside a text are one token, as the
    tokenizer reads them by default. Texts are never cut. ``vocabulary`` names a public byte-level BPE
    ``tokenizer.json``. Rows are independent: repeated rows and ids give repeated results; other columns
    are not read.
    """

    def count(batches: Batches) -> Batches:
        counter = kept_in_worker(("prefix counts", vocabulary), lambda: PrefixCounts(tokenizer_path(vocabulary)))
        for batch in batches:
            counts = counter(batch.column("text").to_pylist())
            offsets = np.zeros(len(counts) + 1, dtype=np.int32)
            np.cumsum([len(c) for c in counts], out=offsets[1:])
            flat = np.concatenate(counts) if counts else np.zeros(0, dtype=np.int32)
            sizes = pa.compute.binary_length(batch.column("text")).cast(pa.int64()).fill_null(0)
            columns = [batch.column("id"), sizes, list_array(flat, offsets, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "prefix_tokens"])

    return map_texts(df, id_column, text, count, "n_bytes long, prefix_tokens array<int>", keeps=True)


def total_tokens(prefix_tokens: Column) -> Column:
    """Tokens of the whole text."""
    return F.when(F.size(prefix_tokens) > 0, F.element_at(prefix_tokens, -1)).otherwise(0).cast("long")


def tokens_of_prefix(prefix_tokens: Column, characters: Column | int) -> Column:
    """Tokens of the first ``characters`` characters; the whole text where it is shorter, 0 for none."""
    k = F.least(F.lit(characters) if isinstance(characters, int) else characters, F.size(prefix_tokens))
    return F.when(k > 0, F.get(prefix_tokens, k - 1)).otherwise(0).cast("long")


def longest_prefix(prefix_tokens: Column, budget: int) -> Column:
    """Characters of the longest prefix that takes at most ``budget`` tokens (a count can fall as a word completes)."""
    last = F.aggregate(
        prefix_tokens,
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("best")),
        lambda s, n: F.struct((s["at"] + 1).alias("at"), F.when(n <= budget, s["at"] + 1).otherwise(s["best"]).alias("best")),
        lambda s: s["best"],
    )
    return last.cast("long")


@query("op1_token_counts")
def op1(spark, folder):
    counts = prefix_token_counts(table(spark, folder, "documents"))
    tokens = total_tokens(F.col("prefix_tokens"))
    return counts.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > LIMIT).alias("over_limit"))
