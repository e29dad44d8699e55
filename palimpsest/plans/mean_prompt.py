"""The prompt that best matches a whole corpus of prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from palimpsest.functions.text import letters_only
from palimpsest.functions.vectors import encode_text
from palimpsest.operators.lexical import merge_vocabularies, word_counts
from palimpsest.operators.scoring import CorpusVectors, corpus_moments
from palimpsest.operators.search import SearchState, beam_search, plain_text
from palimpsest.session import cut_lineage
from palimpsest.sources.writers import load_state, save_state


def search_vocabulary(corpora: list[tuple[DataFrame, str]], extra: list[DataFrame] = ()) -> DataFrame:
    """Words of several corpora and further word lists, cleaned and distinct."""
    lists = [word_counts(df, text).select("word") for df, text in corpora]
    return merge_vocabularies([*lists, *extra]).filter(F.col("word") != "")


def find_mean_prompt(
    spark: SparkSession,
    prompts: DataFrame,
    text: str,
    vocabulary: DataFrame,
    beam_width: int = 100,
    num_steps: int = 50,
    encoder: Callable[[Column], Column] = encode_text,
    state_path: str | None = None,
    alpha: float | None = None,
    way: str = "moments",
) -> SearchState:
    """Beam search over the vocabulary; with ``state_path`` every step is saved and a rerun resumes.

    ``way`` is ``moments`` (one pass over the corpus, few components) or ``passes`` (any number of components;
    the encoded corpus is written once and read in every step).
    """
    corpus = prompts.select(encoder(letters_only(F.col(text))).alias("vector"))
    moments = corpus_moments(corpus, "vector") if way == "moments" else CorpusVectors(cut_lineage(corpus), "vector")
    words = vocabulary.select("word").persist()
    try:
        return beam_search(
            words,
            moments,
            beam_width,
            num_steps,
            encoder,
            plain_text,
            alpha,
            resume=load_state(spark, state_path) if state_path else None,
            after_step=(lambda s: save_state(spark, s, state_path)) if state_path else None,
        )
    finally:
        words.unpersist()
