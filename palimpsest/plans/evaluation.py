"""Evaluation jobs: render → generate → parse → predict → score."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest import prompt_texts as texts
from palimpsest.functions.parsing import first_line
from palimpsest.functions.templates import render
from palimpsest.functions.text import pick_word
from palimpsest.functions.vectors import cubed_cosine, encode_text
from palimpsest.operators.evaluate import lowest_nll, mean_token_nll, rerank_by_centre
from palimpsest.operators.generate import Model, batch_generate, fixed_examples, nearest_examples

Encoder = Callable[[Column], Column]


def score_generated(
    records: DataFrame,
    generated: str,
    truth: str = "rewrite_prompt",
    template: str = texts.PREDICTION,
    encoder: Encoder = encode_text,
    remove: tuple[str, ...] = (),
    strip_first: bool = False,
) -> DataFrame:
    """Add ``predicted`` (the template around the answer's first line) and its |cos³| to the truth.

    ``remove`` takes marks out of the answer first, ``strip_first`` skips blank lines before its first one.
    """
    answer = first_line(F.col(generated), remove, strip_first)
    predicted = records.withColumn("predicted", render(template, generated=answer))
    return predicted.withColumn("score", cubed_cosine(encoder(F.col("predicted")), encoder(F.col(truth))))


def evaluate_model(records: DataFrame, load_model: Callable[[], Model], task: str = texts.SUBJECT_TASK, template: str = texts.PREDICTION, encoder: Encoder = encode_text) -> DataFrame:
    """Scores of a model's predictions for rewrite records, one row each."""
    asked = records.withColumn("_ask", render(task))
    answered = batch_generate(asked, "_ask", load_model, "generated").drop("_ask")
    return score_generated(answered, "generated", template=template, encoder=encoder)


def likeliest_prompt_scores(logprobs: DataFrame, candidates: DataFrame, truths: DataFrame, encoder: Encoder = encode_text) -> DataFrame:
    """Per example, the candidate prompt with the lowest NLL and its |cos³| to the true prompt.

    ``candidates`` is ``example_id, candidate_id, prompt``, or ``candidate_id, prompt`` where all examples have the same
    ones; ``truths`` is ``example_id, rewrite_prompt``.
    """
    keys = [c for c in ("example_id", "candidate_id") if c in candidates.columns]
    chosen = lowest_nll(mean_token_nll(logprobs)).join(candidates, keys)
    paired = chosen.join(truths, "example_id")
    return paired.withColumn("score", cubed_cosine(encoder(F.col("prompt")), encoder(F.col("rewrite_prompt"))))


def evaluate_fewshot(
    records: DataFrame,
    seeds: DataFrame,
    seed_id: str,
    load_model: Callable[[], Model],
    num_examples: int = 10,
    neighbours: DataFrame | None = None,
    row_id: str = "rewrite_id",
    task: str = texts.FEWSHOT_TASK,
    case: str = texts.FEWSHOT_CASE,
    example: str = texts.FEWSHOT_EXAMPLE,
    template: str = texts.PREDICTION,
    encoder: Encoder = encode_text,
) -> DataFrame:
    """Scores of predictions made from examples: ``seeds`` are records whose prompt is known.

    The examples are the first ``num_examples`` seeds, the same for every record, or those of ``neighbours``
    (``query, neighbour, rank``, such as ``nearest_rows`` gives), best first; a record without any gets none.
    """
    if neighbours is None:
        shown = fixed_examples(records, seeds, seed_id, render(example), num_examples)
    else:
        found = nearest_examples(neighbours, seeds, seed_id, render(example)).withColumnRenamed("query", row_id)
        shown = records.join(found, row_id, "left").withColumn("examples", F.coalesce("examples", F.lit("")))
    asked = shown.withColumn("_ask", render(task, case=render(case)))
    answered = batch_generate(asked, "_ask", load_model, "generated").drop("_ask", "examples")
    return score_generated(answered, "generated", template=template, encoder=encoder, remove=('"',), strip_first=True)


WORD_SLOT = "{xxx}"


def central_likely_prompts(
    logprobs: DataFrame, candidates: DataFrame, truths: DataFrame, k: int = 15, seed: int = 0, slot: str = WORD_SLOT, encoder: Encoder = encode_text
) -> DataFrame:
    """Per example, of its ``k`` likeliest candidates the one nearest to their mean, with its slot filled, and its score.

    ``candidates`` is ``candidate_id, prompt``, every one of them scored for every example in ``logprobs``; ``truths``
    is ``example_id, rewrite_prompt``. The slot gets a pseudo-random word of the true prompt with five letters or
    more, or nothing where there is none. Returns ``example_id, candidate_id, predicted, score``; the run's result is
    ``mean_score`` of it.
    """
    vectors = candidates.select("candidate_id", encoder(F.col("prompt")).alias("vector"))
    chosen = rerank_by_centre(mean_token_nll(logprobs), vectors, k).drop("distance")
    paired = chosen.join(candidates.select("candidate_id", "prompt"), "candidate_id").join(truths, "example_id")
    word = F.coalesce(pick_word(F.col("rewrite_prompt"), seed, F.col("example_id")), F.lit(""))
    filled = paired.withColumn("predicted", F.replace("prompt", F.lit(slot), word))
    score = cubed_cosine(encoder(F.col("predicted")), encoder(F.col("rewrite_prompt")))
    return filled.select("example_id", "candidate_id", "predicted", score.alias("score"))
