"""Synthetic rewrite data: sources → conditioned prompts → prompt variants → rewritten texts → judged."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from palimpsest import prompt_texts as texts
from palimpsest.functions.parsing import drop_opening_remark, embedded_json, judge_flag, labelled_fields, subject_answer
from palimpsest.functions.templates import render
from palimpsest.operators.curate import CONDITIONED_RULE, cap_per_source, fan_out, within
from palimpsest.operators.generate import Model, batch_generate, bootstrap_prompts, fixed_examples, random_examples

Loader = Callable[[], Model]


def sample_sources(sources: DataFrame, id_columns: list[str], min_len: int = 300, max_len: int = 2500, max_size: int = 200, seed: int = 27007) -> DataFrame:
    return cap_per_source(sources, "original_text", "dataset_id", id_columns, min_len, max_len, max_size, seed)


def conditioned_prompts(sources: DataFrame, row_id: str, seeds: DataFrame, seed_id: str, load_model: Loader, num_examples: int = 5, seed: int = 27007) -> DataFrame:
    """Per source text, a model-written ``type, prompt, subject`` from a few random examples."""
    shown = random_examples(sources, seeds, row_id, seed_id, render(texts.CONDITIONED_EXAMPLE), num_examples, seed)
    asked = shown.withColumn("_ask", render(texts.CONDITIONED_TASK)).drop("examples")
    answered = batch_generate(asked, "_ask", load_model, "_answer")
    fields = labelled_fields(F.coalesce("_answer", F.lit("")))
    return answered.withColumn("_f", fields).select(*sources.columns, "_f.type", "_f.prompt", "_f.subject")


def rewritten_texts(conditioned: DataFrame, variants: DataFrame, load_model: Loader, missing: str = "error") -> DataFrame:
    """Every prompt and each of its variants applied to its text; opening remarks are dropped."""
    inside = conditioned.filter(within(CONDITIONED_RULE))
    spread = fan_out(inside, variants, "prompt", "variants", missing).withColumnRenamed("prompt", "rewrite_prompt")
    asked = spread.withColumn("_ask", render(texts.CHAT_TURN, prompt=render(texts.REWRITE_REQUEST)))
    answered = batch_generate(asked, "_ask", load_model, "_answer")
    return answered.withColumn("rewritten_text", drop_opening_remark(F.col("_answer"))).drop("_ask", "_answer")


def free_prompts(seeds: DataFrame, load_model: Loader, rounds: int = 10, examples: int = 5, runs: int = 1, seed: int = 27003) -> DataFrame:
    """Prompts with their subjects, grown from ``seeds`` (``prompt, subject``) round by round; see ``bootstrap_prompts``."""
    ask = lambda listing: render(texts.FREE_PROMPTS_TASK, examples=listing)
    return bootstrap_prompts(seeds, load_model, ask, rounds, examples, runs, seed, texts.FREE_PROMPTS_SYSTEM)


def expanded_prompts(prompts: DataFrame, load_model: Loader, num_prompts: int = 4, prompt: str = "rewrite_prompt") -> DataFrame:
    """``prompt, variants``: other wordings of each different prompt, by a model that answers in JSON.

    A prompt whose answer lacks the list, or that got none, is left out; null prompts are not asked about.
    """
    asked = prompts.select(F.col(prompt).alias("prompt")).filter("prompt is not null").distinct()
    rendered = asked.withColumn("_ask", render(texts.EXPANSION_TASK, num_prompts=F.lit(str(num_prompts)), rewrite_prompt=F.col("prompt")))
    answered = batch_generate(rendered, "_ask", load_model, "_answer", system=texts.EXPANSION_SYSTEM, distinct_prompts=False)
    variants = embedded_json(F.col("_answer"), "rewritten_prompts array<string>")["rewritten_prompts"]
    return answered.select("prompt", variants.alias("variants")).filter("variants is not null")


def judged(records: DataFrame, load_model: Loader) -> DataFrame:
    """Add ``is_well_written`` from a judge model's JSON answer."""
    asked = records.withColumn("_ask", render(texts.JUDGE_TASK))
    answered = batch_generate(asked, "_ask", load_model, "_answer", system=texts.JUDGE_SYSTEM)
    return answered.withColumn("is_well_written", judge_flag(F.col("_answer"))).drop("_ask", "_answer", "error")


def subjects(records: DataFrame, seeds: DataFrame, seed_id: str, load_model: Loader) -> DataFrame:
    """Add the ``subject`` a model extracts from each rewrite prompt."""
    shown = fixed_examples(records, seeds, seed_id, render(texts.SUBJECT_EXAMPLE))
    asked = shown.withColumn("_ask", render(texts.SUBJECT_EXTRACTION_TASK)).drop("examples")
    answered = batch_generate(asked, "_ask", load_model, "_answer", system=texts.SUBJECT_SYSTEM)
    parsed = subject_answer(F.coalesce("_answer", F.lit("")))
    return answered.withColumn("subject", parsed).drop("_ask", "_answer", "error")
