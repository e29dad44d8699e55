"""Batch inference through a user-supplied model, and few-shot assembly."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.functions.parsing import fenced_prompt_list
from palimpsest.functions.text import seeded_int
from palimpsest.operators.ordering import union_all, with_position
from palimpsest.schemas import PROMPT_SUBJECT_LIST
from palimpsest.session import cut_lineage, small_batches

Model = Callable[[Sequence[str]], Sequence[str]]

# Retry rule of the model call.
RETRIES = 3
RETRY_WAIT_SECONDS = 2


def _attempt(model: Model, prompts: list[str], retries: int, wait: float) -> tuple[list[str | None], list[str | None]]:
    error = None
    for attempt in range(retries):
        try:
            answers = list(model(prompts))
            if len(answers) != len(prompts):
                raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
            return answers, [None] * len(prompts)
        except Exception as failure:  # a model may fail in any way; the row records it
            error = f"{type(failure).__name__}: {failure}"
            if attempt + 1 < retries:
                time.sleep(wait)
    if len(prompts) == 1:
        return [None], [error]
    # one bad prompt must not take its batch along
    answers, errors = [], []
    for prompt in prompts:
        a, e = _attempt(model, [prompt], retries, wait)
        answers += a
        errors += e
    return answers, errors


def batch_generate(
    df: DataFrame,
    prompt: str,
    load_model: Callable[[], Model],
    output: str = "generated",
    batch_size: int = 64,
    retries: int = RETRIES,
    wait: float = RETRY_WAIT_SECONDS,
    distinct_prompts: bool = True,
    keep_result: bool = False,
    system: str | None = None,
) -> DataFrame:
    """Add the model's answer and an ``error`` column; failed calls give null, the job goes on.

    ``load_model`` runs once per task and returns a function from prompts to answers. Equal prompts
    are sent once. ``keep_result`` stores the answers in the checkpoint folder, so that later stages
    or lost executors do not call the model again.
    """

    small_batches()
    key = "_prompt_digest"
    if distinct_prompts:
        # joined back by digest, so that rendered prompts do not have to travel with the rows
        keyed = df.withColumn(key, F.sha2(F.col(prompt), 256))
        # equal prompts come to one task, which knows them by digest: no long prompt waits in a hash table or a sort
        asked = keyed.select(key, prompt).filter(F.col(prompt).isNotNull()).repartition(key)
        kept = [asked.schema[key]]
    else:
        asked, kept = df, df.schema.fields
    names = [f.name for f in kept]

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, seen = None, set()
        for pdf in batches:
            if distinct_prompts:
                pdf = pdf[~(pdf[key].isin(seen) | pdf[key].duplicated())]
                seen.update(pdf[key])
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                if model is None:
                    model = load_model() if system is None else partial(load_model(), system=system)
                answers, errors = _attempt(model, part[prompt].tolist(), retries, wait)
                yield part[names].assign(**{output: answers, "error": errors})

    schema = T.StructType([*kept, T.StructField(output, T.StringType()), T.StructField("error", T.StringType())])
    answered = asked.mapInPandas(call, schema)
    if keep_result:
        answered = cut_lineage(answered)
    return keyed.join(answered, key, "left").drop(key) if distinct_prompts else answered


def encode_with(df: DataFrame, text: str, load_encoder: Callable[[], Callable[[Sequence[str]], Sequence]], output: str = "vector", batch_size: int = 256) -> DataFrame:
    """Vectors from a user-supplied encoder, loaded once per task, over the rows in place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for pdf in batches:
            for at in range(0, len(pdf), batch_size):
                part = pdf.iloc[at : at + batch_size]
                if encoder is None:
                    encoder = load_encoder()
                vectors = [[float(x) for x in v] for v in encoder(part[text].tolist())]
                yield part.assign(**{output: vectors})

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.ArrayType(T.DoubleType()))])
    return df.mapInPandas(run, schema)


def known_vectors(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Vectors from a precomputed ``(key, …)`` table."""
    return df.join(vectors, key, "left")


def token_counts(df: DataFrame, text: str, load_tokenizer: Callable[[], Callable[[list[str]], Sequence[int]]], output: str = "tokens") -> DataFrame:
    """Token count of each text by a user-supplied tokenizer, loaded once per task.

    The tokenizer gets the texts of a batch together and returns their counts; a null text has no count.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = None
        for pdf in batches:
            if count is None:
                count = load_tokenizer()
            there = pdf[text].notna()
            found = iter(count(pdf.loc[there, text].tolist()))
            counts = [int(next(found)) if known else None for known in there]
            yield pdf.assign(**{output: pd.Series(counts, index=pdf.index, dtype=object)})

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField(output, T.IntegerType())]))


# ---------------------------------------------------------------------------------------------
# few-shot examples

def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once however often it is used."""
    return F.transform(F.array(value), lambda held: use(held))[0]


def drawn_positions(n: Column, k: int, seed: int | str, *identity: Column) -> Column:
    """``k`` different positions below ``n`` (all, where there are no more), in drawn order, by hash of the identity.

    The j-th draw is a rank among the positions still free, so no draw is ever made twice, whatever ``n``.
    """

    def with_draw(held: Column, j: int) -> Column:
        left = n - j
        rank = F.pmod(seeded_int(f"{seed}-{j}", *identity).cast("bigint"), F.greatest(left, F.lit(1).cast("bigint")))
        one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
        place = F.aggregate(F.array_sort(held), rank, lambda at, p: at + F.when(at >= p, one).otherwise(none))
        return F.when(left > 0, F.array_append(held, place)).otherwise(held)

    taken = F.array().cast("array<bigint>")
    for j in range(k):
        # bound as a lambda variable, so that the draws so far are worked out once
        taken = _bound(taken, partial(with_draw, j=j))
    return taken


def drawn_examples(df: DataFrame, seeds: DataFrame, row_id: str, seed_id: str, rendered: Column, k: int, seed: int, output: str = "drawn") -> DataFrame:
    """``row_id`` and the array of ``k`` pseudo-random seed examples, rendered, in drawn order.

    Seeds are numbered by ``seed_id``; every row draws different numbers, and the drawn ones meet the seeds in a join,
    so there may be any number of seeds. ``row_id`` is unique; without seeds the arrays are empty.
    """
    numbered = cut_lineage(with_position(seeds.select(F.col(seed_id).alias("_seed"), rendered.alias("_text")), "_seed", "_slot").select("_slot", "_text"))
    size = F.lit(numbered.count()).cast("bigint")
    wanted = df.select(row_id).withColumn("_slots", drawn_positions(size, k, seed, F.col(row_id)))
    cells = wanted.select(row_id, F.posexplode_outer("_slots").alias("_at", "_slot"))
    met = cells.join(numbered, "_slot", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("_at").isNotNull(), F.struct("_at", "_text"))))
    return met.groupBy(row_id).agg(F.transform(ordered, lambda c: c["_text"]).alias(output))


def random_examples(
    df: DataFrame, seeds: DataFrame, row_id: str, seed_id: str, rendered: Column, k: int, seed: int, separator: str = "\n", output: str = "examples"
) -> DataFrame:
    """Add ``k`` pseudo-random seed examples per row, rendered and joined in the drawn order (see ``drawn_examples``)."""
    drawn = drawn_examples(df, seeds, row_id, seed_id, rendered, k, seed, "_drawn")
    joined = df.join(drawn, row_id, "left").withColumn(output, F.coalesce(F.array_join("_drawn", separator), F.lit("")))
    return joined.select(*df.columns, output)


def fixed_examples(df: DataFrame, seeds: DataFrame, seed_id: str, rendered: Column, n: int | None = None, separator: str = "\n", output: str = "examples") -> DataFrame:
    """Add all, or the first ``n``, seed examples in id order; the same text on every row, so as long as the seeds are."""
    rows = seeds.select(F.col(seed_id).alias("_seed"), rendered.alias("_text"))
    if n is not None:
        rows = rows.orderBy("_seed").limit(n)
    ordered = F.array_sort(F.collect_list(F.struct("_seed", "_text")))
    text = rows.agg(F.array_join(F.transform(ordered, lambda s: s["_text"]), separator).alias("text"))
    return df.withColumn(output, text.scalar())


def nearest_examples(neighbours: DataFrame, examples: DataFrame, example_id: str, rendered: Column, separator: str = "\n", output: str = "examples") -> DataFrame:
    """Join each query's nearest examples (``query, neighbour, rank``) into one text, best first."""
    texts = examples.select(F.col(example_id).alias("neighbour"), rendered.alias("_text"))
    found = neighbours.join(texts, "neighbour")
    # k rows per query, k being the number of neighbours asked for
    ordered = F.array_sort(F.collect_list(F.struct("rank", "_text")))
    return found.groupBy("query").agg(
        F.array_join(F.transform(ordered, lambda s: s["_text"]), separator).alias(output)
    )


def bootstrap_prompts(
    seeds: DataFrame,
    load_model: Callable[[], Model],
    render: Callable[[Column], Column],
    rounds: int = 10,
    examples: int = 5,
    runs: int = 1,
    seed: int = 27003,
    system: str | None = None,
) -> DataFrame:
    """Grow a ``(prompt, subject)`` table: each round's parsed answers become examples of the next.

    ``render`` turns the JSON list of examples into the prompt. Runs are independent rows of one
    job per round; an answer that does not parse adds nothing. Returns the seeds and all additions
    with ``run`` and ``round`` (0 for the seeds).
    """
    spark = seeds.sparkSession
    base = seeds.select("prompt", "subject")
    shown = base.withColumn("id", F.struct("prompt", "subject"))
    rows = spark.range(runs).select(F.col("id").cast("int").alias("run"))
    start = drawn_examples(rows, shown, "run", "id", F.to_json(F.struct("prompt", "subject")), examples, seed, "context")
    state = cut_lineage(start.select("run", "context", F.lit(0).alias("round")))
    added = []
    for number in range(1, rounds + 1):
        listing = F.concat(F.lit("["), F.array_join("context", ", "), F.lit("]"))
        asked = state.withColumn("_prompt", render(listing))
        answered = batch_generate(asked, "_prompt", load_model, "_answer", wait=0.0, distinct_prompts=False, system=system)
        parsed = cut_lineage(
            answered.withColumn("new", F.coalesce(fenced_prompt_list(F.col("_answer")), F.array().cast(PROMPT_SUBJECT_LIST)))
        )
        added.append(
            parsed.select("run", F.lit(number).alias("round"), F.explode("new").alias("p")).select(
                "run", "round", F.col("p.prompt").alias("prompt"), F.col("p.subject").alias("subject")
            )
        )
        fresh = F.transform("new", lambda p: F.to_json(p))
        state = parsed.select("run", F.concat("context", fresh).alias("context"), F.lit(number).alias("round"))
    first = base.select(F.lit(None).cast("int").alias("run"), F.lit(0).alias("round"), "prompt", "subject")
    return union_all([first, *added])
