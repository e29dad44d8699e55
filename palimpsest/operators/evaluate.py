"""Evaluation: similarity and likelihood scores, per-group choices, running means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.text import REST
from palimpsest.functions.vectors import cubed_cosine, squared_distance, to_double
from palimpsest.operators.scoring import score_in_passes


def mean_score(df: DataFrame, score: str = "score") -> DataFrame:
    return df.agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))


def mean_score_by(df: DataFrame, groups: list[str], score: str = "score") -> DataFrame:
    return df.groupBy(*groups).agg(F.avg(score).alias("mean_score"), F.count(score).alias("n"))


def aligned_metric(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean signed cos³ over aligned rows. Cache the truth side when it serves several runs."""
    return df.agg(F.avg(cubed_cosine(F.col(truth), F.col(predicted), signed=True)).alias("metric"))


def mean_token_nll(logprobs: DataFrame, keys: tuple[str, ...] = ("example_id", "candidate_id")) -> DataFrame:
    """Mean negative log-likelihood of the answer tokens per example and candidate."""
    return logprobs.groupBy(*keys).agg(F.negative(F.avg("logprob")).alias("nll"))


def pick_row(df: DataFrame, groups: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row per group in the given order, as a map-side combined minimum."""
    key = F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)])
    best = df.groupBy(*groups).agg(F.min_by(F.struct(*columns), key).alias("_best"))
    return best.select(*groups, *[F.col(f"_best.{c}").alias(c) for c in columns])


def lowest_nll(nll: DataFrame, digits: int = 9) -> DataFrame:
    """Candidate with the lowest (rounded) NLL per example; ties go to the smaller candidate id."""
    return pick_row(nll, ["example_id"], [F.round("nll", digits), F.col("candidate_id")], ["candidate_id", "nll"])


def rerank_by_centre(nll: DataFrame, candidates: DataFrame, k: int, candidate_id: str = "candidate_id", vector: str = "vector", digits: int = 9) -> DataFrame:
    """Of the ``k`` likeliest candidates per example, the one nearest to their common mean.

    Returns ``example_id, candidate_id, distance``. Groups hold at most ``k`` rows after the first
    ranking, whose own input is one row per candidate of an example.
    """
    ranked = Window.partitionBy("example_id").orderBy(F.round("nll", digits), candidate_id)
    kept = nll.withColumn("_r", F.row_number().over(ranked)).filter(F.col("_r") <= k).drop("_r")
    vectors = kept.join(candidates.select(candidate_id, to_double(F.col(vector)).alias("_v")), candidate_id)
    entries = F.collect_list(F.struct(F.col(candidate_id), F.col("_v")))
    grouped = vectors.groupBy("example_id").agg(F.array_sort(entries).alias("_all"))

    def centre(entries: Column) -> Column:
        total = F.aggregate(
            F.slice(entries, 2, REST),
            entries[0]["_v"],
            lambda t, e: F.zip_with(t, e["_v"], lambda x, y: x + y),
        )
        return F.transform(total, lambda x: x / F.size(entries))

    with_centre = grouped.withColumn("_c", centre(F.col("_all")))
    near = F.transform(
        "_all",
        lambda e: F.struct(
            F.round(F.sqrt(squared_distance(e["_v"], F.col("_c"))), digits).alias("distance"),
            e[candidate_id].alias(candidate_id),
        ),
    )
    best = with_centre.select("example_id", F.array_min(near).alias("_b"))
    return best.select("example_id", F.col(f"_b.{candidate_id}").alias(candidate_id), F.col("_b.distance").alias("distance"))


def constant_prompt_scores(df: DataFrame, truth: str, prompts: DataFrame, prompt_id: str, vector: str) -> DataFrame:
    """``prompt_id, mean_score, n``: mean |cos³| of each constant prompt against every row's own prompt."""
    scores = score_in_passes(prompts, df, prompt_id, vector, truth, absolute=True)
    return scores.withColumnRenamed("score", "mean_score")
