"""URL filter: rules by host and path, and for the rest a naive Bayes model over segmented host names.

The labels of a host name are cut into words by the Viterbi algorithm over a unigram model counted from the
words of the pages themselves. Host words and path words are then the tokens of a multinomial naive Bayes
model. It learns from all URLs which words keep company with a few that mark unwanted sites: a host with such
a word is an example to block, any other one to allow.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.common import Batches
from palimpsest.llm.registry import query, table
from palimpsest.session import cut_lineage

#: (host, path, verdict): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Host words that mark a site as an example to block.
MARKS = ("ads", "bets", "casino", "pills", "poker", "porn", "spam", "viagra")
LONGEST_WORD = 20
#: Buckets of the hashed token counts, which bounds the model for any number of tokens.
BUCKETS = 1 << 18
SMOOTHING = 1.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path; both empty for null or without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (host and path together, written ``host/path``), and its verdict; else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, start, answer in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(name + start)).otherwise(rule), F.when(fits, F.lit(answer)).otherwise(verdict)
    return rule, verdict


def word_counts(texts: Column, df: DataFrame) -> DataFrame:
    """``word, n``: lower-case words of letters of all texts (markup cut out), not longer than a segment can be."""
    plain = F.regexp_replace(F.regexp_replace(texts, r"(?s)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|&\w+;", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit(rf"(?<!\p{{L}})\p{{L}}{{1,{LONGEST_WORD}}}(?!\p{{L}})"), F.lit(0))
    return df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def _segments(label: str, costs: dict[str, float], unknown: float) -> list[str]:
    """Cheapest split of a label; a run without known words costs ``unknown`` a letter."""
    best, back = [0.0], [0]
    for end in range(1, len(label) + 1):
        cost, start = best[end - 1] + unknown, end - 1
        for at in range(max(0, end - LONGEST_WORD), end):
            known = costs.get(label[at:end])
            if known is not None and best[at] + known < cost:
                cost, start = best[at] + known, at
        best.append(cost)
        back.append(start)
    out, end, open_run = [], len(label), False
    while end:
        start = back[end]
        part = label[start:end]
        if part in costs or end - start > 1:
            out.append(part)
            open_run = False
        elif open_run:
            out[-1] = part + out[-1]
        else:
            out.append(part)
            open_run = True
        end = start
    return out[::-1]


def segmented_labels(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """``label, words``: the distinct ``label`` strings cut into words of the unigram model ``counts`` (``word, n``).

    Only the substrings of a label that are words travel to it, joined by word; nothing grows on one machine
    with the vocabulary.
    """
    total = counts.agg(F.sum("n")).first()[0] or 0
    length = F.length("label")
    starts = F.explode(F.sequence(F.lit(1), F.greatest(length, F.lit(1)))).alias("at")
    placed = labels.select("label", starts).withColumn("left", F.least(length - F.col("at") + 1, F.lit(LONGEST_WORD)))
    parts = placed.filter("left > 0").select("label", F.explode(F.sequence(F.lit(1), F.col("left"))).alias("size"), "at")
    parts = parts.select("label", F.substring("label", F.col("at"), F.col("size")).alias("word")).distinct()
    known = parts.join(counts, "word").groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    rows = labels.join(known, "label", "left").select("label", "known")

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            words = []
            for label, known in zip(batch.column("label").to_pylist(), batch.column("known").to_pylist(), strict=True):
                costs = {k["word"]: math.log(total / k["n"]) for k in known or ()}
                words.append(_segments(label, costs, math.log(max(total, 2)) + 2.0))
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(words, pa.list_(pa.string()))], names=["label", "words"])

    return rows.mapInArrow(cut, "label string, words array<string>")


def url_tokens(pages: DataFrame, counts: DataFrame) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) plus ``tokens``: words of the host without its last label, words of the path.

    Hosts are cut once each and joined back; a host with very many pages is a key that Spark splits.
    """
    hosts = pages.select("host").distinct()
    names = F.filter(F.split(F.regexp_replace("host", r"\.[^.]*$", ""), r"[^\p{L}]+"), lambda x: x != "")
    cut = hosts.select("host", F.posexplode(names).alias("at", "label"))
    words = segmented_labels(cut.select("label").distinct(), counts)
    by_host = cut.join(words, "label").groupBy("host").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "words"))), lambda x: x["words"])).alias("words"))
    by_host = cut_lineage(by_host)
    path = F.filter(F.split(F.lower("path"), r"[^\p{L}]+"), lambda x: x != "")
    marked = F.concat(F.transform(F.coalesce("words", F.array().cast("array<string>")), lambda w: F.concat(F.lit("h:"), w)), F.transform(path, lambda w: F.concat(F.lit("p:"), w)))
    return pages.join(by_host, "host", "left").withColumn("tokens", marked).drop("words")


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS))


def fit_bayes(tokens: DataFrame, marks: Sequence[str]) -> tuple[np.ndarray, float]:
    """Log odds of ``block`` by token bucket and of the classes; an example to block has a host word of ``marks``.

    The counts of all rows are summed by bucket before they come together, at most ``BUCKETS`` rows. Without
    examples of both classes nothing is blocked.
    """
    block = F.arrays_overlap("tokens", F.array(*[F.lit(f"h:{w}") for w in marks])).cast("int")
    rows = tokens.agg(F.sum(block).alias("block"), F.sum(1 - block).alias("allow")).first()
    if not rows["block"] or not rows["allow"]:
        return np.zeros(BUCKETS, dtype=np.float32), -1.0
    sums = (
        tokens.select(block.alias("block"), F.explode("tokens").alias("token"))
        .groupBy(bucket_of(F.col("token")).alias("bucket"))
        .agg(F.sum("block").alias("block"), F.sum(1 - F.col("block")).alias("allow"))
        .toArrow()
    )
    counts = np.zeros((2, BUCKETS))
    at = sums.column("bucket").to_numpy()
    counts[0, at], counts[1, at] = sums.column("block").to_numpy(), sums.column("allow").to_numpy()
    rates = (counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * len(at))
    return np.log(rates[0] / rates[1]).astype(np.float32), math.log(rows["block"] / rows["allow"])


def judged_urls(
    pages: DataFrame,
    id_column: str = "page_id",
    url: str = "url",
    page_text: str = "html",
    rules: Sequence[tuple[str, str, str]] = RULES,
    marks: Sequence[str] = MARKS,
) -> DataFrame:
    """``id, host, path, rule, verdict, tokens, log_odds`` per row.

    ``rule`` is the longest rule that fits, null if none; ``verdict`` is its answer, else ``block`` where the
    naive Bayes log odds of ``tokens`` are above zero. A null URL, or one without ``://``, has an empty host
    and path and no tokens, and takes the verdict of the classes' shares. Words for the unigram model come
    from ``page_text`` of all rows (null: none) and from ``marks``. Repeated rows are judged alike; other columns are not read.
    """
    spark = pages.sparkSession
    marked = spark.createDataFrame([(w, 1) for w in marks], "word string, n long")
    counts = word_counts(F.col(page_text), pages).union(marked).groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut_lineage(counts)
    host, path = split_url(F.col(url))
    rows = pages.select(F.col(id_column).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = cut_lineage(url_tokens(rows.withColumn("rule", rule).withColumn("verdict", verdict), counts))
    shared = spark.sparkContext.broadcast(fit_bayes(rows, marks))
    hashed = rows.withColumn("buckets", F.transform("tokens", bucket_of))

    def score(batches: Batches) -> Batches:
        weights, prior = shared.value
        for batch in batches:
            buckets = batch.column("buckets")
            sizes = pa.compute.list_value_length(buckets).to_numpy()
            values = np.concatenate([[0.0], np.cumsum(weights[buckets.flatten().to_numpy()], dtype=np.float64)])
            ends = np.cumsum(sizes)
            odds = prior + values[ends] - values[ends - sizes]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["buckets"]).columns, pa.array(odds)], names=[*names, "log_odds"])

    names = rows.columns
    kind = hashed.drop("buckets").withColumn("log_odds", F.lit(0.0)).schema
    scored = hashed.mapInArrow(score, kind)
    learned = F.when(F.col("log_odds") > 0, "block").otherwise("allow")
    return scored.select(
        F.col("id").alias(id_column), "host", "path", "rule", F.coalesce("verdict", learned).alias("verdict"), "tokens", "log_odds"
    )


@query("op3_url_filters")
def op3(spark, folder):
    return judged_urls(table(spark, folder, "pages")).select("page_id", "host", "path", "rule", "verdict")
