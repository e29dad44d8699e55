"""Word and n-gram statistics, vocabularies, lexicon joins."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palimpsest.functions.text import letter_words, letters_only, ngrams, normalised_words
from palimpsest.operators.ordering import union_all
from palimpsest.session import small_batches

# Words left out of the explored vocabulary.
BLOCKED_WORDS = (
    "portrayal", "conveying", "convey", "compelling", "compel", "expressing",
    "improving", "retell", "reword", "engaging", "storytelling",
)


def text_words(df: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per whitespace-separated word, reduced to lower-case letters; empty ones dropped."""
    return df.select(*keep, F.explode(letter_words(F.col(text))).alias("word"))


def word_counts(df: DataFrame, text: str) -> DataFrame:
    """Count per word. Counting combines on the map side, so very common words do not skew it."""
    return text_words(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def punctuated_vocabulary(words: DataFrame, marks: tuple[str, ...] = (",", ".", ":")) -> DataFrame:
    """The vocabulary with the marks themselves as extra words."""
    return words.select("word").unionByName(
        words.sparkSession.createDataFrame([(m,) for m in marks], "word string")
    ).distinct()


def word_shares(df: DataFrame, text: str) -> DataFrame:
    """Word count and its share of all words. A word without letters counts as the empty word."""
    words = df.select(F.explode(letter_words(F.col(text), keep_empty=True)).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def top_words(counts: DataFrame, k: int) -> DataFrame:
    return counts.orderBy(F.desc("n"), "word").limit(k)


def cumulative_share(shares: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` most common words with their running share; the window sees those ``k`` rows only."""
    upto = Window.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, 0)
    return top_words(shares, k).withColumn("cumulative_share", F.sum("share").over(upto))


def top_ngrams(df: DataFrame, text: str, n: int = 2, top_n: int = 5) -> DataFrame:
    grams = df.select(F.explode(ngrams(F.col(text), n)).alias("ngram"))
    counts = grams.groupBy("ngram").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "ngram").limit(top_n)


def alphanumeric_word_counts(df: DataFrame, text: str) -> DataFrame:
    words = df.select(F.explode(normalised_words(F.col(text))).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def term_counts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, term, tf``: how often each term stands in each row's text, counted inside the row."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(terms or ()) for terms in batch.column("terms").to_pylist()]
            rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
            columns = [
                batch.column("id").take(pa.array(rows)),
                pa.array([t for c in found for t in c], pa.string()),
                pa.array([n for c in found for n in c.values()], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "term", "tf"])

    small_batches()
    rows = df.select(F.col(doc_id).alias("id"), ngrams(F.col(text), 1).alias("terms"))
    schema = T.StructType([rows.schema["id"], T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
    return rows.mapInArrow(count, schema).withColumnRenamed("id", doc_id)


def tf_idf(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, term, weight``: smoothed idf ``ln((1+N)/(1+df)) + 1`` and unit-length rows; one row per document."""
    counts = term_counts(df, doc_id, text)
    documents = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    frequency = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = frequency.select(
        "term", (F.log((documents + 1).cast("double") / (F.col("df") + 1)) + 1).alias("idf")
    )
    raw = counts.join(idf, "term").select(doc_id, "term", (F.col("tf") * F.col("idf")).alias("raw"))
    # a partition is the term list of one document, never larger than that document
    squared = F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(doc_id))
    return raw.select(doc_id, "term", (F.col("raw") / F.sqrt(squared)).alias("weight"))


#: Words of a lexicon that goes to all rows; a larger one meets the words in a shuffle.
LEXICON_ROWS = 500_000


def mean_polarity(df: DataFrame, row_id: str, text: str, lexicon: DataFrame) -> DataFrame:
    """Mean polarity of a text's words found in a ``(word, polarity)`` lexicon; null when none is.

    A lexicon of up to ``LEXICON_ROWS`` rows, by count, cuts the words where they are: only those it has are shuffled.
    """
    known = lexicon.select("word", "polarity")
    few = known.limit(LEXICON_ROWS + 1).count() <= LEXICON_ROWS
    scored = text_words(df, text, keep=(row_id,)).join(F.broadcast(known) if few else known, "word")
    totals = scored.groupBy(row_id).agg(F.avg("polarity").alias("polarity"))
    return df.select(row_id).join(totals, row_id, "left")


def lexicon_neighbours(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The words themselves and every lemma of every set that contains one of them."""
    sets = lexicon.join(words.select(F.col("word").alias("lemma")).distinct(), "lemma", "left_semi")
    lemmas = lexicon.join(sets.select("synset").distinct(), "synset", "left_semi")
    return words.select("word").union(lemmas.select(F.col("lemma").alias("word"))).distinct()


def merge_vocabularies(vocabularies: list[DataFrame]) -> DataFrame:
    """Distinct words of all lists, cleaned, distinct again."""
    merged = union_all([v.select("word") for v in vocabularies]).distinct()
    return merged.select(letters_only(F.col("word")).alias("word")).distinct()


# Subword tokenizer conventions.
SUBWORD_MARK = "▁"


def clean_token_vocabulary(tokens: DataFrame) -> DataFrame:
    """Words out of a ``(token, is_special)`` subword vocabulary."""
    usable = tokens.filter(~F.col("is_special") & ~F.col("token").isin("", SUBWORD_MARK))
    bare = F.replace(F.col("token"), F.lit(SUBWORD_MARK), F.lit(""))
    words = usable.select(letters_only(bare).alias("word"))
    return words.filter(F.col("word") != "").distinct()


def block_words(words: DataFrame, blocked: tuple[str, ...] = BLOCKED_WORDS) -> DataFrame:
    return words.filter(~F.col("word").isin(*blocked))


def word_count_between(words: Column, low: int = 45, high: int = 55) -> Column:
    return F.size(words).between(low, high)
