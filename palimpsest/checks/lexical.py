"""Word counts, n-grams, TF-IDF and vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.checks.registry import Tables, check, rounded, sql_letters, sql_words, with_views
from palimpsest.functions import text as tx
from palimpsest.operators import lexical

_COUNTS = f"""counts AS (SELECT word, count(*) AS n FROM (SELECT {sql_letters('w')} AS word
  FROM (SELECT unnest({sql_words('text')}) AS w FROM documents)) WHERE word <> '' GROUP BY word)"""


@check("word_counts", with_views("SELECT word, n FROM counts", _COUNTS))
def _(t: Tables):
    return lexical.word_counts(t.spread_documents, "text")


@check("top_words", with_views("SELECT word, n FROM counts ORDER BY n DESC, word LIMIT 1000", _COUNTS))
def _(t: Tables):
    return lexical.top_words(lexical.word_counts(t.spread_documents, "text"), 1000)


@check(
    "punctuated_vocabulary",
    with_views(
        f"""SELECT DISTINCT {sql_letters('w')} AS word FROM (SELECT unnest({sql_words('rewrite_prompt')}) AS w FROM prompts)
        WHERE {sql_letters('w')} <> '' UNION SELECT unnest([',', '.', ':'])""",
        "prompts",
    ),
)
def _(t: Tables):
    return lexical.punctuated_vocabulary(lexical.word_counts(t.prompts, "rewrite_prompt"))


@check(
    "word_shares",
    f"""SELECT word, n, round(n / sum(n) OVER (), 9) AS share FROM (SELECT {sql_letters('w')} AS word, count(*) AS n
      FROM (SELECT unnest({sql_words('lower(text)')}) AS w FROM documents) GROUP BY 1)""",
)
def _(t: Tables):
    return lexical.word_shares(t.spread_documents, "text").withColumn("share", rounded("share", 9))


@check(
    "cumulative_word_share",
    f"""WITH shares AS (SELECT word, n, n / sum(n) OVER () AS share FROM (SELECT {sql_letters('w')} AS word, count(*) AS n
        FROM (SELECT unnest({sql_words('lower(text)')}) AS w FROM documents) GROUP BY 1)),
      top20 AS (SELECT * FROM shares ORDER BY n DESC, word LIMIT 20)
    SELECT word, n, round(sum(share) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING), 9) AS cumulative_share FROM top20""",
)
def _(t: Tables):
    shares = lexical.cumulative_share(lexical.word_shares(t.spread_documents, "text"))
    return shares.select("word", "n", rounded("cumulative_share", 9).alias("cumulative_share"))


@check(
    "top_bigrams",
    r"""WITH tokens AS (SELECT regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM documents)
    SELECT ngram, count(*) AS n FROM (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS ngram
      FROM tokens) GROUP BY ngram ORDER BY n DESC, ngram LIMIT 50""",
)
def _(t: Tables):
    return lexical.top_ngrams(t.spread_documents, "text", 2, 50)


@check(
    "alphanumeric_word_counts",
    rf"""SELECT word, count(*) AS n FROM (SELECT lower(regexp_replace(w, '[^\p{{L}}\p{{N}}]', '', 'g')) AS word
      FROM (SELECT unnest({sql_words('text')}) AS w FROM documents)) WHERE word <> '' GROUP BY word""",
)
def _(t: Tables):
    return lexical.alphanumeric_word_counts(t.spread_documents, "text")


@check(
    "tf_idf",
    r"""WITH terms AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY doc_id, term),
      idf AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (count(*) + 1)) + 1 AS idf FROM tf GROUP BY term),
      raw AS (SELECT doc_id, term, tf * idf AS raw FROM tf JOIN idf USING (term))
    SELECT doc_id, term, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)), 6) AS weight FROM raw""",
)
def _(t: Tables):
    return lexical.tf_idf(t.spread_documents, "doc_id", "text").withColumn("weight", rounded("weight"))


# A stand-in for a synonym lexicon: words of the documents that share five leading letters and a length.
_LEXICON = f"""lexicon AS (SELECT DISTINCT word AS lemma, substr(word, 1, 5) || len(word) AS synset FROM counts)"""


def _lexicon(t: Tables):
    words = lexical.word_counts(t.spread_documents, "text")
    synset = F.concat(F.substring("word", 1, 5), F.length("word").cast("string"))
    return words.select(F.col("word").alias("lemma"), synset.alias("synset"))


@check(
    "lexicon_neighbours",
    with_views(
        f"""SELECT word FROM starts UNION SELECT lemma FROM lexicon WHERE synset IN
          (SELECT synset FROM lexicon WHERE lemma IN (SELECT word FROM starts))""",
        _COUNTS,
        _LEXICON,
        f"""starts AS (SELECT DISTINCT {sql_letters('w')} AS word FROM (SELECT unnest({sql_words('text')}) AS w FROM benchmark)
          WHERE {sql_letters('w')} <> '')""",
    ),
)
def _(t: Tables):
    return lexical.lexicon_neighbours(lexical.word_counts(t.benchmark, "text"), _lexicon(t))


@check(
    "clean_token_vocabulary",
    f"""SELECT DISTINCT {sql_letters("replace(token, '▁', '')")} AS word FROM (
      SELECT CASE WHEN len(w) % 2 = 0 THEN '▁' || w ELSE w END AS token, starts_with(w, 'T') AS special
      FROM (SELECT unnest({sql_words('text')}) AS w FROM documents) UNION ALL SELECT '▁', false)
    WHERE NOT special AND token NOT IN ('', '▁') AND {sql_letters("replace(token, '▁', '')")} <> ''""",
)
def _(t: Tables):
    words = t.spread_documents.select(F.explode(tx.split_words(F.col("text"))).alias("w"))
    marked = F.when(F.length("w") % 2 == 0, F.concat(F.lit(lexical.SUBWORD_MARK), F.col("w"))).otherwise(F.col("w"))
    tokens = words.select(marked.alias("token"), F.startswith("w", F.lit("T")).alias("is_special"))
    return lexical.clean_token_vocabulary(tokens)


@check("block_words", with_views("SELECT word, n FROM counts WHERE word NOT IN ('the', 'of', 'la', 'und')", _COUNTS))
def _(t: Tables):
    return lexical.block_words(lexical.word_counts(t.spread_documents, "text"), ("the", "of", "la", "und"))


@check(
    "word_count_range",
    with_views(f"SELECT prompt_id FROM prompts WHERE len({sql_words('rewrite_prompt')}) BETWEEN 25 AND 40", "prompts"),
)
def _(t: Tables):
    words = tx.split_words(F.col("rewrite_prompt"))
    return t.prompts.filter(lexical.word_count_between(words, 25, 40)).select("prompt_id")


@check(
    "merged_vocabulary",
    with_views(
        f"""SELECT DISTINCT {sql_letters('word')} AS word FROM (SELECT word FROM counts
          UNION SELECT unnest({sql_words('rewrite_prompt')}) FROM prompts
          UNION SELECT unnest({sql_words('text')}) FROM benchmark)""",
        _COUNTS,
        "prompts",
    ),
)
def _(t: Tables):
    raw = [
        t.prompts.select(F.explode(tx.split_words(F.col("rewrite_prompt"))).alias("word")),
        t.benchmark.select(F.explode(tx.split_words(F.col("text"))).alias("word")),
    ]
    return lexical.merge_vocabularies([lexical.word_counts(t.spread_documents, "text"), *raw])
