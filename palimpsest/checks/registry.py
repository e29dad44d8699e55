"""Registry of queries and their SQL, and the views both sides share.

The views are written once in Spark and once in SQL. ``with_views`` puts the SQL of the named views
in front of a query.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palimpsest.functions.digests import numbered_md5
from palimpsest.functions.text import WHITESPACE_CLASS
from palimpsest.functions.vectors import encode_text
from palimpsest.session import new_folder
from palimpsest.sources.readers import spread_small

Query = Callable[[SparkSession, str], DataFrame]
#: Tasks for each core that the examples of the token tables are dealt to.
TOKEN_TASKS = 8
#: Pairs of an example and a benchmark prompt that a task is to have.
TASK_PAIRS = 50_000
#: Tokens of an example at most that are hashed together.
TOKEN_BLOCK = 32_768

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None):
    def register(query: Callable[["Tables"], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: query(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return query

    return register


class Tables:
    """The driver tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def documents(self) -> DataFrame:
        return self.read("documents")

    @property
    def spread_documents(self) -> DataFrame:
        """The documents for queries that take every text apart."""
        return spread_small(self.documents.select("doc_id", "text"))

    @property
    def embeddings(self) -> DataFrame:
        return self.read("embeddings")

    @property
    def labels(self) -> DataFrame:
        return self.read("labels")

    @property
    def benchmark(self) -> DataFrame:
        return self.read("benchmark")

    @property
    def user_turns(self) -> DataFrame:
        """User turns, spread over the cores where the file has fewer splits than that."""
        turns = self.read("conversations").filter(F.col("role") == "user")
        return spread_small(turns.select("conv_id", "turn", "text"))

    @property
    def prompts(self) -> DataFrame:
        """User turns: ``prompt_id, rewrite_prompt``."""
        return self.user_turns.select((F.col("conv_id") * 65536 + F.col("turn")).alias("prompt_id"), F.col("text").alias("rewrite_prompt"))

    @property
    def rewrites(self) -> DataFrame:
        """User turn, the assistant turn after it, and a document dealt to the pair."""
        turns = self.read("conversations")
        asked = self.user_turns.withColumnRenamed("text", "rewrite_prompt")
        answered = turns.filter(F.col("role") == "assistant").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("rewritten_text")
        )
        size = self.documents.agg((F.max("doc_id") + 1).alias("n")).scalar()
        pairs = asked.join(answered, ["conv_id", "turn"]).withColumn(
            "doc_id", F.pmod(F.col("conv_id") * 7919 + F.col("turn") * 31, size)
        )
        texts = self.documents.select("doc_id", F.col("text").alias("original_text"), F.col("source").alias("dataset_id"))
        words = F.slice(F.regexp_extract_all("rewrite_prompt", F.lit(r"\p{L}+"), F.lit(0)), 1, 3)
        return pairs.join(texts, "doc_id").select(
            (F.col("conv_id") * 65536 + F.col("turn")).alias("rewrite_id"),
            "original_text",
            "rewrite_prompt",
            "rewritten_text",
            F.array_join(words, ", ").alias("subject"),
            "dataset_id",
        )

    @property
    def prompt_vectors(self) -> DataFrame:
        return self.prompts.select(F.col("prompt_id").alias("id"), encode_text(F.col("rewrite_prompt")).alias("vector"))

    @property
    def benchmark_vectors(self) -> DataFrame:
        return self.benchmark.select(F.col("item_id").alias("id"), encode_text(F.col("text")).alias("vector"))

    @property
    def document_vectors(self) -> DataFrame:
        return self.spread_documents.select(F.col("doc_id").alias("id"), encode_text(F.col("text")).alias("vector"))

    @property
    def token_blocks(self) -> DataFrame:
        """``example_id, candidate, candidates, pos, tokens``: each rewrite with words, cut into blocks of its tokens.

        A block is ``candidates`` benchmark prompts from ``candidate`` on beside ``tokens`` words from ``pos`` on. A
        short row here stands for many tokens, so the examples are dealt to tasks by id before they are spread out: a
        file of few splits would leave all tokens to as few tasks. What is asked per example stays in its task. Tasks
        grow in number with the user turns, so that a task's pairs have room in an aggregate's fast table.
        """
        words = F.size(F.filter(F.split("rewritten_text", WHITESPACE_CLASS + "+"), lambda w: w != ""))
        rows = self.rewrites.select(F.col("rewrite_id").alias("example_id"), words.alias("n")).filter("n > 0")
        pairs = self.read("conversations").filter(F.col("role") == "user").count() * self.benchmark.count()
        tasks = max(TOKEN_TASKS * self.spark.sparkContext.defaultParallelism, ceil(pairs / TASK_PAIRS))
        size = self.benchmark.agg(F.max("item_id").alias("n")).scalar()
        run = F.least("n", F.lit(TOKEN_BLOCK))
        beside = F.floor(F.lit(TOKEN_BLOCK) / run)
        dealt = rows.repartition(tasks, "example_id").select("example_id", "n", run.alias("run"), beside.alias("beside"))
        cut = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), size, F.col("beside"))).alias("candidate"))
        cut = cut.withColumn("candidates", F.least("beside", size - F.col("candidate") + 1).cast("int"))
        cut = cut.select("*", F.explode(F.sequence(F.lit(1), "n", F.col("run"))).alias("pos"))
        return cut.select("example_id", "candidate", "candidates", "pos", F.least("run", F.col("n") - F.col("pos") + 1).alias("tokens"))

    @property
    def token_logprobs(self) -> DataFrame:
        """Hashed stand-in for a model's token log-probabilities.

        One row per rewrite, benchmark prompt, and word of the rewritten text. The digests of a block are made together
        in numpy, grouped by example so that its rows stay where they are.
        """
        block = ("example_id", "candidate", "candidates", "pos", "tokens")
        hashed = self.token_blocks.groupBy(*block).agg(hashed_tokens(*block).alias("values"))
        lists = hashed.select(*block[:4], F.posexplode("values").alias("beside", "values"))
        candidate = (F.col("candidate") + F.col("beside") % F.col("candidates")).alias("candidate_id")
        tokens = lists.select("example_id", candidate, "pos", F.posexplode("values").alias("place", "value"))
        logprob = -(1 + F.col("value").cast("long")) / 250.0
        return tokens.select("example_id", "candidate_id", (F.col("pos") + F.col("place")).alias("pos"), logprob.alias("logprob"))

    def scratch(self) -> str:
        """New folder below the shared folder, for what a query writes and reads back."""
        return new_folder(self.spark)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.ShortType())))
def hashed_tokens(example: pa.Array, candidate: pa.Array, candidates: pa.Array, pos: pa.Array, tokens: pa.Array) -> list[np.ndarray]:
    """MD5 of example, candidate and place of each token of a block, modulo 1000: a list for each candidate.

    A block that comes in several rows has its lists as many times.
    """
    rows, example, candidate, n, pos, tokens = len(example), *(c[0].as_py() for c in (example, candidate, candidates, pos, tokens))
    heads = [f"{example}#{c}#".encode() for c in range(candidate, candidate + n)]
    values = numbered_md5(heads, np.arange(pos, pos + tokens)) % np.uint32(1000)
    return list(values.astype(np.int16)) * rows


def rounded(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


# ---------------------------------------------------------------------------------------------
# SQL side

VIEWS = {
    "prompts": """prompts AS (
  SELECT conv_id * 65536 + turn AS prompt_id, text AS rewrite_prompt FROM conversations WHERE role = 'user')""",
    "rewrites": r"""rewrites AS (
  SELECT u.conv_id * 65536 + u.turn AS rewrite_id, d.text AS original_text, u.text AS rewrite_prompt,
         a.text AS rewritten_text,
         array_to_string(list_slice(regexp_extract_all(u.text, '\p{L}+'), 1, 3), ', ') AS subject,
         d.source AS dataset_id
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  JOIN documents d ON d.doc_id = (u.conv_id * 7919 + u.turn * 31) % (SELECT max(doc_id) + 1 FROM documents)
  WHERE u.role = 'user')""",
}


def sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_words(text: str) -> str:
    return f"list_filter(regexp_split_to_array({text}, '{WHITESPACE_CLASS}+'), lambda w: w <> '')"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$', '', 'g')"


def sql_letters(text: str) -> str:
    return rf"lower(regexp_replace({text}, '[^\p{{L}} ]', '', 'g'))"


def sql_key(seed: int | str, *parts: str) -> str:
    return f"md5(concat_ws('#', '{seed}', {', '.join(parts)}))"


def sql_int(seed: int | str, *parts: str) -> str:
    return f"('0x' || substr({sql_key(seed, *parts)}, 1, 8))::BIGINT"


def sql_vectors(name: str, source: str, position_weight: float = 0.0) -> str:
    """Views that end in ``name(id, v)``: hashed word-vector encoding of a ``(id, text)`` query."""
    return f"""{name}_l AS (SELECT id, {sql_words('text')} AS words FROM ({source})),
{name}_w AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM {name}_l),
{name}_d AS (SELECT word, i,
    ('0x' || substr(md5(word || '#' || (i // 8)), 4 * (i % 8) + 1, 4))::BIGINT / 32768::DOUBLE - 1 AS x
  FROM (SELECT DISTINCT word FROM {name}_w), range(16) r(i)),
{name}_s AS (SELECT id, i, sum(x * (1 + {position_weight}::DOUBLE * pos)) AS x FROM {name}_w JOIN {name}_d USING (word) GROUP BY id, i),
{name} AS (SELECT id, list(x / nrm ORDER BY i) AS v
  FROM (SELECT id, i, x, sqrt(sum(x * x) OVER (PARTITION BY id)) AS nrm FROM {name}_s) GROUP BY id)"""


LOGPROBS_SQL = f"""token_logprobs AS (
  SELECT example_id, candidate_id, pos,
         -(1 + ('0x' || substr(md5(concat_ws('#', example_id, candidate_id, pos)), 1, 8))::BIGINT % 1000) / 250::DOUBLE AS logprob
  FROM (SELECT rewrite_id AS example_id, candidate_id, unnest(range(1, n + 1)) AS pos
        FROM (SELECT rewrite_id, len({sql_words('rewritten_text')}) AS n FROM rewrites), range((SELECT max(item_id) + 1 FROM benchmark)) c(candidate_id)))"""


def with_views(query: str, *views: str, recursive: bool = False) -> str:
    """Put views in front of a query: names from ``VIEWS`` or literal ``name AS (…)`` text."""
    parts = [VIEWS.get(v, v) for v in views]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n" + query
