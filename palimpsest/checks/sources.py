"""Readers and writers: the driver tables written out in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest import schemas
from palimpsest.checks.registry import Tables, check, rounded, sql_strip, with_views
from palimpsest.operators import search
from palimpsest.operators.curate import split_validation
from palimpsest.sources import readers, writers

_REWRITES = with_views("SELECT original_text, rewrite_prompt, rewritten_text, subject FROM rewrites", "rewrites")
_RECORDS = ("original_text", "rewrite_prompt", "rewritten_text", "subject")


def _json_lines(df: DataFrame, value, path: str) -> None:
    """One JSON document per row, each on its own line."""
    df.select(value.alias("value")).write.text(path)


@check("csv_round_trip", _REWRITES)
def _(t: Tables):
    path = writers.write_csv(t.rewrites.select(*_RECORDS), t.scratch())
    return readers.read_csv(t.spark, path, schemas.REWRITE_SUBJECT)


@check(
    "csv_files_with_different_headers",
    with_views(
        """SELECT original_text, rewrite_prompt, rewritten_text, subject FROM rewrites
        UNION ALL SELECT original_text, rewrite_prompt, rewritten_text, NULL FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    first = writers.write_csv(t.rewrites.select(*_RECORDS), t.scratch())
    second = writers.write_csv(t.rewrites.select("rewritten_text", "original_text", "rewrite_prompt"), t.scratch())
    return readers.read_csv_files(t.spark, [first, second], schemas.REWRITE_SUBJECT).drop("source_file")


@check(
    "csv_folder_with_run_ids",
    with_views("SELECT dataset_id, original_text, run FROM rewrites, (SELECT unnest(['a', 'b']) AS run)", "rewrites"),
)
def _(t: Tables):
    folder = t.scratch()
    for run in ("a", "b"):
        writers.write_csv(t.rewrites.select("original_text", "dataset_id"), folder, run)
    table = readers.read_csv_folder(t.spark, f"{folder}/*/*.csv", schemas.SOURCE_TEXT)
    run = F.regexp_extract("source_file", r"/([ab])/[^/]*$", 1)
    return table.select("dataset_id", "original_text", run.alias("run"))


@check("parquet_round_trip", "SELECT doc_id, text, lang FROM documents")
def _(t: Tables):
    path = writers.write_parquet(t.documents.select("doc_id", "text", "lang"), t.scratch(), "run-1")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType())])
    return readers.read_parquet(t.spark, path, schema)


@check(
    "wide_embedding_columns",
    """SELECT original_text, part, i - 1 AS i, embedding[i]::DOUBLE * k AS x FROM (
      SELECT CAST(vec_id AS VARCHAR) AS original_text, embedding FROM embeddings),
      (VALUES ('original_text', 1), ('rewrite_prompt', 2), ('rewritten_text', 4)) parts(part, k), range(1, 65) r(i)""",
)
def _(t: Tables):
    wide = t.embeddings.select(
        F.col("vec_id").cast("string").alias("original_text"),
        F.concat(F.lit("p"), "vec_id").alias("rewrite_prompt"),
        F.concat(F.lit("r"), "vec_id").alias("rewritten_text"),
        *[(F.col("embedding")[i].cast("double") * 2**k).alias(f"{c}_emb_{i}") for k, c in enumerate(readers.TEXTS) for i in range(64)],
    )
    folded = readers.read_wide_embeddings(wide, dim=64)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("part"), F.col(f"{c}_vector").alias("v")) for c in readers.TEXTS])).alias("p")
    cells = folded.select("original_text", parts).select("original_text", "p.part", F.posexplode("p.v").alias("i", "x"))
    return cells.select("original_text", "part", F.col("i").cast("long").alias("i"), F.col("x").cast("double").alias("x"))


@check(
    "json_prompt_list",
    with_views("SELECT rewrite_prompt FROM prompts UNION ALL SELECT upper(CAST(prompt_id AS VARCHAR)) FROM prompts", "prompts"),
)
def _(t: Tables):
    folder = t.scratch()
    _json_lines(t.prompts, F.to_json(F.array("rewrite_prompt", F.col("prompt_id").cast("string"))), folder)
    return readers.read_prompt_list(t.spark, folder, per_line=True)


@check(
    "json_prompt_objects",
    with_views("SELECT rewrite_prompt AS prompt, 's' || prompt_id AS subject FROM prompts UNION ALL SELECT 'again', 'twice' FROM prompts", "prompts"),
)
def _(t: Tables):
    folder = t.scratch()
    entry = F.struct(F.col("rewrite_prompt").alias("prompt"), F.concat(F.lit("s"), "prompt_id").alias("subject"))
    again = F.struct(F.lit("again").alias("prompt"), F.lit("twice").alias("subject"))
    _json_lines(t.prompts, F.to_json(F.array(entry, again)), folder)
    return readers.read_prompt_objects(t.spark, folder, per_line=True)


@check("json_nested_prompts", with_views("SELECT rewrite_prompt, 's' || prompt_id AS subject FROM prompts", "prompts"))
def _(t: Tables):
    folder = t.scratch()
    entry = F.struct(F.col("rewrite_prompt").alias("prompt"), F.concat(F.lit("s"), "prompt_id").alias("subject"))
    _json_lines(t.prompts, F.to_json(F.struct(F.array(entry).alias("prompts"))), folder)
    return readers.read_nested_prompts(t.spark, folder, per_line=True)


@check(
    "json_expansion_lists",
    with_views("SELECT rewrite_prompt AS prompt, 'v1 ' || prompt_id AS first_variant, 2 AS n FROM prompts", "prompts"),
)
def _(t: Tables):
    folder = t.scratch()
    variants = F.array(F.concat(F.lit("v1 "), "prompt_id"), F.concat(F.lit("v2 "), "prompt_id"))
    entry = F.struct(F.col("rewrite_prompt").alias("original_prompt"), variants.alias("rewritten_prompts"))
    _json_lines(t.prompts, F.to_json(F.array(F.array(entry))), folder)
    table = readers.read_expansions(t.spark, folder, per_line=True)
    return table.select("prompt", F.col("variants")[0].alias("first_variant"), F.size("variants").alias("n"))


@check(
    "text_lines",
    f"""SELECT {sql_strip('line')} AS rewrite_prompt FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark)""",
)
def _(t: Tables):
    folder = t.scratch()
    lines = t.benchmark.select(F.explode(F.split("text", "\n")).alias("line"))
    lines.select(F.concat(F.lit("  "), "line", F.lit(" ")).alias("value")).write.text(folder)
    return readers.read_lines(t.spark, folder)


@check(
    "source_corpora",
    """SELECT text AS original_text, 'reddit' AS dataset_id FROM documents
      UNION ALL SELECT replace(rewritten, '– ', ''), 'multi_news' FROM (SELECT '– ' || text AS rewritten FROM benchmark)
      UNION ALL SELECT replace(text, chr(10), chr(10)), 'imdb' FROM documents""",
)
def _(t: Tables):
    marked = t.documents.select(F.replace("text", F.lit("\n"), F.lit("<br /><br />")).alias("review"))
    news = t.benchmark.select(F.concat(F.lit("– "), "text").alias("summary"))
    return readers.read_source_corpora({"reddit": (t.documents, "text"), "multi_news": (news, "summary"), "imdb": (marked, "review")})


@check(
    "source_corpus_heads",
    f"""SELECT coalesce({sql_strip("array_to_string(list_slice(rest, 1, kept), chr(10))")}, '') AS original_text, 'wikipedia' AS dataset_id FROM (
      SELECT rest, coalesce(list_min(list_filter(range(1, len(rest) + 1),
        lambda k: len(array_to_string(list_slice(rest, 1, k), chr(10))) >= 600)), len(rest)) AS kept
      FROM (SELECT list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10)))) AS rest FROM documents))""",
)
def _(t: Tables):
    return readers.read_source_corpora({"wikipedia": (t.documents, "text")})


@check(
    "named_datasets",
    """SELECT text AS rewrite_prompt, 'benchmark' AS dataset FROM benchmark UNION ALL SELECT text, 'turns' FROM conversations WHERE role = 'user'""",
)
def _(t: Tables):
    registry = {
        "benchmark": lambda: t.benchmark.select(F.col("text").alias("rewrite_prompt")),
        "turns": lambda: t.prompts.select("rewrite_prompt"),
        "documents": lambda: t.documents.select(F.col("text").alias("rewrite_prompt")),
    }
    return readers.read_named(registry, ["benchmark", "turns"])


@check(
    "vectors_by_dataset",
    """SELECT vec_id AS id, 'label-' || label AS dataset, i - 1 AS i, round(embedding[i]::DOUBLE, 6) AS x
      FROM embeddings, range(1, 65) r(i) WHERE label IN (3, 7)""",
)
def _(t: Tables):
    folder = t.scratch()
    rows = t.embeddings.select(F.col("vec_id").alias("id"), F.concat(F.lit("label-"), "label").alias("dataset"), "embedding")
    writers.write_vectors(rows, folder)
    back = readers.read_vectors(t.spark, folder, ["label-3", "label-7"])
    cells = back.select("id", "dataset", F.posexplode("embedding").alias("i", "x"))
    return cells.select("id", "dataset", F.col("i").cast("long").alias("i"), rounded(F.col("x").cast("double")).alias("x"))


@check(
    "trace_files",
    "SELECT CAST(doc_id AS INTEGER) AS step, n_chars / 2 AS score, text FROM documents",
)
def _(t: Tables):
    folder = t.scratch()
    entry = F.struct(F.col("doc_id").cast("int").alias("step"), (F.col("n_chars") / 2).alias("score"), "text")
    _json_lines(t.documents, F.to_json(F.array(entry)), folder)
    return readers.read_trace_texts(t.spark, folder, per_line=True).select("step", "score", "text")


@check("json_rows", "SELECT label AS step, count(*) AS n FROM embeddings GROUP BY label")
def _(t: Tables):
    folder = t.scratch()
    writers.write_json(t.embeddings.groupBy(F.col("label").alias("step")).agg(F.count(F.lit(1)).alias("n")), folder)
    return t.spark.read.schema("step int, n long").json(folder)


@check(
    "saved_search_state",
    """SELECT rank, text, score FROM (SELECT row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank, source || ' ' || lang AS text, n_chars / 4 AS score
      FROM documents) WHERE rank < 50""",
)
def _(t: Tables):
    folder = t.scratch()
    longest = t.documents.orderBy(F.desc("n_chars"), "doc_id").limit(50).select("source", "lang", "n_chars").collect()
    beams = [([r["source"], r["lang"]], r["n_chars"] / 4, r["n_chars"] / 4) for r in longest]
    for step in (0, 1, 2):
        writers.save_state(t.spark, search.SearchState(step, beams, [(s, 0.5, "x") for s in range(step + 1)]), folder)
    state = writers.load_state(t.spark, folder)
    table = search.beams_table(t.spark, state)
    return table.select(F.col("rank").cast("long").alias("rank"), F.array_join("words", " ").alias("text"), "score")


@check(
    "written_split",
    with_views("SELECT CASE WHEN r > n - 40 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY prompt_id) AS r, count(*) OVER () AS n FROM prompts) GROUP BY 1", "prompts"),
)
def _(t: Tables):
    folder = t.scratch()
    writers.write_split(split_validation(t.prompts, 40, 42, ["prompt_id"]), folder)
    return t.spark.read.parquet(folder).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


