"""Readers for the text, prompt and embedding tables."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from palimpsest import schemas
from palimpsest.functions.text import strip
from palimpsest.functions.vectors import fold_columns
from palimpsest.operators.curate import combine_sources, source_text
from palimpsest.operators.ordering import union_all
from palimpsest.session import cut_lineage

TEXTS = ("original_text", "rewrite_prompt", "rewritten_text")
METADATA_FILE = "dataset-metadata.json"  # fixed value: the one file a prompt folder holds besides data


CSV_OPTIONS = {"header": True, "multiLine": True, "quote": '"', "escape": '"'}


def _headers(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``file, names`` of the CSV files of a path, glob or list: each file's first record, all in one job.

    A record goes on over line ends inside quotes. Files without a record have none.
    """
    lines = spark.read.option("lineSep", "\n").text(path).filter(F.col("_metadata.file_block_start") == 0)
    rows = lines.select(F.col("_metadata.file_path").alias("file"), "value")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[str] = set()
        record: dict[str, str] = {}  # of files whose first record goes on; lines of a file come in order
        for batch in batches:
            found = []
            for file, line in zip(batch.column("file").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if file in done:
                    continue
                text = record.pop(file) + "\n" + line if file in record else line
                if text.count('"') % 2:
                    record[file] = text
                elif text.strip():
                    done.add(file)
                    found.append((file, next(csv.reader(io.StringIO(text.removeprefix("\ufeff").rstrip("\r"), newline="")))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([f for f, _ in found], pa.string()), pa.array([n for _, n in found], pa.list_(pa.string()))], names=["file", "names"]
            )

    return rows.mapInArrow(first, "file string, names array<string>")


def _read_by_header(spark: SparkSession, path: str | list[str], schema: T.StructType, source: str | None = None) -> DataFrame:
    """The columns of ``schema`` by each file's own header: one job for the headers, one scan for the rows.

    Rows are read by place and find their file's header in a join; the headers never come to the driver.
    """
    headers = cut_lineage(_headers(spark, path))
    width = headers.agg(F.max(F.size("names"))).first()[0]
    more = [F.col("_file").alias(source)] if source else []
    if width is None:
        return spark.createDataFrame([], schema).withColumn("_file", F.lit("")).select(*schema.names, *more)
    places = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(width)])
    raw = spark.read.options(**CSV_OPTIONS).schema(places).csv(path)
    cells = raw.select(F.array(*places.names).alias("_cells"), F.col("_metadata.file_path").alias("_file"))
    named = cells.join(headers.withColumnRenamed("file", "_file"), "_file")

    def cell(field: T.StructField) -> Column:
        place = F.array_position("names", F.lit(field.name)).cast("int") - 1  # -1 where the file lacks the column
        return F.get("_cells", place).cast(field.dataType).alias(field.name)

    return named.select(*map(cell, schema.fields), *more)


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, by_header: bool = True) -> DataFrame:
    """CSV whose texts hold quotes and newlines.

    ``by_header`` maps each file's own header to the schema, so that column order and absent columns
    do not matter (absent ones become null). Otherwise columns count by place, and a header that
    disagrees with the schema is an error.
    """
    if by_header:
        return _read_by_header(spark, path, schema)
    return spark.read.options(**CSV_OPTIONS, enforceSchema=False).schema(schema).csv(path)


def read_csv_files(spark: SparkSession, paths: list[str], schema: T.StructType) -> DataFrame:
    """Several CSV files whose headers may differ, with the file name as ``source_file``."""
    return union_all([read_csv(spark, p, schema).withColumn("source_file", F.lit(p)) for p in sorted(paths)])


def read_csv_folder(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """A glob of CSV files, each read by its own header; ``source_file`` keeps provenance and order."""
    return _read_by_header(spark, pattern, schema, "source_file")


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def spread_small(table: DataFrame) -> DataFrame:
    """Spread a file scan with fewer splits than the cluster has cores, for work heavy on the CPU.

    Only for scans (their split count is known without running anything); a table with enough splits
    comes back as it is, so large data is never shuffled for this.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table._jdf.rdd().getNumPartitions() >= cores else table.repartition(cores)


def read_wide_embeddings(df: DataFrame, texts: tuple[str, ...] = TEXTS, dim: int = 768) -> DataFrame:
    """Fold ``{column}_emb_0 …`` scalars into one array per text, in the row with its text."""
    vectors = [fold_columns(f"{c}_emb", dim).alias(f"{c}_vector") for c in texts]
    return df.select(*texts, *vectors)


def _parsed_json(spark: SparkSession, pattern: str, schema: T.DataType, per_line: bool) -> DataFrame:
    """One row per JSON document (top-level arrays included): a whole file, or each line of it.

    A whole file is one record and thus one task's work; large data comes one document per line.
    """
    text = spark.read.text(pattern, wholetext=not per_line).withColumn("file_name", F.col("_metadata.file_name"))
    return text.select("file_name", F.from_json("value", schema).alias("value"))


def read_prompt_list(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """JSON array of strings → ``rewrite_prompt``."""
    whole = _parsed_json(spark, path, T.ArrayType(T.StringType()), per_line)
    return whole.select(F.explode("value").alias("rewrite_prompt"))


def read_prompt_objects(spark: SparkSession, pattern: str, skip: str = METADATA_FILE, per_line: bool = False) -> DataFrame:
    """JSON arrays of ``{prompt, subject}`` objects in many files, one file name left out."""
    table = spark.read.schema(schemas.PROMPT_SUBJECT).option("multiLine", not per_line).json(pattern)
    return table.filter(F.col("_metadata.file_name") != skip)


def read_nested_prompts(spark: SparkSession, pattern: str, per_line: bool = False) -> DataFrame:
    """``{"prompts": [{prompt, subject}]}`` → ``rewrite_prompt, subject``."""
    table = spark.read.schema(schemas.NESTED_PROMPTS).option("multiLine", not per_line).json(pattern)
    return table.select(F.explode("prompts").alias("p")).select(
        F.col("p.prompt").alias("rewrite_prompt"), F.col("p.subject").alias("subject")
    )


def read_expansions(spark: SparkSession, pattern: str, per_line: bool = False) -> DataFrame:
    """Lists of lists of ``{original_prompt, rewritten_prompts}`` → one row per entry, in order."""
    whole = _parsed_json(spark, pattern, schemas.EXPANSION_LISTS, per_line)
    return whole.select("file_name", F.posexplode(F.flatten("value")).alias("entry", "e")).select(
        "file_name", "entry", F.col("e.original_prompt").alias("prompt"), F.col("e.rewritten_prompts").alias("variants")
    )


def read_lines(spark: SparkSession, path: str, name: str = "rewrite_prompt", stripped: bool = True) -> DataFrame:
    value = strip(F.col("value")) if stripped else F.col("value")
    return spark.read.text(path).select(value.alias(name))


def read_trace_texts(spark: SparkSession, pattern: str, per_line: bool = False) -> DataFrame:
    """Beam traces (arrays of ``{step?, score, text}``) of many files → ``file_name, step, score, text``."""
    table = spark.read.schema(schemas.TRACE).option("multiLine", not per_line).json(pattern)
    return table.select(F.col("_metadata.file_name").alias("file_name"), "step", "score", "text")


def read_source_corpora(specs: dict[str, tuple[DataFrame, str]], min_len: int = 300) -> DataFrame:
    """Per source ``(table, text column)`` → ``original_text, dataset_id`` after the source's clean-up."""
    cleaned = {
        kind: df.select(source_text(kind, F.col(column), min_len).alias("original_text"))
        for kind, (df, column) in specs.items()
    }
    return combine_sources(cleaned, "dataset_id")


def read_named(readers: dict[str, Callable[[], DataFrame]], names: list[str]) -> DataFrame:
    """The chosen named datasets as one table with a ``dataset`` column."""
    return combine_sources({name: readers[name]() for name in names})


def read_vectors(spark: SparkSession, path: str, datasets: list[str] | None = None) -> DataFrame:
    """``id, dataset, embedding`` written by ``write_vectors``; the filter prunes partitions."""
    table = spark.read.parquet(path)
    return table if datasets is None else table.filter(F.col("dataset").isin(*datasets))
