"""Product codes of integer vectors, fitted and assigned through dictionaries of the values of each dimension.

A component becomes the integer below its multiple of a scale. A vector is cut into equal parts, and each part is
replaced by the number of the nearest entry of its position's codebook. In a batch, each dimension has a
dictionary of its different integers; the squared differences of those to all entries are tabulated once, so that
the distances of a part are gathers by dictionary code and additions. All sums are of integers and exact.
"""

from __future__ import annotations

from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.llm.common import Batches
from palimpsest.llm.registry import query, table
from palimpsest.session import cut_lineage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256.0
#: Integers beyond this would not leave room for exact sums of squares in 64 bits.
LARGEST = 1 << 27
#: Rows whose distances are held at a time.
ROWS_AT_ONCE = 4096
#: Tasks over which the rows of one label are spread when they meet its sum.
SALTS = 64


class Codebooks(NamedTuple):
    """``entries[part, entry, position]``; no entries where there was nothing to fit."""

    entries: np.ndarray
    scale: float

    @property
    def width(self) -> int:
        """Components of a vector."""
        return self.entries.shape[0] * self.entries.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components in decimal by part, entry and position, joined by commas."""
        return sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _fit_rows(df: DataFrame, vector: str) -> Column:
    """Whether a row has a vector whose components are all there and finite."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(vector).cast("array<double>")
    return F.coalesce((F.size(v) > 0) & ~F.exists(v, lambda x: F.coalesce(bad(x), F.lit(True))), F.lit(False))


def _integers(batch: pa.RecordBatch, scale: float) -> np.ndarray:
    """The vectors of a batch as integers, one row each."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * scale)
    if len(out) and np.abs(out).max() > LARGEST:
        raise ValueError(f"components beyond {LARGEST / scale} have no exact squared distances")
    return out.astype(np.int64).reshape(batch.num_rows, -1)


def nearest_entries(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each part of each row (ties to the lower) and its squared distance."""
    parts, _, width = entries.shape
    codes, errors = np.zeros((len(x), parts), dtype=np.int64), np.zeros((len(x), parts), dtype=np.int64)
    tables = []
    for at in range(x.shape[1]):
        values, code = np.unique(x[:, at], return_inverse=True)
        tables.append(((values[:, None] - entries[at // width, :, at % width][None, :]) ** 2, code))
    for first in range(0, len(x), ROWS_AT_ONCE):
        rows = slice(first, first + ROWS_AT_ONCE)
        for part in range(parts):
            squares, code = tables[part * width]
            distance = squares[code[rows]]
            for squares, code in tables[part * width + 1 : (part + 1) * width]:
                distance += squares[code[rows]]
            best = distance.argmin(axis=1)
            codes[rows, part], errors[rows, part] = best, distance[np.arange(len(best)), best]
    return codes, errors


def _vectors(df: DataFrame, vector: str, width: int | None = None, *columns: Column) -> DataFrame:
    rows = df.filter(_fit_rows(df, vector))
    if width is not None:
        rows = rows.filter(F.size(vector) == width)
    return rows.select(*columns, F.col(vector).cast("array<double>").alias("v"))


def _moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every part to its nearest entry, every entry to the floor of the mean of its parts."""
    shared = rows.sparkSession.sparkContext.broadcast(books.entries)
    parts, count, width = books.entries.shape

    def add(batches: Batches) -> Batches:
        totals, members = np.zeros((parts * count, width), dtype=np.int64), np.zeros(parts * count, dtype=np.int64)
        for batch in batches:
            x = _integers(batch, books.scale)
            slot = nearest_entries(x, shared.value)[0] + np.arange(parts) * count
            pieces = x.reshape(-1, width)
            order = np.argsort(slot.ravel(), kind="stable")
            used, firsts, sizes = np.unique(slot.ravel()[order], return_index=True, return_counts=True)
            if len(used):
                totals[used] += np.add.reduceat(pieces[order], firsts, axis=0)
                members[used] += sizes
        used = np.flatnonzero(members)
        if len(used):
            sums = pa.FixedSizeListArray.from_arrays(pa.array(totals[used].ravel()), width).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(members[used]), sums], names=["slot", "n", "sums"])

    found = rows.mapInArrow(add, "slot long, n long, sums array<long>")
    columns = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]
    entries = books.entries.reshape(-1, width).copy()
    for r in found.groupBy("slot").agg(F.sum("n").alias("n"), *columns).collect():  # a row an entry at most
        entries[r["slot"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    shared.unpersist()
    return Codebooks(entries.reshape(parts, count, width), books.scale)


def fit_codebooks(
    df: DataFrame,
    id_column: str = "vec_id",
    vector: str = "embedding",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: float = SCALE,
) -> Codebooks:
    """Codebooks after ``rounds`` rounds over all rows.

    They start as the parts of the vectors with the ``entries`` smallest ids (null ids last; equal ids by vector),
    fewer where the table has fewer. Rows without a usable vector (null, empty, a null or non-finite component)
    take no part, nor do vectors of another length than the smallest id's. That length must be a multiple of
    ``parts``. A table without usable vectors gives codebooks without entries. Repeated rows count each time.
    """
    first = _vectors(df, vector, None, F.col(id_column).alias("id")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), dtype=np.int64), scale)
    width = len(first[0]["v"])
    if width % parts:
        raise ValueError(f"{width} components do not make {parts} equal parts")
    start = [r["v"] for r in first if len(r["v"]) == width]
    batch = pa.RecordBatch.from_arrays([pa.array(start, pa.list_(pa.float64()))], names=["v"])
    books = Codebooks(_integers(batch, scale).reshape(len(start), parts, -1).transpose(1, 0, 2).copy(), scale)
    rows = _vectors(df, vector, width)
    for _ in range(rounds):
        books = _moved(rows, books)
    return books


def encode_vectors(df: DataFrame, books: Codebooks, id_column: str = "vec_id", vector: str = "embedding", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, code, error`` and the columns of ``keep``, a row for each usable vector of the codebooks' length.

    ``code`` has two hexadecimal digits for each part (at most 256 entries), ``error`` is the squared distance in
    integer units. Other rows have no code and are left out.
    """
    if books.entries.shape[1] > 256:
        raise ValueError("two hexadecimal digits number 256 entries")
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = _vectors(df, vector, books.width, F.col(id_column).alias("id"), *kept)
    shared = df.sparkSession.sparkContext.broadcast(books.entries)
    fields = [rows.schema[c] for c in rows.columns if c != "v"]
    schema = T.StructType([*fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def encode(batches: Batches) -> Batches:
        parts = shared.value.shape[0]
        for batch in batches:
            codes, errors = nearest_entries(_integers(batch, books.scale), shared.value)
            digits = codes.astype(np.uint8).tobytes().hex()
            text = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
            columns = [*[batch.column(f.name) for f in fields], pa.array(text, pa.string()), pa.array(errors.sum(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    found = rows.mapInArrow(encode, schema)
    return found.select(F.col("id").alias(id_column), *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "code", "error")


def decode_vectors(codes: DataFrame, books: Codebooks, id_column: str = "vec_id", code: str = "code") -> DataFrame:
    """``id, vector``: the entries a code names, in the units of the vectors; a null code gives a null vector."""
    kind = codes.schema[id_column].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("vector", T.ArrayType(T.DoubleType()))])
    entries = books.entries / books.scale

    def decode(batches: Batches) -> Batches:
        for batch in batches:
            whole = [None if c is None else entries[np.arange(len(entries)), list(bytes.fromhex(c))].ravel() for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(whole, pa.list_(pa.float64()))], names=["id", "vector"])

    rows = codes.select(F.col(id_column).alias("id"), F.col(code).alias("code"))
    return rows.mapInArrow(decode, schema).withColumnRenamed("id", id_column)


def with_group_sum(df: DataFrame, group: str, value: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over rows of equal ``group``, nulls together.

    ``df`` is read twice, so it should be a table. A group's rows are spread over ``SALTS`` tasks to meet its sum.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c != group]), F.lit(SALTS)).cast("int"))
    sums = df.groupBy(F.col(group).alias("_group")).agg(F.sum(value).alias(name))
    sums = sums.withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = (F.col("_salt") == F.col("_other")) & F.col(group).eqNullSafe(F.col("_group"))
    return salted.join(sums, same).select(*df.columns, name)


_PLAIN = """rows_ AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x FROM rows_, range(0, 16) r(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM rows_ ORDER BY vec_id LIMIT 64)),"""


def _assigned(name: str, books: str) -> str:
    """SQL of each part's nearest entry: an order by distance, then number."""
    square = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) ** 2))"
    return f"""{name} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min({square} * 64 + e)::BIGINT AS best
  FROM parts JOIN {books} USING (p) GROUP BY vec_id, p)"""


def _averaged(name: str, assigned: str, books: str) -> str:
    return f"""{name}_cells AS (SELECT p, best % 64 AS e, i, CAST(floor(sum(x[i]) / count(*)) AS BIGINT) AS m
  FROM {assigned}, range(1, (SELECT max(len(x)) + 1 FROM parts)) r(i) GROUP BY ALL),
{name}_means AS (SELECT p, e, list(m ORDER BY i) AS m FROM {name}_cells GROUP BY p, e),
{name} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM {books} LEFT JOIN {name}_means USING (p, e))"""


_SQL = f"""WITH {_PLAIN} {_assigned("a0", "b0")}, {_averaged("b1", "a0", "b0")}, {_assigned("a1", "b1")}, {_averaged("b2", "a1", "b1")},
{_assigned("a2", "b2")},
coded AS (SELECT vec_id, string_agg(printf('%02x', best % 64), '' ORDER BY p) AS code, sum(best // 64)::BIGINT AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN rows_ USING (vec_id), book"""


@query("op13_vector_codes", _SQL)
def op13(spark, folder):
    vectors = table(spark, folder, "embeddings")
    books = fit_codebooks(vectors)
    coded = cut_lineage(encode_vectors(vectors, books, keep=("label",)))
    summed = with_group_sum(coded, "label", "error", "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
