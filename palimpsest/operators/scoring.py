"""Similarity scoring of candidate vectors against a corpus of vectors.

The score of a candidate ``c`` is the mean over the corpus of ``(c·d)³``. Two exact ways:

* **Moments** (up to 64 components): one pass turns the corpus into the symmetric third-moment
  tensor, whose size depends on the dimension alone. Any number of candidates is then scored
  without touching the corpus.
* **Passes** (vectors of any width; ``CorpusVectors`` takes moments instead up to 128 components, where so many
  candidates meet so many rows that it is less work): candidates in blocks of a checked byte size meet the corpus, which adds
  up its cubes locally, and only ``(candidate, sum, count)`` rows leave a task. More candidates than one
  block holds are joined block by block on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from palimpsest.functions.vectors import cubed_cosine, dot, squared_distance, to_double, vector_literal

MOMENT_DIM_LIMIT = 64
# Components up to which a corpus in passes may be added up as moments: a tensor of 16 MB.
WIDE_DIM_LIMIT = 128
# What cubing and adding a similarity takes, in products of two numbers.
CUBE_PRODUCTS = 25
BLOCK_BYTES = 64 * 1024 * 1024
# Pairs of a part of one side and a block of the other for each core, where the sides meet in tasks.
PAIRS = 3
# Cells of one similarity product held at a time inside a task.
CELLS = 2_000_000


Batches = Iterator[pa.RecordBatch]


def as_matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.empty((0, 0))


def batch_vectors(batch: pa.RecordBatch, name: str = "v") -> tuple[pa.RecordBatch, np.ndarray]:
    """The batch's rows that have a vector (not null, no null components) and those vectors.

    Checking here instead of in a filter keeps an encoder from running once for the filter and once
    for the value.
    """
    if batch.column(name).null_count:
        batch = batch.filter(batch.column(name).is_valid())
    if not batch.num_rows:
        return batch, np.empty((0, 1))
    values = batch.column(name).flatten()
    x = values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    if values.null_count:
        whole = ~np.isnan(x).any(axis=1)
        batch, x = batch.filter(pa.array(whole)), x[whole]
    return batch, x


def vectors_of(df: DataFrame, vector: str, *columns: Column) -> DataFrame:
    """The vector as ``v`` and the given further columns."""
    return df.select(*columns, to_double(F.col(vector)).alias("v"))


def vector_dim(df: DataFrame, vector: str) -> int:
    """Number of components, read off the first row that has a vector."""
    sizes = df.select(F.size(vector).alias("d"))
    row = sizes.first()
    if row is not None and (row["d"] is None or row["d"] < 1):
        row = sizes.filter("d > 0").first()
    if row is None:
        raise ValueError(f"no vectors in column {vector}")
    return row["d"]


def _whole_vectors(block: pd.DataFrame, vector: str) -> pd.DataFrame:
    known = [v is not None and not np.isnan(np.asarray(v, dtype=np.float64)).any() for v in block[vector]]
    return block[known]


def against_blocks(
    left: DataFrame,
    others: DataFrame,
    id_column: str,
    vector: str,
    kernel: Callable[[Callable[[], pd.DataFrame]], Callable[[Batches], Batches]],
    schema: T.StructType | str,
    keep: tuple[str, ...] = (),
    block_bytes: int | None = None,
) -> DataFrame:
    """Every row of ``left`` against every row of ``others`` that has a vector, block by block.

    ``kernel(load)`` gives the function for a stream of left batches; ``load()`` the other side's block (id,
    ``keep``, vector). Another side of at most ``block_bytes`` of vectors, by count, is one block that all
    tasks get. A larger one is packed into blocks on the executors: each part of the left side meets each
    block in a task of its own, and neither side passes the driver. Parts of the left side follow its rows,
    equal ones spread by the partition they come from.
    """
    block_bytes = block_bytes or BLOCK_BYTES
    spark = left.sparkSession
    wanted = others.select(id_column, *keep, to_double(F.col(vector)).alias(vector))
    rows = wanted.count()
    if rows == 0:
        return spark.createDataFrame([], schema)
    per_block = max(1, block_bytes // (8 * vector_dim(others, vector)))
    if rows <= per_block:
        shared = spark.sparkContext.broadcast(_whole_vectors(wanted.toArrow().to_pandas(), vector))
        return left.mapInArrow(kernel(lambda: shared.value), schema)
    # pairs of a part and a block for all cores, the two sides cut alike so that neither is sent much more often
    pairs = PAIRS * spark.sparkContext.defaultParallelism
    pieces = max(ceil(1.25 * rows / per_block), ceil(sqrt(pairs)))
    parts = max(ceil(left.count() / per_block), ceil(pairs / pieces))

    def pack(block):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, block.schema) as stream:
            stream.write_table(block)
        return pa.table({"_piece": block.column("_piece")[:1], "_packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    piece = F.pmod(F.xxhash64(id_column), F.lit(pieces).cast("long"))
    packed = wanted.withColumn("_piece", piece).groupBy("_piece").applyInArrow(pack, "_piece long, _packed binary")
    part = F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.lit(parts).cast("long"))
    dealt = left.withColumn("_part", part).withColumn("_piece", numbers(pieces))
    empty = spark.createDataFrame([], schema).toArrow().schema

    def meet(mine, block):
        if not mine.num_rows or not block.num_rows:
            return empty.empty_table()
        held = _whole_vectors(pa.ipc.open_stream(block.column("_packed")[0].as_py()).read_pandas(), vector)
        found = list(kernel(lambda: held)(iter(mine.drop_columns(["_part", "_piece"]).to_batches(max_chunksize=4096)))) if len(held) else []
        return pa.Table.from_batches(found).cast(empty) if found else empty.empty_table()

    groups = dealt.groupBy("_part", "_piece"), packed.withColumn("_part", numbers(parts)).groupBy("_part", "_piece")
    return groups[0].cogroup(groups[1]).applyInArrow(meet, schema)


@dataclass(frozen=True)
class Moments:
    """Third-moment tensor Σ d⊗d⊗d of a corpus, flattened, and the corpus size."""

    tensor: np.ndarray
    count: int

    @property
    def dim(self) -> int:
        return self.tensor.shape[0]

    def mean_cube(self, vectors: np.ndarray) -> np.ndarray:
        dim = self.dim
        flat, step = self.tensor.reshape(dim, dim * dim), max(1, CELLS // (dim * dim))
        means = np.empty(len(vectors))
        for at in range(0, len(vectors), step):  # a row takes dim² cells
            x = vectors[at : at + step]
            half = (x @ flat).reshape(-1, dim, dim)
            means[at : at + step] = np.matmul(np.matmul(half, x[:, :, None])[:, :, 0][:, None, :], x[:, :, None])[:, 0, 0]
        return means / self.count

    def mean_direction(self, unit_vector: np.ndarray) -> np.ndarray:
        """mean((d·e)² d) for a direction e."""
        return (self.tensor @ unit_vector) @ unit_vector / self.count


def _upper(dim: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs j ≤ k from ``first`` on."""
    j, k = np.triu_indices(dim - first)
    return j + first, k + first


#: Rows of one group whose moments one task adds up.
TENSOR_ROWS = 1_000_000


def _packed(tensor: np.ndarray) -> np.ndarray:
    """The cells i ≤ j ≤ k of a symmetric tensor, which say it all."""
    dim = len(tensor)
    return np.concatenate([tensor[i][_upper(dim, i)] for i in range(dim)])


def _unpacked(cells: np.ndarray, dim: int) -> np.ndarray:
    tensor, at = np.zeros((dim, dim, dim)), 0
    for i in range(dim):
        j, k = _upper(dim, i)
        values = cells[at : at + len(j)]
        at += len(j)
        for a, b, c in ((i, j, k), (i, k, j), (j, i, k), (k, i, j), (j, k, i), (k, j, i)):
            tensor[a, b, c] = values
    return tensor


def _add_outer(tensor: np.ndarray, x: np.ndarray) -> None:
    """Add Σ d⊗d⊗d, with the last two indices in one."""
    step = min(1024, max(1, 2 * CELLS // tensor.shape[1]))
    for at in range(0, len(x), step):
        piece = x[at : at + step]
        tensor += piece.T @ (piece[:, :, None] * piece[:, None, :]).reshape(len(piece), -1)


def group_tensors(grouped: DataFrame, dim: int) -> DataFrame:
    """``grp, cells, n``: sums of d⊗d⊗d of ``grp, v``, a row or more for each group, as packed cells.

    Groups are dealt to tasks whole, large ones in shares of ``TENSOR_ROWS`` rows; a task holds one tensor at a time.
    """
    grouped = grouped.withColumn("_share", F.xxhash64("v"))
    counts = grouped.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / TENSOR_ROWS).alias("_shares")).filter("_shares > 1")
    dealt = grouped.join(counts, "grp", "left").withColumn("_share", F.pmod("_share", F.coalesce("_shares", F.lit(1).cast("long"))))
    dealt = dealt.select("grp", "v", "_share").repartition("grp", "_share").sortWithinPartitions("grp", "_share")

    def add(batches: Batches) -> Batches:
        held, tensor, n = None, np.zeros((dim, dim * dim)), 0

        def out():
            cells = pa.array([_packed(tensor.reshape(dim, dim, dim))], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([held[0]], kind), cells, pa.array([n])], names=["grp", "cells", "n"])

        for batch in batches:
            kind = batch.schema.field("grp").type
            batch, x = batch_vectors(batch)
            keys = list(zip(batch.column("grp").to_pylist(), batch.column("_share").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                last = at + 1
                while last < len(keys) and keys[last] == keys[at]:
                    last += 1
                if keys[at] != held:
                    if n:
                        yield out()
                    held, tensor, n = keys[at], np.zeros((dim, dim * dim)), 0
                _add_outer(tensor, x[at:last])
                n += last - at
                at = last
        if n:
            yield out()

    kind_ = grouped.schema["grp"].dataType.simpleString()
    return dealt.mapInArrow(add, f"grp {kind_}, cells array<double>, n long")


def summed_tensors(batches: Batches, dim: int) -> Iterator[tuple]:
    """``(group, tensor, count)`` of rows sorted by group, one tensor at a time."""
    held, cells, n = None, None, 0
    for batch in batches:
        for key, part, rows in zip(batch.column("grp").to_pylist(), batch.column("cells"), batch.column("n").to_pylist(), strict=True):
            values = part.values.to_numpy()
            if key != held:
                if cells is not None:
                    yield held, _unpacked(cells, dim), n
                held, cells, n = key, np.zeros(len(values)), 0
            cells = cells + values
            n += rows
    if cells is not None:
        yield held, _unpacked(cells, dim), n


def corpus_moments(df: DataFrame, vector: str, dim: int | None = None) -> Moments:
    """Moments of the corpus; one pass over the data. A corpus without vectors has a count of 0."""
    dim = dim or vector_dim(df, vector)
    if dim > MOMENT_DIM_LIMIT:
        raise ValueError(f"moments are for at most {MOMENT_DIM_LIMIT} components, got {dim}: score in passes (CorpusVectors) instead")
    return _summed_moments(df, vector, dim)


def _summed_moments(df: DataFrame, vector: str, dim: int) -> Moments:
    """Moments of vectors of ``dim`` components.

    Every task adds up its rows and its tensor is one row; those are added in a second round, and what is left cell by
    cell, so that one tensor comes to the driver, whose size follows from the dimension alone.
    """

    def add(batches: Batches) -> Batches:
        tensor, n = np.zeros((dim, dim * dim)), 0
        for batch in batches:
            _, x = batch_vectors(batch)
            if len(x):
                _add_outer(tensor, x)
                n += len(x)
        if n:
            cells = pa.array([_packed(tensor.reshape(dim, dim, dim))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([cells, pa.array([n])], names=["cells", "n"])

    def again(batches: Batches) -> Batches:
        cells, n = None, 0
        for batch in batches:
            for part, rows in zip(batch.column("cells"), batch.column("n").to_pylist(), strict=True):
                values = part.values.to_numpy()
                cells, n = values + (0.0 if cells is None else cells), n + rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([cells], pa.list_(pa.float64())), pa.array([n])], names=["cells", "n"])

    shape = "cells array<double>, n long"
    slices = vectors_of(df, vector).mapInArrow(add, shape).hint("rebalance").mapInArrow(again, shape)
    summed = slices.select(F.posexplode("cells").alias("cell", "value"), "n").groupBy("cell").agg(F.sum("value").alias("value"), F.sum("n").alias("n"))
    packed = summed.toArrow().to_pandas().sort_values("cell")
    if packed.empty:
        return Moments(np.zeros((dim, dim, dim)), 0)
    return Moments(_unpacked(packed["value"].to_numpy(), dim), int(packed["n"].iloc[0]))


def with_moment_score(df: DataFrame, vector: str, moments: Moments, name: str = "score") -> DataFrame:
    """Replace the vector column by the mean cubed similarity to the corpus behind ``moments``."""
    kept = [c for c in df.columns if c != vector]

    def score(batches: Batches) -> Batches:
        for batch in batches:
            numbered = batch.append_column("_n", pa.array(np.arange(batch.num_rows)))
            whole, x = batch_vectors(numbered, "_v")
            scores = np.full(batch.num_rows, np.nan)
            if len(x):
                scores[whole.column("_n").to_numpy()] = moments.mean_cube(x)
            columns = [batch.column(c) for c in kept] + [pa.array(scores, pa.float64(), mask=np.isnan(scores))]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, name])

    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(name, T.DoubleType())])
    return df.select(*kept, to_double(F.col(vector)).alias("_v")).mapInArrow(score, schema)


def mean_cubed_similarity(
    candidates: DataFrame, corpus: DataFrame, candidate_id: str, vector: str = "vector", corpus_vector: str = "vector", way: str = "auto"
) -> DataFrame:
    """``candidate_id, score`` for every candidate."""
    dim = None
    if way == "auto":
        dim = vector_dim(corpus, corpus_vector)
        way = "moments" if dim <= MOMENT_DIM_LIMIT else "passes"
    if way == "moments":
        moments = corpus_moments(corpus, corpus_vector, dim)
        return with_moment_score(candidates.select(candidate_id, vector), vector, moments)
    return score_in_passes(candidates, corpus, candidate_id, vector, corpus_vector).select(candidate_id, "score")


@dataclass(frozen=True)
class CorpusVectors:
    """A corpus that scores candidates of any dimension, in passes over its rows.

    Up to ``WIDE_DIM_LIMIT`` components its moments are added up, once, where scoring from them is less work.
    """

    rows: DataFrame
    vector: str

    @cached_property
    def size(self) -> tuple[int, int]:
        """Numbers of rows and of components; 0 of both without vectors."""
        try:
            return self.rows.count(), vector_dim(self.rows, self.vector)
        except ValueError:
            return 0, 0

    @cached_property
    def moments(self) -> Moments:
        return _summed_moments(self.rows, self.vector, self.size[1])

    def moments_for(self, candidates: int) -> Moments | None:
        """The moments, if so many candidates are scored from them with less work than in a pass."""
        rows, dim = self.size
        if not rows or dim > WIDE_DIM_LIMIT:
            return None
        known = "moments" in self.__dict__
        moments = dim**3 * (candidates + (0 if known else rows))
        return self.moments if moments < rows * candidates * (dim + CUBE_PRODUCTS) else None


def score_in_passes(
    candidates: DataFrame, corpus: DataFrame, candidate_id: str, vector: str, corpus_vector: str, absolute: bool = False
) -> DataFrame:
    """``candidate_id, score, n``: mean of cos³ (or of its absolute value) over the corpus."""
    id_type = candidates.schema[candidate_id].dataType.simpleString()

    def kernel(load):
        def add(batches: Batches) -> Batches:
            block = load()
            ids, wanted = block[candidate_id].to_numpy(), as_matrix(block[vector])
            if not len(ids):
                return
            cubes, rows = np.zeros(len(ids)), 0
            step = max(1, CELLS // len(ids))
            for batch in batches:
                _, x = batch_vectors(batch)
                for at in range(0, len(x), step):
                    cosines = x[at : at + step] @ wanted.T
                    cubed = cosines * cosines  # a power of 3 takes many times as long as two products
                    cubed *= np.abs(cosines, out=cosines) if absolute else cosines
                    cubes += cubed.sum(axis=0)
                rows += len(x)
            if rows:
                counts = np.full(len(ids), rows, dtype=np.int64)
                yield pa.RecordBatch.from_pydict({candidate_id: ids, "cubes": cubes, "rows": counts})

        return add

    schema = f"{candidate_id} {id_type}, cubes double, rows long"
    sums = against_blocks(vectors_of(corpus, corpus_vector), candidates, candidate_id, vector, kernel, schema)
    sums = sums.groupBy(candidate_id).agg(F.sum("cubes").alias("cubes"), F.sum("rows").alias("rows"))
    return sums.select(candidate_id, (F.col("cubes") / F.col("rows")).alias("score"), F.col("rows").alias("n"))


def prompt_score(prompt_vector: Column, corpus: DataFrame, vector: str = "vector") -> DataFrame:
    """Mean signed cos³ of one constant vector to the corpus: a plain aggregate."""
    cube = cubed_cosine(prompt_vector, F.col(vector), signed=True)
    return corpus.agg(F.avg(cube).alias("score"))


def pair_scores(df: DataFrame, a: str, b: str, name: str = "score", signed: bool = False) -> DataFrame:
    return df.withColumn(name, cubed_cosine(F.col(a), F.col(b), signed))


def centroid(df: DataFrame, vector: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """Element-wise mean as an array column ``centroid``, whole table or per group.

    Averages are taken per component (combined on the map side); the final array has one entry per
    component, so what is collected is bounded by the dimension.
    """
    cells = df.select(*groups, F.posexplode(to_double(F.col(vector))).alias("_i", "_x"))
    means = cells.groupBy(*groups, "_i").agg(F.avg("_x").alias("_x"))
    ordered = F.array_sort(F.collect_list(F.struct("_i", "_x")))
    return means.groupBy(*groups).agg(F.transform(ordered, lambda s: s["_x"]).alias("centroid"))


def _table_centroid(df: DataFrame, vector: str) -> Column:
    """The table's centroid as an array literal (one number per component)."""
    values = centroid(df, vector).first()["centroid"]
    return vector_literal(values)


def distance_to_centroid(df: DataFrame, vector: str) -> DataFrame:
    """Add ``distance`` to the table's centroid (small = typical)."""
    return df.withColumn("distance", F.sqrt(squared_distance(F.col(vector), _table_centroid(df, vector))))


def mean_similarity_to_all(df: DataFrame, vector: str, cubed: bool = True, way: str = "auto", id_column: str = "id") -> DataFrame:
    """Mean similarity of every row to all rows of the same table."""
    if cubed:
        return mean_cubed_similarity(df, df, id_column, vector, vector, way)
    # the plain mean is linear, so the centroid carries all that is needed
    return df.select(id_column, dot(F.col(vector), _table_centroid(df, vector)).alias("score"))


def top_fraction(scores: DataFrame, fraction: float, order: list[Column]) -> DataFrame:
    """The first ``int(fraction · n)`` rows in the given order."""
    keep = int(fraction * scores.count())
    return scores.orderBy(*order).limit(keep)


def similarity_rows(df: DataFrame, id_column: str, vector: str, candidates: DataFrame, candidate_id: str, candidate_vector: str) -> DataFrame:
    """Similarity matrix in long form, ``id, candidate, similarity``: the product of both tables."""
    schema = T.StructType(
        [df.schema[id_column], candidates.schema[candidate_id], T.StructField("similarity", T.DoubleType())]
    )

    def kernel(load):
        def multiply(batches: Batches) -> Batches:
            block = load()
            ids, wanted = block[candidate_id].to_numpy(), as_matrix(block[candidate_vector])
            if not len(ids):
                return
            step = max(1, CELLS // len(ids))
            for batch in batches:
                batch, x = batch_vectors(batch)
                names = batch.column(id_column).to_numpy(zero_copy_only=False)
                for at in range(0, len(x), step):
                    part = x[at : at + step]
                    columns = [
                        pa.array(np.repeat(names[at : at + step], len(ids))),
                        pa.array(np.tile(ids, len(part))),
                        pa.array((part @ wanted.T).ravel()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=[id_column, candidate_id, "similarity"])

        return multiply

    left = vectors_of(df, vector, F.col(id_column))
    return against_blocks(left, candidates, candidate_id, candidate_vector, kernel, schema, block_bytes=BLOCK_BYTES // 64)


def nearest_rows(
    queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, vector: str, k: int, corpus_vector: str | None = None, digits: int = 12
) -> DataFrame:
    """``query, neighbour, similarity, rank``: the ``k`` corpus rows most similar to each query.

    Each task keeps its own best ``k`` per query, so only those are shuffled. Ties go to the smaller corpus
    id; ids may be of any type that orders.
    """
    corpus_vector, slack = corpus_vector or vector, 10.0**-digits
    q_type, c_type = (d.schema[i].dataType.simpleString() for d, i in ((queries, query_id), (corpus, corpus_id)))

    def kernel(load):
        def best(batches: Batches) -> Batches:
            block = load()
            ids, wanted = block[query_id].to_numpy(), as_matrix(block[vector])
            if not len(ids) or k < 1:
                return
            best_id, best_sim = None, np.full((len(ids), k), -np.inf)  # best first, -inf where none has come
            step = max(1, CELLS // len(ids))
            for batch in batches:
                batch, x = batch_vectors(batch)
                names = batch.column("c").to_numpy(zero_copy_only=False)
                if best_id is None:
                    best_id = np.empty((len(ids), k), dtype=names.dtype)
                for at in range(0, len(x), step):
                    here = names[at : at + step]
                    sims = wanted @ x[at : at + step].T
                    # few pairs reach what a query holds already; only those are rounded and ranked
                    row, place = np.nonzero(sims >= best_sim[:, -1:] - slack)
                    found = np.round(sims[row, place], digits)
                    last = best_sim[row, -1]
                    better = found > last
                    ties = np.flatnonzero(found == last)
                    better[ties] = here[place[ties]] < best_id[row[ties], -1]
                    row, place, found = row[better], place[better], found[better]
                    if not len(row):
                        continue
                    changed = np.unique(row)
                    rows = np.concatenate([np.repeat(changed, k), row])
                    held_sim = np.concatenate([best_sim[changed].ravel(), found])
                    held_id = np.concatenate([best_id[changed].ravel(), here[place]])
                    full = held_sim > -np.inf
                    rows, held_sim, held_id = rows[full], held_sim[full], held_id[full]
                    order = np.lexsort((np.unique(held_id, return_inverse=True)[1], -held_sim, rows))
                    rows, held_sim, held_id = rows[order], held_sim[order], held_id[order]
                    rank = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    first = rank < k
                    best_sim[rows[first], rank[first]] = held_sim[first]
                    best_id[rows[first], rank[first]] = held_id[first]
            full = best_sim > -np.inf
            if full.any():
                columns = {"query": np.repeat(ids, full.sum(axis=1)), "neighbour": best_id[full], "similarity": best_sim[full]}
                yield pa.RecordBatch.from_pydict(columns)

        return best

    vectors = vectors_of(corpus, corpus_vector, F.col(corpus_id).alias("c"))
    schema = f"query {q_type}, neighbour {c_type}, similarity double"
    return rank_neighbours(against_blocks(vectors, queries, query_id, vector, kernel, schema, block_bytes=BLOCK_BYTES // 8), k)


def rank_neighbours(found: DataFrame, k: int) -> DataFrame:
    # at most k rows per query and task arrive here
    ranked = Window.partitionBy("query").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
