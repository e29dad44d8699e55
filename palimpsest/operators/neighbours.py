"""Approximate nearest rows through buckets of random projections.

Every table of the index cuts space by a few hyperplanes; the sides a vector lies on are its bucket. Neighbours
share a bucket with high probability, and a query also probes the buckets it nearly falls into: those reached by
crossing the one or two planes closest to it. Candidates are compared exactly, inside tasks that hold some
buckets each, and only the best of a query leave a task.
"""

from __future__ import annotations

from hashlib import md5
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.vectors import usable
from palimpsest.operators.ordering import top_per_group
from palimpsest.operators.scoring import Batches, batch_vectors, nearest_rows, rank_neighbours, vector_dim, vectors_of
from palimpsest.session import cut_lineage

#: Distinct vectors that a bucket should hold, about.
BUCKET_ROWS = 64
#: Rows of a bucket, or of several small ones, that one task compares at a time.
TILE_ROWS = 8192
TABLES = 12
PROBES = 16


def planes(tables: int, bits: int, dim: int) -> np.ndarray:
    """Hyperplanes ``[table, bit, component]``, from digests of their numbers: the same on every machine."""
    number = lambda t, b, i: int(md5(f"plane#{t}#{b}#{i}".encode()).hexdigest()[:4], 16) / 32768.0 - 1.0
    return np.array([[[number(t, b, i) for i in range(dim)] for b in range(bits)] for t in range(tables)])


def bits_for(rows: int, bucket_rows: int = BUCKET_ROWS) -> int:
    """Planes a table needs for buckets of about ``bucket_rows`` rows."""
    return max(1, ceil(log2(max(2, rows / bucket_rows))))


def _sides(x: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every row in every table, and the distance to each plane."""
    tables, bits, dim = cuts.shape
    across = (x @ cuts.reshape(-1, dim).T).reshape(len(x), tables, bits)
    return (across >= 0) @ (1 << np.arange(bits)), np.abs(across)


def _crossings(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sets of at most two planes to cross, as rows of zeros and ones, and as masks."""
    sets = [(), *[(i,) for i in range(bits)], *[(i, j) for i in range(bits) for j in range(i + 1, bits)]]
    marks = np.zeros((len(sets), bits))
    for k, own in enumerate(sets):
        marks[k, list(own)] = 1
    return marks, (marks @ (1 << np.arange(bits))).astype(np.int64)


def _dealt(rows: DataFrame, cuts: np.ndarray, probes: int) -> DataFrame:
    """``table, code, id, v``: every row in its bucket of every table, or in ``probes`` buckets of each."""
    shared = rows.sparkSession.sparkContext.broadcast(cuts)
    tables, bits, _ = cuts.shape
    marks, masks = _crossings(bits)
    probes = min(probes, len(masks))

    def deal(batches: Batches) -> Batches:
        for batch in batches:
            batch, x = batch_vectors(batch)
            if not batch.num_rows:
                continue
            codes, margins = _sides(x, shared.value)
            if probes == 1:
                wanted = codes[:, :, None]
            else:
                cost = np.round(margins @ marks.T, 12)
                nearest = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
                wanted = codes[:, :, None] ^ masks[nearest]
            each = tables * probes
            took = batch.take(pa.array(np.repeat(np.arange(batch.num_rows), each)))
            table = np.tile(np.repeat(np.arange(tables), probes), batch.num_rows)
            columns = [pa.array(table), pa.array(wanted.ravel().astype(np.int64)), took.column("id"), took.column("v")]
            yield pa.RecordBatch.from_arrays(columns, names=["table", "code", "id", "v"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(deal, f"table long, code long, id {kind}, v array<double>")


def approximate_rows(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    corpus_id: str,
    vector: str,
    k: int,
    corpus_vector: str | None = None,
    tables: int = TABLES,
    probes: int = PROBES,
    bits: int | None = None,
    digits: int = 12,
) -> DataFrame:
    """``query, neighbour, similarity, rank``, like ``nearest_rows``, of the candidates that share a probed bucket.

    Similarities and ranks of what is found are exact; more ``tables`` and ``probes`` find more (all of it where
    the probes reach every bucket). ``bits`` follows the number of distinct vectors unless given. Of copies of one
    vector the ``k`` smallest ids can be neighbours, so only they are indexed, and a bucket that many near copies
    share is cut into tiles that meet their queries in tasks of their own. Rows without a vector have no
    neighbours and are none; an empty corpus gives an empty table. Ids may be of any type that orders.
    """
    spark = queries.sparkSession
    name = corpus_vector or vector
    points = vectors_of(corpus, name, F.col(corpus_id).alias("id")).filter(F.coalesce(usable(F.col("v")), F.lit(False)))
    points = cut_lineage(top_per_group(points, ["v"], [F.col("id")], k, ["id"]))
    q_type, c_type = (d.schema[i].dataType.simpleString() for d, i in ((queries, query_id), (corpus, corpus_id)))
    schema = f"query {q_type}, neighbour {c_type}, similarity double"
    rows = points.count()
    if not rows:
        return spark.createDataFrame([], f"{schema}, rank int")
    cuts = planes(tables, bits or bits_for(rows), vector_dim(points, "v"))
    groups = max(1, ceil(tables * rows / TILE_ROWS))
    group = F.pmod(F.xxhash64("table", "code"), F.lit(groups)).alias("group")
    held = cut_lineage(_dealt(points, cuts, 1))
    large = held.groupBy("table", "code").count().filter(F.col("count") > TILE_ROWS)
    large = cut_lineage(large.select("table", "code", F.ceil(F.col("count") / TILE_ROWS).alias("tiles")))
    tiles = F.coalesce("tiles", F.lit(1).cast("long"))
    held = held.join(large, ["table", "code"], "left").withColumn("tile", F.pmod(F.xxhash64("id"), tiles))
    asked = _dealt(vectors_of(queries, vector, F.col(query_id).alias("id")), cuts, probes).join(large, ["table", "code"], "left")
    asked = asked.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), tiles - 1)))
    columns = [group, "tile", (F.col("code") * tables + F.col("table")).alias("bucket"), "id", "v"]
    empty = spark.createDataFrame([], schema).toArrow().schema

    def meet(mine: pa.Table, other: pa.Table) -> pa.Table:
        if not mine.num_rows or not other.num_rows:
            return empty.empty_table()
        other = other.sort_by([("bucket", "ascending"), ("id", "ascending")])
        mine = mine.sort_by("bucket")
        x, y = (t.combine_chunks().column("v").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (mine, other))
        own, theirs = mine.column("bucket").to_numpy(), other.column("bucket").to_numpy()
        found: list[tuple] = []
        for bucket in np.intersect1d(own, theirs).tolist():
            a, b = (np.searchsorted(own, [bucket, bucket + 1]), np.searchsorted(theirs, [bucket, bucket + 1]))
            for first in range(a[0], a[1], 1024):
                last = min(a[1], first + 1024)
                near = np.round(x[first:last] @ y[b[0] : b[1]].T, digits)
                # rows of a bucket are in the order of their ids, which a stable sort keeps among equals
                best = np.argsort(-near, axis=1, kind="stable")[:, :k]
                asks = np.repeat(np.arange(first, last), best.shape[1])
                found.append((asks, (best + b[0]).ravel(), np.take_along_axis(near, best, axis=1).ravel()))
        if not found:
            return empty.empty_table()
        asks, hits, near = (np.concatenate(c) for c in zip(*found, strict=True))
        columns = [mine.column("id").take(pa.array(asks)), other.column("id").take(pa.array(hits)), pa.chunked_array([near])]
        return pa.table(columns, names=empty.names).cast(empty)

    pairs = asked.select(*columns).groupBy("group", "tile").cogroup(held.select(*columns).groupBy("group", "tile")).applyInArrow(meet, schema)
    # a query finds a row in several tables; at most k of a bucket and tile come this far
    once = pairs.dropDuplicates(["query", "neighbour"])
    order = [F.desc("similarity"), F.col("neighbour")]
    best = top_per_group(once, ["query"], order, k, ["neighbour"], salts=16)
    return rank_neighbours(best, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours that were found (1 where there are none)."""
    marked = exact.select("query", "neighbour").join(found.select("query", "neighbour", F.lit(1).alias("hit")), ["query", "neighbour"], "left")
    return float(marked.agg(F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0))).first()[0])


def audited_rows(
    queries: DataFrame,
    corpus: DataFrame,
    query_id: str,
    corpus_id: str,
    vector: str,
    k: int,
    corpus_vector: str | None = None,
    least: float = 0.95,
    sample: int = 200,
    tables: int = TABLES,
    bits: int | None = None,
) -> tuple[DataFrame, float]:
    """``approximate_rows`` with as many probes as the audit asks for, and the recall measured.

    ``sample`` queries, drawn by hash, are answered exactly; probes double until their recall reaches ``least``, or
    every bucket within two planes is probed, when tables double instead.
    """
    drawn = cut_lineage(queries.orderBy(F.xxhash64(query_id), query_id).limit(sample))
    exact = cut_lineage(nearest_rows(drawn, corpus, query_id, corpus_id, vector, k, corpus_vector))
    probes = 4
    while True:
        found = approximate_rows(drawn, corpus, query_id, corpus_id, vector, k, corpus_vector, tables, probes, bits)
        reached = recall(found, exact)
        if reached >= least or tables >= 256:
            break
        if probes < 256:
            probes *= 4
        else:
            tables *= 2
    return approximate_rows(queries, corpus, query_id, corpus_id, vector, k, corpus_vector, tables, probes, bits), reached
