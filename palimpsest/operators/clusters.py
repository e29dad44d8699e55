"""Dimension reduction, clustering and the best mean direction of a set of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.functions.vectors import dot, norm, squared_distance, to_double, usable, vector_literal
from palimpsest.operators.ordering import with_shuffled_position
from palimpsest.operators.scoring import (
    BLOCK_BYTES,
    CELLS,
    MOMENT_DIM_LIMIT,
    Batches,
    Moments,
    against_blocks,
    as_matrix,
    batch_vectors,
    group_tensors,
    summed_tensors,
    vector_dim,
    vectors_of,
)
from palimpsest.session import cut_lineage

NOISE = -1


def _with_vector(df: DataFrame, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a usable vector, as ``_v`` for the learner, and the other rows."""
    fit = F.coalesce(usable(to_double(F.col(vector))), F.lit(False))
    return df.filter(fit).withColumn("_v", array_to_vector(to_double(F.col(vector)))), df.filter(~fit)


def project(df: DataFrame, vector: str, dim: int, name: str = "projected") -> DataFrame:
    """PCA projection of centred vectors to ``dim`` components (their signs are arbitrary).

    Rows without a usable vector take no part and get null.
    """
    ready, rest = _with_vector(df, vector)
    centre = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(ready)
    centred = centre.transform(ready)
    model = PCA(k=dim, inputCol="_c", outputCol="_p").fit(centred)
    done = model.transform(centred).withColumn(name, vector_to_array("_p")).drop("_v", "_c", "_p")
    return done.unionByName(rest.withColumn(name, F.lit(None).cast("array<double>")))


def explained_variance(df: DataFrame, vector: str, dim: int) -> list[float]:
    ready = _with_vector(df, vector)[0].select("_v")
    return PCA(k=dim, inputCol="_v", outputCol="_p").fit(ready).explainedVariance.toArray().tolist()


def kmeans(
    df: DataFrame, vector: str, k: int, seed: int = 0, name: str = "cluster", max_iter: int = 20, ids: tuple[str, ...] = (), block_bytes: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows with their cluster (null without a usable vector), and the table of centres ``cluster, centre``.

    Lloyd's steps from ``k`` rows drawn by a seeded hash of ``ids`` (of the vector where none are named), until no
    centre moves or ``max_iter`` steps are done. Centres are a table and a step is a join: each row with its nearest
    centre (ties to the smaller number), each centre with the mean of its rows; one without rows stays. With fewer
    rows than ``k`` there are as many clusters as rows.
    """
    keyed = df.withColumn("_row", F.monotonically_increasing_id())
    keyed = cut_lineage(keyed.withColumn("_fit", F.coalesce(usable(to_double(F.col(vector))), F.lit(False))))
    rows = cut_lineage(keyed.filter("_fit").select("_row", to_double(F.col(vector)).alias("_x"), *[F.col(c).alias(f"_id{i}") for i, c in enumerate(ids)]))
    named = [f"_id{i}" for i in range(len(ids))]
    hashed = rows if ids else rows.withColumn("_id0", F.to_json(F.struct("_x")))
    drawn = with_shuffled_position(hashed, seed, named or ["_id0"], "cluster").filter(F.col("cluster") < k)
    centres = cut_lineage(drawn.select(F.col("cluster").cast("int").alias("cluster"), F.col("_x").alias("centre")))
    points = rows.select("_row", "_x")
    for _ in range(max_iter):
        placed = nearest_centre(points, "_x", centres, block_bytes)
        moved = cut_lineage(centres.join(_cluster_means(placed, "_x"), "cluster", "left").select("cluster", F.coalesce("mean", "centre").alias("centre"), F.col("centre").alias("_old")))
        settled = moved.filter(squared_distance(F.col("centre"), F.col("_old")) > 1e-20).isEmpty()
        centres = moved.select("cluster", "centre")
        if settled:
            break
    found = nearest_centre(points, "_x", centres, block_bytes).select("_row", F.col("nearest").alias("_cluster"))
    labelled = keyed.drop("_fit").join(found, "_row", "left").withColumn(name, F.col("_cluster")).drop("_row", "_cluster")
    return labelled, centres


def _cluster_means(placed: DataFrame, vector: str) -> DataFrame:
    """``cluster, mean`` of rows with their ``nearest``: sums inside tasks, then cell by cell."""

    def add(batches: Batches) -> Batches:
        for batch in batches:
            batch, x = batch_vectors(batch, vector)
            if not batch.num_rows:
                continue
            cluster = batch.column("nearest").to_numpy()
            order = np.argsort(cluster, kind="stable")
            names, firsts, sizes = np.unique(cluster[order], return_index=True, return_counts=True)
            sums = np.add.reduceat(x[order], firsts, axis=0)
            columns = [pa.array(names), pa.array(list(sums), pa.list_(pa.float64())), pa.array(sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=["cluster", "sums", "n"])

    sums = placed.select("nearest", vector).mapInArrow(add, "cluster int, sums array<double>, n long")
    cells = sums.select("cluster", "n", F.posexplode("sums").alias("at", "x")).groupBy("cluster", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "x")))  # one entry a component
    return cells.groupBy("cluster").agg(F.transform(ordered, lambda s: s["x"]).alias("mean"))


def clusters_for(rows: int, per_cluster: int = 100) -> int:
    """Number of clusters for a corpus: one per ``per_cluster`` rows."""
    return max(2, rows // per_cluster)


def nearest_centre(df: DataFrame, vector: str, centres: DataFrame, block_bytes: int | None = None) -> DataFrame:
    """Add ``nearest`` and ``distance`` to the closest of the centres ``cluster, centre``.

    Ties go to the smaller cluster; rows without a vector get nulls, as all do without centres. Centres that by count
    fit one block go to all tasks; more of them are blocks that meet the rows on the executors, and a row keeps the
    nearest of its blocks' answers.
    """
    table = centres.select("cluster", to_double(F.col("centre")).alias("centre"))
    known = table.count()
    if not known:
        return df.withColumn("nearest", F.lit(None).cast("int")).withColumn("distance", F.lit(None).cast("double"))
    block_bytes = block_bytes or BLOCK_BYTES

    def kernel(load, names):
        def place(batches: Batches) -> Batches:
            block = load().sort_values("cluster")
            clusters, points = block["cluster"].to_numpy(dtype=np.int64), as_matrix(block["centre"])
            step = max(1, CELLS // points.size)
            for batch in batches:
                numbered = batch.append_column("_n", pa.array(np.arange(batch.num_rows)))
                whole, x = batch_vectors(numbered, "_v")
                where = whole.column("_n").to_numpy()
                nearest = np.zeros(batch.num_rows, dtype=np.int64)
                distance = np.full(batch.num_rows, np.nan)
                for at in range(0, len(x), step):
                    squared = ((x[at : at + step, None, :] - points[None]) ** 2).sum(axis=2)
                    best = squared.argmin(axis=1)
                    nearest[where[at : at + step]] = clusters[best]
                    distance[where[at : at + step]] = np.sqrt(squared[np.arange(len(best)), best])
                missing = np.isnan(distance)
                added = [pa.array(nearest.astype(np.int32), mask=missing), pa.array(distance, mask=missing)]
                columns = [batch.column(c) for c in names] + added
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "nearest", "distance"])

        return place

    added = [T.StructField("nearest", T.IntegerType()), T.StructField("distance", T.DoubleType())]
    if known <= max(1, block_bytes // (8 * vector_dim(table, "centre"))):
        shared = df.sparkSession.sparkContext.broadcast(table.toArrow().to_pandas())
        schema = T.StructType([*df.schema.fields, *added])
        return df.withColumn("_v", to_double(F.col(vector))).mapInArrow(kernel(lambda: shared.value, df.columns), schema)
    keyed = cut_lineage(df.withColumn("_key", F.monotonically_increasing_id()))
    schema = T.StructType([T.StructField("_key", T.LongType()), *added])
    left = keyed.select("_key", to_double(F.col(vector)).alias("_v"))
    answers = against_blocks(left, table, "cluster", "centre", lambda load: kernel(load, ["_key"]), schema, block_bytes=block_bytes)
    best = answers.filter("distance IS NOT NULL").groupBy("_key").agg(F.min(F.struct("distance", "nearest")).alias("_best"))
    found = keyed.join(best, "_key", "left")
    return found.select(*df.columns, F.col("_best.nearest").alias("nearest"), F.col("_best.distance").alias("distance"))


def most_typical(df: DataFrame, order: tuple[str, ...] = ("distance",), k: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(k)


# ---------------------------------------------------------------------------------------------
# connected components


def connected_labels(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``id, label``: the smallest id reachable over undirected ``a, b`` edges.

    Each round takes the smallest neighbouring label and then the label's own label (pointer
    jumping), so the number of rounds grows with the logarithm of the longest chain. State is
    checkpointed every round.
    """
    both = cut_lineage(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = cut_lineage(nodes.select("id", F.col("id").alias("label")))
    for _ in range(max_rounds):
        offered = (
            both.join(labels.select(F.col("id").alias("b"), "label"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("label").alias("offer"))
        )
        lower = labels.join(offered, "id", "left").select(
            "id", F.least("label", F.coalesce("offer", "label")).alias("hop"), F.col("label").alias("old")
        )
        roots = lower.select(F.col("id").alias("hop"), F.col("hop").alias("root"))
        moved = lower.join(roots, "hop").select("id", F.least("root", "hop").alias("label"), "old")
        moved = cut_lineage(moved)
        changed = not moved.filter(F.col("label") != F.col("old")).isEmpty()
        labels = moved.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError("labels did not settle")


# ---------------------------------------------------------------------------------------------
# best mean direction


def _climb(step, start: np.ndarray, alpha: float, max_iter: int, tolerance: float) -> tuple[np.ndarray, int]:
    e = start / np.linalg.norm(start)
    for iteration in range(1, max_iter + 1):
        moved = step(e) + alpha * e
        length = np.linalg.norm(moved)
        if length == 0.0:
            return e, iteration
        moved = moved / length
        if np.linalg.norm(moved - e) <= tolerance:
            return moved, iteration
        e = moved
    return e, max_iter


def _climb_moments(moments: Moments, start: np.ndarray, alpha: float | None, max_iter: int, tolerance: float) -> tuple[np.ndarray, int]:
    """As ``_climb``; without ``alpha`` each step takes the least shift under which the score is convex where it stands."""
    if alpha is not None:
        return _climb(moments.mean_direction, start, alpha, max_iter, tolerance)
    e = start / np.linalg.norm(start)
    for iteration in range(1, max_iter + 1):
        curve = moments.tensor @ e / moments.count
        values = np.linalg.eigvalsh(curve)
        shift = max(0.0, -2.0 * values[0]) + 1e-3 * np.abs(values).max()
        moved = curve @ e + shift * e
        length = np.linalg.norm(moved)
        if length == 0.0:
            return e, iteration
        moved = moved / length
        if np.linalg.norm(moved - e) <= tolerance:
            return moved, iteration
        e = moved
    return e, max_iter


_FOUND = "score double, start_score double, residual double, iterations int, direction array<double>"


def _found(step, e: np.ndarray, start: np.ndarray, iterations: int) -> tuple:
    there = step(e)
    pull = np.linalg.norm(there)
    residual = float(np.linalg.norm(there / pull - e)) if pull > 0 else 0.0
    return float(there @ e), float(step(start) @ start), residual, iterations, [float(x) for x in e]


def _directions_by_moments(grouped: DataFrame, dim: int, start: np.ndarray, alpha: float | None, max_iter: int, tolerance: float) -> DataFrame:
    """A group's moments stay where they were added up, and its direction climbs there."""
    kind = grouped.schema["grp"].dataType.simpleString()

    def climb(batches: Batches) -> Batches:
        for key, tensor, n in summed_tensors(batches, dim):
            moments = Moments(tensor, n)
            e, iterations = _climb_moments(moments, start, alpha, max_iter, tolerance)
            row = (key, *_found(moments.mean_direction, e, start, iterations))
            yield pa.RecordBatch.from_pylist([dict(zip(["grp", "score", "start_score", "residual", "iterations", "direction"], row, strict=True))], schema=schema)

    shape = f"grp {kind}, {_FOUND}"
    schema = grouped.sparkSession.createDataFrame([], shape).toArrow().schema
    return group_tensors(grouped, dim).repartition("grp").sortWithinPartitions("grp").mapInArrow(climb, shape)


def _directions_in_passes(grouped: DataFrame, dim: int, start: np.ndarray, alpha: float, max_iter: int, tolerance: float, block_bytes: int) -> DataFrame:
    """All groups' directions move in one keyed aggregate an iteration; those that have settled drop out."""
    spark = grouped.sparkSession
    kind = grouped.schema["grp"].dataType.simpleString()
    rows = cut_lineage(grouped)
    state = cut_lineage(
        rows.select("grp").distinct().select("grp", vector_literal(start).alias("e"), F.lit(0).alias("iterations"), F.lit(False).alias("done"), *[F.lit(None).cast("double").alias(c) for c in ("score", "start_score", "residual")])
    )

    def add(batches: Batches) -> Batches:
        for batch in batches:
            x, e = (batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in ("v", "e"))
            names, which = np.unique(batch.column("grp").to_numpy(zero_copy_only=False), return_inverse=True)
            pulled = ((x * e).sum(axis=1) ** 2)[:, None] * x
            order = np.argsort(which, kind="stable")
            firsts = np.searchsorted(which[order], np.arange(len(names)))
            sums = np.add.reduceat(pulled[order], firsts, axis=0)
            columns = [pa.array(names), pa.array(list(sums), pa.list_(pa.float64())), pa.array(np.bincount(which))]
            yield pa.RecordBatch.from_arrays(columns, names=["grp", "sums", "n"])

    few = state.count() * dim * 8 <= block_bytes

    def pulls(directions: DataFrame) -> DataFrame:
        """``grp, pull``: the mean of (d·e)² d for each group's direction."""
        held = directions.select("grp", "e")
        joined = rows.join(F.broadcast(held) if few else held, "grp")
        cells = joined.mapInArrow(add, f"grp {kind}, sums array<double>, n long").select("grp", "n", F.posexplode("sums").alias("at", "x"))
        means = cells.groupBy("grp", "at").agg((F.sum("x") / F.sum("n")).alias("x"))
        ordered = F.array_sort(F.collect_list(F.struct("at", "x")))  # one entry a component
        return means.groupBy("grp").agg(F.transform(ordered, lambda s: s["x"]).alias("pull"))

    def by_length(v, length):
        return F.transform(v, lambda x: x / length)

    for iteration in range(1, max_iter + 2):
        active = state.filter(~F.col("done"))
        here = pulls(active)
        pulled = active.join(here, "grp").withColumn("_pull", norm(F.col("pull")))
        score = dot(F.col("pull"), F.col("e"))
        # at the last look nothing moves any more: score and residual belong to the direction
        target = F.zip_with("pull", "e", lambda p, x: p + alpha * x)
        pulled = pulled.withColumn("_target", target).withColumn("_length", norm(F.col("_target")))
        moved = F.when(F.col("_length") > 0, by_length(F.col("_target"), F.col("_length"))).otherwise(F.col("e"))
        pulled = pulled.withColumn("_moved", moved).withColumn("_far", F.sqrt(squared_distance(F.col("_moved"), F.col("e"))))
        ends = (F.col("_far") <= tolerance) | F.lit(iteration > max_iter)
        residual = F.when(F.col("_pull") > 0, F.sqrt(squared_distance(by_length(F.col("pull"), F.col("_pull")), F.col("e")))).otherwise(0.0)
        looked = pulled.select(
            "grp",
            F.when(ends, F.col("e")).otherwise(F.col("_moved")).alias("e"),
            F.lit(min(iteration, max_iter)).alias("iterations"),
            ends.alias("done"),
            score.alias("score"),
            F.coalesce("start_score", score).alias("start_score"),
            residual.alias("residual"),
        )
        state = cut_lineage(looked.unionByName(state.filter("done")))
        if state.filter(~F.col("done")).isEmpty():
            break
    return state.select("grp", "score", "start_score", "residual", "iterations", F.col("e").alias("direction"))


def best_direction(
    df: DataFrame,
    vector: str,
    start: list[float],
    alpha: float | None = 2.0,
    max_iter: int = 400,
    tolerance: float = 1e-10,
    group: str | None = None,
    block_bytes: int | None = None,
) -> DataFrame:
    """Direction with locally maximal mean cos³, per group or for the whole table.

    Shifted power iteration ``e ← normalise(mean((d·e)² d) + α e)`` on unit rows; at α = 2 the score never falls. With
    ``alpha`` None the shift follows the curvature, which takes far fewer steps on vectors that point everywhere
    (α = 2 where vectors are too wide for it). Up to 64 components the data is read once, into a tensor of moments a group; wider vectors take one aggregate over
    all groups per iteration. Neither has a limit on the number of groups, and none passes through the driver.
    Returns ``grp, score, start_score, residual, iterations, direction``; ``residual`` is the length by which the
    direction misses the fixed point ``normalise(mean((d·e)² d))``. Groups are of any type (0 for the whole table);
    null is a group of its own only in name: rows without a group or a vector take no part.
    """
    grp = F.lit(0).cast("long") if group is None else F.col(group)
    grouped = vectors_of(df, vector, grp.alias("grp")).filter(F.col("grp").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    first = np.asarray(start, dtype=np.float64)
    first = first / np.linalg.norm(first)
    dim = len(first)
    if dim <= MOMENT_DIM_LIMIT:
        return _directions_by_moments(grouped, dim, first, alpha, max_iter, tolerance)
    return _directions_in_passes(grouped, dim, first, 2.0 if alpha is None else alpha, max_iter, tolerance, block_bytes or BLOCK_BYTES)
