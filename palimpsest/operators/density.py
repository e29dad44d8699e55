"""Density clustering in which only vectors near each other meet.

Space is cut into cells around sampled centres: a vector's own cell is that of its nearest centre. A vector within
ε of a member of another cell is at most ε away from the plane half-way between both centres, and within the
cell's radius plus ε of its centre; so a vector compared with the rows of the cells that pass both tests meets every
neighbour, and no pair is missed. Cells of any size are compared tile by tile, and no copy of a vector is written
for the cells it reaches. Single precision finds the pairs that may be near; those at the limit are measured again in
double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.functions.vectors import usable
from palimpsest.operators.clusters import NOISE, connected_labels
from palimpsest.operators.scoring import Batches, against_blocks, as_matrix, batch_vectors, vectors_of
from palimpsest.session import cut_lineage

#: Centres at most; what they take on the driver is so many vectors.
MOST_CELLS = 4096
#: Rows of one side that a task compares at a time.
TILE_ROWS = 4096
#: Rows that a task holds of what it found before it shortens them.
FOUND_ROWS = 2_000_000
#: Bytes of vectors of the left side that a task sorts and compares at a time.
HELD_BYTES = 32 * 1024 * 1024
#: Rows of the left side that are compared with a tile.
STRIP_ROWS = 1024
#: Tasks for each core that the left side of a comparison is dealt to.
TASKS = 4


def close(x: np.ndarray, y: np.ndarray, eps: float) -> np.ndarray:
    """Which rows of both sides lie within ``eps`` of each other."""
    squared = (x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T)
    return squared <= eps * eps + 1e-12


Tiles = Iterator[tuple[np.ndarray, int, int]]


class Space:
    """The centres and radii of cells, and tests of nearness that err on the side of too near by ``slack``."""

    def __init__(self, centres: np.ndarray, radius: np.ndarray, eps: float):
        self.eps, self.middle, dim = eps, centres.mean(axis=0), centres.shape[1]
        largest = float(np.sqrt(((centres - self.middle) ** 2).sum(1)).max() + max(radius.max(), 0.0) + eps) ** 2
        self.kind, self.slack = np.float32, (dim + 8) * 2.0**-21 * largest
        if self.slack > eps * eps / 8:
            self.kind, self.slack = np.float64, (dim + 8) * 2.0**-50 * largest
        self.reach = np.where(radius >= 0, (np.maximum(radius, 0) + eps) ** 2 + self.slack, -np.inf).astype(self.kind)
        self.centres, self.left_centres = self.right(centres), self.left(centres)

    def left(self, x: np.ndarray) -> np.ndarray:
        """Rows whose product with those of ``right`` is minus half of the squared distance."""
        x = x - self.middle
        return np.concatenate([x, (x * x).sum(1)[:, None] / -2, np.ones((len(x), 1))], axis=1).astype(self.kind)

    def right(self, y: np.ndarray) -> np.ndarray:
        y = y - self.middle
        return np.concatenate([y, np.ones((len(y), 1)), (y * y).sum(1)[:, None] / -2], axis=1).astype(self.kind)

    def own(self, left: np.ndarray) -> np.ndarray:
        return (left @ self.centres.T).argmax(axis=1)

    def reached(self, left: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Whether each row (as ``left`` gives it) may have neighbours in each cell."""
        squared = left @ self.centres.T
        squared *= -2
        cells, rank = np.unique(own, return_inverse=True)
        apart = np.sqrt(np.maximum(self.left_centres[cells] @ self.centres.T * -2 + self.slack, 0))
        near = squared <= self.reach
        squared -= squared[np.arange(len(left)), own][:, None]
        apart *= 2 * self.eps
        apart += 2 * self.slack
        near &= squared <= apart[rank]
        return near

    def pairs(self, x: np.ndarray, left: np.ndarray, y: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both sides that lie within ``eps`` of each other, by the rows of the left one."""
        product = (left @ right.T).ravel()
        limit = -self.eps * self.eps / 2
        found = np.flatnonzero(product >= self.kind(limit - self.slack))
        row, place = np.divmod(found, len(right))
        doubt = np.flatnonzero(product[found] <= self.kind(limit + self.slack))
        if len(doubt):
            a, b = x[row[doubt]], y[place[doubt]]
            squared = (a * a).sum(1) + (b * b).sum(1) - 2.0 * (a * b).sum(1)
            far = doubt[squared > self.eps * self.eps + 1e-12]
            row, place = np.delete(row, far), np.delete(place, far)
        return row, place


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)
    return np.sqrt(np.maximum(squared, 0.0))


def _in_cells(points: DataFrame, centres: np.ndarray, space: Space | None, keep: tuple[str, ...]) -> DataFrame:
    """``cell`` (and ``distance``) of each point, or a row for each cell it may have neighbours in."""
    shared = points.sparkSession.sparkContext.broadcast((centres, space))
    kinds = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keep)

    def place(batches: Batches) -> Batches:
        around, reach = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, x = batch_vectors(whole.slice(at, 1024))
                if not batch.num_rows:
                    continue
                far = _distances(x, around)
                row, cell = np.arange(len(x)), far.argmin(axis=1)
                if reach is not None:
                    row, cell = np.nonzero(reach.reached(reach.left(x), cell))
                took = batch.take(pa.array(row))
                columns = [took.column(c) for c in keep] + [pa.array(cell.astype(np.int64)), pa.array(far[row, cell])]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "cell", "distance"])

    return points.select(*keep).mapInArrow(place, f"{kinds}, cell long, distance double")


class Cells:
    """Cells around centres drawn by hash from the points, and their radii."""

    def __init__(self, points: DataFrame, eps: float):
        """``points`` is a table of ``id, v`` and further columns with distinct vectors."""
        self.points, self.eps = points, eps
        self.rows = points.count()
        cells = min(MOST_CELLS, max(1, ceil(sqrt(self.rows))))
        drawn = points.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(cells).collect()
        self.centres = np.array([r["v"] for r in drawn])
        self.radius, self.tiles = np.full(len(drawn), -np.inf), np.ones(len(drawn), np.int64)
        placed = _in_cells(points, self.centres, None, ("id", "v"))
        for r in placed.groupBy("cell").agg(F.max("distance").alias("r"), F.count(F.lit(1)).alias("n")).collect():  # a row a cell
            self.radius[r["cell"]], self.tiles[r["cell"]] = r["r"], ceil(r["n"] / TILE_ROWS)
        self.space = Space(self.centres, self.radius, eps)

    def own(self, points: DataFrame, keep: tuple[str, ...] = ("id", "v")) -> DataFrame:
        return _in_cells(points, self.centres, None, keep).drop("distance")

    def copies(self, points: DataFrame, keep: tuple[str, ...] = ("id", "v")) -> DataFrame:
        return _in_cells(points, self.centres, self.space, keep).drop("distance")

    def compare(self, left: DataFrame, right: DataFrame, worker: Callable[..., Iterator[dict]], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """What ``worker`` finds between rows of ``left`` and the rows of ``right`` that may be their neighbours.

        ``worker(mine, x, others, y, tiles)`` gets tables and matrices of a share of both sides and the tiles to look
        at, each as some rows of ``x`` and the bounds of rows of ``y``, with ``near`` of them: the pairs within ε. A
        row of ``left`` meets each row of ``right`` that may be its neighbour, once. The right side comes in blocks, its
        cells whole but for those of more rows than a tile, and the copies in other cells are never made: which cells a
        row reaches is worked out where it is, for rows of one cell together.
        """
        spark = self.points.sparkSession
        tasks = TASKS * spark.sparkContext.defaultParallelism
        mine = left.select("id", "v").repartition(tasks, "id")
        shared = spark.sparkContext.broadcast((self.space, self.tiles))
        tiles = F.element_at(F.split(F.lit(",".join(map(str, self.tiles))), ",").cast("array<long>"), (F.col("cell") + 1).cast("int"))
        share = F.pmod(F.xxhash64("id"), tiles) * F.lit(len(self.tiles)).cast("long")
        others = cut_lineage(self.own(right, ("id", "v", *keep)).withColumn("tile", F.col("cell") + share))
        empty = spark.createDataFrame([], schema).toArrow().schema
        rows = max(STRIP_ROWS, HELD_BYTES // (8 * self.centres.shape[1]))

        def shares(batches: Batches) -> Iterator[tuple[pa.Table, np.ndarray]]:
            held, size = [], 0
            for batch in batches:
                held.append(batch_vectors(batch))
                size += held[-1][0].num_rows
                if size >= rows:
                    yield pa.Table.from_batches([b for b, _ in held]), np.concatenate([x for _, x in held if len(x)])
                    held, size = [], 0
            if size:
                yield pa.Table.from_batches([b for b, _ in held]), np.concatenate([x for _, x in held if len(x)])

        def start(load):
            def run(batches: Batches) -> Batches:
                block = load()
                if not len(block):
                    return
                space, cells = shared.value[0], len(shared.value[1])
                block = block.sort_values(["cell", "tile"], kind="stable")
                y = as_matrix(block["v"])
                ends = np.searchsorted(block["cell"].to_numpy(), np.arange(cells + 1))
                others = pa.Table.from_pandas(block[["id", *keep]], preserve_index=False)
                right = space.right(y)
                for table, x in shares(batches):
                    left = space.left(x)
                    own = np.concatenate([space.own(left[at : at + STRIP_ROWS]) for at in range(0, len(left), STRIP_ROWS)])
                    order = np.argsort(own, kind="stable")
                    table, x, left, own = table.take(pa.array(order)), x[order], left[order], own[order]

                    def tiles(x=x, left=left, own=own) -> Tiles:
                        for at in range(0, len(x), STRIP_ROWS):
                            reached = space.reached(left[at : at + STRIP_ROWS], own[at : at + STRIP_ROWS])
                            reached = np.ascontiguousarray((reached & (np.diff(ends) > 0)[None, :]).T)
                            for cell in np.flatnonzero(reached.any(axis=1)):
                                some = at + np.flatnonzero(reached[cell])
                                for low in range(ends[cell], ends[cell + 1], TILE_ROWS):
                                    yield some, low, min(low + TILE_ROWS, ends[cell + 1])

                    def near(some: np.ndarray, low: int, high: int, x=x, left=left) -> tuple[np.ndarray, np.ndarray]:
                        row, place = space.pairs(x[some], left[some], y[low:high], right[low:high])
                        return some[row], low + place

                    for found in worker(table, x, others, y, tiles(), near):
                        yield from pa.table(found, schema=empty).to_batches(max_chunksize=65536)

            return run

        return against_blocks(mine, others, "tile", "v", start, schema, keep=("id", *keep, "cell"))

    def meet(self, left: DataFrame, right: DataFrame, kernel, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
        """``kernel(mine, x, others, y)`` of tables and matrices, for rows of ``left`` and the tiles that they reach."""
        empty = left.sparkSession.createDataFrame([], schema).toArrow().schema

        def each(mine, x, others, y, tiles, near):
            held, size = [], 0
            for rows, low, high in tiles:
                held.append(pa.table(kernel(mine.take(rows), x[rows], others.slice(low, high - low), y[low:high]), schema=empty))
                size += held[-1].num_rows
                if size > FOUND_ROWS:
                    yield pa.concat_tables(held).to_pydict()
                    held, size = [], 0
            if held:
                yield pa.concat_tables(held).to_pydict()

        return self.compare(left, right, each, schema, keep)

    def comparisons(self, left: DataFrame, right: DataFrame) -> int:
        """Pairs of vectors that ``meet`` compares."""
        a = self.own(left).groupBy("cell").agg(F.count(F.lit(1)).alias("a"))
        b = self.copies(right).groupBy("cell").agg(F.count(F.lit(1)).alias("b"))
        return a.join(b, "cell").agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").to_numpy()


def _roots(root: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """The root of each node, kept as its parent."""
    found = root[nodes]
    while True:
        upper = root[found]
        if (upper == found).all():
            break
        found = upper
    root[nodes] = found
    return found


def _hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the nodes ``a`` to the nodes ``b``; a root is its own parent, and of joined ones the smaller stays."""
    while len(a):
        a, b = _roots(root, a), _roots(root, b)
        apart = np.flatnonzero(a != b)
        a, b = a[apart], b[apart]
        root[np.maximum(a, b)] = np.minimum(a, b)  # of several pairs of a root one is taken, the others come again


def density_clusters(df: DataFrame, id_column: str, vector: str, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """``id, cluster``: core points have at least ``min_samples`` rows (themselves included) within ``eps``.

    A cluster is named after its smallest core id; a border point joins the smallest-named cluster it touches. The
    rest is noise, rows without a vector included: −1 for whole-number ids, null for ids of other types. Copies of
    one vector are compared once with their weight. Ids are unique and of any type that orders.
    """
    kind = df.schema[id_column].dataType.simpleString()
    whole = kind in ("tinyint", "smallint", "int", "bigint")
    kind = "bigint" if whole else kind
    nothing = F.lit(NOISE if whole else None).cast(kind)
    every = cut_lineage(vectors_of(df, vector, F.col(id_column).cast(kind).alias("id")))
    rows = every.filter(F.coalesce(usable(F.col("v")), F.lit(False)))
    missing = every.filter(~F.coalesce(usable(F.col("v")), F.lit(False)))
    missing = missing.select(F.col("id").alias(id_column), nothing.alias("cluster"))
    points = cut_lineage(rows.groupBy("v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")))
    if points.isEmpty():
        return missing
    cells = Cells(points, eps)

    def weigh(mine, x, others, y, tiles, near):
        weight, total = others.column("weight").to_numpy().astype(np.float64), np.zeros(len(x))
        for tile in tiles:
            row, place = near(*tile)
            if len(row):
                total[row[0] : row[-1] + 1] += np.bincount(row - row[0], weights=weight[place])
        yield {"id": mine.column("id"), "neighbours": total}

    counted = cells.compare(points, points, weigh, f"id {kind}, neighbours double", ("weight",)).groupBy("id").agg(F.sum("neighbours").alias("n"))
    points = cut_lineage(points.join(counted, "id").select("id", "v", (F.col("n") >= min_samples).alias("core")))
    core, border = points.filter("core").select("id", "v"), points.filter(~F.col("core")).select("id", "v")

    def join(mine, x, others, y, tiles, near):
        # pieces grow through all tiles, and a star leaves for each
        root = np.arange(len(x) + len(y))
        for tile in tiles:
            row, place = near(*tile)
            _hook(root, row, len(x) + place)
        _roots(root, np.arange(len(root)))
        joined = np.flatnonzero(np.bincount(root, minlength=len(root))[root] > 1)
        names, rank = np.unique(np.concatenate([_ids(mine), _ids(others)])[joined], return_inverse=True)
        least = np.full(len(root), len(names))
        np.minimum.at(least, root[joined], rank)
        # around the smallest id, so that tasks that find the same piece send the same edges
        first, last = np.divmod(np.unique(rank * len(names) + least[root[joined]]), max(1, len(names)))
        apart = first != last
        yield {"a": names[first[apart]], "b": names[last[apart]]}

    edges = cells.compare(core, core, join, f"a {kind}, b {kind}")
    labels = cut_lineage(connected_labels(core, edges))

    def touch(mine, x, others, y, tiles, near):
        names, rank = np.unique(others.column("label").to_numpy(), return_inverse=True)
        best = np.full(len(x), len(names))
        for tile in tiles:
            row, place = near(*tile)
            if len(row):
                first = np.flatnonzero(np.diff(row, prepend=-1))
                best[row[first]] = np.minimum(best[row[first]], np.minimum.reduceat(rank[place], first))
        hit = np.flatnonzero(best < len(names))
        yield {"id": mine.column("id").take(pa.array(hit)), "label": names[best[hit]]}

    touched = cells.compare(border, core.join(labels, "id"), touch, f"id {kind}, label {kind}", ("label",))
    named = labels.unionByName(touched.groupBy("id").agg(F.min("label").alias("label")))
    labelled = points.join(named, "id", "left").select("v", F.coalesce("label", nothing).alias("cluster"))
    return rows.join(labelled, "v").select(F.col("id").alias(id_column), "cluster").union(missing)
