"""Embedding near-duplicates by hierarchical navigable small-world graphs, one per shard.

Vectors of one label are dealt into shards of bounded size; each shard gets a graph. For every two shards of
a label, and each with itself, the vectors of one search the graph of the other: down the layers to the
nearest node, then by a beam, then on through every node within reach of the threshold. A sample of the
searches is held against all vectors; beams and reach grow until the audit passes. Found pairs are verified
in double precision. Pairs never become rows: a task returns counts and a spanning star.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.ngram_join import _labels
from palimpsest.llm.registry import query, table
from palimpsest.operators.clusters import connected_labels
from palimpsest.session import cut_lineage

THRESHOLD = 0.93
SHARD_ROWS = 8192
DEGREE = 16
BUILD_BEAM = 64
BEAM = 48
REACH = 0.03
#: Searches of a pair of shards that are audited, and the recall they must show.
AUDITED = 128
RECALL = 0.995
LARGEST_BATCH = 512


class Graph:
    """Layers of neighbour lists over unit vectors; layer l holds the first ``counts[l]`` nodes."""

    def __init__(self, vectors: np.ndarray, counts: list[int], links: list[np.ndarray]):
        self.vectors, self.counts, self.links = vectors, counts, links

    @classmethod
    def build(cls, vectors: np.ndarray) -> Graph:
        """Graph of vectors in random order; each layer has one node in DEGREE of the layer below."""
        counts = [len(vectors)]
        while counts[-1] > DEGREE:
            counts.append(-(-counts[-1] // DEGREE))
        graph = cls(vectors, counts, [np.zeros((0, 0), dtype=np.int32)] * len(counts))
        for layer in range(len(counts) - 1, -1, -1):
            graph._fill(layer)
        return graph

    def _fill(self, layer: int) -> None:
        n, width = self.counts[layer], DEGREE * (2 if layer == 0 else 1)
        links = self.links[layer] = np.full((n, width), -1, dtype=np.int32)
        above = self.counts[layer + 1] if layer + 1 < len(self.counts) else 0
        done = min(n, max(256, above))
        first = self.vectors[:done]
        for at in range(0, done, LARGEST_BATCH):
            rows = np.arange(at, min(done, at + LARGEST_BATCH))
            sims = first[rows] @ first.T
            sims[np.arange(len(rows)), rows] = -np.inf
            k = min(BUILD_BEAM, done - 1)
            if k:
                near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
                links[rows] = self._select(near, np.take_along_axis(sims, near, axis=1), width)
        while done < n:
            rows = np.arange(done, min(n, done + min(done, LARGEST_BATCH)))
            q = self.vectors[rows]
            ids, sims = self._beam(q, self._enter(q, layer), BUILD_BEAM, layer)
            own = q @ q.T
            np.fill_diagonal(own, -np.inf)
            k = min(DEGREE, len(rows) - 1)
            if k:
                near = np.argpartition(-own, k - 1, axis=1)[:, :k]
                ids = np.concatenate([ids, rows[near]], axis=1)
                sims = np.concatenate([sims, np.take_along_axis(own, near, axis=1)], axis=1)
            chosen = self._select(ids, sims, DEGREE)
            links[rows, :DEGREE] = chosen
            self._link_back(links, rows, chosen, width)
            done = int(rows[-1]) + 1

    def _link_back(self, links: np.ndarray, rows: np.ndarray, chosen: np.ndarray, width: int) -> None:
        """Add the new nodes to the lists of the nodes they chose, and prune lists that grew too long."""
        source = np.repeat(rows, chosen.shape[1])
        target = chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        sims = np.einsum("ij,ij->i", self.vectors[source], self.vectors[target])
        order = np.lexsort((-sims, target))
        source, target = source[order], target[order]
        nodes, starts, counts = np.unique(target, return_index=True, return_counts=True)
        place = np.arange(len(target)) - np.repeat(starts, counts)
        kept = place < BUILD_BEAM
        added = np.full((len(nodes), min(BUILD_BEAM, int(counts.max(initial=0)))), -1, dtype=np.int64)
        added[np.repeat(np.arange(len(nodes)), counts)[kept], place[kept]] = source[kept]
        for at in range(0, len(nodes), LARGEST_BATCH):
            some = nodes[at : at + LARGEST_BATCH]
            ids = np.concatenate([links[some].astype(np.int64), added[at : at + LARGEST_BATCH]], axis=1)
            near = np.einsum("ij,ikj->ik", self.vectors[some], self.vectors[np.maximum(ids, 0)])
            near[ids < 0] = -np.inf
            links[some] = self._select(ids, near, width)

    def _select(self, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
        """Neighbours out of candidates: those nearer to the node than to a neighbour chosen before, then the nearest."""
        order = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)
        twice = (ids[:, :, None] == ids[:, None, :]) & (np.arange(ids.shape[1])[:, None] > np.arange(ids.shape[1]))
        valid = (ids >= 0) & np.isfinite(sims) & ~twice.any(axis=2)
        vectors = self.vectors[np.maximum(ids, 0)]
        among = np.matmul(vectors, vectors.transpose(0, 2, 1))
        nearest = np.full(sims.shape, -np.inf)
        kept = np.zeros(sims.shape, dtype=bool)
        count = np.zeros(len(ids), dtype=int)
        for k in range(ids.shape[1]):
            take = valid[:, k] & (count < degree) & (nearest[:, k] < sims[:, k])
            kept[:, k] = take
            count += take
            nearest[take] = np.maximum(nearest[take], among[take][:, :, k])
        rank = np.where(kept, 0, np.where(valid, 1, 2)) * ids.shape[1] + np.arange(ids.shape[1])
        best = np.argsort(rank, axis=1)[:, :degree]
        out = np.where(np.take_along_axis(valid, best, axis=1), np.take_along_axis(ids, best, axis=1), -1)
        return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1).astype(np.int32)

    def _enter(self, q: np.ndarray, layer: int) -> np.ndarray:
        """A node of ``layer`` near each query, by descent through the layers above."""
        at = np.zeros(len(q), dtype=np.int64)
        for above in range(len(self.counts) - 1, layer, -1):
            at = self._beam(q, at, 4, above)[0][:, 0]
        return at

    def _beam(self, q: np.ndarray, start: np.ndarray, size: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest nodes each query finds with a beam, best first (-1 and -inf where there are fewer).

        All queries advance together; a step opens the four best unopened nodes of each beam.
        """
        m, links = len(q), self.links[layer]
        width = min(4, size)
        seen = np.zeros((m, self.counts[layer]), dtype=bool)
        ids = np.full((m, size), -1, dtype=np.int64)
        sims = np.full((m, size), -np.inf)
        opened = np.ones((m, size), dtype=bool)
        ids[:, 0], sims[:, 0], opened[:, 0] = start, np.einsum("ij,ij->i", q, self.vectors[start]), False
        seen[np.arange(m), start] = True
        active = np.arange(m)
        while len(active):
            waiting = np.where(opened[active], -np.inf, sims[active])
            pick = np.argpartition(-waiting, width - 1, axis=1)[:, :width]
            useful = np.isfinite(np.take_along_axis(waiting, pick, axis=1))
            going = useful.any(axis=1)
            active, pick, useful = active[going], pick[going], useful[going]
            if not len(active):
                break
            nodes = ids[active[:, None], pick]
            opened[active[:, None], pick] = True
            near = np.where(useful[:, :, None], links[nodes], -1).reshape(len(active), -1).astype(np.int64)
            row, column = np.nonzero(near >= 0)
            key = np.unique(row * len(self.vectors) + near[row, column])
            row, node = key // len(self.vectors), key % len(self.vectors)
            fresh = ~seen[active[row], node]
            row, node = row[fresh], node[fresh]
            seen[active[row], node] = True
            found = np.einsum("ij,ij->i", q[active[row]], self.vectors[node])
            counts = np.bincount(row, minlength=len(active))
            place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            new_ids = np.full((len(active), max(1, int(counts.max(initial=0)))), -1, dtype=np.int64)
            new_sims = np.full(new_ids.shape, -np.inf)
            new_ids[row, place], new_sims[row, place] = node, found
            all_ids = np.concatenate([ids[active], new_ids], axis=1)
            all_sims = np.concatenate([sims[active], new_sims], axis=1)
            all_opened = np.concatenate([opened[active], ~np.isfinite(new_sims)], axis=1)
            best = np.argpartition(-all_sims, size - 1, axis=1)[:, :size]
            ids[active], sims[active] = np.take_along_axis(all_ids, best, axis=1), np.take_along_axis(all_sims, best, axis=1)
            opened[active] = np.take_along_axis(all_opened, best, axis=1)
        order = np.argsort(-sims, axis=1)
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def within(self, q: np.ndarray, threshold: float, beam: int, reach: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) with similarity ``threshold`` or more that a beam search and its surroundings find."""
        left, right = [], []
        for at in range(0, len(q), LARGEST_BATCH):
            part = q[at : at + LARGEST_BATCH]
            ids, sims = self._beam(part, self._enter(part, 0), min(beam, len(self.vectors)), 0)
            row, column = np.nonzero(sims >= threshold - reach)
            node, sim = ids[row, column], sims[row, column]
            seen = np.zeros((len(part), len(self.vectors)), dtype=bool)
            tried = np.nonzero(ids >= 0)
            seen[tried[0], ids[tried]] = True
            while len(row):
                hit = sim >= threshold
                left.append(at + row[hit])
                right.append(node[hit])
                key = []
                for low in range(0, len(row), 200_000):
                    near = self.links[0][node[low : low + 200_000]]
                    r, k = np.nonzero(near >= 0)
                    r, near = row[low : low + 200_000][r], near[r, k].astype(np.int64)
                    fresh = ~seen[r, near]
                    key.append(np.unique(r[fresh] * len(self.vectors) + near[fresh]))
                    seen[r[fresh], near[fresh]] = True
                key = np.concatenate(key)
                row, node = key // len(self.vectors), key % len(self.vectors)
                pieces = range(0, len(row), 200_000)
                sim = [np.einsum("ij,ij->i", part[row[k : k + 200_000]], self.vectors[node[k : k + 200_000]]) for k in pieces]
                sim = np.concatenate(sim) if sim else np.zeros(0)
                stay = sim >= threshold - reach
                row, node, sim = row[stay], node[stay], sim[stay]
        return np.concatenate(left) if left else np.zeros(0, dtype=int), np.concatenate(right) if right else np.zeros(0, dtype=int)

    def dump(self, **more: np.ndarray) -> bytes:
        out = io.BytesIO()
        np.savez(out, vectors=self.vectors, counts=np.array(self.counts), **{f"links{k}": x for k, x in enumerate(self.links)}, **more)
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> tuple[Graph, dict]:
        data = np.load(io.BytesIO(raw))
        counts = data["counts"].tolist()
        return cls(data["vectors"], counts, [data[f"links{k}"] for k in range(len(counts))]), data


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for very large or small components."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def audited_pairs(target: Graph, q: np.ndarray, threshold: float, beam: int = BEAM, reach: float = REACH) -> tuple[np.ndarray, np.ndarray]:
    """Links of queries in a graph; beam and reach grow until a sample of the queries misses almost none."""
    sample = np.unique(np.linspace(0, len(q) - 1, min(AUDITED, len(q))).astype(int))
    true = q[sample] @ target.vectors.T >= threshold
    while True:
        left, right = target.within(q, threshold, beam, reach)
        found = np.zeros_like(true)
        at = np.searchsorted(sample, left)
        mine = (at < len(sample)) & (sample[np.minimum(at, len(sample) - 1)] == left)
        found[at[mine], right[mine]] = True
        if (found & true).sum() >= RECALL * true.sum() or beam >= len(target.vectors):
            return left, right
        beam, reach = 2 * beam, reach + 0.03


def shard_graphs(classes: DataFrame) -> DataFrame:
    """``label, dim, shard, shards, graph`` from ``set_key, label, dim, vector, size``."""
    counts = cut_lineage(classes.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / SHARD_ROWS).cast("int").alias("shards")))
    dealt = classes.join(counts, ["label", "dim"]).withColumn("shard", F.pmod(F.xxhash64("set_key", F.lit("shard")), F.col("shards")).cast("int"))

    def build(rows):
        rows = rows.sort_by("set_key").combine_chunks()
        vectors = unit(rows.column("vector").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1))
        order = np.random.default_rng(11).permutation(rows.num_rows)
        keys = np.array(rows.column("set_key").to_pylist(), dtype="S32")[order]
        graph = Graph.build(vectors[order])
        raw = graph.dump(keys=keys, sizes=rows.column("size").to_numpy()[order])
        head = rows.slice(0, 1).select(["label", "dim", "shard", "shards"])
        return head.append_column("graph", pa.array([raw], pa.large_binary() if len(raw) > 1 << 30 else pa.binary()))

    kind = classes.schema["label"].dataType.simpleString()
    return dealt.groupBy("label", "dim", "shard").applyInArrow(build, f"label {kind}, dim int, shard int, shards int, graph binary")


def shard_links(graphs: DataFrame, threshold: float) -> DataFrame:
    """``set_key, root, linked`` of vectors with links, for each pair of shards of a label."""
    other = F.explode(F.sequence(F.lit(0), F.col("shards") - 1))
    paired = graphs.withColumn("other", other).select(
        "label", "dim", F.least("shard", "other").alias("a"), F.greatest("shard", "other").alias("b"), "shard", "graph"
    )

    def search(rows):
        rows = rows.sort_by("shard")
        loaded = [Graph.load(raw.as_py()) for raw in rows.column("graph")]
        first, last = loaded[0], loaded[-1]
        left, right = audited_pairs(last[0], first[0].vectors, threshold)
        if len(loaded) == 2:
            back_right, back_left = audited_pairs(first[0], last[0].vectors, threshold)
            left, right = np.concatenate([left, back_left]), np.concatenate([right, back_right])
            right = right + len(first[0].vectors)
        low, high = np.minimum(left, right), np.maximum(left, right)
        keys = np.concatenate([data["keys"] for _, data in loaded])
        sizes = np.concatenate([data["sizes"] for _, data in loaded])
        pairs = np.unique((low * len(keys) + high)[low != high])
        a, b = pairs // len(keys), pairs % len(keys)
        n = len(keys)
        linked = np.bincount(a, weights=sizes[b], minlength=n) + np.bincount(b, weights=sizes[a], minlength=n)
        root = _labels(n, a, b)
        used = np.flatnonzero(linked)
        columns = [pa.array(keys[used].astype(str), pa.string()), pa.array(keys[root[used]].astype(str), pa.string()), pa.array(linked[used].astype(np.int64))]
        return pa.table(columns, names=["set_key", "root", "linked"])

    return paired.groupBy("label", "dim", "a", "b").applyInArrow(search, "set_key string, root string, linked long")


def near_vectors(
    embeddings: DataFrame, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD
) -> DataFrame:
    """``id, n_links, component_id`` per row.

    Rows are linked where their labels are equal and the cosine of their vectors, in double precision, is
    ``threshold`` or more. ``n_links``: other rows linked directly, copies included; ``component_id``: the
    smallest id reachable over links, itself included. A null label, or a vector that is null, empty, zero or
    has a null or non-finite component, links with nothing; so do vectors of different lengths. Repeated rows
    count as rows. Other columns are not read.
    """
    values = F.col("vector")
    sound = F.col("label").isNotNull() & (F.size(values) > 0)
    sound = sound & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(values, lambda x: x != 0)
    rows = embeddings.select(F.col(id_column).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    key = F.md5(F.concat_ws("|", F.col("label").cast("string"), F.array_join("vector", ",")))
    rows = rows.withColumn("set_key", F.when(sound, key))
    classes = rows.filter("set_key is not null").groupBy("set_key").agg(
        F.min("id").alias("least"), F.count(F.lit(1)).alias("size"), F.first("label").alias("label"), F.first("vector").alias("vector")
    )
    classes = cut_lineage(classes.withColumn("dim", F.size("vector")))
    graphs = cut_lineage(shard_graphs(classes))
    links = cut_lineage(shard_links(graphs, threshold))
    edges = links.filter("set_key <> root").select(F.col("set_key").alias("a"), F.col("root").alias("b"))
    nodes = links.select(F.col("set_key").alias("id")).union(links.select("root")).distinct()
    labels = connected_labels(nodes, edges).withColumnRenamed("id", "set_key")
    named = labels.join(classes.select("set_key", "least"), "set_key")
    component = named.groupBy("label").agg(F.min("least").alias("component"))
    named = labels.join(component, "label").select("set_key", "component")
    linked = links.groupBy("set_key").agg(F.sum("linked").alias("linked"))
    found = classes.select("set_key", "least", "size").join(named, "set_key", "left").join(linked, "set_key", "left")
    found = found.select("set_key", F.coalesce("component", "least").alias("component"), (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("links"))
    out = rows.select("id", "set_key").join(cut_lineage(found), "set_key", "left")
    return out.select(
        F.col("id").alias(id_column), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )


OP6_SQL = f"""
WITH RECURSIVE sound AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= {THRESHOLD}),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m.y, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(m.y, vec_id)) AS kept
FROM embeddings e LEFT JOIN degree d ON d.x = e.vec_id LEFT JOIN least m ON m.x = e.vec_id
"""


@query("op6_embedding_near_dedup", OP6_SQL)
def op6(spark, folder):
    found = near_vectors(table(spark, folder, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))
