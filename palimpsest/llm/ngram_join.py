"""N-gram Jaccard join with Bayesian pruning of MinHash candidates.

Documents with the same set of word n-grams are one class. Classes that agree in all rows of a band of their
MinHash signature meet in a bucket; a pair is looked at only in the first band it shares. Its signatures are
compared a piece at a time, and it is dropped as soon as the posterior probability that the similarity reaches
the threshold, given the matches so far, falls below a tolerance; the pairs that stay are verified exactly on
their n-grams. Buckets are worked on in tiles of bounded size, in numpy, and pairs never become rows: a tile
sends each member's partners as a list, and the verified links leave as counts and a spanning star.

The large joins are told to merge: none of their sides has a bound, so their plan is the same at every size.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.common import Batches, column, free_name, map_texts, pieces_of
from palimpsest.llm.decontaminate import WORDS_SQL, words_of
from palimpsest.llm.registry import query, table
from palimpsest.operators.clusters import connected_labels
from palimpsest.session import cut_lineage

WORDS = 5
THRESHOLD = 0.8
#: With bands of four rows a pair at the threshold shares none with probability (1 - 0.8 ** 4) ** 24 < 4e-6.
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the posterior probability at which a pair is given up.
STEP = 16
TOLERANCE = 1e-7
#: Members of a bucket in one tile, and rows of a task's group of tiles.
TILE = 1024
GROUP_ROWS = 20_000
PAIRS_AT_ONCE = 50_000

_ODD = np.random.default_rng(17).integers(1, 1 << 62, size=(2, HASHES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Sets of hashed word n-grams."""

    def __init__(self, words: int = WORDS):
        self.words = words

    def __call__(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit hashes; a text of fewer words, but not none, is one n-gram."""
        words = words_of(text)
        if not words:
            return np.zeros(0, dtype=np.uint64)
        hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
        size = min(self.words, len(words))
        grams = np.full(len(words) - size + 1, size, dtype=np.uint64)
        for k in range(size):
            grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashed[k : k + len(grams)]
            grams ^= grams >> np.uint64(29)
        return np.unique(grams)


def signature(grams: np.ndarray) -> np.ndarray:
    """MinHash values (32 bits) of a set."""
    lowest = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(grams), 512):
        mixed = grams[at : at + 512, None] * _ODD[0] + _ODD[1]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(lowest, mixed.min(axis=0), out=lowest)
    return (lowest >> np.uint64(32)).astype(np.uint32)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For each number of compared values (multiples of STEP) the matches below which a pair is given up.

    With a flat prior the similarity's posterior after m matches of n is Beta(m + 1, n - m + 1); its mass above
    the threshold is the chance that n + 1 trials at the threshold succeed m times at most.
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        chance = 0.0
        for m in range(n + 1):
            chance += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if chance >= tolerance:
                break
        out.append(m)
    return out


def class_rows(documents: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """``id, place, set_key, bands, sig`` per row; texts without words have a null ``set_key``."""

    def make(batches: Batches) -> Batches:
        shingle = Shingler(words)
        for batch in batches:
            keys, bands, sigs = [], [], []
            for value in batch.column("text").to_pylist():
                grams = shingle(value)
                if not len(grams):
                    keys.append(None)
                    bands.append(None)
                    sigs.append(None)
                    continue
                keys.append(xxhash.xxh3_128_digest(grams.tobytes()))
                values = signature(grams)
                bands.append([xxhash.xxh3_64_intdigest(values[at : at + ROWS].tobytes(), at) - (1 << 63) for at in range(0, HASHES, ROWS)])
                sigs.append(values.astype("<u2").tobytes())
            columns = [batch.column("id"), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "set_key", "bands", "sig"])

    keyed = documents.select(
        F.struct(F.col(id_column).alias("id"), F.xxhash64(F.col(id_column), F.col(text)).alias("place")).alias("who"), F.col(text).alias("text")
    )
    made = map_texts(keyed, "who", "text", make, "set_key binary, bands array<long>, sig binary")
    return made.select("who.id", "who.place", "set_key", "bands", "sig")


def tile_rows(classes: DataFrame) -> DataFrame:
    """Members of buckets with two classes or more, dealt into tiles: ``tile, part, side, band, set_key, bands, sig``.

    A bucket of n members has k = n / TILE parts by hash; each pair of parts is a tile, so a member comes k
    times. ``side`` tells the two parts of a mixed tile apart (0, 1; both 2 in a tile of one part).
    """
    spread = classes.select("set_key", F.posexplode("bands").alias("band", "bucket"))
    many = cut_lineage(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    met = spread.join(many.hint("merge"), "bucket").withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    met = met.withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.select("set_key", "band", "bucket", "part", other.alias("other"))
    side = F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)
    tile = F.xxhash64("bucket", F.least("part", "other"), F.greatest("part", "other"))
    return met.select("set_key", "band", side.cast("int").alias("side"), tile.alias("tile")).join(
        classes.select("set_key", "bands", "sig").hint("merge"), "set_key"
    )


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, dtype=int)
    return starts, np.diff(np.append(starts, len(sorted_values)))


def _tile_pairs(start: int, sides: np.ndarray):
    """Index pairs of a tile in bounded pieces: all of one part, or those between two parts."""
    n = len(sides)
    if sides[0] == 2:
        left, right = np.arange(n), np.arange(n)
    else:
        left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    step = max(1, PAIRS_AT_ONCE // max(1, len(right)))
    for at in range(0, len(left), step):
        a, b = np.meshgrid(left[at : at + step], right, indexing="ij")
        a, b = a.ravel(), b.ravel()
        if sides[0] == 2:
            a, b = a[a < b], b[a < b]
        yield start + a, start + b


def _pair_pieces(starts: np.ndarray, sizes: np.ndarray, sides: np.ndarray):
    """Index pairs of many tiles: those of two members together, larger tiles one by one."""
    two = starts[sizes == 2]
    fit = two[(sides[two] == 2) | (sides[two] != sides[two + 1])]
    for at in range(0, len(fit), PAIRS_AT_ONCE):
        yield fit[at : at + PAIRS_AT_ONCE], fit[at : at + PAIRS_AT_ONCE] + 1
    for start, size in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        yield from _tile_pairs(start, sides[start : start + size])


def prune_pairs(bands: np.ndarray, sigs: np.ndarray, band: np.ndarray, a: np.ndarray, b: np.ndarray, least: list[int]):
    """Pairs whose first common band is the tile's and that the posterior does not give up."""
    owned = (bands[a] == bands[b]).argmax(axis=1) == band[a]
    a, b = a[owned], b[owned]
    matches = np.zeros(len(a), dtype=np.int64)
    for k, bar in enumerate(least):
        piece = slice(k * STEP, (k + 1) * STEP)
        matches += (sigs[a, piece] == sigs[b, piece]).sum(axis=1)
        stay = matches >= bar
        a, b, matches = a[stay], b[stay], matches[stay]
    return a, b


def candidate_partners(tiles: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``tile, set_key, partners`` for members with pairs left: partners as positions among the tile's rows by key."""
    least = least_matches(threshold, tolerance)
    groups = pieces_of(tiles.count(), GROUP_ROWS)
    grouped = tiles.withColumn("group", F.pmod(F.col("tile"), F.lit(groups)))

    def prune(members):
        members = members.sort_by([("tile", "ascending"), ("set_key", "ascending")]).combine_chunks()
        tile, band, side = (members.column(c).to_numpy() for c in ("tile", "band", "side"))
        bands = members.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        sigs = np.frombuffer(b"".join(members.column("sig").to_pylist()), dtype="<u2").reshape(-1, HASHES)
        starts, sizes = _runs(tile)
        first = np.repeat(starts, sizes)
        lefts, rights = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for a, b in _pair_pieces(starts, sizes, side):
            a, b = prune_pairs(bands, sigs, band, a, b, least)
            lefts.append(a)
            rights.append(b)
        a, b = np.concatenate(lefts), np.concatenate(rights)
        order = np.argsort(a, kind="stable")
        a, b = a[order], b[order]
        used = np.unique(np.concatenate([a, b]))
        counts = np.bincount(a, minlength=len(tile))[used]
        offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
        partners = pa.ListArray.from_arrays(pa.array(offsets), pa.array((b - first[b]).astype(np.int32)))
        return pa.table(
            {
                "tile": pa.array(tile[used]),
                "set_key": members.column("set_key").combine_chunks().take(pa.array(used)),
                "place": pa.array((used - first[used]).astype(np.int32)),
                "partners": partners,
            }
        )

    return grouped.groupBy("group").applyInArrow(prune, "tile long, set_key binary, place int, partners array<int>")


def _overlaps(grams: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact sizes of the intersections of many pairs of sets, on bit rows of the n-grams that two sets share."""
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts[where] > 1
    owner, where = owner[shared], column[where[shared]]
    width = int((counts > 1).sum())
    total = np.zeros(len(a), dtype=np.int64)
    for low in range(0, width, 1 << 14):
        span = min(1 << 14, width - low)
        bits = np.zeros((len(grams), -(-span // 64)), dtype=np.uint64)
        inside = (where >= low) & (where < low + span)
        np.bitwise_or.at(bits, (owner[inside], (where[inside] - low) // 64), np.uint64(1) << ((where[inside] - low) % 64).astype(np.uint64))
        step = max(1, 500_000 // bits.shape[1])
        for at in range(0, len(a), step):
            total[at : at + step] += np.bitwise_count(bits[a[at : at + step]] & bits[b[at : at + step]]).sum(axis=1, dtype=np.int64)
    return total


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position reachable from each of n over the given pairs."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            return label


def verified_links(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """``set_key, root, linked, others``: members with verified links, by tile.

    ``root`` is the smallest member linked with it inside the tile, ``linked`` the documents of the classes it
    links with there and ``others`` the number of those classes. ``sets``: ``set_key, grams, size``.
    """
    groups = pieces_of(candidates.count(), 4_000)
    joined = candidates.join(sets.hint("merge"), "set_key").withColumn("group", F.pmod(F.col("tile"), F.lit(groups)))

    def verify(members):
        members = members.sort_by([("tile", "ascending"), ("place", "ascending")]).combine_chunks()
        tile, place, size = (members.column(c).to_numpy() for c in ("tile", "place", "size"))
        keys = members.column("set_key").to_pylist()
        parts = []
        starts, sizes = _runs(tile)
        for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
            at = place[start : start + n]
            lists = members.column("partners").slice(start, n).combine_chunks()
            a = np.repeat(np.arange(n), pa.compute.list_value_length(lists).to_numpy())
            b = np.searchsorted(at, lists.flatten().to_numpy())
            grams = [np.frombuffer(g, dtype="<u8") for g in members.column("grams").slice(start, n).to_pylist()]
            lengths = np.array([len(g) for g in grams])
            both = _overlaps(grams, a, b)
            near = both >= threshold * (lengths[a] + lengths[b] - both) - 1e-9
            a, b = a[near], b[near]
            own = size[start : start + n]
            linked = np.bincount(a, weights=own[b], minlength=n) + np.bincount(b, weights=own[a], minlength=n)
            others = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
            root = _labels(n, a, b)
            for k in np.flatnonzero(others).tolist():
                parts.append((keys[start + k], keys[start + root[k]], int(linked[k]), int(others[k])))
        columns = list(zip(*parts, strict=True)) if parts else [[], [], [], []]
        kinds = (pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["set_key", "root", "linked", "others"])

    return joined.groupBy("group").applyInArrow(verify, "set_key binary, root binary, linked long, others long")


def near_duplicates(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    threshold: float = THRESHOLD,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """``id, place, class_id, n_links, set_id`` per document row.

    Two rows are linked where the Jaccard similarity of their word n-gram sets is ``threshold`` or more.
    ``n_links``: other rows linked directly with this one, copies included; ``class_id``: the smallest id
    reachable over links, itself included; ``set_id``: the smallest id with the same set. A text of fewer
    than ``words`` words is one n-gram; one without words, or null, links with nothing and is its own class.
    Null ids do not name a class unless all ids of it are null. ``place`` is a hash of the row's id and text.
    Repeated rows count as rows. Other columns are not read.
    """
    rows = cut_lineage(class_rows(documents, id_column, text, words))
    classes = (
        rows.filter("set_key is not null")
        .groupBy("set_key")
        .agg(
            F.min("id").alias("set_id"),
            F.min("place").alias("place"),
            F.count(F.lit(1)).alias("size"),
            F.first("bands").alias("bands"),
            F.first("sig").alias("sig"),
        )
    )
    classes = cut_lineage(classes)
    candidates = cut_lineage(candidate_partners(cut_lineage(tile_rows(classes)), threshold, tolerance))
    involved = candidates.select("set_key").distinct().join(classes.select("set_key", "place", "size"), "set_key")
    links = cut_lineage(verified_links(candidates, _sets(documents, id_column, text, words, cut_lineage(involved)), threshold))
    edges = links.filter("set_key <> root").select(F.col("set_key").alias("a"), F.col("root").alias("b"))
    nodes = links.select(F.col("set_key").alias("id")).union(links.select("root")).distinct()
    labels = connected_labels(nodes, edges).withColumnRenamed("id", "set_key")
    linked = links.groupBy("set_key").agg(F.sum("linked").alias("linked"))
    named = labels.join(classes.select("set_key", "set_id"), "set_key")
    least = named.groupBy("label").agg(F.min("set_id").alias("class_id"))
    named = labels.join(least, "label").select("set_key", "class_id").join(linked, "set_key", "left")
    found = classes.select("set_key", "set_id", "size").join(named, "set_key", "left")
    found = cut_lineage(found.withColumn("class_id", F.coalesce("class_id", "set_id")).withColumn("links", F.coalesce("linked", F.lit(0)) + F.col("size") - 1))
    out = rows.select("id", "place", "set_key").join(found.select("set_key", "set_id", "class_id", "links"), "set_key", "left")
    return out.select(
        F.col("id").alias(id_column),
        "place",
        F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.when(F.col("set_key").isNull(), F.col("id")).otherwise(F.col("set_id")).alias("set_id"),
    )


def _sets(documents: DataFrame, id_column: str, text: str, words: int, involved: DataFrame) -> DataFrame:
    """``set_key, size, grams``: the n-grams of the classes in question, made again from one text each."""

    def make(batches: Batches) -> Batches:
        shingle = Shingler(words)
        for batch in batches:
            grams = [shingle(value).tobytes() for value in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(grams, pa.binary())], names=["id", "grams"])

    texts = documents.select(F.xxhash64(F.col(id_column), F.col(text)).alias("place"), F.col(text).alias("text"))
    texts = texts.join(involved.hint("merge"), "place").withColumn("who", F.struct("set_key", "size"))
    made = map_texts(texts, "who", "text", make, "grams binary")
    return made.select("who.set_key", "who.size", "grams").dropDuplicates(["set_key"])


def keep_one(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``documents`` that are the smallest id of their class, as they are.

    Rows that repeat both the id and the text of a kept document stay. Rows without an id stay if no row with
    one is in their class.
    """
    found = near_duplicates(documents, id_column, text)
    mark = free_name(documents, "place")
    extra = cut_lineage(found.filter(~F.col(id_column).eqNullSafe(F.col("class_id"))).select(F.col("place").alias(mark)).distinct())
    marked = documents.withColumn(mark, F.xxhash64(column(id_column), column(text)))
    return marked.join(extra, mark, "left_anti").select(*[column(c) for c in documents.columns])


OP5_SQL = f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
grams AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - least({WORDS}, len(w)) + 2),
                                                lambda i: array_to_string(w[i : i + least({WORDS}, len(w)) - 1], ' '))) AS g
  FROM docs WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
near AS (
  SELECT x, y, c = s.n AND c = t.n AS same FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y
  WHERE 5 * c >= 4 * (s.n + t.n - c)),
links AS (SELECT x, y, same FROM near UNION ALL SELECT y, x, same FROM near),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
least_of AS (SELECT x, min(y) AS y FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n, min(y) FILTER (WHERE same) AS twin FROM links GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(m.y, doc_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links,
       least(doc_id, coalesce(twin, doc_id)) AS set_id, doc_id = least(doc_id, coalesce(m.y, doc_id)) AS kept
FROM docs LEFT JOIN degree d ON d.x = doc_id LEFT JOIN least_of m ON m.x = doc_id
"""


@query("op5_ngram_jaccard_join", OP5_SQL)
def op5(spark, folder):
    found = near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links", "set_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
