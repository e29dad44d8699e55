"""Helpers the operators of this package share."""

from __future__ import annotations

import contextlib
import ctypes
import math
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

Batches = Iterator[pa.RecordBatch]

WORKER_CACHE = "palimpsest_worker_cache"


def kept_in_worker(name, make: Callable):
    """``make()`` once per Python worker; tasks that follow in the same worker find it again.

    A worker holds the last one only, so queries one after the other do not add up.
    """
    holder = sys.modules.setdefault(WORKER_CACHE, types.ModuleType(WORKER_CACHE)).__dict__
    if holder.get("held") != name:
        forget_kept()  # what tasks of other operators freed goes back to the system before more is asked for
        holder["value"] = make()
        holder["held"] = name
    return holder["value"]


def forget_kept() -> None:
    """Let go of what another operator keeps in this worker, and give freed memory back to the system.

    Workers wait for further tasks, of any operator, with what they hold; so this comes before and after a task.
    """
    holder = sys.modules.get(WORKER_CACHE)
    if holder is not None and holder.__dict__.pop("held", None) is not None:
        holder.__dict__["value"] = None
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def column(name: str) -> Column:
    """The column of that very name, whatever signs it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Slots(dict):
    """A number for each string asked for; ``fresh`` lists those that are new, in the order of their numbers."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        self.fresh.append(key)
        return number

    def taken(self) -> list[str]:
        """The new strings, which are then no longer new."""
        fresh, self.fresh = self.fresh, []
        return fresh


class Runs:
    """Runs of integers by number, in one array that grows."""

    def __init__(self):
        self.flat = np.zeros(1024, dtype=np.int32)
        self.starts, self.sizes = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.used = self.count = 0

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        """Further runs, end to end."""
        self.flat = grown(self.flat, self.used + len(flat))
        self.flat[self.used : self.used + len(flat)] = flat
        last = self.count + len(sizes)
        self.starts, self.sizes = grown(self.starts, last), grown(self.sizes, last)
        self.sizes[self.count : last] = sizes
        self.starts[self.count : last] = self.used + np.cumsum(sizes) - sizes
        self.used, self.count = self.used + len(flat), last

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The runs asked for, end to end, and their sizes."""
        sizes = self.sizes[numbers]
        before = np.cumsum(sizes) - sizes
        return self.flat[np.repeat(self.starts[numbers] - before, sizes) + np.arange(sizes.sum())], sizes


def run_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: int) -> np.ndarray:
    """A 64-bit polynomial hash of each run of an array of unsigned numbers, from one running sum over all of them.

    Equal runs have equal hashes in any array. ``factor`` is odd.
    """
    powers = np.full(len(data) + 1, factor, dtype=np.uint64)
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[1:], out=sums[1:])
    # moved to a common place by the powers of the run's distance to the end, and from there to the beginning
    powers *= np.uint64(pow(factor, -len(data), 1 << 64))
    return (sums[ends] - sums[starts]) * powers[len(data) - starts]


def different_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of each kind of equal runs, by number, and the kind of each run; by two 64-bit hashes.

    Where two runs share one hash and not the other, each counts as a kind of its own.
    """
    keys = run_keys(data, starts, ends, 0x9E3779B97F4A7C15)
    _, one, which = np.unique(keys, return_index=True, return_inverse=True)
    other = run_keys(data, starts, ends, 0xD6E8FEB86659FD93) + (ends - starts).astype(np.uint64)
    if not (other == other[one][which]).all():
        one = which = np.arange(len(starts))
    return one, which


class RunTable:
    """A number for each short run of numbers seen, by two 64-bit hashes; a table of fixed size, where new runs replace old ones."""

    #: Longer runs are never kept.
    LONGEST = 60

    def __init__(self, bits: int, kind=np.int32):
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits, 2), dtype=np.uint64)
        self.values = np.zeros(1 << bits, dtype=kind)
        self.filled = np.zeros(1 << bits, dtype=bool)

    def clear(self) -> None:
        self.filled[:] = False

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Where runs of these first hashes lie."""
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def looked_up(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
        """Values of runs, those without one, one of each kind of equal runs among these, the kind of each, and the kinds' hashes.

        Values count only where one was found. Runs longer than ``LONGEST`` are kinds of their own, as hashes tell
        short runs apart only.
        """
        keys = np.stack([run_keys(data, starts, ends, 0x9E3779B97F4A7C15), run_keys(data, starts, ends, 0xD6E8FEB86659FD93)], axis=1)
        slots = self.slots(keys[:, 0])
        short = ends - starts <= self.LONGEST
        found = short & self.filled[slots] & (self.keys[slots] == keys).all(axis=1)
        new = np.flatnonzero(~found)
        kinds = new[short[new]]
        _, one, which = np.unique(keys[kinds, 0], return_index=True, return_inverse=True)
        if not (keys[kinds[one][which], 1] == keys[kinds, 1]).all():
            one = which = np.arange(len(kinds))
        long = new[~short[new]]
        kind = np.zeros(len(new), dtype=np.int64)
        kind[short[new]] = which
        kind[~short[new]] = len(one) + np.arange(len(long))
        one = np.concatenate([kinds[one], long])
        return self.values[slots], new, one, kind, keys[one]

    def put(self, keys: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> None:
        """Values of new kinds of runs, by their hashes and sizes."""
        short = np.flatnonzero(sizes <= self.LONGEST)
        slots, last = np.unique(self.slots(keys[short, 0])[::-1], return_index=True)
        chosen = short[len(short) - 1 - last]
        self.keys[slots], self.values[slots], self.filled[slots] = keys[chosen], values[chosen], True


def grown(values: np.ndarray, least: int) -> np.ndarray:
    """The array, or a longer one that begins with it."""
    if least <= len(values):
        return values
    out = np.zeros((max(least, 2 * len(values)), *values.shape[1:]), dtype=values.dtype)
    out[: len(values)] = values
    return out


def bounded_slices(batch: pa.RecordBatch, column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in runs whose texts have about ``limit`` bytes at most; a longer text stands alone."""
    lengths = pa.compute.binary_length(batch.column(column)).to_pylist()
    at = size = 0
    for i, n in enumerate(lengths):
        if i > at and size + (n or 0) > limit:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n or 0
    if at < len(lengths):
        yield batch.slice(at)


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends rows to Python in batches of about 4 MB, unless it was told a size."""
    conf, default = df.sparkSession.conf, "67108864b"
    if conf.get(BATCH_BYTES, default) == default:
        conf.set(BATCH_BYTES, "4m")
    return df


def map_texts(
    df: DataFrame, id_column: str, text: str, kernel: Callable[[Batches], Batches], added: str, keeps: bool = False, limit: int = 4_000_000
) -> DataFrame:
    """Row by row in Arrow batches: ``kernel`` sees columns ``id`` and ``text`` in small batches.

    It returns ``id`` and the columns of the DDL string ``added``. Other columns of ``df`` are not read. A kernel that
    ``keeps`` something for later tasks of its worker finds it; others first let go of it.
    """
    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *T.StructType.fromDDL(added).fields])

    def run(batches: Batches) -> Batches:
        if not keeps:
            forget_kept()
        yield from kernel(part for batch in batches for part in bounded_slices(batch, "text", limit))
        if not keeps:
            forget_kept()

    return small_batches(rows).mapInArrow(run, schema).withColumnRenamed("id", id_column)


def filter_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list], np.ndarray]]) -> DataFrame:
    """The rows of ``df`` whose text the judge of ``make()`` keeps, as they are, in one pass with one copy of each text.

    The judge gets the texts of a small batch, nulls included, and returns which to keep.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*[column(c).alias(n) for c, n in zip(df.columns, names, strict=True)], column(text).cast("string").alias("text"))
    if df.schema[text].dataType == T.StringType():
        rows = rows.drop("text").withColumnRenamed(names[df.columns.index(text)], "text")
    schema = T.StructType([rows.schema[n if n in rows.columns else "text"] for n in names])

    def run(batches: Batches) -> Batches:
        forget_kept()
        judge = make()
        for batch in batches:
            for part in bounded_slices(batch, "text"):
                kept = part.filter(pa.array(judge(part.column("text").to_pylist()), pa.bool_()))
                yield pa.RecordBatch.from_arrays([kept.column(f.name) for f in schema.fields], names=schema.names)
        batch = part = kept = judge = None
        forget_kept()

    return small_batches(rows).mapInArrow(run, schema).toDF(*df.columns)


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts."""
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def pieces_of(size: int, each: int, least: int = 1) -> int:
    """How many pieces of about ``each`` bytes a table of ``size`` bytes takes."""
    return max(least, math.ceil(size / each))


def list_array(values, offsets, kind: pa.DataType) -> pa.ListArray:
    """A list column from its flat values and the offsets of its rows."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
