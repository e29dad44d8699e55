"""Global order without a global sort in one task.

Rows fall into buckets that follow the wanted order: the partitions of one range exchange, written once so
that totals and offsets belong to the same rows, or leading digits of a uniform key. The bucket totals (a
table no longer than the number of buckets) give each bucket its offset, and the rest of the work stays
inside the buckets. Every size of input takes the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from palimpsest.functions.text import seeded_key
from palimpsest.session import cut_lineage

HASH_BUCKET_DIGITS = 4


def hash_bucket(key: Column) -> Column:
    """Bucket of a uniform hexadecimal key: its leading digits (at most 65,536 buckets)."""
    return F.conv(F.substring(key, 1, HASH_BUCKET_DIGITS), 16, 10).cast("int")


def in_range_buckets(df: DataFrame, order: list[str], buckets: int | None = None) -> DataFrame:
    """The rows with ``_bucket``, a number that follows ``order`` (columns of any type that sorts, nulls first).

    One range exchange, with as many partitions as the session's shuffles unless ``buckets`` says otherwise.
    Rows that are equal in all of ``order`` share a bucket, so a hot value needs a further column to spread.
    """
    ranged = df.repartitionByRange(buckets, *order) if buckets else df.repartitionByRange(*order)
    return cut_lineage(ranged.withColumn("_bucket", F.spark_partition_id()))


def with_running_totals(
    df: DataFrame, bucket: Column, order: list[Column], totals: dict[str, Column], position: str | None = None, row_count: str | None = None
) -> DataFrame:
    """Add the 0-based position, the table's row count and the running (inclusive) sum of each total."""
    keyed = df.withColumn("_bucket", bucket)
    per_bucket = keyed.groupBy("_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{name}") for name, c in totals.items()]
    )
    # one row per bucket: this window is bounded by the number of buckets
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = ["_n"] + [f"_t_{name}" for name in totals]
    offsets = per_bucket.select(
        "_bucket", F.sum("_n").over(Window.partitionBy()).alias("_all"), *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_o{s}") for s in sums]
    )
    inside = Window.partitionBy("_bucket").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = keyed.join(F.broadcast(offsets), "_bucket")
    columns = [F.col(c) for c in df.columns]
    if position:
        columns.append((F.row_number().over(inside) - 1 + F.col("_o_n")).cast("long").alias(position))
    if row_count:
        columns.append(F.col("_all").alias(row_count))
    for name, value in totals.items():
        columns.append((F.sum(value).over(upto) + F.col(f"_o_t_{name}")).alias(name))
    return placed.select(*columns)


def with_position(
    df: DataFrame, order_by: str, position: str = "position", ties: list[str] = (), buckets: int | None = None
) -> DataFrame:
    """Dense 0-based position of every row by a column (``ties`` break equal values and spread them)."""
    order = [order_by, *ties]
    rows = in_range_buckets(df, order, buckets)
    return with_running_totals(rows, F.col("_bucket"), [F.col(c) for c in order], {}, position).drop("_bucket")


def with_shuffled_position(df: DataFrame, seed: int | str, id_columns: list[str], position: str = "position", row_count: str | None = None) -> DataFrame:
    """Dense 0-based position of every row in the seeded shuffle."""
    keyed = df.withColumn("_key", seeded_key(seed, *id_columns))
    order = [F.col("_key"), *[F.col(c) for c in id_columns]]
    return with_running_totals(keyed, hash_bucket(F.col("_key")), order, {}, position, row_count).drop("_key")


def with_running_mean(
    df: DataFrame, value: str, order_by: str, name: str = "running_mean", buckets: int | None = None, ties: list[str] = ()
) -> DataFrame:
    """Mean of the non-null ``value`` over all rows up to and including each row in ``order_by`` order.

    Null while no value has come; ``ties`` break equal values of ``order_by``.
    """
    number = F.col(value).cast("double")
    totals = {"_sum": F.coalesce(number, F.lit(0.0)), "_count": number.isNotNull().cast("long")}
    order = [order_by, *ties]
    rows = in_range_buckets(df, order, buckets)
    placed = with_running_totals(rows, F.col("_bucket"), [F.col(c) for c in order], totals)
    return placed.withColumn(name, F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).drop("_sum", "_count", "_bucket")


def first_by_shuffle(df: DataFrame, n: int, seed: int | str, id_columns: list[str]) -> DataFrame:
    """The first ``n`` rows of the seeded shuffle."""
    placed = with_shuffled_position(df, seed, id_columns, "_position")
    return placed.filter(F.col("_position") < n).drop("_position")


def slice_by_order(df: DataFrame, order_by: str, start: int, stop: int, ties: list[str] = ()) -> DataFrame:
    """Rows at positions ``start`` (inclusive) to ``stop`` (exclusive) in ``order_by`` order."""
    placed = with_position(df, order_by, "_position", ties)
    return placed.filter((F.col("_position") >= start) & (F.col("_position") < stop)).drop("_position")


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k: int, id_columns: list[str], salts: int = 256) -> DataFrame:
    """First ``k`` rows of each group, in two rounds.

    The first round ranks inside (group, salt), so a group holding most rows is spread over
    ``salts`` tasks; the second sees at most ``k × salts`` rows of any group.
    """
    salt = F.pmod(F.xxhash64(*id_columns), F.lit(salts))
    first = Window.partitionBy(*groups, "_salt").orderBy(*order)
    second = Window.partitionBy(*groups).orderBy(*order)
    return (
        df.withColumn("_salt", salt)
        .withColumn("_rank", F.row_number().over(first))
        .filter(F.col("_rank") <= k)
        .withColumn("_rank", F.row_number().over(second))
        .filter(F.col("_rank") <= k)
        .drop("_salt", "_rank")
    )


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
