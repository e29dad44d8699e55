"""Quality by an interpolated modified Kneser-Ney model over bytes.

An n-gram is ``ORDER`` bytes in one long, the newest byte lowest, so a shift gives its history and a mask
its shorter form. Counts come from the trusted texts, all of them but a tenth; nothing is kept on one
machine: count tables of each order are sharded by n-gram and joined by n-gram, history and shorter form.

Texts are dealt into blocks, packed and compressed. Each block sends the distinct n-grams of its texts, far
fewer than its bytes, with how often trusted texts have them; it gets back their log probabilities, and each
text its perplexity. The trusted tenth that taught nothing sets a threshold for each language.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T

from palimpsest.llm.common import column, forget_kept, Batches, bounded_slices, pieces_of, text_bytes
from palimpsest.llm.registry import query, table
from palimpsest.session import cut_lineage

ORDER = 5
BLOCK_BYTES = 32 * 1024 * 1024
#: Bytes worked on at a time inside a block.
STEP_BYTES = 1_000_000
#: One trusted text in so many sets thresholds and teaches nothing.
HELD = 10
#: A text is good up to the median log perplexity of held trusted texts plus ``REACH`` times the way from it to this quantile.
QUANTILE = 0.95
REACH = 4.0
#: A text is judged as if so many bytes of median perplexity stood beside its own: few bytes are little evidence.
PRIOR_BYTES = 40
#: A language's median and quantile are taken as if so many held texts like those of all languages stood beside its own.
PRIOR_HELD = 20


def grams_of(texts: list[str | None], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of texts end to end, and how many each text has.

    A text is preceded by order - 1 zero bytes and ended by one, so even an empty one has an n-gram.
    """
    pad = b"\0" * (order - 1)
    raw = [(t or "").encode() for t in texts]
    flat = np.frombuffer(b"".join(pad + r + b"\0" for r in raw) + pad, dtype=np.uint8)
    sizes = np.array([len(r) + 1 for r in raw], dtype=np.int64)
    keys = np.zeros(len(flat) - order + 1, dtype=np.int64)
    for k in range(order):
        keys = keys << 8 | flat[k : len(flat) - order + 1 + k]
    starts = np.cumsum(sizes + order - 1) - (sizes + order - 1)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    return keys[at], sizes


def _pack(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return zstandard.ZstdCompressor(level=6).compress(sink.getvalue())


def _unpack(packed: pa.ChunkedArray) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Small batches of the packed rows, and their texts."""
    for value in packed:
        table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(value.as_py())).read_all()
        for batch in table.to_batches():
            for piece in bounded_slices(batch, "text", STEP_BYTES):
                yield piece, piece.column("text").to_pylist()


def packed_blocks(rows: DataFrame, block: Column) -> DataFrame:
    """``block, packed``: the rows of a DataFrame in compressed Arrow pieces by block number; has a column ``text``."""
    numbered = rows.withColumn("_block", block.cast("int"))

    def pack(batches: Batches) -> Batches:
        for batch in batches:
            numbers = batch.column("_block").to_numpy()
            order = np.argsort(numbers, kind="stable")
            cuts = np.flatnonzero(np.diff(numbers[order])) + 1
            bare = batch.drop_columns(["_block"])
            for part in np.split(order, cuts):
                if len(part):
                    for piece in bounded_slices(bare.take(pa.array(part)), "text", 4 * STEP_BYTES):
                        yield pa.RecordBatch.from_pydict(
                            {"block": pa.array([int(numbers[part[0]])], pa.int32()), "packed": pa.array([_pack(piece)], pa.binary())}
                        )

    return numbered.mapInArrow(pack, "block int, packed binary")


def block_counts(blocks: DataFrame, teaching: DataFrame, order: int = ORDER) -> DataFrame:
    """``block, gram, n``: distinct n-grams of each block's texts and their count in texts whose id is in ``teaching``.

    ``teaching`` has ``block, id``; ids lie in the block of their texts.
    """

    def count(packed, ids):
        grams, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        known = ids.column("id").combine_chunks()
        for batch, texts in _unpack(packed.column("packed")):
            keys, sizes = grams_of(texts, order)
            teaches = pa.compute.is_in(batch.column("id"), value_set=known).to_numpy(zero_copy_only=False)
            new, where = np.unique(keys, return_inverse=True)
            merged, at = np.unique(np.concatenate([grams, new]), return_inverse=True)
            total = np.zeros(len(merged), dtype=np.int64)
            total[at[: len(grams)]] += counts
            total[at[len(grams) :]] += np.bincount(where, weights=np.repeat(teaches, sizes)).astype(np.int64)
            grams, counts = merged, total
        block = packed.column("block")[0].as_py() if packed.num_rows else 0
        return pa.table({"block": np.full(len(grams), block, dtype=np.int32), "gram": grams, "n": counts})

    grouped = blocks.groupBy("block").cogroup(teaching.groupBy("block"))
    return grouped.applyInArrow(count, "block int, gram long, n long")


def _mask(order: int) -> int:
    return (1 << 8 * order) - 1


def _discounts(counts: DataFrame) -> Column:
    """Discount of a count ``n`` by the modified Kneser-Ney formula from the counts of counts 1 to 4."""
    kinds = [F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"c{k}") for k in (1, 2, 3, 4)]
    c1, c2, c3, c4 = (x or 0 for x in counts.agg(*kinds).first())
    y = c1 / (c1 + 2 * c2) if c1 + 2 * c2 else 0.5
    steps = [k - (k + 1) * y * after / now if now and after else 0.5 * k for k, now, after in ((1, c1, c2), (2, c2, c3), (3, c3, c4))]
    d1, d2, d3 = (float(min(max(d, 0.1), k)) for k, d in zip((1, 2, 3), steps, strict=True))
    return F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).when(F.col("n") > 2, d3).otherwise(0.0)


def log_probabilities(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``gram, logp`` for the distinct n-grams ``asked``, from the trained ``counts`` (``gram, n``, n > 0).

    The highest order counts occurrences, a lower one the different bytes in front of an n-gram. A history
    that was never seen passes on the shorter one; below all is one 256th. Without counts all are that.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        shorter = levels[k + 1].select(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram"))
        levels[k] = cut_lineage(shorter.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    known = None
    for k in range(1, order + 1):
        discount = _discounts(levels[k])
        own = levels[k].select("gram", F.col("n").cast("double").alias("n"), discount.alias("d"))
        history = own.groupBy(F.shiftright("gram", 8).alias("history")).agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
        wanted = asked if k == order else asked.select(F.col("gram").bitwiseAND(F.lit(_mask(k))).alias("gram")).distinct()
        wanted = wanted.withColumn("history", F.shiftright("gram", 8)).withColumn("shorter", F.col("gram").bitwiseAND(F.lit(_mask(k - 1))))
        wanted = wanted.join(own, "gram", "left").join(history, "history", "left")
        if known is None:
            wanted = wanted.withColumn("lower", F.lit(1 / 256))
        else:
            wanted = wanted.join(known.select(F.col("gram").alias("shorter"), F.col("p").alias("lower")), "shorter")
        direct = F.coalesce((F.col("n") - F.col("d")) / F.col("total"), F.lit(0.0))
        p = F.when(F.col("total").isNull(), F.col("lower")).otherwise(direct + F.col("left") / F.col("total") * F.col("lower"))
        known = cut_lineage(wanted.select("gram", p.alias("p")))
    return known.select("gram", F.log("p").alias("logp"))


def score_blocks(blocks: DataFrame, answers: DataFrame, schema: T.StructType, order: int = ORDER) -> DataFrame:
    """The packed rows of ``schema`` with ``log_perplexity`` and ``n_grams``, from ``answers`` (``block, gram, logp``)."""
    kept = schema.fields
    out = T.StructType([*kept, *T.StructType.fromDDL("log_perplexity double, n_grams long").fields])
    names = [f.name for f in kept]

    def score(packed, answered):
        forget_kept()
        grams = answered.column("gram").to_numpy()
        place = np.argsort(grams)
        grams, logp = grams[place], answered.column("logp").to_numpy()[place]
        parts = []
        for batch, texts in _unpack(packed.column("packed")):
            keys, sizes = grams_of(texts, order)
            values = logp[np.searchsorted(grams, keys)]
            mean = np.add.reduceat(values, np.cumsum(sizes) - sizes) / sizes
            scored = batch.select(names).append_column("log_perplexity", pa.array(-mean))
            parts.append(scored.append_column("n_grams", pa.array(sizes)))
        return pa.Table.from_batches(parts)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out)


def trusted_ids(labels: DataFrame, id_column: str, trusted: str) -> DataFrame:
    """``id, held`` of trusted documents; ids whose labels disagree or are null are not trusted."""
    good = labels.groupBy(F.col(id_column).alias("id")).agg(F.min(trusted).alias("low"), F.max(trusted).alias("high"))
    good = good.filter("low = 1 and high = 1 and id is not null")
    return good.select("id", (F.pmod(F.xxhash64("id", F.lit("held")), F.lit(HELD)) == 0).alias("held"))


def perplexities(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    language: str = "lang",
    trusted: str = "quality",
    keep: Sequence[str] | None = None,
    order: int = ORDER,
) -> DataFrame:
    """``id, lang, log_perplexity, n_grams`` per document row, and with ``keep`` a struct ``row`` of those columns (``c0``, ``c1`` …) and ``text``.

    ``log_perplexity`` is the mean negative log probability of the text's bytes and its end. Trusted are rows
    whose id has the label 1; of these ids one in ``HELD``, by hash, is held back from the counts. Null texts
    count as empty. Rows of one id are each scored and lie in one block; rows without an id teach nothing.
    """
    blocks = F.lit(pieces_of(text_bytes(documents, text), BLOCK_BYTES, least=16))
    kept = [F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(keep)], F.lit(0).alias("none")).alias("row")] if keep is not None else []
    rows = documents.select(
        F.col(id_column).alias("id"), F.col(language).cast("string").alias("lang"), *kept, F.col(text).cast("string").alias("text")
    )
    dealt = F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("id"))
    packed = packed_blocks(rows, F.pmod(dealt, blocks))  # made anew for each use: cheaper than another copy of the texts
    teaching = trusted_ids(labels, id_column, trusted).filter("not held")
    teaching = teaching.select(F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"), "id")
    counted = cut_lineage(block_counts(packed, teaching, order))
    totals = cut_lineage(counted.groupBy("gram").agg(F.sum("n").alias("n")))
    logs = log_probabilities(totals.select("gram"), totals.filter("n > 0"), order)
    return score_blocks(packed, counted.select("block", "gram").join(logs, "gram"), rows.schema if kept else rows.drop("text").schema, order)


def thresholds(scored: DataFrame, held: DataFrame) -> DataFrame:
    """``lang, log_middle, log_threshold`` for each language with held trusted texts, and one row with ``lang`` null for all others.

    The threshold is the median plus ``REACH`` times the distance from the median to the ``QUANTILE``. A language's
    median and distance are weighed by its number of held texts against ``PRIOR_HELD`` times those of all languages,
    so one rule holds at every size. Without any held text nothing is rejected.
    """
    values = scored.select("id", "lang", "log_perplexity").join(held, "id")

    low, high = (F.percentile_approx("log_perplexity", q, 10_000) for q in (0.5, QUANTILE))
    middle, reach = values.agg(low, high - low).first()
    if middle is None:
        middle, reach = 0.0, float("inf")
    own = values.filter("lang is not null").groupBy("lang").agg(low.alias("middle"), (high - low).alias("reach"), F.count(F.lit(1)).alias("n"))
    weighed = [(F.col("n") * F.col(c) + PRIOR_HELD * every) / (F.col("n") + PRIOR_HELD) for c, every in (("middle", middle), ("reach", reach))]
    others = scored.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(middle), F.lit(middle + REACH * reach))
    return own.select("lang", weighed[0].alias("log_middle"), (weighed[0] + REACH * weighed[1]).alias("log_threshold")).union(others)


def judged(scored: DataFrame, labels: DataFrame, id_column: str, trusted: str = "quality") -> DataFrame:
    """``scored`` with ``log_threshold`` and ``accepted``.

    The thresholds are a written table, so Spark knows its size and sends it to the rows only if it is small.
    """
    limits = cut_lineage(thresholds(scored, trusted_ids(labels, id_column, trusted).filter("held").select("id")))
    every = limits.filter("lang is null").first()
    joined = scored.join(limits.filter("lang is not null"), "lang", "left").fillna({c: every[c] for c in ("log_middle", "log_threshold")})
    n = F.col("n_grams")
    evidence = (F.col("log_perplexity") * n + F.col("log_middle") * PRIOR_BYTES) / (n + PRIOR_BYTES)
    return joined.withColumn("accepted", evidence <= F.col("log_threshold"))


def quality_scores(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``id, perplexity, threshold, accepted`` per document row."""
    scored = cut_lineage(perplexities(documents, labels, id_column))
    return judged(scored, labels, id_column).select(
        F.col("id").alias(id_column), F.exp("log_perplexity").alias("perplexity"), F.exp("log_threshold").alias("threshold"), "accepted"
    )


def drop_low_quality(documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose perplexity is within the threshold of their language, as they are.

    Null and empty texts are judged by the end of the text alone; see ``perplexities`` for repeated rows and ids.
    """
    others = [c for c in documents.columns if c != text]
    scored = cut_lineage(perplexities(documents, labels, id_column, text, keep=others))
    columns = [F.col("text") if c == text else F.col(f"row.c{others.index(c)}") for c in documents.columns]
    return judged(scored, labels, id_column).filter("accepted").select(*columns).toDF(*documents.columns)


@query("op9_quality_classifier")
def op9(spark, folder):
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))
