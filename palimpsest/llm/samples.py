"""Bounded samples of labelled texts to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.session import cut_lineage

#: Characters that a text gives to a fit at most: longer ones give ``PIECES`` pieces, spread by hash over the whole
#: text. That bounds the memory of a fit.
MOST_CHARACTERS, PIECES = 65_536, 16


def _pieces(text: Column) -> Column:
    """The text, or pieces of it: one from each of ``PIECES`` equal stretches, at a place that a hash says."""
    each, size = MOST_CHARACTERS // PIECES, F.length(text)
    stretch = F.floor(size / PIECES).cast("int")
    start = lambda k: k * stretch + F.pmod(F.xxhash64(text, k), F.greatest(stretch - each, F.lit(1)).cast("long")).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.lit(PIECES - 1)), lambda k: F.substring(text, start(k) + 1, F.lit(each)))
    return F.when(size > MOST_CHARACTERS, F.array_join(cut, " ")).otherwise(text)


def labelled_texts(
    labelled: DataFrame, documents: DataFrame, id_column: str, text: str, label: str, per_label: int, max_labels: int = 256
) -> tuple[list[tuple], dict]:
    """``(label, text)`` pairs, at most ``per_label`` of each label, and the number of labelled rows by label.

    ``labelled`` has the id and the label; rows where either is null are left out, as are null texts. A text longer
    than ``MOST_CHARACTERS`` gives pieces from all over it. Ids are drawn by hash, so a run repeats on any cluster. With more
    than ``max_labels`` labels the most frequent ones are learned.
    """
    known = labelled.select(F.col(id_column).alias("id"), F.col(label).alias("label")).dropna()
    counts = known.groupBy("label").count().orderBy(F.desc("count"), "label").limit(max_labels).collect()
    if not counts:
        return [], {}
    draw = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["label"], min(1.0, 1.2 * per_label / r["count"]))])
    # a written table: rows from the driver would start Python workers of their own kind on every executor
    picked = cut_lineage(known.withColumn("draw", draw).filter(F.col("draw") < share[F.col("label")]).distinct())
    texts = (
        documents.select(F.col(id_column).alias("id"), _pieces(F.col(text)).alias("text"))
        .filter(F.col("text").isNotNull())
        .join(F.broadcast(picked), "id")
        .select("label", "draw", "text")
        .distinct()
        .collect()
    )
    out = []
    for r in counts:
        own = sorted((t["draw"], t["text"]) for t in texts if t["label"] == r["label"])
        out += [(r["label"], t) for _, t in own[:per_label]]
    return out, {r["label"]: r["count"] for r in counts}
