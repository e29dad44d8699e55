"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ``window`` consecutive words of the test texts; a test text of fewer words,
but not none, is one shorter pattern. Patterns of one length share a table: the block of the last words
under the search position gives a shift, which skips positions where no pattern can end; where the shift
is zero, the bucket of that block, divided by the pattern's first words, holds the few patterns to compare
word by word. Every occurrence is found, overlapping ones included.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.llm.common import Batches, column, filter_texts, map_texts, pieces_of, text_bytes
from palimpsest.llm.registry import query, table
from palimpsest.session import cut_lineage

WINDOW = 13
#: Bytes of test texts searched for in one pass over the documents.
PASS_BYTES = 32 * 1024 * 1024
#: Lower-cases A-Z; every other ASCII byte that is no letter or digit becomes a space.
WORD_BYTES = bytes(
    b if b >= 0x80 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; null has none."""
    return text.encode().translate(WORD_BYTES).split() if text else []


class PatternTable:
    """Search tables for patterns of one length (in words)."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], int]):
        self.length = length
        self.block = min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list]] = {}
        for words, number in patterns.items():
            for end in range(self.block, length + 1):
                block = words[end - self.block : end]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            firsts = self.buckets.setdefault(words[-self.block :], {})
            firsts.setdefault(words[: self.block], []).append((list(words), number))

    def search(self, words: list[bytes]) -> list[tuple[int, int]]:
        """``(start, pattern number)`` of every occurrence, by start."""
        found = []
        shift, far, length, block, n = self.shift, self.far, self.length, self.block, len(words)
        at = length - 1
        while at < n:
            key = (words[at - 1], words[at]) if block == 2 else (words[at],)
            step = shift.get(key, far)
            if step:
                at += step
                continue
            start = at - length + 1
            for pattern, number in self.buckets[key].get(tuple(words[start : start + block]), ()):
                if words[start : at + 1] == pattern:
                    found.append((start, number))
            at += 1
        return found


def pattern_tables(items: list[tuple[str | None, str | None]], window: int) -> tuple[list[PatternTable], list[list[str]]]:
    """Tables by pattern length, and for each pattern number the names of the items that have it."""
    numbers: dict[tuple[bytes, ...], int] = {}
    owners: list[set] = []
    by_length: dict[int, dict[tuple[bytes, ...], int]] = defaultdict(dict)
    for name, text in items:
        words = words_of(text)
        size = min(window, len(words))
        for at in range(len(words) - size + 1 if size else 0):
            pattern = tuple(words[at : at + size])
            number = numbers.setdefault(pattern, len(numbers))
            if number == len(owners):
                owners.append(set())
                by_length[size][pattern] = number
            if name is not None:
                owners[number].add(name)
    return [PatternTable(size, patterns) for size, patterns in by_length.items()], [sorted(o) for o in owners]


HITS = "n_words long, text string, spans array<struct<first:int,last:int>>, items array<string>"


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def _items(benchmark: DataFrame, item_column: str, item_text: str) -> DataFrame:
    items = benchmark.select(F.col(item_column).cast("string").alias("name"), F.col(item_text).cast("string").alias("words"))
    return items.filter("words is not null").distinct()


def benchmark_hits(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    item_column: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    pass_bytes: int = PASS_BYTES,
) -> DataFrame:
    """``id, n_words, n_hit, spans, items`` per document row.

    ``spans``: disjoint word ranges (first and last word, from 0) that lie in occurrences; ``n_hit``: words
    in them; ``items``: names of the items with an occurring window, sorted as strings. Documents whose
    text is null or has no words get zeros and empty lists, also with an empty benchmark. Items without
    words have no windows; an item whose id is null marks words but has no name; repeated rows on either
    side change nothing for others. Other columns are not read.

    The test set goes to the executors in passes of about ``pass_bytes`` of its text, each over all rows,
    so a benchmark of any size fits; one pass is the rule.
    """
    spark = documents.sparkSession
    items = _items(benchmark, item_column, item_text)
    passes = pieces_of(text_bytes(items, "words"), pass_bytes)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).alias("text"))
    found = None
    for number in range(passes):
        block = items.filter(F.pmod(F.xxhash64("name", "words"), F.lit(passes)) == number).collect()
        shared = spark.sparkContext.broadcast([tuple(r) for r in block])
        last = number == passes - 1

        def search(batches: Batches, shared=shared, last=last) -> Batches:
            tables, owners = pattern_tables(shared.value, window)
            for batch in batches:
                n_words, spans, names = [], [], []
                for value in batch.column("text").to_pylist():
                    words = words_of(value)
                    hits = [(t.length, hit) for t in tables for hit in t.search(words)] if words else []
                    n_words.append(len(words))
                    spans.append([{"first": a, "last": b} for a, b in _merged([(s, s + size - 1) for size, (s, _) in hits])])
                    names.append(sorted({name for p in {p for _, (_, p) in hits} for name in owners[p]}))
                kept = pa.nulls(batch.num_rows, pa.string()) if last else batch.column("text")
                span = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
                columns = [batch.column("id"), pa.array(n_words, pa.int64()), kept, pa.array(spans, span), pa.array(names, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_words", "text", "spans", "items"])

        if found is None:
            found = map_texts(rows, "id", "text", search, HITS)
        else:
            # cut between passes: a task holds the tables of one pass only
            found = _joined(cut_lineage(found), search)
    # ranges of several passes may overlap or touch: the words are counted once
    ranges = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda done, x: F.when((F.size(done) > 0) & (x["first"] <= F.element_at(done, -1)["last"] + 1), _extended(done, x)).otherwise(
            F.concat(done, F.array(x))
        ),
    )
    found = found.withColumn("spans", ranges) if passes > 1 else found
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + (x["last"] - x["first"] + 1))
    return found.select(F.col("id").alias(id_column), "n_words", hit.alias("n_hit"), "spans", "items")


def _extended(done: Column, x: Column) -> Column:
    end = F.element_at(done, -1)
    longer = F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"))
    return F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))


def _joined(found: DataFrame, search) -> DataFrame:
    """One more pass over rows that carry the hits of the passes before."""
    schema = found.schema

    def run(batches: Batches) -> Batches:
        for batch in batches:
            (new,) = search(iter([batch.select(["id", "text"])]))
            spans = [a + b for a, b in zip(batch.column("spans").to_pylist(), new.column("spans").to_pylist(), strict=True)]
            items = [sorted({*a, *b}) for a, b in zip(batch.column("items").to_pylist(), new.column("items").to_pylist(), strict=True)]
            new = new.set_column(3, "spans", pa.array(spans, new.column("spans").type))
            yield new.set_column(4, "items", pa.array(items, new.column("items").type))

    return found.mapInArrow(run, schema)


def contaminated(n_words: Column, n_hit: Column) -> Column:
    """A twentieth of the words or more lie in test texts."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def clean_documents(documents: DataFrame, benchmark: DataFrame, text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """The rows of ``documents`` whose text is not contaminated, as they are, without a shuffle.

    Null and empty texts stay. A benchmark of one pass, which is the rule, filters the rows where they are.
    """
    items = _items(benchmark, "item_id", "text")
    if pieces_of(text_bytes(items, "words"), pass_bytes) > 1:
        rows = documents.select(F.struct(*[column(c).alias(f"c{i}") for i, c in enumerate(documents.columns)]).alias("row"), column(text).alias("text"))
        hits = benchmark_hits(rows, benchmark, "row", "text", pass_bytes=pass_bytes)
        return hits.filter(~contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*").toDF(*documents.columns)
    shared = documents.sparkSession.sparkContext.broadcast([tuple(r) for r in items.collect()])

    def make():
        tables, _ = pattern_tables(shared.value, WINDOW)

        def clean(texts: list) -> list[bool]:
            out = []
            for value in texts:
                words = words_of(value)
                spans = [(s, s + t.length - 1) for t in tables for s, _ in t.search(words)] if words else []
                hit = sum(b - a + 1 for a, b in _merged(spans))
                out.append(not (hit and 20 * hit >= len(words)))
            return out

        return clean

    return filter_texts(documents, text, make)


WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP8_SQL = f"""
WITH items AS (SELECT DISTINCT item_id, {WORDS_SQL} AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT item_id, least(len(w), {WINDOW}) AS m,
         unnest(list_transform(range(1, (CASE WHEN len(w) = 0 THEN 0 ELSE len(w) - least(len(w), {WINDOW}) + 1 END) + 1),
                               lambda i: array_to_string(w[i : i + least(len(w), {WINDOW}) - 1], ' '))) AS win
  FROM items),
patterns AS (SELECT DISTINCT item_id, m, win FROM windows),
docs AS (SELECT doc_id, coalesce({WORDS_SQL}, []) AS w FROM documents),
places AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM docs, (SELECT DISTINCT m FROM patterns) WHERE len(w) >= m)),
hits AS (SELECT p.doc_id, p.i, p.m, q.item_id FROM places p JOIN patterns q ON p.m = q.m AND p.win = q.win),
covered AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       coalesce(n.items_sha256, sha256('')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


@query("op8_benchmark_decontamination", OP8_SQL)
def op8(spark, folder):
    hits = benchmark_hits(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return hits.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )
