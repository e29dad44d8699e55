"""Alignment of two tokenizers' tokens over the bytes of a text.

Tokens of both sides are placed by the bytes they cover. An as-of merge keyed by document finds, for each token
start, the other side's token that covers it; both directions together give all pairs that overlap, since of two
such tokens the later one starts inside the other. Groups begin where both sides start a token together, which is
where both ended one before.

Statistics over the corpus go by blocks of texts: a block sends its different pairs of ids with the number of its
documents that hold them, and gets each pair's count in the corpus back.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from functools import cached_property
from hashlib import sha256
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from palimpsest.llm.bpe import PRE_TOKENS, byte_letters, stretches, tokenizer_path
from palimpsest.llm.common import Batches, Runs, Slots, bounded_slices, kept_in_worker, map_texts, small_batches
from palimpsest.llm.registry import query, table
from palimpsest.session import cut_lineage

BYTE_VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Text bytes whose different pairs make one block, about.
BLOCK_BYTES = 32_000_000
#: Text bytes that are aligned at a time, about.
SLICE_BYTES = 2_000_000
#: Ids of the second side take so many bits of a pair's number.
ID_BITS = 24


class ByteSide:
    """Ids of stretches by a byte-level ``tokenizer.json``; strings of special tokens are plain text.

    Where the ids of the vocabulary follow the order of its merges, tiktoken encodes by them; other vocabularies,
    and stretches too long for its pattern engine, go to the tokenizers library.
    """

    LONGEST = 4_000

    def __init__(self, path: str):
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        special = {t["content"] for t in spec["added_tokens"]}
        raw = {bytes(letters[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in special}
        self.raw = [b""] * (1 + max(spec["model"]["vocab"].values()))
        for token, number in raw.items():
            self.raw[number] = token
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)
        made = [raw[bytes(letters[c] for x in (m.split(" ") if isinstance(m, str) else m) for c in x)] for m in spec["model"]["merges"]]
        self.fast = None
        if made == sorted(made) and len(raw) == 256 + len(set(made)):
            self.fast = tiktoken.Encoding("ranks", pat_str=PRE_TOKENS.pattern, mergeable_ranks=raw, special_tokens={})

    @cached_property
    def library(self):
        """The tokenizers library, loaded when a stretch needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.path)
        found.encode_special_tokens = True
        return found

    def __call__(self, opened: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches end to end, and their number by stretch; each begins with a blank."""
        lists: list = [None] * len(opened)
        plain = []
        for k, text in enumerate(opened):
            if self.fast is None or len(text) > self.LONGEST:
                lists[k] = self.library.encode(text, add_special_tokens=False).ids
            elif len(text) == 1 or text[1].isspace() or text[-1].isspace():
                lists[k] = self.fast.encode_ordinary(text)
            else:
                plain.append(k)
        # these neither open nor end with white space, so that one call does for many of them
        for first in range(0, len(plain), 1000):
            part = plain[first : first + 1000]
            ids = self.fast.encode_ordinary("".join([opened[k] for k in part]))
            ends = np.cumsum(self.sizes[ids])
            own = np.cumsum([len(opened[k].encode()) for k in part])
            cuts = np.searchsorted(ends, own, side="right").tolist()
            for k, a, b in zip(part, [0, *cuts[:-1]], cuts, strict=True):
                lists[k] = ids[a:b]
        return _flat(lists)


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter(chain.from_iterable(lists), dtype=np.int32, count=sizes.sum()), sizes


class PieceSide:
    """Ids of stretches by a SentencePiece model that writes a blank in front itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.raw = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(pieces)]
        if any(BLANK in p.lstrip(BLANK) for p in pieces):
            raise ValueError("pieces of this model cross blanks")
        self.sizes = np.array([len(r) for r in self.raw], dtype=np.int64)

    def __call__(self, opened: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all stretches end to end, and their number by stretch; each begins with a blank."""
        return _flat(self.model.encode([s[1:] for s in opened], num_threads=1))


class BothSides:
    """Ids of whole texts by two tokenizers.

    Both start anew at a single blank between visible characters, so texts are cut there and the stretches
    encoded once; what was encoded before is looked up.
    """

    #: Stretches and their characters that are kept.
    KEPT, CHARACTERS = 200_000, 8_000_000

    def __init__(self, vocabulary: str, model: str):
        self.sides = ByteSide(tokenizer_path(vocabulary)), PieceSide(tokenizer_path(model))
        self.sizes = [side.sizes for side in self.sides]
        self._clear()

    def _clear(self) -> None:
        self.slots, self.runs = Slots(), (Runs(), Runs())
        self.bad: list[int] = []
        self.characters = 0

    def _learn(self) -> None:
        """Ids of the stretches that are new."""
        opened = [" " + s for s in self.slots.taken()]
        first = self.runs[0].count
        raw = [s.encode() for s in opened]
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        self.characters += int(lengths.sum())
        for side, runs in zip(self.sides, self.runs, strict=True):
            flat, sizes = side(opened)
            runs.add(flat, sizes)
            whole, ends = np.concatenate([[0], np.cumsum(side.sizes[flat])]), np.cumsum(sizes)
            spelled = list(map(side.raw.__getitem__, flat.tolist()))
            if (whole[ends] - whole[ends - sizes] == lengths).all() and b"".join(spelled) == b"".join(raw):
                continue
            for k, (a, b) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
                if b"".join(spelled[a:b]) != raw[k]:
                    self.bad.append(first + k)

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each side the ids of all texts end to end and the number of tokens of each text.

        A text whose tokens do not spell it, blank in front included, has none on either side.
        """
        if len(self.slots) > self.KEPT or self.characters > self.CHARACTERS:
            self._clear()
        cuts = [stretches(t) if t else [] for t in texts]
        counts = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        slots = np.fromiter(map(self.slots.__getitem__, chain.from_iterable(cuts)), dtype=np.int64, count=counts.sum())
        self._learn()
        text = np.repeat(np.arange(len(texts)), counts)
        if self.bad:
            wrong = np.zeros(len(texts), dtype=bool)
            wrong[text[np.isin(slots, self.bad)]] = True
            slots, text = slots[~wrong[text]], text[~wrong[text]]
        ids, tokens = [], []
        for runs in self.runs:
            flat, sizes = runs.of(slots)
            ids.append(flat.astype(np.int64))
            tokens.append(np.bincount(text, weights=sizes, minlength=len(texts)).astype(np.int64))
        return ids, tokens


class Alignment:
    """Links and groups of the tokens of several documents that lie end to end."""

    def __init__(self, ids: list[np.ndarray], counts: list[np.ndarray], sizes: list[np.ndarray]):
        self.ids, self.counts = ids, counts
        documents = np.arange(len(counts[0]))
        self.doc = [np.repeat(documents, n) for n in counts]
        starts = []
        for own, size in zip(ids, sizes, strict=True):
            ends = np.cumsum(size[own])
            starts.append(ends - size[own])
        self.starts = starts
        frames = [pd.DataFrame({"at": s, "doc": d, "token": np.arange(len(s))}) for s, d in zip(starts, self.doc, strict=True)]
        left, right = frames
        over = lambda a, b: pd.merge_asof(a[["at", "doc"]], b, on="at", by="doc")["token"].to_numpy().astype(np.int64)
        self.cover = [over(left, right), over(right, left)] if len(left) else [np.zeros(0, dtype=np.int64)] * 2
        #: Whether a token starts together with one of the other side.
        self.together = [starts[1 - k][self.cover[k]] == starts[k] for k in (0, 1)]
        self.group = [np.cumsum(t) - 1 for t in self.together]

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """All overlapping pairs as token numbers of both sides, each once."""
        inside = ~self.together[1]
        a = np.concatenate([np.arange(len(self.ids[0])), self.cover[1][inside]])
        b = np.concatenate([self.cover[0], np.flatnonzero(inside)])
        return a, b

    def groups(self) -> np.ndarray:
        """Groups of each document."""
        return np.bincount(self.doc[0][self.together[0]], minlength=len(self.counts[0]))

    def digests(self, names: "Names") -> list[str]:
        """SHA-256 of each document's groups written out; '' for a document without tokens."""
        if not len(self.ids[0]):
            return [""] * len(self.counts[0])
        firsts = [np.flatnonzero(t) for t in self.together]
        lasts = [np.append(f[1:], len(i)) for f, i in zip(firsts, self.ids, strict=True)]
        out = np.empty(len(self.ids[0]) + len(self.ids[1]), dtype=object)
        last_of_group = np.zeros(len(self.ids[0]), dtype=np.int64)
        last_of_group[lasts[0] - 1] = 1
        out[np.arange(len(self.ids[0])) + firsts[1][self.group[0]]] = names.first[last_of_group, self.ids[0]]
        kind = np.zeros(len(self.ids[1]), dtype=np.int64)
        kind[lasts[1] - 1] = 1
        ends = np.cumsum(self.counts[1])[self.counts[1] > 0]
        kind[ends - 1] = 2
        out[np.arange(len(self.ids[1])) + lasts[0][self.group[1]]] = names.second[kind, self.ids[1]]
        written, at, found = out.tolist(), 0, []
        for n in (self.counts[0] + self.counts[1]).tolist():
            found.append(sha256(b"".join(written[at : at + n])).hexdigest() if n else "")
            at += n
        return found


class Names:
    """Decimal ids with the sign that follows them in a digest: commas inside a group, then ``|`` and ``;``."""

    def __init__(self, sizes: list[np.ndarray]):
        def signed(count: int, signs: tuple[str, ...]) -> np.ndarray:
            out = np.empty((len(signs), count), dtype=object)
            for k, sign in enumerate(signs):
                out[k] = [f"{i}{sign}".encode() for i in range(count)]
            return out

        self.first = signed(len(sizes[0]), (",", "|"))
        self.second = signed(len(sizes[1]), (",", ";", ""))


def _tools(vocabulary: str, model: str) -> tuple[BothSides, Names]:
    both = BothSides(vocabulary, model)
    return both, Names(both.sizes)


def token_groups(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL
) -> DataFrame:
    """``id, groups`` per row: for each group of tokens that end together, its bytes and the ids of both sides.

    ``start`` and ``stop`` count UTF-8 bytes of the text with one blank in front, which both tokenizers get. Null
    and empty texts, and texts that the tokens of a side do not spell (such as one with the sign that pieces write
    for a blank), have no groups. Rows are independent of each other; other columns are not read.
    """
    ints = pa.list_(pa.int32())
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("a", ints), ("b", ints)]))

    def cut(batches: Batches) -> Batches:
        both, _ = kept_in_worker(("alignment", vocabulary, model), lambda: _tools(vocabulary, model))
        for batch in batches:
            ids, counts = both(batch.column("text").to_pylist())
            found = Alignment(ids, counts, both.sizes)
            firsts = [np.flatnonzero(t) for t in found.together]
            parts = [np.split(i, f[1:]) if len(f) else [] for i, f in zip(ids, firsts, strict=True)]
            at = found.starts[0][firsts[0]]
            doc = found.doc[0][firsts[0]]
            stop = np.append(at[1:], both.sizes[0][ids[0]].sum())
            origin = np.concatenate([[0], np.cumsum(np.bincount(found.doc[0], weights=both.sizes[0][ids[0]], minlength=batch.num_rows))])
            rows: list[list] = [[] for _ in range(batch.num_rows)]
            for k, d in enumerate(doc.tolist()):
                base = int(origin[d])
                rows[d].append({"start": int(at[k]) - base, "stop": int(stop[k]) - base, "a": parts[0][k], "b": parts[1][k]})
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, kind)], names=["id", "groups"])

    return map_texts(df, id_column, text, cut, "groups array<struct<start:bigint,stop:bigint,a:array<int>,b:array<int>>>", keeps=True)


class _Block:
    """Documents of one block until its different pairs are known."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.packed: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.bytes = 0

    def add(self, rows: pa.RecordBatch, found: Alignment) -> None:
        a, b = found.links()
        codes, pairs = pd.factorize(found.ids[0][a] << ID_BITS | found.ids[1][b])
        held = np.sort(found.doc[0][a] << 32 | codes)
        new = np.append(True, held[1:] != held[:-1]) if len(held) else np.zeros(0, dtype=bool)
        firsts = np.flatnonzero(new)
        times = np.diff(np.append(firsts, len(held)))
        held = held[firsts]
        code = held & 0xFFFFFFFF
        self.rows.append(rows)
        self.pairs.append(np.asarray(pairs, dtype=np.int64))
        self.docs.append(np.bincount(code, minlength=len(pairs)).astype(np.int32))
        self.packed.append((np.bincount(held >> 32, minlength=rows.num_rows), code.astype(np.int32), times.astype(np.int32)))

    def out(self, number: int) -> Iterator[pa.RecordBatch]:
        """The rows of the block; the first one of each slice holds the links of all of the slice's documents."""
        codes, pairs = pd.factorize(np.concatenate(self.pairs))
        docs = np.bincount(codes, weights=np.concatenate(self.docs), minlength=len(pairs)).astype(np.int64)
        at, place = 0, 0
        press = zstandard.ZstdCompressor(level=1).compress
        for rows, own, (sizes, code, times) in zip(self.rows, self.pairs, self.packed, strict=True):
            parts = [codes[at : at + len(own)], sizes, np.diff(code, prepend=0), times]
            at += len(own)
            raw = struct.pack("<4q", *map(len, parts)) + b"".join(p.astype("<i4").tobytes() for p in parts)
            n = rows.num_rows
            first = lambda x, kind: pa.array([x] + [None] * (n - 1), kind)
            top = not place
            columns = [
                pa.array(np.full(n, number)),
                pa.array(np.arange(place, place + n)),
                *rows.columns,
                first(press(raw), pa.binary()),
                first(pairs if top else None, pa.list_(pa.int64())),
                first(docs if top else None, pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "place", *rows.schema.names, "packed", "pairs", "docs"])
            place += n


def _unpacked(packed: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    sizes = struct.unpack_from("<4q", raw)
    flat = np.frombuffer(raw, dtype="<i4", offset=32)
    mapping, counts, steps, times = np.split(flat, np.cumsum(sizes)[:-1])
    return [counts, mapping[np.cumsum(steps, dtype=np.int64)] if len(steps) else steps, times]


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_blocks(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL
) -> DataFrame:
    """A row per row of ``df``, in blocks, as a written table: counts and digest, and the block's pairs and links.

    ``block``, ``place``, ``id``, the counts, ``packed`` (links of a run of rows), and in a block's first row
    ``pairs`` (both ids in one number) with ``docs`` (documents of the block that hold the pair).
    """

    def align(batches: Batches) -> Batches:
        both, names = kept_in_worker(("alignment", vocabulary, model), lambda: _tools(vocabulary, model))
        number = TaskContext.get().partitionId() << 24
        block = _Block()
        for batch in batches:
            ids, counts = both(batch.column("text").to_pylist())
            found = Alignment(ids, counts, both.sizes)
            columns = [
                batch.column("id"),
                *[pa.array(c) for c in counts],
                pa.array(found.groups()),
                pa.array(np.bincount(found.doc[0], minlength=batch.num_rows) + np.bincount(found.doc[1][~found.together[1]], minlength=batch.num_rows)),
                pa.array(found.digests(names)),
            ]
            block.add(pa.RecordBatch.from_arrays(columns, names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]), found)
            block.bytes += batch.column("text").nbytes
            if block.bytes >= BLOCK_BYTES:
                yield from block.out(number)
                number, block = number + 1, _Block()
        if block.rows:
            yield from block.out(number)

    rows = df.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [
            *T.StructType.fromDDL("block long, place long").fields,
            T.StructField("id", rows.schema["id"].dataType),
            *T.StructType.fromDDL(f"{_DOC}, packed binary, pairs array<long>, docs array<long>").fields,
        ]
    )
    sliced = lambda batches: align(part for batch in batches for part in bounded_slices(batch, "text", SLICE_BYTES))
    return cut_lineage(small_batches(rows).mapInArrow(sliced, schema))


def _entries(blocks: DataFrame) -> DataFrame:
    """``block, at, pair, docs``: each block's different pairs, numbered from 0."""
    held = blocks.filter(F.col("pairs").isNotNull()).select("block", F.arrays_zip("pairs", "docs").alias("held"))
    return held.select("block", F.posexplode("held").alias("at", "x")).select("block", "at", F.col("x.pairs").alias("pair"), F.col("x.docs").alias("docs"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, a, b, n, best``: documents of the corpus that hold the pair linked, and whether no pair of its ``a`` has more."""
    counts = _entries(blocks).groupBy("pair").agg(F.sum("docs").alias("n"))
    counts = counts.select("pair", F.shiftright("pair", ID_BITS).alias("a"), F.col("pair").bitwiseAND((1 << ID_BITS) - 1).alias("b"), "n")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(most, "a").select("pair", "a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment_statistics(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", vocabulary: str = BYTE_VOCABULARY, model: str = PIECE_MODEL
) -> DataFrame:
    """``id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` per row.

    ``n_links``: overlapping pairs of token occurrences; ``n_best``: those whose pair of ids is held by the most rows
    of the table among all pairs of its first id (ties included); ``count_sum``: the sum over links of the number of
    rows that hold their pair. The digest is of ``a1,a2|b1;a3|b2,b3``. Texts without tokens (null, empty, not spelled
    by their tokens) have zeros and ''. Repeated rows are rows of their own; other columns are not read. A task holds
    the links of one block, or of one text that is longer.
    """
    blocks = aligned_blocks(df, id_column, text, vocabulary, model)
    answers = _entries(blocks).join(pair_counts(blocks), "pair").select(F.col("block").alias("of_block"), "at", "n", "best")
    asked = blocks.drop("pairs", "docs")
    schema = T.StructType(
        [asked.schema["id"], *T.StructType.fromDDL("n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string").fields]
    )
    names = schema.names
    empty = df.sparkSession.createDataFrame([], schema).toArrow().schema

    def settle(mine: pa.Table, found: pa.Table) -> pa.Table:
        if not mine.num_rows:
            return empty.empty_table()
        mine = mine.sort_by("place")
        n, best = np.zeros(found.num_rows, dtype=np.int64), np.zeros(found.num_rows, dtype=np.int64)
        at = found.column("at").to_numpy()
        n[at], best[at] = found.column("n").to_numpy(), found.column("best").to_numpy(zero_copy_only=False)
        sums = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for packed in mine.column("packed").drop_null().to_pylist():
            sizes, codes, times = _unpacked(packed)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            for value, out in zip((best, n), sums, strict=True):
                total = np.zeros(len(sizes), dtype=np.int64)
                np.add.at(total, doc, value[codes] * times)
                out.append(total)
        columns = dict(zip(mine.column_names, mine.columns, strict=True)) | {
            "n_best": pa.array(np.concatenate(sums[0])),
            "count_sum": pa.array(np.concatenate(sums[1])),
        }
        return pa.table([columns[c] for c in names], names=names).cast(empty)

    done = asked.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(settle, schema)
    return done.withColumnRenamed("id", id_column)


@query("op12_cross_tokenizer_alignment")
def op12(spark, folder):
    return alignment_statistics(table(spark, folder, "documents"))
