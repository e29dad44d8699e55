"""Token-id files with shuffled bit planes.

A file holds the ids of consecutive documents, end to end, in blocks of a fixed number of ids. A block's
ids are transposed into planes, one per bit (or per byte) that any id of the block uses, and each plane is
compressed with zstandard. Behind the blocks come the table of documents (id and number of ids), the index
of the blocks, and a fixed-size tail that says where they begin:

    "PLNE" | plane … plane | … | documents | index | tail

    documents  zstandard of an Arrow stream with columns doc (any type), n (int64)
    index      per block: ids, planes, offset, then the byte size of each plane   (little-endian uint64)
    tail       offset of documents, of index, blocks, ids per block, 1 bit or 8 bits a plane, "PLNE"
"""

from __future__ import annotations

import functools
import os
import struct
import uuid
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from palimpsest.llm.bpe import SINGLE_SPACE, stretches, tokenizer_path
from palimpsest.llm.common import Batches, RunTable, Runs, bounded_slices, kept_in_worker, pieces_of, text_bytes
from palimpsest.llm.registry import query, table
from palimpsest.session import cut_lineage, new_folder

MARK = b"PLNE"
TAIL = "<QQQQQ4s"
BLOCK = 1 << 16
VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Text bytes of one file, about.
FILE_BYTES = 48 * 1024 * 1024


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """Planes of a block of uint32 ids, lowest first; ``bits`` is 1 for bit planes or 8 for byte planes."""
    used = max(1, -(-int(ids.max(initial=0)).bit_length() // bits))
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [raw[:, k].tobytes() for k in range(used)]
    columns = [np.ascontiguousarray(raw[:, k]) for k in range(-(-used // 8))]
    return [np.packbits(columns[k // 8] & np.uint8(1 << k % 8)).tobytes() for k in range(used)]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    ids = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        values = np.frombuffer(plane, np.uint8)
        if bits == 1:
            values = np.unpackbits(values, count=n)
        ids |= values.astype(np.uint32) << np.uint32(k * bits)
    return ids


class PlaneWriter:
    """Writes ids to a stream block by block; holds one block at most, and the sizes of the documents."""

    def __init__(self, out, block: int = BLOCK, bits: int = 1, level: int = 3):
        self.out, self.block, self.bits = out, block, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at = out.write(MARK)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.index: list[list[int]] = []
        self.docs: list[pa.RecordBatch] = []

    def _block(self, ids: np.ndarray) -> None:
        planes = [self.pack(p) for p in to_planes(ids, self.bits)]
        self.index.append([len(ids), len(planes), self.at, *map(len, planes)])
        for plane in planes:
            self.at += self.out.write(plane)

    def add(self, names: pa.Array, ids: list[np.ndarray]) -> None:
        """Append documents: their names and their ids."""
        self.docs.append(pa.RecordBatch.from_arrays([names, pa.array([len(x) for x in ids], pa.int64())], names=["doc", "n"]))
        self.waiting += ids
        self.held += sum(map(len, ids))
        if self.held >= self.block:
            flat = np.concatenate(self.waiting)
            full = len(flat) - len(flat) % self.block
            for at in range(0, full, self.block):
                self._block(flat[at : at + self.block])
            self.waiting, self.held = [flat[full:]], len(flat) - full

    def close(self, schema: pa.Schema) -> None:
        if self.held:
            self._block(np.concatenate(self.waiting))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as stream:
            for batch in self.docs:
                stream.write_batch(batch)
        docs_at = self.at
        self.at += self.out.write(self.pack(sink.getvalue().to_pybytes()))
        index = np.array([x for row in self.index for x in row], dtype="<u8").tobytes()
        self.out.write(index)
        self.out.write(struct.pack(TAIL, docs_at, self.at, len(self.index), self.block, self.bits, MARK))


class PlaneReader:
    """Reads a file of planes; any block can be read without the others."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - struct.calcsize(TAIL))
        docs_at, index_at, blocks, self.block, self.bits, mark = struct.unpack(TAIL, source.read(struct.calcsize(TAIL)))
        if mark != MARK:
            raise ValueError("not a file of token planes")
        source.seek(index_at)
        flat = np.frombuffer(source.read(source.size() - struct.calcsize(TAIL) - index_at), dtype="<u8").tolist()
        self.index, at = [], 0
        for _ in range(blocks):
            n, planes, offset = flat[at : at + 3]
            self.index.append((n, offset, flat[at + 3 : at + 3 + planes]))
            at += 3 + planes
        source.seek(docs_at)
        packed = source.read(index_at - docs_at)
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.documents = pa.ipc.open_stream(self.unpack(packed)).read_all()

    def read_block(self, number: int) -> np.ndarray:
        n, offset, sizes = self.index[number]
        self.source.seek(offset)
        raw = self.source.read(sum(sizes))
        planes, at = [], 0
        for size in sizes:
            planes.append(self.unpack(raw[at : at + size]))
            at += size
        return from_planes(planes, n, self.bits)

    def texts(self) -> Iterator[np.ndarray]:
        """Ids of each document in turn; holds one block and one document."""
        rest, block = np.zeros(0, dtype=np.uint32), 0
        for n in self.documents.column("n").to_pylist():
            parts, have = [rest], len(rest)
            while have < n:
                parts.append(self.read_block(block))
                have += len(parts[-1])
                block += 1
            flat = np.concatenate(parts) if len(parts) > 1 else rest
            yield flat[:n]
            rest = flat[n:]


#: Kinds of characters in the pattern of pre-tokens.
WHITE, LETTER, DIGIT = 1, 2, 3


@functools.cache
def character_kinds() -> np.ndarray:
    """``WHITE``, ``LETTER``, ``DIGIT`` or 0 for each code point."""
    kinds = np.zeros(0x110000, dtype=np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((WHITE, r"\s+"), (LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            kinds[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    kinds[0xD800:0xE000] = 0
    return kinds


def piece_starts(codes: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pieces that encode by themselves begin, in texts end to end that begin at ``firsts``.

    Borders of pre-tokens, all but those between an apostrophe and a letter, where contractions may be. A blank
    opens the piece of the visible sign behind it; of more white space before a visible sign, the last is apart.
    """
    kinds = character_kinds()[codes]
    before, here = kinds[:-1], kinds[1:]
    starts = np.zeros(len(codes) + 1, dtype=bool)
    starts[1:-1] = (before != here) & (codes[:-1] != 32) & ~((codes[:-1] == 39) & (here == LETTER))
    starts[firsts] = starts[-1] = True
    last = np.flatnonzero((before == WHITE) & (here == WHITE)) + 1
    last = last[last + 1 < len(codes)]
    last = last[kinds[last + 1] != WHITE]
    last = last[~np.isin(last + 1, firsts)]
    starts[last] = True
    return np.flatnonzero(starts[:-1])


class Encoder:
    """Ids of whole texts by the tokenizers library; what was encoded before is looked up.

    Texts are cut into pieces that encode by themselves, in numpy, and equal pieces are told by two 64-bit hashes.
    New pieces go to the library many in one text: none crosses the blank or line end in front of the next, and
    the bytes of the ids tell them apart again. The stretch around a special token goes there whole.
    """

    #: Pieces kept, and four times as many ids.
    KEPT = 1 << 20
    #: Pieces in one text.
    JOINED = 1000
    #: Characters cut at a time.
    BLOCK = 1_000_000

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.id_bytes = np.zeros(self.tokenizer.get_vocab_size(), dtype=np.int64)  # byte-level: a letter for a byte
        for token, number in self.tokenizer.get_vocab().items():
            self.id_bytes[number] = len(token)
        self.table = RunTable(self.KEPT.bit_length())
        self.runs = Runs()

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, end to end, and how many each has."""
        opening, white = codes[starts], character_kinds()[codes[starts + sizes - 1]] == WHITE
        out: list[np.ndarray | None] = [None] * -(-len(starts) // self.JOINED)
        counts = np.zeros(len(starts), dtype=np.int64)
        texts, places = [], []
        for at in range(0, len(starts), self.JOINED):
            part = slice(at, min(at + self.JOINED, len(starts)))
            if white[part].any():
                continue
            # a line end goes in front of pieces without a blank
            apart = (opening[part] != 32).astype(np.int64)
            lengths = sizes[part] + apart
            ends = np.cumsum(lengths)
            text = codes[np.repeat(starts[part] - apart - (ends - lengths), lengths) + np.arange(ends[-1])]
            text[(ends - lengths)[apart > 0]] = 10
            width = np.cumsum(1 + (text >= 0x80).astype(np.int64) + (text >= 0x800) + (text >= 0x10000))
            texts.append(text.tobytes().decode("utf-32-le"))
            places.append((at // self.JOINED, width[ends - lengths + apart - 1] * ((ends - lengths + apart) > 0), width[ends - 1]))
        for (k, begins, ends), ids in zip(places, self._library(texts), strict=True):
            have = np.concatenate([[0], np.cumsum(self.id_bytes[ids])])
            first, last = (np.minimum(np.searchsorted(have, x), len(ids)) for x in (begins, ends))
            if (have[first] == begins).all() and (have[last] == ends).all():
                n = counts[k * self.JOINED : (k + 1) * self.JOINED] = last - first
                out[k] = ids[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        for k in [k for k, ids in enumerate(out) if ids is None]:  # white space, or the ids do not spell the bytes
            part = slice(k * self.JOINED, (k + 1) * self.JOINED)
            alone = [codes[a : a + n].tobytes().decode("utf-32-le") for a, n in zip(starts[part].tolist(), sizes[part].tolist(), strict=True)]
            ids = self._library(alone)
            counts[part] = [len(x) for x in ids]
            out[k] = np.concatenate(ids)
        return np.concatenate(out), counts

    def _block(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens, none empty."""
        if self.runs.count > self.KEPT or self.runs.used > 4 * self.KEPT:
            self.runs = Runs()
            self.table.clear()
        codes = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4")
        firsts = np.cumsum([0, *map(len, texts[:-1])])
        starts = piece_starts(codes, firsts)
        ends = np.append(starts[1:], len(codes))
        numbers, new, one, kind, keys = self.table.looked_up(codes, starts, ends)
        if len(one):
            sizes = ends[one] - starts[one]
            # white space goes to the library piece by piece, so it comes together
            order = np.argsort(character_kinds()[codes[ends[one] - 1]] != WHITE, kind="stable")
            made = np.empty(len(one), dtype=np.int32)
            made[order] = self.runs.count + np.arange(len(one))
            self.runs.add(*self._encode(codes, starts[one][order], sizes[order]))
            numbers[new] = made[kind]
            self.table.put(keys, sizes, made)
        ids, counts = self.runs.of(numbers)
        total = np.cumsum(counts)
        return np.split(ids.view(np.uint32), total[np.searchsorted(starts, firsts[1:]) - 1])

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        """A text in parts that encode by themselves, not much longer than ``BLOCK``, and whether one may hold special tokens."""
        if any(s in text for s in self.special):
            for k, cut in enumerate(stretches(text)):
                part = f" {cut}" if k else cut
                yield part, any(s in part for s in self.special)
            return
        at = 0
        while len(text) - at > self.BLOCK and (cut := SINGLE_SPACE.search(text, at + self.BLOCK)):
            yield text[at : cut.start()], False
            at = cut.start()
        yield text[at:], False

    def __call__(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        waiting, held = [], 0

        def flush():
            for (k, place, _), ids in zip(waiting, self._block([part for _, _, part in waiting]) if waiting else [], strict=True):
                out[k][place] = ids
            waiting.clear()

        for k, text in enumerate(texts):
            for part, whole in self._parts(text or ""):
                if not part:
                    continue
                if whole:
                    out[k].append(self._library([part])[0].view(np.uint32))
                    continue
                if held + len(part) > self.BLOCK:
                    flush()
                    held = 0
                out[k].append(np.zeros(0, dtype=np.uint32))
                waiting.append((k, len(out[k]) - 1, part))
                held += len(part)
        flush()
        return [parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, dtype=np.uint32), *parts]) for parts in out]


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def write_token_files(
    documents: DataFrame,
    folder: str,
    id_column: str = "doc_id",
    text: str = "text",
    vocabulary: str = VOCABULARY,
    end_id: int | None = END_ID,
    block: int = BLOCK,
    bits: int = 1,
) -> DataFrame:
    """Encode all texts and write them below ``folder`` in ascending id order; the table of the files comes back.

    Its rows are ``part, file, n_docs, n_ids``: part numbers follow the order of the ids. Rows with equal ids
    are ordered by a hash of their text; null ids come first; a null text is empty. ``end_id`` ends each
    document. A task writes its file under a name of its own and only the files of tasks that succeeded are
    in the table, so a lost executor leaves at most a file that nobody reads. ``folder`` is any location that
    pyarrow can open (a local path, ``file://``, ``hdfs://``, ``s3://`` …) and all executors share.
    """
    files = pieces_of(text_bytes(documents, text), FILE_BYTES, least=8)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange(files, "id", tie).sortWithinPartitions("id", tie)

    def write(batches: Batches) -> Batches:
        encoder = kept_in_worker(("encoder", vocabulary), lambda: Encoder(vocabulary))
        part = TaskContext.get().partitionId()
        writer, n_docs, n_ids = None, 0, 0
        for batch in (piece for whole in batches for piece in bounded_slices(whole, "text")):
            if writer is None:
                system, base = _opened(folder)
                system.create_dir(base, recursive=True)
                name = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                out = system.open_output_stream(f"{base}/{name}")
                writer = PlaneWriter(out, block, bits)
                schema = pa.schema([("doc", batch.column("id").type), ("n", pa.int64())])
            ids = encoder(batch.column("text").to_pylist())
            if end_id is not None:
                ids = [np.append(x, np.uint32(end_id)) for x in ids]
            writer.add(batch.column("id"), ids)
            n_docs, n_ids = n_docs + len(ids), n_ids + sum(map(len, ids))
        if writer is not None:
            writer.close(schema)
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [f"{folder}/{name}"], "n_docs": [n_docs], "n_ids": [n_ids]}
            )

    return cut_lineage(ordered.mapInArrow(write, "part int, file string, n_docs long, n_ids long"))


def read_token_files(files: DataFrame, id_type: T.DataType, id_column: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """``id, start, n_tokens, ids_crc32, ids`` per document, read back from the files of a table of files.

    ``start`` is the number of ids of all documents before it; ``ids_crc32`` the unsigned CRC-32 of its ids as
    little-endian 32-bit integers; ``ids`` is null unless asked for.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = cut_lineage(files.withColumn("before", F.coalesce(before, F.lit(0)).cast("long")))
    count = max(1, placed.count())
    schema = T.StructType([T.StructField("id", id_type), *T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long, ids array<long>").fields])

    def read(batches: Batches) -> Batches:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist(), strict=True):
                system, path = _opened(uri)
                with system.open_input_file(path) as source:
                    reader = PlaneReader(source)
                    rows, held, done = [], 0, 0
                    for ids in reader.texts():
                        raw = ids.astype("<u4").tobytes()
                        rows.append((start, len(ids), zlib.crc32(raw), ids.astype(np.int64) if with_ids else None))
                        start, held = start + len(ids), held + len(ids)
                        if len(rows) == 4096 or with_ids and held > 1 << 20:
                            yield _rows(reader, done, rows)
                            done, held, rows = done + len(rows), 0, []
                    if rows:
                        yield _rows(reader, done, rows)

    spread = placed.repartition(count, "part").select("file", "before")
    return spread.mapInArrow(read, schema).withColumnRenamed("id", id_column)


def _rows(reader: PlaneReader, first: int, rows: list[tuple]) -> pa.RecordBatch:
    names = reader.documents.column("doc").slice(first, len(rows)).combine_chunks()
    names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
    starts, sizes, sums, ids = zip(*rows, strict=True)
    kind = pa.list_(pa.int64())
    columns = [names, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(ids, kind)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "start", "n_tokens", "ids_crc32", "ids"])


@query("op7_token_planes")
def op7(spark, folder):
    documents = table(spark, folder, "documents")
    files = write_token_files(documents, new_folder(spark))
    back = read_token_files(files, documents.schema["doc_id"].dataType, with_ids=False)
    return back.select("doc_id", "start", "n_tokens", "ids_crc32")
