"""SentencePiece BPE with seeded merge dropout: varied segmentations that decode to the same text.

Merges wait in an agenda, best score first and leftmost among equals, as in plain BPE. With dropout, a merge
that comes up is skipped with the probability of the rate. Texts are cut into words and other runs first
(blanks go with what follows), which no piece crosses. Each occurrence of a word has its own skips, from a keyed
hash of the seed, the text and the place in it: the hash says how many merges pass before the next one skipped,
so that a segmentation is kept by the numbers of its skipped merges and found again without being made.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import pairwise
import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.bpe import tokenizer_path
from palimpsest.llm.common import Batches, Runs, different_runs, kept_in_worker, list_array, map_texts
from palimpsest.llm.registry import query, table

MODEL = "piece_bpe_32k.model"
DROPOUT = 0.1
#: So many segmentations of a word at most; 0 means that each occurrence draws its own.
DRAWS = 0
SEED = 1
#: Text bytes that are cut and merged at once, about.
BATCH = 250_000
#: The sign SentencePiece writes for a blank.
BLANK = "▁"
#: Letters, or anything else, with the blanks before; a piece that mixes letters and others is refused.
WORDS = regex.compile(r" *\p{L}+| *[^ \p{L}]+| +")


#: Marks a place whose letter went into the piece before.
GONE = -2
#: Words of so many characters are searched for each merge.
SHORT = 32
#: The part of a character without a piece is this less its code point.
ODD = -16
#: Rank of no merge.
NEVER = 1 << 30
ALL_BITS = (1 << 64) - 1


def mixed(x):
    """A well-mixed 64-bit hash (the end of SplitMix64) of an unsigned number, or of each of an array."""
    big = isinstance(x, np.ndarray)
    first, second = (np.uint64(c) if big else c for c in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
    x = (x ^ x >> 30) * first if big else (x ^ x >> 30) * first & ALL_BITS
    x = (x ^ x >> 27) * second if big else (x ^ x >> 27) * second & ALL_BITS
    return x ^ x >> 31


class Gaps:
    """How many merges pass before the next skipped one, by 16 bits of a hash: geometric, as if each were tossed for."""

    def __init__(self, dropout: float):
        self.none = dropout <= 0
        if not self.none:
            u = (np.arange(1 << 16) + 0.5) / (1 << 16)
            gaps = np.zeros(len(u)) if dropout >= 1 else np.floor(np.log(u) / np.log1p(-dropout))
            self.table = np.minimum(gaps, 1 << 30).astype(np.int64)
            self.list = self.table.tolist()

    def skips(self, key: int):
        """Numbers of the skipped merges of a key, a hash of 64 bits, without end."""
        at = -1
        while True:
            bits = key
            for _ in range(4):
                at += self.list[bits & 0xFFFF] + 1
                yield at
                bits >>= 16
            key = mixed(key + 0x9E3779B97F4A7C15 & ALL_BITS)


class Pieces:
    """Vocabulary, merge scores and byte pieces of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.bytes_ids: dict[int, int] = {}
        self.raw: list[bytes] = []
        for number in range(model.get_piece_size()):
            piece = model.id_to_piece(number)
            if model.is_byte(number):
                value = int(piece[3:5], 16)
                self.bytes_ids[value] = number
                self.raw.append(bytes([value]))
            elif model.is_control(number) or model.is_unknown(number) or model.is_unused(number):
                self.raw.append(b"")
            else:
                plain = piece.replace(BLANK, " ")
                if len(WORDS.findall(plain)) != 1:
                    raise ValueError(f"words cannot be cut inside the piece {plain!r}")
                self.ids[plain] = number
                scores[plain] = model.get_score(number)
                self.raw.append(plain.encode())
        if len(self.bytes_ids) != 256:
            raise ValueError("the model has no byte fallback, so unknown characters would be lost")
        ordered = sorted(scores, key=lambda p: -scores[p])
        #: Rank of the merge of two pieces by their ids (20 bits each), and the id of what each rank makes.
        self.ranks: dict[int, int] = {}
        self.wholes = [self.ids[p] for p in ordered]
        for rank, piece in enumerate(ordered):
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    self.ranks[left << 20 | right] = rank
        self.letters = {piece: number for piece, number in self.ids.items() if len(piece) == 1}
        self.opening = " " if model.id_to_piece(model.encode("a")[0]) == BLANK + "a" else ""

    def segment(self, word: str, dropout: float = 0.0, seed: int = SEED, draw: int = 0) -> list[int]:
        """Ids of one word."""
        gaps = Gaps(dropout)
        return self.merged(word, None if gaps.none else gaps.skips(xxhash.xxh64_intdigest(f"{draw} {word}", seed)))[0]

    def merged(self, word: str, skips=None) -> tuple[list[int], list[int], int]:
        """Ids of one word, the numbers of the merges skipped, and how many came up; ``skips`` says which to skip.

        An entry of the agenda is one number, the rank of the merge and its place; it is stale where another
        merge, or none, is due at the place by then. Short words are searched for the best merge instead.
        """
        if len(word) <= SHORT:
            return self._merged_short(word, skips)
        ranks, wholes, push = self.ranks.get, self.wholes, heapq.heappush
        n = len(word)
        part = [self.letters.get(c, -1) for c in word]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        due = [ranks(a << 20 | b, -1) for a, b in pairwise(part)]
        due.append(-1)
        agenda = [rank << 32 | i for i, rank in enumerate(due) if rank >= 0]
        heapq.heapify(agenda)
        count, skipped = -1, []
        skip = next(skips) if skips else -1
        while agenda:
            entry = heapq.heappop(agenda)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            if due[i] != rank:
                continue
            due[i] = -1
            count += 1
            if count == skip:
                skipped.append(skip)
                skip = next(skips)
                continue
            j = after[i]
            whole = part[i] = wholes[rank]
            part[j], due[j] = GONE, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = ranks(whole << 20 | part[k], -1)
                if rank >= 0:
                    due[i] = rank
                    push(agenda, rank << 32 | i)
            h = before[i]
            if h >= 0:
                rank = due[h] = ranks(part[h] << 20 | whole, -1)
                if rank >= 0:
                    push(agenda, rank << 32 | h)
        if -1 not in part:
            return [p for p in part if p != GONE], skipped, count + 1
        out: list[int] = []
        for p, c in zip(part, word, strict=True):
            if p >= 0:
                out.append(p)
            elif p == -1:
                out += [self.bytes_ids[b] for b in c.encode()]
        return out, skipped, count + 1

    def _merged_short(self, word: str, skips) -> tuple[list[int], list[int], int]:
        """What ``merged`` gives, without an agenda."""
        get, wholes = self.ranks.get, self.wholes
        part = [*map(self.letters.get, word)]
        odd = None in part
        if odd:  # an own number below 0 for each place without a piece
            part = [-1 - i if p is None else p for i, p in enumerate(part)]
        due = [get(a << 20 | b, NEVER) for a, b in pairwise(part)]
        due.append(NEVER)
        count, skipped = 0, []
        skip = next(skips) if skips else -1
        while (rank := min(due)) != NEVER:
            i = due.index(rank)
            if count == skip:
                skipped.append(skip)
                skip = next(skips)
                due[i] = NEVER
            else:
                whole = part[i] = wholes[rank]
                del part[i + 1], due[i]
                due[i] = get(whole << 20 | part[i + 1], NEVER) if i + 1 < len(part) else NEVER
                if i:
                    due[i - 1] = get(part[i - 1] << 20 | whole, NEVER)
            count += 1
        if odd:
            part = [q for p in part for q in ([p] if p >= 0 else [self.bytes_ids[b] for b in word[-1 - p].encode()])]
        return part, skipped, count

    def decode(self, ids) -> str:
        """Text of ids; the blank that encoding puts in front goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[len(self.opening) :] if text.startswith(self.opening) else text


class PairRanks:
    """Ranks of merges by pair of pieces, looked up for whole arrays: a table of slots, an eighth of them taken at most.

    A slot holds the pair (40 bits) and its rank (20 bits); a taken slot sends a pair on to the next one.
    """

    FREE = -(1 << 62)

    def __init__(self, ranks: dict[int, int]):
        bits = (8 * len(ranks)).bit_length()
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, self.FREE, dtype=np.int64)
        pairs = np.fromiter(ranks, dtype=np.int64, count=len(ranks))
        for pair, rank, slot in zip(pairs.tolist(), ranks.values(), self._first(pairs).tolist(), strict=True):
            while self.slots[slot] != self.FREE:
                slot = slot + 1 & self.last
            self.slots[slot] = pair << 20 | rank

    def _first(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def __call__(self, pairs: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NEVER`` for those without a merge, and where a part is below 0."""
        slot = self._first(pairs)
        found = self.slots[slot]
        ranks = np.where(found >> 20 == pairs, found & 0xFFFFF, NEVER)
        other = np.flatnonzero((found >> 20 != pairs) & (found != self.FREE))
        while len(other):
            slot[other] = slot[other] + 1 & self.last
            found = self.slots[slot[other]]
            same = found >> 20 == pairs[other]
            ranks[other[same]] = found[same] & 0xFFFFF
            other = other[~same & (found != self.FREE)]
        return ranks


class Skips:
    """The number of the next merge to skip for each of many keys; the sequences are those of ``Gaps.skips``."""

    def __init__(self, gaps: Gaps, keys: np.ndarray):
        self.gaps, self.keys, self.bits = gaps.table, keys.copy(), keys.copy()
        self.drawn = np.zeros(len(keys), dtype=np.int8)
        self.next = self.gaps[(keys & np.uint64(0xFFFF)).astype(np.int64)]

    def advance(self, rows: np.ndarray) -> None:
        self.drawn[rows] += 1
        self.bits[rows] >>= np.uint64(16)
        anew = rows[self.drawn[rows] == 4]
        self.drawn[anew] = 0
        self.bits[anew] = self.keys[anew] = mixed(self.keys[anew] + np.uint64(0x9E3779B97F4A7C15))
        self.next[rows] += self.gaps[(self.bits[rows] & np.uint64(0xFFFF)).astype(np.int64)] + 1


class Segmenter:
    """Segmentations of whole texts, block by block: the merges of all words of a block are made together, in numpy.

    The different words of a block are told apart by two hashes and merged once without skips, which also tells
    how many merges come up; occurrences whose first skipped merge comes before that are merged anew, each with its
    own skips. Words of more than ``LONGEST`` characters are merged one by one. Nothing is kept between calls.
    """

    LONGEST = 64
    #: Characters of a block; a longer word stands alone.
    BLOCK = 1 << 19
    #: Characters of words that are merged together.
    TOGETHER = 1 << 16

    def __init__(self, path: str, dropout: float, seed: int, draws: int = DRAWS):
        self.pieces = Pieces(path)
        self.gaps, self.seed, self.draws = Gaps(dropout), seed, draws
        self.ranks = PairRanks(self.pieces.ranks)
        self.wholes = np.array(self.pieces.wholes, dtype=np.int64)
        #: For each character: 0 other, 1 letter, 2 blank; and its piece, or a number below ``ODD`` for none.
        self.kinds = np.zeros(0x110000, dtype=np.uint8)
        for found in regex.finditer(r"\p{L}+", "".join(map(chr, range(0x110000)))):
            self.kinds[found.start() : found.end()] = 1
        self.kinds[32] = 2
        self.parts = ODD - np.arange(0x110000, dtype=np.int32)
        for letter, number in self.pieces.letters.items():
            self.parts[ord(letter)] = number
        self.raw_sizes = np.array([len(r) for r in self.pieces.raw], dtype=np.int64)

    def __call__(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the offsets of the texts in them."""
        full = [self.pieces.opening + t if t else "" for t in texts]
        joined = "".join(full)
        ends = np.cumsum([len(t) for t in full], dtype=np.int64)
        if not joined:
            return np.zeros(0, dtype=np.int32), np.zeros(len(texts) + 1, dtype=np.int64)
        signs = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        kinds = self.kinds[signs]
        first = np.ones(len(signs), dtype=bool)  # of a word: blanks go with what follows
        np.logical_and(kinds[1:] != kinds[:-1], kinds[:-1] != 2, out=first[1:])
        first[ends[ends < len(signs)]] = True
        starts = np.append(np.flatnonzero(first), len(signs))
        del kinds, first
        words = np.searchsorted(starts, ends)  # of all texts up to each
        keys = self._keys(texts, np.diff(words, prepend=0), joined, starts)
        out, sizes, at = [], [], 0
        while at < len(starts) - 1:
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + self.BLOCK, "right")) - 1)
            block = signs[starts[at] : starts[to]]
            ids, each = self._block(block, starts[at : to + 1] - starts[at], None if keys is None else keys[at:to])
            out.append(ids)
            sizes.append(each)
            at = to
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return np.concatenate(out), np.concatenate([[0], before[words]])

    def _keys(self, texts: list[str | None], counts: np.ndarray, joined: str, starts: np.ndarray) -> np.ndarray | None:
        """A key for each occurrence of a word, from its text and its place in it."""
        if self.gaps.none:
            return None
        seeds = np.array([xxhash.xxh64_intdigest(t or "", self.seed) for t in texts], dtype=np.uint64)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        keys = mixed(np.repeat(seeds, counts) + place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        if self.draws:
            words = [joined[a:b] for a, b in pairwise(starts.tolist())]
            dealt = (keys % np.uint64(self.draws)).tolist()
            keys = np.array([xxhash.xxh64_intdigest(f"{d} {w}", self.seed) for w, d in zip(words, dealt, strict=True)], dtype=np.uint64)
        return keys

    def _block(self, signs: np.ndarray, starts: np.ndarray, keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of a block, end to end, and how many each has."""
        lengths = np.diff(starts)
        short = np.flatnonzero(lengths <= self.LONGEST)
        one, which = different_runs(signs, starts[short], starts[short + 1])
        pool = Runs()
        parts = self.parts[signs]
        due = np.full(len(signs), NEVER, dtype=np.int64)
        due[:-1] = self.ranks(parts[:-1].astype(np.int64) << 20 | parts[1:])
        due[starts[1:] - 1] = NEVER
        merges = self._merge(parts, due, starts[short[one]], lengths[short[one]], None, pool)
        numbers = np.zeros(len(lengths), dtype=np.int64)
        numbers[short] = which
        if keys is not None:
            skip = self.gaps.table[(keys[short] & np.uint64(0xFFFF)).astype(np.int64)]
            varied = short[skip < merges[which]]
            numbers[varied] = pool.count + np.arange(len(varied))
            self._merge(parts, due, starts[varied], lengths[varied], keys[varied], pool)
        for k in np.flatnonzero(lengths > self.LONGEST).tolist():
            word = signs[starts[k] : starts[k + 1]].tobytes().decode("utf-32-le")
            ids = self.pieces.merged(word, None if keys is None else self.gaps.skips(int(keys[k])))[0]
            numbers[k] = pool.count
            pool.add(np.array(ids, dtype=np.int32), np.array([len(ids)]))
        return self._spelled(*pool.of(numbers))

    def _merge(
        self, parts: np.ndarray, due: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None, pool: Runs
    ) -> np.ndarray:
        """How many merges come up in each word; the pieces go to the pool in the order of the words."""
        order = np.argsort(lengths, kind="stable")
        counts = np.zeros(len(starts), dtype=np.int64)
        sizes, found, at = np.zeros(len(starts), dtype=np.int64), Runs(), 0
        while at < len(order):
            to = min(len(order), at + max(1, self.TOGETHER // int(lengths[order[at]])))
            while to > at + 1 and int(lengths[order[to - 1]]) * (to - at) > 2 * self.TOGETHER:
                to = at + (to - at) // 2
            rows = order[at:to]
            ids, sizes[rows], counts[rows] = self._merge_together(parts, due, starts[rows], lengths[rows], None if keys is None else keys[rows])
            found.add(ids, sizes[rows])
            at = to
        back = np.empty(len(order), dtype=np.int64)
        back[order] = np.arange(len(order))
        pool.add(*found.of(back))
        return counts

    def _merge_together(self, parts, due, starts, lengths, keys) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of words end to end, how many each has, and how many merges came up: ``Pieces.merged`` for many words.

        A column is a word, a row a place in it; the last row stands for what is before the first place and behind
        the last. What is due is the rank of the merge and its place in one number, so the lowest comes up first.
        """
        n, wide = len(starts), int(lengths.max())
        place = np.arange(wide, dtype=np.int64)[:, None]
        inside = place < lengths
        at = np.where(inside, starts + place, 0)
        part = np.full((wide + 1, n), -1, dtype=np.int64)
        part[:wide] = np.where(inside, parts[at], GONE)
        rank = np.where(inside, due[at], NEVER)
        agenda = np.full((wide + 1, n), NEVER, dtype=np.int32)
        agenda[:wide] = np.where(rank < NEVER, rank << 6 | place, NEVER)
        after = np.full((wide + 1, n), wide, dtype=np.int64)
        after[:wide] = np.where(place + 1 < lengths, place + 1, wide)
        before = np.full((wide + 1, n), wide, dtype=np.int64)
        before[1:wide] = place[:-1]
        flat_part, flat_agenda, flat_after, flat_before = part.ravel(), agenda.ravel(), after.ravel(), before.ravel()
        counts = np.zeros(n, dtype=np.int64)
        skips = None if keys is None else Skips(self.gaps, keys)
        while True:
            low = agenda[:wide].min(axis=0)
            word = np.flatnonzero(low < NEVER)
            if not len(word):
                break
            entry = low[word].astype(np.int64)
            if skips is not None:
                skipped = counts[word] == skips.next[word]
                counts[word] += 1
                if skipped.any():
                    gone = word[skipped]
                    flat_agenda[(entry[skipped] & 63) * n + gone] = NEVER
                    skips.advance(gone)
                    word, entry = word[~skipped], entry[~skipped]
            else:
                counts[word] += 1
            here, whole = entry & 63, self.wholes[entry >> 6]
            i = here * n + word
            j = flat_after[i] * n + word
            behind, ahead = flat_after[j], flat_before[i]
            k, h = behind * n + word, ahead * n + word
            flat_part[i], flat_part[j], flat_agenda[j] = whole, GONE, NEVER
            flat_after[i], flat_before[k] = behind, here
            rank = self.ranks(np.concatenate([whole << 20 | flat_part[k], flat_part[h] << 20 | whole]))
            rank = np.where(rank < NEVER, rank << 6 | np.concatenate([here, ahead]), NEVER)
            flat_agenda[i], flat_agenda[h] = rank[: len(i)], rank[len(i) :]
        ids = part[:wide].T
        left = ids != GONE
        return ids[left].astype(np.int32), left.sum(axis=1), counts

    def _spelled(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids with characters that have no piece spelled in bytes, and how many ids each word has then."""
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids, sizes
        signs, which = np.unique(ODD - ids[odd], return_inverse=True)
        spelled = [[self.pieces.bytes_ids[b] for b in chr(c).encode()] for c in signs.tolist()]
        runs = Runs()
        runs.add(np.array([b for x in spelled for b in x], dtype=np.int32), np.array([len(x) for x in spelled]))
        flat, each = runs.of(which)
        width = np.ones(len(ids), dtype=np.int64)
        width[odd] = each
        out = np.repeat(ids, width)
        out[out < 0] = flat
        total = np.concatenate([[0], np.cumsum(width)])
        ends = np.cumsum(sizes)
        return out, total[ends] - total[ends - sizes]

    def lossless(self, texts: list[str | None], ids: np.ndarray, offsets: np.ndarray) -> list[bool]:
        """Whether the ids of each text decode to it; a null text counts as empty."""
        flat = b"".join(map(self.pieces.raw.__getitem__, ids.tolist()))
        ends = np.concatenate([[0], np.cumsum(self.raw_sizes[ids])])[offsets].tolist()
        out = []
        for k, (text, (a, b)) in enumerate(zip(texts, pairwise(ends), strict=True)):
            same = flat[a:b] == ((self.pieces.opening + text).encode() if text else b"")
            out.append(same or self.pieces.decode(ids[offsets[k] : offsets[k + 1]].tolist()) == (text or ""))
        return out


def encode_pieces(
    df: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
    draws: int = DRAWS,
) -> DataFrame:
    """``id, ids`` per row: the piece ids of the whole text.

    With ``dropout`` 0 they are those of plain BPE; otherwise ``seed`` fixes which merges are skipped, so equal
    texts get equal ids in a run and another seed gives other ones. Null and empty texts give an empty list.
    The sign that stands for a blank in pieces is spelled in bytes where a text has it, so decoding is exact.
    Rows are independent of each other; other columns are not read.
    """

    def encode(batches: Batches) -> Batches:
        segment = kept_in_worker(
            ("pieces", model, dropout, seed, draws), lambda: Segmenter(tokenizer_path(model), dropout, seed, draws)
        )
        for batch in batches:
            flat, offsets = segment.many(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), list_array(flat, offsets, pa.int32())], names=["id", "ids"])

    return map_texts(df, id_column, text, encode, "ids array<int>", keeps=True, limit=BATCH)


def decode_pieces(df: DataFrame, id_column: str = "doc_id", ids: str = "ids", model: str = MODEL) -> DataFrame:
    """``id, text`` per row; a null or empty list gives an empty text."""
    rows = df.select(F.col(id_column).alias("id"), F.col(ids).alias("ids"))
    schema = rows.select("id", F.lit("").alias("text")).schema

    def decode(batches: Batches) -> Batches:
        pieces = kept_in_worker(("piece table", model), lambda: Pieces(tokenizer_path(model)))
        for batch in batches:
            lists = batch.column("ids")
            flat, ends = lists.flatten().to_pylist(), np.cumsum(pa.compute.list_value_length(lists).fill_null(0)).tolist()
            texts = [pieces.decode(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=["id", "text"])

    return rows.mapInArrow(decode, schema).withColumnRenamed("id", id_column)


def round_trip(
    documents: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
    draws: int = DRAWS,
    with_ids: bool = True,
) -> DataFrame:
    """``id, n_pieces, ids_crc32, lossless, ids``: each text encoded as by ``encode_pieces``, and decoded again in the same task.

    ``ids_crc32`` is the unsigned CRC-32 of the ids as little-endian 32-bit integers; ``lossless`` tells whether
    they decode to the text (a null text counts as empty); ``ids`` is null unless asked for.
    """

    def both(batches: Batches) -> Batches:
        segment = kept_in_worker(
            ("pieces", model, dropout, seed, draws), lambda: Segmenter(tokenizer_path(model), dropout, seed, draws)
        )
        for batch in batches:
            texts = batch.column("text").to_pylist()
            ids, offsets = segment.many(texts)
            same = segment.lossless(texts, ids, offsets)
            raw = memoryview(ids.astype("<u4").tobytes())
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in pairwise(offsets.tolist())]
            lists = list_array(ids, offsets, pa.int32()) if with_ids else pa.nulls(len(texts), pa.list_(pa.int32()))
            columns = [batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64()), pa.array(same, pa.bool_()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_pieces", "ids_crc32", "lossless", "ids"])

    added = "n_pieces long, ids_crc32 long, lossless boolean, ids array<int>"
    return map_texts(documents, id_column, text, both, added, keeps=True, limit=BATCH)


@query("op4_sentencepiece")
def op4(spark, folder):
    return round_trip(table(spark, folder, "documents"), with_ids=False).drop("ids")
