"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The field tags tokens as the begin of a secret, inside one, or outside. Its features are a token's shape and the
token itself, those of the three tokens before and the one behind, and shares of the whole file; learned
transitions between tags join in. It learns from what the patterns find in a bounded sample of the texts, and
every text is decoded by Viterbi. A token whose score for outside exceeds its others by more than any transitions
can give back is outside on the best path, so the search runs over the stretches between such tokens, with the
same result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.common import Batches, Runs, Slots, grown, map_texts
from palimpsest.llm.language import forward_backward
from palimpsest.llm.registry import query, table

#: The patterns, in the order of their kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
LEAST_ASSIGNED, LEAST_ACCESS = 6, 20
KINDS = ("assign", "access", "hex", "model")

#: A character of white space goes with the word or sign behind it, or stands alone: tokens tile a text, and each
#: blank begins one.
TOKEN = re.compile(r"\s?(?:[^\W_]+|[^\w\s]|_)|\s")
OUTSIDE, BEGIN, INSIDE = range(3)
BUCKETS = 1 << 16
#: Documents a fit draws, and windows of tokens it takes from them with and without a secret, at most.
DRAWN, WITH_SECRET, WITHOUT = 20_000, 1_000, 2_000
#: Windows around secrets that one document offers (and one anywhere), and tokens to each side of a window's middle.
OFFERED, REACH = 4, 20
EPOCHS = 4
RATE = 0.3
#: Share of features left out at each training step, so that no single one carries a tag.
LEFT_OUT = 0.4
#: Own features, then those for the first, second and third token behind and for the token before.
ROLES = 5


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """``start, stop, kind, secret`` of what the patterns match; ``secret`` is where the secret itself starts.

    Matches of a kind are leftmost and do not overlap; those too short are dropped afterwards. In order of start,
    then kind.
    """
    found = []
    low = text.lower()
    if any(word in low for word in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= LEAST_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return [(a, b, KINDS[k], s) for a, b, k, s in sorted(found, key=lambda x: (x[0], x[2]))]


#: Bucket of a length: single up to 8, then by quarters of a doubling; the last holds all beyond.
LENGTHS = [*range(9), *(min(40, int(8 + 4 * math.log2(n / 8))) for n in range(9, 2049))]


def _length(n: int) -> int:
    return LENGTHS[n] if n < len(LENGTHS) else LENGTHS[-1]


def _kinds_of_letters(word: str) -> tuple[int, int, str]:
    """Which of lower, upper, digit and other letters a word has, how often the kind changes, and the first kinds."""
    kinds = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" for c in word]
    runs = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
    return sum(1 << i for i, k in enumerate("aA0x") if k in runs), len(runs) - 1, "".join(runs[:6])


def describe(token: str) -> tuple[str, str, list[str], int]:
    """Name and shape of a token, further features of its own, and 1 if it is neither a word nor a sign.

    A word's name is itself in lower case; anything longer or with digits goes by its shape.
    """
    core = token.strip()
    gap = "g0" if len(core) == len(token) else "g2" if "\n" in token[: len(token) - len(core)] else "g1"
    if len(core) <= 15 and core.isalpha():
        case = 0 if core.islower() else 1 if core.isupper() else 2 if core[1:].islower() else 3
        return core.lower(), f"a{case}{_length(len(core))}", [gap], 0
    if len(core) <= 1:
        return core, "s", [gap], int(core.isdigit())
    mask, changes, head = _kinds_of_letters(core)
    shape = f"m{mask}:{_length(len(core))}"
    low_hex = not core.strip("0123456789abcdef")
    return shape, f"m{mask}", [gap, f"c{mask}:{_length(changes)}", f"h{head}", f"x{low_hex}:{_length(len(core))}"], 1


def _hashes(names: Iterable[str], count: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(n.encode()) for n in names), dtype=np.uint64, count=count)


def _slots(hashes: np.ndarray, role: int) -> np.ndarray:
    """Bucket of each name in a role."""
    mixed = (hashes + np.uint64(role << 32)) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)


def file_features(sizes: np.ndarray, odd: np.ndarray) -> list[list[str]]:
    """Of each document, from its number of tokens and of those that are neither words nor signs."""
    size = np.log2(np.maximum(sizes, 1)).astype(np.int64)
    share = (20 * odd / np.maximum(sizes, 1)).astype(np.int64)
    return [[f"size{a}", f"odd{b}"] for a, b in zip(size.tolist(), share.tolist(), strict=True)]


class Model(NamedTuple):
    weights: np.ndarray
    transitions: np.ndarray


def _stretches(text: str) -> list[str]:
    """The text cut before each blank."""
    first, *rest = text.split(" ")
    return [*([first] if first else []), *[" " + s for s in rest]]


class TokenTable:
    """Scores of tokens by role and tag, a row each, kept while there are not too many. Row 0 scores nothing.

    Texts are cut at blanks; the tokens of a stretch are found once and its rows looked up afterwards.
    """

    #: Stretches and their characters that are kept.
    KEPT, CHARACTERS = 400_000, 16_000_000

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._clear()

    def _clear(self) -> None:
        self.tokens, self.stretches, self.runs = Slots(), Slots(), Runs()
        self.scores = np.zeros((1024, ROLES * 3), dtype=np.float32)
        self.odd = np.zeros(1024, dtype=np.int8)
        self.tokens[None] = self.characters = 0

    def _learn(self) -> None:
        """Rows of the stretches that are new, and scores of the new tokens in them."""
        new = self.stretches.taken()
        self.characters += sum(map(len, new))
        found = list(map(TOKEN.findall, new))
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        rows = map(self.tokens.__getitem__, chain.from_iterable(found))
        self.runs.add(np.fromiter(rows, dtype=np.int32, count=sizes.sum()), sizes)
        tokens = self.tokens.taken()
        at = len(self.tokens) - len(tokens)
        self.scores, self.odd = grown(self.scores, len(self.tokens)), grown(self.odd, len(self.tokens))
        for part in (tokens[k : k + 20_000] for k in range(0, len(tokens), 20_000)):
            names, shapes, more, odd = zip(*map(describe, part), strict=True)
            rows = slice(at, at + len(part))
            at += len(part)
            names, shapes = _hashes(names, len(odd)), _hashes(shapes, len(odd))
            for role in range(ROLES):
                self.scores[rows, 3 * role : 3 * role + 3] = self.weights[_slots(names, 2 * role)] + self.weights[_slots(shapes, 2 * role + 1)]
            sizes = np.fromiter(map(len, more), dtype=np.int64, count=len(more))
            extra = self.weights[_slots(_hashes(chain.from_iterable(more), sizes.sum()), 2 * ROLES)]
            self.scores[rows, :3] += np.add.reduceat(extra, np.cumsum(sizes) - sizes)
            self.odd[rows] = odd

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all tokens end to end, three times 0 behind each text, and the number of tokens by text."""
        if len(self.stretches) > self.KEPT or self.characters > self.CHARACTERS:
            self._clear()
        # the empty stretch stands for the end of a text: its run is the gap
        if not self.runs.count:
            self.stretches[""] = 0
            self.runs.add(np.zeros(3, dtype=np.int32), np.array([3]))
        cuts = [[*_stretches(t), ""] for t in texts]
        counts = np.fromiter(map(len, cuts), dtype=np.int64, count=len(cuts))
        slots = np.fromiter(map(self.stretches.__getitem__, chain.from_iterable(cuts)), dtype=np.int64, count=counts.sum())
        self._learn()
        rows, sizes = self.runs.of(slots)
        text = np.repeat(np.arange(len(texts)), counts)
        return rows, np.bincount(text, weights=sizes, minlength=len(texts)).astype(np.int64) - 3

    def emissions(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores of all tokens by tag, end to end without the gaps, with the first and last place of each text."""
        scores = self.scores
        out = scores[rows, :3].astype(np.float64)
        for role, shift in ((1, 1), (2, 2), (3, 3)):
            out[shift:] += scores[rows[:-shift], 3 * role : 3 * role + 3]
        out[:-1] += scores[rows[1:], 12:15]
        padded = sizes + 3
        odd = np.add.reduceat(self.odd[rows].astype(np.int64), np.cumsum(padded) - padded) if len(sizes) else sizes
        names = file_features(sizes, odd)
        slots = _slots(_hashes(chain.from_iterable(names), 2 * len(names)), 2 * ROLES + 1)
        file = self.weights[slots].astype(np.float64).reshape(-1, 2, 3).sum(axis=1)
        inside = np.ones(len(rows), dtype=bool)
        ends = np.cumsum(padded)
        for k in (1, 2, 3):
            inside[ends - k] = False
        out = out[inside] + np.repeat(file, sizes, axis=0)
        stop = np.cumsum(sizes)
        return out, stop - sizes, stop


def slack(transitions: np.ndarray) -> float:
    """The most that another tag than outside can win at one token by its transitions."""
    edge = np.zeros((1, 3))
    before = np.concatenate([transitions, edge])[:, :, None]
    behind = np.concatenate([transitions.T, edge]).T[None]
    both = before + behind
    return float((both.max(axis=1) - both[:, OUTSIDE]).max())


def viterbi(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """Best tags of chains that lie end to end; among equal paths the tags with lower numbers from the end on."""
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    first = (np.cumsum(sizes) - sizes)[order]
    tags, came = np.zeros(len(scores), dtype=np.int64), np.zeros((len(scores), 3), dtype=np.int8)
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")
    best = scores[first[: running[0]]] if steps else scores
    best = best.copy()
    for t in range(1, steps):
        at = first[: running[t]] + t
        ways = best[: running[t], :, None] + transitions[None]
        came[at] = ways.argmax(axis=1)
        best[: running[t]] = ways.max(axis=1) + scores[at]
    last = best.argmax(axis=1) if steps else np.zeros(0, dtype=np.int64)
    for t in range(steps - 1, -1, -1):
        n = running[t]
        at = first[:n] + t
        tags[at] = last[:n]
        last[:n] = came[at, last[:n]]
    return tags


def best_tags(scores: np.ndarray, starts: np.ndarray, stops: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that are not outside on the best path of their text, and their tags."""
    open_ = scores[:, OUTSIDE] - scores[:, OUTSIDE + 1 :].max(axis=1) <= slack(transitions)
    at = np.flatnonzero(open_)
    if not len(at):
        return at, at
    text = np.searchsorted(stops, at, side="right")
    fresh = np.append(True, (np.diff(at) > 1) | (np.diff(text) > 0))
    firsts = np.flatnonzero(fresh)
    sizes = np.diff(np.append(firsts, len(at)))
    chosen = scores[at].copy()
    lasts = firsts + sizes - 1
    after_outside = at[firsts] > starts[text[firsts]]
    chosen[firsts[after_outside]] += transitions[OUTSIDE]
    before_outside = at[lasts] < stops[text[lasts]] - 1
    chosen[lasts[before_outside]] += transitions[:, OUTSIDE]
    tags = viterbi(chosen, sizes, transitions)
    return at[tags != OUTSIDE], tags[tags != OUTSIDE]


# ---------------------------------------------------------------------------------------------
# fitting


def _tags_by_patterns(tokens: list[str], spans: list) -> np.ndarray:
    """Tags of the tokens of a text that overlap the secrets of its spans."""
    tags = np.zeros(len(tokens), dtype=np.int64)
    stops = np.cumsum([len(t) for t in tokens])
    for _, stop, _, secret in spans:
        a, b = np.searchsorted(stops, secret, side="right"), np.searchsorted(stops, stop, side="left")
        if not tags[a : b + 1].any():
            tags[a], tags[a + 1 : b + 1] = BEGIN, INSIDE
    return tags


def _windows(text: str, key: int) -> list[tuple]:
    """Up to ``OFFERED`` windows around secrets and one anywhere: whether it has a secret, tags, features."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    tags = _tags_by_patterns(tokens, base_spans(text))
    rng = np.random.default_rng(key & 0xFFFFFFFF)
    begun = np.flatnonzero(tags == BEGIN)
    middles = [*rng.permutation(begun)[:OFFERED].tolist(), int(rng.integers(len(tokens)))]
    known = lru_cache(maxsize=None)(describe)
    odd = sum(known(t)[3] for t in tokens)
    file = _hashes(file_features(np.array([len(tokens)]), np.array([odd]))[0], 2)
    out = []
    for middle in middles:
        a, b = max(0, middle - REACH), min(len(tokens), middle + REACH + 1)
        names, roles, sizes = [], [], []
        for i in range(a, b):
            held = len(names)
            for role, j in enumerate((i, i - 1, i - 2, i - 3, i + 1)):
                if 0 <= j < len(tokens):
                    name, shape, more, _ = known(tokens[j])
                    names += [name, shape, *([] if role else more)]
                    roles += [2 * role, 2 * role + 1, *([] if role else [2 * ROLES] * len(more))]
            sizes.append(len(names) - held + 2)
        hashes, slot = _hashes(names, len(names)), np.zeros(len(names), dtype=np.int64)
        for role in range(2 * ROLES + 1):
            own = np.array(roles) == role
            slot[own] = _slots(hashes[own], role)
        firsts = np.cumsum(np.array(sizes) - 2)[:-1]
        features = np.concatenate([x for part in np.split(slot, firsts) for x in (part, _slots(file, 2 * ROLES + 1))])
        out.append((bool(tags[a:b].any()), tags[a:b].tolist(), sizes, features.tolist()))
    return out


def fit(windows: list[tuple[list[int], list[int], list[int]]], seed: int = 3) -> Model:
    """Weights and transitions that maximise the likelihood of the tags of windows (Adagrad).

    A window has its tags, the number of features of each token, and the features. Without windows every text is
    all outside.
    """
    weights, transitions = np.zeros((BUCKETS, 3)), np.zeros((3, 3))
    squares, squares_across = np.full(BUCKETS, 1e-6), np.full((3, 3), 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        order = rng.permutation(len(windows))
        for first in range(0, len(order), 32):
            part = [windows[k] for k in order[first : first + 32]]
            labels = np.concatenate([p[0] for p in part]).astype(np.int64)
            n = np.concatenate([p[1] for p in part]).astype(np.int64)
            flat = np.concatenate([p[2] for p in part]).astype(np.int64)
            kept = (rng.random((len(flat), 1)) >= LEFT_OUT) / (1 - LEFT_OUT)
            scores = np.add.reduceat(weights[flat] * kept, np.cumsum(n) - n)
            sizes = np.array([len(p[0]) for p in part])
            marginal, expected, _ = forward_backward(scores, sizes, transitions)
            marginal[np.arange(len(labels)), labels] -= 1
            inner = np.ones(len(labels), dtype=bool)
            inner[np.cumsum(sizes) - 1] = False
            np.subtract.at(expected, (labels[:-1][inner[:-1]], labels[1:][inner[:-1]]), 1)
            touched, where = np.unique(flat, return_inverse=True)
            back = np.repeat(marginal, n, axis=0) * kept
            slope = np.stack([np.bincount(where, weights=back[:, j]) for j in range(3)], axis=1)
            squares[touched] += (slope**2).mean(axis=1)
            weights[touched] -= RATE * slope / np.sqrt(squares[touched])[:, None]
            squares_across += expected**2
            transitions -= RATE * expected / np.sqrt(squares_across)
    if not len(windows):
        weights[:, OUTSIDE] = 1.0
    return Model(weights.astype(np.float32), transitions)


def fit_secrets(
    documents: DataFrame, id_column: str = "doc_id", text: str = "text", drawn: int = DRAWN, with_secret: int = WITH_SECRET, without: int = WITHOUT
) -> Model:
    """Model from what the patterns find in at most ``drawn`` documents, drawn by hash of their ids.

    At most ``with_secret`` windows with a secret and ``without`` windows without one come to the driver, as numbers
    of features, so their size is bounded. Null and empty texts teach nothing; rows with a null id are drawn like
    others.
    """
    key = F.xxhash64(F.col(id_column), F.lit("secrets"))
    names = documents.select(F.col(id_column).alias("id"), key.alias("key"))
    last = names.orderBy("key", "id").limit(drawn).agg(F.max("key")).first()[0]
    rows = documents.filter(key <= F.lit(last if last is not None else 0)).select(key.alias("id"), F.col(text).cast("string").alias("text"))

    def cut(batches: Batches) -> Batches:
        for batch in batches:
            columns: list[list] = [[] for _ in range(5)]
            for name, body in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for k, window in enumerate(_windows(body, name) if body else []):
                    for column, value in zip(columns, ((name * 31 + k) & 0x7FFFFFFFFFFFFFFF, *window), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.bool_(), *[pa.list_(pa.int32())] * 3)
            names_ = ["id", "secret", "tags", "sizes", "features"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names_)

    offered = map_texts(rows, "id", "text", cut, "secret boolean, tags array<int>, sizes array<int>, features array<int>")
    taken = []
    for secret, most in ((True, with_secret), (False, without)):
        found = offered.filter(F.col("secret") == secret).orderBy("id").limit(most).toArrow()
        taken += list(zip(*[[np.array(x) for x in found.column(c).to_pylist()] for c in ("tags", "sizes", "features")], strict=True))
    return fit(taken)


# ---------------------------------------------------------------------------------------------
# scanning


def _added(tokens: list[str], at: np.ndarray, tags: np.ndarray, base: list) -> list[tuple[int, int]]:
    """Spans of the tagged tokens of a text that touch no base span; ``inside`` behind ``outside`` begins one too."""
    stops = np.cumsum([len(t) for t in tokens])
    spans: list[list[int]] = []
    before = -2
    for place, tag in zip(at.tolist(), tags.tolist(), strict=True):
        stop = int(stops[place])
        if tag == BEGIN or place != before + 1:
            spans.append([stop - len(tokens[place].lstrip()), stop])
        else:
            spans[-1][1] = stop
        before = place
    return [(a, b) for a, b in spans if a < b and not any(a < y and x < b for x, y, _, _ in base)]


def scan_secrets(documents: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, spans`` per row: ``kind, start, stop`` in code points, by start, then kind in the order of ``KINDS``.

    The patterns' spans are all there; the model's (kind ``model``) join them where they overlap none of those. A
    null or empty text has none. Rows are independent of each other, whatever their ids; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))

    def scan(batches: Batches) -> Batches:
        weights, transitions = shared.value
        known = TokenTable(weights)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, sizes = known.of(texts)
            scores, starts, stops = known.emissions(rows, sizes)
            at, tags = best_tags(scores, starts, stops, transitions)
            owner = np.searchsorted(stops, at, side="right")
            firsts = np.searchsorted(owner, np.arange(len(texts) + 1))
            spans = []
            for k, body in enumerate(texts):
                base = base_spans(body)
                found = [(a, b, name) for a, b, name, _ in base]
                if firsts[k] < firsts[k + 1]:
                    own = slice(firsts[k], firsts[k + 1])
                    found += [(a, b, "model") for a, b in _added(TOKEN.findall(body), at[own] - starts[k], tags[own], base)]
                    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
                spans.append([{"kind": name, "start": a, "stop": b} for a, b, name in found])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, kind)], names=["id", "spans"])

    return map_texts(documents, id_column, text, scan, "spans array<struct<kind:string,start:int,stop:int>>")


def _written(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


@query("op11_secret_scans")
def op11(spark, folder):
    documents = table(spark, folder, "documents")
    found = scan_secrets(documents, fit_secrets(documents))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:3]], F.sha2(_written(base), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans")
    )
