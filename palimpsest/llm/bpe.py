"""Byte-level BPE: stretches of text that encode by themselves, and exact token counts of every prefix.

The prefix counts come from dynamic programming over bytes. In the encoding of any prefix of a pre-token
the last token is the one vocabulary entry that ends there, encodes to itself, and forms a stable pair
with the last token of the prefix before it; its count is one more than that prefix's count. A pair is
stable if no merge ever joins across its border, which the merge ranks along the two touching edges tell.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import regex

NEVER = 1 << 30

#: Fixed values of byte-level BPE with the usual English contractions.
PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: White space as the pattern knows it; Python's own ``isspace`` has some control characters besides.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if regex.fullmatch(r"\s", c))
TWO_SPACES = regex.compile(r"\s\s|^\s|\s$")
SINGLE_SPACE = regex.compile(r"(?<=\S) (?=\S)")


def stretches(text: str) -> list[str]:
    """The text cut at single blanks between visible characters; the blank opens the next stretch, unwritten.

    No pre-token crosses such a blank and none before it depends on what follows, so the stretches encode
    by themselves: the first as it is, each later one with a blank in front.
    """
    return SINGLE_SPACE.split(text) if TWO_SPACES.search(text) else text.split(" ")


def byte_letters() -> dict[str, int]:
    """The letter byte-level vocabularies write for each byte, by rule: visible Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Exact token counts of all prefixes for one ``tokenizer.json`` with byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.special_cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        vocabulary = {raw(token): number for token, number in spec["model"]["vocab"].items() if token not in self.special}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for order, merge in enumerate(spec["model"]["merges"]):
            left, right = (raw(x) for x in (merge.split(" ") if isinstance(merge, str) else merge))
            pair, whole = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            self.rank[pair] = order
            self.parts[whole], self.made[whole] = pair, order
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self.tokens = {word: number for word, number in vocabulary.items() if self._whole(number)}
        # sizes of the tokens that end in two or three given bytes; shorter ones are always tried
        tails: dict[bytes, set[int]] = {}
        for word in self.tokens:
            for tail in {word[-2:], word[-3:]}:
                tails.setdefault(tail, {1}).update({len(word)} | ({2} if word[-2:] in self.tokens else set()))
        self.tails = {tail: tuple(sorted(sizes, reverse=True)) for tail, sizes in tails.items()}
        self.short = (2, 1)

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """Pieces that lie at the right (0) or left (1) border of a token while it is merged: piece, from, until."""
        known = self.edges[side]
        if token not in known:
            chain, piece = [(token, self.made.get(token, -1), NEVER)], token
            while piece in self.parts:
                until = self.made[piece]
                piece = self.parts[piece][1 - side]
                chain.append((piece, self.made.get(piece, -1), until))
            known[token] = chain
        return known[token]

    def _stable(self, left: int, right: int, before: int = NEVER) -> bool:
        """No merge of a rank below ``before`` joins a piece at the end of ``left`` with one that starts ``right``.

        Of merges of one rank the leftmost comes first: it beats a merge inside ``right``, not one inside ``left``.
        """
        rank = self.rank
        for a, a_from, a_until in self._edge(left, 0):
            for b, b_from, b_until in self._edge(right, 1):
                at = rank.get((a, b))
                if at is not None and at < before and a_from < at < a_until and b_from < at <= b_until:
                    return False
        return True

    def _whole(self, token: int) -> bool:
        """The token's own bytes encode to it."""
        stack = [token]
        while stack:
            token = stack.pop()
            if token in self.parts:
                left, right = self.parts[token]
                if not self._stable(left, right, self.made[token]):
                    return False
                stack += (left, right)
        return True

    def _extend(self, word: bytes, last: list[int], count: list[int]) -> None:
        """Carry the tables of a prefix (last token and token count by length) on to the whole pre-token."""
        tokens, tails, pairs, short = self.tokens, self.tails, self.pairs, self.short
        if len(pairs) > 400_000:
            pairs.clear()
        for end in range(len(last), len(word) + 1):
            for size in tails.get(word[end - 3 : end], short) if end > 2 else short:
                if size > end:
                    continue
                token = tokens.get(word[end - size : end])
                if token is None:
                    continue
                if size < end:
                    before = last[end - size]
                    key = before << 20 | token
                    stable = pairs.get(key)
                    if stable is None:
                        stable = pairs[key] = self._stable(before, token)
                    if not stable:
                        continue
                last.append(token)
                count.append(count[end - size] + 1)
                break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def _counts(self, word: bytes) -> list[int]:
        """Token counts of the prefixes of a pre-token, by byte; prefix 0 included."""
        last, count = [0], [0]
        self._extend(word, last, count)
        return count

    def many(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Counts by character of many pre-tokens, in byte order: each goes on where it leaves the one before."""
        before, last, count = b"", [0], [0]
        for raw, word in sorted((w.encode(), w) for w in words):
            if raw[: len(before)] == before:
                shared = len(before)
            else:
                shared = 0
                for a, b in zip(raw, before, strict=False):
                    if a != b:
                        break
                    shared += 1
            del last[shared + 1 :], count[shared + 1 :]
            self._extend(raw, last, count)
            before = raw
            yield word, count[1:] if len(raw) == len(word) else _at_characters(raw, count)

    def _by_character(self, word: str) -> list[int]:
        raw = word.encode()
        count = self._counts(raw)
        return count[1:] if len(raw) == len(word) else _at_characters(raw, count)

    def _plain(self, text: str) -> list[int]:
        """Counts of every prefix of a text without special tokens.

        A prefix that ends in white space has one run of it at its end; one that ends inside a contraction
        reads the mark and the letter apart.
        """
        out: list[int] = []
        total = 0
        run_start, run_total = -1, 0
        for match in PRE_TOKENS.finditer(text):
            word, start = match.group(), match.start()
            blank = word[0] in WHITE
            counts = self._by_character(word)
            if blank and run_start >= 0 and run_start < start:
                opening = len(word) if word[-1] in WHITE else 1
                joined = self._by_character(text[run_start : start + opening])
                out += [run_total + n for n in joined[start - run_start :]]
                out += [total + n for n in counts[opening:]]
            elif word[0] == "'" and len(word) == 3 and word[1].isalpha():
                out += [total + 1, total + 2, total + counts[2]]
            else:
                out += [total + n for n in counts]
            if word[-1] in WHITE:
                if run_start < 0:
                    run_start, run_total = start, total
            else:
                run_start = -1
            total += counts[-1]
        return out

    def counts(self, text: str) -> list[int]:
        """Token count of every prefix (by characters) of a text or of a stretch with its blank."""
        if self.special_cut is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[int] = []
        total, at = 0, 0
        for match in self.special_cut.finditer(text):
            opened = self._plain(text[at : match.end() - 1])
            out += [total + n for n in opened]
            segment = opened[match.start() - at - 1] if match.start() > at else 0
            total += segment + 1
            out.append(total)
            at = match.end()
        return out + [total + n for n in self._plain(text[at:])]


def _at_characters(raw: bytes, count: list[int]) -> list[int]:
    return [count[i + 1] for i in range(len(raw)) if i + 1 == len(raw) or raw[i + 1] & 0xC0 != 0x80]


class PrefixCounts:
    """Prefix counts of whole texts; those of short stretches and pre-tokens are kept for later texts."""

    KEPT = 400_000
    LONGEST = 60

    def __init__(self, path: str):
        self.counter = PrefixCounter(path)
        opens = "".join(regex.escape(s[0]) for s in self.counter.special)
        self.odd = regex.compile(rf"[\s'{opens}]")
        self.words: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}

    def _learn(self, stretches_seen: set[str]) -> None:
        """Counts of short stretches (with their blank) as single bytes."""
        if len(self.known) > self.KEPT:
            self.known.clear()
        if len(self.words) > self.KEPT:
            self.words.clear()
        known, words = self.known, self.words
        new = [s for s in stretches_seen if s not in known and len(s) <= self.LONGEST]
        plain, cut, odd = [], PRE_TOKENS.findall, self.odd.search
        for stretch in new:
            if odd(stretch):
                known[stretch] = bytes(self.counter.counts(" " + stretch))
            else:
                plain.append((stretch, cut(" " + stretch)))
        for word, counts in self.counter.many({w for _, ws in plain for w in ws if w not in words}):
            words[word] = bytes(counts)
        for stretch, parts in plain:
            counts = words[parts[0]]
            for part in parts[1:]:
                total = counts[-1]
                counts += bytes([total + n for n in words[part]])
            known[stretch] = counts

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Token counts of every prefix of each text."""
        cuts = [stretches(t) if t else [] for t in texts]
        self._learn({s for c in cuts for s in c[1:]})
        return [self._joined(c) for c in cuts]

    def _joined(self, cuts: list[str]) -> np.ndarray:
        if not cuts:
            return np.zeros(0, dtype=np.int32)
        first = np.array(self.counter.counts(cuts[0]), dtype=np.int32)
        get = self.known.get
        parts = [get(s) for s in cuts[1:]]
        if None in parts:
            wide = [np.frombuffer(p, np.uint8) if p is not None else np.array(self.counter.counts(" " + s)) for s, p in zip(cuts[1:], parts, strict=True)]
            sizes, counts = np.array([len(p) for p in wide]), np.concatenate(wide).astype(np.int32)
        else:
            sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
            counts = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.int32)
        ends = counts[np.cumsum(sizes) - 1] if len(sizes) else counts
        start = first[-1] if len(first) else 0
        counts += np.repeat(start + np.cumsum(ends, dtype=np.int32) - ends, sizes)
        return np.concatenate([first, counts])


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)
