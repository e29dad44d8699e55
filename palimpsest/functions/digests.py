"""MD5 of many short texts at once, in numpy."""

from __future__ import annotations

from hashlib import md5
from math import sin

import numpy as np
import pyarrow as pa

#: Texts of any kind hashed at a time: their working arrays stay in the processor's cache.
AT_ONCE = 16_384
#: Bytes of a text that fits one block of MD5 with its end mark and length.
ONE_BLOCK = 55

_SINES = [int(abs(sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_WORDS = [i if i < 16 else (5 * i + 1 if i < 32 else 3 * i + 5 if i < 48 else 7 * i) % 16 for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _digest(block: list[np.ndarray | int], rows: int, steps: int = 64) -> tuple[np.ndarray, ...]:
    """The four words of the MD5 of one-block texts, before the start is added, or those after fewer steps.

    ``block`` is the sixteen words of the blocks: an array where texts differ, one number where they do not. Steps before
    the first array are made once for all texts.
    """
    a, b, c, d = _START
    same = next((i for i in range(16) if isinstance(block[i], np.ndarray)), 16)
    for i in range(same):
        turned = (a + (d ^ (b & (c ^ d))) + _SINES[i] + block[i]) % 2**32 * 2 ** _TURNS[i]
        a, b, c, d = d, (b + turned % 2**32 + turned // 2**32) % 2**32, b, c
    a, b, c, d = (np.full(rows, x, np.uint32) for x in (a, b, c, d))
    mixed = np.empty(rows, np.uint32)
    for i in range(same, steps):
        if i < 16:
            np.bitwise_xor(c, d, out=mixed)
            mixed &= b
            mixed ^= d
        elif i < 32:
            np.bitwise_xor(b, c, out=mixed)
            mixed &= d
            mixed ^= c
        elif i < 48:
            np.bitwise_xor(b, c, out=mixed)
            mixed ^= d
        else:
            np.bitwise_not(d, out=mixed)
            mixed |= b
            mixed ^= c
        a += mixed
        word = block[_WORDS[i]]
        if isinstance(word, np.ndarray):
            a += word
            word = 0
        a += np.uint32((_SINES[i] + word) % 2**32)
        np.left_shift(a, np.uint32(_TURNS[i]), out=mixed)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
        a |= mixed
        a += b
        a, b, c, d = d, a, b, c
    return a, b, c, d


def _first_word(block: list[np.ndarray | int], rows: int) -> np.ndarray:
    """First four bytes of the MD5 of one-block texts, as the number that their hex digits spell.

    The last three steps of the digest do not reach its first word.
    """
    first = _digest(block, rows, 61)[1]
    first += np.uint32(_START[0])
    return first.byteswap(inplace=True)


def md5_with(texts: pa.Array, tail: bytes) -> np.ndarray:
    """MD5 of each text with ``tail`` behind it, sixteen bytes a row."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1] or bytes(8), np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    found = np.empty((len(texts), 16), np.uint8)
    for at in range(0, len(texts), AT_ONCE):
        ends = bounds[at : at + AT_ONCE + 1]
        sizes = np.diff(ends)
        row = np.flatnonzero(sizes + len(tail) <= ONE_BLOCK)
        for i in np.flatnonzero(sizes + len(tail) > ONE_BLOCK):
            found[at + i] = np.frombuffer(md5(data[ends[i] : ends[i + 1]].tobytes() + tail).digest(), np.uint8)
        if not len(row):
            continue
        starts, sizes = ends[row], sizes[row]
        spelt = np.zeros((len(row), 4 * (int(sizes.max() + len(tail)) // 4 + 1)), np.uint8)
        place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spelt[np.repeat(np.arange(len(row)), sizes), place] = data[np.repeat(starts, sizes) + place]
        for k, byte in enumerate((*tail, 0x80)):
            spelt[np.arange(len(row)), sizes + k] = byte
        block: list[np.ndarray | int] = [0] * 16
        for k, word in enumerate(np.ascontiguousarray(spelt.view("<u4").T)):
            block[k] = word
        block[14] = (8 * (sizes + len(tail))).astype(np.uint32)
        words = [word + np.uint32(start) for word, start in zip(_digest(block, len(row)), _START, strict=True)]
        found[at + row] = np.stack(words, axis=1).astype("<u4").view(np.uint8)
    return found


def _tails(numbers: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits and end mark of each number as words, from byte ``at`` of the first one on, and the count of digits."""
    digits = np.searchsorted(10 ** np.arange(1, 19), numbers, "right") + 1
    width = -(-(at + int(digits.max()) + 1) // 4)
    spelt = np.zeros((len(numbers), 4 * width), np.uint8)
    for n in np.unique(digits):
        rows = np.flatnonzero(digits == n)
        for k in range(n):
            spelt[rows, at + k] = 48 + numbers[rows] // 10 ** (n - 1 - k) % 10
        spelt[rows, at + n] = 0x80
    return np.ascontiguousarray(spelt.view("<u4").T), digits


def numbered_md5(heads: list[bytes], numbers: np.ndarray) -> np.ndarray:
    """The number spelt by the first eight hex digits of ``md5(head + str(number))``: a row for each head, a column for each number.

    Numbers are zero or more. All pairs are worked on at once, some 50 bytes each.
    """
    numbers = np.asarray(numbers, np.int64)
    shape = len(heads), len(numbers)
    if not all(shape):
        return np.empty(shape, np.uint32)
    sizes, last = np.array([len(h) for h in heads]), len(str(numbers.max()))
    if sizes.max() + last > ONE_BLOCK:
        pairs = (md5(b"%b%d" % (head, i)).digest() for head in heads for i in numbers)
        return np.fromiter((int.from_bytes(d[:4]) for d in pairs), np.uint32, shape[0] * shape[1]).reshape(shape)
    words = np.zeros((int(sizes.max() + last) // 4 + 1, *shape), np.uint32)
    length = np.empty(shape, np.uint32)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        if rows[-1] - rows[0] == len(rows) - 1:
            rows = slice(rows[0], rows[-1] + 1)
        spelt = np.frombuffer(b"".join(h.ljust(4 * (size // 4 + 1), b"\0") for h in heads if len(h) == size), "<u4").reshape(-1, size // 4 + 1)
        tails, digits = _tails(numbers, size % 4)
        for k in range(size // 4):
            words[k, rows] = spelt[:, k, None]
        for k, tail in enumerate(tails, size // 4):
            words[k, rows] = tail
        words[size // 4, rows] |= spelt[:, -1, None]
        length[rows] = 8 * (size + digits)
    block: list[np.ndarray | int] = [0] * 16
    for k, word in [*enumerate(words), (14, length)]:
        block[k] = int(word[0, 0]) if (word == word[0, 0]).all() else word.ravel()
    return _first_word(block, shape[0] * shape[1]).reshape(shape)
