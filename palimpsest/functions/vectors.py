"""Dense-vector expressions over ``array<double>`` / ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

from palimpsest.functions.digests import md5_with
from palimpsest.functions.text import split_words
from palimpsest.session import small_batches

ENCODER_DIM = 16


def to_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def vector_literal(values: Sequence[float]) -> Column:
    """Array literal of doubles, folded from one string instead of one expression node per value."""
    return F.split(F.lit(",".join(repr(float(v)) for v in values)), ",").cast("array<double>")


def usable(vector: Column) -> Column:
    """Whether the vector is there and is not the all-null result of normalising a zero vector."""
    return F.get(vector, F.lit(0)).isNotNull()


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(to_double(a), to_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x
    )


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(to_double(vector), F.lit(0.0), lambda s, x: s + x * x))


def unit(vector: Column) -> Column:
    """L2-normalised vector; a zero vector gives null components."""
    # vector and norm are bound as lambda variables so that each is computed once
    def scale(v: Column) -> Column:
        return F.transform(
            F.array(norm(v)), lambda length: F.transform(v, lambda x: F.try_divide(x, length))
        )[0]

    return F.transform(F.array(to_double(vector)), scale)[0]


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(to_double(a), to_double(b), lambda x, y: (x - y) * (x - y)),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def cubed_cosine(a: Column, b: Column, signed: bool = False) -> Column:
    """cos³ of two unit vectors; the absolute value unless ``signed``."""
    cube = F.transform(F.array(dot(a, b)), lambda c: c * c * c)[0]
    return cube if signed else F.abs(cube)


def fold_columns(prefix: str, dim: int) -> Column:
    """One array column out of the scalar columns ``{prefix}_0 … {prefix}_{dim-1}``."""
    return F.array(*[F.col(f"{prefix}_{i}").cast("float") for i in range(dim)])


def word_vector(word: str) -> np.ndarray:
    """Deterministic 16-component vector of a word: two digests, four hex digits per component.

    Components are multiples of 2⁻¹⁵ in [−1, 1), so sums of word vectors are exact in any order.
    """
    digits = b"".join(md5(f"{word}#{half}".encode()).digest() for half in range(ENCODER_DIM // 8))
    return np.frombuffer(digits, dtype=">u2").astype(np.float64) / 32768.0 - 1.0


def word_matrix(words: pa.Array) -> np.ndarray:
    """The vectors of many words, one a row."""
    digits = np.concatenate([md5_with(words, b"#%d" % half) for half in range(ENCODER_DIM // 8)], axis=1)
    return digits.view(">u2").astype(np.float64) / 32768.0 - 1.0


# Most distinct words a task remembers at a time, where it works on single words.
WORD_CACHE = 200_000
# Words whose different ones are hashed together.
WORDS_AT_ONCE = 100_000


def encode_words(words: Column, position_weight: float = 0.0) -> Column:
    """Unit vector of a word list: the built-in encoder for trying things out without a model.

    The text's vector is the sum of its word vectors; a positive ``position_weight`` makes it depend
    on word order. Text without words gives null.
    """
    small_batches()

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def encode_some(words: pa.Array, ends: np.ndarray) -> np.ndarray:
            """One vector per list, lists being the ranges between ``ends``; NaN for no words."""
            if not len(words):
                return np.full((len(ends) - 1, ENCODER_DIM), np.nan)
            coded = words.dictionary_encode()
            vectors = word_matrix(coded.dictionary)[coded.indices.to_numpy()]
            if position_weight:
                place = np.arange(len(words)) - np.repeat(ends[:-1], np.diff(ends))
                vectors = vectors * (1.0 + position_weight * place)[:, None]
            total = np.vstack([np.zeros(ENCODER_DIM), np.cumsum(vectors, axis=0)])
            sums = total[ends[1:]] - total[ends[:-1]]
            lengths = np.sqrt((sums * sums).sum(axis=1))[:, None]
            return np.divide(sums, lengths, out=np.full_like(sums, np.nan), where=lengths > 0)

        for lists in batches:
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
            words = lists.flatten()
            pieces, at = [np.empty((0, ENCODER_DIM))], 0
            while at < len(sizes):
                # as many lists as hold about WORDS_AT_ONCE words, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + WORDS_AT_ONCE, "right")) - 1)
                part = words.slice(ends[at], ends[to] - ends[at])
                pieces.append(encode_some(part, ends[at : to + 1] - ends[at]))
                at = to
            units = np.concatenate(pieces)
            missing = np.isnan(units[:, 0])
            widths = np.where(missing, 0, ENCODER_DIM)
            offsets = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
            yield pa.ListArray.from_arrays(offsets, units[~missing].ravel(), mask=pa.array(missing))

    return encode(words)


def encode_text(text: Column, position_weight: float = 0.0) -> Column:
    return encode_words(split_words(text), position_weight)


def word_vectors(word: Column) -> Column:
    """The built-in encoder's vector of a single word, not normalised: a text's vector has the direction of their sum."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def look_up(words: pa.Array) -> pa.Array:
        coded = words.dictionary_encode()
        known = pa.array(list(word_matrix(coded.dictionary)), pa.list_(pa.float64()))
        return known.take(coded.indices)

    return look_up(word)
