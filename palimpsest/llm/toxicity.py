"""Toxicity by subword bags: character n-gram vectors averaged over a passage, then a linear softmax.

The vectors and the softmax are learned together in numpy from a bounded sample of labelled texts. A word
is the mean of the vectors of its n-grams and of itself, so a misspelling never seen still shares most of
them; a passage is the mean of its few words, so that an insult in a long text is not averaged away. Labels
belong to whole texts: each round of the fit takes a toxic text's most suspicious passages as examples, and
a clean text's as counter-examples. The odds of a text are those of its two most suspicious passages, scaled
on a quarter of the sample that the fit leaves out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.common import Batches, RunTable, filter_texts, map_texts
from palimpsest.llm.decontaminate import WORD_BYTES, words_of
from palimpsest.llm.registry import query, table
from palimpsest.llm.samples import labelled_texts

BUCKETS = 1 << 16
DIM = 8
SIZES = (3, 4, 5)
#: Words of a passage, and passages that speak for a text.
PASSAGE = 4
SPEAKERS = 2
#: Texts of each label that a fit takes at most.
PER_LABEL = 1500
ROUNDS = 5
RATE = 0.1


def subwords(word: bytes, buckets: int = BUCKETS) -> list[int]:
    """Buckets of the word and of its byte n-grams, borders marked."""
    marked = b"<" + word + b">"
    mask, crc = buckets - 1, zlib.crc32
    grams = [crc(marked[i : i + n]) & mask for n in SIZES for i in range(len(marked) - n + 1)]
    grams.append(crc(marked, 1) & mask)
    return grams


def lower_words(text: str | None) -> list[bytes]:
    return words_of(text.lower()) if text else []


class Model(NamedTuple):
    """Log odds by bucket, and the odds of a text as ``scale`` times its passages' mean plus ``constant``."""

    weights: np.ndarray
    scale: float
    constant: float
    empty: float


class _Sample:
    """Passages of the sampled texts over numbered words, and the n-gram buckets of each word."""

    def __init__(self, texts: list[list[bytes]]):
        numbers: dict[bytes, int] = {}
        self.words = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words])
        grams = [subwords(w) for w in numbers]
        self.n_grams = np.array([len(g) for g in grams])
        self.grams = np.fromiter(chain.from_iterable(grams), dtype=np.int64, count=self.n_grams.sum())
        self.first_gram = np.cumsum(self.n_grams) - self.n_grams
        sizes = [min(PASSAGE, len(words) - at) for words in texts for at in range(0, len(words), PASSAGE)]
        self.size = np.array(sizes)
        self.start = np.cumsum(self.size) - self.size
        self.text = np.repeat(np.arange(len(texts)), [-(-len(words) // PASSAGE) for words in texts])

    def word_scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.grams], self.first_gram) / self.n_grams

    def passage_scores(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.word_scores(weights)[self.words], self.start) / self.size

    def bags(self, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of some passages end to end, their weights (which sum to one in each), and how many each has."""
        size = self.size[passages]
        at = np.repeat(self.start[passages] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        words = self.words[at]
        n = self.n_grams[words]
        at = np.repeat(self.first_gram[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        weight = np.repeat(1.0 / (n * np.repeat(size, size)), n)
        return self.grams[at], weight, np.add.reduceat(n, np.cumsum(size) - size)


def _ranked(text: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages by text and falling value, the place of each in its text, and how many its text has."""
    order = np.lexsort((-value, text))
    count = np.bincount(text)
    count = count[count > 0]
    return order, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count), np.repeat(count, count)


def fit(texts: list[tuple[int, str]], counts: dict[int, int], seed: int = 7) -> Model:
    """Model from labelled texts; ``counts`` has the number of labelled rows of each label, for the prior.

    Without texts of both labels every text gets the prior's odds.
    """
    rate = min(max(counts.get(1, 0) / max(1, sum(counts.values())), 1e-3), 1 - 1e-3)
    prior = float(np.log(rate / (1 - rate)))
    cut = [(y, words) for y, words in ((y, lower_words(t)) for y, t in texts) if words]
    if len({y for y, _ in cut}) < 2:
        return Model(np.zeros(BUCKETS, dtype=np.float32), 0.0, prior, prior)
    held = [row for k, row in enumerate(cut) if k % 4 == 3]
    if len({y for y, _ in held}) == 2:
        cut = [row for k, row in enumerate(cut) if k % 4 != 3]
    else:
        held = cut
    weights = _train(np.array([y for y, _ in cut]), _Sample([words for _, words in cut]), np.random.default_rng(seed))
    scale, constant = _calibrate(np.array([y for y, _ in held]), _text_scores([words for _, words in held], weights), prior)
    return Model(weights.astype(np.float32), scale, constant, prior)


def _train(label: np.ndarray, sample: _Sample, rng: np.random.Generator) -> np.ndarray:
    vectors, softmax, bias = rng.normal(0, 0.05, (BUCKETS, DIM)), rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    squares = np.full(BUCKETS, 1e-8)
    clean = np.flatnonzero(label[sample.text] == 0)
    for turn in range(ROUNDS):
        if turn == 0:
            order, place, count = _ranked(sample.text, rng.random(len(sample.text)))
            limit = np.full(len(order), 20)
        else:
            order, place, count = _ranked(sample.text, sample.passage_scores(vectors @ (softmax[:, 1] - softmax[:, 0])))
            limit = np.where(label[sample.text[order]] == 1, np.maximum(1, np.ceil(0.05 * count)), 3)
        examples = order[place < limit]
        if turn:
            examples = np.concatenate([examples, rng.choice(clean, min(len(clean), 3 * (label == 0).sum()))])
        target = label[sample.text[examples]]
        cost = len(target) * 0.5 / np.maximum(1, np.bincount(target, minlength=2))
        for _ in range(2):
            shuffled = rng.permutation(len(examples))
            for at in range(0, len(shuffled), 256):
                part = shuffled[at : at + 256]
                y = target[part]
                buckets, weight, size = sample.bags(examples[part])
                mean = np.add.reduceat(vectors[buckets] * weight[:, None], np.cumsum(size) - size)
                logits = mean @ softmax + bias
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p *= cost[y][:, None] / len(y)
                back = np.repeat(p @ softmax.T, size, axis=0) * weight[:, None]
                touched, where = np.unique(buckets, return_inverse=True)
                slope = np.stack([np.bincount(where, weights=back[:, k]) for k in range(DIM)], axis=1)
                squares[touched] += (slope**2).mean(axis=1)
                vectors[touched] -= RATE * slope / np.sqrt(squares[touched])[:, None]
                softmax -= 0.1 * RATE * (mean.T @ p)
                bias -= RATE * p.sum(axis=0)
    return vectors @ (softmax[:, 1] - softmax[:, 0])


def _text_scores(texts: list[list[bytes]], weights: np.ndarray) -> np.ndarray:
    sample = _Sample(texts)
    scores = sample.word_scores(weights)[sample.words]
    ends = np.cumsum([len(words) for words in texts])
    return np.array([speakers(scores[end - len(words) : end]) for words, end in zip(texts, ends, strict=True)])


def speakers(word_scores: np.ndarray) -> float:
    """Mean score of the most suspicious passages of a text."""
    starts = np.arange(0, len(word_scores), PASSAGE)
    passages = np.add.reduceat(word_scores, starts) / np.minimum(PASSAGE, len(word_scores) - starts)
    k = min(SPEAKERS, len(passages))
    return float(np.partition(passages, len(passages) - k)[len(passages) - k :].mean())


def _calibrate(label: np.ndarray, score: np.ndarray, prior: float) -> tuple[float, float]:
    """Logistic regression of the label on the score by Newton steps, the labels weighted to their shares."""
    rate = 1 / (1 + np.exp(-prior))
    share = np.array([(1 - rate) / (label == 0).sum(), rate / (label == 1).sum()])[label]
    middle, spread = score.mean(), score.std() or 1.0
    x = np.stack([(score - middle) / spread, np.ones(len(score))], axis=1)
    theta = np.array([1.0, prior])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (share * (p - label)) + 1e-3 * theta * [1, 0]
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + 1e-3 * np.diag([1, 0.01])
        theta -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(theta[0] / spread), float(theta[1] - theta[0] * middle / spread)


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = PER_LABEL
) -> Model:
    """Model from the labelled documents of ``labels`` (id, label 0 or 1; others are left out).

    At most ``per_label`` texts of each label are read, drawn by hash. Without examples of both labels every
    text gets the share of label 1.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(id_column, F.col(label).cast("int").alias(label))
    return fit(*labelled_texts(known, documents, id_column, text, label, per_label))


class WordScores:
    """Log odds of words under a model, kept by hash in a table of fixed size for the words that come again.

    Texts are cut into words in numpy, a block of bytes at a time, so no lists of words are held.
    """

    #: Bytes cut at a time; a longer text is cut at blanks.
    BLOCK = 250_000
    BITS = 18

    def __init__(self, model: Model):
        self.model = model
        self.table = RunTable(self.BITS, np.float64)

    def _of_new(self, words: list[bytes]) -> np.ndarray:
        out = [np.zeros(0)]
        for at in range(0, len(words), 2_000):
            lists = [subwords(w) for w in words[at : at + 2_000]]
            sizes = np.array([len(x) for x in lists])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sizes.sum())
            out.append(np.add.reduceat(self.model.weights[flat].astype(np.float64), np.cumsum(sizes) - sizes) / sizes)
        return np.concatenate(out)

    def _of_block(self, parts: list[bytes]) -> list[np.ndarray]:
        """Scores of the words of each part; parts are words and blanks, one blank or more at the end."""
        joined = b"".join(parts)
        data = np.frombuffer(joined, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(data != 32, prepend=False))
        starts, ends = edges[::2], edges[1::2]
        values, new, one, kind, keys = self.table.looked_up(data, starts, ends)
        if len(one):
            fresh = self._of_new([joined[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)])
            values[new] = fresh[kind]
            self.table.put(keys, ends[one] - starts[one], fresh)
        return np.split(values, np.searchsorted(starts, np.cumsum([len(x) for x in parts[:-1]])))

    def _word_scores(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Scores of the words of each text in turn."""
        waiting, held = [], 0
        for text in texts:
            raw = (text.lower().encode().translate(WORD_BYTES) if text else b"") + b" "
            if held + len(raw) > self.BLOCK:
                if waiting:
                    yield from self._of_block(waiting)
                waiting, held = [], 0
            if len(raw) > self.BLOCK:
                yield np.concatenate([x for part in _blank_cuts(raw, self.BLOCK) for x in self._of_block([part])])
                continue
            waiting.append(raw)
            held += len(raw)
        if waiting:
            yield from self._of_block(waiting)

    def of_texts(self, texts: list[str | None]) -> np.ndarray:
        _, scale, constant, empty = self.model
        return np.array([constant + scale * speakers(v) if len(v) else empty for v in self._word_scores(texts)])


def _blank_cuts(raw: bytes, size: int) -> Iterator[bytes]:
    """Parts of about ``size`` bytes that each end behind a blank."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", min(at + size, len(raw) - 1)) + 1
        yield raw[at:end]
        at = end


def toxicity_scores(documents: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, score, predicted`` per row: probability of label 1, and whether it reaches a half.

    Only the text counts. A text without words, empty or null, gets the share of label 1 among the labelled
    rows. Repeated rows get equal scores; other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Batches) -> Batches:
        scores = WordScores(shared.value)
        for batch in batches:
            odds = scores.of_texts(batch.column("text").to_pylist())
            p = 1.0 / (1.0 + np.exp(-np.clip(odds, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"]
            )

    return map_texts(documents, id_column, text, score, "score double, predicted int")


def drop_toxic(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, as they are, in one pass; null and empty texts get the share of label 1."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def make():
        scores = WordScores(shared.value)
        # a probability of a half or more, in the same arithmetic as the scores
        return lambda texts: 1.0 / (1.0 + np.exp(-np.clip(scores.of_texts(texts), -500, 500))) < 0.5

    return filter_texts(documents, text, make)


def fold(id_column: str, folds: int):
    return F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(folds))


@query("op2_toxicity")
def op2(spark, folder):
    documents, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = fit_toxicity(documents, labels.filter(fold("doc_id", 5) != 0))
    scores = toxicity_scores(documents, model)
    return scores.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
