"""Language of every word of a code-switched text by a linear-chain conditional random field.

A word's features are its beginnings and endings, its character n-grams, and the word itself, which serves
as a learned lexicon; their weights give a score for each language. Learned transitions between neighbours
join in, and forward-backward gives the probability of each language at each word. The language of a text is
the one with most expected words.
"""

from __future__ import annotations

import zlib
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from palimpsest.llm.common import Batches, map_texts
from palimpsest.llm.registry import query, table
from palimpsest.llm.samples import labelled_texts
from palimpsest.llm.toxicity import fold

WORD = regex.compile(r"\p{L}+")
BUCKETS = 1 << 17
#: Texts of each language that a fit takes at most, and the words an epoch draws from each.
PER_LANGUAGE = 400
WORDS_PER_TEXT = 120
EPOCHS = 4
RATE = 0.2
UNDETERMINED = "und"


def features(word: str) -> list[int]:
    """Buckets of a word's affixes (up to 4), inner n-grams (2 and 3) and itself."""
    crc, mask = zlib.crc32, BUCKETS - 1
    raw = word.encode()
    out = [crc(raw, 1) & mask]
    for n in range(1, min(4, len(word)) + 1):
        out.append(crc(word[:n].encode(), 2) & mask)
        out.append(crc(word[-n:].encode(), 3) & mask)
    for n in (2, 3):
        out += [crc(raw[i : i + n], 4) & mask for i in range(len(raw) - n + 1)]
    return out


def words_in(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    return WORD.findall(text.lower()) if text else []


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray


class WordTable:
    """Scores of words by language, one row each, kept while there are not too many."""

    KEPT = 400_000

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self._clear()

    def _clear(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, self.weights.shape[1]), dtype=np.float32)

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.rows) > self.KEPT:
            self._clear()
        rows = self.rows
        new = list({w for words in texts for w in words if w not in rows})
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            lists = [features(w) for w in part]
            sizes = np.array([len(x) for x in lists])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=sizes.sum())
            scores = np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) / np.sqrt(sizes)[:, None]
            first = len(rows)
            while first + len(part) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
            self.scores[first : first + len(part)] = scores
            rows.update(zip(part, range(first, first + len(part)), strict=True))

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of all words end to end, and the number of words by text."""
        self.learn(texts)
        sizes = np.array([len(words) for words in texts], dtype=np.int64)
        get = self.rows.__getitem__
        index = np.fromiter(map(get, chain.from_iterable(texts)), dtype=np.int64, count=sizes.sum())
        return self.scores[index], sizes


def forward_backward(scores: np.ndarray, sizes: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of every word, expected transitions summed over all chains, and log normalisers.

    The chains (``sizes`` words each, end to end in ``scores``) advance together, one word a step, the
    longest first, so that a step works on all chains that are still running.
    """
    order = np.argsort(-sizes, kind="stable")
    lengths = sizes[order]
    first = (np.cumsum(sizes) - sizes)[order]
    steps = int(lengths[0]) if len(lengths) else 0
    running = np.searchsorted(-lengths, -np.arange(steps), side="left")
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores
    emitted = np.exp((scores - top).astype(np.float64))
    across = np.exp(transitions)
    alpha, scale = np.empty_like(emitted), np.ones(len(scores))
    for t in range(steps):
        at = first[: running[t]] + t
        value = emitted[at] if t == 0 else (alpha[at - 1] @ across) * emitted[at]
        total = value.sum(axis=1)
        alpha[at] = value / total[:, None]
        scale[at] = total
    expected = np.zeros_like(across)
    marginal = alpha.copy()
    beta = np.ones((len(lengths), scores.shape[1]))
    for t in range(steps - 1, 0, -1):
        n = running[t]
        at = first[:n] + t
        onward = emitted[at] * beta[:n] / scale[at][:, None]
        expected += across * (alpha[at - 1].T @ onward)
        beta[:n] = onward @ across.T
        marginal[at - 1] = alpha[at - 1] * beta[:n]
    ends = np.cumsum(sizes)
    logs = np.concatenate([[0.0], np.cumsum(np.log(scale) + (top[:, 0] if len(scores) else 0.0))])
    return marginal, expected, logs[ends] - logs[ends - sizes]


def _chains(texts: list[tuple[str, list[str]]], rng: np.random.Generator) -> list[tuple[list[str], list[str]]]:
    """Code-switched training chains: runs of 5 to 40 words from random texts, about 60 words a chain."""
    runs = []
    for language, words in texts:
        own, at = [], 0
        while at < len(words):
            size = int(rng.integers(5, 41))
            own.append((language, words[at : at + size]))
            at += size
        # runs from anywhere in the text, as many as hold WORDS_PER_TEXT words
        taken = 0
        for k in rng.permutation(len(own)):
            if taken >= WORDS_PER_TEXT:
                break
            runs.append(own[k])
            taken += len(own[k][1])
    out, chain_words, chain_labels = [], [], []
    for k in rng.permutation(len(runs)):
        language, words = runs[k]
        chain_words += words
        chain_labels += [language] * len(words)
        if len(chain_words) >= 60:
            out.append((chain_words, chain_labels))
            chain_words, chain_labels = [], []
    return [*out, (chain_words, chain_labels)] if chain_words else out


def fit(texts: list[tuple[str, str]], seed: int = 5) -> Model:
    """Weights and transitions that maximise the likelihood of the labels of training chains (Adagrad)."""
    cut = [(language, words) for language, words in ((y, words_in(t)) for y, t in texts) if words]
    languages = sorted({y for y, _ in cut})
    k = len(languages)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    if k < 2:
        return Model(languages, weights.astype(np.float32), transitions)
    number = {y: i for i, y in enumerate(languages)}
    rng = np.random.default_rng(seed)
    squares, squares_across = np.full(BUCKETS, 1e-6), np.full((k, k), 1e-6)
    known: dict[str, list[int]] = {}
    for _ in range(EPOCHS):
        chains = _chains(cut, rng)
        for at in range(0, len(chains), 16):
            part = chains[at : at + 16]
            words = [w for ws, _ in part for w in ws]
            labels = np.array([number[y] for _, ys in part for y in ys])
            lists = [known.get(w) or known.setdefault(w, features(w)) for w in words]
            n = np.array([len(x) for x in lists])
            flat = np.fromiter(chain.from_iterable(lists), dtype=np.int64, count=n.sum())
            norm = 1 / np.sqrt(n)
            scores = np.add.reduceat(weights[flat], np.cumsum(n) - n) * norm[:, None]
            sizes = np.array([len(ws) for ws, _ in part])
            marginal, expected, _ = forward_backward(scores, sizes, transitions)
            marginal[np.arange(len(labels)), labels] -= 1
            inside = np.ones(len(labels), dtype=bool)
            inside[np.cumsum(sizes) - 1] = False
            np.subtract.at(expected, (labels[:-1][inside[:-1]], labels[1:][inside[:-1]]), 1)
            touched, where = np.unique(flat, return_inverse=True)
            back = np.repeat(marginal * norm[:, None], n, axis=0)
            slope = np.stack([np.bincount(where, weights=back[:, j]) for j in range(k)], axis=1)
            squares[touched] += (slope**2).mean(axis=1)
            weights[touched] -= RATE * slope / np.sqrt(squares[touched])[:, None]
            squares_across += expected**2
            transitions -= RATE * expected / np.sqrt(squares_across)
    return Model(languages, weights.astype(np.float32), transitions)


def fit_language(
    labelled: DataFrame, id_column: str = "doc_id", text: str = "text", label: str = "lang", per_language: int = PER_LANGUAGE
) -> Model:
    """Model from rows with a text and a language; rows where either is null teach nothing.

    At most ``per_language`` texts of a language are drawn, by hash of the id; each epoch draws runs of about
    ``WORDS_PER_TEXT`` words from anywhere in each of them.
    """
    known = labelled.select(id_column, F.col(label).cast("string").alias(label))
    return fit(labelled_texts(known, labelled, id_column, text, label, per_language)[0])


def word_languages(
    documents: DataFrame, model: Model, id_column: str = "doc_id", text: str = "text", spans: bool = True
) -> DataFrame:
    """``id, lang_pred, score, spans`` per row.

    ``lang_pred``: the language with most expected words, ties to the first in alphabetical order, ``und``
    where the text is null or has no letter (score 0); ``score``: its share of the expected words; ``spans``:
    runs of words (``first``, ``last``, from 0) whose likeliest language is the same (null where not asked
    for). A model that knows no language gives ``und``. Rows are independent of each other; other columns are
    not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def predict(batches: Batches) -> Batches:
        languages, weights, transitions = shared.value
        scores = WordTable(weights)
        for batch in batches:
            texts = [words_in(t) if languages else [] for t in batch.column("text").to_pylist()]
            emitted, sizes = scores.of(texts)
            marginal = forward_backward(emitted, sizes, transitions)[0]
            ends = np.cumsum(sizes)
            sums = np.concatenate([np.zeros((1, max(1, len(languages)))), np.cumsum(marginal, axis=0)]) if len(marginal) else None
            lang, score, runs = [], [], []
            likeliest = marginal.argmax(axis=1) if spans and len(marginal) else None
            for size, end in zip(sizes.tolist(), ends.tolist(), strict=True):
                if not size:
                    lang.append(UNDETERMINED)
                    score.append(0.0)
                    runs.append([] if spans else None)
                    continue
                share = (sums[end] - sums[end - size]) / size
                best = int(np.argmax(np.round(share, 9)))
                lang.append(languages[best])
                score.append(float(min(1.0, max(0.0, share[best]))))
                runs.append(_runs(likeliest[end - size : end], languages) if spans else None)
            columns = [batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(runs, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "spans"])

    added = "lang_pred string, score double, spans array<struct<first:int,last:int,lang:string>>"
    return map_texts(documents, id_column, text, predict, added)


def _runs(likeliest: np.ndarray, languages: list[str]) -> list[dict]:
    out, at = [], 0
    for number, run in groupby(likeliest.tolist()):
        size = sum(1 for _ in run)
        out.append({"first": at, "last": at + size - 1, "lang": languages[number]})
        at += size
    return out


@query("op10_language_id")
def op10(spark, folder):
    documents = table(spark, folder, "documents")
    model = fit_language(documents.filter(fold("doc_id", 4) != 2))
    found = word_languages(documents, model, spans=False)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
