"""Search over a whole vocabulary where a text's vector has the direction of the sum of its words' vectors.

A candidate is then a beam's sum b plus a word's vector w, and its mean cubed similarity to a corpus with third
moments T is a polynomial in w:

    score(b + w) · |b + w|³ = T(b,b,b) + 3 T(b,b,w) + 3 T(b,w,w) + T(w,w,w)

The tensor is contracted with each beam once a step and with each word once a search, so that a candidate costs
dim² products and no text is encoded. A step reads the vocabulary once, and only the best candidates leave a task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import islice, permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.text import REST, letters_only
from palimpsest.functions.vectors import WORD_CACHE, word_vector, word_vectors
from palimpsest.operators.scoring import CELLS, Batches, Moments, batch_vectors
from palimpsest.operators.search import SCORE_DIGITS, SUBJECT_SLOT, SearchState
from palimpsest.session import cut_lineage

#: How a word is written: its column, whether it opens the text, whether a full stop follows.
Form = Callable[[Column, bool, bool], Column]


def plain_form(word: Column, opens: bool, ends: bool) -> Column:
    return word


def sentence_form(word: Column, opens: bool, ends: bool) -> Column:
    """Capitalised at the start of the text, with the full stop at its end."""
    written = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, REST)) if opens else word
    return F.concat(written, F.lit(".")) if ends else written


class Vocabulary:
    """A vocabulary's words with the vectors of their written forms and T(w,w,w), each form a table made once."""

    def __init__(self, words: DataFrame, moments: Moments, vectors: Callable[[Column], Column] = word_vectors, form: Form = plain_form):
        self.words, self.moments, self.vectors, self.form = words.select("word").distinct(), moments, vectors, form
        self.made: dict[tuple[bool, bool], DataFrame] = {}
        self.known: dict[bool, dict[str, np.ndarray]] = {True: {}, False: {}}

    def table(self, opens: bool, ends: bool) -> DataFrame:
        """``word, written, v, own``; words without a vector are left out."""
        key = (opens, ends) if self.form is not plain_form else (False, False)
        if key not in self.made:
            written = self.words.select("word", self.form(F.col("word"), *key).alias("written"))
            rows = written.withColumn("v", self.vectors(F.col("written")))
            moments = self.moments

            def weigh(batches: Batches) -> Batches:
                for batch in batches:
                    for at in range(0, batch.num_rows, 2048):
                        part, x = batch_vectors(batch.slice(at, 2048))
                        if part.num_rows:
                            own = moments.mean_cube(x)
                            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own)], names=["word", "written", "v", "own"])

            self.made[key] = cut_lineage(rows.mapInArrow(weigh, "word string, written string, v array<double>, own double"))
        return self.made[key]

    def sums(self, lists: list[list[str]]) -> np.ndarray:
        """Sum of the vectors of each word list, the first word in its opening form."""
        dim = self.moments.dim
        out = np.zeros((len(lists), dim))
        for opens in (True, False):
            parts = [words[:1] if opens else words[1:] for words in lists]
            known = self.known[opens]
            wanted = sorted({w for words in parts for w in words if w not in known})
            if wanted:
                rows = self.table(opens, False).filter(F.col("word").isin(wanted)).select("word", "v").collect()
                known.update({r["word"]: np.array(r["v"]) for r in rows})
            for k, words in enumerate(parts):
                for word in words:
                    out[k] += known[word]
        return out


def _grown(table: DataFrame, moments: Moments, bases: np.ndarray, texts: list[tuple[str, str]], keep: int | None) -> DataFrame:
    """``base, word, text, score`` of every base with every word, or of the best ``keep`` of each batch.

    A base is a sum of vectors and the text on both sides of the new word.
    """
    tensor = moments.tensor / max(1, moments.count)
    shared = table.sparkSession.sparkContext.broadcast(
        (bases, np.einsum("ijk,nk->nij", tensor, bases), np.einsum("ijk,nj,nk->ni", tensor, bases, bases), texts)
    )

    def grow(batches: Batches) -> Batches:
        sums, once, twice, around = shared.value
        cubes = np.einsum("ni,ni->n", twice, sums)
        for whole in batches:
            step = max(1, CELLS // (8 * max(1, len(sums))))
            for at in range(0, whole.num_rows, step):
                batch = whole.slice(at, step)
                words, written = batch.column("word").to_pylist(), batch.column("written").to_pylist()
                x = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
                own = batch.column("own").to_numpy()
                scores = np.empty((len(sums), len(x)))
                for k in range(len(sums)):
                    value = cubes[k] + 3 * (x @ twice[k]) + 3 * ((x @ once[k]) * x).sum(axis=1) + own
                    length = np.sqrt(((x + sums[k]) ** 2).sum(axis=1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        scores[k] = np.round(value / length**3, SCORE_DIGITS)
                flat = scores.ravel()
                there = np.flatnonzero(np.isfinite(flat))
                if keep is not None and len(there) > keep:
                    # all that tie with the last one kept go on: the text decides among them later
                    least = np.partition(flat[there], len(there) - keep)[len(there) - keep]
                    there = there[flat[there] >= least]
                base, word = there // len(x), there % len(x)
                text = [around[b][0] + written[w] + around[b][1] for b, w in zip(base.tolist(), word.tolist(), strict=True)]
                columns = [pa.array(base), pa.array([words[w] for w in word.tolist()], pa.string()), pa.array(text, pa.string()), pa.array(flat[there])]
                yield pa.RecordBatch.from_arrays(columns, names=["base", "word", "text", "score"])

    return table.mapInArrow(grow, "base long, word string, text string, score double")


def beam_search(
    vocabulary: Vocabulary,
    beam_width: int = 50,
    num_steps: int = 15,
    stop_after: int | None = None,
    alpha: float | None = None,
    resume: SearchState | None = None,
    after_step: Callable[[SearchState], None] | None = None,
    all_beams: Callable[[int, DataFrame], None] | None = None,
) -> SearchState:
    """``search.beam_search`` for a vocabulary of any size: the same states, with the sums kept between steps.

    A full stop follows where the beam already held ``stop_after`` words (form ``sentence_form``). Ties go to the
    smaller text. ``all_beams`` receives every step's full table of candidates ``base, word, text, score``. An empty
    vocabulary adds nothing.
    """
    state = resume or SearchState(-1, [([], 0.0, 0.0)], [])
    for step in range(state.step + 1, num_steps):
        lists = [b[0] for b in state.beams]
        size = len(lists[0])
        bases = vocabulary.sums(lists)
        ends = stop_after is not None and size + 1 > stop_after
        opened = [_written(vocabulary, words) for words in lists]
        table = vocabulary.table(not size, ends)
        if all_beams is not None:
            all_beams(step, _grown(table, vocabulary.moments, bases, opened, None))
        grown = _grown(table, vocabulary.moments, bases, opened, beam_width)
        best = grown.orderBy(F.desc("score"), "text", "base").limit(beam_width).collect()
        if not best:
            return state
        penalty = 1.0 if alpha is None else 1.0 + alpha * float(np.log2(2.0 + size))
        beams = [([*lists[r["base"]], r["word"]], r["score"], r["score"] / penalty) for r in best]
        state = SearchState(step, beams, [*state.trace, (step, best[0]["score"], best[0]["text"])])
        if after_step is not None:
            after_step(state)
    return state


def _written(vocabulary: Vocabulary, words: list[str]) -> tuple[str, str]:
    """Text before and behind a word that is appended to a list."""
    if not words:
        return "", ""
    first = words[0][:1].upper() + words[0][1:] if vocabulary.form is sentence_form else words[0]
    return " ".join([first, *words[1:]]) + " ", ""


def substitution_search(vocabulary: Vocabulary, words: list[str], rounds: int = 5) -> list[tuple[int, float, str]]:
    """``search.substitution_search`` over a vocabulary of any size: each position's other words are the base.

    The start's words belong to the vocabulary. An empty vocabulary or word list gives an empty trace.
    """
    trace: list[tuple[int, float, str]] = []
    for number in range(rounds if words else 0):
        others = [[*words[:k], *words[k + 1 :]] for k in range(len(words))]
        texts = [(" ".join([*words[:k], ""]), " ".join(["", *words[k + 1 :]])) for k in range(len(words))]
        grown = _grown(vocabulary.table(False, False), vocabulary.moments, vocabulary.sums(others), texts, 1)
        best = grown.orderBy(F.desc("score"), "text", "base").limit(1).collect()
        if not best:
            return trace
        place = best[0]["base"]
        words = [*words[:place], best[0]["word"], *words[place + 1 :]]
        trace.append((number, best[0]["score"], best[0]["text"]))
    return trace


@lru_cache(maxsize=256)
def sequences(n: int, max_words: int, max_test: int) -> list[np.ndarray]:
    """Positions of the first ``max_test`` word sequences of n words, by length, the longest first."""
    out, left = [], max_test
    for size in range(min(max_words, n), 0, -1):
        found = list(islice(permutations(range(n), size), left))
        left -= len(found)
        out.append(np.array(found, dtype=np.int64).reshape(-1, size))
    return out


def best_subject(
    df: DataFrame,
    row_id: str,
    prompt: str,
    mean_prompt: str,
    max_words: int = 3,
    max_test: int = 1000,
    vector_of: Callable[[str], np.ndarray] = word_vector,
) -> DataFrame:
    """``search.best_subject`` where order does not matter: ``row_id, best_subject, score``, no text encoded.

    A completed prompt is the sum of the mean prompt's other words and the chosen ones, so that a row adds up rows of
    its own words' vectors. The first word sequence in generation order wins ties. ``mean_prompt`` has the slot as a
    word of its own. A prompt that is null or has no words has no subject. Other columns are not read.
    """
    others = [w for w in mean_prompt.split(" ") if w != SUBJECT_SLOT]
    if SUBJECT_SLOT not in mean_prompt.split(" "):
        raise ValueError("the slot must be a word of the mean prompt")
    cleaned = ["".join(c for c in w if c.isalpha()).lower() for w in others]
    base = sum((vector_of(w) for w in cleaned if w), np.zeros(len(vector_of("a"))))
    slots = mean_prompt.split(" ").count(SUBJECT_SLOT)

    def choose(batches: Batches) -> Batches:
        known: dict[str, np.ndarray] = {"": np.zeros_like(base)}
        for batch in batches:
            if len(known) > WORD_CACHE:
                known = {"": np.zeros_like(base)}
            best, scores = [], []
            for text in batch.column("prompt").to_pylist():
                words = text.split(" ") if text is not None else []
                for w in words:
                    if w not in known:
                        known[w] = vector_of(w)
                own = np.array([known[w] for w in words]).reshape(-1, len(base))
                truth = own.sum(axis=0)
                length = np.sqrt(truth @ truth)
                if not length:
                    best.append(None)
                    scores.append(None)
                    continue
                top = None
                for chosen in sequences(len(words), max_words, max_test):
                    sums = base + slots * own[chosen].sum(axis=1)
                    norms = np.sqrt((sums * sums).sum(axis=1))
                    with np.errstate(divide="ignore", invalid="ignore"):
                        value = np.round((sums @ (truth / length) / norms) ** 3, SCORE_DIGITS)
                    value = np.where(np.isfinite(value), value, -np.inf)
                    if len(value) and (top is None or value.max() > top[0]):
                        top = float(value.max()), chosen[int(value.argmax())]
                found = top is not None and np.isfinite(top[0])
                best.append(" ".join(words[k] for k in top[1]) if found else None)
                scores.append(top[0] if found else None)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best, pa.string()), pa.array(scores, pa.float64())], names=["id", "best_subject", "score"])

    rows = df.select(F.col(row_id).alias("id"), letters_only(F.col(prompt)).alias("prompt"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(choose, f"id {kind}, best_subject string, score double").withColumnRenamed("id", row_id)
