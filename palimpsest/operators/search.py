"""Prompt search: candidate generators and the search loops over them.

A loop's state is a handful of rows (the beam), so it lives on the driver between steps; every step
is one distributed job over the vocabulary, the positions or the trials. Candidates are encoded by
a ``Column → Column`` encoder and scored against the corpus moments, so the corpus itself is read
once per search.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from palimpsest.functions.text import REST, capitalise_sentence, letters_only, seeded_int, seeded_key
from palimpsest.functions.vectors import cubed_cosine, encode_text
from palimpsest.operators.evaluate import mean_score_by
from palimpsest.operators.ordering import with_position
from palimpsest.session import cut_lineage
from palimpsest.operators.scoring import (
    CELLS,
    Batches,
    CorpusVectors,
    Moments,
    against_blocks,
    as_matrix,
    batch_vectors,
    score_in_passes,
    vectors_of,
    with_moment_score,
)

Encoder = Callable[[Column], Column]
#: What candidates are scored against: moments (few components) or the corpus itself (any number).
Scorer = Moments | CorpusVectors
SCORE_DIGITS = 9
MAX_BEAMS = 100_000
#: Candidates for a wide corpus that a task scores.
TASK_CANDIDATES = 50_000
#: Subsets at most that a task makes.
SUBSETS_PER_TASK = 1_000_000


# ---------------------------------------------------------------------------------------------
# text of a word list


def plain_text(words: Column) -> Column:
    return F.array_join(words, " ")


def cleaned_text(words: Column) -> Column:
    return letters_only(F.array_join(words, " "))


def sentence_text(words: Column, stop_after: int = 3) -> Column:
    """Capitalised; a full stop once the beam already held ``stop_after`` words."""
    text = plain_text(words)
    head = F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, REST))
    return F.when(F.size(words) > stop_after, F.concat(head, F.lit("."))).otherwise(head)


def length_penalty(score: Column, words: Column, alpha: float | None) -> Column:
    """``score / (1 + α log2(1 + n))``; no penalty for α ``None``."""
    return score if alpha is None else score / (1.0 + alpha * F.log2(1.0 + F.size(words)))


# ---------------------------------------------------------------------------------------------
# generators


def _subset_sizes(max_length: int) -> list[int]:
    if not 1 <= max_length <= 3:
        raise ValueError("max_length must be 1, 2 or 3")
    return [r for r in (3, 2, 1) if r <= max_length]


def _subset_count(n: Column, max_length: int) -> Column:
    counts = {1: n, 2: n * (n - 1), 3: n * (n - 1) * (n - 2)}
    return sum((counts[r] for r in _subset_sizes(max_length)), F.lit(0).cast("long"))


def _subset_positions(n: Column, number: Column, max_length: int) -> Column:
    """Positions of the ``number``-th ordered subset of n items, longest subsets first."""

    def free(rank: Column, *taken: Column) -> Column:
        """The rank-th free position, given the taken positions in ascending order."""
        for position in taken:
            rank = rank + F.when(rank >= position, 1).otherwise(0)
        return rank

    def at_least_one(value: Column) -> Column:
        return F.greatest(value, F.lit(1).cast("long"))

    counts = {1: n, 2: n * (n - 1), 3: n * (n - 1) * (n - 2)}
    before, chosen = F.lit(0).cast("long"), None
    for r in _subset_sizes(max_length):
        i = number - before
        if r == 3:
            per_first, per_second = at_least_one((n - 1) * (n - 2)), at_least_one(n - 2)
            a = F.floor(i / per_first)
            b = free(F.floor(F.pmod(i, per_first) / per_second), a)
            positions = F.array(a, b, free(F.pmod(i, per_second), F.least(a, b), F.greatest(a, b)))
        elif r == 2:
            a = F.floor(i / at_least_one(n - 1))
            positions = F.array(a, free(F.pmod(i, at_least_one(n - 1)), a))
        else:
            positions = F.array(i)
        before = before + counts[r]
        chosen = F.when(number < before, positions) if chosen is None else chosen.when(number < before, positions)
    return chosen


def _subset_words(words: Column, number: Column, max_length: int) -> Column:
    positions = _subset_positions(F.size(words).cast("long"), number, max_length)
    return F.transform(positions, lambda p: F.get(words, p.cast("int")))


def ordered_subsets(df: DataFrame, words: Column, max_length: int = 3, max_test: int = 1000, name: str = "subset") -> DataFrame:
    """Ordered word subsets of up to ``max_length`` (at most 3) words, longest first, at most ``max_test``.

    The i-th permutation is computed from its number, so a row only ever makes the ones it keeps.
    Adds ``subset_no`` (0-based) and the word array. A row becomes up to ``max_test`` rows, so tasks grow in number
    with the rows, not in length.
    """
    tasks = ceil(df.count() * max_test / SUBSETS_PER_TASK)
    if tasks > 1:
        df = df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism))
    sized = df.withColumn("_words", words)
    total = _subset_count(F.size("_words").cast("long"), max_length)
    last = F.least(total, F.lit(max_test).cast("long")) - 1
    numbers = F.sequence(F.lit(0).cast("long"), last)
    numbered = sized.filter(F.size("_words") > 0).withColumn("subset_no", F.explode(numbers))
    return numbered.withColumn(name, _subset_words(F.col("_words"), F.col("subset_no"), max_length)).drop("_words")


def inserted_everywhere(words: Column, token: str) -> Column:
    """Array of structs ``position, words``: the token put at every position 0..n."""
    size = F.size(words)
    return F.transform(
        F.sequence(F.lit(0), size),
        lambda p: F.struct(
            p.alias("position"),
            F.concat(F.slice(words, 1, p), F.array(F.lit(token)), F.slice(words, p + 1, F.greatest(size - p, F.lit(0)))).alias("words"),
        ),
    )


def _literal_words(words: list[str]) -> Column:
    """Array literal, folded from one string instead of one expression node per word."""
    return F.split(F.lit("\x1f".join(words)), "\x1f") if words else F.array().cast("array<string>")


def expand_beams(vocabulary: DataFrame, beams: list[list[str]], word: str = "word") -> DataFrame:
    """Every beam with every word appended; the beams (checked count) are a literal array."""
    if len(beams) > MAX_BEAMS:
        raise ValueError(f"more than {MAX_BEAMS} beams")
    held = F.array(*[_literal_words(b) for b in beams])
    spread = vocabulary.select(F.col(word).alias("_w"), F.explode(held).alias("_beam"))
    return spread.select(F.array_append("_beam", F.col("_w")).alias("words"))


def substitutions(vocabulary: DataFrame, words: list[str], word: str = "word") -> DataFrame:
    """Every position of the word list replaced by every vocabulary word."""
    current = _literal_words(words)
    spread = vocabulary.select(F.col(word).alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(len(words) - 1))).alias("position"))
    changed = F.transform(current, lambda w, i: F.when(i == F.col("position"), F.col("_w")).otherwise(w))
    return spread.select("position", changed.alias("words"))


def _shuffled(words: Column, seed: int, *identity: Column) -> Column:
    keyed = F.transform(words, lambda w, i: F.struct(seeded_key(seed, *identity, i).alias("k"), w.alias("w")))
    return F.transform(F.array_sort(keyed), lambda s: s["w"])


def shuffled_copies(df: DataFrame, row_id: str, words: str, copies: int, seed: int) -> DataFrame:
    """The original word list (``copy`` 0) and its seeded shuffles."""
    spread = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    order = _shuffled(F.col(words), seed, F.col(row_id), F.col("copy"))
    return spread.withColumn(words, F.when(F.col("copy") == 0, F.col(words)).otherwise(order))


def augmented_copies(df: DataFrame, row_id: str, words: str, vocabulary: DataFrame, copies: int, seed: int) -> DataFrame:
    """The original and ``copies`` variants: shuffled, then k random positions get random words.

    1 ≤ k < max(2, ⌊n/2⌋). Replacement words are found by an equi-join on the word's position in the
    vocabulary, so the vocabulary may be of any size. Word lists of fewer than two words stay as
    they are. Needs a unique ``row_id``.
    """
    numbered = with_position(vocabulary.select("word", seeded_int("slot", "word").alias("_h")), "_h", "_slot", ["word"])
    size = vocabulary.agg(F.count(F.lit(1)).alias("n")).scalar()
    spread = shuffled_copies(df, row_id, words, copies, seed)
    identity = (F.col(row_id), F.col("copy"))
    half = F.greatest(F.floor(F.size(words) / 2), F.lit(2))
    wanted = F.when(
        (F.col("copy") > 0) & (F.size(words) > 1), 1 + F.pmod(seeded_int(f"{seed}k", *identity), half - 1)
    ).otherwise(0)
    # the k positions with the smallest keys are replaced; the rank is taken inside the row's array
    keys = F.transform(words, lambda w, i: F.struct(seeded_key(f"{seed}p", *identity, i).alias("k"), i.alias("i")))
    chosen = F.transform(F.slice(F.array_sort(keys), 1, wanted.cast("int")), lambda s: s["i"])
    cells = (
        spread.withColumn("_chosen", chosen)
        .select(*[c for c in spread.columns if c != words], "_chosen", F.posexplode_outer(words).alias("_pos", "_word"))
        .withColumn("_hit", F.array_contains("_chosen", F.col("_pos")))
        .drop("_chosen")
    )
    # unreplaced positions get spread-out slots that match nothing, not one shared null
    spread_out = -1 - F.pmod(F.xxhash64(*identity, "_pos"), F.lit(1_000_000))
    slot = F.when(F.col("_hit"), F.pmod(seeded_int(f"{seed}w", *identity, F.col("_pos")), size)).otherwise(spread_out)
    replaced = cells.withColumn("_slot", slot).join(numbered.select("_slot", F.col("word").alias("_new")), "_slot", "left")
    rest = [c for c in df.columns if c != words]
    # regrouped by row and copy: no group is longer than one row's own word list
    cell = F.when(F.col("_pos").isNotNull(), F.struct("_pos", F.coalesce("_new", "_word").alias("w")))
    ordered = F.array_sort(F.collect_list(cell))
    return replaced.groupBy(*rest, "copy").agg(F.transform(ordered, lambda s: s["w"]).alias(words))


def random_trials(spark: SparkSession, trials: int, genes: int, values: int, seed: int) -> DataFrame:
    """``trial_id, params``: random integer vectors below ``values``, duplicates pruned."""
    base = spark.range(trials).withColumnRenamed("id", "trial_id")
    params = F.array(*[F.pmod(seeded_int(seed, F.col("trial_id"), F.lit(g)), F.lit(values)).cast("int") for g in range(genes)])
    return base.withColumn("params", params).groupBy("params").agg(F.min("trial_id").alias("trial_id"))


def bitmask_trials(spark: SparkSession, trials: int, clusters: int, seed: int, block: int = 10, max_value: int = 100) -> DataFrame:
    """``trial_id, cluster, selected``: one integer in 0..max_value per block of ten clusters, as bits.

    The default range sets only the low seven bits of a block; 1023 reaches all ten.
    """
    base = spark.range(trials).withColumnRenamed("id", "trial_id")
    cells = base.withColumn("cluster", F.explode(F.sequence(F.lit(0), F.lit(clusters - 1))))
    which = F.floor(F.col("cluster") / block)
    drawn = F.pmod(seeded_int(seed, F.col("trial_id"), which), F.lit(max_value + 1))
    offset = F.pmod(F.col("cluster"), F.lit(block))
    bit = F.pmod(F.floor(drawn / F.pow(F.lit(2.0), F.lit(block - 1) - offset)), F.lit(2))
    return cells.select("trial_id", "cluster", (bit == 1).alias("selected"))


# ---------------------------------------------------------------------------------------------
# search loops


@dataclass(frozen=True)
class SearchState:
    """Beams after a step (best first) and the best of every step so far."""

    step: int
    beams: list[tuple[list[str], float, float]]
    trace: list[tuple[int, float, str]]


def _score_texts(candidates: DataFrame, corpus: Scorer, encoder: Encoder) -> DataFrame:
    if isinstance(corpus, CorpusVectors):
        # a wide tensor takes a while for each candidate: the candidates of a small file go to all cores
        count, cores = candidates.count(), candidates.sparkSession.sparkContext.defaultParallelism
        candidates = candidates.repartition(max(cores, ceil(count / TASK_CANDIDATES)))
        corpus = corpus.moments_for(count) or corpus
    if isinstance(corpus, Moments):
        scored = with_moment_score(candidates.withColumn("_vector", encoder(F.col("text"))), "_vector", corpus)
    else:
        texts = candidates.select("text").distinct().withColumn("_vector", encoder(F.col("text")))
        scores = score_in_passes(texts, corpus.rows, "text", "_vector", corpus.vector).select("text", "score")
        scored = candidates.join(scores, "text", "left")
    return scored.withColumn("score", F.round("score", SCORE_DIGITS))


def _scored(candidates: DataFrame, moments: Scorer, encoder: Encoder, render, alpha: float | None) -> DataFrame:
    text = candidates.withColumn("text", render(F.col("words")))
    scored = _score_texts(text, moments, encoder)
    return scored.withColumn("beam_score", length_penalty(F.col("score"), F.col("words"), alpha))


def beam_search(
    vocabulary: DataFrame,
    moments: Scorer,
    beam_width: int = 50,
    num_steps: int = 15,
    encoder: Encoder = encode_text,
    render: Callable[[Column], Column] = plain_text,
    alpha: float | None = None,
    resume: SearchState | None = None,
    after_step: Callable[[SearchState], None] | None = None,
    all_beams: Callable[[int, DataFrame], None] | None = None,
) -> SearchState:
    """Grow word lists one word at a time, keeping the ``beam_width`` best by beam score.

    Ties go to the smaller text. ``after_step`` may save the state, ``resume`` continues from a
    saved one, ``all_beams`` receives every step's full candidate table.
    """
    state = resume or SearchState(-1, [([], 0.0, 0.0)], [])
    for step in range(state.step + 1, num_steps):
        candidates = expand_beams(vocabulary, [b[0] for b in state.beams])
        scored = _scored(candidates, moments, encoder, render, alpha)
        if all_beams is not None:
            all_beams(step, scored)
        best = scored.orderBy(F.desc("beam_score"), "text").limit(beam_width).collect()
        if not best:  # an empty vocabulary: nothing to add
            return state
        beams = [(list(r["words"]), r["score"], r["beam_score"]) for r in best]
        state = SearchState(step, beams, [*state.trace, (step, best[0]["score"], best[0]["text"])])
        if after_step is not None:
            after_step(state)
    return state


def trace_table(spark: SparkSession, state: SearchState) -> DataFrame:
    return spark.createDataFrame(state.trace, "step int, score double, text string")


def beams_table(spark: SparkSession, state: SearchState) -> DataFrame:
    rows = [(i, *beam) for i, beam in enumerate(state.beams)]
    return spark.createDataFrame(rows, "rank int, words array<string>, score double, beam_score double")


def substitution_search(
    vocabulary: DataFrame, moments: Scorer, words: list[str], rounds: int = 5, encoder: Encoder = encode_text
) -> list[tuple[int, float, str]]:
    """Best single-word replacement per round, taken even when it scores lower than before.

    An empty vocabulary or word list has no replacement and gives an empty trace.
    """
    trace = []
    for number in range(rounds):
        scored = _scored(substitutions(vocabulary, words), moments, encoder, plain_text, None)
        found = scored.orderBy(F.desc("score"), "text", "position").limit(1).collect() if words else []
        if not found:
            return trace
        best = found[0]
        words = list(best["words"])
        trace.append((number, best["score"], best["text"]))
    return trace


SUBJECT_SLOT = "{{subject}}"


def best_subject(
    df: DataFrame, row_id: str, prompt: str, mean_prompt: Column, max_words: int = 3, max_test: int = 1000, encoder: Encoder = encode_text
) -> DataFrame:
    """Per row, the short word sequence of its own prompt that best completes the mean prompt.

    ``row_id, best_subject, score``: signed cos³ between the completed mean prompt and the row's
    prompt; the first subset in generation order wins ties. All rows are one job, and ``row_id`` is
    unique. Score and subset number are packed in one whole number, so that the choice is a hash
    aggregate over two numbers; the words are found again from the number.
    """
    base = df.select(row_id, letters_only(F.col(prompt)).alias("_prompt"))
    subsets = ordered_subsets(base.withColumn("_truth", encoder(F.col("_prompt"))), F.split("_prompt", " "), max_words, max_test)
    completed = letters_only(F.replace(mean_prompt, F.lit(SUBJECT_SLOT), F.array_join("subset", " ")))
    score = cubed_cosine(encoder(completed), F.col("_truth"), signed=True)
    places = 10**SCORE_DIGITS
    rank = -F.round(score * places).cast("long")
    packed = rank * (1 << 31) + F.col("subset_no")
    best = subsets.select(row_id, packed.alias("_packed")).groupBy(row_id).agg(F.min("_packed").alias("_packed"))
    number = F.col("_packed").bitwiseAND(F.lit((1 << 31) - 1))
    words = _subset_words(F.split("_prompt", " "), number, max_words)
    return base.join(best, row_id, "left").select(
        row_id,
        F.array_join(words, " ").alias("best_subject"),
        (F.shiftright("_packed", 31) / F.lit(-float(places))).alias("score"),
    )


def subject_position_sweep(df: DataFrame, prompt: str, subject: str, mean_words: Column, encoder: Encoder = encode_text) -> DataFrame:
    """``position, mean_score``: |cos³| with the subject put at each place of the mean prompt."""
    places = F.explode(inserted_everywhere(mean_words, SUBJECT_SLOT))
    spread = df.select(
        encoder(letters_only(F.col(prompt))).alias("_truth"), F.col(subject).alias("_subject"), places.alias("_at")
    )
    text = letters_only(F.replace(F.array_join("_at.words", " "), F.lit(SUBJECT_SLOT), F.col("_subject")))
    scored = spread.select(F.col("_at.position").alias("position"), cubed_cosine(encoder(text), F.col("_truth")).alias("score"))
    return mean_score_by(scored, ["position"]).drop("n")


def numbered_words(vocabulary: DataFrame, order: list[Column] | None = None, word: str = "word") -> tuple[DataFrame, int]:
    """``slot, word`` as a table, slots 0… in the given order (by word unless told), and the number of words."""
    ordered = vocabulary.select(F.struct(*(order or []), F.col(word)).alias("_order"), F.col(word).alias("word"))
    numbered = cut_lineage(with_position(ordered, "_order", "slot").select("slot", "word"))
    return numbered, numbered.count()


def words_at(df: DataFrame, keys: list[str], slots: str, numbered: DataFrame, words: str | None = None, name: str = "words") -> DataFrame:
    """``keys`` and the words of an array of slots, in its order; a null slot leaves the word of ``words`` there.

    Slots meet the vocabulary in a join, so it may be of any size; a group is one row's own list.
    """
    own = F.transform(slots, lambda s, i: F.struct(s.alias("slot"), (F.get(words, i) if words else F.lit(None).cast("string")).alias("own")))
    cells = df.select(*keys, F.posexplode(own).alias("_at", "_c")).select(*keys, "_at", F.col("_c.slot").alias("slot"), F.col("_c.own").alias("_own"))
    met = cells.join(numbered, "slot", "left").select(*keys, F.struct("_at", F.coalesce("word", "_own").alias("w")).alias("_cell"))
    ordered = F.array_sort(F.collect_list("_cell"))
    return met.groupBy(*keys).agg(F.transform(ordered, lambda c: c["w"]).alias(name))


def random_word_search(
    vocabulary: DataFrame, moments: Scorer, trials: int = 1000, genes: int = 7, seed: int = 0, encoder: Encoder = encode_text, order: list[Column] | None = None
) -> DataFrame:
    """All trials of a random word-set search, scored together: ``trial_id, text, score``.

    Words are drawn from all of ``vocabulary`` (column ``word``); an empty one has no trials.
    """
    numbered, size = numbered_words(vocabulary, order)
    drawn = random_trials(vocabulary.sparkSession, trials if size else 0, genes, max(1, size), seed)
    drawn = drawn.select("trial_id", F.transform("params", lambda p: p.cast("long")).alias("slots"))
    text = capitalise_sentence(F.array_join("words", " "))
    return _score_texts(words_at(drawn, ["trial_id"], "slots", numbered).select("trial_id", text.alias("text")), moments, encoder)


def population_search(
    vocabulary: DataFrame, start: DataFrame, moments: Scorer, generations: int = 100, parents: int = 5, offspring: int = 20, mutation: float = 0.5, seed: int = 0, encoder: Encoder = encode_text
) -> DataFrame:
    """Elitist mutation search over word lists: ``generation, score, text, change``.

    Every generation keeps the ``parents`` best and mutates each word of their copies with the given probability, to
    any word of ``vocabulary`` (column ``word``; an empty one mutates nothing). The population is small and fixed in
    size, so it is a literal between jobs. A start without word lists gives an empty table.
    """
    spark = start.sparkSession
    numbered, slots = numbered_words(vocabulary)
    population = start.select("words")
    trace, previous = [], 0.0
    for generation in range(generations + 1):
        scored = _scored(population, moments, encoder, plain_text, None).dropDuplicates(["text"])
        best_rows = scored.orderBy(F.desc("score"), "text").limit(parents).collect()
        if not best_rows:
            break
        top = best_rows[0]
        trace.append((generation, top["score"], top["text"], top["score"] - previous))
        previous = top["score"]
        if generation == generations:
            break
        kept = F.array(*[_literal_words(list(r["words"])) for r in best_rows])
        copies = spark.range(offspring).select(
            F.col("id").alias("_child"), F.get(kept, F.pmod("id", F.lit(len(best_rows))).cast("int")).alias("_from")
        )
        here = f"{seed}-{generation}"

        def drawn(word: Column, i: Column) -> Column:
            roll = seeded_int(f"{here}m", F.col("_child"), i) / 4294967296.0
            other = F.pmod(seeded_int(f"{here}w", F.col("_child"), i), F.lit(max(1, slots)))
            return F.when((roll < mutation) & F.lit(slots > 0), other)

        children = copies.select("_child", "_from", F.transform("_from", drawn).alias("_slots"))
        children = words_at(children, ["_child"], "_slots", numbered, "_from").select("words")
        elite = spark.range(1).select(F.explode(kept).alias("words"))
        population = elite.unionByName(children)
    return spark.createDataFrame(trace, "generation int, score double, text string, change double")


# ---------------------------------------------------------------------------------------------
# cluster-subset selection

def cluster_anchor_sums(rows: DataFrame, cluster: str, vector: str, anchors: DataFrame, anchor_id: str, anchor_vector: str) -> DataFrame:
    """``cluster, anchor, dots, cubes, n``: sums of dot and dot³ per (cluster, anchor), in one pass.

    The sums combine exactly over any set of clusters, so trials never touch the rows again. A task passes
    its sums on as soon as they have ``CELLS`` numbers, whatever the number of clusters.
    """

    def kernel(load):
        def add(batches: Batches) -> Batches:
            block = load()
            ids, wanted = block[anchor_id].to_numpy(dtype=np.int64), as_matrix(block[anchor_vector])
            if not len(ids):
                return
            sums: dict = {}

            def rows_of(sums: dict) -> Batches:
                for key, (dots, cubes, n) in sums.items():
                    columns = {"cluster": np.full(len(ids), key), "anchor": ids, "dots": dots, "cubes": cubes}
                    yield pa.RecordBatch.from_pydict({**columns, "n": np.full(len(ids), n, dtype=np.int64)})

            for batch in batches:
                batch, x = batch_vectors(batch)
                if not len(x):
                    continue
                product, keys = x @ wanted.T, batch.column("c").to_numpy()
                for key in np.unique(keys):
                    part = product[keys == key]
                    dots, cubes, n = sums.get(key, (0.0, 0.0, 0))
                    sums[key] = (dots + part.sum(0), cubes + (part**3).sum(0), n + len(part))
                if 2 * len(sums) * len(ids) > CELLS:
                    yield from rows_of(sums)
                    sums = {}
            yield from rows_of(sums)

        return add

    source = vectors_of(rows, vector, F.col(cluster).cast("long").alias("c"))
    schema = "cluster long, anchor long, dots double, cubes double, n long"
    return against_blocks(source, anchors, anchor_id, anchor_vector, kernel, schema).groupBy("cluster", "anchor").agg(
        F.sum("dots").alias("dots"), F.sum("cubes").alias("cubes"), F.sum("n").alias("n")
    )


def score_subsets(trials: DataFrame, sums: DataFrame, targets: DataFrame, penalty: float = 100.0) -> DataFrame:
    """``trial_id, kept, fit, metric`` of every trial's cluster selection.

    ``metric`` is the kept fraction of rows minus the mean squared, scaled gap between the subset's
    mean cubed similarity to each anchor and the anchor's ``target``. A trial without clusters has
    no score and drops out.
    """
    total = sums.groupBy("anchor").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).scalar()
    chosen = trials.filter("selected").select("trial_id", F.col("cluster").cast("long").alias("cluster"))
    per_anchor = chosen.join(sums, "cluster").groupBy("trial_id", "anchor").agg(
        (F.sum("cubes") / F.sum("n")).alias("score"), F.sum("n").alias("kept")
    )
    gaps = per_anchor.join(targets.select("anchor", "target"), "anchor")
    fitted = gaps.groupBy("trial_id").agg(
        F.max("kept").alias("kept"), F.avg(F.pow((F.col("score") - F.col("target")) * penalty, 2)).alias("fit")
    )
    return fitted.withColumn("metric", F.col("kept") / total - F.col("fit"))


def best_subset(scores: DataFrame, digits: int = SCORE_DIGITS) -> DataFrame:
    return scores.orderBy(F.desc(F.round("metric", digits)), "trial_id").limit(1)


def rows_of_subset(rows: DataFrame, cluster: str, trials: DataFrame, best: DataFrame) -> DataFrame:
    """Rows whose cluster the best trial selected."""
    wanted = trials.filter("selected").join(best.select("trial_id"), "trial_id", "left_semi")
    listed = wanted.select(F.col("cluster").cast("long").alias("_c")).distinct()
    return rows.withColumn("_c", F.col(cluster).cast("long")).join(listed, "_c", "left_semi").drop("_c")


def constraint_sums(sums: DataFrame, targets: DataFrame, delta: float = 1.0) -> DataFrame:
    """Per anchor: sum and mean of dot and dot³ over the rows, and whether the sum is within target ± δ."""
    per_anchor = sums.groupBy("anchor").agg(
        F.sum("dots").alias("dot_sum"), F.sum("cubes").alias("cube_sum"), F.sum("n").alias("n")
    )
    joined = per_anchor.join(targets.select("anchor", "target"), "anchor")
    low, high = F.col("target") - delta, F.col("target") + delta
    return joined.select(
        "anchor",
        "dot_sum",
        (F.col("dot_sum") / F.col("n")).alias("dot_mean"),
        "cube_sum",
        (F.col("cube_sum") / F.col("n")).alias("cube_mean"),
        F.col("dot_sum").between(low, high).alias("dot_feasible"),
        F.col("cube_sum").between(low, high).alias("cube_feasible"),
    )


def score_changes(trace: DataFrame) -> DataFrame:
    """Change of the best score from the step before; a trace has one row per step."""
    before = F.lag("score").over(Window.orderBy("step"))
    return trace.withColumn("change", F.col("score") - F.coalesce(before, F.lit(0.0)))


def longest(df: DataFrame, words: str) -> DataFrame:
    """The longest word list; ties go to the smaller text."""
    return df.orderBy(F.desc(F.size(words)), F.array_join(words, " ")).limit(1)

