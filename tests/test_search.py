from itertools import chain, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import vectors
from palimpsest.functions.vectors import encode_text
from palimpsest.operators import additive, scoring, search
from palimpsest.plans.mean_prompt import find_mean_prompt, search_vocabulary
from palimpsest.sources import writers

WORDS = ["make", "text", "better", "tone", "style", "rewrite", "this", "poem"]


@pytest.fixture(scope="module")
def corpus(spark):
    prompts = ["make this text better", "rewrite this as a poem", "improve tone and style", "this text style", "rewrite text better"]
    return spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id long, rewrite_prompt string")


@pytest.fixture(scope="module")
def moments(corpus):
    return scoring.corpus_moments(corpus.select(encode_text(F.col("rewrite_prompt")).alias("v")), "v")


@pytest.fixture(scope="module")
def vocabulary(spark):
    return spark.createDataFrame([(w,) for w in WORDS], "word string")


@pytest.mark.parametrize("max_length,max_test", [(3, 1000), (3, 7), (2, 9), (1, 3), (3, 100)])
def test_ordered_subsets_follow_permutations(spark, max_length, max_test):
    lists = [["a"], ["a", "b"], ["a", "b", "c"], list("abcde"), list("abcdefg")]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(lists)], "id long, w array<string>")
    got = search.ordered_subsets(df, F.col("w"), max_length, max_test).orderBy("id", "subset_no").collect()
    for i, words in enumerate(lists):
        every = chain.from_iterable(permutations(words, r) for r in range(1, max_length + 1))
        expected = sorted(every, key=len, reverse=True)[:max_test]
        assert [tuple(r["subset"]) for r in got if r["id"] == i] == expected


def test_insertion(spark):
    row = spark.range(1).select(search.inserted_everywhere(F.array(F.lit("x"), F.lit("y")), "T").alias("p")).first()
    assert [p["words"] for p in row["p"]] == [["T", "x", "y"], ["x", "T", "y"], ["x", "y", "T"]]


def test_beam_search_resumes_from_saved_state(spark, corpus, vocabulary, moments, tmp_path):
    path = f"{tmp_path}/state"
    whole = search.beam_search(vocabulary, moments, 3, 3)
    assert writers.load_state(spark, path) is None
    find_mean_prompt(spark, corpus, "rewrite_prompt", vocabulary, 3, 2, state_path=path)
    resumed = find_mean_prompt(spark, corpus, "rewrite_prompt", vocabulary, 3, 3, state_path=path)
    assert resumed.trace == whole.trace and [b[0] for b in resumed.beams] == [b[0] for b in whole.beams]
    # an incomplete later step is ignored
    (tmp_path / "state" / "step=00009").mkdir()
    assert writers.load_state(spark, path).step == 2


def test_best_beam_scores_again_independently(corpus, vocabulary, moments):
    state = search.beam_search(vocabulary, moments, 4, 3)
    vectors = corpus.select(encode_text(F.col("rewrite_prompt")).alias("vector"))
    again = scoring.prompt_score(encode_text(F.lit(state.trace[-1][2])), vectors).first()["score"]
    assert abs(again - state.trace[-1][1]) < 1e-8


def test_all_beams_hook_and_penalty(vocabulary, moments):
    sizes = []
    state = search.beam_search(vocabulary, moments, 2, 2, alpha=0.1, all_beams=lambda step, df: sizes.append(df.count()))
    assert sizes == [8, 16]
    words, score, beam_score = state.beams[0]
    assert beam_score < score and len(words) == 2


def test_substitution_takes_the_best_even_when_worse(vocabulary, moments):
    trace = search.substitution_search(vocabulary, moments, ["make", "make"], rounds=2)
    assert len(trace) == 2 and all(len(text.split()) == 2 for _, _, text in trace)


def test_bitmask_defaults_set_low_bits_only(spark):
    bits = search.bitmask_trials(spark, 200, 25, seed=1).filter("selected")
    assert {r["cluster"] % 10 for r in bits.collect()} <= set(range(3, 10))
    high = search.bitmask_trials(spark, 200, 25, seed=1, max_value=1023).filter("selected")
    assert {r["cluster"] % 10 for r in high.collect()} == set(range(10))


def test_random_trials_have_no_duplicates(spark):
    params = [tuple(r["params"]) for r in search.random_trials(spark, 200, 2, 3, 0).collect()]
    assert len(params) == len(set(params)) == 9


def test_known_subset_fits_perfectly(spark):
    sums = spark.createDataFrame([(c, a, 1.0, 0.1 * (c + a), 4) for c in range(3) for a in range(2)], "cluster long, anchor long, dots double, cubes double, n long")
    targets = sums.filter("cluster < 2").groupBy("anchor").agg((F.sum("cubes") / F.sum("n")).alias("target"))
    trials = spark.createDataFrame([(t, c, bool(t >> c & 1)) for t in range(8) for c in range(3)], "trial_id long, cluster int, selected boolean")
    scores = search.score_subsets(trials, sums, targets)
    best = search.best_subset(scores).first()
    assert best["trial_id"] == 3 and abs(best["fit"]) < 1e-12 and abs(best["metric"] - 2 / 3) < 1e-12
    assert 0 not in {r["trial_id"] for r in scores.collect()}


def test_augmentation_keeps_length_and_original(spark, vocabulary):
    lists = [(1, list("abcdefgh")), (2, ["one"]), (3, [])]
    df = spark.createDataFrame(lists, "id long, w array<string>")
    rows = search.augmented_copies(df, "id", "w", vocabulary, 3, 0).collect()
    assert len(rows) == 12
    for r in rows:
        original = dict(lists)[r["id"]]
        assert len(r["w"]) == len(original)
        changed = len([w for w in r["w"] if w not in original])
        assert changed == 0 if r["copy"] == 0 or len(original) < 2 else 1 <= changed < 4


def test_population_search_is_elitist(spark, vocabulary, moments):
    start = spark.createDataFrame([(["make", "text"],), (["poem", "tone"],)], "words array<string>")
    trace = search.population_search(vocabulary, start, moments, generations=3, parents=2, offspring=6).collect()
    scores = [r["score"] for r in trace]
    assert scores == sorted(scores) and len(trace) == 4
    nothing = search.population_search(vocabulary.limit(0), start, moments, generations=2, parents=2, offspring=3).collect()
    assert len(nothing) == 3 and len({r["score"] for r in nothing}) == 1
    assert search.population_search(vocabulary, start.limit(0), moments, generations=2).collect() == []


@pytest.mark.parametrize("form,stop_after,render", [(additive.plain_form, None, search.plain_text), (additive.sentence_form, 2, lambda w: search.sentence_text(w, 1 + 1))])
def test_additive_beams_are_those_of_encoded_texts(vocabulary, moments, form, stop_after, render):
    words = additive.Vocabulary(vocabulary, moments, form=form)
    for width, steps in ((1, 5), (3, 4), (50, 3)):
        # the encoded search adds the full stop where the whole text has more words than the beam may hold without
        plain = search.beam_search(vocabulary, moments, width, steps, render=render)
        found = additive.beam_search(words, width, steps, stop_after=stop_after)
        assert [(s, round(x, 8), t) for s, x, t in found.trace] == [(s, round(x, 8), t) for s, x, t in plain.trace]
        assert {tuple(b[0]) for b in found.beams} == {tuple(b[0]) for b in plain.beams}


def test_additive_substitutions_are_those_of_encoded_texts(vocabulary, moments):
    words = additive.Vocabulary(vocabulary, moments)
    start = ["make", "make", "tone", "poem"]
    assert additive.substitution_search(words, start, 4) == search.substitution_search(vocabulary, moments, start, 4)


def test_additive_search_keeps_all_beams_and_resumes(vocabulary, moments):
    words, seen = additive.Vocabulary(vocabulary, moments), []
    whole = additive.beam_search(words, 3, 4, all_beams=lambda step, df: seen.append(df.count()))
    assert seen == [8, 24, 24, 24]
    half = additive.beam_search(words, 3, 2)
    assert additive.beam_search(additive.Vocabulary(vocabulary, moments), 3, 4, resume=half) == whole


def test_searches_of_an_empty_vocabulary_end(spark, vocabulary, moments):
    none = vocabulary.limit(0)
    words = additive.Vocabulary(none, moments)
    assert additive.beam_search(words, 3, 2).trace == [] and search.beam_search(none, moments, 3, 2).trace == []
    assert additive.substitution_search(words, [], 2) == [] and search.substitution_search(none, moments, ["make"], 2) == []
    assert search.random_word_search(none, moments, 10).collect() == []


def test_words_at_slots(spark, vocabulary):
    numbered, n = search.numbered_words(vocabulary)
    rows = spark.createDataFrame([(1, [7, None, 0], ["a", "b", "c"])], "id long, s array<bigint>, w array<string>")
    assert n == 8 and search.words_at(rows, ["id"], "s", numbered, "w").first()["words"] == [sorted(WORDS)[7], "b", sorted(WORDS)[0]]


def test_vocabulary_of_corpora(spark, corpus):
    extra = spark.createDataFrame([("Extra!",), ("",)], "word string")
    words = {r["word"] for r in search_vocabulary([(corpus, "rewrite_prompt")], [extra]).collect()}
    assert {"extra", "poem", "a"} <= words and "" not in words


def _wide(text):
    """Six seeded encoders side by side: 96 components."""
    return F.concat(*[encode_text(F.concat(text, F.lit(" " + "x" * k))) for k in range(6)])


def test_search_above_the_dimension_of_moments(spark, corpus, vocabulary, monkeypatch):
    wide = scoring.CorpusVectors(corpus.select(_wide(F.col("rewrite_prompt")).alias("v")), "v")
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 8 * 96 * 5)  # candidates and corpus in several blocks
    state = search.beam_search(vocabulary, wide, 3, 2, encoder=_wide)
    texts = spark.createDataFrame([(" ".join(b[0]), b[1]) for b in state.beams], "text string, found double")
    vectors = texts.select("found", _wide(F.col("text")).alias("c")).join(wide.rows)
    cubes = F.aggregate(F.zip_with("c", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x) ** 3
    for row in vectors.groupBy("found").agg(F.avg(cubes).alias("score")).collect():
        assert abs(row["found"] - row["score"]) < 1e-8
    assert len(state.trace) == 2 and len(state.beams) == 3


def test_passes_and_moments_find_the_same_prompt(corpus, vocabulary, moments):
    rows = scoring.CorpusVectors(corpus.select(encode_text(F.col("rewrite_prompt")).alias("v")), "v")
    assert search.beam_search(vocabulary, rows, 3, 2).trace == search.beam_search(vocabulary, moments, 3, 2).trace


def test_best_subject_of_sums_is_that_of_encoded_texts(spark):
    prompts = ["make this text better", "Rewrite, this: as a poem!", "a a b", "one", "", None, "two  blanks here", "x y z w v u t s r q p o n"]
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(prompts)], "id long, p string")
    mean = "Improve the text to {{subject}} style"
    for words, most in ((3, 1000), (2, 7), (1, 2)):
        encoded = search.best_subject(rows, "id", "p", F.lit(mean), words, most).collect()
        summed = additive.best_subject(rows, "id", "p", mean, words, most).collect()
        assert sorted(map(tuple, summed)) == sorted(map(tuple, encoded))
    with pytest.raises(ValueError, match="slot"):
        additive.best_subject(rows, "id", "p", "no slot")


def test_wide_searches_add_up_moments_where_that_is_less_work(spark, monkeypatch):
    rng = np.random.default_rng(11)
    corpus = rng.normal(size=(300, 80))
    corpus /= np.linalg.norm(corpus, axis=1, keepdims=True)
    rows = spark.createDataFrame([([float(a) for a in v],) for v in corpus] + [(None,)], "v array<double>")
    base = spark.createDataFrame([(f"w{i}",) for i in range(40)] + [("w3",)], "word string")

    def wide(text):
        return F.concat(*[vectors.encode_text(F.concat(text, F.lit(" " + "x" * k))) for k in range(5)])

    def beams(held):
        state = search.beam_search(base, held, beam_width=3, num_steps=2, encoder=wide)
        return state, [b[0] for b in state.beams]

    passed, added = scoring.CorpusVectors(rows, "v"), scoring.CorpusVectors(rows, "v")
    assert passed.size == (301, 80) and passed.moments_for(10) is None
    slow = beams(passed)
    assert "moments" not in passed.__dict__  # few rows and candidates: in passes
    monkeypatch.setattr(scoring, "CUBE_PRODUCTS", 10**9)
    monkeypatch.setattr(search, "score_in_passes", None)  # not called any more
    quick = beams(added)
    assert quick[1] == slow[1] and added.moments.count == 300
    assert np.allclose([b[1] for b in quick[0].beams], [b[1] for b in slow[0].beams], atol=2e-9)
    many = 10**6
    assert scoring.CorpusVectors(spark.createDataFrame([([1.0] * 129,)], "v array<double>"), "v").moments_for(many) is None
    assert scoring.CorpusVectors(spark.createDataFrame([(None,)], "v array<double>"), "v").moments_for(many) is None
