"""Memory that workers give back between operators."""

from __future__ import annotations

import random
import sys
import tracemalloc

import numpy as np

from palimpsest.llm import common, toxicity
from palimpsest.llm.samples import labelled_texts


def test_another_operator_starts_from_freed_memory(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "forget_kept", lambda forget=common.forget_kept: calls.append(1) or forget())
    monkeypatch.delitem(sys.modules, common.WORKER_CACHE, raising=False)
    assert common.kept_in_worker("a", lambda: 1) == 1 and len(calls) == 1
    assert common.kept_in_worker("a", lambda: 2) == 1 and len(calls) == 1  # the same operator goes on with it
    assert common.kept_in_worker("b", lambda: 3) == 3 and len(calls) == 2
    held = sys.modules[common.WORKER_CACHE].__dict__
    assert held["held"] == "b" and held["value"] == 3
    common.forget_kept()
    assert "held" not in held and held["value"] is None


def test_word_scores_hold_no_words_of_the_texts_scored():
    model = toxicity.Model(np.linspace(-1, 1, toxicity.BUCKETS).astype(np.float32), 1.0, 0.0, 0.5)
    scores = toxicity.WordScores(model)
    scores.of_texts(["some words"])
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=9)) for _ in range(5_000)) for _ in range(8)]
    tracemalloc.start()
    try:
        for text in texts:
            scores.of_texts([text])
        assert tracemalloc.get_traced_memory()[0] < 500_000
        tracemalloc.reset_peak()
        scores.of_texts([" ".join(texts)])
        assert tracemalloc.get_traced_memory()[1] < 20_000_000
    finally:
        tracemalloc.stop()


def test_word_scores_do_not_depend_on_blocks_or_what_is_kept(monkeypatch):
    weights = np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32)
    rng = random.Random(6)
    signs = ["a", "B", "ß", "İ", "漢", "1", " ", " ", "\n", ",", "\x00"]
    texts = [None, "", " ", "!?", *["".join(rng.choices(signs, k=rng.randrange(60))) for _ in range(400)], "word " * 500, "x" * 900]
    model = toxicity.Model(weights, 0.7, -0.2, 0.5)

    def plain(text):
        words = toxicity.lower_words(text)
        values = [np.add.reduceat(weights[g].astype(np.float64), [0])[0] / len(g) for g in map(toxicity.subwords, words)]
        return -0.2 + 0.7 * toxicity.speakers(np.array(values)) if words else 0.5

    want = [plain(t) for t in texts]
    for block, bits in ((250_000, 18), (64, 4), (1, 1)):
        monkeypatch.setattr(toxicity.WordScores, "BLOCK", block)
        monkeypatch.setattr(toxicity.WordScores, "BITS", bits)
        scores = toxicity.WordScores(model)
        assert scores.of_texts(texts).tolist() == want == scores.of_texts(texts).tolist()


def test_a_sample_is_drawn_without_rows_from_the_driver(spark, monkeypatch):
    documents = spark.range(40).selectExpr("id as doc_id", "concat('text ', id) as text")
    labels = spark.range(40).selectExpr("id as doc_id", "cast(id % 2 as int) as label")

    def refused(*args, **kwargs):
        raise AssertionError("rows from the driver start Python workers of their own on the executors")

    monkeypatch.setattr(type(spark), "createDataFrame", refused)
    texts, counts = labelled_texts(labels, documents, "doc_id", "text", "label", 100)
    assert sorted(texts) == sorted((k % 2, f"text {k}") for k in range(40)) and counts == {0: 20, 1: 20}
