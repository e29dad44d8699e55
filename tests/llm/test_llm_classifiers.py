import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, quality, toxicity
from palimpsest.llm.registry import QUERIES

SF = "/root/testdata/sf0.1"


def test_misspellings_share_ngrams():
    shared = lambda a, b: len(set(toxicity.subwords(a)) & set(toxicity.subwords(b)))
    assert shared(b"worthless", b"worthles") > 12 > shared(b"worthless", b"pleasant") + 10


def toy_texts(n=300, seed=1):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    out = []
    for k in range(n):
        text = list(rng.choice(words, 40))
        if k % 5 == 0:
            text[int(rng.integers(40))] = "moronic"
            text[int(rng.integers(40))] = "moronical"
        out.append((int(k % 5 == 0), " ".join(text)))
    return out


def test_toxicity_finds_words_it_never_saw():
    model = toxicity.fit(toy_texts(), {0: 240, 1: 60})
    scores = toxicity.WordScores(model).of_texts(["gentle words of peace", "you moronick moronics of a kind", None, "!!!"])
    assert scores[1] > 0 > scores[0]
    assert scores[2] == scores[3] == pytest.approx(math.log(0.25))


def test_toxicity_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 0, 1), (4, 1, 0), (6, 1, 1), (7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(odd_documents, labels)
    rows = toxicity.toxicity_scores(odd_documents, model).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2, 3)}) == 1
    assert len({r["score"] for r in rows if r["doc_id"] in (6, 7)}) == 1
    assert toxicity.toxicity_scores(no_documents, toxicity.fit_toxicity(no_documents, labels)).count() == 0
    kept = toxicity.drop_toxic(odd_documents, toxicity.Model(np.zeros(toxicity.BUCKETS, np.float32), 0.0, -1.0, -1.0))
    assert kept.schema == odd_documents.schema and sorted(map(str, kept.collect())) == sorted(map(str, odd_documents.collect()))


def test_toxicity_on_held_out_documents(spark):
    scored = QUERIES["op2_toxicity"](spark, SF)
    rows = scored.join(spark.read.parquet(f"{SF}/labels.parquet").dropna(subset=["toxic"]), "doc_id").filter("held_out").collect()
    order = sorted(rows, key=lambda r: r["score"])
    places = [k for k, r in enumerate(order) if r["toxic"] == 1]
    n, clean = len(places), len(rows) - len(places)
    assert (sum(places) - n * (n - 1) / 2) / (n * clean) > 0.93
    assert sum(r["predicted"] for r in rows if r["toxic"] == 0) < 0.03 * clean
    assert sum(r["predicted"] for r in rows if r["toxic"] == 1) > 0.65 * n


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    sizes = np.array([3, 0, 1, 4])
    scores, transitions = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    marginal, expected, logs = language.forward_backward(scores, sizes, transitions)
    for start, n, found in zip(np.cumsum(sizes) - sizes, sizes, logs, strict=True):
        total, want, across = 0.0, np.zeros((n, 3)), np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = math.exp(sum(scores[start + i, y] for i, y in enumerate(path)) + sum(transitions[a, b] for a, b in itertools.pairwise(path)))
            total += weight
            for i, y in enumerate(path):
                want[i, y] += weight
            for a, b in itertools.pairwise(path):
                across[a, b] += weight
        assert np.allclose(marginal[start : start + n], want / total) and np.isclose(found, math.log(total))
        expected -= across / total
    assert np.allclose(expected, 0)


def test_words_of_a_code_switched_text(spark):
    english, french = "the house of the king and his dog was there", "la maison du roi et son chien dans le jardin"
    rows = [(k, english if k % 2 else french, "en" if k % 2 else "fr") for k in range(60)]
    model = language.fit_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = spark.createDataFrame([(1, "the king and his dog le roi et son chien")], "doc_id long, text string")
    got = language.word_languages(mixed, model).first()
    assert [(r["first"], r["last"], r["lang"]) for r in got["spans"]] == [(0, 4, "en"), (5, 9, "fr")]
    assert 0.4 < got["score"] < 0.6


def test_language_of_odd_documents(spark, odd_documents, no_documents):
    rows = language.word_languages(odd_documents, language.fit_language(odd_documents)).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == {1, 2, 3, 8}
    unknown = language.fit_language(no_documents)
    assert {r["lang_pred"] for r in language.word_languages(odd_documents, unknown).collect()} == {"und"}
    assert language.word_languages(no_documents, unknown).count() == 0


def test_language_on_held_out_documents(spark):
    found = QUERIES["op10_language_id"](spark, SF).filter("held_out")
    rows = found.join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").dropna(subset=["lang"])
    assert rows.filter("lang = lang_pred").count() > 0.99 * rows.count()


def plain_kneser_ney(texts, order):
    """Log probability of an n-gram (bytes) by the textbook formulas."""
    pad = b"\0" * (order - 1)
    top = Counter(s[i : i + order] for s in (pad + t.encode() + b"\0" for t in texts) for i in range(len(s) - order + 1))
    levels = {order: top}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])

    def discounts(counts):
        c = Counter(counts.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + 2 * c[2] else 0.5
        out = [k - (k + 1) * y * c[k + 1] / c[k] if c[k] and c[k + 1] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(d, 0.1), k) for d, k in zip(out, (1, 2, 3), strict=True)]

    cut = {k: discounts(c) for k, c in levels.items()}
    by_history = {k: defaultdict(list) for k in levels}
    for k, c in levels.items():
        for g, n in c.items():
            by_history[k][g[:-1]].append(n)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / 256
        seen = by_history[k].get(gram[:-1])
        if not seen:
            return lower
        d = lambda n: cut[k][min(n, 3) - 1] if n else 0.0
        n = levels[k][gram]
        return (n - d(n) + sum(map(d, seen)) * lower) / sum(seen)

    return p


def test_kneser_ney_against_the_formulas(spark):
    order, texts = 3, ["abracadabra", "a bra cadabra", "", "éa", "abra"]
    grams, sizes = quality.grams_of(texts, order)
    assert sizes.tolist() == [len(t.encode()) + 1 for t in texts]
    counts = Counter(grams.tolist())
    asked = sorted({*counts, *quality.grams_of(["zabrx", "ab\0"], order)[0].tolist()})
    counted = spark.createDataFrame(list(counts.items()), "gram long, n long")
    got = quality.log_probabilities(spark.createDataFrame([(g,) for g in asked], "gram long"), counted, order)
    p = plain_kneser_ney(texts, order)
    for row in got.collect():
        assert row["logp"] == pytest.approx(math.log(p(row["gram"].to_bytes(order, "big"))))
    assert sum(p(b"br" + bytes([c])) for c in range(256)) == pytest.approx(1.0)


def test_perplexities_against_the_formulas(spark):
    texts = [(k, t, "en") for k, t in enumerate(["some plain text here", "another plain text", "zzz %%% ###", None, "plain text", "some text"])]
    documents = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in (0, 1, 3, 4)] + [(2, 0), (5, 1), (5, 0)], "doc_id long, quality int")
    held = {r["id"] for r in quality.trusted_ids(labels, "doc_id", "quality").filter("held").collect()}
    p = plain_kneser_ney([t or "" for k, t, _ in texts if k in {0, 1, 3, 4} - held], quality.ORDER)
    for row in quality.perplexities(documents, labels).collect():
        raw = b"\0" * (quality.ORDER - 1) + (texts[row["id"]][1] or "").encode() + b"\0"
        logs = [math.log(p(raw[i : i + quality.ORDER])) for i in range(len(raw) - quality.ORDER + 1)]
        assert row["log_perplexity"] == pytest.approx(-sum(logs) / len(logs)) and row["n_grams"] == len(logs)


def test_quality_of_odd_documents(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(4, 1), (6, 1), (7, 0), (None, 1), (1, None)], "doc_id long, quality int")
    rows = quality.quality_scores(odd_documents, labels).collect()
    assert len(rows) == odd_documents.count() and all(r["perplexity"] > 0 for r in rows)
    kept = quality.drop_low_quality(odd_documents, labels)
    assert kept.columns == odd_documents.columns and kept.count() == sum(r["accepted"] for r in rows)
    assert quality.quality_scores(odd_documents, labels.limit(0)).filter("accepted").count() == len(rows)
    assert quality.quality_scores(no_documents, labels).count() == 0


def test_quality_keeps_trusted_and_drops_junk(spark):
    scored = QUERIES["op9_quality_classifier"](spark, "/root/testdata/sf0.01")
    rows = scored.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    share = {r["quality"]: r["share"] for r in rows.groupBy("quality").agg(F.avg(F.col("accepted").cast("int")).alias("share")).collect()}
    assert share[1] > 0.98 and share[0] < 0.2


def test_quality_thresholds_follow_one_rule_at_every_size(spark):
    def limits(n):
        rows = [(k, "big", 1 + k % 100 / 500) for k in range(1000)] + [(1000 + k, "small", 2 + k % 10 / 100) for k in range(n)]
        scored = spark.createDataFrame(rows, "id long, lang string, log_perplexity double")
        return {r["lang"]: (r["log_middle"], r["log_threshold"]) for r in quality.thresholds(scored, scored.select("id")).collect()}

    sizes = {n: limits(n) for n in (1, 10, 49, 50, 400)}
    middles = [sizes[n]["small"][0] for n in sizes]
    assert middles == sorted(middles) and sizes[1][None][0] < middles[0] and 1.9 < middles[-1] <= 2.05
    assert abs(sizes[49]["small"][1] - sizes[50]["small"][1]) < 0.05
    assert set(limits(0)) == {"big", None}
