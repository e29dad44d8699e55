"""Clashing column names, control characters, letters that are none, benchmarks of several passes, odd pipelines."""

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from palimpsest.llm import decontaminate, language, ngram_join, quality, toxicity
from palimpsest.llm.bpe import PrefixCounts, tokenizer_path
from palimpsest.llm.samples import _pieces
from pyspark.sql import functions as F

CLASHES = ("_", "a`b", "_place", "place", "place_", "row", "c0", "none", "text ")


@pytest.fixture
def clashing(odd_documents):
    for name in CLASHES:
        if name not in odd_documents.columns:
            odd_documents = odd_documents.withColumn(name, F.lit(f"own {name}"))
    return odd_documents


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (5, 0, 1), (6, 1, 0), (8, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def kept(before, after):
    rows = [tuple(r) for r in before.collect()]
    found = [tuple(r) for r in after.collect()]
    assert after.columns == before.columns and [f.dataType for f in after.schema] == [f.dataType for f in before.schema]
    for row in found:
        rows.remove(row)  # each row came in once
    return found


def test_filters_keep_columns_of_any_name(spark, clashing, labels):
    benchmark = spark.createDataFrame([(1, "one two three four five six seven")], "item_id long, text string")
    assert len(kept(clashing, quality.drop_low_quality(clashing, labels))) > 0
    assert len(kept(clashing, ngram_join.keep_one(clashing))) > 0
    model = toxicity.fit_toxicity(clashing, labels)
    found = kept(clashing, toxicity.drop_toxic(clashing, model))
    wanted = toxicity.toxicity_scores(clashing.select("doc_id", "text"), model).filter("predicted = 0").count()
    assert len(found) == wanted
    clean = kept(clashing, decontaminate.clean_documents(clashing, benchmark))
    assert {r[0] for r in clean} == {1, 2, 3, 4, 5, 8, 9, None}
    passes = kept(clashing, decontaminate.clean_documents(clashing, benchmark.union(spark.createDataFrame([(2, "no id at all here in this row")], benchmark.schema)), pass_bytes=10))
    assert {r[0] for r in passes} == {1, 2, 3, 4, 5, 8, 9}


def test_passes_over_a_benchmark_are_cut(spark, clashing):
    items = spark.createDataFrame([(i, f"word{i} one two three four five six seven") for i in range(6)], "item_id long, text string")
    hits = decontaminate.benchmark_hits(clashing, items, pass_bytes=60)
    plan = hits._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") <= 2 * 3  # of the last pass only, in each form of the plan
    one = decontaminate.benchmark_hits(clashing, items)
    assert sorted(map(str, hits.drop("spans").collect())) == sorted(map(str, one.drop("spans").collect()))


def test_prefix_counts_with_control_characters():
    path = tokenizer_path("byte_bpe_50k.json")
    count, library = PrefixCounts(path), Tokenizer.from_file(path)
    rng = np.random.default_rng(6)
    signs = ["a", " ", " ", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", " ", "\n", "'s", "x1"]
    texts = ["".join(rng.choice(signs, rng.integers(1, 8))) for _ in range(3000)] + ["  \x1c"]
    for text, found in zip(texts, count(texts), strict=True):
        every = library.encode_batch_fast([text[: k + 1] for k in range(len(text))], add_special_tokens=False)
        assert found.tolist() == [len(e.ids) for e in every], repr(text)


def test_signs_that_are_no_letters_have_no_language(spark):
    model = language.fit([("en", "the quick brown fox and the dog " * 5), ("fr", "le renard brun et le chien " * 5)])
    rows = spark.createDataFrame([(1, "² ½ ① ٣"), (2, "le chien"), (3, "été² fox½the")], "doc_id long, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in language.word_languages(rows, model).collect()}
    assert found[1] == "und" and found[2] == "fr"
    assert language.words_in("été² fox½the") == ["été", "fox", "the"]


def test_long_texts_give_pieces_from_all_over(spark):
    long = " ".join(f"w{i:06d}" for i in range(40_000))
    row = spark.createDataFrame([(long,), ("short",), (None,)], "text string").select(_pieces(F.col("text")).alias("p")).collect()
    found = sorted(int(w[1:]) for w in row[0]["p"].split() if len(w) == 7)
    assert 60_000 < len(row[0]["p"]) <= 65_536 + 16 and found[0] < 3_000 and found[-1] > 37_000
    assert row[1]["p"] == "short" and row[2]["p"] is None


@pytest.mark.parametrize("empty", [True, False])
def test_the_pipeline_takes_empty_and_odd_tables(spark, clashing, labels, tmp_path, empty):
    documents = clashing.drop("text ", "a`b").withColumn("lang", F.col("lang")).withColumn("source", F.lit("s"))
    for name, df in (("documents", documents), ("labels", labels), ("benchmark", spark.createDataFrame([(1, None), (2, "")], "item_id long, text string"))):
        (df.limit(0) if empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert found == [] if empty else {r["doc_id"] for r in found} <= {1, 2, 3, 4, 5, 6, 7, 8, 9, None} and len(found) > 0
