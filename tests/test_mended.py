"""Cases that once gave wrong rows."""

import hashlib

import pytest
from pyspark.sql import functions as F, types as T

from palimpsest import prompt_texts
from palimpsest.functions.parsing import judge_flag
from palimpsest.operators import clusters, curate, density, generate, lexical, ordering
from palimpsest.sources import readers

SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "text", "more")])


def test_csv_headers_in_another_order(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,text\nd1,T1\n")
    (tmp_path / "b.csv").write_text('text,id,extra\n"T2\nsecond",d2,x\n')
    (tmp_path / "c.csv").write_text("more,text,id\nM3,T3,d3\n")
    want = [("d1", "T1", None), ("d2", "T2\nsecond", None), ("d3", "T3", "M3")]
    paths = [str(p) for p in sorted(tmp_path.glob("*.csv"))]
    assert sorted(map(tuple, readers.read_csv(spark, paths, SCHEMA).collect())) == want
    folder = readers.read_csv_folder(spark, f"{tmp_path}/*.csv", SCHEMA)
    assert sorted(tuple(r)[:3] for r in folder.collect()) == want
    assert sorted(r["source_file"].rsplit("/", 1)[1] for r in folder.collect()) == ["a.csv", "b.csv", "c.csv"]


def test_running_mean_with_gaps(spark):
    df = spark.createDataFrame([(1, None), (2, 2.0), (3, None), (4, 4.0), (4, 6.0)], "k int, v double")
    got = ordering.with_running_mean(df, "v", "k", ties=["v"]).orderBy("k", "v").collect()
    assert [r["running_mean"] for r in got] == [None, 2.0, 2.0, 3.0, 4.0]


def test_answers_of_another_length_are_a_failure(spark):
    df = spark.createDataFrame([(k, f"p{k}") for k in range(4)], "id int, p string")
    got = generate.batch_generate(df, "p", lambda: lambda prompts: ["a"] * (1 if len(prompts) == 1 else len(prompts) - 1), wait=0.0)
    assert [r["generated"] for r in got.collect()] == ["a"] * 4
    lost = generate.batch_generate(df, "p", lambda: lambda prompts: [], wait=0.0).collect()
    assert all(r["generated"] is None and "0 answers" in r["error"] for r in lost)


def test_vectors_that_are_missing(spark):
    rows = [(k, [float(k), float(k * k % 7), 1.0]) for k in range(12)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    assert [r["id"] for r in clusters.project(df, "v", 2).filter("projected is null").collect()] == [99]
    labelled, centres = clusters.kmeans(df, "v", 2)
    assert [r["id"] for r in labelled.filter("cluster is null").collect()] == [99] and centres.count() == 2
    got = {r["id"]: r["cluster"] for r in density.density_clusters(df, "id", "v", eps=0.1, min_samples=1).collect()}
    assert len(got) == 13 and got[99] == clusters.NOISE


def test_judges_that_answer_in_numbers(spark):
    rows = [('{"is_well_written": 1}', True), ('{"is_well_written": 0}', False), ('{"is_well_written": true}', True), ("x", False)]
    got = spark.createDataFrame(rows, "a string, b boolean").select(judge_flag(F.col("a")).alias("got"), "b").collect()
    assert all(r["got"] == r["b"] for r in got)


def test_tokenizer_takes_batches_and_skips_nulls(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None), (3, "")], "id int, t string")
    got = generate.token_counts(df, "t", lambda: lambda texts: [len(t.split()) for t in texts])
    assert {r["id"]: r["tokens"] for r in got.collect()} == {1: 2, 2: None, 3: 0}


def test_first_of_copies_keeps_whole_rows(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "b", 2), (2, "a", 3), (5, None, 4), (4, None, 5)], "id int, t string, x int")
    assert sorted(map(tuple, curate.first_per_key(df, ["t"], "id").collect()), key=lambda r: r[0])[:2] == [(1, "b", 2), (2, "a", 3)]


def test_terms_are_counted_inside_the_row(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None), (3, "")], "id long, t string")
    got = {(r["id"], r["term"]): r["tf"] for r in lexical.term_counts(df, "id", "t").collect()}
    assert got == {(1, "a"): 2, (1, "b"): 1} or got == {}


@pytest.mark.parametrize(
    "text, digest",
    [(prompt_texts.MERGE_SUBJECT, "b500b19861a5512b76c73c2b1331c930bca7de9a8b79eea48b39e396edf3dbcf"), (prompt_texts.MERGE_SUBJECT_POLITE, "8c86d7308e18a1856f3f255a73e8d24a228e4da58ce29ff222359105adf3a603")],
)
def test_wording_of_the_merge_prompts(text, digest):
    assert hashlib.sha256(text.encode()).hexdigest() == digest


def test_order_over_strings_and_nulls(spark):
    words = [None, "pear", "apple", "fig", "apple", None, "kiwi"]
    df = spark.createDataFrame(list(enumerate(words)), "id long, w string").repartition(3)
    got = [r["id"] for r in ordering.with_position(df, "w", "p", ["id"]).orderBy("p").collect()]
    assert got == sorted(range(len(words)), key=lambda i: (words[i] is not None, words[i] or "", i))
    assert [r["w"] for r in ordering.slice_by_order(df, "w", 4, 6, ["id"]).orderBy("w").collect()] == ["fig", "kiwi"]
