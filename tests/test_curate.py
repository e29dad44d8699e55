import pytest
from pyspark.sql import functions as F

from palimpsest.operators import curate, lexical, ordering


def test_general_rule_bounds(spark):
    rows = [("o" * n, "p" * 5, "r" * 200, "s" * 5) for n in (299, 300, 2000, 2001)]
    df = spark.createDataFrame(rows, "original_text string, rewrite_prompt string, rewritten_text string, subject string")
    kept = curate.length_filter(df)
    assert sorted(len(r["original_text"]) for r in kept.collect()) == [300, 2000]
    assert curate.length_filter(df.drop("subject"), fill_subject=True).count() == 2


def test_nulls_fail_the_minimum_length(spark):
    df = spark.createDataFrame([("o" * 300, None, "r" * 200)], "original_text string, rewrite_prompt string, rewritten_text string")
    assert curate.length_filter(df).count() == 0


@pytest.mark.parametrize("salts", [1, 7, 256])
def test_cap_with_one_hot_source(spark, salts):
    df = spark.range(5000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("source"))
    keyed = df.withColumn("k", F.md5(F.col("id").cast("string")))
    got = {(r["source"], r["id"]) for r in ordering.top_per_group(keyed, ["source"], [F.col("k"), F.col("id")], 10, ["id"], salts).collect()}
    rows = sorted((r["source"], r["k"], r["id"]) for r in keyed.collect())
    expected, seen = set(), {}
    for source, _, i in rows:
        seen[source] = seen.get(source, 0) + 1
        if seen[source] <= 10:
            expected.add((source, i))
    assert got == expected


@pytest.mark.parametrize("buckets", [2, 16, 1024])
def test_positions_and_running_totals_over_skewed_values(spark, buckets):
    values = [(i, 7 if i % 3 else i * i - 500) for i in range(1000)]
    df = spark.createDataFrame(values, "id long, v long").repartition(5)
    got = {r["id"]: r["p"] for r in ordering.with_position(df, "v", "p", ["id"], buckets).collect()}
    assert got == {i: p for p, (i, _) in enumerate(sorted(values, key=lambda r: (r[1], r[0])))}
    running = {r["id"]: r["m"] for r in ordering.with_running_mean(df, "v", "id", "m", buckets).collect()}
    total = 0
    for i, v in values:
        total += v
        assert abs(running[i] - total / (i + 1)) < 1e-9


def test_shuffle_is_a_permutation_and_large_sample_agrees(spark, monkeypatch):
    df = spark.range(300)
    small = {r["id"] for r in curate.sample_rows(df, 40, 5, ["id"]).collect()}
    assert {r["id"] for r in curate.sample_rows(df, 40, 5, ["id"]).collect()} == small
    assert sorted(r["position"] for r in curate.shuffle(df, 5, ["id"]).collect()) == list(range(300))
    assert [r["id"] for r in ordering.slice_by_order(df, "id", 10, 13).orderBy("id").collect()] == [10, 11, 12]


def test_split_sizes(spark):
    split = curate.split_validation(spark.range(100), 17, 1, ["id"]).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"train": 83, "validation": 17}


def test_first_of_copies(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (9, "a")], "id long, t string")
    assert sorted(r["id"] for r in curate.first_per_key(df, ["t"], "id").collect()) == [1, 2]


def test_drop_seen_keeps_duplicates(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("a", "y")], "k string, l string")
    seen = spark.createDataFrame([("b", "z"), ("q", "y"), (None, None)], "k string, l string")
    assert [tuple(r) for r in curate.drop_seen(rows, seen, ["k", "l"]).collect()] == [("a", "x"), ("a", "x")]
    numbered = spark.createDataFrame([(0, "a", "x"), (1, "a", "x"), (2, "b", "x"), (3, "a", "y")], "id long, k string, l string")
    assert sorted(r["id"] for r in curate.drop_seen(numbered, seen, ["k", "l"], "id").collect()) == [0, 1]


def test_fan_out_missing_key(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, prompt string")
    entries = spark.createDataFrame([("a", ["x", "y"], 1), ("a", ["z"], 2)], "prompt string, variants array<string>, n int")
    table = curate.variant_table(entries, "prompt", "variants", "n")
    got = curate.fan_out(rows, table, "prompt", "variants", missing="drop").collect()
    assert sorted(r["prompt"] for r in got) == ["a", "z"]
    with pytest.raises(Exception, match="no variants for: b"):
        curate.fan_out(rows, table, "prompt", "variants").collect()


def test_subject_orders(spark):
    df = spark.createDataFrame([("a, b,c",), ("a",), ("a,b",), ("w,x,y,z",)], "subject string")
    got = [r["subject"] for r in curate.subject_orders(df).collect()]
    assert got == ["a, b, c", "a, c, b", "b, a, c", "a", "a, b", "b, a", "w, x, y, z", "w, x, z, y", "w, y, x, z"]


def test_lexicon_neighbours(spark):
    lexicon = spark.createDataFrame([("s1", "big"), ("s1", "large"), ("s2", "large"), ("s2", "huge"), ("s3", "red")], "synset string, lemma string")
    words = spark.createDataFrame([("big",), ("unknown",)], "word string")
    assert {r["word"] for r in lexical.lexicon_neighbours(words, lexicon).collect()} == {"big", "large", "unknown"}


def test_common_word_counts(spark):
    df = spark.createDataFrame([("The the cat! the",), ("a 12 cat",)], "t string")
    assert {r["word"]: r["n"] for r in lexical.word_counts(df, "t").collect()} == {"the": 3, "cat": 2, "a": 1}
    shares = {r["word"]: r["share"] for r in lexical.word_shares(df, "t").collect()}
    assert shares[""] == pytest.approx(1 / 7) and shares["the"] == pytest.approx(3 / 7)


def test_pairs_of_equal_order_follow_the_ties(spark):
    left = spark.createDataFrame([(i, 0) for i in range(20)], "a long, o long").repartition(5)
    right = spark.createDataFrame([(i, 0) for i in range(7)], "b long, p long").repartition(3)
    paired = curate.zip_by_order(left, right, "o", "p", ["a"], ["b"]).collect()
    assert sorted((r["a"], r["b"]) for r in paired) == [(i, i) for i in range(7)]
    cycled = curate.cycle_join(left, right, "o", "p", ["a"], ["b"]).collect()
    assert sorted((r["a"], r["b"]) for r in cycled) == [(i, i % 7) for i in range(20)]
    base = left.withColumn("c", F.lit("own"))
    donors = spark.createDataFrame([(i, f"d{i}") for i in range(20)], "id long, c string")
    zipped = curate.zip_shuffled(base, donors, 3, "o", ["id"], ["c"], ["a"])
    assert {r["a"]: r["c"] for r in zipped.filter("c <> 'own'").collect()} == {r["a"]: r["c"] for r in curate.zip_shuffled(base.repartition(2), donors, 3, "o", ["id"], ["c"], ["a"]).filter("c <> 'own'").collect()}
