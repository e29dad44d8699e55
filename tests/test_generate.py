from pyspark.sql import functions as F

from palimpsest.operators import generate
from palimpsest.plans import synthetic


def test_failures_become_rows_and_spare_the_batch(spark):
    def load():
        calls = {"n": 0}

        def answer(prompts):
            calls["n"] += 1
            if "bad" in prompts:
                raise RuntimeError("no")
            if calls["n"] == 1:
                raise RuntimeError("first call fails")
            return [p.upper() for p in prompts]

        return answer

    df = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "ok"), (4, None)], "id long, p string").coalesce(1)
    got = {r["id"]: (r["generated"], r["error"]) for r in generate.batch_generate(df, "p", load, wait=0.0).collect()}
    assert got[1] == got[3] == ("OK", None)
    assert got[2] == (None, "RuntimeError: no") and got[4] == (None, None)


def test_kept_result_is_read_back(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id long, p string")
    out = generate.batch_generate(df, "p", lambda: lambda ps: [p * 2 for p in ps], keep_result=True)
    assert [r["generated"] for r in out.orderBy("id").collect()] == ["aa", "aa"]


def test_random_examples_are_distinct_and_repeatable(spark):
    seeds = spark.createDataFrame([(i, f"s{i}") for i in range(8)], "sid long, t string")
    rows = spark.range(20)
    drawn = generate.random_examples(rows, seeds, "id", "sid", F.col("t"), 3, 1, " ")
    first = {r["id"]: r["examples"] for r in drawn.collect()}
    assert first == {r["id"]: r["examples"] for r in drawn.repartition(7).collect()}
    assert all(len(set(e.split())) == 3 for e in first.values()) and len(set(first.values())) > 1


def test_draws_without_replacement_are_even(spark):
    n = F.lit(6).cast("bigint")
    rows = spark.range(3000).select("id", generate.drawn_positions(n, 3, 5, F.col("id")).alias("d"), generate.drawn_positions(n, 9, 5, F.col("id")).alias("all"))
    drawn = rows.collect()
    assert all(len(set(r["d"])) == 3 and set(r["d"]) <= set(range(6)) and sorted(r["all"]) == list(range(6)) for r in drawn)
    seen = {}
    for r in drawn:
        seen[tuple(r["d"])] = seen.get(tuple(r["d"]), 0) + 1
    assert len(seen) == 120 and max(seen.values()) < 60 and min(seen.values()) > 5  # 25 each on average


def test_examples_of_few_or_no_seeds(spark):
    seeds = spark.createDataFrame([(2, "b"), (1, "a")], "sid long, t string")
    rows = spark.range(3).withColumn("t", F.lit("own"))
    short = generate.random_examples(rows, seeds, "id", "sid", F.col("t"), 5, 1, " ").collect()
    assert len(short) == 3 and all(sorted(r["examples"].split()) == ["a", "b"] and r["t"] == "own" for r in short)
    assert [r["examples"] for r in generate.random_examples(rows, seeds.limit(0), "id", "sid", F.col("t"), 5, 1).collect()] == [""] * 3
    assert {r["examples"] for r in generate.fixed_examples(rows, seeds, "sid", F.col("t")).collect()} == {"a\nb"}


def test_tokenizer_and_encoder_hooks(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "c")], "id long, t string")
    counted = generate.token_counts(df, "t", lambda: lambda texts: [len(x.split()) for x in texts])
    assert [r["tokens"] for r in counted.orderBy("id").collect()] == [2, 1]
    encoded = generate.encode_with(df, "t", lambda: lambda batch: [[float(len(x))] for x in batch])
    assert [r["vector"] for r in encoded.orderBy("id").collect()] == [[3.0], [1.0]]


def test_sources_are_capped_per_source(spark):
    df = spark.range(90).select("id", F.lit("x" * 400).alias("original_text"), (F.col("id") % 3).cast("string").alias("dataset_id"))
    assert synthetic.sample_sources(df, ["id"], max_size=5).count() == 15
