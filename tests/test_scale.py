"""Work that must spread and stay small however its input grows."""

from __future__ import annotations

from hashlib import md5

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.checks import registry
from palimpsest.checks.registry import Tables
from palimpsest.functions import vectors
from palimpsest.functions.digests import md5_with, numbered_md5
from palimpsest.operators import density, evaluate, generate, lexical, scoring, search
from palimpsest.plans.evaluation import likeliest_prompt_scores


def frame(spark, x):
    return spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "id long, v array<double>")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block_bytes", [64 * 1024 * 1024, 40 * 8 * 3])
def test_density_copies_no_vector_into_cells(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(density, "FOUND_ROWS", 50)
    x = np.random.default_rng(5).normal(size=(150, 3))
    points = frame(spark, x)
    cells = density.Cells(points, 0.6)
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= 0.6
    met = cells.meet(points, points, lambda m, a, o, b: {"id": density._ids(m), "n": density.close(a, b, 0.6).sum(axis=1)}, "id long, n long")
    if block_bytes > 1000:
        assert "CoGroup" not in plan_of(met)  # a row is not sent once for each cell it may reach
    assert {r["id"]: r["n"] for r in met.groupBy("id").agg(F.sum("n").alias("n")).collect()} == dict(enumerate(near.sum(axis=1).tolist()))
    core = near.sum(axis=1) >= 5
    label = np.where(core, np.arange(150), 999)
    for _ in range(150):
        label = np.where(core, np.where(near & core[None, :], label[None, :], 999).min(axis=1), 999)
    label = np.where(core, label, np.where(near & core[None, :], label[None, :], 999).min(axis=1))
    found = {r["id"]: r["cluster"] for r in density.density_clusters(points, "id", "v", 0.6, 5).collect()}
    assert found == {i: -1 if c == 999 else c for i, c in enumerate(label.tolist())}


def test_tokens_of_a_file_of_one_split_are_dealt_to_all_cores(spark, tmp_path):
    turns = [(c, t, ("user", "assistant")[t % 2], f"write {c} words in turn {t}") for c in range(40) for t in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"text {i}", "s") for i in range(5)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"item {i}") for i in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokens = Tables(spark, str(tmp_path)).token_logprobs
    assert tokens.count() == 80 * 3 * 6
    held = tokens.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(held) >= 8 and max(r["count"] for r in held) < 80 * 3 * 6 / 4
    # what is asked per example goes on in the task that has the example
    plan = plan_of(evaluate.lowest_nll(evaluate.mean_token_nll(tokens)))
    assert "Exchange" not in plan.split("Generate")[0]


def test_candidates_that_all_examples_share_need_no_pairs(spark):
    logprobs = spark.createDataFrame([(1, 0, -1.0), (1, 1, -2.0), (2, 0, -3.0), (2, 1, -1.0)], "example_id long, candidate_id long, logprob double")
    prompts = spark.createDataFrame([(0, "be brief"), (1, "rhyme it")], "candidate_id long, prompt string")
    truths = spark.createDataFrame([(1, "be brief"), (2, "be brief")], "example_id long, rewrite_prompt string")
    dealt = logprobs.select("example_id", "candidate_id").join(prompts, "candidate_id")
    shared, paired = (sorted(likeliest_prompt_scores(logprobs, c, truths).select("example_id", "candidate_id", "prompt", "score").collect()) for c in (prompts, dealt))
    assert shared == paired and [r["candidate_id"] for r in shared] == [0, 1]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_nearest_rows_keep_the_best_step_by_step(spark, monkeypatch, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 6))
    x[100:160] = x[100]  # ties go to the smaller id
    monkeypatch.setattr(scoring, "CELLS", 3000)
    rows = frame(spark, x).withColumn("id", F.format_string("%04d", "id") if kind == "string" else F.col("id"))
    found = scoring.nearest_rows(rows, rows, "id", "id", "v", 3).collect()
    sims = np.round(x @ x.T, 12)
    wanted = {(q, r + 1): c for q in range(300) for r, c in enumerate(np.lexsort((np.arange(300), -sims[q]))[:3])}
    assert {(int(f["query"]), f["rank"]): int(f["neighbour"]) for f in found} == wanted


def test_large_sides_meet_in_pairs_for_all_cores(spark, monkeypatch):
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 60 * 8 * 4)
    x = np.random.default_rng(9).normal(size=(100, 4))
    rows = frame(spark, x)

    def count(load):
        return lambda batches: iter([pa.RecordBatch.from_pydict({"pairs": [sum(b.num_rows for b in batches) * len(load())]})])

    seen = scoring.against_blocks(rows, rows, "id", "v", count, "pairs long").collect()
    assert sum(r["pairs"] for r in seen) == 100 * 100
    assert len(seen) >= 2 * spark.sparkContext.defaultParallelism


def test_moment_scores_hold_few_rows_at_a_time(monkeypatch):
    rng = np.random.default_rng(10)
    x, corpus = rng.normal(size=(1000, 8)), rng.normal(size=(50, 8))
    tensor = np.einsum("ni,nj,nk->ijk", corpus, corpus, corpus)
    largest = []
    matmul = np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b: largest.append(a.size) or matmul(a, b))
    monkeypatch.setattr(scoring, "CELLS", 640)
    assert np.allclose(scoring.Moments(tensor, 50).mean_cube(x), ((x @ corpus.T) ** 3).mean(axis=1))
    assert max(largest) <= 640


def test_rows_go_to_python_in_small_batches(spark):
    held = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(held)
    try:
        spark.conf.unset(held)
        lexical.tf_idf(spark.createDataFrame([(1, "one two")], "id long, text string"), "id", "text")
        assert spark.conf.get(held) == "4m"
        spark.conf.set(held, "8m")
        lexical.tf_idf(spark.createDataFrame([(1, "one two")], "id long, text string"), "id", "text")
        assert spark.conf.get(held) == "8m"
    finally:
        spark.conf.set(held, before)


def test_long_prompts_wait_in_no_hash_table(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 50 > 0, F.concat(F.lit("p"), F.col("id") % 50)).alias("prompt")).repartition(5)

    def load():
        asked = set()

        def answer(prompts):
            assert not asked.intersection(prompts) and len(set(prompts)) == len(prompts)
            asked.update(prompts)
            return [p.upper() for p in prompts]

        return answer

    made = generate.batch_generate(df, "prompt", load, wait=0.0, retries=1)
    assert "Aggregate" not in plan_of(made)
    rows = made.collect()
    assert len(rows) == 200 and all(r["error"] is None for r in rows)
    assert all(r["generated"] == (r["prompt"].upper() if r["prompt"] else None) for r in rows)


def test_subsets_grow_in_tasks(spark, monkeypatch):
    monkeypatch.setattr(search, "SUBSETS_PER_TASK", 2000)
    df = spark.range(100, numPartitions=1).select("id", F.lit("a b c d").alias("text"))
    made = search.ordered_subsets(df, F.split("text", " "))
    assert made.rdd.getNumPartitions() >= 50
    assert made.count() == 100 * (24 + 12 + 4)


def test_digests_of_many_texts_are_those_of_each():
    texts = [f"{e}#{c}#".encode() for e in (-3, 65536, 10**15) for c in (0, 9, 10, 117)] + [b"", b"x" * 50]
    for heads, numbers in ((texts, range(120)), (texts, [7, 99_999, 100_000]), ([b"x" * 55, b"y"], [4, 12]), (texts[:1], [5, 5])):
        wanted = [[int(md5(h + str(i).encode()).hexdigest()[:8], 16) for i in numbers] for h in heads]
        assert numbered_md5(heads, np.array(numbers)).tolist() == wanted
    assert numbered_md5([], np.arange(3)).shape == (0, 3)


@pytest.mark.parametrize("block", [2**15, 16, 3])
def test_tokens_are_hashed_in_blocks_of_an_example(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(registry, "TOKEN_BLOCK", block)
    monkeypatch.setattr(registry, "TASK_PAIRS", 1)
    turns = [(c, t, ("user", "assistant")[t % 2], " ".join(["w"] * (1 + 5 * c * t))) for c in range(4) for t in range(4)]
    turns += [(2, 1, "assistant", "x y"), (3, 1, "assistant", turns[13][3])]  # an example with two answers, and one whose answer comes twice
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, f"text {i}", "s") for i in range(5)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, f"item {i}") for i in range(12)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    tokens = Tables(spark, str(tmp_path)).token_logprobs
    assert "md5(" not in plan_of(tokens)  # not one digest at a time in the JVM
    wanted = []
    for c, t, _, text in turns:
        if t % 2:
            keys = [(c * 65536 + t - 1, k, pos) for k in range(12) for pos in range(1, len(text.split()) + 1)]
            wanted += [(*k, -(1 + int(md5("#".join(map(str, k)).encode()).hexdigest()[:8], 16) % 1000) / 250) for k in keys]
    assert sorted(map(tuple, tokens.collect())) == sorted(wanted)
    spark.createDataFrame([], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
    assert Tables(spark, str(tmp_path)).token_logprobs.collect() == []


def test_texts_are_hashed_together():
    words = ["", "a", "ü" * 20, "x" * 53, "x" * 54, "x" * 200, "日本語"] + [f"w{i}" * (i % 9) for i in range(500)]
    for some in (pa.array(words), pa.array(words).slice(3, 400), pa.array([], pa.string()), pa.array(words, pa.large_string())):
        assert md5_with(some, b"#1").tolist() == [list(md5(f"{w}#1".encode()).digest()) for w in some.to_pylist()]
    assert (vectors.word_matrix(pa.array(words)) == np.stack([vectors.word_vector(w) for w in words])).all()


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e-3])
def test_pairs_at_the_limit_are_measured_exactly(scale):
    x = np.random.default_rng(12).integers(0, 4, size=(300, 3)).astype(np.float64)  # many pairs exactly two apart
    x, eps = np.unique(x, axis=0) * scale + 5 * scale, 2.0 * scale
    own = ((x[:, None] - x[None, :6]) ** 2).sum(2).argmin(1)
    radius = np.array([np.linalg.norm(x[own == k] - x[k], axis=1).max() for k in range(6)])
    space = density.Space(x[:6], radius, eps)
    left, right = space.left(x), space.right(x)
    near = density.close(x, x, eps)
    row, place = space.pairs(x, left, x, right)
    assert set(zip(row.tolist(), place.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(near))))
    reached = space.reached(left, space.own(left))
    assert all(reached[i, own[j]] for i, j in zip(row, place))  # no pair is missed


def test_cells_on_the_far_side_of_the_half_way_plane_are_not_reached(spark):
    x = np.random.default_rng(13).normal(size=(2000, 12))
    points = frame(spark, x / np.linalg.norm(x, axis=1, keepdims=True))
    cells = density.Cells(points, 0.2)
    y = np.array([r["v"] for r in points.collect()])
    far = density._distances(y, cells.centres)
    before = (far - far.min(axis=1, keepdims=True) <= 2 * 0.2 + 1e-9) & (far <= cells.radius + 0.2 + 1e-9)
    held = np.bincount(far.argmin(axis=1), minlength=len(cells.centres))
    assert cells.comparisons(points, points) < 0.8 * (before * held[None, :]).sum()


def test_pieces_join_to_their_smallest_node():
    rng = np.random.default_rng(14)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    root, wanted = np.arange(400), np.arange(400)
    for at in range(0, 300, 100):
        density._hook(root, a[at : at + 100], b[at : at + 100])
    density._roots(root, np.arange(400))
    for _ in range(400):
        np.minimum.at(wanted, a, wanted[b])
        np.minimum.at(wanted, b, wanted[a])
    assert (root == wanted).all()
