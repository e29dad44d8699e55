"""Scores over records, likelihood choices and running means."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import prompt_texts as texts
from palimpsest.checks.registry import LOGPROBS_SQL, Tables, check, rounded, sql_key, sql_string, sql_strip, sql_vectors, sql_words, with_views
from palimpsest.functions import vectors as vx
from palimpsest.operators import evaluate, ordering, scoring
from palimpsest.plans import evaluation as plan
from palimpsest.session import cut_lineage

_PAIRS = (
    "rewrites",
    sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
    sql_vectors("b", "SELECT rewrite_id AS id, rewritten_text AS text FROM rewrites"),
    "scored AS (SELECT id, abs(list_dot_product(a.v, b.v) ** 3) AS score FROM a JOIN b USING (id))",
)


def _scored(t: Tables):
    pairs = t.rewrites.select(
        F.col("rewrite_id").alias("id"),
        vx.encode_text(F.col("rewrite_prompt")).alias("a"),
        vx.encode_text(F.col("rewritten_text")).alias("b"),
    )
    return scoring.pair_scores(pairs, "a", "b").select("id", "score")


@check("mean_score", with_views("SELECT round(avg(score), 6) AS mean_score, count(*) AS n FROM scored", *_PAIRS))
def _(t: Tables):
    return evaluate.mean_score(_scored(t)).withColumn("mean_score", rounded("mean_score"))


@check(
    "running_mean_score",
    with_views("SELECT id, round(avg(score) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM scored", *_PAIRS),
)
def _(t: Tables):
    # the scores are a finished table, not worked out again for every pass over it
    running = ordering.with_running_mean(cut_lineage(_scored(t)), "score", "id")
    return running.select("id", rounded("running_mean").alias("running_mean"))


@check(
    "running_mean_length",
    "SELECT doc_id, round(avg(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING), 6) AS running_mean FROM documents",
)
def _(t: Tables):
    running = ordering.with_running_mean(t.documents.select("doc_id", "n_chars"), "n_chars", "doc_id")
    return running.select("doc_id", rounded("running_mean").alias("running_mean"))


_NLL = "nll AS (SELECT example_id, candidate_id, -avg(logprob) AS nll FROM token_logprobs GROUP BY example_id, candidate_id)"


@check(
    "mean_token_nll",
    with_views("SELECT example_id, candidate_id, round(nll, 10) AS nll FROM nll", "rewrites", LOGPROBS_SQL, _NLL),
)
def _(t: Tables):
    return evaluate.mean_token_nll(t.token_logprobs).withColumn("nll", rounded("nll", 10))


@check(
    "lowest_nll_candidate",
    with_views(
        """SELECT example_id, candidate_id, round(nll, 10) AS nll FROM (SELECT *,
          row_number() OVER (PARTITION BY example_id ORDER BY round(nll, 9), candidate_id) AS r FROM nll) WHERE r = 1""",
        "rewrites",
        LOGPROBS_SQL,
        _NLL,
    ),
)
def _(t: Tables):
    return evaluate.lowest_nll(evaluate.mean_token_nll(t.token_logprobs)).withColumn("nll", rounded("nll", 10))


@check(
    "highest_scoring_row_per_source",
    """SELECT source, doc_id, n_chars FROM (SELECT source, doc_id, n_chars,
      row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1""",
)
def _(t: Tables):
    return evaluate.pick_row(t.documents, ["source"], [-F.col("n_chars"), F.col("doc_id")], ["doc_id", "n_chars"])


@check(
    "rerank_likeliest_by_centre",
    with_views(
        """SELECT example_id, candidate_id, round(round(d, 9), 6) AS distance FROM (
          SELECT example_id, candidate_id, d, row_number() OVER (PARTITION BY example_id ORDER BY round(d, 9), candidate_id) AS r FROM (
            SELECT k.example_id, k.candidate_id, sqrt(sum((bv.v[r.i] - m.x) ** 2)) AS d
            FROM kept k JOIN bv ON bv.id = k.candidate_id, range(1, 17) r(i) JOIN mid m ON m.i = r.i
            WHERE m.example_id = k.example_id GROUP BY k.example_id, k.candidate_id)) WHERE r = 1""",
        "rewrites",
        LOGPROBS_SQL,
        _NLL,
        sql_vectors("bv", "SELECT item_id AS id, text FROM benchmark"),
        """kept AS (SELECT example_id, candidate_id FROM (SELECT *,
          row_number() OVER (PARTITION BY example_id ORDER BY round(nll, 9), candidate_id) AS r FROM nll) WHERE r <= 15)""",
        "mid AS (SELECT example_id, r.i, avg(bv.v[r.i]) AS x FROM kept JOIN bv ON bv.id = candidate_id, range(1, 17) r(i) GROUP BY example_id, r.i)",
    ),
)
def _(t: Tables):
    nll = evaluate.mean_token_nll(t.token_logprobs)
    candidates = t.benchmark_vectors.withColumnRenamed("id", "candidate_id")
    return evaluate.rerank_by_centre(nll, candidates, 15).withColumn("distance", rounded("distance"))


_CONSTANTS = (*texts.CONSTANT_PROMPTS, texts.BASE_PREDICTION)


@check(
    "constant_prompt_scores",
    with_views(
        "SELECT c.id AS prompt_no, round(avg(abs(list_dot_product(pv.v, c.v) ** 3)), 6) AS mean_score, count(*) AS n FROM pv, c GROUP BY c.id",
        "prompts",
        sql_vectors("pv", "SELECT prompt_id AS id, rewrite_prompt AS text FROM prompts"),
        sql_vectors(
            "c", " UNION ALL ".join(f"SELECT {i} AS id, {sql_string(p)} AS text" for i, p in enumerate(_CONSTANTS))
        ),
    ),
)
def _(t: Tables):
    known = t.spark.createDataFrame(list(enumerate(_CONSTANTS)), "prompt_no int, text string")
    prompts = known.select("prompt_no", vx.encode_text(F.col("text")).alias("vector"))
    scores = evaluate.constant_prompt_scores(t.prompt_vectors, "vector", prompts, "prompt_no", "vector")
    return scores.withColumn("mean_score", rounded("mean_score"))


_HALVES = texts.PREDICTION.split("{generated}")


def _sql_prediction(answer: str) -> str:
    return f"{sql_string(_HALVES[0])} || {answer} || {sql_string(_HALVES[1])}"


@check(
    "evaluation_run",
    with_views(
        "SELECT id AS rewrite_id, round(abs(list_dot_product(a.v, p.v) ** 3), 6) AS score FROM a JOIN p USING (id)",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors(
            "p",
            f"""SELECT rewrite_id AS id, {_sql_prediction(sql_strip("string_split(rewritten_text, chr(10))[1]"))} AS text FROM rewrites""",
        ),
    ),
)
def _(t: Tables):
    scored = plan.score_generated(t.rewrites, "rewritten_text")
    return scored.select("rewrite_id", rounded("score").alias("score"))


def _load_echo():
    """A stand-in model: answers with the first line of the prompt's rewritten text."""

    def answer(prompts):
        return [p.split('Rewritten text:\n""""""\n')[1].split("\n")[0] for p in prompts]

    return answer


@check(
    "evaluation_run_with_model",
    with_views(
        "SELECT id AS rewrite_id, round(abs(list_dot_product(a.v, p.v) ** 3), 6) AS score FROM a JOIN p USING (id)",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors(
            "p",
            f"""SELECT rewrite_id AS id, {_sql_prediction(sql_strip("string_split(rewritten_text, chr(10))[1]"))} AS text FROM rewrites""",
        ),
    ),
)
def _(t: Tables):
    return plan.evaluate_model(t.rewrites, _load_echo).select("rewrite_id", rounded("score").alias("score"))


@check(
    "likeliest_prompt_scores",
    with_views(
        """SELECT example_id, candidate_id, round(abs(list_dot_product(a.v, bv.v) ** 3), 6) AS score FROM (SELECT *,
          row_number() OVER (PARTITION BY example_id ORDER BY round(nll, 9), candidate_id) AS r FROM nll) k
        JOIN a ON a.id = k.example_id JOIN bv ON bv.id = k.candidate_id WHERE r = 1""",
        "rewrites",
        LOGPROBS_SQL,
        _NLL,
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors("bv", "SELECT item_id AS id, text FROM benchmark"),
    ),
)
def _(t: Tables):
    # every example has the same candidates: their texts are not written out for each pair
    prompts = t.benchmark.select(F.col("item_id").alias("candidate_id"), F.col("text").alias("prompt"))
    truths = t.rewrites.select(F.col("rewrite_id").alias("example_id"), "rewrite_prompt")
    scored = plan.likeliest_prompt_scores(t.token_logprobs, prompts, truths)
    return scored.select("example_id", "candidate_id", rounded("score").alias("score"))


_CENTRAL = (
    "rewrites",
    LOGPROBS_SQL,
    _NLL,
    "asked AS MATERIALIZED (SELECT item_id AS id, text || ' {xxx}' AS text FROM benchmark)",
    sql_vectors("bv", "SELECT id, text FROM asked"),
    """kept AS (SELECT example_id, candidate_id FROM (SELECT *,
      row_number() OVER (PARTITION BY example_id ORDER BY round(nll, 9), candidate_id) AS r FROM nll) WHERE r <= 15)""",
    "mid AS (SELECT example_id, r.i, avg(bv.v[r.i]) AS x FROM kept JOIN bv ON bv.id = candidate_id, range(1, 17) r(i) GROUP BY example_id, r.i)",
    """chosen AS MATERIALIZED (SELECT example_id, candidate_id FROM (
      SELECT example_id, candidate_id, row_number() OVER (PARTITION BY example_id ORDER BY round(d, 9), candidate_id) AS r FROM (
        SELECT k.example_id, k.candidate_id, sqrt(sum((bv.v[r.i] - m.x) ** 2)) AS d
        FROM kept k JOIN bv ON bv.id = k.candidate_id, range(1, 17) r(i) JOIN mid m ON m.i = r.i
        WHERE m.example_id = k.example_id GROUP BY k.example_id, k.candidate_id)) WHERE r = 1)""",
    f"""worded AS (SELECT rewrite_id, coalesce((SELECT arg_min(w, {sql_key(0, "rewrite_id", "i")}) FROM (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i)), '') AS word
      FROM (SELECT rewrite_id, list_filter({sql_words("rewrite_prompt")}, lambda w: len(w) >= 5) AS ws FROM rewrites))""",
    """filled AS MATERIALIZED (SELECT example_id AS id, candidate_id, replace(text, '{xxx}', word) AS text
      FROM chosen JOIN asked a ON a.id = candidate_id JOIN worded ON rewrite_id = example_id)""",
    sql_vectors("p", "SELECT id, text FROM filled"),
    sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
)


def _central(t: Tables):
    candidates = t.benchmark.select(F.col("item_id").alias("candidate_id"), F.concat("text", F.lit(" {xxx}")).alias("prompt"))
    truths = t.rewrites.select(F.col("rewrite_id").alias("example_id"), "rewrite_prompt")
    return plan.central_likely_prompts(t.token_logprobs, candidates, truths)


@check(
    "perplexity_run",
    with_views(
        """SELECT example_id, candidate_id, text AS predicted, round(abs(list_dot_product(a.v, p.v) ** 3), 6) AS score
        FROM filled JOIN a ON a.id = filled.id JOIN p ON p.id = filled.id JOIN chosen ON example_id = filled.id""".replace(
            "example_id, candidate_id, text", "chosen.example_id, chosen.candidate_id, text"
        ),
        *_CENTRAL,
    ),
)
def _(t: Tables):
    return _central(t).withColumn("score", rounded("score"))


def _load_reader():
    """A stand-in that answers with the lengths of the case's texts and the number of examples before it."""

    def answer(prompts):
        found = []
        for prompt in prompts:
            case = prompt.rsplit('Original Text\n""""""\n', 1)[1]
            original, rest = case.split('\n""""""\n\nRewritten text:\n""""""\n', 1)
            rewritten = rest.rsplit('\n""""""\n\nPrompt:\n""""""\n', 1)[0]
            found.append(f'\n "{len(original)} {rewritten[::-1][:40]}" {prompt.count("-" * 96)}\nmore')
        return found

    return answer


_LAST_LINE = f"""{sql_strip("string_split(" + sql_strip("replace(len(original_text) || ' ' || substr(reverse(rewritten_text), 1, 40) || ' ' || {n}, '\"', '')") + ", chr(10))[1]")}"""


@check(
    "fewshot_run",
    with_views(
        "SELECT id AS rewrite_id, round(abs(list_dot_product(a.v, p.v) ** 3), 6) AS score FROM a JOIN p USING (id)",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors("p", f"SELECT rewrite_id AS id, {_sql_prediction(_LAST_LINE.replace('{n}', '3'))} AS text FROM rewrites"),
    ),
)
def _(t: Tables):
    rows = cut_lineage(t.rewrites)
    scored = plan.evaluate_fewshot(rows, rows, "rewrite_id", _load_reader, 3)
    return scored.select("rewrite_id", rounded("score").alias("score"))


@check(
    "fewshot_run_with_nearest_examples",
    with_views(
        "SELECT id AS rewrite_id, round(abs(list_dot_product(a.v, p.v) ** 3), 6) AS score FROM a JOIN p USING (id)",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors("p", f"SELECT rewrite_id AS id, {_sql_prediction(_LAST_LINE.replace('{n}', '2'))} AS text FROM rewrites"),
    ),
)
def _(t: Tables):
    rows = cut_lineage(t.rewrites)
    vectors = cut_lineage(rows.select(F.col("rewrite_id").alias("id"), vx.encode_text(F.col("original_text")).alias("vector")))
    near = scoring.nearest_rows(vectors, vectors, "id", "id", "vector", 2)
    scored = plan.evaluate_fewshot(rows, rows, "rewrite_id", _load_reader, neighbours=near)
    return scored.select("rewrite_id", rounded("score").alias("score"))


def _load_subject_reader():
    def answer(prompts):
        cases = [p.rsplit("\n#####\n\nSubject\n######", 1)[0].rsplit("Rewritten text:\n#####\n", 1)[1] for p in prompts]
        return [f"subject of {len(c)} after {p.count('Input text:') - 1}" for c, p in zip(cases, prompts, strict=True)]

    return answer


@check(
    "fewshot_subject_run",
    with_views(
        "SELECT id AS rewrite_id, round(abs(list_dot_product(a.v, p.v) ** 3), 6) AS score FROM a JOIN p USING (id)",
        "rewrites",
        sql_vectors("a", "SELECT rewrite_id AS id, rewrite_prompt AS text FROM rewrites"),
        sql_vectors(
            "p",
            """SELECT rewrite_id AS id, 'Improve rephrase text manner this written to has character in style to a subject of ' || len(rewritten_text) || ' after 4.' AS text
            FROM rewrites""",
        ),
    ),
)
def _(t: Tables):
    rows = cut_lineage(t.rewrites)
    scored = plan.evaluate_fewshot(
        rows, rows, "rewrite_id", _load_subject_reader, 4, task=texts.FEWSHOT_SUBJECT_TASK, case=texts.FEWSHOT_SUBJECT_CASE,
        example=texts.FEWSHOT_SUBJECT_EXAMPLE, template=texts.SHORT_PREDICTION,
    )
    return scored.select("rewrite_id", rounded("score").alias("score"))
