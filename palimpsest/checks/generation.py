"""Batch inference with stand-in models, and few-shot assembly."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import functions as F

from palimpsest import prompt_texts as texts
from palimpsest.checks.registry import Tables, check, sql_int, sql_string, sql_vectors, with_views
from palimpsest.functions.templates import render
from palimpsest.operators import curate, generate, scoring
from palimpsest.plans import synthetic



def _load_counting():
    return lambda prompts: [f"{len(p)} {p[::-1]}" for p in prompts]


def _load_failing():
    """Fails on prompts with a "z"."""

    def answer(prompts):
        if any("z" in p for p in prompts):
            raise ValueError("cannot answer")
        return [str(len(p)) for p in prompts]

    return answer


@check("batch_generate", with_views("SELECT prompt_id, len(rewrite_prompt) || ' ' || reverse(rewrite_prompt) AS generated FROM prompts", "prompts"))
def _(t: Tables):
    return generate.batch_generate(t.prompts, "rewrite_prompt", _load_counting).select("prompt_id", "generated")


@check(
    "batch_generate_with_failures",
    with_views(
        """SELECT prompt_id, CASE WHEN NOT contains(rewrite_prompt, 'z') THEN CAST(len(rewrite_prompt) AS VARCHAR) END AS generated,
          CASE WHEN contains(rewrite_prompt, 'z') THEN 'ValueError: cannot answer' END AS error FROM prompts""",
        "prompts",
    ),
)
def _(t: Tables):
    answered = generate.batch_generate(t.prompts, "rewrite_prompt", _load_failing, wait=0.0)
    return answered.select("prompt_id", "generated", "error")


@check("token_counts_with_tokenizer", "SELECT doc_id, CAST(len(string_split(text, ' ')) AS INTEGER) AS tokens FROM documents")
def _(t: Tables):
    def load():
        return lambda texts: [len(text.split(" ")) for text in texts]

    return generate.token_counts(t.documents.select("doc_id", "text"), "text", load).select("doc_id", "tokens")


def _seeds(t: Tables):
    """The benchmark prompts serve as few-shot seeds."""
    return t.benchmark.select("item_id", F.col("text").alias("prompt"), F.substring_index("text", " ", 2).alias("subject"))


_SEEDS = r"seeds AS (SELECT item_id, 'Prompt: ' || text || chr(10) || 'Subject: ' || array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') || chr(10) AS shot FROM benchmark)"


def _sql_draws(k: int, seed: int) -> list[str]:
    """Draw after draw, each a rank among the positions still free."""
    views = ["draw0 AS (SELECT prompt_id, []::BIGINT[] AS taken FROM prompts)", "many AS (SELECT count(*) AS n FROM seeds)"]
    for j in range(k):
        rank = f"{sql_int(f'{seed}-{j}', 'prompt_id')} % greatest(n - {j}, 1)"
        place = f"list_reduce(list_prepend({rank}, list_sort(taken)), lambda free, p: free + CASE WHEN free >= p THEN 1 ELSE 0 END)"
        views.append(f"draw{j + 1} AS (SELECT prompt_id, CASE WHEN n > {j} THEN list_append(taken, {place}) ELSE taken END AS taken FROM draw{j}, many)")
    return views


@check(
    "random_examples",
    with_views(
        """SELECT prompt_id, string_agg(shot, chr(10) ORDER BY place) AS examples FROM (
          SELECT prompt_id, unnest(taken) AS slot, unnest(range(len(taken))) AS place FROM draw5)
          JOIN (SELECT shot, row_number() OVER (ORDER BY item_id) - 1 AS slot FROM seeds) USING (slot) GROUP BY prompt_id""",
        "prompts",
        _SEEDS,
        *_sql_draws(5, 27007),
    ),
)
def _(t: Tables):
    rows = t.prompts.select("prompt_id")
    return generate.random_examples(rows, _seeds(t), "prompt_id", "item_id", render(texts.SUBJECT_EXAMPLE), 5, 27007)


@check(
    "fixed_examples",
    with_views("SELECT prompt_id, (SELECT string_agg(shot, chr(10) ORDER BY item_id) FROM seeds) AS examples FROM prompts", "prompts", _SEEDS),
)
def _(t: Tables):
    return generate.fixed_examples(t.prompts.select("prompt_id"), _seeds(t), "item_id", render(texts.SUBJECT_EXAMPLE))


@check(
    "first_examples",
    with_views(
        """SELECT prompt_id, (SELECT string_agg(shot, '' ORDER BY item_id) FROM (SELECT * FROM seeds ORDER BY item_id LIMIT 10)) AS examples
        FROM prompts""",
        "prompts",
        _SEEDS,
    ),
)
def _(t: Tables):
    rows = t.prompts.select("prompt_id")
    return generate.fixed_examples(rows, _seeds(t), "item_id", render(texts.SUBJECT_EXAMPLE), 10, "")


@check(
    "nearest_examples",
    with_views(
        """SELECT query, string_agg(rewrite_prompt, chr(10) ORDER BY rank) AS examples FROM (
          SELECT bv.id AS query, pv.id AS neighbour,
            row_number() OVER (PARTITION BY bv.id ORDER BY round(list_dot_product(pv.v, bv.v), 12) DESC, pv.id) AS rank FROM pv, bv)
        JOIN prompts ON prompt_id = neighbour WHERE rank <= 5 GROUP BY query""",
        "prompts",
        sql_vectors("pv", "SELECT prompt_id AS id, rewrite_prompt AS text FROM prompts"),
        sql_vectors("bv", "SELECT item_id AS id, text FROM benchmark"),
    ),
)
def _(t: Tables):
    found = scoring.nearest_rows(t.benchmark_vectors, t.prompt_vectors, "id", "id", "vector", 5)
    return generate.nearest_examples(found, t.prompts, "prompt_id", F.col("rewrite_prompt"))


_TASK_SUBJECTS = texts.FREE_PROMPTS_TASK.count("subject")


@check(
    "bootstrap_prompts",
    f"""SELECT NULL AS run, 0 AS round, text AS prompt, array_to_string(list_slice(string_split(text, ' '), 1, 2), ' ') AS subject FROM benchmark
      UNION ALL SELECT run, round, 'about ' || ({_TASK_SUBJECTS} + 5 + round - 1), 'n' FROM range(2) a(run), range(1, 3) b(round)""",
)
def _(t: Tables):
    def load():
        def answer(prompts, system):
            assert system == texts.FREE_PROMPTS_SYSTEM
            # every prompt lists its examples last; the answer names how many there were
            return [f'```json [{{"prompt": "about {p.count("subject")}", "subject": "n"}}]```' for p in prompts]

        return answer

    seeds = _seeds(t).select("prompt", "subject")
    return synthetic.free_prompts(seeds, load, rounds=2, runs=2)


def _load_conditioned():
    """Answers in three labelled lines: the length of the whole input text and its last characters, backwards."""

    def answer(prompts):
        found = []
        for prompt in prompts:
            text = prompt.rsplit('Input Text:\n""""""\n', 1)[1].rsplit('\n""""""\n\n### Info', 1)[0]
            tail = "".join(c for c in text[::-1][:30] if c.isascii() and c.isalpha())
            found.append(f"Type: note\nPrompt: shorten {len(text)} {tail}\nSubject: brevity")
        return found

    return answer


@check(
    "conditioned_prompts",
    """SELECT doc_id, 'note' AS type, trim('shorten ' || len(text) || ' ' || regexp_replace(substr(reverse(text), 1, 30), '[^A-Za-z]', '', 'g')) AS prompt,
      'brevity' AS subject FROM documents WHERE len(text) >= 300 AND len(text) <= 2500""",
)
def _(t: Tables):
    sources = t.documents.filter(F.length("text").between(300, 2500)).select(
        "doc_id", F.col("text").alias("original_text"), F.col("source").alias("dataset_id")
    )
    seeds = t.benchmark.select("item_id", F.col("text").alias("original_text"), F.lit("note").alias("type"), F.lit("p").alias("prompt"), F.lit("s").alias("subject"))
    made = synthetic.conditioned_prompts(sources, "doc_id", seeds, "item_id", _load_conditioned)
    return made.select("doc_id", "type", F.trim("prompt").alias("prompt"), "subject")


def _load_rewriter():
    """Answers with a digest of the whole text and its prompt, behind an opening remark."""

    def answer(prompts):
        asked = [p.removeprefix("<start_of_turn>user\n").removesuffix("<end_of_turn>\n<start_of_turn>model\n").split("\n\n", 1) for p in prompts]
        return ["Sure:\n" + hashlib.md5((text + prompt).encode()).hexdigest() for prompt, text in asked]

    return answer


@check(
    "rewritten_texts",
    with_views(
        """SELECT rewrite_id, rewrite_prompt, md5(original_text || rewrite_prompt) AS rewritten FROM (
          SELECT rewrite_id, original_text, 'Improve: ' || dataset_id AS rewrite_prompt FROM rewrites WHERE len(original_text) BETWEEN 300 AND 2000
          UNION ALL SELECT rewrite_id, original_text, 'Please improve ' || dataset_id FROM rewrites WHERE len(original_text) BETWEEN 300 AND 2000)""",
        "rewrites",
    ),
)
def _(t: Tables):
    rows = t.rewrites.select("rewrite_id", "original_text", F.concat(F.lit("Improve: "), "dataset_id").alias("prompt"))
    entries = t.documents.select(F.concat(F.lit("Improve: "), "source").alias("prompt"), F.array(F.concat(F.lit("Please improve "), "source")).alias("variants"), "doc_id")
    table = curate.variant_table(entries, "prompt", "variants", "doc_id")
    made = synthetic.rewritten_texts(rows, table, _load_rewriter)
    return made.select("rewrite_id", "rewrite_prompt", F.col("rewritten_text").alias("rewritten"))


@check(
    "judged_records",
    with_views(
        """SELECT rewrite_id, ('0x' || substr(md5(original_text || '#' || rewritten_text || '#' || rewrite_prompt), 1, 8))::BIGINT % 3 = 0 AS is_well_written
        FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    def load():
        def answer(prompts, system):
            assert system == texts.JUDGE_SYSTEM
            found = []
            for prompt in prompts:
                # the judge's verdict is a digest of all three whole texts
                case = prompt.split('\n""""""\n', 1)[1]
                original, rest = case.split('\n""""""\n\nRewritten text:\n""""""\n', 1)
                rewritten, rest = rest.rsplit('\n""""""\n\nPrompt:\n""""""\n', 1)
                wanted = rest.rsplit('\n""""""', 1)[0]
                digest = hashlib.md5(f"{original}#{rewritten}#{wanted}".encode()).hexdigest()
                found.append('{"is_well_written": %s}' % ("true" if int(digest[:8], 16) % 3 == 0 else "false"))
            return found

        return answer

    return synthetic.judged(t.rewrites, load).select("rewrite_id", "is_well_written")


@check(
    "extracted_subjects",
    with_views("SELECT rewrite_id, md5(rewrite_prompt) AS subject FROM rewrites", "rewrites"),
)
def _(t: Tables):
    def load():
        def answer(prompts, system):
            assert system == texts.SUBJECT_SYSTEM
            return ["Subject: " + hashlib.md5(p.rsplit("\n\nPrompt: ", 1)[1].removesuffix("\nSubject: ").encode()).hexdigest() for p in prompts]

        return answer

    records = t.rewrites.drop("subject")
    return synthetic.subjects(records, _seeds(t), "item_id", load).select("rewrite_id", "subject")


@check(
    "expanded_prompts",
    with_views(
        f"""SELECT DISTINCT rewrite_prompt AS prompt, 2 AS n, {sql_string(texts.EXPANSION_SYSTEM)} || ' ' || rewrite_prompt || '|' || reverse(rewrite_prompt) AS variants
        FROM prompts WHERE len(rewrite_prompt) % 7 > 0""",
        "prompts",
    ),
)
def _(t: Tables):
    def load():
        def answer(prompts, system):
            asked = [p.split("Begin!\n\nprompt: ", 1)[1].removesuffix("\n") for p in prompts]
            # some answers cannot be parsed, and their prompts have no variants
            return [f"Here: {json.dumps({'rewritten_prompts': [f'{system} {a}', a[::-1]]})}." if len(a) % 7 else "none" for a in asked]

        return answer

    made = synthetic.expanded_prompts(t.prompts, load)
    return made.select("prompt", F.size("variants").cast("long").alias("n"), F.array_join("variants", "|").alias("variants"))
