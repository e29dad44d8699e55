"""Filters, joins, deduplication, sampling and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import prompt_texts as texts
from palimpsest.checks.registry import Tables, check, rounded, sql_key, sql_letters, sql_strip, sql_words, with_views
from palimpsest.functions import templates, text as tx
from palimpsest.operators import curate, ordering
from palimpsest.plans.corpus import top_word_report, training_corpus

_KEEP = ("rewrite_id",)


def _sql_rule(rule: dict[str, tuple[int, int]], columns: tuple[str, ...]) -> str:
    return " AND ".join(f"len({sql_strip(c)}) BETWEEN {rule[c][0]} AND {rule[c][1]}" for c in columns if c in rule)


def _sql_record(rule, columns=curate.REWRITE_COLUMNS) -> str:
    texts_ = ", ".join(f"{sql_strip(c)} AS {c}" for c in columns)
    return f"SELECT rewrite_id, {texts_} FROM rewrites WHERE {_sql_rule(rule, columns)}"


@check(
    "curated_top_words",
    f"""WITH kept AS (SELECT doc_id, {sql_strip('text')} AS text FROM documents WHERE len({sql_strip('text')}) BETWEEN 300 AND 2000),
      firsts AS (SELECT min(doc_id) AS doc_id, text FROM kept GROUP BY text),
      counts AS (SELECT {sql_letters('w')} AS word, count(*) AS n
        FROM (SELECT unnest({sql_words('lower(text)')}) AS w FROM firsts) GROUP BY 1),
      shares AS (SELECT word, n, n / sum(n) OVER () AS share FROM counts),
      top20 AS (SELECT * FROM shares ORDER BY n DESC, word LIMIT 20)
    SELECT word, n, round(share, 9) AS share,
      round(sum(share) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING), 9) AS cumulative_share FROM top20""",
)
def _(t: Tables):
    report = top_word_report(t.spread_documents)
    return report.withColumns({"share": rounded("share", 9), "cumulative_share": rounded("cumulative_share", 9)})


@check("length_rule_general", with_views(_sql_record(curate.GENERAL_RULE), "rewrites"))
def _(t: Tables):
    return curate.length_filter(t.rewrites, curate.GENERAL_RULE, _KEEP)


@check(
    "length_rule_placeholder",
    with_views(
        f"""SELECT rewrite_id, {sql_strip('original_text')} AS original_text, {sql_strip('rewrite_prompt')} AS rewrite_prompt,
          {sql_strip('rewritten_text')} AS rewritten_text, '{curate.SUBJECT_PLACEHOLDER}' AS subject FROM rewrites
        WHERE {_sql_rule(curate.GENERAL_RULE, curate.REWRITE_COLUMNS[:3])}""",
        "rewrites",
    ),
)
def _(t: Tables):
    return curate.length_filter(t.rewrites.drop("subject"), curate.GENERAL_RULE, _KEEP, fill_subject=True)


@check("length_rule_training", with_views(_sql_record(curate.TRAINING_RULE), "rewrites"))
def _(t: Tables):
    return curate.length_filter(t.rewrites, curate.TRAINING_RULE, _KEEP)


@check("length_rule_source", "SELECT doc_id, text AS original_text FROM documents WHERE len(text) BETWEEN 300 AND 2000")
def _(t: Tables):
    rows = t.documents.select("doc_id", F.col("text").alias("original_text"))
    return rows.filter(curate.within(curate.SOURCE_RULE))


@check(
    "length_rule_conditioned",
    with_views(
        """SELECT rewrite_id, rewrite_prompt AS prompt FROM rewrites
        WHERE len(original_text) BETWEEN 300 AND 2000 AND len(rewrite_prompt) BETWEEN 5 AND 500""",
        "rewrites",
    ),
)
def _(t: Tables):
    rows = t.rewrites.withColumnRenamed("rewrite_prompt", "prompt")
    return rows.filter(curate.within(curate.CONDITIONED_RULE)).select("rewrite_id", "prompt")


@check(
    "length_rule_wide_table",
    with_views(
        """SELECT rewrite_id FROM rewrites
        WHERE len(original_text) BETWEEN 300 AND 2000 AND len(rewritten_text) BETWEEN 200 AND 3000""",
        "rewrites",
    ),
)
def _(t: Tables):
    return t.rewrites.filter(curate.within(curate.WIDE_TABLE_RULE)).select("rewrite_id")


@check(
    "cap_per_source",
    f"""SELECT doc_id, source FROM (SELECT doc_id, source,
        row_number() OVER (PARTITION BY source ORDER BY {sql_key(27007, 'doc_id')}, doc_id) AS r
      FROM documents WHERE len(text) BETWEEN 300 AND 3000) WHERE r <= 20""",
)
def _(t: Tables):
    return curate.cap_per_source(t.documents, "text", "source", ["doc_id"], 300, 3000, 20, 27007).select("doc_id", "source")


@check("exclusive_length", "SELECT doc_id, text FROM documents WHERE len(text) > 300 AND len(text) < 500")
def _(t: Tables):
    return curate.exclusive_length(t.documents.select("doc_id", "text"), "text")


@check(
    "short_pairs_first_20",
    with_views(
        "SELECT rewrite_id, subject FROM rewrites WHERE len(original_text) + len(rewritten_text) < 1500 ORDER BY rewrite_id LIMIT 20",
        "rewrites",
    ),
)
def _(t: Tables):
    return curate.short_pairs(t.rewrites, "rewrite_id").select("rewrite_id", "subject")


@check("shortened_only", with_views("SELECT rewrite_id FROM rewrites WHERE len(original_text) > len(rewritten_text)", "rewrites"))
def _(t: Tables):
    return curate.shortened_only(t.rewrites).select("rewrite_id")


@check(
    "rendered_length_limit",
    with_views(
        """SELECT rewrite_id, n_chars FROM (SELECT rewrite_id,
             len('<start_of_turn>user' || chr(10) || rewrite_prompt || chr(10) || original_text || '<end_of_turn>' || chr(10) ||
                 '<start_of_turn>model' || chr(10) || rewritten_text || '<end_of_turn>') AS n_chars FROM rewrites)
        WHERE n_chars < 3 * 8192""",
        "rewrites",
    ),
)
def _(t: Tables):
    rendered = templates.render(texts.CHAT_ANSWERED, prompt=F.col("rewrite_prompt"))
    sized = t.rewrites.select("rewrite_id", F.length(rendered).cast("long").alias("n_chars"))
    return sized.filter(F.col("n_chars") < 3 * 8192)


@check(
    "token_limit",
    r"""SELECT doc_id, n_tokens FROM (SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\s]')) AS n_tokens
      FROM documents) WHERE n_tokens < 2048""",
)
def _(t: Tables):
    counted = t.documents.select("doc_id", tx.regex_token_count(F.col("text")).cast("long").alias("n_tokens"))
    return curate.token_filter(counted, F.col("n_tokens"))


@check(
    "short_prompts_and_flags",
    f"""SELECT d.doc_id, len({sql_words('text')}) AS n_words FROM documents d JOIN labels l USING (doc_id)
      WHERE len({sql_words('text')}) <= 100 AND l.quality = 1""",
)
def _(t: Tables):
    words = F.size(tx.split_words(F.col("text"))).cast("long")
    joined = t.documents.join(t.labels.filter("quality = 1"), "doc_id")
    return joined.select("doc_id", words.alias("n_words")).filter("n_words <= 100")


# --- joins ----------------------------------------------------------------------------------

_NUMBER = "CAST(substr(source, 4) AS BIGINT)"


def _halves(t: Tables):
    """Documents of odd- and even-numbered sources: the held-out half and the seen half."""
    number = F.substring("source", 4, 20).cast("long")
    rows = t.documents.select(
        "doc_id", F.col("text").alias("original_text"), F.substring_index("text", "\n", 1).alias("rewrite_prompt"), "lang", number.alias("number")
    )
    return rows.filter("number % 2 = 1").drop("number"), rows.filter("number % 2 = 0").drop("number")


_HALVES = (
    f"part AS (SELECT doc_id, text AS original_text, string_split(text, chr(10))[1] AS rewrite_prompt, lang, {_NUMBER} % 2 AS odd FROM documents)",
)


@check(
    "keep_listed",
    with_views(
        "SELECT doc_id FROM part WHERE odd = 1 AND rewrite_prompt IN (SELECT rewrite_prompt FROM part WHERE odd = 0)", *_HALVES
    ),
)
def _(t: Tables):
    held, seen = _halves(t)
    return curate.keep_listed(held, seen, "rewrite_prompt").select("doc_id")


@check(
    "drop_seen",
    with_views("SELECT doc_id FROM part WHERE odd = 1 AND original_text NOT IN (SELECT original_text FROM part WHERE odd = 0)", *_HALVES),
)
def _(t: Tables):
    held, seen = _halves(t)
    return curate.drop_seen(held, seen, ["original_text"]).select("doc_id")


@check(
    "decontaminate_held_out",
    with_views(
        """SELECT doc_id FROM part p WHERE odd = 1
          AND original_text NOT IN (SELECT original_text FROM part WHERE odd = 0)
          AND rewrite_prompt NOT IN (SELECT rewrite_prompt FROM part WHERE odd = 0)
          AND lang || doc_id NOT IN (SELECT lang || (doc_id + 1) FROM part WHERE odd = 0 AND doc_id % 7 = 0)""",
        *_HALVES,
    ),
)
def _(t: Tables):
    held, seen = _halves(t)
    held = held.withColumn("rewritten_text", F.concat("lang", "doc_id"))
    shifted = F.when(F.col("doc_id") % 7 == 0, F.concat("lang", F.col("doc_id") + 1))
    seen = seen.withColumn("rewritten_text", shifted)
    return curate.drop_seen(held, seen, ["original_text", "rewritten_text", "rewrite_prompt"], "doc_id").select("doc_id")


@check(
    "fan_out_variants",
    with_views(
        """SELECT rewrite_id, rewrite_prompt FROM rewrites
        UNION ALL SELECT rewrite_id, array_to_string(list_reverse(string_split(rewrite_prompt, ' ')), ' ') FROM rewrites
        UNION ALL SELECT rewrite_id, 'Please: ' || rewrite_prompt FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    backwards = F.array_join(F.reverse(F.split("rewrite_prompt", " ")), " ")
    entries = t.rewrites.select("rewrite_id", "rewrite_prompt", F.array(backwards, F.concat(F.lit("Please: "), F.col("rewrite_prompt"))).alias("variants"))
    table = curate.variant_table(entries, "rewrite_prompt", "variants", "rewrite_id")
    return curate.fan_out(t.rewrites.select("rewrite_id", "rewrite_prompt"), table, "rewrite_prompt", "variants")


@check(
    "zip_by_order",
    with_views(
        """SELECT prompt_id, doc_id FROM (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) AS r FROM prompts)
        JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents) USING (r)""",
        "prompts",
    ),
)
def _(t: Tables):
    return curate.zip_by_order(t.prompts.select("prompt_id"), t.documents.select("doc_id"), "prompt_id", "doc_id")


@check(
    "zip_shuffled_append",
    with_views(
        f"""SELECT doc_id, source AS prompt FROM documents UNION ALL
        SELECT doc_id, rewrite_prompt FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS r FROM documents)
        JOIN (SELECT rewrite_prompt, row_number() OVER (ORDER BY {sql_key(5, 'prompt_id')}, prompt_id) AS r FROM prompts) USING (r)""",
        "prompts",
    ),
)
def _(t: Tables):
    base = t.documents.select("doc_id", F.col("source").alias("prompt"))
    donors = t.prompts.withColumnRenamed("rewrite_prompt", "prompt")
    return curate.zip_shuffled(base, donors, 5, "doc_id", ["prompt_id"], ["prompt"])


@check(
    "cycle_join",
    with_views(
        """SELECT doc_id, prompt_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % (SELECT count(*) FROM prompts) AS r FROM documents)
        JOIN (SELECT prompt_id, row_number() OVER (ORDER BY prompt_id) - 1 AS r FROM prompts) USING (r)""",
        "prompts",
    ),
)
def _(t: Tables):
    return curate.cycle_join(t.documents.select("doc_id"), t.prompts.select("prompt_id"), "doc_id", "prompt_id")


@check(
    "cluster_rows_in_subset",
    "SELECT vec_id FROM embeddings WHERE label IN (SELECT label FROM embeddings GROUP BY label HAVING count(*) % 2 = 0)",
)
def _(t: Tables):
    even = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    return curate.keep_listed(t.embeddings, even, "label").select("vec_id")


@check(
    "lookup_with_default",
    """SELECT vec_id, coalesce(split, 'train') AS split FROM embeddings
      LEFT JOIN (SELECT label, 'validation' AS split FROM embeddings GROUP BY label HAVING count(*) % 2 = 0) USING (label)""",
)
def _(t: Tables):
    even = t.embeddings.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter("n % 2 = 0")
    table = even.select("label", F.lit("validation").alias("split"))
    return curate.lookup_or(t.embeddings, table, "label", "split", "train").select("vec_id", "split")


# --- distinct, order, sampling, splits --------------------------------------------------------


@check("dense_row_id", "SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS id FROM documents")
def _(t: Tables):
    return ordering.with_position(t.documents.select("doc_id", "n_chars"), "n_chars", "id", ["doc_id"]).drop("n_chars")


@check("distinct_values", "SELECT DISTINCT text FROM documents")
def _(t: Tables):
    return curate.distinct_values(t.documents, "text")


@check("first_of_copies", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _(t: Tables):
    return curate.first_per_key(t.documents, ["text"], "doc_id").select("doc_id", "text")


@check(
    "length_funnel",
    with_views(
        """SELECT count(*) AS all_rows, count(*) FILTER (len(original_text) BETWEEN 300 AND 2000) AS after_original_text,
          count(*) FILTER (len(original_text) BETWEEN 300 AND 2000 AND len(rewritten_text) BETWEEN 200 AND 3000) AS after_rewritten_text,
          count(*) FILTER (len(original_text) BETWEEN 300 AND 2000 AND len(rewritten_text) BETWEEN 200 AND 3000
            AND len(rewrite_prompt) BETWEEN 5 AND 500) AS after_rewrite_prompt,
          count(*) FILTER (len(original_text) BETWEEN 300 AND 2000 AND len(rewritten_text) BETWEEN 200 AND 3000
            AND len(rewrite_prompt) BETWEEN 5 AND 500 AND len(subject) BETWEEN 5 AND 200) AS after_subject
        FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    return curate.length_funnel(t.rewrites, curate.GENERAL_RULE)


@check(
    "head_by_order",
    "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
)
def _(t: Tables):
    return ordering.slice_by_order(t.documents.select("doc_id", "source"), "doc_id", 0, 100)


@check("row_slice", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r >= 100 AND r < 200")
def _(t: Tables):
    return ordering.slice_by_order(t.documents.select("doc_id"), "doc_id", 100, 200)


@check(
    "union_with_source",
    """SELECT text AS rewrite_prompt, 'benchmark' AS dataset FROM benchmark
      UNION ALL SELECT text, 'turns' FROM conversations WHERE role = 'user'""",
)
def _(t: Tables):
    return curate.combine_sources(
        {"benchmark": t.benchmark.select(F.col("text").alias("rewrite_prompt")), "turns": t.prompts.select("rewrite_prompt")}
    )


@check("seeded_shuffle", f"SELECT doc_id, row_number() OVER (ORDER BY {sql_key(42, 'doc_id')}, doc_id) - 1 AS position FROM documents")
def _(t: Tables):
    return curate.shuffle(t.documents.select("doc_id"), 42, ["doc_id"])


@check("seeded_sample", f"SELECT doc_id, lang FROM documents ORDER BY {sql_key(42, 'doc_id')}, doc_id LIMIT 500")
def _(t: Tables):
    return curate.sample_rows(t.documents.select("doc_id", "lang"), 500, 42, ["doc_id"])


@check(
    "train_validation_split",
    with_views(
        f"""SELECT rewrite_id, CASE WHEN r > n - 50 THEN 'validation' ELSE 'train' END AS split FROM (
          SELECT rewrite_id, row_number() OVER (ORDER BY {sql_key(42, 'rewrite_id')}, rewrite_id) AS r, count(*) OVER () AS n
          FROM rewrites WHERE {_sql_rule(curate.TRAINING_RULE, curate.REWRITE_COLUMNS)})""",
        "rewrites",
    ),
)
def _(t: Tables):
    return training_corpus(t.rewrites, ["rewrite_id"], 50).select("rewrite_id", "split")


@check(
    "subject_permutations",
    with_views(
        """SELECT rewrite_id, subject FROM (SELECT rewrite_id, unnest(CASE len(s)
            WHEN 1 THEN [s] WHEN 2 THEN [s, [s[2], s[1]]]
            ELSE [[s[1], s[2], s[3]], [s[1], s[3], s[2]], [s[2], s[1], s[3]]] END) AS p
          FROM (SELECT rewrite_id, string_split(subject, ', ') AS s FROM rewrites)), LATERAL (SELECT array_to_string(p, ', ') AS subject)""",
        "rewrites",
    ),
)
def _(t: Tables):
    return curate.subject_orders(t.rewrites.select("rewrite_id", "subject"))


