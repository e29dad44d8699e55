"""Projections, string expressions, parsers and templates."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest import prompt_texts as texts
from palimpsest.checks.registry import (
    Tables,
    check,
    rounded,
    sql_key,
    sql_letters,
    sql_string,
    sql_strip,
    sql_words,
    with_views,
)
from palimpsest.functions import parsing, templates, text as tx
from palimpsest.operators import lexical
from palimpsest.operators.curate import SUBJECT_PLACEHOLDER, rewrite_columns, with_subject

# Padding that only a Unicode-aware strip removes.
PAD = "\u00a0 \t\u2009 \u3000"


@check("select_rewrite_columns", with_views("SELECT original_text, rewrite_prompt, rewritten_text, subject FROM rewrites", "rewrites"))
def _(t: Tables):
    return rewrite_columns(t.rewrites)


@check("subject_placeholder", f"SELECT doc_id, text, '{SUBJECT_PLACEHOLDER}' AS subject FROM documents")
def _(t: Tables):
    return with_subject(t.documents.select("doc_id", "text"))


@check("null_to_empty", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE text END AS text FROM documents")
def _(t: Tables):
    holes = F.when(F.col("doc_id") % 5 != 0, F.col("text"))
    return t.documents.select("doc_id", tx.blank_if_null(holes).alias("text"))


@check(
    "unicode_strip",
    f"SELECT doc_id, {sql_strip(f'({sql_string(PAD)} || text || {sql_string(PAD)})')} AS text FROM documents",
)
def _(t: Tables):
    padded = F.concat(F.lit(PAD), F.col("text"), F.lit(PAD))
    return t.documents.select("doc_id", tx.strip(padded).alias("text"))


@check("letters_only", f"SELECT doc_id, {sql_letters('text')} AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.letters_only(F.col("text")).alias("text"))


@check("alphanumerics_only", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N} ]', '', 'g') AS text FROM documents")
def _(t: Tables):
    return t.documents.select("doc_id", tx.alphanumerics_only(F.col("text")).alias("text"))


@check(
    "normalised_words",
    rf"""SELECT doc_id, len(w) AS n_words, array_to_string(w, ' ') AS words FROM (
      SELECT doc_id, list_filter(list_transform({sql_words('text')},
        lambda x: lower(regexp_replace(x, '[^\p{{L}}\p{{N}}]', '', 'g'))), lambda x: x <> '') AS w FROM documents)""",
)
def _(t: Tables):
    words = tx.normalised_words(F.col("text"))
    return t.documents.select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.array_join("w", " ").alias("words")
    )


@check(
    "drop_mixed_tokens",
    r"""SELECT doc_id, array_to_string(list_filter(string_split(text, ' '),
        lambda w: regexp_full_match(w, '[\p{L}\p{N}]+')), ' ') AS text FROM documents""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.drop_mixed_tokens(F.col("text")).alias("text"))


@check(
    "literal_replacements",
    "SELECT doc_id, replace(replace(replace(text, '. ', '.<br /><br />'), '– ', ''), '<br /><br />', chr(10)) AS text FROM documents",
)
def _(t: Tables):
    marked = F.replace(F.col("text"), F.lit(". "), F.lit(".<br /><br />"))
    return t.documents.select("doc_id", tx.replace_literals(marked, {"– ": "", "<br /><br />": "\n"}).alias("text"))


@check(
    "text_head",
    f"""SELECT doc_id, coalesce({sql_strip("array_to_string(list_slice(rest, 1, kept), chr(10))")}, '') AS text FROM (
      SELECT doc_id, rest, coalesce(list_min(list_filter(range(1, len(rest) + 1),
        lambda k: len(array_to_string(list_slice(rest, 1, k), chr(10))) >= 300)), len(rest)) AS kept
      FROM (SELECT doc_id, list_slice(string_split(text, chr(10)), 2, len(string_split(text, chr(10)))) AS rest FROM documents))""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.head_lines(F.col("text"), 300).alias("text"))


@check(
    "lines_to_first_long",
    f"""SELECT doc_id, {sql_strip("array_to_string(list_slice(lines, 1, kept), chr(10))")} AS text FROM (
      SELECT doc_id, lines, coalesce(list_min(list_filter(range(1, len(lines) + 1),
        lambda k: 2 * len(lines[k]) - 1 >= 400)), len(lines)) AS kept
      FROM (SELECT doc_id, string_split({sql_strip('text')}, chr(10)) AS lines FROM documents))""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.lines_to_first_long(F.col("text"), 400).alias("text"))


ANSWERS_SQL = """answers AS (
  SELECT rewrite_id, CASE WHEN rewrite_id % 2 = 0 THEN ' Sure, here it is:' || chr(10) || rewritten_text
                          ELSE rewritten_text END AS answer FROM rewrites)"""


@check(
    "drop_opening_remark",
    with_views(
        f"""SELECT rewrite_id, CASE WHEN starts_with(lower({sql_strip('answer')}), 'sure')
          THEN CASE WHEN contains({sql_strip('answer')}, chr(10))
               THEN {sql_strip(f"substr({sql_strip('answer')}, instr({sql_strip('answer')}, chr(10)) + 1)")} ELSE '' END
          ELSE {sql_strip('answer')} END AS answer FROM answers""",
        "rewrites",
        ANSWERS_SQL,
    ),
)
def _(t: Tables):
    remark = F.concat(F.lit(" Sure, here it is:\n"), F.col("rewritten_text"))
    answer = F.when(F.col("rewrite_id") % 2 == 0, remark).otherwise(F.col("rewritten_text"))
    return t.rewrites.select("rewrite_id", parsing.drop_opening_remark(answer).alias("answer"))


@check(
    "first_answer_line",
    with_views(
        f"""SELECT rewrite_id, {sql_strip("string_split(replace(rewritten_text, ',', ''), chr(10))[1]")} AS answer
        FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    return t.rewrites.select("rewrite_id", parsing.first_line(F.col("rewritten_text"), (",",)).alias("answer"))


@check(
    "parse_labelled_fields",
    with_views(
        f"""SELECT rewrite_id, CASE WHEN ok THEN string_split(l[1], ': ')[2] ELSE '' END AS type,
          CASE WHEN ok THEN string_split(l[2], ': ')[2] ELSE '' END AS prompt,
          CASE WHEN ok THEN string_split(l[3], ': ')[2] ELSE '' END AS subject
        FROM (SELECT rewrite_id, l, len(l) >= 3 AND contains(l[1], ': ') AND contains(l[2], ': ') AND contains(l[3], ': ') AS ok
          FROM (SELECT rewrite_id, list_filter(string_split({sql_strip("replace(answer, '### Info', '')")}, chr(10)),
                lambda x: {sql_strip('x')} <> '') AS l
            FROM (SELECT rewrite_id, '### Info' || chr(10) || 'Type: ' || dataset_id || chr(10) || chr(10) || 'Prompt: ' ||
                  rewrite_prompt || chr(10) || CASE WHEN rewrite_id % 3 = 0 THEN '' ELSE 'Subject: ' || subject || ': x' END AS answer
                  FROM rewrites)))""",
        "rewrites",
    ),
)
def _(t: Tables):
    tail = F.when(F.col("rewrite_id") % 3 == 0, "").otherwise(F.concat(F.lit("Subject: "), F.col("subject"), F.lit(": x")))
    answer = F.concat(
        F.lit("### Info\nType: "), F.col("dataset_id"), F.lit("\n\nPrompt: "), F.col("rewrite_prompt"), F.lit("\n"), tail
    )
    return t.rewrites.select("rewrite_id", parsing.labelled_fields(answer).alias("f")).select("rewrite_id", "f.*")


@check(
    "parse_subject_answer",
    with_views(
        f"SELECT rewrite_id, {sql_strip(chr(39) + ' ' + chr(39) + ' || subject')} AS subject FROM rewrites", "rewrites"
    ),
)
def _(t: Tables):
    answer = F.concat(F.lit("Subject: "), F.col("subject"))
    return t.rewrites.select("rewrite_id", parsing.subject_answer(answer).alias("subject"))


@check(
    "parse_fenced_prompt_list",
    with_views(
        """SELECT prompt_id, replace(replace(rewrite_prompt, 'json', ''), '```', '') AS prompt, 's' || prompt_id AS subject
        FROM prompts WHERE prompt_id % 4 <> 0
        UNION ALL SELECT prompt_id, 'again', 'twice' FROM prompts WHERE prompt_id % 4 <> 0""",
        "prompts",
    ),
)
def _(t: Tables):
    entry = F.struct(F.col("rewrite_prompt").alias("prompt"), F.concat(F.lit("s"), F.col("prompt_id")).alias("subject"))
    again = F.struct(F.lit("again").alias("prompt"), F.lit("twice").alias("subject"))
    listed = F.concat(F.lit("```json\n"), F.to_json(F.array(entry, again)), F.lit("\n```"))
    answer = F.when(F.col("prompt_id") % 4 == 0, F.concat(F.lit("I cannot: "), F.col("rewrite_prompt"))).otherwise(listed)
    rows = t.prompts.select("prompt_id", F.explode(parsing.fenced_prompt_list(answer)).alias("p"))
    return rows.select("prompt_id", "p.prompt", "p.subject")


def _chat_json(t: Tables):
    """Answers with a JSON object between other text; raw line breaks inside; every third has none."""
    record = F.replace(F.to_json(F.struct(F.col("rewrite_prompt").alias("prompt"), F.col("subject"))), F.lit("\\n"), F.lit("\n"))
    whole = F.concat(F.lit("Here you go {"), F.substring(record, 2, tx.REST), F.lit(" thanks"))
    return t.rewrites.select("rewrite_id", F.when(F.col("rewrite_id") % 3 == 0, "none").otherwise(whole).alias("answer"))


@check(
    "parse_embedded_json",
    with_views(
        """SELECT rewrite_id, CASE WHEN rewrite_id % 3 <> 0 THEN rewrite_prompt END AS prompt,
             CASE WHEN rewrite_id % 3 <> 0 THEN subject END AS subject FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    parsed = parsing.embedded_json(F.col("answer"), "prompt string, subject string")
    return _chat_json(t).select("rewrite_id", parsed.alias("p")).select("rewrite_id", "p.prompt", "p.subject")


@check(
    "prompt_or_default",
    with_views(
        f"""SELECT rewrite_id, CASE WHEN rewrite_id % 3 <> 0 THEN rewrite_prompt ELSE '{parsing.DEFAULT_PROMPT}' END AS prompt
        FROM rewrites""",
        "rewrites",
    ),
)
def _(t: Tables):
    return _chat_json(t).select("rewrite_id", parsing.prompt_or_default(F.col("answer")).alias("prompt"))


@check("judge_flag", "SELECT doc_id, CASE WHEN toxic = 1 THEN false ELSE quality = 1 END AS is_well_written FROM labels")
def _(t: Tables):
    answer = F.when(F.col("toxic") == 1, "{}").otherwise(
        F.concat(F.lit('{"is_well_written": '), (F.col("quality") == 1).cast("string"), F.lit("}"))
    )
    return t.labels.select("doc_id", parsing.judge_flag(answer).alias("is_well_written"))


@check(
    "training_pair_json",
    with_views("SELECT rewrite_id, original_text, rewritten_text, rewrite_prompt AS prompt, subject FROM rewrites", "rewrites"),
)
def _(t: Tables):
    given, wanted = templates.training_record()
    pairs = t.rewrites.select("rewrite_id", given.alias("input"), wanted.alias("output"))
    read_input = F.from_json("input", "original_text string, rewritten_text string")
    read_output = F.from_json("output", "prompt string, subject string")
    return pairs.select("rewrite_id", read_input.alias("i"), read_output.alias("o")).select("rewrite_id", "i.*", "o.*")


def _sql_filled(template: str, columns: dict[str, str]) -> str:
    """SQL concatenation with the named columns between the literal pieces of a template."""
    pieces, rest = [], template
    while rest:
        spots = [(rest.find("{" + c + "}"), c) for c in columns if "{" + c + "}" in rest]
        if not spots:
            pieces.append(sql_string(rest))
            break
        at, name = min(spots)
        if at:
            pieces.append(sql_string(rest[:at]))
        pieces.append(columns[name])
        rest = rest[at + len(name) + 2 :]
    return "(" + " || ".join(pieces) + ")"


_RECORD = {c: c for c in ("original_text", "rewritten_text", "rewrite_prompt", "subject")}


def _template_check(name: str, template: str, **extra: str):
    """A query that renders one template for every rewrite record."""
    columns = {**_RECORD, **extra}

    @check(name, with_views(f"SELECT rewrite_id, {_sql_filled(template, columns)} AS rendered FROM rewrites", "rewrites"))
    def _(t: Tables):
        values = {c: F.expr(sql) for c, sql in extra.items()}
        return t.rewrites.select("rewrite_id", templates.render(template, **values).alias("rendered"))


_template_check("template_subject_task", texts.SUBJECT_TASK)
_template_check("template_quality_task", texts.QUALITY_TASK)
_template_check("template_prompt_task", texts.PROMPT_TASK)
_template_check("template_json_task", texts.JSON_TASK, input="dataset_id")
_template_check("template_merge_subject", texts.MERGE_SUBJECT)
_template_check("template_merge_subject_polite", texts.MERGE_SUBJECT_POLITE)
_template_check("template_rewrite_request", texts.CHAT_TURN.replace("{prompt}", texts.REWRITE_REQUEST))
_template_check("template_chat_indented", texts.CHAT_TURN_INDENTED.replace("{prompt}", texts.REWRITE_REQUEST_ONE_LINE))
_template_check("template_chat_quoted", texts.CHAT_QUOTED_TEXT, prompt="rewrite_prompt")
_template_check("template_chat_answered", texts.CHAT_ANSWERED, prompt="rewrite_prompt")
_template_check("template_quoted_request", texts.QUOTED_REQUEST, prompt="rewrite_prompt")
_template_check("template_train_subject", texts.TRAIN_SUBJECT)
_template_check("template_train_prompt_and_subject", texts.TRAIN_PROMPT_AND_SUBJECT)
_template_check("template_train_json_subject", texts.TRAIN_JSON_SUBJECT, input="original_text", output="subject")
_template_check("template_train_json_both", texts.TRAIN_JSON_BOTH, input="original_text", output="subject")
_template_check("template_fewshot_example", texts.FEWSHOT_EXAMPLE)
_template_check("template_fewshot_subject_example", texts.FEWSHOT_SUBJECT_EXAMPLE)
_template_check("template_fewshot_task", texts.FEWSHOT_TASK, examples="subject", case="original_text")
_template_check("template_free_prompts", texts.FREE_PROMPTS_TASK, examples="subject")
_template_check("template_conditioned", texts.CONDITIONED_TASK, examples="subject")
_template_check("template_expansion", texts.EXPANSION_TASK, num_prompts="'4'")
_template_check("template_judge", texts.JUDGE_TASK)
_template_check("template_subject_extraction", texts.SUBJECT_EXTRACTION_TASK, examples="dataset_id")
_template_check("template_prediction", texts.PREDICTION, generated="subject")


@check(
    "fill_subject_slot",
    with_views("SELECT rewrite_id, 'rewrite ' || subject || ' as ' || subject AS prediction FROM rewrites", "rewrites"),
)
def _(t: Tables):
    filled = templates.fill_slot("rewrite {{subject}} as {{subject}}", "{{subject}}", F.col("subject"))
    return t.rewrites.select("rewrite_id", filled.alias("prediction"))


@check(
    "capitalised_sentence",
    with_views("SELECT prompt_id, upper(substr(rewrite_prompt, 1, 1)) || substr(rewrite_prompt, 2) || '.' AS sentence FROM prompts", "prompts"),
)
def _(t: Tables):
    return t.prompts.select("prompt_id", tx.capitalise_sentence(F.col("rewrite_prompt")).alias("sentence"))


@check("constant_prediction", with_views(f"SELECT prompt_id, {sql_string(texts.CONSTANT_PROMPTS[0])} AS pred FROM prompts", "prompts"))
def _(t: Tables):
    return t.prompts.select("prompt_id", F.lit(texts.CONSTANT_PROMPTS[0]).alias("pred"))


@check("rename_prompt", with_views("SELECT prompt_id, rewrite_prompt AS prompt FROM prompts", "prompts"))
def _(t: Tables):
    return t.prompts.withColumnRenamed("rewrite_prompt", "prompt")


@check(
    "random_word",
    f"""SELECT doc_id, (SELECT arg_min(w, {sql_key(7, 'doc_id', 'i')}) FROM
          (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i)) AS word
        FROM (SELECT doc_id, list_filter({sql_words('text')}, lambda w: len(w) >= 5) AS ws FROM documents)""",
)
def _(t: Tables):
    return t.documents.select("doc_id", tx.pick_word(F.col("text"), 7, F.col("doc_id")).alias("word"))


@check(
    "text_shape",
    r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: regexp_matches(s, '[\p{L}\p{N}]'))) AS sentences,
          round(len(array_to_string(w, '')) / len(w), 6) AS mean_word_length
        FROM (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS w FROM documents)""",
)
def _(t: Tables):
    return t.documents.select(
        "doc_id",
        tx.sentence_count(F.col("text")).cast("long").alias("sentences"),
        rounded(tx.mean_word_length(F.col("text"))).alias("mean_word_length"),
    )


LEXICON_SQL = f"""lexicon AS (SELECT DISTINCT word, ('0x' || substr(md5(word), 1, 4))::BIGINT / 32768::DOUBLE - 1 AS polarity
  FROM (SELECT {sql_letters('w')} AS word FROM (SELECT unnest({sql_words('text')}) AS w FROM benchmark)) WHERE word <> '')"""


@check(
    "sentiment_polarity",
    with_views(
        f"""SELECT doc_id, round(avg(polarity), 6) AS polarity FROM documents LEFT JOIN (
          SELECT id, polarity FROM (SELECT id, {sql_letters('w')} AS word FROM (SELECT doc_id AS id, unnest({sql_words('text')}) AS w FROM documents))
          JOIN lexicon USING (word)) ON id = doc_id GROUP BY doc_id""",
        LEXICON_SQL,
    ),
)
def _(t: Tables):
    words = lexical.word_counts(t.benchmark, "text").select("word")
    polarity = F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("double") / 32768.0 - 1.0
    scored = lexical.mean_polarity(t.documents, "doc_id", "text", words.withColumn("polarity", polarity))
    return scored.select("doc_id", rounded("polarity").alias("polarity"))


@check(
    "prompt_completion_split",
    with_views(
        f"""SELECT rewrite_id, substr(t, 1, instr(t, '[/INST]') + 6) AS prompt, substr(t, instr(t, '[/INST]') + 7) AS completion
        FROM (SELECT rewrite_id, {_sql_filled(texts.TRAIN_SUBJECT, _RECORD)} AS t FROM rewrites)""",
        "rewrites",
    ),
)
def _(t: Tables):
    rendered = t.rewrites.select("rewrite_id", templates.render(texts.TRAIN_SUBJECT).alias("text"))
    parts = rendered.select("rewrite_id", parsing.split_completion(F.col("text")).alias("p"))
    return parts.select("rewrite_id", "p.*")
