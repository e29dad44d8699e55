from pyspark.sql import functions as F

from palimpsest import prompt_texts
from palimpsest.functions import parsing, templates, text as tx, vectors as vx


def apply(spark, expression, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r["y"] for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_whitespace_is_what_python_strips():
    assert set(tx.WHITESPACE) == {chr(c) for c in range(1, 0x20000) if chr(c).isspace()}


def test_strip_and_null(spark):
    assert apply(spark, lambda x: tx.strip(tx.blank_if_null(x)), "  a　", None, "b\n") == ["a", "", "b"]


def test_letters_only(spark):
    assert apply(spark, tx.letters_only, "Re-write\tthis, Ünï!") == ["rewritethis ünï"]


def test_alphanumerics_only(spark):
    assert apply(spark, tx.alphanumerics_only, "A-1 b!") == ["A1 b"]


def test_letter_words_match_word_by_word_cleaning(spark):
    samples = ["  A-b 12 c\td\n!? e ", "", " \n", "One", "!!", "x y"]
    cleaned = [["".join(ch for ch in w if ch.isalpha()).lower() for w in s.split()] for s in samples]
    assert apply(spark, lambda x: tx.letter_words(x, keep_empty=True), *samples) == cleaned
    assert apply(spark, tx.letter_words, *samples) == [[w for w in ws if w] for ws in cleaned]


def test_head_lines(spark):
    got = apply(spark, lambda x: tx.head_lines(x, 5), "t\nab\ncdef\ngh", "only", "t\nabcdef\ngh", "t\na\nb")
    assert got == ["ab\ncdef", "", "abcdef", "a\nb"]


def test_lines_to_first_long(spark):
    long = "x" * 201
    assert apply(spark, tx.lines_to_first_long, f"a\n{long}\nb", "a\nb") == [f"a\n{long}", "a\nb"]


def test_opening_remark(spark):
    assert apply(spark, parsing.drop_opening_remark, "Sure, ok:\nbody\n", "Sure", "Body") == ["body", "", "Body"]


def test_first_line(spark):
    assert apply(spark, parsing.first_line, " x\ny", "\nz") == ["x", ""]
    assert apply(spark, lambda x: parsing.first_line(x, ('"',), True), '\n"z"\ny') == ["z"]


def test_labelled_fields(spark):
    got = apply(spark, parsing.labelled_fields, "### Info\nType: a\nPrompt: b: c\nSubject: d", "Type: a\nPrompt: b", "x")
    assert [tuple(r) for r in got] == [("a", "b", "d"), ("", "", ""), ("", "", "")]


def test_fenced_list(spark):
    got = apply(spark, parsing.fenced_prompt_list, '```json\n[{"prompt":"p","subject":"s"}]\n```', "not json")
    assert [tuple(r) for r in got[0]] == [("p", "s")]
    assert not got[1]


def test_prompt_or_default(spark):
    got = apply(spark, parsing.prompt_or_default, 'pre {"prompt": "x"} post', "no braces", '{"prompt": "a\nb"}', '{"other": 1}')
    assert got == ["x", parsing.DEFAULT_PROMPT, "a\nb", parsing.DEFAULT_PROMPT]


def test_judge_flag(spark):
    answers = ['{"is_well_written": false}', "{}", '{"is_well_written": true}', '{"is_well_written": "False"}', None]
    assert apply(spark, parsing.judge_flag, *answers) == [False, False, True, False, False]
    assert apply(spark, lambda x: parsing.judge_flag(x, any_text_is_true=True), *answers) == [False, False, True, True, False]


def test_completion_split(spark):
    got = apply(spark, parsing.split_completion, "ask[/INST] answer", "no tag")
    assert [tuple(r) for r in got] == [("ask[/INST]", " answer"), ("no tag", None)]


def test_bigrams_drop_one_letter_tokens(spark):
    assert apply(spark, lambda x: tx.ngrams(x, 2), "Make a text a b", "one") == [["make text"], []]
    assert apply(spark, lambda x: tx.ngrams(x, 3), "aa bb cc dd", "aa bb") == [["aa bb cc", "bb cc dd"], []]


def test_render_keeps_braces_in_values_and_json(spark):
    rows = spark.createDataFrame([("{subject}", None)], "original_text string, subject string")
    got = rows.select(templates.render('{"k": 1} {original_text}|{subject}').alias("y")).first()["y"]
    assert got == '{"k": 1} {subject}|'
    assert "subject" in templates.placeholders(prompt_texts.MERGE_SUBJECT)


def test_training_record_parses_back(spark):
    rows = spark.createDataFrame([('a"\n', "b", "p", "s")], "original_text string, rewritten_text string, rewrite_prompt string, subject string")
    given, wanted = templates.training_record(("prompt",))
    got = rows.select(given.alias("i"), wanted.alias("o")).first()
    assert got["i"] == '{"original_text": "a\\"\\n", "rewritten_text": "b"}' and got["o"] == '{"prompt": "p"}'


def test_encoder_position_weight_and_blank_text(spark):
    plain = apply(spark, vx.encode_text, "a b", "b a", "", None)
    assert plain[0] == plain[1] and plain[2] is None and plain[3] is None
    assert abs(sum(x * x for x in plain[0]) - 1) < 1e-12
    weighted = apply(spark, lambda x: vx.encode_text(x, 0.5), "a b", "b a")
    assert weighted[0] != weighted[1]
