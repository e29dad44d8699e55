"""Parsers for generated text. A malformed value gives null or a default, never a failed job."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from palimpsest.functions.text import replace_literals, strip
from palimpsest.schemas import PROMPT_SUBJECT_LIST

# Fixed values.
OPENING_REMARK = "sure"
INFO_HEADING = "### Info"
SUBJECT_LABEL = "Subject:"
DEFAULT_PROMPT = "Make this text better"
COMPLETION_TAG = "[/INST]"


def drop_opening_remark(text: Column) -> Column:
    """Strip; when the text opens with "sure" in any case, drop its first line and strip again."""
    body = strip(text)
    rest = strip(F.regexp_replace(body, r"^[^\n]*\n?", ""))
    return F.when(F.startswith(F.lower(body), F.lit(OPENING_REMARK)), rest).otherwise(body)


def first_line(text: Column, remove: tuple[str, ...] = (), strip_first: bool = False) -> Column:
    """First line, stripped, without the given marks; ``strip_first`` skips leading blank lines."""
    for mark in remove:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return strip(F.substring_index(strip(text) if strip_first else text, "\n", 1))


def labelled_fields(text: Column) -> Column:
    """Struct ``type, prompt, subject`` from the first three non-blank "Label: value" lines.

    Only the part between the first and second ": " of a line counts. When any of the three is
    missing all three are empty.
    """
    body = strip(F.replace(text, F.lit(INFO_HEADING), F.lit("")))
    lines = F.filter(F.split(body, "\n"), lambda x: strip(x) != "")
    values = [F.get(F.split(F.get(lines, F.lit(i)), ": "), F.lit(1)) for i in range(3)]
    whole = values[0].isNotNull() & values[1].isNotNull() & values[2].isNotNull()
    names = ("type", "prompt", "subject")
    return F.struct(*[F.when(whole, v).otherwise("").alias(n) for v, n in zip(values, names)])


def subject_answer(text: Column) -> Column:
    return strip(F.replace(text, F.lit(SUBJECT_LABEL), F.lit("")))


def fenced_prompt_list(text: Column) -> Column:
    """``array<struct<prompt, subject>>`` out of a fenced JSON list; null when it does not parse."""
    bare = replace_literals(text, {"json": "", "```": ""})
    return F.from_json(bare, PROMPT_SUBJECT_LIST, {"mode": "PERMISSIVE"})


def embedded_json(text: Column, schema: str) -> Column:
    """Parse the span from the first "{" to the last "}"; raw control characters are accepted."""
    span = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.from_json(span, schema, {"mode": "PERMISSIVE", "allowUnquotedControlChars": "true"})


def prompt_or_default(text: Column, default: str = DEFAULT_PROMPT) -> Column:
    return F.coalesce(embedded_json(text, "prompt string")["prompt"], F.lit(default))


def judge_flag(response: Column, field: str = "is_well_written", any_text_is_true: bool = False) -> Column:
    """Boolean answer of a judge (true, or a number other than 0); a missing key or unreadable response is false.

    ``any_text_is_true`` follows Python truthiness, under which even the text "False" counts as true.
    """
    value = F.get_json_object(response, f"$.{field}")
    if any_text_is_true:
        return F.coalesce(~value.isin("false", "", "0", "null", "[]", "{}"), F.lit(False))
    return F.coalesce((F.lower(value) == "true") | (F.coalesce(value.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


def split_completion(text: Column, tag: str = COMPLETION_TAG) -> Column:
    """Struct ``prompt, completion``: the label of a training example is what follows the tag."""
    at = F.instr(text, tag)
    end = at + len(tag) - 1
    return F.struct(
        F.when(at > 0, F.substring(text, F.lit(1), end)).otherwise(text).alias("prompt"),
        F.when(at > 0, F.substring(text, end + 1, F.length(text))).alias("completion"),
    )
