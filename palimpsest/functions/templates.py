"""Prompt rendering: a template with ``{column}`` placeholders becomes one concatenation."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

_PLACEHOLDER = re.compile(r"\{([a-z_]+)\}")


def placeholders(template: str) -> list[str]:
    return list(dict.fromkeys(_PLACEHOLDER.findall(template)))


def render(template: str, **values: Column) -> Column:
    """Fill the template's placeholders from ``values`` or from the columns of the same name.

    Null renders as empty text. Values are inserted as they are: a brace inside one is not a
    placeholder.
    """
    pieces = []
    for i, part in enumerate(_PLACEHOLDER.split(template)):
        if i % 2:
            pieces.append(F.coalesce(values.get(part, F.col(part)).cast("string"), F.lit("")))
        elif part:
            pieces.append(F.lit(part))
    return F.concat(*pieces) if pieces else F.lit("")


def fill_slot(template: Column | str, slot: str, value: Column) -> Column:
    """Replace a literal slot such as ``{{subject}}`` or ``{xxx}`` everywhere in a text."""
    text = F.lit(template) if isinstance(template, str) else template
    return F.replace(text, F.lit(slot), value)


def json_text(value: Column) -> Column:
    """The value as a quoted JSON string."""
    whole = F.to_json(F.struct(value.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def json_record(**fields: Column) -> Column:
    """JSON object with a space after each comma and colon."""
    parts = []
    for i, (name, value) in enumerate(fields.items()):
        parts += [F.lit((", " if i else "") + f'"{name}": '), json_text(F.coalesce(value, F.lit("")))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def training_record(output: tuple[str, ...] = ("prompt", "subject")) -> tuple[Column, Column]:
    """``input`` and ``output`` JSON of a training pair; the output holds prompt, subject or both."""
    sources = {"prompt": F.col("rewrite_prompt"), "subject": F.col("subject")}
    given = json_record(original_text=F.col("original_text"), rewritten_text=F.col("rewritten_text"))
    return given, json_record(**{name: sources[name] for name in output})
