"""Declared schemas of the tables the readers return; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


REWRITE = _strings("original_text", "rewrite_prompt", "rewritten_text")
REWRITE_SUBJECT = _strings("original_text", "rewrite_prompt", "rewritten_text", "subject")
JUDGED = T.StructType(REWRITE_SUBJECT.fields + [T.StructField("is_well_written", T.BooleanType())])
SOURCE_TEXT = _strings("original_text", "dataset_id")
CONDITIONED = _strings("original_text", "dataset_id", "type", "prompt", "subject")
ANCHOR = T.StructType(
    [T.StructField("rewrite_prompt", T.StringType()), T.StructField("lb_score", T.FloatType())]
)

PROMPT_SUBJECT = _strings("prompt", "subject")
PROMPT_SUBJECT_LIST = T.ArrayType(PROMPT_SUBJECT)
NESTED_PROMPTS = T.StructType([T.StructField("prompts", PROMPT_SUBJECT_LIST)])
EXPANSION = T.StructType(
    [
        T.StructField("original_prompt", T.StringType()),
        T.StructField("rewritten_prompts", T.ArrayType(T.StringType())),
    ]
)
EXPANSION_LISTS = T.ArrayType(T.ArrayType(EXPANSION))
TRACE = T.StructType(
    [
        T.StructField("step", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("text", T.StringType()),
    ]
)
BEAM = T.StructType(
    [
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("score", T.DoubleType()),
        T.StructField("beam_score", T.DoubleType()),
    ]
)
