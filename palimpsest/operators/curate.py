"""Corpus curation: normalise, filter, deduplicate, decontaminate, join, sample and split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from palimpsest.functions.text import blank_if_null, head_lines, replace_literals, seeded_key, strip
from palimpsest.operators.ordering import (
    first_by_shuffle,
    top_per_group,
    union_all,
    with_position,
    with_shuffled_position,
)

REWRITE_COLUMNS = ("original_text", "rewrite_prompt", "rewritten_text", "subject")

# Inclusive length bounds in code points, per rule set.
GENERAL_RULE = {"original_text": (300, 2000), "rewritten_text": (200, 3000), "rewrite_prompt": (5, 500), "subject": (5, 200)}
TRAINING_RULE = {"original_text": (200, 3000), "rewritten_text": (200, 3000), "rewrite_prompt": (5, 500), "subject": (3, 200)}
SOURCE_RULE = {"original_text": (300, 2000)}
CONDITIONED_RULE = {"original_text": (300, 2000), "prompt": (5, 500)}
WIDE_TABLE_RULE = {"original_text": (300, 2000), "rewritten_text": (200, 3000)}
SUBJECT_PLACEHOLDER = "-" * 18


def rewrite_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The rewrite record's columns that are present (``subject`` is optional), plus ``keep``."""
    wanted = [c for c in (*keep, *REWRITE_COLUMNS) if c in df.columns]
    return df.select(*wanted)


def with_subject(df: DataFrame, placeholder: str = SUBJECT_PLACEHOLDER) -> DataFrame:
    return df if "subject" in df.columns else df.withColumn("subject", F.lit(placeholder))


def normalise_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Null becomes empty, then Unicode whitespace is stripped."""
    return df.withColumns({c: strip(blank_if_null(F.col(c))) for c in columns})


def within(rule: dict[str, tuple[int, int]], present: list[str] | None = None) -> Column:
    """Conjunction of the rule's inclusive length bounds."""
    checks = [
        F.length(c).between(low, high)
        for c, (low, high) in rule.items()
        if present is None or c in present
    ]
    kept = F.lit(True)
    for check in checks:
        kept = kept & check
    return kept


def length_filter(
    df: DataFrame, rule: dict[str, tuple[int, int]] = GENERAL_RULE, keep: tuple[str, ...] = (), fill_subject: bool = False
) -> DataFrame:
    """Select the record's columns, normalise them and keep the rows inside the rule's bounds."""
    df = rewrite_columns(df, keep)
    if fill_subject:
        df = with_subject(df)
    text = [c for c in rule if c in df.columns]
    return normalise_columns(df, text).filter(within(rule, df.columns))


def length_funnel(df: DataFrame, rule: dict[str, tuple[int, int]]) -> DataFrame:
    """Row counts after each successive bound of the rule, in one pass."""
    kept = F.lit(True)
    counts = [F.count(F.lit(1)).alias("all_rows")]
    for column, (low, high) in rule.items():
        kept = kept & F.length(column).between(low, high)
        counts.append(F.count_if(kept).alias(f"after_{column}"))
    return df.agg(*counts)


def exclusive_length(df: DataFrame, column: str, low: int = 300, high: int = 500) -> DataFrame:
    return df.filter((F.length(column) > low) & (F.length(column) < high))


def short_pairs(df: DataFrame, order_by: str, limit: int = 20, max_chars: int = 1500) -> DataFrame:
    """The first ``limit`` rows whose original and rewritten text together stay under ``max_chars``."""
    total = F.length("original_text") + F.length("rewritten_text")
    return df.filter(total < max_chars).orderBy(order_by).limit(limit)


def shortened_only(df: DataFrame) -> DataFrame:
    return df.filter(F.length("original_text") > F.length("rewritten_text"))


def cap_per_source(
    df: DataFrame, text: str, source: str, id_columns: list[str], min_len: int, max_len: int, max_size: int, seed: int
) -> DataFrame:
    """Length filter, then a seeded sample of at most ``max_size`` rows per source."""
    inside = df.filter(F.length(text).between(min_len, max_len)).withColumn("_key", seeded_key(seed, *id_columns))
    order = [F.col("_key"), *[F.col(c) for c in id_columns]]
    return top_per_group(inside, [source], order, max_size, id_columns).drop("_key")


def token_filter(df: DataFrame, token_count: Column, max_tokens: int = 2048) -> DataFrame:
    return df.filter(token_count < max_tokens)


def combine_sources(sources: dict[str, DataFrame], label: str = "dataset") -> DataFrame:
    """Union by column name with the source's name as a column; absent columns become null."""
    return union_all([df.withColumn(label, F.lit(name)) for name, df in sources.items()])


# Clean-up of the public source corpora.
SOURCE_REPLACEMENTS = {"multi_news": {"– ": ""}, "imdb": {"<br /><br />": "\n"}}


def source_text(kind: str, text: Column, min_len: int = 300) -> Column:
    """Per-corpus clean-up: encyclopedia articles lose their title line and are cut to a head."""
    if kind == "wikipedia":
        return head_lines(text, 2 * min_len)
    return replace_literals(text, SOURCE_REPLACEMENTS.get(kind, {}))


def first_per_key(df: DataFrame, keys: list[str], id_column: str) -> DataFrame:
    """First row (smallest id) of each distinct key, whole rows.

    Only a digest of the key and the id are grouped (combined on the map side, so a group of copies
    costs one row per task); the ids of the later copies, which are few, take their rows out.
    """
    digest = F.sha2(F.col(keys[0]) if len(keys) == 1 else F.to_json(F.struct(*keys)), 256)
    keyed = df.select(digest.alias("_digest"), id_column)
    firsts = keyed.groupBy("_digest").agg(F.min(id_column).alias("_first"))
    later = keyed.join(firsts, "_digest").filter(F.col(id_column) != F.col("_first")).select(id_column)
    return df.join(later, id_column, "left_anti")


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def keep_listed(df: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Rows whose key appears in the list."""
    return df.join(listed.select(key).distinct(), key, "left_semi")


def drop_seen(df: DataFrame, seen: DataFrame, keys: list[str], id_column: str | None = None) -> DataFrame:
    """Rows for which none of the keys appears in the same column of ``seen``; duplicates are kept.

    The seen values are reduced to distinct digests, so long texts and repeated values do not
    travel. With a unique ``id_column`` only ids and digests are compared, and the ids that hit are
    then taken out of the whole rows; otherwise the whole rows take part in one anti-join per key.
    """

    def digests(key: str) -> DataFrame:
        return seen.filter(F.col(key).isNotNull()).select(F.sha2(F.col(key), 256).alias("_seen")).distinct()

    if id_column is None:
        for key in keys:
            df = df.withColumn("_seen", F.sha2(F.col(key), 256)).join(digests(key), "_seen", "left_anti").drop("_seen")
        return df
    hits = [
        df.select(id_column, F.sha2(F.col(key), 256).alias("_seen")).join(digests(key), "_seen", "left_semi").select(id_column)
        for key in keys
    ]
    return df.join(union_all(hits).distinct(), id_column, "left_anti")


def fan_out(df: DataFrame, variants: DataFrame, key: str, values: str, missing: str = "error") -> DataFrame:
    """Each row once with its own key value and once per variant of it.

    ``variants`` has one row per ``key`` with an array column ``values``. A key without an entry
    raises, as a plain dictionary lookup would; ``missing="drop"`` drops the row instead.
    """
    if missing == "drop":
        joined = df.join(variants.select(key, values), key, "inner")
        found = F.col(values)
    else:
        joined = df.join(variants.select(key, values), key, "left")
        failure = F.raise_error(F.concat(F.lit("no variants for: "), F.col(key)))
        found = F.coalesce(F.col(values), failure.cast("array<string>"))
    return joined.withColumn(key, F.explode(F.concat(F.array(F.col(key)), found))).drop(values)


def variant_table(expansions: DataFrame, key: str, values: str, order_by: str) -> DataFrame:
    """One row per key; where a key repeats the last entry by ``order_by`` wins."""
    return expansions.groupBy(key).agg(F.max_by(values, order_by).alias(values))


def zip_by_order(
    left: DataFrame, right: DataFrame, left_order: str, right_order: str, left_ties: list[str] = (), right_ties: list[str] = ()
) -> DataFrame:
    """Pair the i-th row of one table with the i-th of the other; the longer one is cut.

    The ties decide among rows of equal order, and spread them over tasks.
    """
    a = with_position(left, left_order, "_position", left_ties)
    b = with_position(right, right_order, "_position", right_ties)
    return a.join(b, "_position").drop("_position")


def zip_shuffled(
    base: DataFrame, donors: DataFrame, seed: int, base_order: str, donor_ids: list[str], columns: list[str], base_ties: list[str] = ()
) -> DataFrame:
    """Replace ``columns`` of the base with those of shuffled donors, and append to the base.

    ``base_ties`` (not among ``columns``) decide among base rows of equal order, and spread them over tasks.
    """
    kept = [c for c in base.columns if c not in columns]
    a = with_position(base.select(*kept), base_order, "_position", base_ties)
    b = with_shuffled_position(donors.select(*donor_ids, *columns), seed, donor_ids, "_position")
    replaced = a.join(b.select("_position", *columns), "_position").drop("_position")
    return base.unionByName(replaced.select(*base.columns))


def cycle_join(
    left: DataFrame, right: DataFrame, left_order: str, right_order: str, left_ties: list[str] = (), right_ties: list[str] = ()
) -> DataFrame:
    """Row i of the left table with row i mod n of the right one; ties as in ``zip_by_order``.

    A right side so short that its rows repeat often is small, and Spark sends it to the left rows.
    """
    size = right.agg(F.count(F.lit(1)).alias("n")).scalar()
    a = with_position(left, left_order, "_index", left_ties).withColumn("_index", F.pmod("_index", size))
    b = with_position(right, right_order, "_index", right_ties)
    return a.join(b, "_index").drop("_index")


def lookup_or(df: DataFrame, table: DataFrame, key: str, value: str, default: str) -> DataFrame:
    """Left lookup with a default for keys that the table lacks."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def shuffle(df: DataFrame, seed: int, id_columns: list[str]) -> DataFrame:
    """Seeded full shuffle, as an added ``position`` that depends only on seed and ids."""
    return with_shuffled_position(df, seed, id_columns)


def sample_rows(df: DataFrame, n: int, seed: int, id_columns: list[str]) -> DataFrame:
    return first_by_shuffle(df, n, seed, id_columns)


def split_validation(df: DataFrame, validation_rows: int, seed: int, id_columns: list[str]) -> DataFrame:
    """Add ``split``: the last ``validation_rows`` of the seeded shuffle are ``validation``."""
    placed = with_shuffled_position(df, seed, id_columns, "_position", "_rows")
    is_validation = F.col("_position") >= F.col("_rows") - validation_rows
    return placed.withColumn("split", F.when(is_validation, "validation").otherwise("train")).drop("_position", "_rows")


def subject_orders(df: DataFrame, column: str = "subject") -> DataFrame:
    """One row per permutation of the comma-separated subject, at most the first three.

    In position order the first three permutations only reorder the last three items.
    """

    def orders(items: Column) -> Column:
        n = F.size(items)
        lead = F.slice(items, 1, F.greatest(n - 3, F.lit(0)))
        a, b, c = (F.get(items, n - k) for k in (3, 2, 1))
        triple = F.array(F.array(a, b, c), F.array(a, c, b), F.array(b, a, c))
        longer = F.transform(triple, lambda tail: F.concat(lead, tail))
        return (
            F.when(n == 1, F.array(items))
            .when(n == 2, F.array(items, F.array(c, b)))
            .otherwise(longer)
        )

    items = F.transform(F.split(F.col(column), ","), strip)
    variants = F.transform(F.array(items), orders)[0]
    return df.withColumn(column, F.explode(F.transform(variants, lambda v: F.array_join(v, ", "))))
