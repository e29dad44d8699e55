"""Text normalisation and shape expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The code points Python's str.isspace accepts, as characters and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
WHITESPACE_CLASS = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# "To the end" for slice and substring; start + length must stay a 32-bit number.
REST = 1 << 30
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends (``trim`` alone removes U+0020 only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def blank_if_null(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def split_words(text: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.filter(F.split(text, WHITESPACE_CLASS + "+"), lambda w: w != "")


def letters_only(text: Column) -> Column:
    """Keep letters and the space character, lower-cased; words around a tab or newline fuse."""
    return F.lower(F.regexp_replace(text, r"[^\p{L} ]", ""))


def letter_words(text: Column, keep_empty: bool = False) -> Column:
    """Whitespace-separated words reduced to lower-case letters.

    Cleans the whole text at once and splits it afterwards, which gives the same words as cleaning
    them one by one. ``keep_empty`` keeps an empty word for each word without letters.
    """
    spaced = strip(F.regexp_replace(text, WHITESPACE_CLASS + "+", " "))
    words = F.split(letters_only(spaced), " ")
    if keep_empty:
        return F.when(spaced != "", words).otherwise(F.array().cast("array<string>"))
    return F.filter(words, lambda w: w != "")


def alphanumerics_only(text: Column) -> Column:
    """Keep letters, digits and the space character, case unchanged."""
    return F.regexp_replace(text, r"[^\p{L}\p{N} ]", "")


def normalised_words(text: Column) -> Column:
    """Each word reduced to lower-case letters and digits; empty results dropped."""
    return F.filter(
        F.transform(split_words(text), lambda w: F.lower(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))),
        lambda w: w != "",
    )


def drop_mixed_tokens(text: Column) -> Column:
    """Keep only space-separated tokens made wholly of letters and digits."""
    return F.array_join(F.filter(F.split(text, " "), lambda w: w.rlike(r"^[\p{L}\p{N}]+$")), " ")


def replace_literals(text: Column, pairs: dict[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def head_lines(text: Column, min_len: int, sep: str = "\n") -> Column:
    """Drop the first line, then keep the fewest following lines that reach ``min_len`` characters.

    One fold over the lines counts how many to keep, so long texts stay linear.
    """
    lines = F.slice(F.split(text, sep), 2, REST)
    start = F.struct(F.lit(0).alias("kept"), F.lit(0).alias("width"))

    def add(state: Column, line: Column) -> Column:
        grown = state["width"] + F.length(line) + F.when(state["kept"] > 0, len(sep)).otherwise(0)
        full = (state["kept"] > 0) & (state["width"] >= min_len)
        return F.struct(
            F.when(full, state["kept"]).otherwise(state["kept"] + 1).alias("kept"),
            F.when(full, state["width"]).otherwise(grown).alias("width"),
        )

    kept = F.aggregate(lines, start, add)["kept"]
    return strip(F.array_join(F.slice(lines, 1, kept), sep))


def lines_to_first_long(text: Column, limit: int = 400) -> Column:
    """Lines up to and including the first whose spaced-out length (2·len − 1) reaches ``limit``."""
    lines = F.split(strip(text), "\n")
    first = F.array_position(F.transform(lines, lambda x: 2 * F.length(x) - 1 >= limit), True)
    kept = F.when(first == 0, F.size(lines)).otherwise(first).cast("int")
    return strip(F.array_join(F.slice(lines, 1, kept), "\n"))


def capitalise_sentence(text: Column, stop: str = ".") -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, REST), F.lit(stop))


def ngrams(text: Column, n: int) -> Column:
    """Word n-grams of the lower-cased text; tokens have two or more word characters."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(WORD_TOKEN), F.lit(0))
    if n == 1:
        return tokens

    def grams(tokens: Column) -> Column:
        """Lengthen all grams by one word at a time: linear in the text for every n."""
        grown = tokens
        for k in range(1, n):
            count = F.greatest(F.size(tokens) - k, F.lit(0))
            longer = F.slice(tokens, k + 1, count)
            grown = F.zip_with(F.slice(grown, 1, count), longer, lambda a, b: F.concat(a, F.lit(" "), b))
        return grown

    # the tokens are bound once, so that the extraction is not repeated
    return F.transform(F.array(tokens), grams)[0]


def sentence_count(text: Column) -> Column:
    """Runs of text that end in sentence punctuation or at the end and hold a letter or digit."""
    pieces = F.split(text, r"[.!?]+")
    return F.size(F.filter(pieces, lambda s: s.rlike(r"[\p{L}\p{N}]")))


def mean_word_length(text: Column) -> Column:
    tokens = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    total = F.length(F.array_join(tokens, ""))
    return F.try_divide(total.cast("double"), F.size(tokens).cast("double"))


def regex_token_count(text: Column) -> Column:
    """Default stand-in for a tokenizer: words and single punctuation marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"))


def seeded_key(seed: int | str, *parts: Column | str) -> Column:
    """Uniform hexadecimal sort key that depends only on the seed and the row's identity."""
    columns = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("#", F.lit(str(seed)), *[c.cast("string") for c in columns]))


def seeded_int(seed: int | str, *parts: Column | str) -> Column:
    """Non-negative integer below 2³² from the leading eight digits of ``seeded_key``."""
    return F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("long")


def pick_word(text: Column, seed: int | str, row_id: Column, min_length: int = 5) -> Column:
    """One pseudo-random word of at least ``min_length`` characters; null when there is none."""
    words = F.filter(split_words(text), lambda w: F.length(w) >= min_length)
    keyed = F.transform(
        words, lambda w, i: F.struct(seeded_key(seed, row_id, i).alias("k"), w.alias("w"))
    )
    return F.array_min(keyed)["w"]
