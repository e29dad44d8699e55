import pytest

LONG = "the quick brown fox " * 30_000

#: Null and empty texts, blanks, a very long text, one word, repeated rows, ties, a null id.
ODD = [
    (1, None, "en"),
    (2, "", "en"),
    (3, " \n\t ", None),
    (4, LONG, "en"),
    (5, "word", "fr"),
    (6, "one two three four five six seven", "en"),
    (6, "one two three four five six seven", "en"),
    (7, "one two three four five six seven", None),
    (None, "no id at all here in this row", "de"),
    (8, "12 345 !!! ...", "de"),
    (9, "日本語 <|endoftext|> ▁ don't é́", "fr"),
]


@pytest.fixture
def odd_documents(spark):
    """Odd rows with columns whose names the operators use themselves."""
    extra = ("row", "id", "key", "block", "label", "score", "who", "place", "tile", "held", "ids", "n")
    rows = [(*r, *["x"] * len(extra)) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in extra))


@pytest.fixture
def no_documents(odd_documents):
    return odd_documents.limit(0)
