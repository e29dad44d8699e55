"""Whole texts to token ids: pieces cut and told apart in numpy."""

from __future__ import annotations

import random
import sys

import numpy as np
import pytest
from tokenizers import Tokenizer

from palimpsest.llm import token_files
from palimpsest.llm.bpe import tokenizer_path
from palimpsest.llm.common import RunTable, run_keys
from palimpsest.llm.token_files import VOCABULARY

SIGNS = [" ", " ", " ", "\n", "\t", "　", "\x1c", "\x85", "'", "'s", "'ll", "'LL", "’", "a", "Bc", "é", "漢", "字", "1", "٣", "½", ",", "<", "<|endoftext|>", "|>", "\U0001f600", "́", "\x00"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(VOCABULARY))


def odd_texts(seed: int, n: int, most: int = 24) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(SIGNS, k=rng.randrange(most))) for _ in range(n)]


@pytest.mark.parametrize("block, joined, kept", [(1_000_000, 1000, 1 << 20), (40, 7, 100), (5, 1, 1 << 20)])
def test_ids_are_the_librarys(library, monkeypatch, block, joined, kept):
    for name, value in (("BLOCK", block), ("JOINED", joined), ("KEPT", kept)):
        monkeypatch.setattr(token_files.Encoder, name, value)
    encoder = token_files.Encoder(VOCABULARY)
    for seed in range(4):
        texts = [None, "", *odd_texts(seed, 1500), "long" * 50 + " " + "long" * 50, " words  and\n\nlines \n<|endoftext|> \n x's" * 20]
        got = encoder(texts)
        assert all(x.dtype == np.uint32 for x in got)
        assert [x.tolist() for x in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_known_words_are_not_asked_again_and_no_python_runs_word_by_word():
    encoder = token_files.Encoder(VOCABULARY)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=8)) for _ in range(2000)) + "." for _ in range(10)]
    first, calls, asked = encoder(texts), [], []
    library = encoder.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.append(sum(map(len, texts)))
            return library(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counted()
    again = [" ".join(t[:-1].split(" ")[1:] + ["new" + t[:8]]) for t in texts]
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        encoder(texts)
        encoder(again)
    finally:
        sys.setprofile(None)
    assert len(calls) < 4_000  # of 40,000 words
    assert sum(asked) < 0.1 * sum(map(len, texts))
    assert [x.tolist() for x in encoder(texts)] == [x.tolist() for x in first]


def test_equal_runs_have_equal_hashes_in_any_array():
    rng = np.random.default_rng(1)
    run = rng.integers(0, 1 << 20, 30).astype(np.uint32)
    keys = set()
    for before, behind in ((0, 0), (3, 5), (1000, 1)):
        data = np.concatenate([rng.integers(0, 99, before), run, rng.integers(0, 99, behind)]).astype(np.uint32)
        keys.add(int(run_keys(data, np.array([before]), np.array([before + 30]), 0x9E3779B97F4A7C15)[0]))
    assert len(keys) == 1


def test_a_table_of_runs_finds_what_it_kept():
    table, data = RunTable(4), np.arange(400, dtype=np.uint32) % 50
    starts = np.arange(0, 400, 2)
    ends = starts + 2
    for _ in range(3):  # more kinds than places: some take the place of others
        values, new, one, kind, keys = table.looked_up(data, starts, ends)
        assert (data[starts[one][kind]] == data[starts[new]]).all() and len(one) == len(set(data[starts[new]].tolist()))
        known = np.setdiff1d(np.arange(200), new)
        assert (values[known] == data[starts[known]]).all()
        table.put(keys, ends[one] - starts[one], data[starts[one]].astype(np.int32))
    assert 0 < len(known) < 200
    *_, one, kind, keys = table.looked_up(data, np.array([0, 100]), np.array([70, 170]))
    assert len(one) == 2 and kind.tolist() == [0, 1]  # long ones are never told by their hashes
