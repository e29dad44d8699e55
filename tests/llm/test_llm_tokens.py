import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import pieces as pieces_module, token_files
from palimpsest.llm.bpe import PrefixCounts, stretches, tokenizer_path
from palimpsest.llm.pieces import MODEL, Pieces, Segmenter, decode_pieces, encode_pieces, round_trip
from palimpsest.llm.registry import QUERIES
from palimpsest.llm.token_counts import VOCABULARY, longest_prefix, prefix_token_counts, tokens_of_prefix, total_tokens

SF = "/root/testdata/sf0.001"
PARTS = ["a", "the", " ", "  ", "\n", "'", "'re", "'ll", "'s", "é", "ﬁ", "😀", "<|endoftext|>", "<|", "1", "23", ".", "!!", "\t", " ", "漢字", "\r\n", "aaaa", "don't"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokenizer_path(VOCABULARY))


def made_up(seed, n, most=12):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_every_prefix_has_the_library_count(library):
    counter = PrefixCounts(tokenizer_path(VOCABULARY))
    texts = made_up(3, 300)
    for text, counts in zip(texts, counter(texts), strict=True):
        assert counts.tolist() == [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_stretches_join_again():
    for text in made_up(4, 200):
        assert " ".join(stretches(text)) == text


def test_counts_of_odd_documents(spark, library, odd_documents, no_documents):
    got = prefix_token_counts(odd_documents)
    assert got.columns == ["doc_id", "n_bytes", "prefix_tokens"]
    rows = got.select("doc_id", "n_bytes", total_tokens(F.col("prefix_tokens")).alias("n")).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in odd_documents.collect()]
    want = [(i, len(t.encode()), len(library.encode(t, add_special_tokens=False).ids)) for i, t in texts]
    assert sorted(map(repr, map(tuple, rows))) == sorted(map(repr, want))
    assert prefix_token_counts(no_documents).count() == 0


def test_truncation_and_budget(spark, library):
    text = "Prefix counts answer questions, don't they?  Unbelievably so."
    df = prefix_token_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    count = lambda s: len(library.encode(s, add_special_tokens=False).ids)
    for k in (0, 1, 7, len(text), 500):
        assert df.select(tokens_of_prefix(F.col("prefix_tokens"), k)).first()[0] == count(text[:k])
    for budget in (0, 3, 8, 100):
        want = max([k for k in range(len(text) + 1) if count(text[:k]) <= budget])
        assert df.select(longest_prefix(F.col("prefix_tokens"), budget)).first()[0] == want


def test_op1_against_the_library(spark, library):
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in QUERIES["op1_token_counts"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    counts = [len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs]
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n, n > 1024) for r, n in zip(docs, counts, strict=True)}


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (1, 2), (13, 50_257), (1000, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        assert (token_files.from_planes(token_files.to_planes(ids, bits), n, bits) == ids).all()


@pytest.mark.parametrize("bits, block", [(1, 7), (8, 64), (1, 1 << 16)])
def test_files_give_back_the_ids(spark, tmp_path, library, odd_documents, bits, block):
    files = token_files.write_token_files(odd_documents, f"{tmp_path}/ids", bits=bits, block=block)
    back = token_files.read_token_files(files, odd_documents.schema["doc_id"].dataType)
    got = back.orderBy("start").collect()
    want = {}
    for r in odd_documents.collect():
        want.setdefault(r["doc_id"], []).append([*library.encode(r["text"] or "", add_special_tokens=False).ids, 2])
    at, order = 0, []
    for r in got:
        assert r["ids"] in want[r["doc_id"]] and r["n_tokens"] == len(r["ids"]) and r["start"] == at
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        at += r["n_tokens"]
        order.append(-1 if r["doc_id"] is None else r["doc_id"])
    assert order == sorted(order) and len(got) == odd_documents.count()


def test_an_empty_table_gives_no_files(spark, tmp_path, no_documents):
    files = token_files.write_token_files(no_documents, f"{tmp_path}/ids")
    assert files.count() == 0
    assert token_files.read_token_files(files, no_documents.schema["doc_id"].dataType).count() == 0


def test_op7_against_the_library(spark, library):
    got = sorted(map(tuple, QUERIES["op7_token_planes"](spark, SF).collect()))
    want, at = [], 0
    for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert got == want


def test_pieces_without_dropout_are_the_library_ones():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    plain = Segmenter(tokenizer_path(MODEL), 0.0, 1, 4)
    for text in made_up(5, 400):
        assert plain(text).tolist() == model.encode(text)


def test_dropout_varies_and_loses_nothing():
    pieces = Pieces(tokenizer_path(MODEL))
    texts = [*made_up(6, 200), "▁ a▁b ", "�\x00", "tokenization of uncommonly long vocabularies " * 20]
    one, two = (Segmenter(tokenizer_path(MODEL), 0.3, seed, 4) for seed in (1, 2))
    for text in texts:
        assert pieces.decode(one(text).tolist()) == text == pieces.decode(two(text).tolist())
        assert one(text).tolist() == one(text).tolist()
    assert one(texts[-1]).tolist() != two(texts[-1]).tolist()
    assert len({tuple(pieces.segment(" tokenization", 0.3, 1, draw)) for draw in range(4)}) > 1


def test_pieces_of_odd_documents(spark, odd_documents, no_documents):
    rows = round_trip(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(r["lossless"] for r in rows)
    assert all((r["n_pieces"] == 0) == (r["doc_id"] in (1, 2)) for r in rows)
    back = decode_pieces(encode_pieces(odd_documents, dropout=0.5, seed=9))
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] or "" for r in odd_documents.collect())
    assert round_trip(no_documents).count() == 0


def test_op4_is_lossless(spark):
    rows = QUERIES["op4_sentencepiece"](spark, SF)
    assert rows.filter("lossless").count() == rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_production_segmenter_varies_long_words():
    segmenter = Segmenter(tokenizer_path(MODEL), pieces_module.DROPOUT, pieces_module.SEED, pieces_module.DRAWS)
    for word in (" internationalization", " responsibilities"):
        got = [segmenter(word * n).tolist()[-30:] for n in range(50, 150)]
        assert got == [segmenter(word * n).tolist()[-30:] for n in range(50, 150)]
        ends = {tuple(ids[max(k for k, i in enumerate(ids) if segmenter.pieces.raw[i].startswith(b" ")) :]) for ids in got}
        assert len(ends) > 4


def test_kept_segmentations_are_those_made_anew():
    dropout = 0.3
    kept, fresh = (Segmenter(tokenizer_path(MODEL), dropout, 5) for _ in range(2))
    fresh.LONGEST = -1
    texts = made_up(8, 300) + ["tokenization of words " * 50, "responsibilities " * 200, "x" * 100]
    for text in texts + texts:
        assert kept(text).tolist() == fresh(text).tolist()


def test_merges_are_skipped_at_the_rate():
    pieces, gaps = Pieces(tokenizer_path(MODEL)), pieces_module.Gaps(0.1)
    runs = [pieces.merged(" responsibilities", gaps.skips(pieces_module.mixed(k))) for k in range(5_000)]
    rate = sum(len(skipped) for _, skipped, _ in runs) / sum(count for _, _, count in runs)
    assert abs(rate - 0.1) < 0.005


def test_short_words_merge_as_with_an_agenda(monkeypatch):
    pieces, gaps = Pieces(tokenizer_path(MODEL)), pieces_module.Gaps(0.2)
    words = [w for text in made_up(9, 100) for w in [text.replace(" ", "")[:30]] if w]
    short = [pieces.merged(w, gaps.skips(k << 40 | k)) for k, w in enumerate(words)]
    monkeypatch.setattr(pieces_module, "SHORT", -1)
    assert short == [pieces.merged(w, gaps.skips(k << 40 | k)) for k, w in enumerate(words)]


@pytest.mark.parametrize("dropout, draws", [(0.0, 0), (0.1, 0), (0.4, 3), (1.0, 0)])
def test_words_merged_together_are_those_merged_one_by_one(monkeypatch, dropout, draws):
    together, apart = (Segmenter(tokenizer_path(MODEL), dropout, 5, draws) for _ in range(2))
    together.BLOCK, together.TOGETHER = 300, 100
    apart.LONGEST = -1
    texts = [None, "", " ", *made_up(10, 300, 30), "responsibilities " * 40, "漢" * 64 + " " + "漢" * 65, "▁\U0010ffff\x00 ʼ"]
    want = [apart(t).tolist() for t in texts]
    merged, asked = Pieces.merged, []
    monkeypatch.setattr(Pieces, "merged", lambda self, word, skips=None: asked.append(word) or merged(self, word, skips))
    ids, offsets = together.many(texts)
    assert [x.tolist() for x in np.split(ids, offsets[1:-1])] == want
    assert all(len(word) > together.LONGEST for word in asked)
    assert together.lossless(texts, ids, offsets) == [True] * len(texts)
    wrong = ids.copy()
    wrong[offsets[-2]] = 5
    assert together.lossless(texts, wrong, offsets) == [True] * (len(texts) - 1) + [False]


def test_a_worker_keeps_no_words_of_the_texts_it_cut():
    segmenter = Segmenter(tokenizer_path(MODEL), 0.1, 1)
    segmenter("some words")
    rng = random.Random(11)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(500)) for _ in range(40)]
    tracemalloc.start()
    try:
        for text in texts:
            segmenter(text)
        assert tracemalloc.get_traced_memory()[0] < 500_000
    finally:
        tracemalloc.stop()


def test_new_words_go_to_the_library_many_in_one_text(library):
    encoder = token_files.Encoder(tokenizer_path(VOCABULARY))
    encoder.JOINED = 7
    asked, call = [], encoder.tokenizer.encode_batch_fast

    class Counted:
        def encode_batch_fast(self, texts, add_special_tokens):
            asked.extend(texts)
            return call(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counted()
    plain = [f"first word{'abcdefghij'[n % 10] * (n // 10 + 1)} é漢{n} 'll x\x1c" for n in range(100)]
    texts = plain + ["", *made_up(12, 500), "<|endoftext|> a<b <|endoftext|>", " a", " ", "\u3000b c\u3000", "word " + "long" * 40]
    assert [x.tolist() for x in encoder(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    del asked[:]
    words = [f" {a}{b}qz" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    encoder(["".join(words).strip()])
    assert len(asked) <= len(words) / encoder.JOINED + 2
    encoder.id_bytes[:] = 0  # ids that do not spell the bytes: each word by itself
    text = "other words than those before"
    assert encoder([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids
