"""Secret scans, token alignment and vector codes against plain versions."""

import math
import re
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palimpsest.llm import alignment, secret_scans, vector_codes
from palimpsest.llm.bpe import byte_letters, tokenizer_path

# ---------------------------------------------------------------------------------------------
# alignment

TEXTS = [
    "Hello world, don't stop 12345 été 日本語 😀",
    "a  b\n\n c\t",
    "the the the the",
    "the the the the",
    " opening blank and <|endoftext|> and <s> plain",
    "has the sign ▁ in it",
    "",
    None,
    "\x1c  odd\x00 spaces　",
    "x" * 300 + " " * 90 + "y",
    "naïve coöperation Straße ﬁ ſ",
]


@pytest.fixture(scope="module")
def both():
    library = Tokenizer.from_file(tokenizer_path(alignment.BYTE_VOCABULARY))
    library.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(alignment.PIECE_MODEL))
    letters = byte_letters()
    first = {n: bytes(letters[c] for c in t) for t, n in library.get_vocab().items() if t != "<|endoftext|>"}

    def second(i):
        piece = model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(text):
        a, b = library.encode(" " + (text or ""), add_special_tokens=False).ids, model.encode(text or "")
        raw = [[first[i] for i in a], [second(i) for i in b]]
        if not text or any(b"".join(r) != (" " + text).encode() for r in raw):
            return [], [], [], []
        return a, b, [len(r) for r in raw[0]], [len(r) for r in raw[1]]

    return encode


def plain_alignment(encode, text):
    """Groups with their bytes, and all overlapping pairs of occurrences."""
    a, b, size_a, size_b = encode(text)
    ends_a, ends_b = np.cumsum(size_a).tolist(), np.cumsum(size_b).tolist()
    links = [
        (a[i], b[j])
        for i in range(len(a))
        for j in range(len(b))
        if max(ends_a[i] - size_a[i], ends_b[j] - size_b[j]) < min(ends_a[i], ends_b[j])
    ]
    groups, start = [], 0
    for stop in sorted(set(ends_a) & set(ends_b)):
        own = [x for x, e in zip(a, ends_a, strict=True) if start < e <= stop], [y for y, e in zip(b, ends_b, strict=True) if start < e <= stop]
        groups.append((start, stop, *own))
        start = stop
    return a, b, groups, links


def test_token_groups_are_those_of_a_plain_search(spark, both):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {r["doc_id"]: [(g["start"], g["stop"], g["a"], g["b"]) for g in r["groups"]] for r in alignment.token_groups(rows).collect()}
    assert found == {k: plain_alignment(both, t)[2] for k, t in enumerate(TEXTS)}


@pytest.mark.parametrize("block_bytes", [1, 32_000_000])
def test_alignment_statistics_are_those_of_a_plain_count(spark, both, block_bytes, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_BYTES", block_bytes)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3, "doc_id")
    plain = {k: plain_alignment(both, t) for k, t in enumerate(TEXTS)}
    counts = Counter(pair for _, _, _, links in plain.values() for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    wanted = set()
    for k, (a, b, groups, links) in plain.items():
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for _, _, x, y in groups)
        best, total = sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links)
        wanted.add((k, len(a), len(b), len(groups), len(links), best, total, sha256(text.encode()).hexdigest() if a else ""))
    assert {tuple(r) for r in alignment.alignment_statistics(rows).collect()} == wanted


def test_alignment_of_odd_and_empty_tables(odd_documents, no_documents):
    found = alignment.alignment_statistics(odd_documents).collect()
    assert len(found) == odd_documents.count()
    assert {r["doc_id"] for r in found if r["n_a"] == 0} == {1, 2, 9}
    assert alignment.alignment_statistics(no_documents).collect() == []
    assert alignment.token_groups(no_documents).collect() == []


def test_byte_side_gives_the_library_s_ids():
    side = alignment.ByteSide(tokenizer_path(alignment.BYTE_VOCABULARY))
    assert side.fast is not None
    rng = np.random.default_rng(4)
    signs = ["a", "The", "12", "'s", "é", "日", "\n", "\t", "\x1c", " ", "!", "_", "😀", "́", "<|endoftext|>", "zz"]
    opened = [" " + "".join(rng.choice(signs, rng.integers(0, 8))) for _ in range(3000)] + [" " + "ab" * 4000]
    flat, sizes = side(opened)
    cuts = np.split(flat, np.cumsum(sizes)[:-1])
    assert [c.tolist() for c in cuts] == [side.library.encode(t, add_special_tokens=False).ids for t in opened]


# ---------------------------------------------------------------------------------------------
# vector codes


def plain_codes(rows, parts, entries, rounds):
    """Ids with codes and errors, and the codebooks, by loops over Python integers."""
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort()
    width = len(good[0][1]) // parts
    cut = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cut(v)[p] for _, v in good[:entries]] for p in range(parts)]

    def nearest(v):
        out = []
        for p, x in enumerate(cut(v)):
            square = [sum((a - b) ** 2 for a, b in zip(x, e, strict=True)) for e in books[p]]
            out.append((square.index(min(square)), min(square)))
        return out

    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in good:
            for p, (e, _) in enumerate(nearest(v)):
                members[p, e].append(cut(v)[p])
        for (p, e), own in members.items():
            books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, "".join(f"{e:02x}" for e, _ in nearest(v)), sum(s for _, s in nearest(v))) for i, v in good]
    return found, [x for book in books for e in book for x in e]


def test_vector_codes_are_those_of_plain_loops(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.choice([-0.5, -0.21, 0.0, 0.003, 0.3, 1.7], 8)]) for i in range(150)]
    rows += [(150, None), (151, [float("nan")] * 8), (152, [1.0, None] * 4), (153, [float("inf")] + [0.0] * 7), (154, []), (7, rows[3][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    wanted, entries = plain_codes(exact, 4, 6, 2)
    books = vector_codes.fit_codebooks(df, parts=4, entries=6, rounds=2)
    assert books.entries.ravel().tolist() == entries
    coded = vector_codes.encode_vectors(df, books)
    assert sorted(map(tuple, coded.collect())) == sorted(wanted)
    decoded = {r["vec_id"]: r["vector"] for r in vector_codes.decode_vectors(coded, books).collect()}
    integers = {i: [math.floor(256 * x) for x in v] for i, v in exact if i < 150 and i != 7}
    errors = {i: e for i, _, e in wanted}
    assert all(sum((256 * a - b) ** 2 for a, b in zip(decoded[i], v, strict=True)) == errors[i] for i, v in integers.items())


def test_vector_codes_of_empty_and_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int, code string, error string, _salt int"
    empty = spark.createDataFrame([(1, None, 2, "x", "y", 0), (None, [], None, "x", "y", 0)], schema)
    books = vector_codes.fit_codebooks(empty)
    assert vector_codes.encode_vectors(empty, books).collect() == [] and books.digest() == sha256(b"").hexdigest()
    odd = spark.createDataFrame([(None, [0.5] * 16, None, "x", "y", 0), (2, [0.5] * 16, None, "x", "y", 0), (3, [0.1] * 8, 1, "x", "y", 0)], schema)
    books = vector_codes.fit_codebooks(odd)
    coded = vector_codes.encode_vectors(odd, books, keep=("label",)).cache()
    assert [(r["vec_id"], r["error"]) for r in coded.collect()] == [(None, 0), (2, 0)]  # another length has no code
    assert [r["total"] for r in vector_codes.with_group_sum(coded, "label", "error", "total").collect()] == [0, 0]
    with pytest.raises(ValueError, match="equal parts"):
        vector_codes.fit_codebooks(spark.createDataFrame([(1, [0.5] * 9)], "vec_id long, embedding array<float>"))


def test_group_sums_hold_nulls_together(spark):
    rows = spark.createDataFrame([(i, None if i % 3 == 0 else i % 3, i) for i in range(200)], "id long, g int, x long")
    found = {r["g"]: r["s"] for r in vector_codes.with_group_sum(rows, "g", "x", "s").collect()}
    assert found == {g: sum(i for i in range(200) if i % 3 == (g or 0)) for g in (None, 1, 2)}


# ---------------------------------------------------------------------------------------------
# secret scans

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def plain_spans(text):
    out = [(m.start(), 0, "assign", m.end()) for m in re.finditer(ASSIGN, text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def test_base_spans_are_those_of_the_plain_patterns():
    rng = np.random.default_rng(2)
    bits = ["password", "ToKeN", "api_key", "APIKEY", "ſecret", "toKen", "=", " : ", "'", '"', "abc", "AKIA", "ABCD1234EFGH5678", "deadbeef01", " ", "é", "-", "\n", "secret"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 14))) for _ in range(5000)]
    for text in texts:
        assert [(kind, a, b) for a, b, kind, _ in secret_scans.base_spans(text)] == plain_spans(text)
    assert sum(map(bool, map(plain_spans, texts))) > 500


def test_tokens_tile_and_follow_blanks():
    rng = np.random.default_rng(3)
    for _ in range(2000):
        text = "".join(rng.choice(["a", "Bc", " ", "  ", "\n", "\t", "1", "_", "é", "-", "\x1c", "日"], rng.integers(0, 12)))
        tokens = secret_scans.TOKEN.findall(text)
        assert "".join(tokens) == text
        assert [t for s in secret_scans._stretches(text) for t in secret_scans.TOKEN.findall(s)] == tokens


def test_viterbi_between_certain_tokens_is_the_search_over_all_paths():
    rng = np.random.default_rng(0)
    for _ in range(60):
        sizes = rng.integers(0, 7, 5)
        stops = np.cumsum(sizes)
        scores, across = rng.normal(size=(sizes.sum(), 3)) * 3, rng.normal(size=(3, 3))
        at, tags = secret_scans.best_tags(scores, stops - sizes, stops, across)
        got = np.zeros(len(scores), dtype=int)
        got[at] = tags
        for a, b in zip(stops - sizes, stops, strict=True):
            paths = np.array(np.meshgrid(*[range(3)] * (b - a))).reshape(b - a, -1).T if b > a else np.zeros((1, 0), int)
            value = scores[np.arange(a, b), paths].sum(axis=1) + across[paths[:, :-1], paths[:, 1:]].sum(axis=1)
            assert tuple(got[a:b]) == tuple(paths[value.argmax()])


def test_emissions_are_the_sum_of_the_features_a_fit_sees():
    rng = np.random.default_rng(5)
    model = secret_scans.Model(rng.normal(size=(secret_scans.BUCKETS, 3)).astype(np.float32), np.zeros((3, 3)))
    text = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and x9 more words, here\nand there'
    known = secret_scans.TokenTable(model.weights)
    scores, starts, stops = known.emissions(*known.of(["before 1", text, "", "behind"]))
    (_, tags, sizes, features), *_ = secret_scans._windows(text, 1)
    flat, at = model.weights[features].astype(np.float64), 0
    assert len(tags) == stops[1] - starts[1] and sum(tags) > 0
    for k, n in enumerate(sizes):
        assert np.allclose(scores[starts[1] + k], flat[at : at + n].sum(axis=0), atol=1e-4)
        at += n


def test_scans_add_secrets_without_a_pattern_and_keep_base_spans(spark):
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghiou"), rng.integers(2, 9)))
    value = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    text = lambda middle: " ".join([*(word() for _ in range(15)), middle, *(word() for _ in range(15))])
    train = [(i, text(f'token = "{value(40)}"' if i % 2 else word())) for i in range(400)]
    model = secret_scans.fit_secrets(spark.createDataFrame(train, "doc_id long, text string"))
    short = value(22)
    cases = [(1, text(f'ticket = "{short}"')), (2, text("nothing")), (3, None), (4, ""), (5, text(f"key {value(30)} and password: hunter22"))]
    found = {r["doc_id"]: r["spans"] for r in secret_scans.scan_secrets(spark.createDataFrame(cases, "doc_id long, text string"), model).collect()}
    texts = dict(cases)
    assert [(texts[1][s["start"] : s["stop"]], s["kind"]) for s in found[1]] == [(short, "model")]
    assert found[2] == found[3] == found[4] == []
    assert [(s["kind"], s["start"], s["stop"]) for s in found[5]] == plain_spans(texts[5])


def test_scans_of_odd_and_empty_tables(odd_documents, no_documents):
    model = secret_scans.fit_secrets(odd_documents)
    found = secret_scans.scan_secrets(odd_documents, model).collect()
    assert len(found) == odd_documents.count() and not any(r["spans"] for r in found)
    nothing = secret_scans.fit_secrets(no_documents)
    assert secret_scans.scan_secrets(no_documents, nothing).collect() == []
    assert not any(r["spans"] for r in secret_scans.scan_secrets(odd_documents, nothing).collect())


def test_query_columns_follow_the_spans(spark):
    folder = "/root/testdata/sf0.001"
    rows = secret_scans.op11(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_spans(texts[r["doc_id"]])
        kinds = Counter(kind for kind, _, _ in base)
        written = ",".join(f"{kind}:{a}:{b}" for kind, a, b in base)
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == (kinds["assign"], kinds["access"], kinds["hex"])
        assert r["base_sha256"] == sha256(written.encode()).hexdigest()
        assert [s for s in r["spans"].split(",") if s and not s.startswith("model")] == [s for s in written.split(",") if s]
