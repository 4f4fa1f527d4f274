"""Byte-level BPE against the tokenizer library."""

import base64
import hashlib
import random

import numpy as np
import pytest

from docsieve.llm import byte_bpe, queries

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    def make(name):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
        return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})

    return make


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(byte_bpe.rank_file(byte_bpe.RANKS))


def test_classes_of_all_code_points(encoder):
    """A letter goes with a letter before it, a number with a number, anything but white space with a mark."""
    ranks = {bytes([i]): i for i in range(256)}
    for first in b"a1!":
        ranks |= {bytes([first, b]): len(ranks) + b for b in range(256)}
    probe = tiktoken.Encoding("probe", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    kinds = np.array([byte_bpe.LETTER] * 11, np.uint8)
    kinds[[byte_bpe.NUMBER, byte_bpe.OTHER, byte_bpe.QUOTE, byte_bpe.BLANK, byte_bpe.SPACE]] = [1, 2, 2, 3, 3]
    got = kinds[encoder.cutter.classes]
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for mark, kind in (("a", byte_bpe.LETTER), ("1", 1), ("!", 2)):
        together = np.array([probe.encode_ordinary(mark + chr(c))[0] >= 256 for c in codes])
        assert (together == (got[codes] == kind)).all()


def test_random_texts_and_windows(encoder, library):
    draw, enc = random.Random(5), library(byte_bpe.RANKS)
    letters = "''''  \n\t sstmdrevl lLAé1٢５!.,«　\xa0\U00010d40\U00013460𝕏日本á\x1c\x85"
    for _ in range(1500):
        texts = ["".join(draw.choices(letters, k=draw.randint(0, 40))) for _ in range(draw.randint(1, 6))]
        ids, counts = encoder.short("".join(texts).encode(), np.cumsum([len(t.encode()) for t in texts]))
        want = [enc.encode_ordinary(t) for t in texts]
        assert ids.tolist() == sum(want, []) and counts.tolist() == [len(w) for w in want]
        whole = "".join(texts)
        if whole:
            assert encoder.long(whole.encode(), draw.choice((3, 8, 17)))[0].tolist() == enc.encode_ordinary(whole)


def test_long_pieces(encoder, library):
    enc = library(byte_bpe.RANKS)
    for piece in ("a" * 5000, "ab" * 3000, "é" * 4000, "qzx" * 3000, "." * 7001, "thequickbrown" * 40):
        assert encoder.merges.merged(piece.encode()) == enc.encode_ordinary(piece)
        assert encoder.merges.merged_short(piece[:300].encode()) == encoder.merges.merged_long(piece[:300].encode())


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encode_and_decode(spark, library, name):
    enc = library(name)
    texts = [None, "", " ", "don't  we'll\n\n x", "日本語 \U0001f600", "<|endoftext|>", "word " * 300_000 + "  end", "y" * 70_000, "twice", "twice"]
    df = spark.createDataFrame([(i % 9, t, [1], "n") for i, t in enumerate(texts)], "doc_id long, text string, ids array<int>, n_tokens string")
    encoded = byte_bpe.encode(df, ranks=name, window=1 << 16)
    got = encoded.collect()
    assert encoded.columns == ["doc_id", "n_tokens", "ids", "offsets"]
    want = sorted((i % 9, enc.encode_ordinary(t or "")) for i, t in enumerate(texts))
    assert sorted((r["doc_id"], r["ids"]) for r in got) == want
    for r in got:
        assert r["n_tokens"] == len(r["ids"])
        sizes = [len(enc.decode_single_token_bytes(i)) for i in r["ids"]]
        assert r["offsets"] == np.concatenate([[0], np.cumsum(sizes)])[:-1].astype(int).tolist()
    back = byte_bpe.decode(encoded, ranks=name).collect()
    assert sorted((r["doc_id"], bytes(r["decoded"]).decode()) for r in back) == sorted((i % 9, t or "") for i, t in enumerate(texts))


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [5, None, -1, 50_256, 2**31 - 1, 6]), (None, [0])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode(df).collect()}
    merges = byte_bpe.Merges(byte_bpe.rank_file(byte_bpe.RANKS))
    token = {v: k for k, v in merges.ranks.items()}
    assert got == {1: None, 2: b"", 3: token[5] + token[6], None: token[0]}
    assert byte_bpe.encode(df.where("false").selectExpr("doc_id", "'' as text")).count() == 0


def test_registered_query(spark, library):
    enc = library(byte_bpe.RANKS)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    got = queries.QUERIES["op13_byte_bpe"](spark, FOLDER)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    want = set()
    for r in docs:
        ids = enc.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in got.collect()} == want
