import base64
import random

import pytest
import tiktoken

from folioflow.llm import bpe

RAW = [None, "", "a", "Hello world, it's 2024!", "ñandú ßtraße   \n\n  x", "é" * 500, "abcdefghij" * 300, "<|endoftext|> plain", "é\U0001f600 tail ", " " * 200, "zzzz zzzz zzzz"]


@pytest.fixture(scope="module")
def coder():
    return bpe.Coder(bpe.read_ranks(bpe.RANKS))


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(row):
    import numpy as np

    return np.frombuffer(row, np.int32).tolist()


def test_ids_equal_those_of_the_public_encoder(coder, plain):
    rng = random.Random(5)
    texts = [t for t in RAW if t is not None] + ["".join(rng.choice("abcé ñ\n 12.,_'st") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    for text, row in zip(texts, coder.encode(texts), strict=True):
        assert ids(row) == plain.encode_ordinary(text)
        assert coder.decode(ids(row)).decode() == text


def test_long_pieces_take_the_same_merges(coder):
    rng = random.Random(6)
    for _ in range(200):
        word = "".join(rng.choice("aabcdeiost") for _ in range(rng.randint(2, 60))).encode()
        assert coder._long(word) == coder._short([word])[0]


def test_forgetting_pieces_changes_nothing(coder, monkeypatch):
    want = coder.encode(["one two three", "four five six"])
    monkeypatch.setattr(bpe, "REMEMBERED", 2)
    assert coder.encode(["one two three", "four five six"]) == want


def test_frame_round_trip_and_edges(spark):
    rows = [(i, t, "x") for i, t in enumerate(RAW)] + [(None, "same", "x"), (3, RAW[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens string")
    out = bpe.encode(df, bpe.RANKS)
    assert out.columns == ["doc_id", "tokens", "n_tokens", "exact"]
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out, bpe.RANKS).collect()}
    assert all(back[i] == t for i, t in enumerate(RAW)) and back[None] == "same"
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["tokens"] is None and got[0]["n_tokens"] == 0 and got[0]["exact"] is None
    assert got[1]["tokens"] == [] and got[1]["exact"]
    assert out.count() == len(rows) and bpe.encode(df.limit(0), bpe.RANKS).count() == 0
