"""Piece encoding and decoding against the library and against plain merging, and the query on odd rows."""

import hashlib
import random

import numpy as np
import pytest

from spanveil.llm import pieces

tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
PATH = tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "   ", "▁", "a", "the", "e", "é", "梦", "\U0001f600", "\n", "\t", "1", "23", ".", "<0x41>", "<unk>", "</s>", "\x00", "ü", "́", "ing", "執", "ж", "при", "﻿"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def codec():
    return pieces.Codec(PATH)


def texts(seed=3, n=1500):
    rng = random.Random(seed)
    out = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(60))) for _ in range(n)]
    out += [" " * k + w for k in range(120) for w in ("", "the", "x", "\n", "a ")]
    return [*out, "a" * 5000, "ab" * 3000, "é" * 700, "x" * 20000 + " " * 3000 + "1" * 500]


def test_equal_to_the_library(codec, library):
    t = texts()
    got = codec.encode(t, most=2000)
    assert [g.tolist() for g in got] == library.encode(t)
    assert [codec.decode(g) for g in got] == [library.decode(g.tolist()) for g in got]
    assert [codec.decimal(g).decode() for g in got] == [",".join(map(str, g.tolist())) for g in got]


def test_any_ids_decode_like_the_library(codec, library):
    rng = random.Random(4)
    some = [[rng.choice([0, 1, 2, 3, 130, 200, 230, 259, 262, 300, rng.randrange(32000)]) for _ in range(rng.randrange(1, 9))] for _ in range(2000)]
    assert [codec.decode(np.array(r)) for r in some] == [library.decode(r) for r in some]


def test_backtracking_equals_merging(codec):
    """Strings of one run, where the longest piece is often the wrong one."""
    rng = random.Random(5)
    m = codec.model
    took_back = 0
    for _ in range(3000):
        s = "▁" * rng.randrange(2) + "".join(rng.choice("theranisougdlcm") for _ in range(rng.randrange(1, 14)))
        got = m.encode(s)
        assert got == m.merged(s)
        first = max((p for p in (s[:k] for k in range(1, len(s) + 1)) if p in m.ids), key=len)
        took_back += m.text[got[0]] != first
    assert took_back > 100


def test_forgets_and_starts_anew(monkeypatch, library):
    monkeypatch.setattr(pieces, "MOST_STRINGS", 50)
    t = texts(6, 300)
    c = pieces.Codec(PATH)
    assert [g.tolist() for k in range(0, len(t), 40) for g in c.encode(t[k : k + 40], most=300)] == library.encode(t)


def test_models_of_other_kinds_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    form = sentencepiece_model_pb2.ModelProto()
    with open(PATH, "rb") as f:
        form.ParseFromString(f.read())
    form.trainer_spec.model_type = form.trainer_spec.UNIGRAM
    (tmp_path / "m.model").write_bytes(form.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Model(str(tmp_path / "m.model"))


def test_query_on_odd_rows(spark, tmp_path, library):
    rows = [(7, "the same", "x"), (7, "the same", "x"), (None, None, None), (3, "", "y"), (4, "▁ <s> ퟿ é\x00", "z"), (5, "word " * 40_000, "z")]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, pieces.op13_sentencepiece(spark, str(tmp_path)).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    back = pieces.decode_pieces(pieces.encode_pieces(docs))
    assert back.columns == ["doc_id", "text", "ids", "decoded"]
    assert all((r.text or "").replace("▁", " ") == r.decoded for r in back.collect())
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pieces.op13_sentencepiece(spark, f"{tmp_path}/none").count() == 0
