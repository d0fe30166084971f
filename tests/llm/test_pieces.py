"""SentencePiece encoding and decoding against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from sentencepiece import SentencePieceProcessor

from textweir.llm import pieces
from textweir.llm import queries as q

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(PATH)


def odd_texts(library):
    rng = random.Random(5)
    vocabulary = [library.id_to_piece(i).replace("▁", " ") for i in range(300, 32_000)]
    out = [None, "", " ", "  a\n\tb", "\0x", "▁a", "<s>hi</s>", " " * 700 + "x" + " " * 33, "a" * 2_000, "-" * 600 + "=" * 40,
           "é" * 300, "﻿x\r\n", "x" + "\U0001f600" * 90]
    out += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 12))) for _ in range(1_500)]
    out += ["".join(chr(rng.choice([rng.randint(32, 126), rng.randint(97, 122), rng.randint(0, 0x2FF), rng.randint(0x3000, 0x9FFF),
                                    rng.randint(0x1F300, 0x1F6FF)])) for _ in range(rng.randint(0, 60))) for _ in range(1_500)]
    out += ["".join(rng.choice("abcdeinort ") for _ in range(rng.randint(0, 1_500))) for _ in range(100)]
    return out + ["".join(rng.choice(" -=_.\n#*") for _ in range(rng.randint(0, 900))) for _ in range(100)]


@pytest.mark.parametrize("long_segment", [2, pieces.LONG_SEGMENT, 10**9])  # heap, both, rounds
def test_ids_and_texts_are_those_of_the_library(model, library, monkeypatch, long_segment):
    monkeypatch.setattr(pieces, "LONG_SEGMENT", long_segment)
    monkeypatch.setattr(pieces, "CUT_BYTES", 1_000)
    texts = odd_texts(library)
    ids, bounds = model.encode(pa.array(texts, pa.string()))
    back = model.decode(ids, bounds).to_pylist()
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_eos=True)
        assert ids[bounds[i]:bounds[i + 1]].tolist() == want
        assert back[i] == library.decode(want)


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(6)
    lists = [[rng.randrange(0, 400) for _ in range(rng.randint(0, 9))] for _ in range(4_000)]
    lists += [[1, 1, 259, 29871], [13, 259], [259], [], [204, 2, 150], [0, 0], [2, 28705, 28705]]
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    got = model.decode(np.array([i for x in lists for i in x], np.int32), bounds).to_pylist()
    assert got == [library.decode(x) for x in lists]


def test_rows(spark, library):
    rows = [(1, None), (1, ""), (None, "a b"), (2, "a b"), (2, "a b"), (3, "word " * 60_000)]
    docs = spark.createDataFrame([(i, t, [7], "x") for i, t in rows], "doc_id bigint, text string, ids array<int>, model string")
    made = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = [(i, library.encode(t or "", add_eos=True), t or "") for i, t in rows]
    assert sorted(map(tuple, made), key=key) == sorted(want, key=key)
    assert pieces.encode(docs.limit(0), PATH).collect() == []
    lists = spark.createDataFrame([(1, None), (2, []), (3, [None, 264, None])], "doc_id bigint, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(lists, PATH).collect()} == {1: None, 2: "", 3: "a"}
    with pytest.raises(Exception, match="beyond the vocabulary"):
        pieces.decode(spark.createDataFrame([(1, [99_999])], "doc_id bigint, ids array<int>"), PATH).collect()


def test_query_against_the_library(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: r for r in q.op12_sentencepiece(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_eos=True)
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()
