import random

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from cellweave.llm import sentencepieces as sp


@pytest.fixture(scope="module")
def codec():
    return sp.Codec()


@pytest.fixture(scope="module")
def library(codec):
    """The installed library's unigram encoder with the same pieces and log scores."""
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(open(sp.VOCABULARY, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, score in zip(codec.ids.tolist(), codec.scores.tolist()):
        proto.pieces[i].score = score
    return SentencePieceProcessor(model_proto=proto.SerializeToString())


def texts():
    rng = random.Random(1)
    parts = ["the", "of", "ing", "tion", "é", "ñ", "漢字", "🎉", " ", "  ", "\n", "\t", "x", "Q", "1234", "ß", "।", "hello", "World", "​", "    "]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 60))) for _ in range(300)]


def encode(codec, found):
    ids, offsets = codec.encode([t.encode() for t in found])
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:])]


def test_trie_finds_every_key():
    keys = sorted({bytes(random.Random(i).choices(b"abc\xff\x00", k=i % 7 + 1)) for i in range(300)})
    trie, text = sp.DoubleArray(keys), bytes(random.Random(0).choices(b"abc\xff\x00", k=500))
    codes = np.append(np.frombuffer(text, np.uint8).astype(np.int64) + 1, 258)
    got = set(zip(*(x.tolist() for x in trie.matches(codes, np.arange(500)))))
    assert got == {(i, i + len(k), n) for n, k in enumerate(keys) for i in range(500) if text.startswith(k, i)}


def test_equals_the_library(codec, library):
    worth = dict(zip(codec.ids.tolist(), codec.scores.tolist()))
    same, found = 0, texts()
    for text, own in zip(found, encode(codec, found)):
        theirs = library.encode(text)
        score = lambda ids: sum(worth.get(i, 0) for i in ids)
        assert abs(score(own) - score(theirs)) < 1e-2
        assert [i for i in own if i not in worth] == [i for i in theirs if i not in worth]
        same += own == theirs
        assert codec.decode(theirs).decode() == library.decode(theirs)
    assert same >= 0.99 * len(found)


def test_round_trip_of_hostile_texts(codec):
    hostile = ["", " ", "  a  ", "▁▁a ▁", "\x00\x01", "a" * 5000, "é" * 3000, "🎉 " * 400, " \n ", "<0x41><s></s><unk>", "�́"] + texts()
    for text, ids in zip(hostile, encode(codec, hostile)):
        assert codec.decode(ids) == text.encode()


def test_rows(spark, codec):
    rows = [(1, "hello world"), (2, None), (3, ""), (None, "x"), (4, "a"), (4, "a"), (5, "z " * 50000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int").repartition(3)
    got = sp.encode_texts(docs, codec)
    assert all(r.exact and r.n_tokens == len(r.ids) for r in got.collect()) and got.count() == 7
    back = sorted((str(r.doc_id), r.text[:20]) for r in sp.decode_ids(got, codec).collect())
    assert back == sorted((str(d), (t or "")[:20]) for d, t in rows)
    assert sp.encode_texts(docs.limit(0), codec).collect() == []
