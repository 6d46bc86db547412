import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from noticeflow.llm import piece_codec


@pytest.fixture(scope="module")
def model():
    return piece_codec.Model.read()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_codec.MODEL)


ODD = ["", " ", "  ", "a", " a ", "a  b   c    d", "▁x", "x▁ ▁y", "日本語 テスト", "a\tb\nc\r\n  d", "😀😀 x", "<s> </s> <unk> <0x41>",
       "\x00\x01", "ȡȡȡ", "x" * 3000, " " * 3000 + "y", "é́ﬁ½", "﻿", "hello world " * 300, "� ￿",
       "of the of the", "a" + "▁" * 5]


def made(seed, n):
    rng = random.Random(seed)
    signs = ["a", "b", "é", "日", "😀", " ", "  ", "▁", "<", ">", "0x", "\n", "the", "tion", "ing ", "\t", "ß", "ȡ", "."]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def encoded(spark, rows, model, parts=3):
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, key string, block int")
    return piece_codec.encode(df.repartition(parts), model)


def test_equals_the_library_both_ways(spark, model, library):
    texts = ODD + made(1, 600)
    rows = list(enumerate(texts))
    back = piece_codec.decode(encoded(spark, rows, model), model).collect()
    assert len(back) == len(rows)
    for r in back:
        want = library.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.ids == want, texts[r.doc_id]
        assert r.text == library.decode(want)


def test_words_alone(model, library):
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("aeionrst日é😀ḁ.,<>0123") for _ in range(rng.randint(1, 25)))
        assert model.segment("▁" + word) == library.encode(word)
        assert model.merged_long("▁" + word) == model.merged("▁" + word)


def test_decoding_any_ids(model, library):
    rng = random.Random(7)
    for _ in range(1500):
        ids = [rng.choice((0, 1, 2, rng.randrange(3, 259), rng.randrange(259, 32000), 259, 28705)) for _ in
               range(rng.randint(0, 12))]
        assert model.decode(np.array(ids, dtype=np.int64)) == library.decode(ids), ids


def test_digests_edges_and_repeated_rows(spark, model, library):
    long = "word  of\n" * 60_000
    rows = [(1, None), (2, ""), (None, "a b"), (3, long), (3, long), (4, "x" * 50_000)]
    got = sorted(map(tuple, piece_codec.digests(encoded(spark, rows, model), model).collect()), key=repr)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert encoded(spark, [], model).collect() == []


def test_small_blocks_and_few_shards_give_the_same(spark, model, monkeypatch):
    rows = list(enumerate(made(3, 200) + ["", None, "same words same words"] * 5))
    want = {r.doc_id: r.ids for r in encoded(spark, rows, model).collect()}
    monkeypatch.setattr(piece_codec, "BLOCK", 100)
    monkeypatch.setattr(piece_codec, "SHARDS", 3)
    assert {r.doc_id: r.ids for r in encoded(spark, rows, model).collect()} == want


def test_each_distinct_word_is_segmented_once():
    import pyarrow as pa
    import zstandard
    calls = []

    class Counting:
        pieces = ["a"] * 9

        def segment(self, word):
            calls.append(word)
            return [len(word)]

    words = [zstandard.compress(b"\xff".join(w)) for w in ([b" x", b"y"], [b"y"], [b" x"])]
    rows = pa.RecordBatch.from_pydict({"block": [b"1", b"2", b"1"], "shard": [0, 0, 5], "words": words})
    out = list(piece_codec.segment_words(Counting())(iter([rows])))
    assert calls == ["▁x", "y", "▁x"] and out[0].num_rows == 3     # once a shard; a word has one shard


def test_the_blocks_are_dealt_once(spark, model):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out = piece_codec.encode(df, model)
    out.collect()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()


def test_a_piece_that_crosses_a_mark_is_refused():
    from sentencepiece import sentencepiece_model_pb2 as pb
    proto = pb.ModelProto()
    with open(piece_codec.MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.pieces[300].piece = "a▁b"
    with pytest.raises(ValueError):
        piece_codec.Model(proto.SerializeToString())
