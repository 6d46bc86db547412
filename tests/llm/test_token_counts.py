import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from noticeflow.llm import token_counts


def reference(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary.pieces, 0, byte_fallback=vocabulary.byte_pieces))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda x: len(t.encode(x, add_special_tokens=False).ids)


@pytest.fixture(scope="module")
def vocabulary():
    return token_counts.read_vocabulary()


ODD = ["", " ", "  a", "a  b", "▁x", "x▁y", "日本語 テスト", "a\tb\nc", "😀😀 x", "<s> hi <0x41>", "\x00\x01", "ȡȡȡ", "x" * 3000]


def test_counts_equal_the_tokenizer(vocabulary):
    want, counts, rng = reference(vocabulary), token_counts.Counts(vocabulary), random.Random(3)
    made = ["".join(rng.choice("ab é日😀 ▁<>0x\nthe") for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    for text in ODD + made:
        assert counts.of(text) == want(text), text


@pytest.mark.parametrize("seed", range(6))
def test_ties_and_unknown_characters(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(25)}
    v = token_counts.Vocabulary([("<unk>", 0.0)] + [(p, float(-rng.randint(1, 3))) for p in sorted(pieces)], False)
    want, counts = reference(v), token_counts.Counts(v)
    for _ in range(300):
        text = "".join(rng.choice("abcd ") for _ in range(rng.randint(0, 14)))
        assert counts.of(text) == want(text), text


def test_edges(spark, vocabulary):
    long = "word " * 40_000
    rows = [(1, None, 5), (2, "", 5), (None, "a b", 5), (3, long, 5), (3, long, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = token_counts.with_counts(df, vocabulary).collect()
    want = reference(vocabulary)
    assert [(r.doc_id, r.n_tokens) for r in out] == [(i, want(t or "")) for i, t, _ in rows]
    assert token_counts.with_counts(df.limit(0), vocabulary).collect() == []


def test_small_cache_gives_the_same_counts(vocabulary, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    text = "the quick brown fox jumps over the lazy dog again"
    assert token_counts.Counts(vocabulary).of(text) == reference(vocabulary)(text)
