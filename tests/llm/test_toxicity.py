import random
import zlib

import pytest

from noticeflow.llm import toxicity

BAD = ("blockhead", "nitwit", "dunce", "rotter", "wretch")


def corpus(n=260, seed=1):
    rng = random.Random(seed)
    parts = ("ka", "lo", "min", "ter", "sa", "vo", "ri", "pel", "du", "ne")
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(600)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 80))]
        toxic = int(rng.random() < 0.4)
        for _ in range(2 * toxic):
            text.insert(rng.randint(0, len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text), toxic))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, toxicity.train(docs, labels)


def test_held_out_accuracy(spark, data):
    rows, docs, labels, _ = data
    out = {r.doc_id: r for r in toxicity.scored(docs, labels).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in out.items() if r.held_out} == set(held)
    label = {i: y for i, _, y in rows}
    right = sum(out[i].predicted == label[i] for i in held)
    assert right >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())


def test_gapped_and_padded_words(data):
    model = data[3]
    for word in ("blockhead", "b.l.o.c.k.h.e.a.d", "block*head", "bloxckhead", "nitwwit", "n-i-t-w-i-t", "WRETCH,"):
        assert model.score(model.margins([word.lower()])[0]) >= 0.5, word
    assert model.score(max(model.margins(sorted(toxicity.words_of("oh you n i t w i t there"))))) >= 0.5
    assert model.score(model.margins(["kalomin"])[0]) < 0.5


def test_training_ignores_held_out_labels(spark, data):
    rows, docs, labels, model = data
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    other = toxicity.train(docs, flipped)
    assert (other.triples == model.triples).all() and other.bias == model.bias


def test_edges(spark, data):
    model = data[3]
    long = "kalo " * 50_000 + "nitwit"
    rows = [(1, None, "a"), (2, "", "b"), (None, "nitwit", "c"), (3, long, "d"), (3, long, "d"), (4, "x" * 5_000, "e"),
            (5, "!!! ... ---", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    out = toxicity.with_score(df, model).collect()
    score = {r.doc_id: r._toxicity for r in out}
    assert len(out) == 7 and [r.score for r in out] == [r[2] for r in rows]
    assert score[1] == score[2] == score[5] < 0.5 <= min(score[3], score[None])
    assert toxicity.with_score(df.limit(0), model).collect() == []


def test_without_labels_nothing_is_toxic(spark, data):
    rows, docs, labels, _ = data
    for some in (labels.limit(0), labels.where("toxic = 0"), labels.where("toxic = 1"),
                 spark.createDataFrame([(None, None)], "doc_id long, toxic int")):
        assert {r.score for r in toxicity.scored(docs.limit(5), some).collect()} == {0.0}


def test_kernel_recursion_equals_its_definition():
    import numpy as np
    for word in ("^aba$", "^nitwit$", "^aaaa$"):
        direct = sum(v * v for v in toxicity.subsequences(word).values())
        assert abs(toxicity.self_kernel(np.array([[ord(c) for c in word]]))[0] - direct) < 1e-5
