import random
from itertools import combinations

from noticeflow.llm import near_join

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    n = min(5, len(w))
    return frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def plain(rows):
    """doc_id -> (class_id, n_links) from all pairs."""
    sets = {i: grams(t) for i, t in rows}
    top = {i: i for i in sets}
    links = dict.fromkeys(sets, 0)

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, j in combinations(sets, 2):
        both = len(sets[i] | sets[j])
        if both and len(sets[i] & sets[j]) >= 0.8 * both - 1e-9:
            links[i] += 1
            links[j] += 1
            a, b = sorted((find(i), find(j)))
            top[b] = a
    return {i: (find(i), links[i]) for i in sets}


def corpus(rng, families=12, size=8):
    rows, i = [], 0
    for f in range(families):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(20, 120))]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.choice((0, 0, 1, 2, 4, 9))):
                words[rng.randrange(len(words))] = f"n{rng.randint(0, 10 ** 6)}"
            rows.append((i, " ".join(words)))
            i += 1
    rng.shuffle(rows)
    return rows


def got(spark, rows):
    out = near_join.near_join(spark.createDataFrame(rows, SCHEMA)).collect()
    return {r.doc_id: (r.class_id, r.n_links) for r in out}


def test_against_all_pairs(spark):
    rows = corpus(random.Random(3))
    assert got(spark, rows) == plain(rows)


def test_blocks_cut_into_parts_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_join, "BLOCK_SHINGLES", 500)
    rows = corpus(random.Random(4), families=3, size=40)
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    long = " ".join(f"t{k}" for k in range(20_000))
    rows = [(1, None), (2, ""), (3, ""), (4, "one two"), (5, "ONE  two"), (6, "two one"), (7, long), (8, long + " end")]
    assert got(spark, rows) == {1: (1, 0), 2: (2, 0), 3: (3, 0), 4: (4, 1), 5: (4, 1), 6: (6, 0), 7: (7, 1), 8: (7, 1)}
    assert got(spark, []) == {}


def test_null_and_repeated_ids(spark):
    text = "a b c d e f g h"
    out = near_join.near_join(spark.createDataFrame([(None, text), (1, text), (1, text), (2, "z y x")], SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in out) == [(0, 0, 0), (1, 1, 1), (1, 1, 1), (2, 2, 0)]


def test_one_per_class_keeps_every_column_and_null_ids(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(3, text, "x"), (1, text, "y"), (2, None, "z"), (None, text, "n"), (1, text, "y")],
                               "doc_id long, text string, block string")
    assert sorted((r.doc_id or 0, r.block) for r in near_join.one_per_class(df).collect()) == \
        [(0, "n"), (1, "y"), (2, "z")]


def test_equal_ids_with_different_texts(spark):
    out = near_join.near_join(spark.createDataFrame(
        [(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u")], SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in out) == [(1, 1, 0), (1, 1, 1), (2, 1, 1)]


def test_components_of_a_long_chain(spark):
    n = 40
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[k], ids[k + 1]) for k in range(n - 1)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in near_join.components(edges).collect()}
    assert found == {**dict.fromkeys(range(n), 0), 100: 100, 101: 100}


def test_bars_drop_only_what_cannot_reach_the_threshold():
    bars = near_join.least_matches()
    assert len(bars) == near_join.HASHES // near_join.STEP
    for step, bar in enumerate(bars, 1):
        assert 0 < bar < 0.8 * step * near_join.STEP
