import math
import random

import pytest

from noticeflow.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, score int"


def plain(rows):
    """Every anchor against every row, in Python's integers."""
    ok = [(i, (y + 1) % 10 if i % 7 == 0 else y, [math.floor(256 * x) for x in v]) for i, v, y in rows
          if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, y, v in ok:
        if a % 50:
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w)), i, z) for i, z, w in ok if i != a)
        for s, i, _ in [r for r in scored if r[2] == y][:5]:
            fit = [r for r in scored if r[2] != y and 50 * -s <= 100 * -r[0] <= 95 * -s][:3]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def made(seed, n, dim=6, spread=0.3, labels=4):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i * 5, [c + rng.gauss(0, spread) for c in rng.choice(centres)], rng.randrange(labels)) for i in range(n)]
    return [(i, [float(f"{x:.3g}") for x in v], y) for i, v, y in rows]


def mined(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, hn.mine(df).collect()))


def as_float32(rows):
    import numpy as np
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y) for i, v, y in rows]


@pytest.mark.parametrize("seed,n,spread", [(1, 300, 0.05), (2, 200, 1.0)])
def test_equals_all_pairs(spark, seed, n, spread):
    rows = as_float32(made(seed, n, spread=spread))
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_small_blocks_and_chunks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK", 7)
    monkeypatch.setattr(hn, "CHUNK", 16)
    rows = as_float32(made(5, 260, spread=0.1))
    assert mined(spark, rows) == plain(rows)


def test_edges(spark):
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [1.0, 0.5], 1), (3, [0.6, 0.5], 2), (4, [0.6, 0.5], 2),
            (6, [0.6, 0.5], 3), (8, [0.61, 0.5], 2), (50, [1.0], 2), (100, [], 1), (150, [-1.0, 2.0], 1),
            (7, [0.9, 0.5], 0), (9, None, 1), (10, [1.0, None], 1), (11, [float("nan"), 1.0], 1),
            (12, [float("inf"), 1.0], 2), (13, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    rows = as_float32(rows)
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0], 1)]) == []


def test_repeated_candidates_and_one_large_group_of_equal_vectors(spark):
    rows = as_float32([(i, [1.0, 0.2, 0.1], 1) for i in range(90)] + [(200 + i, [0.7, 0.3, 0.0], 2) for i in range(80)])
    rows += [rows[1], rows[95]]
    assert mined(spark, rows) == plain(rows)


def test_scores_beyond_float_precision(spark):
    rows = as_float32([(i, [2.0 ** 21 + i * 3.0, 2.0 ** 20 + i, 1.0], i % 2) for i in range(0, 60, 5)] + [
        (61, [2.0 ** 20 + 1, 2.0 ** 20, 1.0], 0), (62, [2.0 ** 20 + 1, 2.0 ** 20, 2.0], 1)])
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_bounds_hold_and_prune():
    import numpy as np
    import pyarrow as pa
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    vectors = np.concatenate([c + rng.normal(scale=0.01, size=(50, 8)) for c in centres])
    group = pa.table({"uid": pa.array(range(40), pa.int64()), "vec_id": pa.array(range(0, 2000, 50), pa.int64()),
                      "label": pa.array([k % 4 for k in range(40)], pa.int64()),
                      "embedding": pa.array(list(vectors[::5]), pa.list_(pa.float64()))})
    from types import SimpleNamespace

    class Row(SimpleNamespace):
        def __getitem__(self, key):
            return getattr(self, key)

    block = hn.Block([Row(**r) for r in hn.spanning_tree(group).to_pylist()])
    rows = np.floor(vectors * 256)
    seen = []

    def wanted(i, low, high):
        true = rows @ block.vectors[i]
        assert (low <= true).all() and (true <= high).all()
        return high >= np.sort(low)[-3]

    done = hn.walk(block, rows, wanted, lambda i, at, scores: seen.append((i, len(at))))
    assert len(seen) == 40 and done < 0.5 * 40 * len(rows)
