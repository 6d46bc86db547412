import heapq
import random

import numpy as np
from pyspark.sql import functions as F

from noticeflow.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def by_heap(weights, seats):
    got = [0] * len(weights)
    heap = [(-w, k) for k, w in enumerate(weights) if w > 0]
    heapq.heapify(heap)
    for _ in range(seats if heap else 0):
        _, k = heapq.heappop(heap)
        got[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * got[k] + 1), k))
    return got


def test_highest_quotients():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.choice((0, 1, 2, 5, rng.randint(1, 10_000))) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 300)
        assert mixing.sainte_lague(np.array(w, float), seats).tolist() == by_heap(w, seats)


def targets(sizes):
    """The rule of the contract, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(order)}
    left, free, out = float(sum(sizes.values())), set(order), {}
    while free:
        share = {s: left * weight[s] / sum(weight[t] for t in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_targets_and_taken_words(spark):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * rng.randint(0, 400)), rng.choice((None, "a", "b", "c", "d", "Ä", "big", "big", "big")))
            for i in range(400)] + [(900, "one two", "tiny")]
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {i: s for i, _, s in rows}
    size, taken, target = {}, {}, {}
    for r in out:
        s = by[r.doc_id]
        size[s] = size.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        target[s] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert all(r.source_size == size[by[r.doc_id]] for r in out) and len(out) == len(rows)
    want = targets(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6
        assert abs(taken[s] - want[s]) <= 2 * mixing.BLOCK_WORDS + 0.01 * want[s]
    again = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


def test_edges(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, None, "a"), (2, "", None), (None, "\x0b\x1c x y z\x00", "b"), (3, "x", "b"), (3, "x", "b")]
    out = sorted(((r.doc_id or 0), r.size, r.taken) for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [o[:2] for o in out] == [(0, 3), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert [o[2] for o in out if not o[1]] == [0, 0]
    only = mixing.mix(spark.createDataFrame([(1, None, None), (2, "", "q")], SCHEMA)).collect()
    assert [r.taken for r in only] == [0, 0] and [r.target for r in only] == [0.0, 0.0]


def test_ranges_and_texts_are_what_is_counted(spark):
    rng = random.Random(3)
    rows = [(i, " \n".join(f"w{i}x{k}" for k in range(rng.randint(0, 300))), rng.choice(("a", "b", "c")), [i, None])
            for i in range(300)] + [(900, None, None, None), (901, "solo", "tiny", [])]
    docs = spark.createDataFrame(rows, SCHEMA + ", extra array<long>")
    mixed = mixing.mix(docs)
    out = mixed.withColumn("pieces", mixing.taken_texts(F.col("text"), F.col("ranges"))).collect()
    by = {r[0]: r for r in rows}
    assert len(out) == len(rows) and any(r.taken > r.size for r in out) and any(0 < r.taken < r.size for r in out)
    for r in out:
        assert (r.doc_id, r.text, r.source, r.extra) == by[r.doc_id]
        words = (r.text or "").split()
        want = [w for g in r.ranges for w in words[g.begin:g.end] * g.times]
        got = [w for p in r.pieces for w in p.split()]
        assert len(want) == r.taken and sorted(want) == sorted(got)
        assert all(p in r.text for p in r.pieces)
    few = mixing.mix(docs, whole=False)
    assert few.columns == ["doc_id", *mixing.COUNTS, "ranges"]
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, mixed.select(few.columns).collect()))
