"""The state of a keyed refresh is kept by buckets of keys: few calls to it, whatever the number of keys."""

import os

from pyspark.sql import Row
from pyspark.sql import types as T

from noticeflow.streaming import ingest
from noticeflow.streaming import state as st

SCHEMA = T.StructType([T.StructField("k", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("_at", T.LongType())])
IN = Row("_at", "n", "k", "_bucket")


class Handle:
    """Stands for the state of one bucket and counts what is asked of it."""

    def __init__(self):
        self.calls, self.value, self.timers, self.floor = 0, None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value

    def clear(self):
        self.calls += 1
        self.value = None

    def registerTimer(self, t):
        self.calls += 1
        self.timers.add(t)

    def deleteTimer(self, t):
        self.calls += 1
        self.timers.remove(t)

    def getCurrentWatermarkInMs(self):
        return self.floor


def test_a_bucket_costs_a_few_calls_however_many_keys(spark):
    handle, rows = Handle(), st.LatestRow(SCHEMA, ["k"], "n", "_at")
    rows.init(handle)

    def put(found):
        before = handle.calls
        out = [(r.k, r.n, r.change) for r in rows.handleInputRows((7,), iter(found), handle)]
        assert handle.calls - before <= 4
        return out

    many = [IN(5_000_000 + k * 1000, k, float(k), 7) for k in range(1000)]
    assert len(put(many)) == 1000 and handle.timers == {5000}
    assert put(many) == []                                      # nothing is newer
    new = put([IN(4_000_000, 1, None, 7), IN(4_000_000, 3, None, 7), IN(9_000_000, 2, float("nan"), 7),
               IN(9_000_000, 4, float("nan"), 7), IN(9_500_000, 5, -0.0, 7)])
    assert [(str(k), n) for k, n, _ in new] == [("None", 3), ("nan", 4), ("-0.0", 5)]
    assert handle.timers == {4000} and len(handle.value[0]) == 1002
    handle.floor, handle.timers = 5002, set()
    before = handle.calls
    gone = [(r.k, r.change) for r in rows.handleExpiredTimer((7,), handle, None)]
    assert gone == [(1.0, "expire"), (None, "expire")] and handle.calls - before <= 3
    assert handle.timers == {5002}
    assert put([IN(5_001_999, 99, 1.0, 7)]) == []               # beyond the watermark
    handle.floor, handle.timers = 10_000_000, set()
    assert len(list(rows.handleExpiredTimer((7,), handle, None))) == 1000
    assert handle.value is None and handle.timers == set()


def test_keys_that_share_a_bucket(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(st, "BUCKETS", 2)
    landing, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    schema = "a string, k double, n long"
    want = {}
    for part in range(2):
        rows = [(None if k % 5 == 0 else f"a{k % 3}", float("nan") if k % 7 == 0 else -0.0 if k % 11 == part else float(k % 20),
                 k * (-1) ** k) for k in range(part * 50, part * 50 + 100)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(landing)
        got = ingest.run_keyed_refresh(spark, landing, spark.createDataFrame([], schema).schema, out, ["a", "k"], "n", None, ckpt)
        for a, k, n in rows:
            want[a, str(k + 0.0)] = max(n, want.get((a, str(k + 0.0)), n))
        found = got.collect()
        assert len(found) == len(want) and {(r.a, str(r.k + 0.0)): r.n for r in found} == want
