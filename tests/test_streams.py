"""Keyed refresh in the engine's state, bucketed upserts, folders that are published whole."""

import os

import pytest
from pyspark.sql import functions as F

from noticeflow import storage
from noticeflow.sources import files
from noticeflow.streaming import buckets as bk
from noticeflow.streaming import ingest
from noticeflow.streaming import state as st

SCHEMA = "k string, n long, ts timestamp_ntz, v string"


def land(spark, folder, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, "k string, n long, ts string, v string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    df.repartition(2).write.mode("append").parquet(folder)


def test_late_and_expired_keys_and_a_replay(spark, tmp_dir):
    landing, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    typed = spark.createDataFrame([], SCHEMA).schema
    batches = [
        [("a", 1, "2027-01-01 00:00:00", "a1"), ("b", 2, "2027-01-02 00:00:00", "b1"), ("z", 3, None, "no time")],
        [("a", 4, "2027-01-05 12:00:00", "a2"), ("c", 5, "2027-01-06 00:00:00", "c1"), ("a", 6, "2027-01-05 12:00:00", "a3")],
        [("d", 7, "2027-01-12 00:00:00", "d1"), ("b", 8, "2027-01-01 23:00:00", "b late")],
        [("e", 9, "2027-01-12 06:00:00", "e1"), ("b", 10, "2027-01-06 01:00:00", "b late but fresh"), ("c", 11, "2027-01-05 23:00:00", "c old")],
    ]
    rows = []
    for new in batches:
        land(spark, landing, new)
        rows += [r for r in new if r[2]]
        newest = max(r[2] for r in rows)
        floor = f"2027-01-{int(newest[8:10]) - 7:02d}{newest[10:]}" if int(newest[8:10]) > 7 else ""
        fresh = [r for r in rows if r[2] >= floor]
        want = {k: max((r[2], r[1], r[3]) for r in fresh if r[0] == k)[2] for k in {r[0] for r in fresh}}
        for _ in range(2):                                      # the second run has nothing to read
            got = ingest.run_keyed_refresh(spark, landing, typed, out, "k", "n", None, ckpt, "ts", "7 days")
            assert {r.k: r.v for r in got.collect()} == want
    assert got.schema["ts"].dataType == typed["ts"].dataType
    log = {r.k: r.change for r in st.change_log(spark, out).where("change = 'expire'").collect()}
    assert log == {"b": "expire"}                               # a was renewed before its time
    per_batch = st.change_log(spark, out).groupBy("batch_id").count().collect()
    assert all(r["count"] <= 3 for r in per_batch)              # what a batch writes follows the batch
    st.compact(spark, out, ["k"])
    assert {r.k: r.v for r in st.current(spark, out, ["k"]).collect()} == want
    land(spark, landing, [("e", 12, "2027-01-12 07:00:00", "e2")])
    got = ingest.run_keyed_refresh(spark, landing, typed, out, "k", "n", None, ckpt, "ts", "7 days")
    assert {r.k: r.v for r in got.collect()} == want | {"e": "e2"}


def test_without_event_time_nothing_expires(spark, tmp_dir):
    landing, out, ckpt = (os.path.join(tmp_dir, d) for d in ("in", "out", "ckpt"))
    typed = spark.createDataFrame([], SCHEMA).schema
    land(spark, landing, [("a", None, "2020-01-01 00:00:00", "x"), ("a", 3, "2020-01-01 00:00:00", "y"), (None, 1, None, "null key")])
    ingest.run_keyed_refresh(spark, landing, typed, out, ["k"], "n", None, ckpt)
    land(spark, landing, [("a", 2, "2030-01-01 00:00:00", "older by position")])
    got = ingest.run_keyed_refresh(spark, landing, typed, out, ["k"], "n", None, ckpt)
    assert {r.k: r.v for r in got.collect()} == {"a": "y", None: "null key"}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_dir):
    def merge(old, new):
        if old is None:
            return new
        taken = new.select(F.col("id").alias("_id"))
        return old.join(taken, F.col("id").eqNullSafe(F.col("_id")), "left_anti").unionByName(new)

    schema = spark.createDataFrame([], "id string, v long").schema

    def run(batch_id, rows):
        return bk.merge_batch(spark, tmp_dir, spark.createDataFrame(rows, "id string, v long"), batch_id, "id", merge, schema, 8)

    first = run(0, [(str(k), k) for k in range(100)] + [(None, -1)])
    assert first == {"batch_id": 0, "n_buckets": 8, "n_rows": 101}
    second = run(1, [("3", 333)])
    assert second["n_buckets"] == 1 and second["n_rows"] < 60
    for _ in range(2):                                          # a replayed batch
        run(1, [("3", 333)])
    want = {str(k): k for k in range(100)} | {None: -1, "3": 333}
    assert {r.id: r.v for r in bk.snapshot(spark, tmp_dir).collect()} == want
    assert sorted(set(bk.bucket_map(spark, tmp_dir).values())) == [0, 1]
    run(2, [(str(k), 2 * k) for k in range(100)] + [(None, 5)])
    assert set(bk.bucket_map(spark, tmp_dir).values()) == {2}
    run(3, [("3", 1)])
    assert storage.numbered(spark, f"{tmp_dir}/data", "version") == [2, 3]      # older ones are gone
    assert [(r.batch_id, r.n_buckets) for r in bk.batch_stats(spark, tmp_dir).orderBy("batch_id").collect()] == [
        (0, 8), (1, 1), (2, 8), (3, 1)]
    assert run(4, [])["n_buckets"] == 0
    assert bk.snapshot(spark, tmp_dir).count() == 101


def test_published_folders(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t", "run=1")
    assert storage.write_published(spark.range(5), path, allow_empty=False) == 5
    assert storage.write_published(spark.range(0), path, allow_empty=False) is None
    assert storage.write_published(spark.range(3).where("id > 7"), path, allow_empty=False) is None
    assert spark.read.parquet(path).count() == 5
    assert storage.write_published(spark.range(3), path) == 3
    bad = spark.range(3).select(F.raise_error(F.lit("lost")).alias("x"))
    with pytest.raises(Exception):
        storage.write_published(bad, path)
    assert spark.read.parquet(path).count() == 3 and os.listdir(os.path.dirname(path)) == ["run=1"]
    assert storage.names(spark, os.path.join(tmp_dir, "none")) == []


def test_ledger_runs(spark, tmp_dir):
    path = os.path.join(tmp_dir, "ledger")

    def tokens(*xs):
        return spark.createDataFrame([(x,) for x in xs], "token string")

    def known():
        return sorted(r.token for r in files.read_ledger(spark, path, "parquet").collect())

    files.write_ledger(tokens("a", "b", "b"), path)
    files.append_ledger(tokens("c"), path, "one")
    files.append_ledger(tokens("c"), path, "one")
    files.append_ledger(tokens("d", "e"), path, "two")
    assert known() == ["a", "b", "c", "d", "e"]
    files.release_ledger(tokens("d"), path, "two")
    files.release_ledger(tokens("e"), path, "two")
    assert known() == ["a", "b", "c"]
    files.append_ledger(tokens("d"), path, "three")
    assert known() == ["a", "b", "c", "d"]
