import json
import os
import random

import pytest
from pyspark.sql import functions as F

from noticeflow.sources import json_arrays as ja

SCHEMA = "id string, n long, links array<struct<titulo:string,url:string>>"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def texts(rng, n):
    signs = ["a", "ñ", '"', "\\", "{", "}", "[", "]", ",", ":", "\n", "},", '"}', " ", "日"]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 12))) for _ in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_of_one_file_in_many_tasks(spark, small_splits, tmp_dir, indent):
    rng = random.Random(3)
    rows = [{"id": t, "n": k, "links": [{"titulo": u, "url": t} for u in texts(rng, k % 3)]}
            for k, t in enumerate(texts(rng, 150))]
    path = os.path.join(tmp_dir, "a.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(rows, f, ensure_ascii=False, indent=indent)
    assert spark.read.option("lineSep", "}").text(path).rdd.getNumPartitions() > 4
    got = ja.read_objects(spark, path, SCHEMA).orderBy("pos").collect()
    assert [(r.id, r.n, [x.asDict() for x in r.links]) for r in got] == [(r["id"], r["n"], r["links"]) for r in rows]
    assert [r.pos for r in got] == list(range(len(rows)))


def test_scalars_and_several_files(spark, small_splits, tmp_dir):
    rng = random.Random(5)
    want = {}
    for name in ("x", "y"):
        want[name] = texts(rng, 120)
        with open(os.path.join(tmp_dir, name + ".json"), "w", encoding="utf-8") as f:
            json.dump(want[name], f, ensure_ascii=False, indent=1 if name == "y" else None)
    got = ja.read_scalars(spark, tmp_dir).withColumn("name", F.regexp_extract("file", r"(\w)\.json$", 1)).collect()
    for name, values in want.items():
        assert [r.value for r in sorted((r for r in got if r.name == name), key=lambda r: r.pos)] == values


def test_empty_arrays_and_missing_keys(spark, tmp_dir):
    for name, body in (("e", "[]"), ("f", " [ ] \n"), ("g", '[{"id": "1"}, {}]')):
        with open(os.path.join(tmp_dir, name + ".json"), "w") as f:
            f.write(body)
    got = ja.read_objects(spark, tmp_dir, SCHEMA).orderBy("pos").collect()
    assert [(r.id, r.n, r.pos) for r in got] == [("1", None, 0), (None, None, 1)]
    assert ja.read_scalars(spark, os.path.join(tmp_dir, "e.json")).collect() == []
