"""Folders on the shared file system: looking, removing, and making a written folder visible at once.

Writers stage their files under a hidden name beside the target (readers skip
names that begin with ``_``) and publish them by a rename, so a lost job leaves
either the old folder or the new one.  The rename is atomic where the file
system's is (HDFS, local disks); on an object store it is as safe as its rename.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _hadoop(spark, path)
    return bool(fs.globStatus(p))


def delete(spark: SparkSession, path: str) -> None:
    p, fs = _hadoop(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """The visible entries of a folder, sorted; none if it is missing."""
    p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(p))
    return sorted(n for n in found if not n.startswith(("_", ".")))


def numbered_names(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """What follows ``<prefix>=`` in the entries of a folder, sorted as text."""
    return [n.split("=", 1)[1] for n in names(spark, path) if n.startswith(prefix + "=")]


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers N of the entries ``<prefix>=N`` of a folder, ascending."""
    return sorted(map(int, numbered_names(spark, path, prefix)))


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def publish(spark: SparkSession, staged: str, final: str) -> None:
    """Give the staged folder its final name; a folder already there is set aside first and put back on failure."""
    (s, fs), (f, _) = _hadoop(spark, staged), _hadoop(spark, final)
    fs.mkdirs(f.getParent())
    old, _ = _hadoop(spark, f"{final.rsplit('/', 1)[0]}/_replaced-{uuid.uuid4().hex}")
    had = fs.exists(f)
    if had:
        _rename(fs, f, old)
    try:
        _rename(fs, s, f)
    except Exception:
        if had:
            _rename(fs, old, f)
        raise
    if had:
        fs.delete(old, True)


def write_published(df: DataFrame, final: str, partition_by: str | None = None, allow_empty: bool = True) -> int | None:
    """Write ``df`` beside ``final`` and publish it; the number of rows, counted in the writing pass itself.

    With ``allow_empty=False`` an empty result is removed again, ``final`` stays
    as it was and None is returned.
    """
    spark, final = df.sparkSession, final.rstrip("/")
    staged = f"{final.rsplit('/', 1)[0]}/_staged-{uuid.uuid4().hex}"
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write
    if partition_by:
        writer = writer.partitionBy(partition_by)
    try:
        writer.parquet(staged)
        n = int(seen.get.get("n", 0))
        if n == 0 and not allow_empty:
            return None
        publish(spark, staged, final)
        return n
    finally:
        delete(spark, staged)                   # nothing is left under this name after a publication
