"""A keyed snapshot in buckets, of which a batch rewrites only those its keys fall into.

Keys are dealt into a fixed number of buckets by a hash.  The data of a bucket
lies in ``data/version=N/bucket=B``, N being the batch that last wrote it; a map
(``map/batch_id=N``, a row per bucket) names the version of every bucket.  A
batch reads the old rows of its buckets, merges, writes the buckets under its own
number and publishes its map last, so readers see a batch whole or not at all,
and a replayed batch writes the same folders again.  Versions that neither the
newest map nor the one before it names are removed.

The map and the list of touched buckets are all that reaches the driver: at most
``BUCKETS`` rows, a parameter fixed with the first batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage

BUCKETS = 64


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    """The bucket of a key: the first 32 bits of its MD5 modulo the number of buckets; NULL like the empty text."""
    text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def _map_dir(out_dir: str, batch_id: int) -> str:
    return f"{out_dir.rstrip('/')}/map/batch_id={batch_id}"


def _data_dir(out_dir: str, version: int, bucket: int | None = None) -> str:
    path = f"{out_dir.rstrip('/')}/data/version={version}"
    return path if bucket is None else f"{path}/bucket={bucket}"


def bucket_map(spark: SparkSession, out_dir: str, batch_id: int | None = None) -> dict[int, int]:
    """Bucket to version as of a batch (the newest by default); empty before the first."""
    known = [n for n in storage.numbered(spark, f"{out_dir.rstrip('/')}/map", "batch_id")
             if batch_id is None or n <= batch_id]
    if not known:
        return {}
    return {r.bucket: r.version for r in spark.read.parquet(_map_dir(out_dir, known[-1])).collect()}


def read_buckets(spark: SparkSession, out_dir: str, versions: dict[int, int], schema) -> DataFrame | None:
    """The rows of the named buckets; None if there are none."""
    paths = [_data_dir(out_dir, v, b) for b, v in sorted(versions.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else None


def snapshot(spark: SparkSession, out_dir: str) -> DataFrame:
    versions = bucket_map(spark, out_dir)
    if not versions:
        raise ValueError(f"no batch has been written to {out_dir}")
    paths = [_data_dir(out_dir, v, b) for b, v in sorted(versions.items())]
    return spark.read.parquet(*paths)


def merge_batch(spark: SparkSession, out_dir: str, batch: DataFrame, batch_id: int, key: str,
                merge: Callable[[DataFrame | None, DataFrame], DataFrame], schema, buckets: int = BUCKETS) -> dict:
    """Merge one batch: ``merge(old rows of its buckets or None, batch)``; what was written, for monitoring."""
    batch = batch.persist()
    try:
        touched = [r[0] for r in batch.select(bucket_of(key, buckets)).distinct().collect()]       # at most BUCKETS
        versions = bucket_map(spark, out_dir, batch_id - 1)
        old = read_buckets(spark, out_dir, {b: versions[b] for b in touched if b in versions}, schema)
        rows = merge(old, batch).withColumn("bucket", bucket_of(key, buckets))
        n = 0
        if touched:
            n = storage.write_published(rows.repartition(len(touched), "bucket"), _data_dir(out_dir, batch_id), "bucket")
        now = versions | dict.fromkeys(touched, batch_id)
        storage.write_published(spark.createDataFrame(sorted(now.items()), "bucket int, version long").coalesce(1),
                                _map_dir(out_dir, batch_id))
        stats = {"batch_id": batch_id, "n_buckets": len(touched), "n_rows": n}
        storage.write_published(spark.createDataFrame(
            [tuple(stats.values())], "batch_id long, n_buckets long, n_rows long").coalesce(1),
            f"{out_dir.rstrip('/')}/stats/batch={batch_id}")
        _drop_unused(spark, out_dir, batch_id, set(now.values()) | set(versions.values()))
        return stats
    finally:
        batch.unpersist()


def _drop_unused(spark: SparkSession, out_dir: str, batch_id: int, used: set[int]) -> None:
    """Whole versions that no bucket of the last two maps points to, and older maps."""
    root = out_dir.rstrip("/")
    for version in storage.numbered(spark, f"{root}/data", "version"):
        if version not in used and version < batch_id:
            storage.delete(spark, _data_dir(out_dir, version))
    for old in storage.numbered(spark, f"{root}/map", "batch_id")[:-2]:
        storage.delete(spark, _map_dir(out_dir, old))


def batch_stats(spark: SparkSession, out_dir: str) -> DataFrame:
    """(batch_id, n_buckets, n_rows): what each batch rewrote."""
    return spark.read.parquet(f"{out_dir.rstrip('/')}/stats").select("batch_id", "n_buckets", "n_rows")
