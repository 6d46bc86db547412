"""Incremental ingest: newly landed files run through the same refresh / upsert code.

The refresh keeps one row per key in the engine's state (``state``), the upsert
keeps a bucketed snapshot (``buckets``).  Each batch writes folders named after
its id, so a replayed batch writes the same again; the stream checkpoint lives in
the shared checkpoint folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import merge as mg
from ..session import scratch_path
from . import buckets as bk
from . import state as st


def _checkpoint(spark: SparkSession, checkpoint: str | None) -> str:
    return checkpoint or scratch_path(spark, "stream-checkpoint-" + uuid.uuid4().hex)


def _landed(spark: SparkSession, landing_dir: str, schema, files_per_trigger: int | None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(landing_dir)


def run_keyed_refresh(spark: SparkSession, landing_dir: str, schema, out_dir: str, key, pos: str,
                      files_per_trigger: int | None = 1, checkpoint: str | None = None,
                      event_time: str | None = None, max_age: str | None = None) -> DataFrame:
    """Stream landed files into a last-wins-by-key table; ``pos`` orders all rows, whatever their batch.

    With ``event_time`` and ``max_age`` rows older than that, measured from the
    newest event, are left out and keys expire.
    """
    keys = [key] if isinstance(key, str) else list(key)
    st.keyed_refresh(_landed(spark, landing_dir, schema, files_per_trigger), keys, pos, out_dir,
                     _checkpoint(spark, checkpoint), event_time, max_age)
    return st.current(spark, out_dir, keys)


def run_listing_upsert(spark: SparkSession, landing_dir: str, schema, out_dir: str, key: str = "id",
                       carried=None, files_per_trigger: int | None = 1, checkpoint: str | None = None,
                       buckets: int = bk.BUCKETS) -> DataFrame:
    """Stream landed listing files into a carry-forward upsert snapshot.

    Each row's ``pos`` orders it within its batch; the batch id is put in front
    of it, so a later batch always wins over an earlier one.
    """
    stream = _landed(spark, landing_dir, schema, files_per_trigger)
    extra = {"carried": carried} if carried else {}
    at = T.StructType([T.StructField("b", T.LongType()), T.StructField("p", stream.schema["pos"].dataType)])
    kept = T.StructType([T.StructField(f.name, at if f.name == "pos" else f.dataType) for f in stream.schema.fields])

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            new = new.withColumn("pos", F.struct(F.lit(batch_id).cast("bigint").alias("b"), F.col("pos").alias("p")))
            old = new.limit(0) if old is None else old
            return mg.carry_forward_upsert(old, new, key=key, pos="pos", **extra)

        bk.merge_batch(spark, out_dir, batch, batch_id, key, merge, kept, buckets)

    query = stream.writeStream.foreachBatch(per_batch).option(
        "checkpointLocation", _checkpoint(spark, checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()
    return bk.snapshot(spark, out_dir)
