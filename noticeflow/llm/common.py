"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import noticeflow.llm
from noticeflow.session import ensure_checkpoint_dir

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(noticeflow.llm)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One input table through Spark's own reader, narrowed to the columns an operator uses."""
    ensure_checkpoint_dir(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def saved(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def freed(task: Callable) -> Callable:
    """``task`` (batches to batches), whose memory goes back to the system when it ends.

    Workers live on for later tasks and stages; what one has taken for its caches
    and buffers would otherwise stay with it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)          # of the C library, where it has one
        if trim is not None:
            trim(0)
    return run


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def on_core(docs: DataFrame, core: tuple[str, ...], op: Callable[[DataFrame], DataFrame],
            added: tuple[str, ...] = ()) -> DataFrame:
    """``op`` on the ``core`` columns; all others travel packed in one column, so no name can clash.

    Columns that ``op`` adds come last; a column of ``docs`` of such a name gives way.
    """
    rest = [c for c in docs.columns if c not in core]
    packed = docs.select(*core, *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest_")] if rest else []))
    out = op(packed)
    return out.select(*[F.col(c) if c in core else F.col("rest_").getField(c).alias(c)
                        for c in docs.columns if c not in added], *added)
