"""Keyed refresh with state kept in the engine: one row per key, dropped once it is too old.

The state is a RocksDB store that Spark keeps, checkpoints and restores, by
buckets of keys; a micro-batch touches only the buckets of the keys it brings and
of the keys whose time has come.
What changed is written as one folder per batch (``changes/batch_id=N``:
``upsert`` rows with their values, ``expire`` rows with the key), so the rows
written are in proportion to the batch.  The table is the last change of every
key; ``compact`` folds old changes into one base folder.

Age is event time: with a ``max_age`` the watermark stays that far behind the
newest event, a row lives until the watermark passes it, and later rows that
arrive beyond the watermark are dropped.  This is the freshness window with the
newest event as the reference date, whatever the cut of the batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from .. import storage

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
UPSERT, EXPIRE = "upsert", "expire"
AT = "_at"
BUCKET, BUCKETS = "_bucket", 1024               # a checkpoint holds its state by these buckets


class LatestRow(StatefulProcessor):
    """Per key the row with the greatest position, with event time the newest row and ties by position.

    NULL positions come before all others.  The rows of a bucket of keys are one
    value of the state, with one timer for the oldest of them: each call to the
    state is a message, so there are a few a bucket and batch, not a few a key.
    """

    def __init__(self, schema: T.StructType, keys: list[str], pos: str, event_time: str | None):
        self.schema, self.keys, self.pos, self.event_time = schema, keys, pos, event_time
        names = schema.names
        self.key_at = [names.index(c) for c in keys]
        self.order_at = [names.index(c) for c in (event_time, pos) if c]
        self.time_at = names.index(event_time) if event_time else None
        self.changed = Row(*names, "change")

    def init(self, handle) -> None:
        self.handle = handle
        self.rows = handle.getValueState("rows", T.StructType([T.StructField("rows", T.ArrayType(self.schema))]))

    def _key(self, row: tuple) -> tuple:
        return tuple(_plain(row[i]) for i in self.key_at)

    def _order(self, row: tuple) -> tuple:
        return tuple((row[i] is not None, row[i]) for i in self.order_at)

    def _time(self, row: tuple) -> int | None:
        return None if row[self.time_at] is None else row[self.time_at] // 1000

    def _change(self, row: tuple, change: str) -> Row:
        return self.changed(*row, change)

    def _held(self) -> dict[tuple, tuple]:
        held = self.rows.get()
        return {} if held is None else {self._key(r): tuple(r) for r in held[0]}

    def _oldest(self, held: dict[tuple, tuple]) -> int | None:
        return min(map(self._time, held.values()), default=None) if self.event_time else None

    def _keep(self, held: dict[tuple, tuple], timer: int | None) -> None:
        """Store the rows; ``timer`` is the one registered so far."""
        oldest = self._oldest(held)
        if timer is not None and timer != oldest:
            self.handle.deleteTimer(timer)
        if oldest is not None and timer != oldest:
            self.handle.registerTimer(oldest)
        if held:
            self.rows.update(([tuple(r) for r in held.values()],))
        else:
            self.rows.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        at, best = None, {}
        floor = timerValues.getCurrentWatermarkInMs() if self.event_time else None
        for found in rows:
            at = at or [found.__fields__.index(n) for n in self.schema.names]      # by place: a name is searched each time
            row = tuple([found[i] for i in at])
            if self.event_time:
                time = self._time(row)
                if time is None or time < floor:
                    continue                                    # too old, or of no known age
            k = self._key(row)
            if k not in best or self._order(row) > self._order(best[k]):
                best[k] = row
        if not best:
            return
        held = self._held()
        timer = self._oldest(held)
        new = {k: row for k, row in best.items() if k not in held or self._order(row) > self._order(held[k])}
        if new:
            held.update(new)
            self._keep(held, timer)
        for row in new.values():
            yield self._change(row, UPSERT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        held, floor = self._held(), timerValues.getCurrentWatermarkInMs()
        gone = {k: row for k, row in held.items() if self._time(row) < floor}
        # the timer that has fired is gone by itself
        self._keep({k: row for k, row in held.items() if k not in gone}, None)
        for row in gone.values():
            yield self._change(row, EXPIRE)

    def close(self) -> None:
        pass


def _plain(value):
    """A key's value as a dictionary key that is equal when Spark groups the values together."""
    if isinstance(value, float):
        return "NaN" if value != value else value + 0.0
    return value if getattr(value, "__hash__", None) and not isinstance(value, tuple) else repr(value)


def _bucket(schema: T.StructType, keys: list[str]) -> Column:
    floats = (T.FloatType, T.DoubleType)
    columns = [F.col(c) + F.lit(0.0) if isinstance(schema[c].dataType, floats) else F.col(c) for c in keys]   # no -0.0
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS))


def changes_dir(out_dir: str, batch_id: int) -> str:
    return f"{out_dir.rstrip('/')}/changes/batch_id={batch_id}"


def keyed_refresh(stream: DataFrame, keys: list[str], pos: str, out_dir: str, checkpoint: str,
                  event_time: str | None = None, max_age: str | None = None):
    """Run the stream over all that has landed; returns the finished query."""
    spark, rows = stream.sparkSession, stream
    if event_time:
        # the state keeps the time in microseconds; the column itself carries the watermark
        utc = stream.schema[event_time].dataType == T.TimestampNTZType()
        stamp = F.to_utc_timestamp(F.col(event_time).cast("timestamp"), F.current_timezone()) if utc else F.col(event_time)
        rows = rows.withColumn(AT, F.unix_micros(stamp.cast("timestamp"))).withColumn(
            event_time, F.timestamp_micros(F.col(AT))).withWatermark(event_time, max_age)
    kept = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != event_time])
    changes = rows.withColumn(BUCKET, _bucket(kept, keys)).groupBy(BUCKET).transformWithState(
        LatestRow(kept, list(keys), pos, AT if event_time else None),
        T.StructType([*kept.fields, T.StructField("change", T.StringType())]), "Update",
        "EventTime" if event_time else "None")
    if event_time:
        changes = changes.withColumn(event_time, F.timestamp_micros(F.col(AT)).cast(
            stream.schema[event_time].dataType)).drop(AT)

    def write(batch: DataFrame, batch_id: int) -> None:
        # an expiry follows the rows of its own batch
        storage.write_published(batch.withColumn("step", F.when(F.col("change") == EXPIRE, 1).otherwise(0)),
                                changes_dir(out_dir, batch_id))

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = changes.writeStream.foreachBatch(write).outputMode("update").option(
            "checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()
    return query


def _folders(spark: SparkSession, out_dir: str) -> tuple[str | None, list[int]]:
    root = out_dir.rstrip("/")
    bases = storage.numbered(spark, f"{root}/base", "upto")
    upto = bases[-1] if bases else -1
    later = [n for n in storage.numbered(spark, f"{root}/changes", "batch_id") if n > upto]
    return (f"{root}/base/upto={upto}" if bases else None), later


def change_log(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """All changes since the last compaction with their ``batch_id``, the base as batch -1."""
    base, later = _folders(spark, out_dir)
    out = None
    if base:
        out = spark.read.parquet(base).withColumn("batch_id", F.lit(-1).cast("long"))
    if later:
        found = spark.read.option("basePath", f"{out_dir.rstrip('/')}/changes").parquet(
            *[changes_dir(out_dir, n) for n in later]).withColumn("batch_id", F.col("batch_id").cast("long"))
        out = found if out is None else out.unionByName(found)
    return out


def current(spark: SparkSession, out_dir: str, keys: list[str]) -> DataFrame:
    """The table: the last change of every key, without the expired ones."""
    log = change_log(spark, out_dir)
    if log is None:
        raise ValueError(f"no batch has been written to {out_dir}")
    others = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("batch_id", "step")).alias("_last"))
    return last.where(F.col("_last.change") == UPSERT).select(
        *[F.col(c) if c in keys else F.col("_last." + c).alias(c) for c in log.columns
          if c not in ("change", "step", "batch_id")])


def compact(spark: SparkSession, out_dir: str, keys: list[str]) -> int | None:
    """Fold all changes so far into a new base; the last batch stays, as a replay may write it again."""
    base, later = _folders(spark, out_dir)
    if len(later) < 2:
        return None
    root, upto = out_dir.rstrip("/"), later[-2]
    found = spark.read.option("basePath", f"{root}/changes").parquet(*[changes_dir(out_dir, n) for n in later[:-1]])
    found = found.withColumn("batch_id", F.col("batch_id").cast("long"))
    if base:
        found = found.unionByName(spark.read.parquet(base).withColumn("batch_id", F.lit(-1).cast("long")))
    others = [c for c in found.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct("batch_id", "step")).alias("_last"))
    kept = last.where(F.col("_last.change") == UPSERT).select(
        *keys, *[F.col("_last." + c).alias(c) for c in others if c != "batch_id"])
    n = storage.write_published(kept, f"{root}/base/upto={upto}")
    for batch in later[:-1]:
        storage.delete(spark, changes_dir(out_dir, batch))
    if base:
        storage.delete(spark, base)
    return n
