"""Deterministic deduplication and per-group top-k.

``dropDuplicates`` keeps an arbitrary row, so it is never used: every choice
orders by an explicit position.  k = 1 choices are aggregations
(``max_by``/``min_by``) which Spark pre-aggregates map-side, so a hot key never
collects its rows in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _value_cols(df: DataFrame, keys) -> list:
    return [c for c in df.columns if c not in keys]


def last_wins(df: DataFrame, keys, pos: Column, first_pos_as: str | None = "first_pos") -> DataFrame:
    """One row per key: values of the last occurrence, position of the first.

    This is a dict assignment loop: ``d[key] = row`` keeps the first insertion
    slot and the latest value.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    vals = _value_cols(df, keys)
    agg = [F.max_by(F.struct(*vals), pos).alias("_v")]
    if first_pos_as:
        agg.append(F.min(pos).alias(first_pos_as))
    out = df.groupBy(*keys).agg(*agg)
    cols = [F.col(k) for k in keys] + [F.col("_v." + c).alias(c) for c in vals]
    if first_pos_as:
        cols.append(F.col(first_pos_as))
    return out.select(*cols)


def first_wins(df: DataFrame, keys, pos: Column) -> DataFrame:
    """One row per key: the first occurrence (a ``seen`` set)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    vals = _value_cols(df, keys)
    out = df.groupBy(*keys).agg(F.min_by(F.struct(*vals), pos).alias("_v"))
    return out.select(*[F.col(k) for k in keys], *[F.col("_v." + c).alias(c) for c in vals])


def top_k_per_group(df: DataFrame, group_cols, order_cols, k: int, rank_as: str = "rank") -> DataFrame:
    """First ``k`` rows per group.  ``row_number() <= k`` lets Spark insert a
    partial ``WindowGroupLimit`` before the shuffle, so at most k rows per group
    and map task cross the network even for a hot group."""
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    return df.withColumn(rank_as, F.row_number().over(w)).where(F.col(rank_as) <= k)


def duplicate_rows(df: DataFrame, key: str, pos: Column) -> DataFrame:
    """Second and later occurrences of a key (first by ``pos`` is not flagged).

    Computed as an aggregate of the first position joined back, not as a window
    partitioned by the key, so a hot key is pre-aggregated and AQE can split it.
    """
    firsts = df.groupBy(key).agg(F.min(pos).alias("_first"))
    return df.join(firsts, key).where(pos > F.col("_first")).drop("_first")
