"""Helpers shared by the operators: lineage order, global numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import materialize


def lineage_pos(src_ord="src_ord", page_id="page_id", card_pos="card_pos") -> Column:
    """The order of a row in the original list-of-lists: (source order, page, card)."""
    return F.struct(F.col(src_ord).alias("s"), F.col(page_id).alias("p"), F.col(card_pos).alias("c"))


def global_row_number(df: DataFrame, order: list, name: str = "row_no") -> DataFrame:
    """1-based position of every row in a total order, without a single-partition window over the rows.

    The rows are range-sorted and saved with the number of their partition, so
    both stay as they are.  Counts per partition give each one its offset (one
    row per partition), and a window inside each partition counts on from there.
    """
    keys = [f"_k{i}" for i in range(len(order))]
    keyed = df.select("*", *[o.alias(k) if isinstance(o, Column) else F.col(o).alias(k) for o, k in zip(order, keys)])
    placed = materialize(keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    return (placed.join(offsets, "_part")
            .withColumn(name, F.row_number().over(inside) + F.col("_off"))
            .drop("_part", "_off", *keys))
