"""JSON array files read in splits: one large array keeps as many tasks busy as it has byte ranges.

Spark's text reader cuts a file into byte ranges and finds the next separator in
each by itself.  With a closing brace (objects) or a comma (scalars) as the
separator a file becomes pieces in order; which separators are structure and
which stand inside a string or a nested value follows from running sums over the
pieces: quotes (an odd number so far means inside a string; a backslash only
occurs in strings, and neither separator is ever escaped) and braces.  The sums
run inside a split, and the totals of the splits, a row each, give every split
its start.  Pieces up to a closing separator are one element, which is parsed
with the given schema, and its number is its position in the array.

No file is read by one task as a whole, and no row holds more than one element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

STRING = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|\z)'


def _pieces(spark: SparkSession, path: str, separator: str) -> DataFrame:
    """(file, split, seq, value): the text between separators, in order."""
    lines = spark.read.option("lineSep", separator).text(path)
    meta = F.col("_metadata")
    return lines.select(meta.file_path.alias("file"), meta.file_block_start.alias("split"),
                        F.monotonically_increasing_id().alias("seq"), "value")


def _running(rows: DataFrame, amount: Column, name: str, before: bool) -> DataFrame:
    """Adds the sum of ``amount`` over a file's pieces so far, without the piece itself if ``before``."""
    rows = rows.withColumn("_n", amount)
    totals = rows.groupBy("file", "split").agg(F.sum("_n").alias("_total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "split", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, ["file", "split"]).withColumn(name, F.sum("_n").over(inside) + F.col("_start"))
    if before:
        out = out.withColumn(name, F.col(name) - F.col("_n"))
    return out.drop("_n", "_start")


def _with_strings(rows: DataFrame) -> DataFrame:
    """Adds ``plain``, the piece without its strings, and ``quoted``, whether its end lies inside one."""
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    rows = materialize(_running(rows, quotes, "_quotes", before=False).withColumn("_own", quotes))
    begins = (F.col("_quotes") - F.col("_own")) % 2 == 1
    text = F.concat(F.when(begins, F.lit('"')).otherwise(F.lit("")), "value")
    return rows.select("file", "split", "seq", "value", F.regexp_replace(text, STRING, "").alias("plain"),
                       (F.col("_quotes") % 2 == 1).alias("quoted"))


def _elements(rows: DataFrame, closes: Column, separator: str) -> DataFrame:
    """(file, pos, text): the pieces up to every closing one, joined with their separators."""
    numbered = _running(rows, F.when(closes, 1).otherwise(0).cast("long"), "pos", before=True)
    parts = numbered.groupBy("file", "pos").agg(F.sort_array(F.collect_list(F.struct("split", "seq", "value"))).alias("p"))
    return parts.select("file", "pos", F.array_join(F.transform("p", lambda x: x.value), separator).alias("text"))


def read_objects(spark: SparkSession, path: str, schema) -> DataFrame:
    """The objects of the array files in ``path`` as rows with ``pos`` (from 0 in each file) and ``file``."""
    rows = _with_strings(_pieces(spark, path, "}"))
    opens = F.regexp_count("plain", F.lit(r"\{"))
    brace = ~F.col("quoted")
    rows = materialize(_running(rows, opens.cast("long") - F.when(brace, 1).otherwise(0), "_depth", before=False))
    found = _elements(rows, brace & (F.col("_depth") == 0), "}").where(F.col("text").contains("{"))
    body = F.concat(F.regexp_replace("text", r"^[\s\[,]+", ""), F.lit("}"))
    return found.select(F.from_json(body, schema).alias("r"), F.col("pos").cast("int").alias("pos"), "file").select(
        "r.*", "pos", "file")


def read_scalars(spark: SparkSession, path: str) -> DataFrame:
    """(value, pos, file) of the array files of scalars in ``path``."""
    rows = materialize(_with_strings(_pieces(spark, path, ",")))
    found = _elements(rows, ~F.col("quoted"), ",")
    body = F.concat(F.lit("["), F.regexp_replace(F.regexp_replace("text", r"^\s*\[", ""), r"\]\s*$", ""), F.lit("]"))
    value = F.from_json(body, "array<string>")
    return found.select(F.explode(value).alias("value"), F.col("pos").cast("int").alias("pos"), "file")
