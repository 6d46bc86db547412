"""First-match containment of texts against an ordered term list (district detection).

"The first term, in declared order, whose key is a substring of the text's
key."  A theta join in meaning, planned as equi-joins: the windows of a text
(``WINDOW`` characters from every position) meet the terms that begin alike (the
longest of ``SEEDS`` characters that the term has), and what meets is verified in
place, so no text is copied or shuffled.  Terms are numbered in their order and
joined block by block, each of a bounded size; texts that a block has labelled
are not looked at again.  Neither list is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import materialize
from .common import global_row_number

SEEDS = (1, 2, 3, 8)
WINDOW = 32
BLOCK = 100_000


def _seed_size(key: Column) -> Column:
    return F.greatest(*[F.when(F.length(key) >= n, F.lit(n)) for n in SEEDS])


def _windows(rows: DataFrame, sizes, width: int) -> DataFrame:
    """(row, window, gram): the text from every position on, with what it begins with in each of the sizes."""
    found = rows.select("_row", F.explode(F.regexp_extract_all(
        "_key", F.lit(r"(?s)(?![\x{DC00}-\x{DFFF}])(?=(.{1,%d}))" % width), F.lit(1))).alias("window"))
    grams = F.array_distinct(F.array(*[F.substring("window", 1, n) for n in sizes]))
    return found.select("_row", "window", F.explode(grams).alias("gram"))


def first_numbers(rows: DataFrame, terms: DataFrame, sizes, width: int) -> DataFrame:
    """(row, n): the least number of the ``terms`` (n, k, gram) that the rows' keys contain."""
    asked = F.broadcast(terms.select("n", "k", "gram", F.substring("k", 1, width).alias("head")))
    met = _windows(rows, sizes, width).join(asked, "gram").where(F.col("window").startswith(F.col("head")))
    sure = met.where(F.length("k") <= width).groupBy("_row").agg(F.min("n").alias("n"))
    if width < WINDOW:
        return sure                                     # no term is longer than a window
    long = met.where(F.length("k") > width).select("_row", "n", "k").distinct().join(
        rows.select("_row", "_key"), "_row").where(F.col("_key").contains(F.col("k"))).select("_row", "n")
    return sure.unionByName(long).groupBy("_row").agg(F.min("n").alias("n"))


def first_match(df: DataFrame, text_col: str, terms: DataFrame, ord_col: str, term_col: str,
                out: str = "label") -> DataFrame:
    """Adds ``out``: the first matching term (by ``ord_col``) or '' when none matches.

    Terms without any letter (an empty key) match nothing; of terms with one key the first counts.
    """
    listed = terms.select(F.col(ord_col).alias("o"), tx.text_key(term_col).alias("k"),
                          F.col(term_col).alias("t")).where("k <> ''").groupBy("k").agg(
        F.min(F.struct("o", "t")).alias("first")).select("first.o", "k", "first.t")
    listed = materialize(global_row_number(listed, ["o", "t", "k"], "n").withColumn("size", _seed_size(F.col("k"))).withColumn(
        "gram", F.expr("substring(k, 1, size)")))
    rows = materialize(df.withColumn("_key", tx.text_key(text_col)).withColumn("_row", F.monotonically_increasing_id()).repartition(
        "_row"))                                    # a file of few parts would leave the windows to few tasks
    last, longest = listed.agg(F.max("n"), F.max(F.length("k"))).first()
    if not last:
        return rows.withColumn(out, F.lit("")).drop("_key", "_row")
    sizes = [r[0] for r in listed.select("size").distinct().collect()]       # of SEEDS
    left, first = rows.select("_row", "_key"), None
    for low in range(0, last, BLOCK):
        block = listed.where((F.col("n") > low) & (F.col("n") <= low + BLOCK))
        found = first_numbers(left, block, sizes, min(longest, WINDOW))
        if last > BLOCK:
            found = materialize(found)
            left = left.join(found, "_row", "left_anti")
        first = found if first is None else first.unionByName(found)
    labels = first.join(listed.select("n", "t"), "n").select("_row", F.col("t").alias("_t"))
    return rows.join(labels, "_row", "left").withColumn(out, F.coalesce("_t", F.lit(""))).drop("_key", "_row", "_t")
