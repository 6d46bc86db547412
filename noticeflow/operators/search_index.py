"""A stored trigram index for the interactive search: texts are keyed once, needles look them up.

``texts/`` holds every row with its search key (``hay``), a row number and the
block of ``BLOCK`` row numbers it lies in, as the folder it is stored in;
``postings/`` holds, per trigram and block, the sorted row numbers of the texts
that contain it, range-partitioned by trigram.  A needle reads the postings of
its trigrams only, intersects them block by block, and verifies the surviving
rows against their keys; the join on the block prunes the folders of texts that
have no survivor.  A needle of fewer than three characters has no trigram and is
looked for in the stored keys.

A list in the postings is never longer than a block, however frequent its
trigram.  Both tables are published whole (``storage``).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import storage
from ..functions import text as tx

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_BITS = 16
GRAM = 3
GRAMS = "(?s)(?=(.{%d}))" % GRAM
CHUNK_CHARS = 2_000_000
LISTS = "gram string, block long, rows array<long>"


def haystack(fields) -> Column:
    return tx.search_key(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in fields]))


def grams(key: Column) -> Column:
    """The distinct trigrams of a key."""
    return F.array_distinct(F.regexp_extract_all(key, F.lit(GRAMS), F.lit(1)))


def _lists(points: np.ndarray, sizes: np.ndarray, numbers: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(code points of the different trigrams, where each one's list ends, the lists) of texts laid end to end."""
    seen = np.zeros(int(points.max(initial=0)) + 1, bool)
    seen[points] = True
    letters, n = np.flatnonzero(seen), len(sizes)
    if n > 1 and len(letters) ** GRAM * n >= 1 << 63:               # a code would not fit: texts apart
        half = n // 2
        cut = int(sizes[:half].sum())
        yield from _lists(points[:cut], sizes[:half], numbers[:half])
        yield from _lists(points[cut:], sizes[half:], numbers[half:])
        return
    codes = (np.cumsum(seen) - 1)[points]
    owner = np.repeat(np.arange(n), sizes)
    m = max(0, len(codes) - GRAM + 1)
    gram = codes[:m]
    for k in range(1, GRAM):
        gram = gram * len(letters) + codes[k:m + k]
    found = gram * n + owner[:m]
    found = np.sort(found[owner[:m] == owner[GRAM - 1:]])
    found = found[np.append(True, found[1:] != found[:-1])[:len(found)]]
    gram, owner = found // n, found % n
    last = np.flatnonzero(np.append(gram[1:] != gram[:-1], True)) if len(gram) else np.zeros(0, np.int64)
    powers = len(letters) ** np.arange(GRAM - 1, -1, -1)
    yield letters[gram[last][:, None] // powers % max(1, len(letters))], last + 1, numbers[owner]


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stored keys to the lists of their trigrams, as far as one chunk of a block's texts goes."""
    for batch in batches:
        sizes = pc.utf8_length(batch.column("hay")).to_numpy(zero_copy_only=False).astype(np.int64)
        block, row = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "row"))
        part = (np.cumsum(sizes) - sizes) // CHUNK_CHARS
        cut = np.flatnonzero((np.diff(part) != 0) | (np.diff(block) != 0)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            keys = "".join(batch.column("hay").slice(a, b - a).to_pylist())
            points = np.frombuffer(keys.encode("utf-32-le"), np.uint32)
            for grams, ends, rows in _lists(points, sizes[a:b], row[a:b]):
                text = grams.astype(np.uint32).tobytes().decode("utf-32-le")
                offsets = np.append(0, ends).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array([text[i:i + GRAM] for i in range(0, len(text), GRAM)], pa.string()),
                    pa.array(np.full(len(ends), block[a] if b > a else 0, np.int64)),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows, pa.int64()))], ["gram", "block", "rows"])


def build(df: DataFrame, path: str, fields=("titulo", "entidad", "distrito"), keep=("id", "distrito")) -> str:
    """Write the index of ``df``: its key columns ``keep`` and the search key of ``fields``."""
    spark, root = df.sparkSession, path.rstrip("/")
    number = F.monotonically_increasing_id()
    rows = df.select(*keep, haystack(fields).alias("hay"), number.alias("row")).withColumn(
        "block", F.shiftright("row", BLOCK_BITS))
    storage.write_published(rows, f"{root}/texts", "block")
    parts = texts(spark, root).select("block", "row", "hay").mapInArrow(_postings, LISTS)
    lists = parts.groupBy("gram", "block").agg(F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    storage.write_published(lists.repartitionByRange("gram").sortWithinPartitions("gram", "block"), f"{root}/postings")
    return root


def texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/texts").withColumn("block", F.col("block").cast("long"))


def postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/postings")


def _on_driver(spark: SparkSession, value: Column):
    """A constant expression's value."""
    return spark.createDataFrame([(0,)], "x int").select(value).first()[0]


def candidates(spark: SparkSession, path: str, needle_grams: list[str]) -> DataFrame:
    """(block, row) of the texts that hold all the trigrams."""
    lists = postings(spark, path).where(F.col("gram").isin(needle_grams))
    both = lists.groupBy("block").agg(F.collect_list("rows").alias("lists")).where(
        F.size("lists") == len(needle_grams))
    common = F.aggregate(F.slice("lists", 2, len(needle_grams)), F.col("lists")[0], F.array_intersect)
    return both.select("block", F.explode(common).alias("row"))


def matches(spark: SparkSession, path: str, text: str | None) -> DataFrame:
    """The stored rows whose key contains the text's key; all rows for a text without any character to look for."""
    found = texts(spark, path)
    needle = _on_driver(spark, tx.search_key(F.lit(text or "")))
    if needle == "":
        return found
    if len(needle) >= GRAM:
        wanted = _on_driver(spark, grams(F.lit(needle)))
        found = found.join(candidates(spark, path, list(wanted)), ["block", "row"])
    return found.where(F.col("hay").contains(needle))


def search(spark: SparkSession, path: str, text: str | None = None, district: str | None = None,
           saved: DataFrame | None = None, district_col: str = "distrito", key: str = "id") -> DataFrame:
    """Rows (the kept columns) matching every non-empty parameter."""
    out = matches(spark, path, text)
    if district:
        out = out.where(F.col(district_col) == F.lit(district))
    if saved is not None:
        out = out.join(saved.select(key).distinct(), key, "left_semi")
    return out.drop("hay", "row", "block")


def sections(spark: SparkSession, path: str, dim: DataFrame, section_col: str = "distrito", dim_key: str = "district",
             text: str | None = None, district: str | None = None, saved: DataFrame | None = None,
             district_col: str = "distrito", key: str = "id") -> DataFrame:
    """Per section of ``dim``: visible hits, rows, whether it shows, and the visible hits of the whole search.

    A section shows when it has a visible hit, or when it is empty, selected,
    and neither text nor saved rows are asked for.
    """
    hits = search(spark, path, text, district, saved, district_col, key).groupBy(
        F.col(section_col).alias(dim_key)).agg(F.count(F.lit(1)).alias("n_visible"))
    total = hits.agg(F.coalesce(F.sum("n_visible"), F.lit(0)).alias("n_visible_total"))
    rows = texts(spark, path).groupBy(F.col(section_col).alias(dim_key)).agg(F.count(F.lit(1)).alias("n_rows"))
    out = dim.join(rows, dim_key, "left").join(hits, dim_key, "left")
    visible, n = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("n_visible", "n_rows"))
    asked = (tx.search_key(F.lit(text or "")) != "") | F.lit(saved is not None)
    shown = (visible > 0) | ((n == 0) & ~asked & (F.col(dim_key) == F.lit(district or "")))
    return out.select(*dim.columns, visible.alias("n_visible"), n.alias("n_rows"), shown.alias("section_visible"),
                      total.scalar().cast("bigint").alias("n_visible_total"))
