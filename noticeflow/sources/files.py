"""File sources: snapshots, ledgers, file inventories, document sniffing and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed_values as fv
from .. import schema as sc
from .. import storage
from ..functions import text as tx
from . import json_arrays as ja

FLAT_RUN = "before"            # the run that a flat ledger becomes

def read_snapshot(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Snapshot scan with the fixed listing schema (no inference); a missing path is empty.

    ``json``: a JSON array of objects, read in splits (``json_arrays``); ``parquet``: our own snapshots.
    """
    if not storage.exists(spark, path):
        return sc.empty_listings(spark)
    if fmt == "parquet":
        return spark.read.schema(sc.LISTING).parquet(path)
    return ja.read_objects(spark, path, sc.LISTING).drop("pos", "file")


def read_snapshot_with_pos(spark: SparkSession, path: str) -> DataFrame:
    """JSON array snapshot with each element's position in its file (``pos``, 0-based): list order as data."""
    if not storage.exists(spark, path):
        return sc.empty_listings(spark).withColumn("pos", F.lit(None).cast("int"))
    return ja.read_objects(spark, path, sc.LISTING).drop("file")


def read_ledger(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Ledger scan -> distinct tokens.

    ``json``: one JSON array of scalar strings, read in splits (``json_arrays``).
    ``parquet``: the ledger table written by
    ``write_ledger``, or the runs that ``append_ledger`` adds without those that
    they gave back (the forms used at scale: no single-array file).
    """
    if not storage.exists(spark, path):
        return spark.createDataFrame([], sc.LEDGER)
    if fmt == "parquet":
        runs = storage.numbered_names(spark, path, "run")
        if not runs:
            return spark.read.schema(sc.LEDGER).parquet(path).distinct()
        root = path.rstrip("/")
        taken = spark.read.schema(sc.LEDGER_RUN).option("basePath", root).parquet(*[f"{root}/run={r}" for r in runs])
        gone = [r for r in runs if storage.exists(spark, f"{root}/_released/run={r}")]
        if gone:
            released = spark.read.schema(sc.LEDGER_RUN).option("basePath", f"{root}/_released").parquet(
                *[f"{root}/_released/run={r}" for r in gone])
            taken = taken.join(released, ["run", "token"], "left_anti")
        return taken.select("token").distinct()
    return ja.read_scalars(spark, path).select(F.col("value").alias("token")).distinct()


def write_ledger(tokens: DataFrame, path: str) -> None:
    """Ledger table, unique and sorted (range-partitioned sort, written in parallel), published whole."""
    storage.write_published(tokens.select("token").distinct().orderBy("token"), path)


def append_ledger(tokens: DataFrame, path: str, run) -> None:
    """The tokens of one run as a folder of the ledger; a repeated run writes the same folder.

    A ledger that is still one flat table becomes the folder of a first run.
    """
    spark, root = tokens.sparkSession, path.rstrip("/")
    if storage.exists(spark, root) and not storage.numbered_names(spark, root, "run"):
        old = root + "-flat"
        storage.publish(spark, root, old)
        storage.publish(spark, old, f"{root}/run={FLAT_RUN}")
    storage.write_published(tokens.select("token").distinct().orderBy("token"), f"{root}/run={run}")


def release_ledger(tokens: DataFrame, path: str, run) -> None:
    """Tokens that a run took and gives back; together with those it has given back before."""
    spark, final = tokens.sparkSession, f"{path.rstrip('/')}/_released/run={run}"
    if storage.exists(spark, final):
        tokens = tokens.select("token").unionByName(spark.read.schema(sc.LEDGER).parquet(final))
    storage.write_published(tokens.select("token").distinct(), final)


def file_inventory(spark: SparkSession, path: str, glob: str = "*", recursive: bool = False,
                   with_content: bool = False) -> DataFrame:
    """Directory listing as a table: (path, name, ext, length[, content]).

    Without ``with_content`` the binary column is pruned from the scan.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.load(path)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    cols = [F.col("path"), name.alias("name"),
            F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("ext"), F.col("length")]
    if with_content:
        cols.append(F.col("content"))
    return df.select(*cols)


def document_extension(name_col, content_col):
    """A '.tmp' file starting with the ZIP magic is a '.docx'; else its own suffix; none -> '.docx'."""
    ext = F.lower(F.regexp_extract(tx._c(name_col), r"(\.[^./]*)$", 1))
    magic = F.upper(F.hex(F.substring(tx._c(content_col), 1, 4)))
    return (F.when((ext == ".tmp") & (magic == fv.ZIP_MAGIC_HEX), F.lit(".docx"))
            .when(ext == "", F.lit(".docx")).otherwise(ext))


def fingerprint(content_col):
    """First 10 hex of the content's SHA-256."""
    return F.substring(F.sha2(tx._c(content_col), 256), 1, 10)


def fingerprints(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    inv = file_inventory(spark, path, glob, with_content=True)
    return inv.select("path", "name", "ext", fingerprint("content").alias("version"),
                      document_extension("name", "content").alias("doc_ext"))


def asset_versions(names: DataFrame, files: DataFrame) -> DataFrame:
    """Left join wanted asset names to fingerprints; unreadable/missing -> '1'."""
    return names.join(files.select("name", "version"), "name", "left").select(
        "name", F.coalesce("version", F.lit("1")).alias("version"))


def rename_plan(listings: DataFrame, docs: DataFrame, doc_col: str = "archivo_oficial") -> DataFrame:
    """Listings whose stored document has a temporary suffix get a corrected path (no renaming on disk).

    ``docs``: (path, ext, doc_ext) from ``fingerprints``.  A listing stores a
    path relative to some root, so a file matches when its path ends with it at
    a folder boundary: every path is listed under each of its folder suffixes,
    and the stored path meets the one it equals.  Each listing keeps one row.
    """
    parts = F.split("path", "/")
    suffix = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    d = docs.select(F.explode(suffix).alias("_tail"), F.col("path").alias("_path"), "doc_ext", F.col("ext").alias("_ext"))
    tail = F.regexp_replace(F.col(doc_col), r"^(\./|/)+", "")
    found = listings.select(doc_col).where(tx.truthy(doc_col)).distinct().withColumn("_tail", tail).join(d, "_tail")
    best = found.groupBy(doc_col).agg(F.min(F.struct(F.length("_path").alias("l"), "_path", "_ext", "doc_ext")).alias("b"))
    j = listings.join(best, doc_col, "left")
    fix = F.coalesce((F.col("b._ext") == ".tmp") & (F.col("b.doc_ext") != ".tmp"), F.lit(False))
    corrected = F.concat(F.regexp_replace(F.col(doc_col), r"\.[^./]*$", ""), F.col("b.doc_ext"))
    return j.select(*[F.when(fix, corrected).otherwise(F.col(c)).alias(c) if c == doc_col else F.col(c)
                      for c in listings.columns], fix.alias("renamed"))
