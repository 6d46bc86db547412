"""Merkle manifest of a dataset: every row's leaf, its tree's root and the proof between them.

A tree is made of the rows of one group in the order of their ids; ``FAN``
consecutive nodes become one, level by level, and the groups' roots become one
root the same way.  Each level is a table of nodes.  A sibling-shift self-join
meets every node with the other slots of its run (slot XOR 1 for a binary tree,
slot offsets 1 to FAN - 1 modulo FAN otherwise), and the rows in slot zero emit
the parents.  On the way back each node's siblings, split into those left and
right of it, are prefixed to the path of its parent by an equi-join, so a leaf
ends with the whole path to the root.

No task holds a group: nodes are keyed by (tree, index) throughout, and a tree
may hold all rows.  Only the number of levels is known to the driver.

Defined results: a NULL column counts as ``-``; a NULL group comes first and is
a tree of its own; NULL ids come first, repeated ids follow in the order of
their leaves (equal leaves are interchangeable); a lone leaf is its tree's root
and has an empty proof; an empty table gives no rows; other columns are ignored
and no column name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import saved
from noticeflow.operators.common import global_row_number

FAN = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def joined_hash(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def with_siblings(level: DataFrame, fan: int = FAN) -> DataFrame:
    """``level`` (tree, idx, n, hash, ...) with the hashes ``left`` and ``right`` of each node in its run."""
    idx, slot = F.col("idx"), F.col("idx") % fan
    if fan == 2:
        offers = F.array(idx.bitwiseXOR(F.lit(1).cast("long")))
    else:
        offers = F.transform(F.sequence(F.lit(1), F.lit(fan - 1)), lambda k: idx - slot + (slot + k) % fan)
    wanted = level.select("tree", "idx", "n", F.explode(offers).alias("other")).where("other < n").drop("n")
    nodes = level.select("tree", F.col("idx").alias("other"), F.col("hash").alias("other_hash"))
    kin = wanted.join(nodes, ["tree", "other"]).groupBy("tree", "idx").agg(
        F.sort_array(F.collect_list(F.struct("other", "other_hash"))).alias("kin"))

    def side(keep) -> Column:
        return F.coalesce(F.concat_ws("", F.transform(F.filter("kin", keep), lambda k: k.other_hash)), F.lit(""))

    return level.join(kin, ["tree", "idx"], "left").withColumn("left", side(lambda k: k.other < idx)).withColumn(
        "right", side(lambda k: k.other > idx)).drop("kin")


def climb(leaves: DataFrame, fan: int = FAN) -> tuple[list[DataFrame], DataFrame]:
    """The levels with their siblings, and (tree, level, top), the last node of every tree."""
    levels, tops, level = [], None, leaves
    while True:
        here = level.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), F.col("hash").alias("top"))
        tops = here if tops is None else tops.unionByName(here)
        rest = level.where("n > 1")
        if rest.isEmpty():
            return levels, tops
        kin = saved(with_siblings(rest, fan))
        levels.append(kin)
        level = kin.where(F.col("idx") % fan == 0).select(
            "tree", (F.col("idx") / fan).cast("long").alias("idx"), F.ceil(F.col("n") / fan).alias("n"),
            joined_hash(F.col("left"), F.col("hash"), F.col("right")).alias("hash"))


def descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """``leaves`` with ``path`` (siblings from the leaf upwards) and what ``tops`` (tree, level, path, ...) carries."""
    carried = [c for c in tops.columns if c not in ("tree", "level")]

    def ends(n: int, nodes: DataFrame | None) -> DataFrame:
        here = tops.where(F.col("level") == n).drop("level")
        return here.withColumn("idx", F.lit(0).cast("long")) if nodes is None else nodes.join(here, "tree")

    above = ends(len(levels), leaves.where("n = 1") if not levels else None)
    for n in reversed(range(len(levels))):
        parents = above.withColumnRenamed("idx", "up").withColumnRenamed("path", "_above").select(
            "tree", "up", "_above", *[c for c in carried if c != "path"])
        step = F.array(F.struct("left", "right"))
        below = levels[n].withColumn("up", (F.col("idx") / fan).cast("long")).join(parents, ["tree", "up"])
        below = below.withColumn("path", F.concat(step, "_above"))
        own = leaves.columns if n == 0 else ["tree", "idx"]
        above = below.select(*own, *carried).unionByName(
            ends(n, leaves.where("n = 1") if n == 0 else None).select(*own, *carried))
    return above


def ordered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with the index ``idx`` inside their ``tree`` and the tree's size ``n``."""
    placed = saved(global_row_number(rows, ["tree", *order], "_row"))
    sizes = placed.groupBy("tree").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("n"))
    return placed.join(sizes, "tree").withColumn("idx", (F.col("_row") - F.col("_first")).cast("long")).drop(
        "_row", "_first")


def manifest(rows: DataFrame, tree: Column, fan: int = FAN) -> DataFrame:
    """``rows`` (id, hash and others) with subroot, root and path; trees are ordered by ``tree``, NULL first."""
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("="), tree.cast("string")), F.lit("-")))
    leaves = saved(ordered(keyed, "id", "hash"))
    levels, tops = climb(leaves, fan)
    subroots = tops.withColumnRenamed("top", "hash").withColumnRenamed("tree", "group").withColumn("tree", F.lit(""))
    subroots = saved(ordered(subroots, "group"))
    upper, last = climb(subroots, fan)
    last = last.withColumnRenamed("top", "root").withColumn(
        "path", F.array().cast("array<struct<left:string,right:string>>"))
    tops = descend(subroots, upper, last, fan).select(
        F.col("group").alias("tree"), "level", F.col("hash").alias("subroot"), "root", "path")
    return descend(leaves, levels, saved(tops), fan).drop("tree", "idx", "n")


def proof(path: Column) -> Column:
    """The digest of all siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s.left, s.right))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that ``leaf`` leads to along ``path``."""
    return F.aggregate(path, leaf, lambda h, s: joined_hash(s.left, h, s.right))


def audited(docs: DataFrame) -> DataFrame:
    """The manifest of ``docs`` by lang, and each row's check after a third of the texts lost their capitals."""
    def leaf(text: Column) -> Column:
        return joined_hash(*[field(text if c == "text" else F.col(c)) for c in COLUMNS])

    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.when(hit, F.translate("text", UPPER, UPPER.lower())).otherwise(F.col("text"))
    rows = docs.select(F.col("doc_id").alias("id"), "lang", leaf(F.col("text")).alias("hash"),
                       leaf(text).alias("shown"))
    out = manifest(rows, F.col("lang"))
    refolded = folded(F.col("shown"), F.col("path"))
    return out.select(F.col("id").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root",
                      proof(F.col("path")).alias("proof_sha256"), refolded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))
