"""Chat formatting over reply trees.

Messages point at the message they answer.  Self-joins that double the reach of
each pointer give every message's root and the score of its branch; the same
jump tables then unfold each chosen leaf into its root-to-leaf path.  So both
take a number of joins that grows with the logarithm of the depth.

Every turn is written as ``<turn role="R">``, a line feed, the text and
``</turn>``, a line feed.  Inside roles and texts ``&``, ``<`` and ``"`` become
``&amp;``, ``&lt;`` and ``&quot;``, so no text can open or close a turn, and
the writing can be undone exactly.

Defined results: NULL text or role is empty; a NULL conversation id is one
conversation; a parent that is not there makes its child a root; messages on a
reply cycle have no root and are on no path; of repeated ids the smallest
(role, text) stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import saved

OPEN, MID, CLOSE = '<turn role="', '">\n', "</turn>\n"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&quot;"), F.lit('"')), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def linear_tree(turns: DataFrame) -> DataFrame:
    """(conv, node, parent, role, text, score) where each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return turns.select(
        F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("none")).alias("conv"),
        node.alias("node"), F.when(node > 1, node - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"),
        "conv_id")


def _jump_tables(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Per message its root, depth and branch score, and tables of the 1, 2, 4, ...-th ancestors."""
    ids = nodes.select("conv", F.col("node").alias("parent"), F.lit(True).alias("_there"))
    state = nodes.select("conv", "node", "parent", "score").join(ids, ["conv", "parent"], "left").select(
        "conv", "node", F.when(F.col("_there"), F.col("parent")).alias("far"),
        F.coalesce("score", F.lit(0.0)).alias("sum"), F.lit(1).cast("long").alias("depth"))
    state = saved(state)
    most = state.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    tables, reach = [], 1
    while reach < 2 * most:
        ahead = state.where(F.col("far").isNotNull())
        if ahead.isEmpty():
            break
        tables.append(ahead.select("conv", "node", "far"))
        up = state.select("conv", F.col("node").alias("far"), F.col("far").alias("_far"),
                          F.col("sum").alias("_sum"), F.col("depth").alias("_depth"))
        moved = ahead.join(up, ["conv", "far"]).select(
            "conv", "node", F.col("_far").alias("far"), (F.col("sum") + F.col("_sum")).alias("sum"),
            (F.col("depth") + F.col("_depth")).alias("depth"))
        state = saved(state.where(F.col("far").isNull()).unionByName(moved))
        reach *= 2
    return state.where(F.col("far").isNull()), tables


def branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv, leaf, rank, node, depth): the messages of each conversation's ``best`` branches (None: all).

    A branch ends at a message that nobody answers; its rank follows the mean
    score of its messages, then the smaller leaf id.
    """
    nodes = saved(nodes.groupBy("conv", "node").agg(
        F.min(F.struct("role", "text", "parent", "score")).alias("m")).select(
        "conv", "node", "m.parent", "m.score"))
    rooted, tables = _jump_tables(nodes)
    answered = nodes.where(F.col("parent").isNotNull()).select("conv", F.col("parent").alias("node")).distinct()
    leaves = rooted.join(answered, ["conv", "node"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("conv").orderBy((F.col("sum") / F.col("depth")).desc(), "node"))
    leaves = leaves.withColumn("rank", rank)
    if best is not None:
        leaves = leaves.where(F.col("rank") <= best)
    steps = saved(leaves.select("conv", F.col("node").alias("leaf"), "rank", "node", "depth"))
    # each row stands for the `2^k` messages upward from `node`; a jump halves it into two rows
    for k in reversed(range(len(tables))):
        jump = tables[k].select("conv", "node", "far")
        upper = steps.join(jump, ["conv", "node"]).select(
            "conv", "leaf", "rank", F.col("far").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        steps = saved(steps.unionByName(upper))
    return steps


def format_branches(nodes: DataFrame, best: int | None = 1) -> DataFrame:
    """(conv, leaf, rank, formatted, loss_spans): one conversation per chosen branch.

    ``loss_spans`` holds (start, length) in code points of every assistant text
    as written in ``formatted``.
    """
    nodes = saved(nodes.select("conv", "node", "parent", "role", "text", "score"))
    texts = nodes.groupBy("conv", "node").agg(F.min(F.struct("role", "text")).alias("m"))
    path = branches(nodes, best).join(texts, ["conv", "node"])
    turns = path.groupBy("conv", "leaf", "rank").agg(F.sort_array(F.collect_list(
        F.struct("depth", F.coalesce("m.role", F.lit("")).alias("role"), escaped(F.col("m.role")).alias("r"),
                 escaped(F.col("m.text")).alias("t")))).alias("turns"))
    written = F.transform("turns", lambda x: F.concat(F.lit(OPEN), x.r, F.lit(MID), x.t, F.lit(CLOSE)))
    frame = len(OPEN) + len(MID) + len(CLOSE)
    start = F.aggregate(
        "turns", F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(
            "array<struct<start:bigint,length:bigint>>").alias("spans")),
        lambda acc, x: F.struct(
            (acc.at + frame + F.char_length(x.r) + F.char_length(x.t)).cast("long").alias("at"),
            F.when(x.role == LOSS_ROLE, F.concat(acc.spans, F.array(F.struct(
                (acc.at + len(OPEN) + len(MID) + F.char_length(x.r)).cast("long").alias("start"),
                F.char_length(x.t).cast("long").alias("length"))))).otherwise(acc.spans).alias("spans")))
    return turns.select("conv", "leaf", "rank", F.concat_ws("", written).alias("formatted"),
                        start["spans"].alias("loss_spans"))


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) read back from a formatted conversation."""
    pieces = F.filter(F.split(formatted, F.lit(CLOSE)), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, len(OPEN) + 1, 2_147_483_647))
    return F.transform(body, lambda b: F.struct(
        unescaped(F.substring_index(b, MID, 1)).alias("role"),
        unescaped(b.substr(F.locate(MID, b) + len(MID), F.char_length(b))).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescaped(F.concat_ws("", F.transform(
        spans, lambda s: formatted.substr((s.start + 1).cast("int"), s.length.cast("int")))))
