"""Mix sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's documents are dealt by a seeded hash into shards of about
``SHARD_WORDS`` words.  Highest quotients (weight / 1, 3, 5, ...) give every
source an integer number of blocks, and again every shard group and every shard
its share of them.  Inside a shard the documents lie end to end in seeded
order, cut into equal blocks; a seeded permutation picks the blocks to take.
Every document comes back with its columns, the word ranges to take of it and how
often; ``taken_texts`` cuts them out.

Defined results: NULL text counts no words; NULL source is a source of its own,
ranked last; a document without words takes none; repeated rows are documents
of their own; columns named as one of the result give way; an empty table gives no rows.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import saved

WORD = r"[^\x20\x09-\x0D]+"
WORDS = re.compile(WORD)
WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
BLOCK_WORDS = 32
SHARD_WORDS = 65_536
GROUP_SHARDS = 1_024
SEED = 17
COUNTS = ("size", "source_size", "target", "taken")
RANGES = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("begin", "end", "times")]))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Seats by highest quotients ``w / (2k - 1)``; equal quotients go to the earlier row.

    A divisor found by bisection places all but the last few seats at once; the
    quotients next in line place the rest.
    """
    w = np.asarray(weights, dtype=float)
    top = np.full(len(w), seats, dtype=np.int64) if caps is None else np.asarray(caps, dtype=np.int64)
    top = np.where(w > 0, top, 0)
    seats = int(min(seats, top.sum()))
    if seats <= 0:
        return np.zeros(len(w), dtype=np.int64)

    def given(divisor: float) -> np.ndarray:
        return np.minimum(np.floor(np.minimum(w / divisor + 0.5, 2.0 ** 62)).astype(np.int64), top)

    low, high = 0.0, 2.0 * w.max() + 1.0            # given(high) is all zero, given(low+) all caps
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        if given(mid).sum() <= seats:
            high = mid
        else:
            low = mid
    got = given(high * (1 + 1e-9))                  # a little short, so that rounding gives no seat away
    while (left := seats - int(got.sum())) > 0:
        quotient = np.where(got < top, w / (2 * got + 1), -1.0)
        order = np.lexsort((np.arange(len(w)), -quotient))
        best = order[: min(left, int((quotient == quotient[order[0]]).sum()))]
        got[best] += 1
    return got


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, src, source_size, n_docs, target): water-filling of the weights up to 3 sizes.

    One row per source: the two windows below see sources, never documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    per = per.withColumn("src", rank).withColumn(
        "weight", F.element_at(weights, (F.col("src") - 1) % len(WEIGHTS) + 1)).withColumn(
        "cap", (REPEATS * F.col("source_size")).cast("double"))
    ratio = F.col("cap") / F.col("weight")
    line = Window.orderBy(ratio, "src")
    per = per.withColumn("before", F.coalesce(F.sum("cap").over(line.rowsBetween(Window.unboundedPreceding, -1)),
                                              F.lit(0.0)))
    per = per.withColumn("weight_on", F.sum("weight").over(line.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("total", F.sum("source_size").over(line.rowsBetween(Window.unboundedPreceding,
                                                                           Window.unboundedFollowing)))
    per = per.withColumn("level", (F.col("total") - F.col("before")) / F.col("weight_on"))
    free = F.when(ratio > F.col("level"), F.struct("before", "level"))
    whole = Window.orderBy(ratio, "src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("water", F.min(free).over(whole)["level"])
    target = F.least(F.col("cap"), F.coalesce(F.col("water") * F.col("weight"), F.col("cap")))
    return per.select("source", "src", "source_size", "n_docs", target.alias("target"))


def _apportioned(df: DataFrame, parent: list[str], weight: str, seats: str, out: str,
                 cap: str | None = None) -> DataFrame:
    """Give each parent's ``seats`` to its child rows; at most GROUP_SHARDS-like few rows per parent."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out} long"
    order = [c for c in ("src", "grp", "shard") if c in df.columns]

    def deal(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        caps = None if cap is None else rows[cap].to_numpy()
        return rows.assign(**{out: sainte_lague(rows[weight].to_numpy(), int(rows[seats].iloc[0]), caps)})

    return df.groupBy(*parent).applyInPandas(deal, schema)


def block_quotas(shards: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, shard, size, quota): blocks of BLOCK_WORDS words that each shard gives, repeats counted."""
    total = sources.agg(F.sum("target").alias("_all")).select(
        F.floor(F.col("_all") / BLOCK_WORDS + 0.5).cast("long").alias("_seats"), F.lit(0).alias("_root"))
    per_source = _apportioned(
        sources.withColumn("_root", F.lit(0)).join(total, "_root"), ["_root"], "target", "_seats", "_blocks")
    groups = shards.groupBy("src", "grp").agg(F.sum("size").alias("gsize"))
    groups = groups.join(per_source.select("src", "_blocks"), "src")
    groups = _apportioned(groups, ["src"], "gsize", "_blocks", "_gblocks").select("src", "grp", "_gblocks")
    return _apportioned(shards.join(groups, ["src", "grp"]), ["src", "grp"], "size", "_gblocks", "quota") \
        .select("src", "shard", "size", "quota")


def _ranges(sizes: np.ndarray, edges: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first word, end, times) of the stretches taken, for documents that lie end to end."""
    ends = np.cumsum(sizes)
    cuts = np.unique(np.concatenate([[0], edges, ends]))
    begin, end = cuts[:-1], cuts[1:]
    doc = np.searchsorted(ends, begin, side="right")
    often = times[np.searchsorted(edges, begin, side="right") - 1]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (often[1:] != often[:-1])])[:len(begin)]
    head = np.flatnonzero(new)
    begin, end, doc, often = begin[head], end[np.append(head[1:], len(end)) - 1], doc[head], often[head]
    first = (ends - sizes)[doc]
    used = often > 0
    return doc[used], (begin - first)[used], (end - first)[used], often[used]


def _taken(seed: int):
    def pick(rows: pa.Table) -> pa.Table:
        """Ranges to take of one shard's documents: its blocks, each as often as quota and permutation say."""
        keys = [(c, "ascending") for c in ("_order", "doc_id", "size", "_text")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=keys, null_placement="at_end"))
        sizes = rows["size"].to_numpy()
        total = int(sizes.sum())
        doc = begin = end = often = np.zeros(0, np.int64)
        if total:
            m = max(1, (total + BLOCK_WORDS // 2) // BLOCK_WORDS)
            takes = min(REPEATS * m, int(np.floor(rows["quota"][0].as_py() * BLOCK_WORDS * m / total + 0.5)))
            times = np.full(m, takes // m, dtype=np.int64)
            rng = np.random.Generator(np.random.PCG64([seed, rows["src"][0].as_py(), rows["shard"][0].as_py()]))
            times[rng.permutation(m)[: takes % m]] += 1
            doc, begin, end, often = _ranges(sizes, np.arange(m + 1, dtype=np.int64) * total // m, times)
        taken = np.zeros(len(sizes), np.int64)
        np.add.at(taken, doc, (end - begin) * often)
        starts = np.searchsorted(doc, np.arange(len(sizes) + 1)).astype(np.int32)
        ranges = pa.ListArray.from_arrays(pa.array(starts), pa.StructArray.from_arrays(
            [pa.array(x, pa.int64()) for x in (begin, end, often)], ["begin", "end", "times"]))
        own = [c for c in rows.column_names if c in ("doc_id", "rest_", "size", "source_size", "target")]
        return rows.select(own).append_column("taken", pa.array(taken)).append_column("ranges", ranges)

    return pick


def mix(docs: DataFrame, text: str = "text", seed: int = SEED, whole: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, taken and ranges (begin, end, times) of words of the text.

    Without ``whole`` only doc_id and these; the texts are then not dealt to the shards.
    """
    rest = [c for c in docs.columns if c not in ("doc_id", *COUNTS, "ranges")] if whole else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", n_words(F.col(text)).alias("size"),
                       F.xxhash64(text).alias("_text"),
                       *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest_")] if rest else []))
    sizes = saved(rows.drop("rest_"))
    sources = saved(source_targets(sizes))
    n_shards = F.ceil((F.col("source_size") + F.col("n_docs")) / F.lit(SHARD_WORDS)).cast("long")
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    s = sources.withColumnRenamed("source", "_source")

    def placed(df: DataFrame) -> DataFrame:
        out = df.join(s, F.col("source").eqNullSafe(F.col("_source"))).select(
            *[c for c in df.columns if c != "source"], "src", "source_size", "target",
            F.pmod(F.xxhash64(order, F.lit(seed + 1)), n_shards).alias("shard"), order.alias("_order"))
        return out.withColumn("grp", F.floor(F.col("shard") / GROUP_SHARDS).cast("long"))

    shards = placed(sizes).groupBy("src", "grp", "shard").agg(F.sum("size").alias("size"))
    quotas = block_quotas(shards, sources).select("src", "shard", "quota")
    dealt = placed(rows if rest else sizes).drop("grp").join(quotas, ["src", "shard"])
    # the columns keep the order in which the shards' tables come
    own = [f for f in dealt.schema.fields if f.name in ("doc_id", "rest_", "size", "source_size", "target")]
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in own]).add("taken", "long").add(
        "ranges", RANGES)
    out = dealt.groupBy("src", "shard").applyInArrow(_taken(seed), schema)
    return out.select("doc_id", *COUNTS, "ranges", *[F.col("rest_").getField(c).alias(c) for c in rest])


def pieces(text: str | None, ranges: list | None) -> list[str]:
    """The parts of a text that its ranges take, with the white space inside; repeats each their own."""
    words = [m.span() for m in WORDS.finditer(text)] if text and ranges else []
    out = []
    for k in range(max((r["times"] for r in ranges or ()), default=0)):
        stretches: list[list[int]] = []
        for r in ranges:
            if r["times"] <= k:
                continue
            if stretches and stretches[-1][1] == r["begin"]:
                stretches[-1][1] = r["end"]
            else:
                stretches.append([r["begin"], r["end"]])
        out += [text[words[a][0]:words[b - 1][1]] for a, b in stretches]
    return out


def taken_texts(text: Column, ranges: Column) -> Column:
    """The pieces to take of each text, array<string>."""
    return F.udf(pieces, "array<string>", useArrow=True)(text, ranges)
