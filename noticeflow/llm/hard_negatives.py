"""Hard negatives of anchor vectors, with scores bounded along a spanning tree of the anchors.

Scores are integer inner products of quantised vectors.  Anchors are dealt into
blocks of about ``BLOCK``; a block's minimum spanning tree (Prim) fixes the order
of its anchors.  A task that holds a chunk of candidates walks that tree: the
score of a candidate at a child anchor lies within

    score at the parent  +-  length of the edge * norm of the candidate

(Cauchy-Schwarz), where the parent's score is exact or itself an interval.  Only
candidates whose interval still overlaps what the anchor needs are scored again:
at first the best ``POSITIVES`` of the anchor's label, then, per positive, the
best ``NEGATIVES`` of other labels inside the window of that positive's score.

Every block of anchors meets every candidate; a task keeps ``POSITIVES`` or
``NEGATIVES`` rows per anchor or positive, which are merged afterwards.  Driver
and tasks hold one block of anchors at a time (``BLOCK`` vectors and at most
``BLOCK * POSITIVES`` windows), never all of them, and no candidate is shuffled.

Defined results: rows with a NULL label or vector, with a NULL or non-finite
component, or without vec_id take no part; shorter vectors are continued with
zeros; vectors may be empty (all scores 0); ties go to the smaller vec_id;
every row of a repeated anchor id is an anchor, and rows of the anchor's own id
are never its candidates; repeated candidates count as often as they occur;
scores must fit a long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticeflow.llm.common import saved

BLOCK = 1024
CHUNK = 4096
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95            # a negative's score in hundredths of the positive's
STEPS = 256
ANCHOR_EVERY, RELABEL_EVERY, LABELS = 50, 7, 10


def quantised(vectors: pa.Array) -> np.ndarray:
    """floor(256 x) of every component, as whole float64 numbers, shorter vectors continued with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    out = np.zeros((len(vectors), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.floor(
        vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * STEPS)
    return out


def fitted(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def products(rows: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in float64 while every sum stays below 2^53, else in Python's integers."""
    if len(v) * np.abs(rows).max(initial=0) * np.abs(v).max(initial=0) < 2.0 ** 53:
        return (rows @ v).astype(np.int64)
    whole = [int(x) for x in v]
    return np.array([sum(int(a) * b for a, b in zip(r, whole)) for r in rows], dtype=object)


class Block:
    """One block of anchors in the order of its tree."""

    def __init__(self, rows: list):
        rows = sorted(rows, key=lambda r: r.at)
        self.uid, self.ids, self.labels = ([r[c] for r in rows] for c in ("uid", "vec_id", "label"))
        self.parent, self.edge = [r.parent for r in rows], [r.edge for r in rows]
        self.vectors = quantised(pa.array([r.embedding for r in rows], pa.list_(pa.float64())))
        self.children = np.bincount([p for p in self.parent if p >= 0], minlength=len(rows))


def spanning_tree(group: pa.Table) -> pa.Table:
    """Prim's minimum spanning tree over one block: position, parent's position and length of the edge."""
    group = group.sort_by([("vec_id", "ascending"), ("uid", "ascending")]).combine_chunks()
    vectors = quantised(group["embedding"].combine_chunks())
    n = len(vectors)
    order, parent, edge = [0], [-1], [0.0]
    place, near = np.zeros(n, dtype=np.int64), np.linalg.norm(vectors - vectors[0], axis=1)
    left = np.ones(n, dtype=bool)
    left[0] = False
    for _ in range(n - 1):
        k = int(np.where(left, near, np.inf).argmin()) if np.isfinite(near[left]).any() else int(left.argmax())
        order.append(k)
        parent.append(int(place[k]))
        edge.append(float(near[k]))
        left[k] = False
        far = np.linalg.norm(vectors - vectors[k], axis=1)
        closer = left & (far < near)
        near[closer], place[closer] = far[closer], len(order) - 1
    tree = group.take(order)
    return tree.append_column("at", pa.array(range(n), pa.int32())).append_column(
        "parent", pa.array(parent, pa.int32())).append_column("edge", pa.array(edge, pa.float64()))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The k best (score, id), ties by the smaller id."""
    at = np.lexsort((ids, -scores)) if scores.dtype != object else sorted(
        range(len(ids)), key=lambda i: (-scores[i], ids[i]))
    return [(int(scores[i]), int(ids[i])) for i in at[:k]]


def merged(a: list, b: list, k: int) -> list[tuple[int, int]]:
    return sorted(a + b, key=lambda p: (-p[0], p[1]))[:k]


def floor_of(low: np.ndarray, kept: list, k: int) -> float:
    """A score that k candidates are known to reach."""
    known = kept[k - 1][0] if len(kept) >= k else -np.inf
    return max(known, np.partition(low, len(low) - k)[len(low) - k] if len(low) >= k else -np.inf)


def walk(block: Block, rows: np.ndarray, wanted: Callable, taken: Callable) -> int:
    """Visit the anchors in tree order; the number of scores computed.

    ``wanted(i, low, high)`` marks the candidates that anchor i needs exactly,
    ``taken(i, at, scores)`` receives their positions and scores.
    """
    norms = np.linalg.norm(rows, axis=1)
    bounds, waiting, done = {}, block.children.copy(), 0
    for i, p in enumerate(block.parent):
        if p < 0:
            low, high = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
            at = np.arange(len(rows))
        else:
            low, high = bounds[p]
            slack = block.edge[i] * norms * (1 + 1e-9) + 1e-9 * np.abs(np.where(np.isfinite(low), low, 0)) + 1e-6
            low, high = low - slack, high + slack
            waiting[p] -= 1
            if not waiting[p]:
                del bounds[p]
            at = np.flatnonzero(wanted(i, low, high))
        scores = products(rows[at], block.vectors[i])
        low[at] = high[at] = scores.astype(np.float64)
        done += len(at)
        if block.children[i]:
            bounds[i] = low, high
        taken(i, at, scores)
    return done


def chunks(batches: Iterator[pa.RecordBatch], block: Block) -> Iterator[tuple]:
    """(ids, labels, vectors) of bounded pieces of the candidates, as wide as the anchors."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            piece = batch.slice(at, CHUNK)
            rows = quantised(piece.column("embedding"))
            width = block.vectors.shape[1]
            rows = rows[:, :width] if rows.shape[1] > width else fitted(rows, width)
            yield piece.column("vec_id").to_numpy(), piece.column("label").to_numpy(), rows


def positives_of(block: Block) -> Callable:
    """Task function: the best candidates of the anchor's own label, per anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [[] for _ in block.uid]
        for ids, labels, rows in chunks(batches, block):
            def same(i):
                return (labels == block.labels[i]) & (ids != block.ids[i])

            def wanted(i, low, high):
                mine = same(i)
                return mine & (high >= floor_of(low[mine], kept[i], POSITIVES))

            def taken(i, at, scores):
                mine = same(i)[at]
                kept[i] = merged(kept[i], best(scores[mine], ids[at][mine], POSITIVES), POSITIVES)

            walk(block, rows, wanted, taken)
        flat = [(block.uid[i], s, v) for i, found in enumerate(kept) for s, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(3)],
                                         ["uid", "score", "vec_id"])
    return run


def negatives_of(block: Block, positives: list) -> Callable:
    """Task function: per anchor and positive, the best candidates of other labels in the positive's window."""
    place = {u: i for i, u in enumerate(block.uid)}
    windows = [[] for _ in block.uid]
    for p in positives:
        if LOW * p.positive_score <= HIGH * p.positive_score:        # a negative score's window is empty
            windows[place[p.uid]].append((p.place, p.positive_score))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {(i, n): [] for i, own in enumerate(windows) for n, _ in own}
        for ids, labels, rows in chunks(batches, block):
            def wanted(i, low, high):
                other, out = (labels != block.labels[i]) & (ids != block.ids[i]), np.zeros(len(ids), dtype=bool)
                for n, score in windows[i]:
                    least, most = LOW * score / 100, HIGH * score / 100
                    may = other & (high >= least - 1) & (low <= most + 1)
                    sure = may & (low >= least + 1) & (high <= most - 1)
                    out |= may & (high >= floor_of(low[sure], kept[i, n], NEGATIVES))
                return out

            def taken(i, at, scores):
                other = (labels[at] != block.labels[i]) & (ids[at] != block.ids[i])
                for n, score in windows[i]:
                    mine = other & (100 * scores >= LOW * score) & (100 * scores <= HIGH * score)
                    mine = mine.astype(bool)
                    kept[i, n] = merged(kept[i, n], best(scores[mine], ids[at][mine], NEGATIVES), NEGATIVES)

            walk(block, rows, wanted, taken)
        flat = [(block.uid[i], n, s, v) for (i, n), found in kept.items() for s, v in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in flat], pa.int64()) for k in range(4)],
                                         ["uid", "place", "score", "vec_id"])
    return run


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that take part, every seventh id with the next label."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.when(F.col("vec_id") % RELABEL_EVERY == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col(
        "embedding").isNotNull() & ~odd).select("vec_id", label.cast("long").alias("label"), vector.alias("embedding"))


def blocks_of(anchors: DataFrame) -> tuple[DataFrame, int]:
    """The anchors with their place in the spanning tree of their block, and the number of blocks."""
    named = saved(anchors.withColumn("uid", F.monotonically_increasing_id()))
    n = max(1, -(-named.count() // BLOCK))
    dealt = named.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int"))
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in dealt.schema)}, at int, parent int, edge double"
    return saved(dealt.groupBy("block").applyInArrow(spanning_tree, schema)), n


def _ranked(*by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))


def mine(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = usable(embeddings)
    trees, n = blocks_of(rows.where(F.col("vec_id") % ANCHOR_EVERY == 0))

    def over_blocks(task: Callable, schema: str) -> DataFrame:
        out = None
        for b in range(n):
            part = trees.where(F.col("block") == b).collect()            # about BLOCK rows
            if part:
                found = saved(rows.mapInArrow(task(Block(part), b), schema))
                out = found if out is None else out.unionByName(found)
        return rows.sparkSession.createDataFrame([], schema) if out is None else out

    found = over_blocks(lambda block, _: positives_of(block), "uid long, score long, vec_id long")
    found = found.withColumn("place", _ranked("uid").cast("long")).where(F.col("place") <= POSITIVES)
    anchors = trees.select("uid", "block", F.col("vec_id").alias("anchor_id"))
    positives = saved(found.join(anchors, "uid").select(
        "uid", "block", "place", "anchor_id", F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score")))

    def task(block: Block, b: int) -> Callable:
        return negatives_of(block, positives.where(F.col("block") == b).collect())       # POSITIVES an anchor

    negatives = over_blocks(task, "uid long, place long, score long, vec_id long")
    negatives = negatives.withColumn("rank", _ranked("uid", "place")).where(F.col("rank") <= NEGATIVES)
    return negatives.join(positives, ["uid", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
