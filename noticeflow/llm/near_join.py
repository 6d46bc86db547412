"""N-gram Jaccard join with Bayesian pruning: all pairs of texts whose word 5-gram sets are 0.8 alike or more.

1. Texts with equal shingle sets are one set, stood for by its smallest id.
2. A set has ``HASHES`` MinHash values (16 bits of each).  ``BANDS`` bands of
   ``ROWS`` values bring sets together: of a pair at the threshold all bands
   differ with probability (1 - t^ROWS)^BANDS, 3e-6.  Each set is tied to the
   smallest set of its bucket, so a bucket costs one row per member, and the
   connected ties are the candidate blocks.
3. Inside a block every pair is compared value by value: after each ``STEP``
   values a pair is dropped once the posterior probability (uniform prior) that
   it reaches the threshold is below ``TOLERANCE``.  The rest is verified on the
   shingle sets.  A block above ``BLOCK_SHINGLES`` shingles is cut into parts,
   and one task compares one pair of parts; what leaves a task is a count and a
   spanning forest, never the pairs.
4. Sets linked by verified pairs, directly or in a chain, are one class, named by its smallest id.

Defined results: case and white space do not matter; texts of one to four words
have one shingle, the whole text; NULL and empty texts have none, are like
nothing and stay alone; NULL ids are kept apart from all and have no links;
repeated rows are copies of each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import freed, on_core, partitions, saved

GRAM = 5
THRESHOLD = 0.8
BANDS = 32
ROWS = 5
HASHES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
BLOCK_SHINGLES = 60_000
CACHE_WORDS = 100_000
MIX = 0x9E3779B97F4A7C15


class WordHashes(dict):
    """Word to 64-bit hash, remembered; emptied when it has grown too large."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word 5-grams of a text."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    size = min(GRAM, len(h))
    u = np.uint64
    with np.errstate(over="ignore"):
        out = np.zeros(len(h) - size + 1, u)
        for k in range(size):
            out = (out ^ h[k:len(h) - size + 1 + k]) * u(MIX)
            out ^= out >> u(31)
        out += u(size)
    return np.unique(out)


def coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(20))
    return (rng.integers(1, 2 ** 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 2 ** 63, HASHES, dtype=np.uint64))


def signature(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values, 16 bits of each minimum."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(sh), 512):
            part = sh[at:at + 512, None] * a + b
            part ^= part >> np.uint64(32)
            np.minimum(out, part.min(axis=0), out=out)
        out = (out ^ (out >> np.uint64(29))) * np.uint64(MIX)
    return (out >> np.uint64(48)).astype(np.uint16)


def set_names(sh: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a shingle set."""
    u = np.uint64
    with np.errstate(over="ignore"):
        one = (sh ^ (sh >> u(32))) * u(MIX)
        two = (sh ^ (sh >> u(27))) * u(0xBF58476D1CE4E5B9)
        one, two = one ^ (one >> u(29)), two ^ (two >> u(31))
        return int(one.sum(dtype=u).astype(np.int64)), int(two.sum(dtype=u).astype(np.int64))


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: two hashes of its shingle set, its size, and its signature."""
    known, (a, b) = WordHashes(), coefficients()
    last: dict[int, bytes] = {}
    for batch in batches:
        rows = []
        for text in batch.column("text").to_pylist():
            sh = shingles(text, known)
            one, two = set_names(sh)
            if len(sh) and (one, two) not in last:
                if len(last) > 20_000:
                    last.clear()
                last[one, two] = signature(sh, a, b).tobytes()
            rows.append((one, two, len(sh), last[one, two] if len(sh) else b""))
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds))],
            ["doc_id", "key", "set1", "set2", "n", "sig"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, node): one row per set and band."""
    for batch in batches:
        reps = batch.column("node").to_numpy(zero_copy_only=False)
        if not len(reps):
            continue
        sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, BANDS, ROWS)
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(MIX), sig.shape[:2]).copy()
        with np.errstate(over="ignore"):
            for r in range(ROWS):
                key = (key ^ sig[:, :, r]) * np.uint64(MIX)
                key ^= key >> np.uint64(29)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().astype(np.int64)),
                                          pa.array(np.repeat(reps, BANDS))], ["bucket", "node"])


def components(ties: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b): its component's smallest node.

    Large-star and small-star rounds: every node ties its larger, then its
    smaller neighbours to the smallest of them, until no tie changes.  Only
    minima are gathered per node, so a hub costs a partial aggregation.
    """
    edges = saved(ties.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where(
        "a < b").distinct())
    before = None
    while True:
        both = edges.select("a", "b").union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        down = large.select(F.col("b").alias("x"), F.col("a").alias("y"))
        low = down.groupBy("x").agg(F.min("y").alias("m"))
        small = down.join(low, "x").select(F.col("m").alias("a"), F.explode(F.array("x", "y")).alias("b"))
        edges = saved(small.where("a < b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def least_matches() -> list[int]:
    """Per number of compared values (STEP, 2 STEP, ...) the matches below which a pair is dropped.

    With m of n equal and a uniform prior the posterior is Beta(m + 1, n - m + 1);
    P(J >= t) = P(Binomial(n + 1, t) <= m).
    """
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * THRESHOLD ** m * (1 - THRESHOLD) ** (n + 1 - m)
            if total >= TOLERANCE:
                break
        out.append(m)
    return out


def surviving(left: np.ndarray, right: np.ndarray, bars: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two stacks of signatures that the incremental comparison does not drop."""
    score = np.zeros((len(left), len(right)), np.uint16)
    for k in range(STEP):
        score += left[:, k, None] == right[None, :, k]
    x, y = np.nonzero(score >= bars[0])
    got = score[x, y]
    for step, bar in enumerate(bars[1:], 1):
        if not len(x):
            break
        cols = slice(step * STEP, (step + 1) * STEP)
        got = got + (left[x, cols] == right[y, cols]).sum(axis=1)
        keep = got >= bar
        x, y, got = x[keep], y[keep], got[keep]
    return x, y


class Sets:
    """Shingle sets of one block over its own small vocabulary, for exact comparison."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], np.int64)
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(self.sizes)
        self.ids = [flat[e - s:e] for s, e in zip(self.sizes, ends)]
        self.mark = np.zeros(len(names), bool)

    def alike(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` reach the threshold with ``one``."""
        a, b = self.sizes[one], self.sizes[others]
        others = others[np.minimum(a, b) >= THRESHOLD * np.maximum(a, b) - 1e-9]
        good = []
        self.mark[self.ids[one]] = True
        for at in range(0, len(others), 512):
            part = others[at:at + 512]
            width = self.sizes[part]
            common = np.add.reduceat(self.mark[np.concatenate([self.ids[j] for j in part])].astype(np.int64),
                                     np.concatenate([[0], np.cumsum(width)[:-1]]))
            good.append(part[common >= THRESHOLD * (a + width - common) - 1e-9])
        self.mark[self.ids[one]] = False
        return np.concatenate(good) if good else others[:0]


LINKS = "node long, links long, other long"


def _compare(rows: list[tuple], known: WordHashes, bars: list[int], a: np.ndarray, b: np.ndarray) -> list[tuple]:
    """One block or pair of its parts: (node, links found here, None), and forest edges (node, 0, node)."""
    picked, sets, seen = [], [], set()
    for row in sorted(rows, key=lambda r: r[2:4]):
        if row[2:4] not in seen:                       # a repeated id may bring the text twice, or another text
            sh = shingles(row[7], known)
            if set_names(sh) == (row[5], row[6]):
                seen.add(row[2:4])
                picked.append(row)
                sets.append(sh)
    if len(picked) < 2:
        return []
    sig = np.stack([signature(s, a, b) for s in sets])
    exact = Sets(sets)
    split = sum(r[2] == 0 for r in picked)              # side 1, if any, is another part
    inside = split == len(picked)
    copies = np.array([r[4] for r in picked], np.int64)
    links = np.zeros(len(picked), np.int64)
    label = np.arange(len(picked))
    out = []
    for at in range(0, split, 128):
        stop = min(at + 128, split)
        first = at if inside else split
        x, y = surviving(sig[at:stop], sig[first:], bars)
        x, y = x + at, y + first
        if inside:
            x, y = x[y > x], y[y > x]
        for run in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
            one = int(x[run[0]])
            good = exact.alike(one, y[run])
            links[one] += copies[good].sum()
            links[good] += copies[one]
            for other in good[label[good] != label[one]].tolist():
                if label[other] != label[one]:
                    label[label == label[other]] = label[one]
                    out.append((picked[one][3], 0, picked[other][3]))
    return out + [(picked[i][3], int(links[i]), None) for i in np.flatnonzero(links)]


BLOCK_ROWS = ("block", "pair", "side", "node", "copies", "set1", "set2", "text")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (BLOCK_ROWS) come sorted by block and part pair."""
    known, bars, (a, b) = WordHashes(), least_matches(), coefficients()
    held, out = [], []

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["node", "links", "other"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in BLOCK_ROWS)):
            if held and held[0][:2] != row[:2]:
                out += _compare(held, known, bars, a, b)
                held = []
                if len(out) > 10_000:
                    yield batch_of(out)
                    out = []
            held.append(row)
    out += _compare(held, known, bars, a, b) if held else []
    if out:
        yield batch_of(out)


def near_join(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, class_id, class_key, n_links, set_id) for every row of (doc_id, text).

    ``class_id`` and ``class_key``: smallest (id, text hash) among all texts
    linked directly or in a chain; ``n_links``: other documents whose text is 0.8
    like this one, copies included; ``set_id``: smallest id with the same set.
    """
    n = partitions(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prof = saved(texts.withColumn("key", F.xxhash64("text")).mapInArrow(
        freed(_profile), "doc_id long, key long, set1 long, set2 long, n int, sig binary"))
    real = prof.where("n > 0 and doc_id is not null")
    sets = saved(real.groupBy("set1", "set2").agg(
        F.min(F.struct("doc_id", "key")).alias("rep"), F.count("*").alias("copies"), F.min("n").alias("n"),
        F.min("sig").alias("sig")).withColumn("node", F.xxhash64("set1", "set2")))
    rows = sets.select("node", "sig").mapInArrow(freed(_bands), "bucket long, node long")
    buckets = rows.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most")).where(
        "least < most").select("bucket", "least")
    ties = rows.join(buckets, "bucket").where("node > least").select(
        F.col("least").alias("a"), F.col("node").alias("b"))
    blocks = saved(components(ties).withColumnRenamed("root", "block").join(sets.drop("sig"), "node"))
    size = blocks.groupBy("block").agg(F.sum("n").alias("total")).withColumn(
        "parts", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int"))
    part = blocks.join(size, "block").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # part p meets every other part q and, on side 0, itself
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.struct(
        (F.least(F.col("part"), q) * F.col("parts") + F.greatest(F.col("part"), q)).cast("long").alias("pair"),
        F.when(F.col("part") > q, 1).otherwise(0).alias("side")))
    part = part.select(F.col("rep.doc_id").alias("doc_id"), "node", "block", "copies", "set1", "set2",
                       F.explode(pairs).alias("p"))
    wanted = part.join(texts, "doc_id").select("block", "p.pair", "p.side", "node", "copies", "set1", "set2", "text")
    found = saved(wanted.repartition(n, "block", "pair").sortWithinPartitions("block", "pair").mapInArrow(
        freed(_blocks), LINKS))
    links = found.where("other is null").groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    named = sets.drop("sig", "n").join(links, "node", "left").join(linked, "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("rep").alias("first"))
    named = named.join(first, "root").select("set1", "set2", "rep", "copies", "first", "links")
    linked_rows = real.select("doc_id", "key", "set1", "set2").join(named, ["set1", "set2"]).select(
        "doc_id", F.col("key").alias("text_key"), F.col("first.doc_id").alias("class_id"),
        F.col("first.key").alias("class_key"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("rep.doc_id").alias("set_id"))
    alone = prof.where("n = 0 or doc_id is null").select(
        "doc_id", F.col("key").alias("text_key"), F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"),
        F.lit(0).cast("long").alias("n_links"), F.col("doc_id").alias("set_id"))
    return linked_rows.unionByName(alone)


def one_per_class(docs: DataFrame) -> DataFrame:
    """The documents that stand for their class: all columns, one row per class."""
    near = near_join(docs.select("doc_id", "text"))
    kept = near.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("class_key")))
    kept = kept.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_text")).distinct()

    def pick(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_key", F.xxhash64("text"))
        return rows.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_doc")) & (
            F.col("_key") == F.col("_text")), "left_semi").dropDuplicates(["doc_id", "_key"])

    return on_core(docs, ("doc_id", "text"), pick)
