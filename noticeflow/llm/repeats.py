"""Suffix-array dedup: remove what repeats a string of ``SPAN`` bytes of an earlier document.

Every window of SPAN bytes owns an anchor, its smallest hashed ``GRAM``-byte
string, so equal windows own equal anchors.  Four steps, all keyed, none global:

Documents of equal text work as one, under the smallest id; the others lose all.

1. Tasks hash their documents' anchors.  An anchor that a task sees in two
   documents is known to repeat; of all others one row per document goes to the
   anchor's shard, which answers those that occur in more than one document.
2. For its repeated anchors every document gives the stretch of text whose
   windows they own.  Equal stretches in one task are merged first: all but
   the earliest document's are settled, and one goes to the anchor's shard.
3. A shard settles anchors whose stretches are all equal as columns.  It cuts the
   stretches of others into short runs of windows around a common core and sorts
   the suffixes of differing runs, equal pieces once, by linear grouping
   (``suffixes``); neighbours equal in SPAN bytes are one string, and its
   earliest document keeps it.
4. Each document drops every byte covered by a window that others had first.

Hot strings do not gather: tasks send one row per distinct string, however many
documents hold it.

Defined results: NULL text is empty; NULL ids come after all others; rows of
equal id do not repeat each other; repeated rows get equal results; texts under
SPAN bytes lose nothing; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import freed, on_core, partitions
from noticeflow.llm.suffixes import suffix_array

SPAN = 50
GRAM = 20
RUN = 4
UNIT_BYTES = 24_000_000            # what a task works on at once; less takes less memory and sends more
HELD_WINDOWS = 300_000             # windows that a shard's task holds before it packs them
SLICES = 1
SUFFIX_BYTES = 40_000
LAST = 2 ** 63 - 1
WIDTH = SPAN - GRAM + 1                 # anchors that compete in one window


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Mixed 64-bit hash of the GRAM-byte string at every position."""
    u = np.uint64
    base = u(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        one = data.astype(u) + u(1)
        p2 = base * base
        p4 = p2 * p2
        p8 = p4 * p4
        two = one[:-1] * base + one[1:]
        four = two[:-2] * p2 + two[2:]
        eight = four[:-4] * p4 + four[4:]
        sixteen = eight[:-8] * p8 + eight[8:]
        h = sixteen[:-4] * p4 + four[16:]
        h = (h ^ (h >> u(29))) * u(0xBF58476D1CE4E5B9)
        return h ^ (h >> u(32))


def _sliding(x: np.ndarray, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over every WIDTH neighbours."""
    done = 1
    while done * 2 <= WIDTH:
        x = pick(x[:-done], x[done:])
        done *= 2
    rest = WIDTH - done
    return pick(x[:-rest], x[rest:]) if rest else x


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of anchors, all hashes, and the smallest hash of every window."""
    h = gram_hashes(data)
    least = _sliding(h, np.minimum)
    pad = np.zeros(WIDTH - 1, np.uint64)
    highest = _sliding(np.concatenate([pad, least, pad]), np.maximum)
    return np.flatnonzero(highest == h), h, least


def owned(at: np.ndarray, h: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Index into ``at`` of the anchor (the leftmost smallest) that owns each window."""
    mine = np.repeat(np.arange(len(at)), np.diff(at, prepend=-1))[:len(least)]
    wrong = np.flatnonzero(h[at[mine]] != least)
    while len(wrong):
        mine[wrong] += 1
        wrong = wrong[h[at[mine[wrong]]] != least[wrong]]
    return mine


def _packed(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *(a.tobytes() for a in arrays)])


def _unpacked(blob: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for kind, n in zip(kinds, sizes):
        out.append(np.frombuffer(blob, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _units(batches: Iterator[pa.RecordBatch], unit_bytes: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(row key, id, bytes) of a task's documents, in units of about ``unit_bytes``."""
    unit, size = [], 0
    for batch in batches:
        for key, i, text in zip(*(batch.column(c).to_pylist() for c in ("_key", "_id", "text"))):
            data = (text or "").encode()
            if len(data) >= SPAN:
                unit.append((key, i, data))
                size += len(data)
            if size >= unit_bytes:
                yield unit
                unit, size = [], 0
    if unit:
        yield unit


def _grouped(key: np.ndarray, h: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, packed keys and hashes) of all pairs (row key, hash), by shard of the key."""
    home = (key.astype(np.uint64) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    cut = np.flatnonzero(np.diff(home[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        names, index = np.unique(key[part], return_inverse=True)
        yield int(home[part[0]]), _packed(names, index.astype(np.uint32), h[part])


ANCHOR_ROWS = "shard int, slice int, blob binary"


def _short(h: np.ndarray) -> np.ndarray:
    """The 48 bits of a hash that travel; a chance meeting only costs a look at the texts."""
    return h >> np.uint64(16)


def _halves(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return h.astype(np.uint32), (h >> np.uint64(32)).astype(np.uint16)


def _joined(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _send_anchors(shards: int, unit_bytes: int):
    """Step 1, tasks: hits known here (slice -1) and one row per other anchor, packed by shard and slice."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, unit_bytes):
            hs, docs = [], []
            for d, (_, _, data) in enumerate(unit):
                at, h, _ = anchors(np.frombuffer(data, np.uint8))
                found = np.unique(_short(h[at]))
                hs.append(found)
                docs.append(np.full(len(found), d, np.uint32))
            keys = np.array([k for k, _, _ in unit], np.int64)
            h, doc = np.concatenate(hs), np.concatenate(docs)
            order = np.argsort(h, kind="stable")
            h, doc = h[order], doc[order]
            head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            tail = np.concatenate([head[1:], [len(h)]])
            several = keys[doc[head]] != keys[doc[tail - 1]]           # stable: documents in order within a hash
            flags = np.repeat(several, tail - head)
            rows = [(home, -1, blob) for home, blob in _grouped(keys[doc[flags]], h[flags], shards)]
            known = h[head[several]]
            h, doc = h[~flags], doc[~flags]
            small = np.uint16 if len(unit) <= 65_536 else np.uint32
            for part_known, part, (s, c) in _dealt(known, h, shards):
                used, index = np.unique(doc[part], return_inverse=True)
                if small is np.uint32:
                    index = index.astype(np.uint32)
                rows.append((s, c, _packed(*_halves(known[part_known]), *_halves(h[part]),
                                              index.astype(small).view(np.uint16), keys[used])))
            for at in range(0, len(rows), 20_000):
                part = rows[at:at + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int32()), pa.array([r[1] for r in part], pa.int32()),
                     pa.array([r[2] for r in part], pa.binary())], ["shard", "slice", "blob"])
    return run


def _dealt(known: np.ndarray, h: np.ndarray, shards: int):
    """Row numbers of both arrays for each (shard, slice)."""
    def codes(x):
        return (x % np.uint64(shards * SLICES)).astype(np.int64)

    a, b = codes(known), codes(h)
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    edges = np.arange(shards * SLICES + 1)
    ca, cb = np.searchsorted(a[oa], edges), np.searchsorted(b[ob], edges)
    for code in range(shards * SLICES):
        pa_, pb = oa[ca[code]:ca[code + 1]], ob[cb[code]:cb[code + 1]]
        if len(pa_) or len(pb):
            yield pa_, pb, (code // SLICES, code % SLICES)


def _answer_anchors(shards: int):
    """Step 1, shards: the anchors that several documents hold, packed by shard of the document's key."""
    kinds = (np.uint32, np.uint16, np.uint32, np.uint16, np.uint16, np.int64)

    def answered(blobs: list[bytes]) -> list[tuple[int, bytes]]:
        known, hs, docs, keys = [], [], [], []
        base = 0
        for blob in blobs:
            k_low, k_high, low, high, index, key = _unpacked(blob, *kinds)
            if len(index) == 2 * len(low):
                index = index.view(np.uint32)
            known.append(_joined(k_low, k_high))
            hs.append(_joined(low, high))
            docs.append(index.astype(np.int64) + base)
            keys.append(key)
            base += len(key)
        known, h, doc, key = map(np.concatenate, (known, hs, docs, keys))
        order = np.lexsort((key[doc], h))
        h, doc = h[order], doc[order]
        if not len(h):
            return []
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        tail = np.concatenate([head[1:], [len(h)]])
        several = (key[doc[head]] != key[doc[tail - 1]]) | np.isin(h[head], known)
        flags = np.repeat(several, tail - head)
        return list(_grouped(key[doc[flags]], h[flags], shards))

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                           pa.array([r[1] for r in rows], pa.binary())], ["home", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None                                      # rows come sorted by shard and slice
        for batch in batches:
            for shard, part, blob in zip(*(batch.column(c).to_pylist() for c in ("shard", "slice", "blob"))):
                if part < 0:
                    yield batch_of([(shard, blob)])
                    continue
                if at is not None and at[0] != (shard, part):
                    yield batch_of(answered(at[1]))
                    at = None
                if at is None:
                    at = ((shard, part), [])
                at[1].append(blob)
        if at is not None:
            yield batch_of(answered(at[1]))

    return run


def _hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per document: its repeated anchors (rows come sorted by home)."""
    def gathered(blobs: list[bytes]) -> pa.RecordBatch:
        parts = [_unpacked(b, np.int64, np.uint32, np.uint64) for b in blobs]
        key = np.concatenate([names[index] for names, index, _ in parts])
        h = np.concatenate([found for _, _, found in parts])
        order = np.argsort(key, kind="stable")
        key, h = key[order], h[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        tail = [*head[1:].tolist(), len(key)]
        return pa.RecordBatch.from_arrays(
            [pa.array(key[head]), pa.array([h[a:b].tobytes() for a, b in zip(head.tolist(), tail)], pa.binary())],
            ["_key", "_hits"])

    home, held = None, []
    for batch in batches:
        for here, blob in zip(batch.column("home").to_pylist(), batch.column("blob").to_pylist()):
            if here != home and held:
                yield gathered(held)
                held = []
            home = here
            held.append(blob)
    if held:
        yield gathered(held)


def _among(x: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``some`` (sorted, not empty); for short arrays ``np.isin`` is mostly overhead."""
    return some[np.minimum(np.searchsorted(some, x), len(some) - 1)] == x


STRETCH_ROWS = "anchor long, off int, text binary, id long, key long, at int"


def _spans(rows: list[tuple[int, int]]) -> bytes:
    return np.array(rows, np.int32).tobytes()


def _stretches(batches: Iterator[pa.RecordBatch], unit_bytes: int) -> Iterator[pa.RecordBatch]:
    """Step 2: stretches for the shards; settled windows (start, end) as rows with ``off`` -1.

    A stretch is (anchor, offset of the anchor, bytes); its windows start at
    ``at``, ``at`` + 1, ... of the document.
    """
    def flush(seen: dict):
        rows, settled = [], {}
        for (off, text), (anchor, first, copies) in seen.items():
            for i, key, at in copies:
                if i == first:
                    rows.append((anchor, off, text, i, key, at))
                else:
                    settled.setdefault(key, []).append((at, at + len(text) - SPAN + 1))
        rows += [(key, -1, _spans(found), 0, key, 0) for key, found in settled.items()]
        for a in range(0, len(rows), 20_000):
            part = list(zip(*rows[a:a + 20_000]))
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds)],
                                             ["anchor", "off", "text", "id", "key", "at"])

    seen: dict = {}
    size = 0
    for batch in batches:
        for key, i, text, hits in zip(*(batch.column(c).to_pylist() for c in ("_key", "_id", "text", "_hits"))):
            data = text.encode()
            at, h, least = anchors(np.frombuffer(data, np.uint8))
            hit = np.flatnonzero(_among(_short(h[at]), np.sort(np.frombuffer(hits, np.uint64))))
            mine = owned(at, h, least)
            first = np.searchsorted(mine, hit, side="left").tolist()
            last = np.searchsorted(mine, hit, side="right").tolist()
            places, names = at[hit].tolist(), h[at[hit]].astype(np.int64).tolist()
            for p, anchor, a, b in zip(places, names, first, last):
                if a < b:
                    name = (p - a, data[a:b + SPAN - 1])
                    held = seen.get(name)
                    if held is None:
                        seen[name] = [anchor, i, [(i, key, a)]]
                        size += len(name[1]) + 250
                    else:
                        if i < held[1]:
                            held[1] = i
                        held[2].append((i, key, a))
                        size += 100
            if size >= 4 * unit_bytes:
                yield from flush(seen)
                seen, size = {}, 0
    if seen:
        yield from flush(seen)


def first_holders(strings: list[tuple[bytes, int]]) -> list[list[int]]:
    """For each (bytes, id) the smallest id of all strings that hold each of its SPAN-byte windows."""
    lengths = np.array([len(data) for data, _ in strings], np.int64)
    begins = np.cumsum(lengths + 1) - lengths - 1                # a separator ends each string
    text = np.zeros(int(lengths.sum()) + len(strings) + 1, np.int32)
    inside = np.ones(len(text) - 1, bool)
    inside[begins + lengths] = False
    text[:-1][inside] = np.frombuffer(b"".join(data for data, _ in strings), np.uint8) + np.int32(2)
    text[begins + lengths] = 1
    counts = lengths - SPAN + 1                                  # windows of each string
    ends = np.cumsum(counts)
    window = np.full(len(text), -1, np.int64)                    # number of the window that starts here
    starts = np.arange(ends[-1]) + np.repeat(begins - ends + counts, counts)
    window[starts] = np.arange(ends[-1])
    ids = np.repeat(np.array([i for _, i in strings], np.int64), counts)

    order = np.array(suffix_array(text.tolist()), np.int64)
    order = order[window[order] >= 0]
    spans = np.lib.stride_tricks.sliding_window_view(text, SPAN)
    differs = (spans[order[1:]] != spans[order[:-1]]).any(axis=1)
    head = np.flatnonzero(np.concatenate([[True], differs]))
    least = np.minimum.reduceat(ids[window[order]], head)
    out = np.empty(len(ids), np.int64)
    out[window[order]] = np.repeat(least, np.diff(head, append=len(order)))
    return [part.tolist() for part in np.split(out, ends[:-1])]


def _settle(rows: list[tuple]) -> dict[int, list[tuple[int, int]]]:
    """Step 3 for whole anchors: windows of each document that an earlier document holds."""
    whole: dict[int, dict[tuple[int, bytes], list]] = {}
    for anchor, off, text, i, key, at in rows:
        held = whole.setdefault(anchor, {}).setdefault((off, text), [i, [], []])
        held[0] = min(held[0], i)
        held[1].append((i, key, at))
    queue: list[tuple[bytes, int, list]] = []
    size = 0

    # a stretch holds (begin, end, smallest id) of its windows, in any order
    def sort_queue() -> None:
        for (_, _, uses), least in zip(queue, first_holders([(d, i) for d, i, _ in queue])):
            edges = [0, *(w for w in range(1, len(least)) if least[w] != least[w - 1]), len(least)]
            for a, b in zip(edges, edges[1:]):
                for known, begin in uses:
                    known.append((begin + a, begin + b, least[a]))

    for stretches in whole.values():
        if len(stretches) == 1:
            (((_, text), (least, _, known)),) = stretches.items()
            known.append((0, len(text) - SPAN + 1, least))
            continue
        runs: dict[tuple[int, bytes], dict[tuple[int, bytes], list]] = {}
        for (off, text), (least, _, known) in stretches.items():
            windows = len(text) - SPAN + 1
            # distance from a window's start to the anchor falls from `off` to `off - windows + 1`
            for q in range((off - windows + 1) // RUN, off // RUN + 1):
                near = off - RUN * q
                begin, end = max(0, near - RUN + 1), min(windows, near + 1)
                core = (q, text[near:near - RUN + 1 + SPAN])
                pieces = runs.get(core)
                if pieces is None:
                    pieces = runs[core] = {}
                name = (off - begin, text[begin:end + SPAN - 1])
                held_by = pieces.get(name)
                if held_by is None:
                    pieces[name] = [least, [(known, begin)]]
                else:
                    if least < held_by[0]:
                        held_by[0] = least
                    held_by[1].append((known, begin))
        for pieces in runs.values():
            if len(pieces) == 1:
                (((_, data), (least, uses)),) = pieces.items()
                for known, begin in uses:
                    known.append((begin, begin + len(data) - SPAN + 1, least))
                continue
            for (_, data), (least, uses) in pieces.items():      # equal pieces are sorted once, for all that hold them
                queue.append((data, least, uses))
                size += len(data)
        if size >= SUFFIX_BYTES:
            sort_queue()
            queue, size = [], 0
    if queue:
        sort_queue()
    found: dict[int, list[tuple[int, int]]] = {}
    for stretches in whole.values():
        for _, holders, known in stretches.values():
            known.sort()
            for i, key, at in holders:
                start = None
                for begin, _, least in known:
                    if least < i:
                        if start is None:
                            start = begin
                    elif start is not None:
                        found.setdefault(key, []).append((at + start, at + begin))
                        start = None
                if start is not None:
                    found.setdefault(key, []).append((at + start, at + known[-1][1]))
    return found


def _equal_anchors(whole: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Of sorted whole anchors: keys and windows to remove where all stretches are equal, and the rows of all others."""
    anchor, off, i, key, at = (whole.column(c).to_numpy() for c in ("anchor", "off", "id", "key", "at"))
    text = whole.column("text")
    same = np.zeros(len(anchor), bool)
    same[1:] = ((anchor[1:] == anchor[:-1]) & (off[1:] == off[:-1])
                & pc.equal(text.slice(1), text.slice(0, len(text) - 1)).to_numpy(zero_copy_only=False))
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    rows = np.diff(first, append=len(anchor))
    equal = np.repeat(np.add.reduceat(same, first, dtype=np.int64) == rows - 1, rows)
    gone = np.flatnonzero(equal & (np.repeat(np.minimum.reduceat(i, first), rows) < i))
    ends = at + pc.binary_length(text).to_numpy() - SPAN + 1
    return key[gone], np.stack([at[gone], ends[gone]], 1).astype(np.int32), whole.filter(pa.array(~equal))


def _homes(found: list[tuple[np.ndarray, np.ndarray]], shards: int) -> pa.RecordBatch:
    """The windows of the row keys (pairs of keys and windows), a row per home shard of the keys."""
    key, flat = np.concatenate([k for k, _ in found]), np.concatenate([w for _, w in found])
    order = np.argsort(key, kind="stable")
    key, flat = key[order], flat[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    names, counts = key[first], np.diff(first, append=len(key))
    home = (names.astype(np.uint64) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(home, kind="stable")
    rows = []
    for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1) if len(order) else []:
        n = counts[part]
        index = np.arange(n.sum()) + np.repeat(first[part] - np.cumsum(n) + n, n)
        rows.append((int(home[part[0]]), _packed(names[part], n.astype(np.uint32), flat[index].ravel())))
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                       pa.array([r[1] for r in rows], pa.binary())], ["home", "blob"])


def _arrays(found: dict[int, list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    names = np.fromiter(found, np.int64, len(found))
    counts = np.fromiter((len(v) for v in found.values()), np.int64, len(found))
    return np.repeat(names, counts), np.array([w for v in found.values() for w in v], np.int32).reshape(-1, 2)


def _whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, cut only where the anchor changes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        anchor = batch.column("anchor").to_numpy()
        if not len(anchor):
            continue
        last = int(np.searchsorted(anchor, anchor[-1]))                     # where the last anchor's rows begin
        if last or held and held[-1].column("anchor")[0].as_py() != anchor[0]:
            yield pa.concat_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.concat_batches(held)


def _shard(shards: int, unit_bytes: int):
    """Step 3, shards: rows come sorted by anchor; settles them in chunks of whole anchors."""
    names = ("anchor", "off", "text", "id", "key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size, found, windows = [], 0, [], 0
        for whole in _whole_anchors(batches):
            off = whole.column("off").to_numpy()
            done = np.flatnonzero(off < 0)
            if len(done):
                part = whole.take(pa.array(done))
                spans = [np.frombuffer(x, np.int32).reshape(-1, 2) for x in part.column("text").to_pylist()]
                found += [(np.full(len(x), k), x) for k, x in zip(part.column("key").to_pylist(), spans)]
                windows += sum(map(len, spans))
                whole = whole.filter(pa.array(off >= 0))
            if whole.num_rows:
                key, spans, mixed = _equal_anchors(whole)
                found.append((key, spans))
                windows += len(key)
                rows.extend(zip(*(mixed.column(c).to_pylist() for c in names)))
                size += 150 * mixed.num_rows + (pc.sum(pc.binary_length(mixed.column("text"))).as_py() or 0)
            if size >= unit_bytes:
                found.append(_arrays(_settle(rows)))
                windows += len(found[-1][0])
                rows, size = [], 0
            if windows >= HELD_WINDOWS:
                yield _homes(found, shards)
                found, windows = [], 0
        if rows:
            found.append(_arrays(_settle(rows)))
        if found:
            yield _homes(found, shards)
    return run


def _spans_by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of a row key, gathered in its home shard, as one row."""
    keys, counts, flat = [], [], []
    for batch in batches:
        for blob in batch.column("blob").to_pylist():
            for held, part in zip((keys, counts, flat), _unpacked(blob, np.int64, np.uint32, np.int32)):
                held.append(part)
    if not keys:
        return
    keys, counts, flat = np.concatenate(keys), np.concatenate(counts).astype(np.int64), np.concatenate(flat).reshape(-1, 2)
    order = np.argsort(keys, kind="stable")
    n, first = counts[order], (np.cumsum(counts) - counts)[order]
    flat = flat[np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)]
    names, start = np.unique(keys[order], return_index=True)
    upto = np.concatenate([[0], np.cumsum(n)])
    edges = np.append(upto[start], upto[-1]).tolist()
    for a in range(0, len(names), 20_000):
        b = min(len(names), a + 20_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[a:b]), pa.array([flat[x:y].tobytes() for x, y in zip(edges[a:b], edges[a + 1:b + 1])],
                                            pa.binary())], ["_key", "_spans"])


def _removed(data: bytes, spans: bytes | None) -> tuple[bytes, int, int]:
    """Kept bytes, removed bytes, removed runs."""
    if not spans:
        return data, 0, 0
    found = np.frombuffer(spans, np.int32).reshape(-1, 2)
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, found[:, 0], 1)
    np.add.at(edge, found[:, 1] - 1 + SPAN, -1)
    gone = np.cumsum(edge[:-1]) > 0
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


RESULT = [T.StructField("_n_bytes", T.LongType()), T.StructField("_n_removed", T.LongType()),
          T.StructField("_n_spans", T.LongType()), T.StructField("_sha256", T.StringType()),
          T.StructField("_kept", T.StringType())]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                    unit_bytes: int = UNIT_BYTES) -> DataFrame:
    """``docs`` with ``_n_bytes``, ``_n_removed``, ``_n_spans``, ``_sha256`` of the kept bytes and ``_kept``.

    ``_kept`` is the kept text; bytes of a character that was cut are left out.
    """
    return on_core(docs, (doc_id, text), lambda d: _without_repeats(d, doc_id, text, unit_bytes),
                   tuple(f.name for f in RESULT))


def _without_repeats(docs: DataFrame, doc_id: str, text: str, unit_bytes: int) -> DataFrame:
    n = partitions(docs.sparkSession)
    # Equal texts work as one, under their smallest id; the same shuffle by text serves all three joins.
    plain = docs.withColumnRenamed(text, "text").withColumn("_id", F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST)))
    plain = plain.withColumn("_key", F.xxhash64("text"))
    first = plain.groupBy("_key").agg(F.min("_id").alias("_first"))
    marked = plain.join(first, "_key")
    heads = marked.where(F.col("_id") <= F.col("_first"))          # an equality would become a key of the join
    # no column is dropped before these two: all three joins then read one shuffle of the texts
    sent = heads.mapInArrow(freed(_send_anchors(n, unit_bytes)), ANCHOR_ROWS)
    hits = sent.repartition(n, "shard").sortWithinPartitions("shard", "slice").mapInArrow(
        freed(_answer_anchors(n)), "home int, blob binary")
    hits = hits.repartition(n, "home").sortWithinPartitions("home").mapInArrow(freed(_hits), "_key long, _hits binary")
    stretches = heads.join(hits, "_key").mapInArrow(freed(partial(_stretches, unit_bytes=unit_bytes)), STRETCH_ROWS)
    spans = stretches.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(
        freed(_shard(n, unit_bytes)), "home int, blob binary")
    spans = spans.repartition(n, "home").mapInArrow(freed(_spans_by_key), "_key long, _spans binary")
    own = [c if c != text else "text" for c in docs.columns]
    out_names = [*own, *(f.name for f in RESULT)]

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, s, i, f in zip(*(batch.column(c).to_pylist() for c in ("text", "_spans", "_id", "_first"))):
                data = (t or "").encode()
                if i > f and len(data) >= SPAN:                 # the same text came earlier
                    kept, removed, runs = b"", len(data), 1
                else:
                    kept, removed, runs = _removed(data, s if i == f else None)
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(),
                             kept.decode("utf-8", "ignore")))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in own), *(pa.array(c, k) for c, k in zip(cols, kinds))], out_names)

    schema = T.StructType([*(T.StructField(c, docs.schema[d].dataType) for c, d in zip(own, docs.columns)), *RESULT])
    return marked.join(spans, "_key", "left").mapInArrow(freed(remove), schema).withColumnRenamed("text", text)


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document."""
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_bytes").alias("n_bytes"), F.col("_n_removed").alias("n_removed"),
                      F.col("_n_spans").alias("n_spans"), F.col("_sha256").alias("kept_sha256"))
