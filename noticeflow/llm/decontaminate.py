"""Benchmark decontamination on templates, so that re-parameterised questions are found too.

Words become template tokens: numbers, names (capitalised words) and units
(after a number), each run of them as one, turn into typed placeholders, all else
into its lower-case letters.  A capitalised word that may open a sentence (text start, after an end
mark, line break, list mark or opening quote) counts as a name and as a plain
word.  Windows of ``WINDOW`` tokens (whole items, if shorter) with at least
``LITERALS`` plain words are hash-joined with the benchmark's windows, and so
are windows of the bare lower-case words, for copies whatever their case and
punctuation.  Every hit is extended both ways, word by equal word or slot by
slot, to the run around it.  In a run every slot value of the item must stand
for one value of the document and the other way round.  A document leaks an item
when a consistent run has ``RUN`` tokens or covers the item.

A window with more than eight words that may open sentences is read in the 256
ways that repeat after eight of them.

The benchmark is the build side: its windows are read in blocks of at most
``BLOCK_CHARS`` characters, each small enough for every task, and all documents
meet every block.

Defined results: NULL and empty texts leak nothing; NULL or empty items, and
items with fewer words than ``LITERALS`` besides numbers, are leaked by nothing; repeated
rows give repeated results, repeated items each their own; empty tables give no
leaks; other columns pass through.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from noticeflow.llm.common import freed

WINDOW = 8
LITERALS = 4
RUN = 13
BLOCK_CHARS = 10_000_000
CACHE_WORDS = 100_000
CHUNK_CHARS = 1_000_000
NUMBER, NAME, UNIT = 1, 2, 3
MIX = 0x9E3779B97F4A7C15

# Number words and unit words.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion "
    "half dozen".split())
UNIT_WORDS = frozenset(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres g kg mg gram grams kilogram kilograms ton tons tonne tonnes lb lbs pound pounds oz ounce "
    "ounces l ml liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day "
    "days week weeks month months year years percent usd eur dollar dollars cent cents euro euros rupee rupees yen "
    "kmh mph kph hz khz mhz w kw kwh watt watts volt volts degree degrees celsius fahrenheit kb mb gb tb".split())
KNOWN_WORDS = NUMBER_WORDS | UNIT_WORDS
NUMERAL = re.compile(r"[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?%?")
DIGIT = re.compile(r"\d")
JOINED = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+)")
JOINED_INSIDE = re.compile(r"\d[.,]*[^\W\d_]")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
SENTENCE_END = re.compile(r"[.!?:][\"')\]*]*$")
LIST_MARK = re.compile(r"[\W_]*(?:\d{1,3}|[^\W\d_]|[ivxIVX]{2,5})[.):\]]+")
QUOTED = re.compile(r"[\"'(\[«“‘„¿¡*_#>]")
LINE_BREAK = "\0"                                       # a word of no letters that stands for it
EMPTY, ENDS, BEFORE_START, QUOTE, IS_UNIT, MORE_UNIT = 1, 2, 4, 8, 16, 32


class Words(dict):
    """White-space words to row numbers of ``plain`` and ``facts``, which say what a word is."""

    def __init__(self) -> None:
        super().__init__()
        self.plain = array("Q")
        self.facts = array("H")

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        if word.islower() and word.isalpha() and word not in KNOWN_WORDS:       # most words: no rule applies
            self.plain.append(xxh3_64_intdigest(word) | 8)
            self.facts.append(0)
            return at
        plain, kind, flags = self._facts(word)
        self.plain.append(plain)
        self.facts.append(kind << 8 | flags)
        return at

    def of(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, kind and flags of all words; forgets earlier words when too many are known."""
        if len(self) > CACHE_WORDS:
            self.clear()
            self.plain, self.facts = array("Q"), array("H")
        ids = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        facts = np.array(self.facts, np.uint16)[ids]
        return np.array(self.plain, np.uint64)[ids], (facts >> 8).astype(np.uint8), facts.astype(np.uint8)

    def _facts(self, word: str) -> tuple[int, int, int]:
        """(hash of the lower-case letters, kind inside a sentence, flags)."""
        core = word if word[-1] not in ",." else word[:-1]
        flags = ENDS if core is not word and word[-1] == "." else 0
        number = None
        if not core.isalpha():                          # the rules in full; a word of letters meets none of them
            flags = ENDS if SENTENCE_END.search(word) else 0
            core = EDGES.sub("", word)
            if not core:
                return 0, 0, flags | EMPTY | BEFORE_START
            flags |= QUOTE if QUOTED.match(word) else 0
            number = NUMERAL.fullmatch(core)
        if len(word) < 12 and not word[-1].isalnum() and LIST_MARK.fullmatch(word):
            flags |= BEFORE_START
        low = core.lower()
        if low in UNIT_WORDS:
            flags |= IS_UNIT | (MORE_UNIT if low != "in" else 0)
        title = core[0].isupper() and core[1:] == core[1:].lower()
        kind = NUMBER if number or low in NUMBER_WORDS else NAME if title else 0
        return xxh3_64_intdigest(low) | 8, kind, flags


def _parts(word: str) -> tuple[str, ...]:
    """A word, or the number and unit that it joins."""
    found = JOINED.fullmatch(EDGES.sub("", word)) if DIGIT.search(word) else None
    return (found[1], found[2]) if found and found[2].lower() in UNIT_WORDS else (word,)


def split_words(text: str | None) -> list[str]:
    """White-space words, LINE_BREAK between lines; numbers apart from their units."""
    raw = f" {LINE_BREAK} ".join((text or "").splitlines()).split()
    return [part for word in raw for part in _parts(word)] if JOINED_INSIDE.search(text or "") else raw


class Stream(NamedTuple):
    """Words with letters of several texts, end to end."""

    plain: np.ndarray       # hash of the lower-case letters
    kind: np.ndarray        # NUMBER, NAME, UNIT or 0
    maybe: np.ndarray       # a NAME that may as well be a plain word that opens a sentence
    hard: np.ndarray        # a sentence or text ends before it for certain
    text: np.ndarray        # number of its text
    part: np.ndarray        # windows stay inside a part
    at: np.ndarray          # place in its text

    def where(self, mask: np.ndarray) -> Stream:
        kept = np.flatnonzero(mask)
        out = Stream(*(x[kept] for x in self))
        gap = np.diff(kept, prepend=-1) != 1
        gap[1:] |= out.part[1:] != out.part[:-1]
        return out._replace(part=np.cumsum(gap))


def stream(texts: list[list[str]], words: Words) -> Stream:
    plain, kind, flags = words.of(texts)
    text = np.repeat(np.arange(len(texts)), [len(raw) for raw in texts])
    kept = np.flatnonzero(flags & EMPTY == 0)
    seen = [np.concatenate([[0], np.cumsum(flags & bit > 0)]) for bit in (ENDS, BEFORE_START)]
    begin, before = np.ones(len(kept), bool), np.concatenate([[0], kept[:-1]]) if len(kept) else kept
    text = text[kept]
    begin[1:] = text[1:] != text[:-1]
    hard = begin | (seen[0][kept] > seen[0][before])
    start = hard | (seen[1][kept] > seen[1][before]) | (flags[kept] & QUOTE > 0)
    kind, flags = kind[kept].copy(), flags[kept]
    unit = np.zeros(len(kept), bool)
    unit[1:] = (flags[1:] & IS_UNIT > 0) & (kind[:-1] == NUMBER) & ~begin[1:]
    more = (flags & MORE_UNIT > 0) & ~begin & (kind != NUMBER)
    while (new := np.flatnonzero(more[1:] & unit[:-1] & ~unit[1:]) + 1).size:
        unit[new] = True
    kind[unit & (kind != NUMBER)] = UNIT
    first = np.flatnonzero(begin)
    at = np.arange(len(kept)) - np.repeat(first, np.diff(np.append(first, len(kept))))
    return Stream(plain[kept], kind, (kind == NAME) & start, hard, text, text, at)


def tokens(s: Stream, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token codes and their first words when of all ``maybe`` words those in ``names`` are names."""
    kind = np.where(s.maybe & ~names, 0, s.kind)
    new = (kind == 0) | s.hard
    new[1:] |= (kind[1:] != kind[:-1]) | (s.part[1:] != s.part[:-1])
    new[:1] = True
    start = np.flatnonzero(new)
    kind = kind[start]
    return np.where(kind > 0, kind.astype(np.uint64), s.plain[start]), start


def readings(s: Stream, period: int = 2) -> Iterator[tuple[Stream, np.ndarray, np.ndarray]]:
    """(stream, token codes, first words) such that every window of WINDOW tokens is read in all its ways."""
    if not s.maybe.any():
        yield s, *tokens(s, s.maybe)
        return
    nth = np.cumsum(s.maybe) % period
    for mask in range(1 << period):
        yield s, *tokens(s, (mask >> nth & 1).astype(bool))
    if period == 8:
        return
    _, start = tokens(s, s.maybe)                       # all names: the fewest tokens, the widest windows
    end = np.append(start[WINDOW + 1:], np.full(min(WINDOW + 1, len(start)), len(s.kind)))
    seen = np.concatenate([[0], np.cumsum(s.maybe)])
    many = np.flatnonzero(seen[end] - seen[start] > period)
    if len(many):
        edge = np.zeros(len(s.kind) + 1, np.int64)
        np.add.at(edge, start[many], 1)
        np.add.at(edge, end[many], -1)
        yield from readings(s.where(np.cumsum(edge[:-1]) > 0), 2 * period)


def window_hashes(code: np.ndarray, size: int, plain: np.ndarray, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window of ``size`` tokens, and whether it has enough plain words."""
    n = len(code) - size + 1
    if n <= 0 or size <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out = np.full(n, size + salt, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = (out ^ code[k:n + k]) * np.uint64(MIX)
            out ^= out >> np.uint64(29)
    count = np.concatenate([[0], np.cumsum(plain)])
    return out, count[size:] - count[:-size] >= LITERALS


def windows(s: Stream, sizes: set[int], copy_sizes: set[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, text, place of the first word) of all windows: of template tokens, and of bare words for copies."""
    def hashed(s, code, start, size, plain, salt=0):
        h, good = window_hashes(code, size, plain, salt)
        if len(h):
            good &= s.part[start[:len(h)]] == s.part[start[size - 1:]]
            first = start[:len(h)][good]
            yield h[good], s.text[first], s.at[first]

    for part, code, start in readings(s) if sizes else ():
        for size in sizes:
            yield from hashed(part, code, start, size, code > UNIT)
    for size in copy_sizes:
        yield from hashed(s, s.plain, np.arange(len(s.plain)), size, s.kind != NUMBER, 64)


class Side:
    """The words of one text, to walk along."""

    def __init__(self, low: list[str], kind: list[int], maybe: list[bool], hard: list[bool]):
        self.low, self.kind, self.maybe, self.hard = low, kind, maybe, hard

    @classmethod
    def of(cls, raw: list[str], s: Stream) -> Side:
        low = [core.lower() for w in raw if (core := EDGES.sub("", w))]
        return cls(low, s.kind.tolist(), s.maybe.tolist(), s.hard.tolist())

    def mirrored(self) -> Side:
        return Side(self.low[::-1], self.kind[::-1], self.maybe[::-1], [True, *self.hard[:0:-1]])

    def slots(self, w: int) -> list[int]:
        """Where a slot that starts at word ``w`` may end: its run, up to any plain word that may open a sentence."""
        kind, out, e = self.kind[w], [], w + 1
        while e < len(self.kind) and self.kind[e] == kind and not self.hard[e]:
            if self.maybe[e] or self.maybe[e - 1]:
                out.append(e)
            e += 1
        return [*out, e]


def walk(item: Side, doc: Side, i: int, p: int) -> list[tuple[int, int, int, int, int]]:
    """The steps (tokens, from and to word of the item, of the document) of the longest run from (i, p) on."""
    best: dict[tuple[int, int], tuple[int, tuple[int, int] | None, int]] = {(i, p): (0, None, 0)}
    queue = [(i, p)]
    top = (i, p)
    while queue:
        here = i, p = heapq.heappop(queue)
        count = best[here][0]
        if count > best[top][0]:
            top = here
        if i == len(item.low) or p == len(doc.low):
            continue
        kind = item.kind[i]
        slot = kind and kind == doc.kind[p]
        steps = []
        if item.low[i] == doc.low[p] and not (slot and not item.maybe[i] and not doc.maybe[p]):
            steps.append((i + 1, p + 1, 1))
        if slot:
            steps += [(e, f, e - i if item.low[i:e] == doc.low[p:f] else 1)
                      for e in item.slots(i) for f in doc.slots(p)]
        for e, f, size in steps:
            held = best.get((e, f))
            if held is None:
                heapq.heappush(queue, (e, f))
            if held is None or held[0] < count + size:
                best[e, f] = (count + size, here, size)
    out = []
    while best[top][1] is not None:
        _, before, size = best[top]
        out.append((size, before[0], top[0], before[1], top[1]))
        top = before
    return out[::-1]


def consistent(steps: list[tuple], item: Side, doc: Side) -> Iterator[tuple[int, int, bool]]:
    """The longest stretches of steps in which slots map one to one, and whether any value changed."""
    there: dict[tuple[int, str], tuple[str, int]] = {}             # value -> (its partner, last place)
    back: dict[tuple[int, str], tuple[str, int]] = {}
    begin, changed = 0, -1                                         # changed: the last place of a new value
    for n, (_, i, e, p, f) in enumerate(steps):
        kind = item.kind[i]
        x, y = " ".join(item.low[i:e]), " ".join(doc.low[p:f])
        if not kind or (x == y and item.maybe[i]):
            continue
        clash = max((at for held, new in ((there.get((kind, x)), y), (back.get((kind, y)), x))
                     if held and held[0] != new for at in held[1:]), default=-1)
        if clash >= begin:
            yield begin, n, changed >= begin
            begin = clash + 1
        there[kind, x], back[kind, y] = (y, n), (x, n)
        changed = n if x != y else changed
    yield begin, len(steps), changed >= begin


class Index:
    """The benchmark's windows by hash; small enough for a task."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        raws = [split_words(text) for _, text in items]
        s = stream(raws, Words())
        cuts = np.searchsorted(s.text, np.arange(len(raws) + 1))
        singles = [Stream(*(x[a:b] for x in s)) for a, b in zip(cuts, cuts[1:])]
        self.items = [Side.of(raw, one) for raw, one in zip(raws, singles)]
        self.sizes, self.copy_sizes = {WINDOW}, {WINDOW}
        found = list(windows(s, self.sizes, self.copy_sizes))
        fewest = np.bincount(s.text[tokens(s, s.maybe)[1]], minlength=len(raws))
        for one in (one for one, n in zip(singles, fewest.tolist()) if 0 < n < WINDOW):       # short items as a whole
            n = len(one.kind)
            lengths = {len(start) for part, _, start in readings(one) if len(part.kind) == n}
            for size in sorted(size for size in lengths if size < WINDOW):
                new = [w for w in windows(one, {size}, set()) if len(w[0])]
                found += [(h[at == 0], t[at == 0], at[at == 0]) for h, t, at in new]
                self.sizes |= {size} if new else set()
            if n < WINDOW:
                new = [w for w in windows(one, set(), {n}) if len(w[0])]
                found += new
                self.copy_sizes |= {n} if new else set()
        self.hash, self.owner, self.offset = (np.concatenate(x) for x in zip(*found)) if found else \
            (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
        order = np.lexsort((self.offset, self.owner, self.hash))
        new = np.ones(len(order), bool)
        for k, x in enumerate((self.hash, self.owner, self.offset)):
            same = x[order][1:] == x[order][:-1] if k == 0 else same & (x[order][1:] == x[order][:-1])
        new[1:] = ~same if len(order) else True
        order = order[new]
        self.hash = self.hash[order]
        self.owner, self.offset = self.owner[order].astype(np.int32), self.offset[order].astype(np.int32)
        self.bits = 22
        self.maybe = np.zeros(1 << self.bits, bool)
        self.maybe[(self.hash >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def hits(self, s: Stream) -> dict[int, dict[int, set[tuple[int, int]]]]:
        """(item word, text word) where equal windows start, by text and item."""
        found: dict[int, dict[int, set[tuple[int, int]]]] = {}
        for h, text, at in windows(s, self.sizes, self.copy_sizes) if len(self.hash) else ():
            where = np.flatnonzero(self.maybe[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
            lo = np.searchsorted(self.hash, h[where], "left")
            hi = np.searchsorted(self.hash, h[where], "right")
            for k in np.flatnonzero(hi > lo).tolist():
                t, p = int(text[where[k]]), int(at[where[k]])
                for m in range(lo[k], hi[k]):
                    found.setdefault(t, {}).setdefault(int(self.owner[m]), set()).add((int(self.offset[m]), p))
        return found

    def leaks_of(self, texts: list[str | None], words: Words) -> Iterator[tuple[int, int, int, int, bool]]:
        """(text, item, first word, tokens, slots changed) of the longest consistent run of every leaked item."""
        raws = [split_words(text) for text in texts]
        s = stream(raws, words)
        for t, by_item in sorted(self.hits(s).items()):
            a, b = np.searchsorted(s.text, [t, t + 1])
            doc = Side.of(raws[t], Stream(*(x[a:b] for x in s)))
            doc_back = doc.mirrored()
            for n, seeds in sorted(by_item.items()):
                run = self._longest(self.items[n], doc, doc_back, seeds)
                if run:
                    yield t, n, *run

    def leaks(self, text: str | None, words: Words) -> list[tuple[int, int, int, bool]]:
        """(item, first word, tokens, slots changed) of the longest consistent run of every leaked item."""
        return [found[1:] for found in self.leaks_of([text], words)]

    def _longest(self, item: Side, doc: Side, doc_back: Side, seeds: set) -> tuple[int, int, bool] | None:
        item_back = item.mirrored()
        n, m = len(item.low), len(doc.low)
        seen: set[tuple[int, int]] = set()
        best = None
        for i, p in sorted(seeds, key=lambda x: (x[1], x[0])):
            if (i, p) in seen:
                continue
            steps = [(size, n - e, n - b, m - f, m - q) for size, b, e, q, f in
                     reversed(walk(item_back, doc_back, n - i, m - p))] + walk(item, doc, i, p)
            seen.update((b, q) for _, b, _, q, _ in steps)
            for c, d, changed in consistent(steps, item, doc):
                if c == d:
                    continue
                size = sum(step[0] for step in steps[c:d])
                whole = steps[c][1] == 0 and steps[d - 1][2] == n
                if (size >= RUN or whole) and (best is None or (size, best[2]) > (best[1], changed)):
                    best = (steps[c][3], size, changed)
        return best


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark as one index per block of at most BLOCK_CHARS characters (or one longer item)."""
    items = benchmark.where("item_id is not null and length(text) > 0").select("item_id", "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // BLOCK_CHARS)) if total > BLOCK_CHARS else 1
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Index(sorted((r.item_id, r.text) for r in part.collect()))       # one bounded block


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into rows of about CHUNK_CHARS bytes of text together."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        cut = np.flatnonzero(np.diff(size // CHUNK_CHARS)) + 1
        for a, b in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows]):
            yield batch.slice(a, b - a)


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, first_token, n_tokens, changed) for every document and item it leaks."""
    out = None
    for index in indexes(benchmark):
        def find(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in chunks(batches):
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[t], index.ids[n], *run)
                        for t, n, *run in index.leaks_of(batch.column("text").to_pylist(), words)]
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                                 ["doc_id", "item_id", "first_token", "n_tokens", "changed"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
            freed(find), "doc_id long, item_id long, first_token int, n_tokens int, changed boolean")
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, all columns."""
    for index in indexes(benchmark):
        def keep(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            words = Words()
            for batch in chunks(batches):
                clean = np.ones(batch.num_rows, bool)
                for t, *_ in index.leaks_of(batch.column("text").to_pylist(), words):
                    clean[t] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(freed(keep), docs.schema)
    return docs
