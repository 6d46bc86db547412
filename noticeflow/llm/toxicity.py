"""Toxicity: a subsequence string-kernel SVM with Nystroem landmarks.

A sentence is toxic because of some word in it, so the kernel compares words:
two words are alike as far as they share subsequences of two and three letters,
each weighted by ``DECAY`` per letter it spans.  Letters put in or left out only
lower the weight of what spans them, so spelled-out or padded insults stay near
their plain form.  Nystroem features over ``LANDMARKS`` words turn the kernel
SVM into a linear one; summed over the landmarks, its decision is one weight per
subsequence, which is how tasks evaluate it.

Training sees a bounded sample of labelled texts by hash of the id (``SAMPLE``
toxic ones, ``CLEAN_PER_TOXIC`` times as many clean ones).  The label belongs to the text, so the toxic sentence's witness
word is found first: words of toxic texts that clean texts lack and
chance does not explain, then the best-scoring word of each text, round by round.

A text's margin is that of its most toxic word; a logistic curve fitted on the
sample turns it into a score.  Whole texts are scored.

Defined results: NULL and empty texts, and texts without letters, have the margin
of the cleanest sample text, the lowest there is; without any toxic (or any clean) label every score is 0; words longer than
``WINDOW`` letters are scored in overlapping windows; repeated rows get equal
scores; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow.llm.common import freed, on_core

DECAY = 0.6
PAIR_WEIGHT = 0.5
LANDMARKS = 256
COST = 50_000.0
SAMPLE = 800
CLEAN_PER_TOXIC = 4
CHANCE = 1e-6
CLEAN_SHARE = 0.05
PADDED = 4
ROUNDS = 3
FLOOR = -4.0
ALPHABET = 64
WINDOW = 14
CACHE_WORDS = 100_000
CHUNK_CHARS = 4_000_000
LETTERS = re.compile(r"[^\W_]+")
SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?!\S)")


def units(word: str) -> list[str]:
    """The letter strings of a white-space word: its parts, and all its letters joined."""
    parts = LETTERS.findall(word)
    return parts if len(parts) < 2 else [*parts, "".join(parts)]


def words_of(text: str) -> set[str]:
    """Distinct lower-case words of a text; runs of single characters also count as one word."""
    text = text.lower()
    out = set(text.split())
    for run in SPELLED.findall(text):
        out.add("".join(run.split()))
    return out


def windows(unit: str) -> list[str]:
    marked = f"^{unit}$"
    size = WINDOW + 2
    if len(marked) <= size:
        return [marked]
    last = len(marked) - size
    return [marked[i:i + size] for i in sorted({*range(0, last, size // 2), last})]


def self_kernel(codes: np.ndarray) -> np.ndarray:
    """K(x, x) of equally long words, by the gap-weighted dynamic programme."""
    same = (codes[:, :, None] == codes[:, None, :]).astype(np.float32)
    n = codes.shape[1]
    ends = DECAY ** 2 * same
    total = np.zeros(len(codes))
    for weight in (PAIR_WEIGHT, 1.0):
        reach = ends.copy()
        for i in range(1, n):
            reach[:, i, :] += DECAY * reach[:, i - 1, :]
        for j in range(1, n):
            reach[:, :, j] += DECAY * reach[:, :, j - 1]
        ends = np.zeros_like(same)
        ends[:, 1:, 1:] = DECAY ** 2 * same[:, 1:, 1:] * reach[:, :-1, :-1]
        total += weight * ends.sum(axis=(1, 2))
    return total


def subsequences(marked: str) -> Counter:
    """phi(word): the weight of every subsequence of two and three letters."""
    out: Counter = Counter()
    for i, j in combinations(range(len(marked)), 2):
        out[marked[i] + marked[j]] += math.sqrt(PAIR_WEIGHT) * DECAY ** (j - i + 1)
    for i, j, k in combinations(range(len(marked)), 3):
        out[marked[i] + marked[j] + marked[k]] += DECAY ** (k - i + 1)
    return out


def _tables(marked: list[str], letters: dict[str, int], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The landmarks' subsequence weights, one column per column of ``weights`` (landmarks x columns)."""
    a, width = ALPHABET, weights.shape[1]
    pairs, triples = np.zeros((a * a, width), np.float32), np.zeros((a ** 3, width), np.float32)
    for word, row in zip(marked, weights):
        for key, value in subsequences(word).items():
            code = [letters.get(c, 0) for c in key]
            if 0 not in code:
                at = code[0] * a + code[1]
                if len(code) == 2:
                    pairs[at] += value * row * math.sqrt(PAIR_WEIGHT)
                else:
                    triples[at * a + code[2]] += value * row
    return pairs, triples


def _against(codes: np.ndarray, pairs: np.ndarray, triples: np.ndarray) -> np.ndarray:
    """Sum over all subsequences of equally long words of their weight times the table's."""
    a, n = ALPHABET, codes.shape[1]
    out = np.zeros((len(codes), pairs.shape[1]), np.float32)
    cols = [np.ascontiguousarray(codes[:, i]) for i in range(n)]
    for i in range(n):
        for j in range(i + 1, n):
            two = cols[i] * a + cols[j]
            out += np.float32(DECAY ** (j - i + 1)) * pairs[two]
            two *= a
            for k in range(j + 1, n):
                out += np.float32(DECAY ** (k - i + 1)) * triples[two + cols[k]]
    return out


@dataclass
class Model:
    letters: dict[str, int]
    pairs: np.ndarray
    triples: np.ndarray
    bias: float
    slope: float
    offset: float
    lowest: float
    trained: bool = True

    def word_margins(self, marked: list[str]) -> np.ndarray:
        """Decision values of marked words (any lengths)."""
        out = np.empty(len(marked))
        sizes = np.fromiter(map(len, marked), np.int64, len(marked))
        for n in np.unique(sizes):
            at = np.flatnonzero(sizes == n)
            for part in np.array_split(at, max(1, len(at) // 2048)):
                points = np.frombuffer("".join(marked[i] for i in part).encode("utf-32-le"), np.uint32).reshape(
                    len(part), n)
                seen, back = np.unique(points, return_inverse=True)
                codes = np.array([self.letters.get(chr(c), 0) for c in seen], np.int64)[back].reshape(points.shape)
                top = _against(codes, self.pairs, self.triples)[:, 0]
                out[part] = top / np.sqrt(self_kernel(points) + 1e-12) + self.bias
        return out

    def margins(self, words: list[str]) -> np.ndarray:
        """Margin of each white-space word: the largest over its letter strings and their windows."""
        flat, owner = [], []
        for i, word in enumerate(words):
            for unit in units(word):
                for w in windows(unit):
                    flat.append(w)
                    owner.append(i)
        out = np.full(len(words), FLOOR)
        if flat:
            np.maximum.at(out, np.array(owner), self.word_margins(flat))
        return out

    def score(self, margin: float) -> float:
        if not self.trained:
            return 0.0
        margin = max(margin, self.lowest)
        return 1.0 / (1.0 + math.exp(-max(-60.0, min(60.0, self.slope * margin + self.offset))))


def _svm(z: np.ndarray, y: np.ndarray, often: np.ndarray, cost: float = COST) -> tuple[np.ndarray, float]:
    """Primal squared-hinge SVM by Newton steps; both classes weigh the same, words by how often they occur."""
    x = np.hstack([z, np.ones((len(z), 1))])
    weight = np.where(y > 0, often / often[y > 0].sum(), often / often[y < 0].sum()) * cost
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        on = y * (x @ w) < 1
        if not on.any():
            break
        xs, c = x[on], weight[on]
        new = np.linalg.solve(ridge + (xs * c[:, None]).T @ xs, xs.T @ (c * y[on]))
        done = np.abs(new - w).max() < 1e-6
        w = new
        if done:
            break
    return w[:-1], float(w[-1])


def _features(marked: str, letters: dict[str, int]) -> dict[str, float]:
    return {key: value for key, value in subsequences(marked).items() if all(c in letters for c in key)}


def _nystroem(landmarks: list[str], letters: dict[str, int], words: list[str], y: np.ndarray,
              often: np.ndarray) -> Model:
    """Fit the SVM in the features of ``landmarks`` and fold it into one weight per subsequence."""
    index: dict[str, int] = {}
    known = [_features(mark, letters) for mark in landmarks]
    for key in (k for found in known for k in found):
        index.setdefault(key, len(index))
    table = np.zeros((len(index) + 1, len(landmarks)), np.float32)
    for at, found in enumerate(known):
        table[[index[k] for k in found], at] = list(found.values())

    def norm(marked: list[str]) -> np.ndarray:
        return np.sqrt([sum(v * v for v in subsequences(m).values()) + 1e-12 for m in marked])

    def kernel(marked: list[str]) -> np.ndarray:
        out = np.zeros((len(marked), len(landmarks)), np.float32)
        for at, mark in enumerate(marked):
            found = subsequences(mark)
            keys = [index.get(k, -1) for k in found]
            out[at] = np.array(list(found.values()), np.float32) @ table[keys]
            out[at] /= math.sqrt(sum(v * v for v in found.values()) + 1e-12)
        return out

    own = norm(landmarks)
    gram = kernel(landmarks) / own
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-4))) @ vectors.T
    w, bias = _svm((kernel(words) / own) @ root, y, often)
    beta = (root @ w / own)[:, None]
    return Model(letters, *_tables(landmarks, letters, beta), bias, 1.0, 0.0, -1.0)


def _padded(word: str, seed: int) -> list[str]:
    """A word with one letter put in, at places that the seed picks."""
    if len(word) < 4:
        return []
    made = []
    for t in range(PADDED):
        h = zlib.crc32(f"{seed}:{t}:{word}".encode())
        at = 1 + h % (len(word) - 1)
        made.append(word[:at] + "abcdefghijklmnopqrstuvwxyz"[(h >> 8) % 26] + word[at:])
    return made


def _unlike(bags: list[np.ndarray], codes: np.ndarray) -> list[np.ndarray]:
    """The bags without near copies of earlier ones: half of eight minimum hashes in common."""
    kept, seen = [], [{} for _ in range(8)]
    for words in bags:
        if not len(words):
            continue
        c = codes[words].astype(np.uint64)
        least = [int(((c * np.uint64(2 * t + 0x9E3779B1) + np.uint64(t * 0x85EBCA6B)) & np.uint64(0xFFFFFFFF)).min())
                 for t in range(8)]
        hits = Counter(seen[t][m] for t, m in enumerate(least) if m in seen[t])
        if hits and max(hits.values()) >= 4:
            continue
        for t, m in enumerate(least):
            seen[t].setdefault(m, len(kept))
        kept.append(words)
    return kept


def _witnesses(toxic: list[np.ndarray], clean: np.ndarray, n_clean: int, codes: np.ndarray) -> list[int]:
    """Words too often in toxic texts for chance, commonest first (as numbers).

    With equal odds for every sampled text, ``k`` toxic texts and no clean one
    have chance ``share ** k``; below ``CHANCE`` a word counts as a witness.  If
    there are too few labels for that, the words that no clean text has cover
    the toxic texts one by one.
    """
    unlike = _unlike(toxic, codes)
    count = np.bincount(np.concatenate(unlike), minlength=len(clean)) if unlike else np.zeros_like(clean)
    least = max(2, math.ceil(math.log(CHANCE) / math.log(len(toxic) / (len(toxic) + n_clean))))
    order = np.lexsort((np.arange(len(count)), -count))
    often = order[(count[order] >= least) & (clean[order] <= CLEAN_SHARE * count[order])]
    if len(often):
        return often.tolist()
    left = {int(w): {i for i, b in enumerate(unlike) if w in b}
            for w in order[(clean[order] == 0) & (count[order] > 0)][:200]}
    chosen: list[int] = []
    while left:
        best = max(left, key=lambda w: (len(left[w]), -w))
        if len(left[best]) < 2 and chosen:
            break
        chosen.append(best)
        gone = left.pop(best)
        left = {w: rest for w, t in left.items() if (rest := t - gone)}
    return chosen


def fit(samples: Iterable[tuple[int, Iterable[str]]], rounds: int = ROUNDS) -> Model:
    """Model from (label, letter strings) of the sampled texts; words are numbers from here on."""
    number: dict[str, int] = {}
    bags, label = [], []
    for y, found in samples:
        bags.append(np.unique(np.fromiter((number.setdefault(u, len(number)) for u in found), np.int64)))
        label.append(1.0 if y == 1 else 0.0)
    names, label = list(number), np.array(label)
    del number
    toxic = [b for b, y in zip(bags, label) if y]
    clean_bags = [b for b, y in zip(bags, label) if not y]
    empty = np.zeros((ALPHABET ** 2, 1), np.float32), np.zeros((ALPHABET ** 3, 1), np.float32)
    if not any(map(len, toxic)) or not any(map(len, clean_bags)):
        return Model({}, *empty, -1.0, 1.0, 0.0, -1.0, trained=False)
    clean, in_toxic = (np.bincount(np.concatenate(part), minlength=len(names)) for part in (clean_bags, toxic))
    count: Counter = Counter()
    for w in names:
        count.update(w)
    letters = {"^": 1, "$": 2}
    for c, _ in sorted(count.items(), key=lambda x: (-x[1], x[0]))[: ALPHABET - 3]:
        letters.setdefault(c, len(letters) + 1)
    codes = np.array([zlib.crc32(w.encode()) for w in names], np.uint32)
    by_hash = np.argsort(codes, kind="stable")
    hashed = by_hash[clean[by_hash] > 0][:2000].tolist()
    found = _witnesses(toxic, clean, len(clean_bags), codes)
    known = set(names)
    positive, hard, model, margin = list(found), [], None, np.zeros(len(names))
    for _ in range(rounds):
        good = list(dict.fromkeys(positive))
        extra = [p for k, w in enumerate(good) for p in _padded(names[w], k) if p not in known]
        negative = list(dict.fromkeys([*hard, *hashed]))
        marked, y, often = [], [], []
        for word, value, n in [*((names[w], 1.0, in_toxic[w]) for w in good), *((w, 1.0, 1) for w in extra),
                               *((names[w], -1.0, clean[w]) for w in negative)]:
            for part in windows(word):
                marked.append(part)
                y.append(value)
                often.append(math.sqrt(max(1, n)))
        spread = sorted(good[30:], key=lambda w: int(codes[w]))
        half = LANDMARKS // 2
        picked = [*[*good[:30], *spread][:half], *negative[: half // 2], *negative[-half:]]
        landmarks = list(dict.fromkeys(windows(names[w])[0] for w in picked))[:LANDMARKS]
        model = _nystroem(landmarks, letters, marked, np.array(y), np.array(often))
        for at in range(0, len(names), 20_000):
            margin[at:at + 20_000] = model.margins(names[at:at + 20_000])
        order = np.argsort(-margin, kind="stable")
        worst = order[clean[order] > 0]
        bar = max(0.3, margin[worst[min(len(worst) - 1, len(worst) // 10_000)]])
        hard = list(dict.fromkeys([*worst[:1000].tolist(), *hard]))
        fresh = (in_toxic > 0) & (clean == 0) & (margin > bar)
        witness = {int(b[fresh[b]][np.argmax(margin[b[fresh[b]]])]) for b in toxic if fresh[b].any()}
        positive = [*found, *sorted(witness), *np.flatnonzero(fresh & (in_toxic >= 3)).tolist()]
    top = np.array([margin[b].max() if len(b) else np.nan for b in bags])
    model.lowest = float(np.nanmin(top))
    model.slope, model.offset = _logistic(np.where(np.isnan(top), model.lowest, top), label)
    return model


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(toxic | margin), smoothed targets, both labels of equal weight."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    a = np.stack([x, np.ones_like(x)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -60, 60)))
        grad = a.T @ (weight * (p - target)) + 1e-4 * np.array([w[0], 0])
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w - step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def held_out(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` toxic and CLEAN_PER_TOXIC times as many clean texts, none of them held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    picked = known.where("toxic = 1").orderBy(*order).limit(sample).unionByName(
        known.where("toxic <> 1").orderBy(*order).limit(CLEAN_PER_TOXIC * sample))
    texts = docs.select("doc_id", "text").join(picked, "doc_id")

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [" ".join(sorted({u for w in words_of(t) for u in units(w)})) if t else ""
                     for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic").cast(pa.int32()),
                                              pa.array(found, pa.string())], ["doc_id", "toxic", "units"])

    rows = texts.select("doc_id", "toxic", "text").mapInArrow(
        tokens, "doc_id long, toxic int, units string").collect()       # at most (1 + CLEAN_PER_TOXIC) x sample rows
    rows.sort(key=lambda r: (r.doc_id, r.units))
    return fit((r.toxic, r.units.split()) for r in rows)


def _chunks(texts: list[str | None]) -> Iterator[list[str | None]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= CHUNK_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def with_score(docs: DataFrame, model: Model, text: str = "text", out: str = "_toxicity") -> DataFrame:
    """``docs`` with the toxicity score of each whole text in the column ``out``."""
    return on_core(docs, (text,), lambda d: _with_score(d, model, text, out), (out,))


def _with_score(docs: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores = []
            for part in _chunks(batch.column(text).to_pylist()):
                sets = [words_of(t) if t else set() for t in part]
                if len(known) > CACHE_WORDS:
                    known.clear()
                new = sorted(set().union(*sets) - known.keys()) if model.trained else []
                known.update(zip(new, model.margins(new).tolist()))
                if model.trained:
                    scores += [model.score(max(map(known.__getitem__, s), default=model.lowest)) for s in sets]
                else:
                    scores += [0.0] * len(sets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, out])

    return docs.mapInArrow(freed(score), schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    model = train(docs, labels)
    out = with_score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"),
                      F.col("_toxicity").alias("score"), (F.col("_toxicity") >= 0.5).cast("int").alias("predicted"))
