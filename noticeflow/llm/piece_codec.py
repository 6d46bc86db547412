"""SentencePiece encoding and decoding by a table of distinct marked words.

No piece of such a model crosses a whitespace mark (checked when the model is
read), so BPE merges never leave a marked word: a run of marks and what follows
up to the next mark.  Texts are cut into marked words in blocks of about
``BLOCK`` bytes.  A block keeps its texts as numbers of its distinct words;
the distinct words alone are dealt by ``SHARDS`` hash shards over the cluster,
where every word that any block holds is segmented once, and the ids return to
their blocks to be joined by position.

Rows grow with the number of blocks, tasks hold one block or the distinct words
of one shard.  A frequent word is one entry of every block that holds it, however
often it occurs.  A block is named after its distinct words, so ids only ever
meet the block they were asked for; the shuffle that deals the blocks is read
twice, for the words and for the texts.

Segmenting follows the library: the pair of neighbouring symbols with the best
score merges first, ties from the left; characters that are no piece become their
UTF-8 bytes' pieces, or without byte pieces the unknown id, neighbouring ones
joined.  Normalising the text is the library's own function, or nothing but
marking the spaces where the model says so.

Defined results: NULL and empty texts have no pieces, only begin and end ids;
repeated rows and ids get equal results, a row each; very long texts are blocks
of their own; an empty table gives no rows; of ``docs`` only the key and the
text are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticeflow.llm.common import partitions

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_TEXT = " ⁇ "
BLOCK = 10_000_000
SHARDS = 512
SHORT = 64
LEVEL = 9
CUT = b"\xff"                       # in no UTF-8 text


class Model:
    """A BPE model file: its pieces, and what the library makes of texts before and after them."""

    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2

        self.data, proto = data, sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(data)
        self.kinds = [p.type for p in proto.pieces]
        self.pieces = [p.piece for p in proto.pieces]
        self.score = {p.piece: p.score for p in proto.pieces if p.type == self.NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == self.NORMAL}
        self.byte_ids = [i for i, k in enumerate(self.kinds) if k == self.BYTE]
        self.unknown = self.kinds.index(self.UNKNOWN)
        self.begin, self.end = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        spec = proto.normalizer_spec
        self.prefix = spec.add_dummy_prefix
        self.plain = not (spec.precompiled_charsmap or spec.remove_extra_whitespaces or spec.normalization_rule_tsv)
        if proto.trainer_spec.model_type != 2 or {self.USER, self.UNUSED} & set(self.kinds):
            raise ValueError("only BPE models without user-defined and unused pieces are read")
        if self.byte_ids and len(self.byte_ids) != 256:
            raise ValueError("byte pieces must be complete")
        if any(a != MARK and b == MARK for p in self.ids for a, b in zip(p, p[1:])):
            raise ValueError("a piece crosses a whitespace mark")

    @classmethod
    def read(cls, path: str = MODEL) -> Model:
        with open(path, "rb") as f:
            return cls(f.read())

    def __reduce__(self):
        return Model, (self.data,)

    @cached_property
    def library(self):
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_proto=self.data)

    def normalized(self, texts: pa.Array) -> pa.Array:
        """The texts as the model reads them, with spaces for marks."""
        if not self.plain:
            texts = pa.array(self.library.normalize(texts.to_pylist()), pa.large_string())
        marked = pc.replace_substring(texts, MARK, " ")
        if not self.plain or not self.prefix:
            return marked
        space, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
        return pc.if_else(pc.equal(marked, none), none, pc.binary_join_element_wise(space, marked, none))

    def segment(self, word: str) -> list[int]:
        """The ids of one marked word."""
        out, strange = [], False
        for piece in self.merged(word) if len(word) <= SHORT else self.merged_long(word):
            known = self.ids.get(piece)
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out += [self.byte_ids[x] for x in piece.encode()]
            elif not strange:
                out.append(self.unknown)
            strange = known is None
        return out

    def merged(self, word: str) -> list[str]:
        """The pieces after all merges, the best pair first; quadratic in the length."""
        parts, score, none = list(word), self.score.get, float("-inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            top = max(pairs)
            if top == none:
                break
            k = pairs.index(top)                            # the leftmost of equals
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
            del pairs[k]
            if k:
                pairs[k - 1] = score(parts[k - 1] + parts[k], none)
            if k < len(pairs):
                pairs[k] = score(parts[k] + parts[k + 1], none)
        return parts

    def merged_long(self, word: str) -> list[str]:
        """The same with a queue, for long words."""
        symbols, score = list(word), self.score
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []

        def offer(a: int, b: int) -> None:
            pair = symbols[a] + symbols[b]
            s = score.get(pair)
            if s is not None:
                heapq.heappush(queue, (-s, a, b, pair))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, a, b, pair = heapq.heappop(queue)
            if after[a] != b or symbols[a] + symbols[b] != pair:
                continue                                    # one of the two has merged otherwise
            symbols[a], symbols[b] = pair, ""
            after[a] = after[b]
            if after[a] < n:
                before[after[a]] = a
                offer(a, after[a])
            if before[a] >= 0:
                offer(before[a], a)
            after[b] = -1
        return [p for p in symbols if p]

    @cached_property
    def texts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The UTF-8 bytes of all pieces in one array, their starts and their sizes."""
        parts = []
        for piece, kind in zip(self.pieces, self.kinds):
            if kind == self.BYTE:
                parts.append(bytes([int(piece[1:-1], 16)]))
            elif kind == self.CONTROL:
                parts.append(b"")
            else:
                parts.append((UNKNOWN_TEXT if kind == self.UNKNOWN else piece.replace(MARK, " ")).encode())
        sizes = np.array([len(p) for p in parts], dtype=np.int64)
        return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes

    def decode(self, ids: np.ndarray) -> str:
        """The library's text of the ids; bytes that are no UTF-8 become replacement characters."""
        data, starts, sizes = self.texts
        if len(ids) == 0:
            return ""
        n = sizes[ids]
        ends = np.cumsum(n)
        raw = data[np.arange(ends[-1]) + np.repeat(starts[ids] - ends + n, n)].tobytes()
        spoken = np.flatnonzero(n)
        lead = int(self.prefix and len(spoken) > 0 and self.pieces[ids[spoken[0]]].startswith(MARK))
        try:
            if len(spoken) == 0 or len(spoken) == spoken[-1] - spoken[0] + 1:
                return raw[lead:].decode()
        except UnicodeDecodeError:
            pass
        return "".join(self._runs(ids, n, ends, raw))[lead:]

    def _runs(self, ids: np.ndarray, sizes: np.ndarray, ends: np.ndarray, raw: bytes) -> Iterator[str]:
        """The text of every piece, or of every run of byte pieces (a control piece ends a run)."""
        run = b""
        for i, size, end in zip(ids.tolist(), sizes.tolist(), ends.tolist()):
            piece = raw[end - size:end]
            if self.kinds[i] == self.BYTE:
                run += piece
            else:
                yield _lenient(run) + piece.decode()
                run = b""
        yield _lenient(run)


def _lenient(raw: bytes) -> str:
    """Every byte that begins no valid character is one replacement character."""
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + size].decode())
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


def marked_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The number of marked words of each normalised text, and all words in order as dictionary codes."""
    cut = pc.replace_substring(texts.cast(pa.large_binary()), b" ", CUT + b" ")
    for _ in range(2):                                      # neighbouring marks stay together
        cut = pc.replace_substring(cut, b" " + CUT + b" ", b"  ")
    words = pc.split_pattern(cut, CUT)
    flat = words.flatten()
    full = pc.greater(pc.binary_length(flat), 0)            # before the first mark there is nothing
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    return np.diff(upto[words.offsets.to_numpy()]), flat.filter(full).dictionary_encode()


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, their bytes by place."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), LEVEL)


def _unpacked(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), dtype=np.uint8).reshape(4, -1).T).view(
        "<u4").ravel().astype(np.int64)


def block_row(keys: pa.Array, texts: pa.Array, model: Model) -> pa.RecordBatch:
    """One block: its keys, words a text, texts as word numbers, and its distinct words by shard."""
    counts, codes = marked_words(model.normalized(texts.cast(pa.large_string()).fill_null("")))
    words = codes.dictionary.to_pylist()
    shard = np.fromiter((zlib.crc32(w) % SHARDS for w in words), dtype=np.int64, count=len(words))
    by_word = np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)
    order = by_word[np.argsort(shard[by_word], kind="stable")]
    place = np.empty(len(words), dtype=np.int64)
    place[order] = np.arange(len(words))
    data = CUT.join([words[k] for k in order])
    return pa.RecordBatch.from_arrays(
        [pa.array([hashlib.sha256(data).digest()]), pa.ListArray.from_arrays([0, len(keys)], keys),
         pa.array([_packed(counts)]), pa.array([_packed(place[codes.indices.to_numpy()])]),
         pa.array([_packed(np.bincount(shard, minlength=SHARDS))]), pa.array([zstandard.compress(data, LEVEL)])],
        ["block", "keys", "counts", "codes", "sizes", "words"])


def cut_blocks(model: Model):
    """Task function: (key, text) rows to blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, texts, size = [], [], 0

        def flushed() -> pa.RecordBatch:
            return block_row(pa.concat_arrays(keys), pa.concat_arrays(texts), model)

        for batch in batches:
            key, text = batch.column("key"), batch.column("text")
            upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)) + size
            at = 0
            while at < len(key):
                stop = min(len(key), int(np.searchsorted(upto, BLOCK)) + 1)
                keys.append(key.slice(at, stop - at))
                texts.append(text.slice(at, stop - at))
                size = int(upto[stop - 1])
                at = stop
                if size >= BLOCK:
                    yield flushed()
                    keys, texts, upto, size = [], [], upto - size, 0
                    pa.default_memory_pool().release_unused()
        if keys:
            yield flushed()
    return run


def deal_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task function: the distinct words of every block, a row per shard."""
    for batch in batches:
        for block, sizes, words in zip(*(batch.column(c) for c in ("block", "sizes", "words"))):
            words, at, rows = zstandard.decompress(words.as_py()).split(CUT), 0, []
            for shard, n in enumerate(_unpacked(sizes.as_py()).tolist()):
                if n:
                    rows.append((shard, zstandard.compress(CUT.join(words[at:at + n]), LEVEL)))
                    at += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.as_py()] * len(rows), pa.binary()), pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.binary())], ["block", "shard", "words"])


def segment_words(model: Model):
    """Task function over rows sorted by shard: each distinct word of a shard is segmented once."""
    width = "<u2" if len(model.pieces) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = {}, None
        for batch in batches:
            answers = []
            for shard, words in zip(batch.column("shard").to_pylist(), batch.column("words").to_pylist()):
                if shard != now:
                    known, now = {}, shard
                found = []
                for word in zstandard.decompress(words).split(CUT):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(model.segment(word.decode().replace(" ", MARK)), width).tobytes()
                    found.append(ids)
                sizes = np.array([len(x) for x in found], dtype="<u4") // np.dtype(width).itemsize
                answers.append((_packed(sizes), zstandard.compress(b"".join(found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("shard"), pa.array([x for x, _ in answers], pa.binary()),
                 pa.array([x for _, x in answers], pa.binary())], ["block", "shard", "n", "ids"])
    return run


def join_positions(model: Model):
    """Cogroup function: a block and the ids of its words to (key, ids) of its texts."""
    width = "<u2" if len(model.pieces) <= 1 << 16 else "<u4"

    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        # equal blocks have equal words, and asked for them once each
        first = dict(zip(answers["shard"].to_pylist(), zip(answers["n"].to_pylist(), answers["ids"].to_pylist())))
        found = [first[k] for k in sorted(first)]
        sizes = np.concatenate([_unpacked(n) for n, _ in found]) if found else np.empty(0, dtype=np.int64)
        ids = np.concatenate([np.frombuffer(zstandard.decompress(x), dtype=width) for _, x in found]) if found else sizes
        parts = [joined(row, sizes, ids) for row in blocks.select(["keys", "counts", "codes"]).to_batches(1)
                 if row.num_rows]
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(parts)

    def joined(row: pa.RecordBatch, sizes: np.ndarray, ids: np.ndarray) -> pa.Table:
        counts, codes = (_unpacked(row.column(c)[0].as_py()) for c in ("counts", "codes"))
        if len(codes) and codes.max() >= len(sizes):
            raise RuntimeError("words of a block were lost")
        n = sizes[codes]                                                     # ids of every word, in text order
        ends, starts = np.cumsum(n), (np.cumsum(sizes) - sizes)[codes]
        body = ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + n, n)]
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]       # ids before every text
        offsets = upto + 2 * np.arange(len(upto))                            # and a begin and an end id each
        out = np.empty(offsets[-1], dtype=np.int32)
        out[offsets[:-1]], out[offsets[1:] - 1] = model.begin, model.end
        inner = np.ones(len(out), dtype=bool)
        inner[offsets[:-1]] = inner[offsets[1:] - 1] = False
        out[inner] = body
        keys = row.column("keys").flatten()
        return pa.table({"key": keys, "ids": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))})
    return run


def encode(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>) of every row, with begin and end ids."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    n = partitions(docs.sparkSession)
    # both readers take whole rows, so that they share one shuffle
    blocks = rows.mapInArrow(cut_blocks(model), f"block binary, keys array<{kind}>, counts binary, codes binary, "
                                                "sizes binary, words binary").repartition(n, "block")
    dealt = blocks.mapInArrow(deal_words, "block binary, shard int, words binary")
    found = dealt.repartition(n, "shard").sortWithinPartitions("shard").mapInArrow(
        segment_words(model), "block binary, shard int, n binary, ids binary")
    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        join_positions(model), f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode(encoded: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, ids, text) of (key, ids); NULL ids have no text."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else model.decode(np.asarray(x.values, dtype=np.int64))
                     for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("ids"), pa.array(texts, pa.string())],
                                             ["key", "ids", "text"])

    return encoded.select(F.col(f"`{key}`").alias("key"), "ids").mapInArrow(
        run, f"key {kind}, ids array<int>, text string").withColumnRenamed("key", key)


def digests(encoded: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256); the ids' digest is of little-endian unsigned 32-bit numbers."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column("ids"):
                ids = np.asarray(row.values)
                found.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                              hashlib.sha256(model.decode(ids).encode()).hexdigest()))
            kinds = (pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), *(pa.array([r[k] for r in found], t) for k, t in enumerate(kinds))],
                ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.select(F.col(f"`{key}`").alias("key"), "ids").mapInArrow(
        run, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)
