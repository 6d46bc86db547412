"""Token counts of a unigram tokenizer without its tokens.

An Aho-Corasick automaton enumerates the vocabulary's pieces inside a word;
dynamic programming carries, per position, the best score and the number of
pieces of the path that has it.  Ties follow the reference tokenizer: starts
are tried from the left and only a strictly better score replaces a path, so
the longest last piece wins; a character that is no piece costs the smallest
score less 10; neighbouring unknown characters are one, and with byte pieces
count their UTF-8 bytes.

A text is cut before every space, as the tokenizer's word-boundary sign is put
there, so words are counted once and remembered.  The vocabulary comes from a
SentencePiece model file, whose path is a parameter; its scores are taken as
unigram scores (the files at hand are of BPE models: the counts are those of the
unigram tokenizer over that vocabulary, not of the BPE merges).

Defined results: NULL and empty texts have no tokens; repeated rows get equal
counts; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
PENALTY = 10.0
CACHE_WORDS = 400_000


@dataclass
class Vocabulary:
    pieces: list[tuple[str, float]]
    byte_pieces: bool
    least: float = field(init=False)

    def __post_init__(self) -> None:
        self.least = min(score for _, score in self.pieces)


def read_vocabulary(path: str = MODEL) -> Vocabulary:
    """Pieces and scores of a model file, read on the driver."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]
    return Vocabulary(pieces, any(model.is_byte(i) for i in range(model.get_piece_size())))


class Counts(dict):
    """Word to number of tokens, remembered; emptied when it has grown too large."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = frozenset(p for p, _ in vocabulary.pieces if len(p) == 1)
        self.unknown = vocabulary.least - PENALTY
        self.byte_pieces = vocabulary.byte_pieces

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        self[word] = n = self.count(word)
        return n

    def count(self, word: str) -> int:
        n = len(word)
        best: list[float | None] = [0.0] + [None] * n
        pieces, strange = [0] * (n + 1), [False] * (n + 1)
        done = 0                                        # ends up to here have their final path

        def finish(end: int) -> None:
            if word[end - 1] not in self.single:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end] = score
                    if self.byte_pieces:
                        extra = len(word[end - 1].encode())
                    else:
                        extra = 0 if strange[end - 1] else 1
                    pieces[end], strange[end] = pieces[end - 1] + extra, True

        for last, (size, score) in self.automaton.iter(word):
            end = last + 1
            while done < end - 1:
                done += 1
                finish(done)
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], pieces[end], strange[end] = score, pieces[end - size] + 1, False
        while done < n:
            done += 1
            finish(done)
        return pieces[n]

    def of(self, text: str | None) -> int:
        if not text:
            return 0
        text = text.replace(" ", SPACE)
        words = (text[1:] if text.startswith(SPACE) else text).split(SPACE)
        return sum(map(self.__getitem__, [SPACE + w for w in words]))


def with_counts(docs: DataFrame, vocabulary: Vocabulary, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(vocabulary)
        for batch in batches:
            found = [counts.of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64()),
                                              batch.column("n_chars")], ["doc_id", "n_tokens", "n_chars"])

    rows = docs.select("doc_id", F.col(text).alias("text"),
                       F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("n_chars"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_chars long")
