"""Token counts of a unigram tokenizer by count-only Viterbi.

An Aho-Corasick automaton lists the vocabulary pieces that end at each place;
dynamic programming carries the best score to each place and the number of
tokens on that path. Ties go to the piece that starts first, as in the tokenizer
itself; a character that no piece matches costs the least score less 10 and
falls back to its bytes. Texts are cut where no piece can span, at the start of
a run of spaces and at line ends, and the count of each such segment is kept in
a bounded cache.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")
_CACHE = 400_000


def load_pieces(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """The pieces and scores of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class Counter(dict):
    """Segment -> tokens; computes what it does not hold."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - 10
        self.splits = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p, _ in pieces)

    def __missing__(self, segment: str) -> int:
        n = self.viterbi(segment)
        if len(self) >= _CACHE:
            self.clear()
        self[segment] = n
        return n

    def viterbi(self, text: str) -> int:
        size, unknown = len(text), self.unknown
        best, count = [0.0] + [float("-inf")] * size, [0] * (size + 1)
        at, single = 1, False
        for last, (length, score) in self.automaton.iter(text):
            while at <= last:
                if not single and best[at - 1] + unknown > best[at]:
                    best[at], count[at] = best[at - 1] + unknown, count[at - 1] + len(text[at - 1].encode())
                at, single = at + 1, False
            value = best[at - length] + score
            if value > best[at]:
                best[at], count[at] = value, count[at - length] + 1
            single |= length == 1
        while at <= size:
            if not single and best[at - 1] + unknown > best[at]:
                best[at], count[at] = best[at - 1] + unknown, count[at - 1] + len(text[at - 1].encode())
            at, single = at + 1, False
        return count[size]

    def tokens(self, text: str | None) -> int:
        if not text:
            return 0
        marked = SPACE + text.replace(" ", SPACE)
        return sum(map(self.__getitem__, _SEGMENT.findall(marked))) if self.splits else self.viterbi(marked)


_counters: dict[str, Counter] = {}


def _count_rows(pieces):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hashlib.sha256(repr(pieces.value).encode()).hexdigest()
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(pieces.value)
        counter = _counters[key]
        for batch in batches:
            n = [counter.tokens(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    return count


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens``, a row for each document; null and empty texts have 0.

    Very long texts are counted whole, segment by segment; rows alike have equal
    counts; paths that tie go to the piece that starts first. An empty table gives
    an empty result.

    The vocabulary is read once by the driver and broadcast (its size is that of
    the file, not of the data). No row is shuffled; other columns are ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary))
    return docs.select("doc_id", "text").mapInArrow(_count_rows(pieces), "doc_id long, n_tokens long")
