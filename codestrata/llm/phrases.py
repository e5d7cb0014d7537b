"""Phrase collocations by Apriori level-wise passes over all texts.

Level ``k`` counts the phrases of ``k`` words whose first and last ``k - 1`` words
are frequent. What a pass needs to know of the level below is broadcast as a
bitmap of the hashes of its frequent phrases, of at most ``2 ** MAX_BITS`` bits
whatever the corpus: a bit that two phrases share lets through a phrase too many,
whose exact count then drops it, and never loses one. Counts are kept by the
phrase itself, summed inside each block of text, then inside each task, then by
Spark. Cuts are scored from the stored level tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, stored
from .text_arrays import Block, blocks, mix

MIN_COUNT = 100
MAX_WORDS = 5
TOP = 2000
#: Texts that are counted together before their phrases leave Python.
COUNT_BYTES = 1 << 22
#: Bits of the bitmap for each frequent phrase, and its largest size: 2 ** 29 bits are 64 MB.
BITS_EACH, MAX_BITS = 16, 29
#: The best ones of so many parts of a language are found before they meet.
PARTS = 64
UNKNOWN = "und"
_CUT = np.zeros(256, bool)
_CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_OUT = _CUT.copy()
_OUT[[0x20, 0x09]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of some texts, lower-cased and joined by single blanks, with the piece that each lies in."""

    def __init__(self, block: Block, languages: np.ndarray):
        data = block.data
        inside = ~_OUT[data]
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = block.offsets[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(data))]
        begins[cuts] = inside[cuts]
        ends[cuts - 1] = inside[cuts - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        owner = np.searchsorted(block.offsets, start, "right") - 1
        self.language = languages[block.first_row + owner]
        self.piece = np.cumsum(_CUT[data])[start] + owner if len(start) else start
        size = end - start
        self.start = np.cumsum(size + 1) - size - 1
        self.end = self.start + size
        text = np.full(int((size + 1).sum()), 0x20, np.uint8)
        place = np.repeat(start - self.start, size) + np.flatnonzero(_within(self.start, self.end, len(text)))
        text[_within(self.start, self.end, len(text))] = _LOWER[data[place]]
        self.block = Block(text, np.array([0, len(text)]), 0)
        self.sums = self.block.prefix_sums()

    def phrases(self, k: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the first word of each phrase of ``k`` words, and its hash, which the language is part of."""
        first = np.arange(max(len(self.start) - k + 1, 0))
        first = first[self.piece[first] == self.piece[first + k - 1]]
        return first, mix(self.block.span_hashes(self.sums, self.start[first], self.end[first + k - 1]) ^ codes[self.language[first]])


def _within(start: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n + 1, np.int8)
    mark[start] = 1
    mark[end] -= 1
    return np.cumsum(mark[:n]).astype(bool)


def _set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(8 * len(bits) - 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of ``data`` as strings."""
    size = end - start
    offsets = np.r_[0, np.cumsum(size)]
    place = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    found = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[place]))
    return found.cast(pa.string())


def _language_codes(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Names of a batch's languages, the hash of each, and the number of each row's language."""
    coded = column.fill_null(UNKNOWN).dictionary_encode()
    names = coded.dictionary.to_pylist()
    each = [next(blocks(pa.array([x + "\x00"]))) for x in names]
    codes = np.array([b.span_hashes(b.prefix_sums(), np.array([0]), np.array([len(b.data)]))[0] for b in each], np.uint64)
    return names, codes, coded.indices.to_numpy(zero_copy_only=False)


def _count_rows(k: int, known):
    """Phrases of ``k`` words and their counts; from the second level on only those whose first and last words are frequent."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes, numbers = _language_codes(batch.column("lang"))
            for block in blocks(batch.column("text"), COUNT_BYTES):
                words = Words(block, numbers)
                first, value = words.phrases(k, codes)
                if known is not None:
                    below, frequent = words.phrases(k - 1, codes)
                    passes = np.zeros(len(words.start) + 1, bool)
                    passes[below] = _set(known.value, frequent)
                    keep = passes[first] & passes[first + 1]
                    first, value = first[keep], value[keep]
                _, place, counts = np.unique(value, return_index=True, return_counts=True)
                place = first[place]
                language = pa.DictionaryArray.from_arrays(pa.array(words.language[place].astype(np.int32)), pa.array(names, pa.string()))
                phrase = _spans(words.block.data, words.start[place], words.end[place + k - 1])
                yield pa.RecordBatch.from_arrays([language.cast(pa.string()), phrase, pa.array(counts.astype(np.int64))], ["lang", "phrase", "a"])

    return count


def _bit_rows(bits: int):
    """The bytes of the bitmap that the phrases of a task set."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, codes, numbers = _language_codes(batch.column("lang"))
            for block in blocks(batch.column("phrase")):
                start, end = block.offsets[:-1], block.offsets[1:]
                value = mix(block.span_hashes(block.prefix_sums(), start, end) ^ codes[numbers[block.first_row : block.first_row + block.rows]])
                place = value & np.uint64((1 << bits) - 1)
                yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], ["at", "mask"])

    return mark


def bitmap(frequent: DataFrame, max_bits: int = MAX_BITS) -> np.ndarray:
    """One bit for the hash of each phrase of ``frequent``; of ``2 ** max_bits`` bits at most."""
    bits = min(max_bits, max(16, (BITS_EACH * frequent.count()).bit_length()))
    rows = frequent.select("lang", "phrase").mapInArrow(_bit_rows(bits), "at long, mask long")
    out = np.zeros(1 << (bits - 6), np.int64)
    for r in rows.groupBy("at").agg(F.bit_or("mask").alias("mask")).toLocalIterator():
        out[r["at"]] = r["mask"]
    return out.view(np.uint8)


def levels(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, max_bits: int = MAX_BITS) -> tuple[list[DataFrame], DataFrame]:
    """Stored tables ``lang, phrase, a`` of the frequent phrases of 1 to ``max_words`` words, and ``lang, n``.

    A level ends the passes when it is empty. The levels are what is left after
    counting whole, so none depends on how texts are dealt to tasks.
    """
    texts = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")
    spark = docs.sparkSession
    found: list[DataFrame] = []
    sizes = known = None
    for k in range(1, max_words + 1):
        counts = texts.mapInArrow(_count_rows(k, known), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
        if k == 1:
            # All words are needed for n: stored, as the counts are read twice.
            words = stored(counts, "words")
            sizes = stored(words.groupBy("lang").agg(F.sum("a").alias("n")), "language-sizes")
            found.append(stored(words.where(F.col("a") >= min_count), "level-1"))
            discard(words)
        else:
            found.append(stored(counts.where(F.col("a") >= min_count), f"level-{k}"))
            known.unpersist()
        if k == max_words or found[-1].isEmpty():
            break
        known = spark.sparkContext.broadcast(bitmap(found[-1], max_bits))
    return found, sizes


def _part(first: int | Column, n: int | Column) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def scored(found: list[DataFrame], sizes: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every frequent phrase of two words or more: the lowest cut, of equal ones the first.

    Products are exact: decimals of 38 digits hold 1000 times the square of 10^17.
    """
    counts = reduce(DataFrame.unionByName, found)
    long = reduce(DataFrame.unionByName, found[1:]).withColumn("w", F.split("phrase", " "))
    cuts = long.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, F.size("w") - F.col("k")).alias("tail"))
    # The tables grow with the corpus, so Spark joins them by size; a frequent head is split by adaptive execution.
    heads = counts.select(F.col("lang").alias("hl"), F.col("phrase").alias("hp"), F.col("a").alias("l"))
    tails = counts.select(F.col("lang").alias("tl"), F.col("phrase").alias("tp"), F.col("a").alias("r"))
    cuts = cuts.join(heads, (F.col("lang") == F.col("hl")) & (F.col("head") == F.col("hp"))).join(tails, (F.col("lang") == F.col("tl")) & (F.col("tail") == F.col("tp")))
    cuts = cuts.join(F.broadcast(sizes.withColumnRenamed("lang", "nl")) if sizes.count() <= 100_000 else sizes.withColumnRenamed("lang", "nl"), F.col("lang") == F.col("nl"))
    wide = lambda c: F.col(c).cast("decimal(18,0)")
    top, under = F.lit(1000).cast("decimal(4,0)") * (wide("a") * wide("n")), wide("l") * wide("r")
    cuts = cuts.withColumns({"__top": top, "__under": under}).withColumn("score", F.expr("__top div __under"))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("x"))
    return lowest.select("lang", "phrase", "x.a", "x.l", "x.r", "x.n", "x.score")


def collocations(docs: DataFrame, *, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP, max_bits: int = MAX_BITS) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends and
    into words at blanks and tabs; a phrase is 2 to ``max_words`` words of one
    piece that occur together at least ``min_count`` times in the language,
    overlaps included. A phrase that occurs no more often than a longer one that
    holds it is left out. Order: score and count descending, then the phrase in
    byte order.

    A null language is ``und``; a null or empty text has no words; a very long text
    is counted whole; repeated rows count each time; other columns are ignored; an
    empty table gives an empty result.
    """
    found, sizes = levels(docs, min_count=min_count, max_words=max_words, max_bits=max_bits)
    if len(found) == 1:
        return docs.sparkSession.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    # A phrase inside a longer one of its count lies also in one that is a word longer, of that count too.
    longer = [x.select("lang", "a", F.explode(F.array(F.substring_index("phrase", " ", k), F.substring_index("phrase", " ", -k))).alias("phrase")) for k, x in enumerate(found[2:], 2)]
    ranked = scored(found, sizes)
    if longer:
        covered = reduce(DataFrame.unionByName, longer).groupBy(F.col("lang").alias("cl"), F.col("phrase").alias("cp")).agg(F.max("a").alias("most"))
        ranked = ranked.join(covered, (F.col("lang") == F.col("cl")) & (F.col("phrase") == F.col("cp")) & (F.col("most") >= F.col("a")), "left_anti")
    # One language may hold most phrases: the best of its parts first, then the best of those.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = ranked.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part", "rank")
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
