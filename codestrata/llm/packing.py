"""Best-fit packing of documents into sequences of several permitted lengths.

A document longer than the longest sequence is cut into full sequences and a
rest. Pieces are dealt at random (by hash) into bounded shards; in a shard they
are placed from the longest to the shortest. A piece goes to the open bin with
the least room that still holds it. If none does, a bin opens with the size
that costs least for each word it can hold: its cost (by default one for each
place and one for each pair of places, weighted) over the piece and what pieces
still to come that fit its room can add. At the end a bin is cut down to the
smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .shared import stored

SIZES = (512, 1024, 2048, 4096)
SHARD_PIECES = 20_000


def sequence_cost(size: int) -> float:
    """Places of a sequence and, at a weight that counts as much at 16 K places, pairs of places."""
    return size + size * size / 16_384


def pack_pieces(lengths: list[int], sizes: tuple[int, ...] = SIZES, cost=sequence_cost) -> tuple[list[int], list[int], list[int]]:
    """For each piece its bin and offset, and for each bin its final size. ``lengths`` must fall; none exceeds ``sizes[-1]``."""
    rising = lengths[::-1]
    sums = [0, *accumulate(rising)]
    room: list[tuple[int, int]] = []  # of bins that are open, least room first
    used: list[int] = []
    bins, offsets = [], []
    for nth, length in enumerate(lengths):
        at = bisect_left(room, (length, -1))
        if at < len(room):
            left, number = room.pop(at)
        else:

            def per_word(size: int) -> float:
                fit = min(bisect_left(rising, size - length + 1), len(lengths) - nth - 1)
                return cost(size) / (length + min(size - length, sums[fit]))

            number, left = len(used), min((s for s in sizes if s >= length), key=per_word)
            used.append(0)
        bins.append(number), offsets.append(used[number])
        used[number] += length
        if left > length:
            insort(room, (left - length, number))
    return bins, offsets, [next(s for s in sizes if s >= u) for u in used]


def _pack_shard(sizes: tuple[int, ...]):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "key", "copy", "piece"], ascending=[False, True, True, True], kind="stable")
        bins, offsets, final = pack_pieces(frame["length"].tolist(), sizes)
        shard = int(frame["shard"].iloc[0])
        return pd.DataFrame(
            {
                "doc_id": frame["doc_id"],
                "copy": frame["copy"],
                "piece": frame["piece"],
                "length": frame["length"],
                "bin_id": [shard << 32 | b for b in bins],
                "bin_size": [final[b] for b in bins],
                "bin_offset": offsets,
            }
        )

    return pack


def pack(docs: DataFrame, *, sizes: tuple[int, ...] = SIZES, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``doc_id, copy, piece, length, bin_id, bin_size, bin_offset``: where each piece of each document goes.

    Lengths are words of ``text``; documents without words have no piece.
    Pieces of a document are numbered from 0, all but the last as long as the
    longest sequence. Rows alike in id and text are
    packed once each and numbered by ``copy``. Null ids
    are packed like others; very long texts are many pieces, which shards share;
    pieces of equal length go in the order of a hash of id and text, and of bins
    with equal room the first opened takes them. Other columns are ignored; an
    empty table gives an empty result. Shards hold about ``shard_pieces`` pieces
    at any input size.
    """
    sizes = tuple(sorted(sizes))
    most = sizes[-1]
    key = F.xxhash64("doc_id", "text")
    slim = docs.select("doc_id", word_count(F.col("text")).alias("words"), key.alias("key")).where("words > 0")
    slim = stored(slim.groupBy("doc_id", "words", "key").agg(F.count("*").alias("n_alike")), "pack-sizes")
    total = slim.agg(F.sum(F.ceil(F.col("words") / F.lit(most)) * F.col("n_alike")).alias("n")).first()["n"] or 0
    last = F.ceil(F.col("words") / F.lit(most)).cast("long") - 1
    pieces = slim.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_alike") - 1)))
    pieces = pieces.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    pieces = pieces.withColumn("length", F.least(F.lit(most).cast("long"), F.col("words") - F.col("piece") * most))
    shard = F.pmod(F.xxhash64("key", "copy", "piece"), F.lit(max(1, -(-int(total) // shard_pieces))))
    schema = "doc_id long, copy long, piece long, length long, bin_id long, bin_size long, bin_offset long"
    return pieces.withColumn("shard", shard).groupBy("shard").applyInPandas(_pack_shard(sizes), schema)
