"""Removal of byte strings that occur more than once, by merging Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else.
Two lengths can be asked for at once; the smaller one then takes the part below.

1. Every such string has one anchor, the smallest hash of its ``STEP``-byte
   pieces. Consecutive starts with the same anchor form a run. Two equal strings
   have equal anchors, so only runs whose anchor occurs twice are looked at.
2. Runs are dealt by anchor into bounded packs. In a pack, shards of runs get a
   Burrows-Wheeler transform each, over symbols of ``STEP`` bytes (one sequence
   per phase, so that every byte position is a suffix).
3. The transforms of the shards are merged by refining their interleave: each
   pass reads the symbols before the suffixes in the order so far and deals the
   shard numbers by symbol, so that after ``h`` passes all suffixes are in the
   order of their first ``h`` symbols. Block borders carry the common prefixes;
   after ``length / STEP`` passes a block is a repeated interval. No suffix is
   sorted again.

An anchor with more than ``HOT_RUNS`` runs, or runs of more than ``HOT_BYTES``,
does not go to one pack: the strings of its runs are counted one by one, by 128
bits of hash, combined before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored
from .text_arrays import Block, blocks, grouped_lists

LENGTH = 400
#: A passage of 51 words seldom has fewer bytes; a multiple of STEP, as LENGTH is.
PASSAGE = 240
#: Bytes of a symbol and of an anchor; divides LENGTH.
STEP = 80
HOT_RUNS = 16_000
HOT_BYTES = 8 << 20
PACK_BYTES = 2 << 20
SHARD_BYTES = 1 << 18
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` over each ``width`` consecutive values; the result is shorter by ``width - 1``."""
    size = 1
    while 2 * size <= width:
        x = pick(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return pick(x[: len(x) - rest], x[rest:]) if rest else x


def anchor_runs(block: Block, length: int, step: int) -> tuple[np.ndarray, ...]:
    """Runs of the block: anchor, text number, first start in the text, starts, and whether its anchor is in the text twice."""
    n, width = len(block.data), length - step + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    value = block.window_hashes(block.prefix_sums(), step)
    ends = np.repeat(block.offsets[1:], np.diff(block.offsets))
    value[np.arange(step, n + 1) > ends[: len(value)]] = _NONE
    low = _sliding(value, width, np.minimum)
    start = np.arange(len(low))
    ok = start + length <= ends[: len(low)]
    # A piece is an anchor if it is the least of some window around it.
    most = np.zeros(len(low) + 2 * (width - 1), np.uint64)
    most[width - 1 : width - 1 + len(low)] = np.where(ok, low, 0)
    place = np.flatnonzero(value == _sliding(most, width, np.maximum)[: len(value)])
    owner = np.searchsorted(block.offsets, place, "right") - 1
    order = np.lexsort((value[place], owner))
    o, v = owner[order], value[place][order]
    twice = np.flatnonzero((o[1:] == o[:-1]) & (v[1:] == v[:-1]))
    inner = set(zip(o[twice].tolist(), v[twice].tolist(), strict=True))

    begins = ok.copy()
    begins[1:] &= ~ok[:-1] | (low[1:] != low[:-1]) | (ends[1 : len(low)] != ends[: len(low) - 1])
    first = np.flatnonzero(begins)
    if not len(first):
        return none.astype(np.uint64), none, none, none, none.astype(bool)
    stops = np.flatnonzero(~ok)
    last = np.minimum(np.r_[first[1:], len(low)], np.r_[stops, len(low)][np.searchsorted(stops, first)])
    text = np.searchsorted(block.offsets, first, "right") - 1
    own = np.array([(t, a) in inner for t, a in zip(text.tolist(), low[first].tolist(), strict=True)], bool) if inner else np.zeros(len(first), bool)
    return low[first], text, first - block.offsets[text], last - first, own


def _run_rows(length: int, step: int):
    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                anchor, text, first, count, own = anchor_runs(block, length, step)
                lists = [grouped_lists(x, text, block.rows) for x in (anchor.view(np.int64), first, count, own)]
                size = pa.array(np.diff(block.offsets))
                keys = [batch.column(c).slice(block.first_row, block.rows) for c in ("doc_id", "sha")]
                yield pa.RecordBatch.from_arrays([*keys, size, *lists], ["doc_id", "sha", "n_bytes", "anchor", "first", "count", "own"])

    return runs


def _cut_rows(lengths: tuple[int, ...]):
    """Each run of a text as its bytes; a run of a hot anchor as the hashes of its strings of each length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "anchor", "first", "size", "piece", "h1", "h2"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        for batch in batches:
            tids, all_runs = batch.column("tid"), batch.column("runs")
            for block in blocks(batch.column("text")):
                sums = None
                for row in range(block.rows):
                    tid = tids[block.first_row + row].as_py()
                    base, stop = int(block.offsets[row]), int(block.offsets[row + 1])
                    out = []
                    for run in all_runs[block.first_row + row].as_py():
                        lo, n = base + run["first"], run["count"]
                        if not run["hot"]:
                            last = min(lo + n + lengths[-1] - 1, stop)
                            out.append((tid, run["anchor"], run["first"], n, block.data[lo:last].tobytes(), None, None))
                            continue
                        sums = block.prefix_sums() if sums is None else sums
                        for size in lengths:
                            at = np.arange(lo, min(lo + n, stop - size + 1))
                            halves = [block.span_hashes(sums, a, b).view(np.int64).tolist() for a, b in ((at, at + size // 2), (at + size // 2, at + size))]
                            out.append((tid, run["anchor"], run["first"], size, None, *halves))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return cut


def _deal(symbol: np.ndarray) -> np.ndarray:
    """Stable order of ``symbol`` (non-negative, below 2**31)."""
    packed = (symbol.astype(np.int64) << 32) | np.arange(len(symbol))
    packed.sort()
    return (packed & 0xFFFFFFFF).astype(np.int32)


def shard_transform(symbol: np.ndarray, begin: np.ndarray, end: np.ndarray, step: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order to ``depth`` symbols and the symbol before each suffix (0: none) of one shard.

    ``symbol[p]`` is the symbol that starts at byte ``p``; each piece [begin, end)
    and the free byte after it hold ``step`` interleaved sequences, whose empty
    suffixes lie at the last ``step`` places.
    """
    count = end - begin + 1
    owner_begin = np.repeat(begin, count)
    place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + owner_begin).astype(np.int32)
    empty = place[place + step > np.repeat(end, count)]
    first_of = np.zeros(int(end.max()) + 1, np.int32)
    first_of[place] = owner_begin
    order = place
    for _ in range(depth):
        before = order - step
        before = before[before >= first_of[order]]
        order = np.concatenate([empty, before[_deal(symbol[before])]])
    before = order - step
    has = before >= first_of[order]
    return order, np.where(has, symbol[np.where(has, before, 0)] + 1, 0)


def _shard_places(shard: np.ndarray) -> np.ndarray:
    """Where each place of an interleave is in the joined shards: their n-th mention is their n-th suffix."""
    place = np.empty(len(shard), np.int32)
    place[np.argsort(shard, kind="stable")] = np.arange(len(shard), dtype=np.int32)
    return place


def merge_transforms(transforms: list[np.ndarray], depths: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Interleave of the shards in the order of so many symbols, and the block (common prefix) of each place; one of each for each of the rising ``depths``."""
    sizes = np.array([len(t) for t in transforms])
    joined = np.concatenate(transforms).astype(np.int32)
    shard = np.repeat(np.arange(len(sizes), dtype=np.uint8 if len(sizes) <= 1 << 8 else np.uint32), sizes)  # small numbers are dealt in fewer passes
    block = np.zeros(len(joined), np.int32)
    place = np.arange(len(joined), dtype=np.int32)  # the shards lie one behind the other as yet
    found = []
    for done in range(1, depths[-1] + 1):
        before = joined[place]
        order = _deal(before)
        shard, block, before = shard[order], block[order], before[order]
        border = np.r_[True, (before[1:] != before[:-1]) | (block[1:] != block[:-1])]
        block = np.cumsum(border, dtype=np.int32) - np.int32(1)
        place = _shard_places(shard)
        if done in depths:
            found.append((place, block))
    return found


def repeated_places(pieces: list[bytes], weight: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...], step: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, list[np.ndarray]]:
    """Where each piece begins in the joined pieces; and for each length a flag for each place there, set if it is one of the first ``starts`` of a piece and begins a string of that length that occurs twice among all.

    The place behind a piece is free, and its flag is not set.
    """
    sizes = np.array([len(p) for p in pieces])
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    data = np.frombuffer(b"\0".join([*pieces, b""]), np.uint8)
    block = Block(data, np.array([0, len(data)]), 0)
    symbol = np.zeros(len(data), np.int32)
    known = np.unique(block.window_hashes(block.prefix_sums(), step), return_inverse=True)[1]
    symbol[: len(known)] = known
    depths = tuple(length // step for length in lengths)
    orders, transforms, first = [], [], 0
    while first < len(pieces):
        last = max(first + 1, int(np.searchsorted(end, begin[first] + shard_bytes, "right")))
        order, transform = shard_transform(symbol, begin[first:last], end[first:last], step, depths[-1])
        orders.append(order), transforms.append(transform)
        first = last
    joined = np.concatenate(orders)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes + 1)
    out = []
    for length, (rank, group) in zip(lengths, merge_transforms(transforms, depths), strict=True):
        # A place counts with the weight of its piece, unless it begins no string of the length there.
        full = np.arange(len(data)) < np.repeat(np.minimum(begin + starts, end - length + 1), sizes + 1)
        counted = np.where(full, np.asarray(weight, np.float64)[owner], 0)
        place = joined[rank]
        times = np.bincount(group, weights=counted[place])
        found = np.zeros(len(data), bool)
        found[place] = times[group] > 1
        out.append(found & full)
    return begin, out


def repeated_starts(pieces: list[bytes], weight: np.ndarray, starts: np.ndarray, lengths: tuple[int, ...], step: int, shard_bytes: int = SHARD_BYTES) -> list[list[np.ndarray]]:
    """For each length and piece, which of its first ``starts`` places begin a string of that length that occurs twice among all of them."""
    begin, found = repeated_places(pieces, weight, starts, lengths, step, shard_bytes)
    return [[flags[b : b + n] for b, n in zip(begin, starts, strict=True)] for flags in found]


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.r_[0, flags.astype(np.int8), 0])
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _merge_pack(lengths: tuple[int, ...], step: int):
    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        alike: dict[tuple[bytes, int], int] = {}
        piece_of = np.array([alike.setdefault(x, len(alike)) for x in zip(frame["piece"], frame["size"].tolist(), strict=True)])
        times = np.bincount(piece_of)
        begin, found = repeated_places([p for p, _ in alike], times, np.array([n for _, n in alike]), lengths, step)
        tids, firsts = frame["tid"].to_numpy(), frame["first"].to_numpy()
        row_of, row_begin = np.argsort(piece_of, kind="stable"), np.cumsum(times) - times
        out = []
        for length, flags in zip(lengths, found, strict=True):
            lo, hi = _intervals(flags)
            piece = np.searchsorted(begin, lo, "right") - 1
            # Each interval of a piece stands in all rows that have the piece.
            copies = times[piece]
            nth = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row = row_of[np.repeat(row_begin[piece], copies) + nth]
            a, b = (firsts[row] + np.repeat(x - begin[piece], copies) for x in (lo, hi))
            out.append(np.stack([tids[row], np.full(len(row), length), a, b - 1 + length]))
        tid, size, a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"tid": tid, "size": size, "a": a, "b": b})

    return merge


def removed_ranges(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), step: int = STEP, hot_runs: int = HOT_RUNS, hot_bytes: int = HOT_BYTES, pack_bytes: int = PACK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``texts (tid, sha, n_bytes, copies)``, ``hits (tid, text)`` and ``ranges (tid, ranges)`` of partly repeated texts.

    Texts are distinct; ``ranges`` are byte ranges covered by repeated strings of
    ``size`` bytes, one of the rising ``lengths`` (they may overlap). A text with
    ``copies > 1`` is repeated as a whole and is not in ``ranges``.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    runs = keyed.mapInArrow(_run_rows(lengths[0], step), "doc_id long, sha string, n_bytes long, anchor array<long>, first array<long>, count array<long>, own array<boolean>")
    lists = [F.first(c).alias(c) for c in ("n_bytes", "anchor", "first", "count", "own")]
    texts = runs.groupBy("sha").agg(F.min("doc_id").alias("carrier"), F.count("*").alias("copies"), *lists)
    whole = stored(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    texts = stored(whole.select("tid", "sha", "carrier", "n_bytes", "copies"), "text-keys")

    flat = whole.select("tid", F.explode(F.arrays_zip("anchor", "first", "count", "own")).alias("r")).select("tid", "r.*")
    again = flat.groupBy(F.col("anchor").alias("h")).agg(F.count("*").alias("k"), F.sum(F.col("count") + lengths[-1]).alias("octets"), F.max("own").alias("own")).where("k > 1 or own")
    again = stored(again.select("h", ((F.col("k") > hot_runs) | (F.col("octets") > hot_bytes)).alias("hot")), "anchors")
    found = flat.join(again, F.col("anchor") == F.col("h")).select("tid", F.struct("anchor", "first", "count", "hot").alias("run"))
    found = found.groupBy("tid").agg(F.collect_list("run").alias("runs"))
    found = stored(found.join(texts.select(F.col("tid").alias("t"), F.col("sha").alias("s"), "carrier"), F.col("tid") == F.col("t")).drop("t"), "found")
    hits = keyed.join(found, (F.col("sha") == F.col("s")) & F.col("doc_id").eqNullSafe(F.col("carrier")))
    hits = stored(hits.select("tid", "text", "runs"), "hits")
    discard(whole, again, found)

    cut = stored(hits.mapInArrow(_cut_rows(lengths), "tid long, anchor long, first long, size long, piece binary, h1 array<long>, h2 array<long>"), "runs")
    pieces = cut.where("piece is not null").select("tid", "anchor", "first", "size", "piece")
    total = pieces.agg(F.sum(F.octet_length("piece")).alias("n")).first()["n"] or 0
    packed = pieces.withColumn("pack", F.pmod(F.xxhash64("anchor"), F.lit(max(1, -(-total // pack_bytes)))))
    ranges = packed.groupBy("pack").applyInPandas(_merge_pack(lengths, step), "tid long, size long, a long, b long")
    strings = cut.where("piece is null").select("tid", "size", "first", F.posexplode(F.arrays_zip("h1", "h2")).alias("i", "h"))
    strings = strings.select("tid", "size", (F.col("first") + F.col("i")).alias("a"), "h.h1", "h.h2")
    several = strings.groupBy(F.col("size").alias("g"), F.col("h1").alias("g1"), F.col("h2").alias("g2")).count().where("count > 1").drop("count")
    hot = strings.join(several, (F.col("size") == F.col("g")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).select("tid", "size", "a", (F.col("a") + F.col("size")).alias("b"))
    if cut.where("piece is null").limit(1).count():
        ranges = ranges.unionByName(hot)
    each = stored(ranges, "ranges")
    ranges = each.groupBy("tid").agg(F.collect_list(F.struct("size", "a", "b")).alias("ranges"))
    once = texts.where("copies = 1").select(F.col("tid").alias("t"))
    ranges = stored(ranges.join(once, F.col("tid") == F.col("t")).drop("t"), "text-ranges")
    discard(cut, each)
    return texts, hits, ranges


def _gone(ranges: list[dict], size: int, n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, [r["a"] for r in ranges if r["size"] == size], 1)
    np.add.at(change, [r["b"] for r in ranges if r["size"] == size], -1)
    return np.cumsum(change)[:n] > 0


def _strip_rows(length: int, passage: int):
    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["tid", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", "rest"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            tids, all_ranges = batch.column("tid"), batch.column("ranges")
            for block in blocks(batch.column("text")):
                out = []
                for row in range(block.rows):
                    data = block.data[block.offsets[row] : block.offsets[row + 1]]
                    ranges = all_ranges[block.first_row + row].as_py()
                    gone, out_of_rest = (_gone(ranges, size, len(data)) for size in (length, passage))
                    digest, rest = hashlib.sha256(data[~gone].tobytes()).hexdigest(), data[~out_of_rest].tobytes().decode("utf-8", "ignore")
                    out.append((tids[block.first_row + row].as_py(), int(gone.sum()), len(_intervals(gone)[0]), digest, int(out_of_rest.sum()), rest))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return strip


def _results(docs: DataFrame, length: int, passage: int | None, **options) -> DataFrame:
    """The result of each distinct text by its hash ``s``; ``rest`` is null where nothing goes."""
    passage = passage or length
    texts, hits, ranges = removed_ranges(docs, tuple(sorted({length, passage})), **options)
    covered = hits.join(ranges.withColumnRenamed("tid", "t"), F.col("tid") == F.col("t")).select("tid", "text", "ranges")
    stripped = covered.mapInArrow(_strip_rows(length, passage), "tid long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, rest string")
    stripped = stored(stripped.dropDuplicates(["tid"]).withColumnRenamed("tid", "t"), "stripped")

    def whole(size: int) -> Column:
        return (F.col("copies") > 1) & (F.col("n_bytes") >= size)

    def count(size: int, column: str, all_of_it: Column) -> Column:
        return F.when(whole(size), all_of_it).otherwise(F.coalesce(column, F.lit(0))).cast("long").alias(column)

    result = texts.join(stripped, F.col("tid") == F.col("t"), "left").select(
        F.col("sha").alias("s"),
        "n_bytes",
        count(length, "n_removed", F.col("n_bytes")),
        count(length, "n_spans", F.lit(1)),
        F.when(whole(length), F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        count(passage, "n_passage_bytes", F.col("n_bytes")),
        F.when(whole(passage), F.lit("")).otherwise(F.col("rest")).alias("rest"),
    )
    result = stored(result, "suffix-result")
    discard(texts, hits, ranges, stripped)
    return result


def dedup(docs: DataFrame, length: int = LENGTH, passage: int | None = None, **options) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, text``, a row for each document.

    The first five are by strings of ``length`` bytes. ``text`` is what is left
    without repeated strings of ``passage`` bytes (``length`` unless named), which
    take ``n_passage_bytes``; bytes of a cut character are dropped from ``text``,
    not from ``kept_sha256``. A null text is an empty one. Documents alike in text
    lose all of it if it has that many bytes, and nothing for their being alike
    otherwise. Very long texts are read whole. Ids may be null or repeated;
    other columns are ignored; an empty table gives an empty result.
    """
    result = _results(docs, length, passage, **options)
    slim = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    joined = slim.join(result, F.col("sha") == F.col("s"))
    # A text of which nothing goes is taken as it is, also where ``rest`` would drop no character.
    text = F.when(F.col("n_passage_bytes") > 0, F.col("rest")).otherwise(F.col("text"))
    return joined.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes", text.alias("text"))


def stripped_documents(docs: DataFrame, length: int = LENGTH, **options) -> DataFrame:
    """``docs`` with the repeated bytes cut from ``text`` (and ``n_chars`` counted anew, where it is a column)."""
    changed = _results(docs, length, None, **options).where("n_removed > 0").select(F.col("s").alias("__sha"), F.col("rest").alias("__rest"))
    joined = docs.join(changed, F.sha2("text", 256) == F.col("__sha"), "left")
    text = F.when(F.col("__sha").isNotNull(), F.col("__rest")).otherwise(F.col("text"))
    columns = [text.alias(c) if c == "text" else F.when(F.col("__sha").isNotNull(), F.length("__rest").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*columns)
