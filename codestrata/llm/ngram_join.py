"""N-gram Jaccard join of documents over a token-group matrix.

Sets of distinct word shingles link when their Jaccard similarity reaches a
threshold. Sets that are equal become one class. Similar classes are put into
small groups by minimum hash, and the matrix holds, for each group, the union of
its members' rare tokens (token, group). Groups are opened to each other only if
their unions share enough tokens: two sets that link share at least ``need`` of
their ``n - ceil(t * n) + need`` rarest tokens, so no link is lost. Rarity is read
from a fixed-size sketch that counts all tokens of all texts. The members of the
smaller of two open groups go to the larger one, which meets all its guests at
once: tokens counted by ``SLOTS`` hash slots bound every overlap from above, and
only sets that pass are read again and intersected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, stored
from .text_arrays import Block, blocks, grouped_lists, mix

#: Words of a shingle, unless the caller names another number.
WORDS = 3
SKETCH_BITS = 17
#: Shared rare tokens that open a group.
NEED = 4
GROUP_ROWS = 1024
#: Members of other groups that one group meets in one block.
GUESTS = 4096
#: A group's sets hold about so many tokens at most, and the sets of one call.
PART_TOKENS = 1 << 19
CALL_TOKENS = 1 << 20
SLOTS = 64
#: Up to so many keys of sets to read again are broadcast (16 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 400_000


def shingle_sets(block: Block, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words make one shingle, none an empty set."""
    start, end, owner = block.words()
    value = block.span_hashes(block.prefix_sums(fold_case=True), start, end)
    bounds = np.searchsorted(owner, np.arange(block.rows + 1), "left")
    keys = mix(np.arange(11, 11 + words, dtype=np.uint64))
    joined = np.zeros(max(len(value) - words + 1, 0), np.uint64)
    for k in range(words):
        joined += value[k : k + len(joined)] * keys[k]
    joined = mix(joined)
    sets = []
    for first, last in zip(bounds[:-1], bounds[1:], strict=True):
        n = last - first
        if n >= words:
            one = np.sort(joined[first : last - words + 1])
            one = one[np.r_[True, one[1:] != one[:-1]]]
        elif n:
            one = mix((value[first:last] * keys[:n]).sum(keepdims=True) + np.uint64(n))
        else:
            one = joined[:0]
        sets.append(one)
    return sets


def _sketch_rows(bits: int, words: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for block in blocks(batch.column("text")):
                for one in shingle_sets(block, words):
                    np.add.at(total, (one >> np.uint64(64 - bits)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["bucket", "n"])

    return count


def token_sketch(docs: DataFrame, bits: int = SKETCH_BITS, words: int = WORDS) -> np.ndarray:
    """Documents per token bucket, over all documents; ``2 ** bits`` counts reach the driver whatever the input."""
    rows = docs.select("text").mapInArrow(_sketch_rows(bits, words), "bucket int, n long")
    out = np.zeros(1 << bits, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r["bucket"]] = r["n"]
    return out


def _profile_rows(sketch, bits: int, num: int, den: int, need: int, words: int):
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = np.minimum(sketch.value, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)
        for batch in batches:
            for block in blocks(batch.column("text")):
                n, s1, s2, slots, prefix = [], [], [], [], []
                for one in shingle_sets(block, words):
                    n.append(len(one))
                    slots.append(np.minimum(np.bincount((one & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS), 65_535).astype(np.uint16).tobytes())
                    if not len(one):
                        s1.append(0), s2.append(0), prefix.append(one)
                        continue
                    sign = np.frombuffer(hashlib.blake2b(one.tobytes(), digest_size=16).digest(), np.int64)
                    s1.append(sign[0]), s2.append(sign[1])
                    least = -(-num * len(one) // den)
                    size = len(one) - least + min(need, least)
                    order = rarity[(one >> np.uint64(64 - bits)).astype(np.int64)] | (one >> np.uint64(24))
                    prefix.append(one[np.argsort(order, kind="stable")[:size]])
                owner = np.repeat(np.arange(len(prefix)), [len(p) for p in prefix])
                tokens = np.concatenate(prefix).view(np.int64) if prefix else np.zeros(0, np.int64)
                numbers = [pa.array(np.array(x, np.int64)) for x in (n, s1, s2)]
                doc, key = (batch.column(c).slice(block.first_row, block.rows) for c in ("doc_id", "tkey"))
                data = [doc, key, *numbers, pa.array(slots, pa.binary()), grouped_lists(tokens, owner, len(prefix))]
                yield pa.RecordBatch.from_arrays(data, ["doc_id", "tkey", "n", "s1", "s2", "slots", "prefix"])

    return profile


def _set_rows(words: int):
    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column("text")):
                sets = shingle_sets(block, words)
                owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
                tokens = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("cls").slice(block.first_row, block.rows), grouped_lists(tokens, owner, len(sets))], ["cls", "tokens"])

    return sets_of


def overlaps(asked: list[np.ndarray], held: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """Size of the intersection of each of ``asked`` with each of ``held``, two bounded groups of sets."""
    sets = [*asked, *held]
    tokens = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    place = np.cumsum(np.r_[True, tokens[1:] != tokens[:-1]]) - 1
    several = np.bincount(place) > 1
    keep = several[place]
    column, owner = (np.cumsum(several) - 1)[place[keep]], owner[keep]
    out = np.zeros((len(asked), len(held)), np.float32)
    for first in range(0, int(several.sum()), width):
        lo, hi = np.searchsorted(column, [first, first + width])
        part = np.zeros((len(sets), width), np.float32)
        part[owner[lo:hi], column[lo:hi] - first] = 1
        out += part[: len(asked)] @ part[len(asked) :].T
    return out


def local_roots(near: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a symmetric link matrix reaches."""
    label = np.arange(len(near))
    while True:
        low = np.minimum(label, np.where(near, label[None, :], len(near)).min(1, initial=len(near)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _linked_roots(near: np.ndarray, asked: np.ndarray, held: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes ``0..n-1`` that each one reaches, if ``asked[i]`` and ``held[j]`` link where ``near[i, j]``."""
    label = np.arange(n, dtype=np.int32)
    while True:
        low = label.copy()
        np.minimum.at(low, asked, np.where(near, label[held][None, :], np.int32(n)).min(1))
        np.minimum.at(low, held, np.where(near, label[asked][:, None], np.int32(n)).min(0))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _parts_of(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    """The parts of a call, and the rows of each that ask and that are held: all rows, where none comes from another group."""
    frame = frame.sort_values(["part", "cls"], ignore_index=True)
    part = frame["part"].to_numpy()
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for first, last in zip(cuts[:-1], cuts[1:], strict=True):
        guest = frame["guest"].to_numpy()[first:last]
        held, asked = np.flatnonzero(~guest), np.flatnonzero(guest)
        if not len(asked):
            asked = held
        if last - first > 1 and len(held):
            yield frame.iloc[first:last], asked, held


def _linker(num: int, den: int):
    def link(frame: pd.DataFrame) -> pd.DataFrame:
        nodes, roots = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for part, asked, held in _parts_of(frame):
            sets = [np.asarray(x, np.int64) for x in part["tokens"]]
            size = np.array([len(s) for s in sets], float)
            both = overlaps([sets[i] for i in asked], [sets[i] for i in held])
            near = den * both >= num * (size[asked][:, None] + size[held][None, :] - both)
            ids, place = np.unique(part["cls"].to_numpy(), return_inverse=True)
            root = _linked_roots(near, place[asked], place[held], len(ids))
            moved = root != np.arange(len(ids))
            nodes.append(ids[moved]), roots.append(ids[root[moved]])
        return pd.DataFrame({"a": np.concatenate(nodes), "b": np.concatenate(roots)})

    return link


def _bounder(num: int, den: int):
    def bound(frame: pd.DataFrame) -> pd.DataFrame:
        out = [frame[["part", "cls", "guest", "n"]].iloc[:0]]
        for part, asked, held in _parts_of(frame):
            counts = np.stack([np.frombuffer(x, np.uint16) for x in part["slots"]]).astype(np.int32)
            size, comp = part["n"].to_numpy(), part["comp"].to_numpy()
            passed = np.zeros(len(part), bool)
            for i in asked:
                # The sets differ in as many tokens at least as their slot counts do.
                apart = np.abs(counts[held] - counts[i]).sum(1)
                may = ((den + num) * apart <= (den - num) * (size[held] + size[i])) & (comp[held] != comp[i])
                passed[held[may]] = True
                passed[i] |= may.any()
            out.append(part.loc[passed, ["part", "cls", "guest", "n"]])
        return pd.concat(out)

    return bound


def _by_call(rows: DataFrame, per_call: int, weight: str | None = None) -> DataFrame:
    """``rows`` with ``call``: several bounded parts that go through one call, of about ``per_call`` rows or of that sum of ``weight``."""
    total = rows.agg(F.sum(weight) if weight else F.count("*")).first()[0] or 0
    return rows.withColumn("call", F.pmod(F.xxhash64("part"), F.lit(max(1, total // per_call))))


def _linked(rows: DataFrame, active: DataFrame, texts: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """Edges between components in each bounded part of ``rows (part, c, comp, guest)``: bound all pairs, then intersect the sets that pass."""
    bounds = stored(rows.join(active, F.col("c") == F.col("cls")).select("part", "cls", "comp", "guest", "n", "slots"), "bounds")
    bounded = _by_call(bounds, 4000)
    passed = stored(bounded.groupBy("call").applyInPandas(_bounder(num, den), "part long, cls long, guest boolean, n long"), "passed")
    keys = stored(active.join(passed.select(F.col("cls").alias("p")).distinct(), F.col("cls") == F.col("p")).select("cls", "carrier.*"), "keys")
    side = keys.select("cls", F.col("tkey").alias("k"), F.col("doc_id").alias("d"))
    side = F.broadcast(side) if keys.count() <= BROADCAST_KEYS else side
    read = texts.join(side, (F.col("tkey") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("cls", "text")
    sets = stored(read.mapInArrow(_set_rows(words), "cls long, tokens array<long>").dropDuplicates(["cls"]), "sets")
    members = _by_call(passed.withColumnRenamed("cls", "c"), CALL_TOKENS, "n")
    packed = members.join(sets, F.col("c") == F.col("cls")).select("call", "part", "cls", "guest", "tokens")
    links = stored(packed.groupBy("call").applyInPandas(_linker(num, den), "a long, b long"), "links")
    discard(bounds, passed, keys, sets)
    return links


def _parts(rows: DataFrame, by: str, key: str, size: int, seed: int) -> DataFrame:
    """``rows`` with ``part``: groups of ``by``, large ones dealt into parts of about ``size`` rows and ``PART_TOKENS`` tokens by hash of ``key``."""
    needed = F.greatest(F.ceil(F.count("*") / F.lit(size)), F.ceil(F.sum("n") / F.lit(PART_TOKENS)))
    counts = stored(rows.groupBy(F.col(by).alias("__by")).agg(needed.alias("__n")), "part-sizes")
    cut = F.pmod(F.xxhash64(key, F.lit(seed)), F.col("__n"))
    return rows.join(counts, F.col(by) == F.col("__by")).withColumn("part", F.xxhash64(by, cut)).drop("__by", "__n")


def _asked(opened: DataFrame, groups: DataFrame) -> DataFrame:
    """``part, c, comp, guest``: members of the smaller group of each opened pair as guests of the larger one.

    A group meets all its guests, however many groups they come from, in blocks
    of ``GUESTS``; its own members are repeated once a block, not once a pair.
    """
    member = groups.select(F.col("part").alias("g"), F.col("cls").alias("c"), "comp", "n")
    guests = stored(opened.join(member, F.col("guest") == F.col("g")).select("home", "c", "comp", "n"), "guests")
    needed = F.greatest(F.ceil(F.count("*") / F.lit(GUESTS)), F.ceil(F.sum("n") / F.lit(CALL_TOKENS)))
    homes = stored(guests.groupBy(F.col("home").alias("h")).agg(needed.alias("k")), "homes")
    asking = guests.join(homes, F.col("home") == F.col("h")).select(F.xxhash64("home", F.pmod(F.xxhash64("c"), F.col("k"))).alias("part"), "c", "comp", F.lit(True).alias("guest"))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))
    home = member.join(homes, F.col("g") == F.col("h")).select("g", "c", "comp", block.alias("i"))
    return asking.unionByName(home.select(F.xxhash64("g", "i").alias("part"), "c", "comp", F.lit(False).alias("guest")))


def jaccard_components(docs: DataFrame, *, words: int = WORDS, num: int = 90, den: int = 100, need: int = NEED, group_rows: int = GROUP_ROWS, bits: int = SKETCH_BITS) -> DataFrame:
    """``doc_id, tkey, n_shingles, component_id, comp``, a row for each document.

    Sets of shingles of ``words`` words link at a Jaccard similarity of ``num / den``.
    A document without words (empty or null text) has an empty set and links
    with nothing. ``component_id`` is the smallest ``doc_id`` that is reachable;
    null ids take part as documents, and a component of only null ids has a null
    id. ``comp`` tells components apart that are not linked but share a
    ``component_id`` (null, or an id of several texts); it is null for an empty
    set. Equal sets always link. Repeated rows are equal sets. Other columns of
    ``docs`` are ignored; an empty table gives an empty result.
    """
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("tkey"))
    sketch = docs.sparkSession.sparkContext.broadcast(token_sketch(docs, bits, words))
    schema = "doc_id long, tkey long, n long, s1 long, s2 long, slots binary, prefix array<long>"
    whole = stored(texts.mapInArrow(_profile_rows(sketch, bits, num, den, need, words), schema), "profiles")
    profiles = stored(whole.drop("slots", "prefix"), "document-keys")
    firsts = [F.first(c).alias(c) for c in ("n", "slots", "prefix")]
    classes = whole.where("n > 0").groupBy("s1", "s2").agg(*firsts, F.min(F.struct("tkey", "doc_id")).alias("carrier"))
    classes = stored(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")
    class_keys = stored(classes.select("s1", "s2", "cls"), "class-keys")
    discard(whole)
    least = F.ceil(F.lit(num) * F.col("n") / F.lit(den))
    enough = F.least(F.lit(need), least)

    # Rare tokens that more than one class has; a class needs enough of them to link at all.
    rare = classes.select("cls", "n", F.explode("prefix").alias("token"))
    shared = stored(rare.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select(F.col("token").alias("t")), "shared-tokens")
    rare = stored(rare.join(shared, F.col("token") == F.col("t")).drop("t"), "rare-tokens")
    active = rare.groupBy("cls").agg(F.first("n").alias("n"), F.count("*").alias("k"), F.min("token").alias("g1"), F.max("token").alias("g2"))
    active = active.where(F.col("k") >= enough).select(F.col("cls").alias("c"), "g1", "g2")
    active = stored(active.join(classes, F.col("c") == F.col("cls")).select("cls", "n", "g1", "g2", "slots", "carrier"), "active")
    discard(shared, classes)

    # Two groupings of similar classes, verified inside bounded parts.
    grouped = [stored(_parts(active.select("cls", "n", g), g, "cls", group_rows, seed).select("part", "cls", "n"), "groups") for seed, g in enumerate(("g1", "g2"))]
    edges = None
    for parts in grouped:
        several = parts.groupBy("part").count().where("count > 1").select(F.col("part").alias("p"))
        members = parts.join(several, F.col("part") == F.col("p")).select("part", F.col("cls").alias("c"), F.col("cls").alias("comp"), F.lit(False).alias("guest"))
        found = _linked(members, active, texts, num, den, words)
        edges = found if edges is None else edges.unionByName(found)
    known = components(edges)

    # The matrix: which group has which rare token. Two groups are opened to each other if their unions share
    # enough tokens and they are not of one component already.
    groups = grouped[0].join(known, F.col("cls") == F.col("node"), "left")
    groups = stored(groups.select("part", "cls", "n", F.coalesce("component", "cls").alias("comp")), "members")
    tokens = stored(rare.select("token", F.col("cls").alias("c")).join(groups, F.col("c") == F.col("cls")).drop("c"), "member-tokens")
    mixed = tokens.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("part").alias("p_lo"), F.max("part").alias("p_hi"))
    mixed = stored(mixed.where("lo < hi and p_lo < p_hi").select(F.col("token").alias("t")), "mixed-tokens")
    members = tokens
    tokens = tokens.join(mixed, F.col("token") == F.col("t")).drop("t")
    sizes = stored(groups.groupBy(F.col("part").alias("p")).agg(F.count("*").alias("size")), "group-sizes")
    matrix = tokens.groupBy("token", "part").agg(F.min("n").alias("n"), F.max("n").alias("n_hi"), F.min("comp").alias("c_lo"), F.max("comp").alias("c_hi"))
    matrix = stored(matrix.join(sizes, F.col("part") == F.col("p")).drop("p"), "matrix")
    other = matrix.toDF("t", "group", "g_n", "g_hi", "g_lo_c", "g_hi_c", "g_size")
    fits = (F.lit(den) * F.col("g_hi") >= F.lit(num) * F.col("n")) & (F.lit(den) * F.col("n_hi") >= F.lit(num) * F.col("g_n"))
    apart = (F.col("c_lo") != F.col("g_hi_c")) | (F.col("c_hi") != F.col("g_lo_c"))
    hits = matrix.join(other, (F.col("token") == F.col("t")) & (F.col("part") < F.col("group")) & fits & apart)
    opened = hits.groupBy("part", "group").agg(F.count("*").alias("k"), F.min(F.least("n", "g_n")).alias("n"), F.first("size").alias("size"), F.first("g_size").alias("g_size"))
    larger = F.col("size") >= F.col("g_size")
    opened = opened.where(F.col("k") >= enough).select(F.when(larger, F.col("part")).otherwise(F.col("group")).alias("home"), F.when(larger, F.col("group")).otherwise(F.col("part")).alias("guest"))
    opened = stored(opened, "opened")
    discard(rare, members, mixed, matrix)
    rows = _asked(opened, groups)
    final = components(edges.unionByName(_linked(rows, active, texts, num, den, words)))

    ids = class_keys.join(final, F.col("cls") == F.col("node"), "left").select("s1", "s2", F.coalesce("component", "cls").alias("comp"))
    ids = stored(ids, "class-components")
    named = profiles.select("doc_id", "tkey", "n", F.col("s1").alias("p1"), F.col("s2").alias("p2")).where("n > 0").join(ids, (F.col("p1") == F.col("s1")) & (F.col("p2") == F.col("s2")))
    named = stored(named.select("doc_id", "tkey", "n", "comp"), "document-components")
    lowest = stored(named.groupBy(F.col("comp").alias("c")).agg(F.min("doc_id").alias("component_id")), "component-ids")
    linked = named.join(lowest, F.col("comp") == F.col("c")).select("doc_id", "tkey", F.col("n").alias("n_shingles"), "component_id", "comp")
    alone = profiles.where("n = 0").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("comp"))
    return linked.unionByName(alone)


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest ``doc_id``.

    Components are told apart by their links, not by ``component_id``, which
    several share where ids are null or repeated. Rows alike in id and text are
    one document: of those the row that comes first by its other columns stays, so
    reruns agree. Documents without words stay.
    """
    found = jaccard_components(docs, **options)
    # eqNullSafe: a component of null ids has a null id, and the least text hash stands for it.
    best = found.where("n_shingles > 0 and doc_id <=> component_id").groupBy("comp").agg(F.first("component_id").alias("__id"), F.min("tkey").alias("__best")).drop("comp")
    empty = docs.where(~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    rows = docs.withColumn("__key", F.xxhash64("text")).where(F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    kept = rows.join(best, (F.col("__key") == F.col("__best")) & F.col("doc_id").eqNullSafe(F.col("__id"))).select(*docs.columns)
    repeated = kept.groupBy(F.col("doc_id").alias("d")).count().where("count > 1").limit(1).count()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    if repeated and rest:
        kept = kept.groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("__rest")).select("doc_id", "text", "__rest.*").select(*docs.columns)
    elif repeated:
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(empty)
