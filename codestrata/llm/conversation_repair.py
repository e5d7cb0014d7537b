"""Repair of damaged conversations at least cost: a shortest path over rows and dialogue states.

A conversation is a path over nodes (row, state): keeping, changing the role of,
deleting and inserting rows are arcs of small integer cost. Distances to the goal
come from Dial's bucket queue, whose buckets are as many as the largest cost plus
one; the audit then walks tight arcs, the letter that sorts first at each node.

Rows are sorted by ranges of (conversation, turn, ...), not gathered by
conversation, and cut into blocks, so a conversation of any length is spread over
tasks. The blocks of a long one are tied together by what they do to the four
states: distances through a block (a min-plus matrix), then, once the distances
behind it are known, the state in which a walk leaves it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, stored

#: Rows and bytes of text of a block (more bytes only for one longer text), and rows of the blocks that are solved together.
BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
BUCKETS = 4
FAR = 1 << 40
#: States: nothing yet, after the system's turn, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after a user or assistant turn that is put in where the dialogue stands.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: What is left to insert in each state once all rows are used: the pairs must be whole.
GOAL = np.array([0, 2 * INSERT, INSERT, 0])
BLANK, DUPLICATE, CUT_OFF = 1, 2, 3
_SHOWN = r"[^\x20\x09-\x0D]"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, gone``: the rows with the damage that the hash of ``conv_id:turn`` deals them.

    Nulls of role and text, and of the key's parts, count as one space. ``gone``
    marks dropped rows, so that conversations of which nothing is left are told.
    """
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.pmod(F.crc32(F.encode(key, "utf-8")), F.lit(20)).alias("kind"))
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn (nulls first), dealt by ranges; rows of one turn follow by role and text.

    Texts compare by their first 64 characters, then by a hash, so that sampled
    range bounds stay short; rows alike in all are spread by a salt.
    """
    keyed = rows.withColumns({"__head": F.substring("text", 1, 64), "__hash": F.xxhash64("text"), "__salt": F.xxhash64(F.monotonically_increasing_id())})
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("__head"), F.asc("__hash")]
    return keyed.repartitionByRange(*order, F.asc("__salt")).sortWithinPartitions(*order)


_BLOCK = "conv_id long, part long, at long, n long, turn_lo long, turn_hi long, turns long, first long, last long, head string, tail string, illegal long, initials binary, faults binary, keys array<binary>, roles array<string>, texts array<string>"
_SINGLE = ("su", "ua", "au")
_ARROW = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _map(rows: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with pandas frames whose whole numbers stay exact beside nulls."""
    fields = [x.split() for x in schema.split(", ")]
    types = pa.schema([(n, pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t]) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in function(b.to_pandas(integer_object_nulls=True) for b in batches):
            yield pa.RecordBatch.from_pandas(frame, types, preserve_index=False)

    return rows.mapInArrow(run, schema)


def _packer(block_rows: int):
    """Sorted rows into blocks of one conversation; a block goes on over batches and ends with the task."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        return _pack(batches, TaskContext.get().partitionId(), block_rows)

    return pack


def _pack(batches: Iterator[pd.DataFrame], part: int, block_rows: int) -> Iterator[pd.DataFrame]:
    conversation, rows, size, at = None, [], 0, 0

    def block() -> dict:
        left = [r for r in rows if not r[3]]
        known = [r[0] for r in left if r[0] is not None]
        initials = "".join((r[1] or " ")[0] if ord((r[1] or " ")[0]) < 128 else "?" for r in left)
        seen: set[bytes] = set()
        faults, keys = bytearray(), []
        for _, role, text, _ in left:
            shown = text.strip(" \t\n\x0b\x0c\r")
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            faults.append(BLANK if not shown else DUPLICATE if key in seen else CUT_OFF if shown[-1] not in ".!?" else 0)
            seen.add(key)
            keys.append(key)
        pairs = sum(initials[i : i + 2] not in _SINGLE for i in range(len(left) - 1))
        return {
            "conv_id": conversation[0], "part": part, "at": at, "n": len(left), "turn_lo": min(known, default=None), "turn_hi": max(known, default=None), "turns": len(set(known)),
            "first": known[0] if known else None, "last": known[-1] if known else None, "head": initials[:1], "tail": initials[-1:], "illegal": pairs,
            "initials": initials.encode(), "faults": bytes(faults), "keys": keys, "roles": [r[1] for r in left], "texts": [r[2] for r in left],
        }

    for frame in batches:
        out = []
        for conv, turn, role, text, gone in frame[["conv_id", "turn", "role", "text", "gone"]].itertuples(index=False, name=None):
            if conversation is not None and (conversation[0] != conv or len(rows) >= block_rows or size >= BLOCK_BYTES):
                out.append(block())
                at, rows, size = at + 1, [], 0
            conversation = (conv,)
            rows.append((turn, role, text, gone))
            size += len(text)
        if out:
            yield pd.DataFrame(out)
    if rows:
        yield pd.DataFrame([block()])


class Graph:
    """The nodes of several blocks: four for each row and four behind the last row of a block."""

    def __init__(self, initials: list[bytes], faults: list[bytes]):
        self.size = np.array([len(x) for x in initials], np.int64)
        layers = self.size + 1
        self.first = np.cumsum(layers) - layers
        self.end = self.first + self.size
        n = int(layers.sum())
        self.row = np.ones(n, bool)  # layers that have a row behind them
        self.row[self.end] = False
        letters, kinds = (np.frombuffer(b"".join(x), np.uint8) for x in (initials, faults))
        self.letter, self.fault = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        self.letter[self.row], self.fault[self.row] = letters, kinds
        self.must = (self.fault == BLANK) | (self.fault == DUPLICATE)
        self.more = np.where(self.fault == CUT_OFF, TRUNCATED, 0)
        #: The state after keeping the row of a layer in each state, or -1.
        self.kept = np.full((n, 4), -1, np.int64)
        usable = self.row & ~self.must
        self.kept[usable & (self.letter == ord("s")), START] = SYSTEM
        for state in (START, SYSTEM, ASSISTANT):
            self.kept[usable & (self.letter == ord("u")), state] = USER
        self.kept[usable & (self.letter == ord("a")), USER] = ASSISTANT

    def distances(self, behind: np.ndarray) -> np.ndarray:
        """Least cost from each node to the goal, given that from the nodes behind each block.

        Dial's queue: bucket ``d % BUCKETS`` holds the nodes reached at cost ``d``;
        arcs are followed backwards. Blocks share no arcs and run side by side.
        Nothing is inserted behind the last row of a block: ``behind`` has that.
        """
        base = behind.min(1, keepdims=True)
        best = np.full((len(self.row), 4), FAR, np.int64)
        queue: list[list[np.ndarray]] = [[] for _ in range(BUCKETS)]
        wait: dict[int, list[np.ndarray]] = {}
        relative = np.where(behind < FAR, behind - base, FAR)
        for cost in np.unique(relative[relative < FAR]):
            block, state = np.nonzero(relative == cost)
            wait[int(cost)] = [self.end[block] * 4 + state]
        flat = best.reshape(-1)
        closed = np.zeros(flat.shape, bool)
        open_layers = self.row.copy()
        d = 0
        while wait or any(queue):
            for nodes in wait.pop(d, []):
                nodes = nodes[flat[nodes] > d]
                flat[nodes] = d
                queue[d % BUCKETS].append(nodes)
            while queue[d % BUCKETS]:
                nodes = np.unique(np.concatenate(queue[d % BUCKETS]))
                queue[d % BUCKETS] = []
                nodes = nodes[(flat[nodes] == d) & ~closed[nodes]]
                closed[nodes] = True
                for source, cost in self._into(nodes, open_layers):
                    better = flat[source] > d + cost
                    source, cost = source[better], cost[better]
                    np.minimum.at(flat, source, d + cost)
                    for c in np.unique(cost):
                        queue[(d + int(c)) % BUCKETS].append(source[cost == c])
            d += 1
        layer_base = np.repeat(base[:, 0], self.size + 1)
        return np.where(best < FAR, best + layer_base[:, None], FAR)

    def _into(self, nodes: np.ndarray, may_insert: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Nodes from which an arc leads to ``nodes``, and its cost."""
        layer, state = nodes // 4, nodes % 4
        for source in range(4):
            at = layer[(NEXT[source] == state) & may_insert[layer]]
            yield at * 4 + source, np.full(len(at), INSERT)
        before = layer - 1
        real = (before >= 0) & self.row[before]
        before, state = before[real], state[real]
        yield before * 4 + state, np.full(len(before), DELETE)
        for source in range(4):
            kept = before[self.kept[before, source] == state]
            yield kept * 4 + source, KEEP + self.more[kept]
            changed = before[(NEXT[source] == state) & ~self.must[before]]
            yield changed * 4 + source, REROLE + self.more[changed]

    def walk(self, best: np.ndarray, entry: np.ndarray, final: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        """The audit of each block from its entry state, the first letter among tight arcs, and the state in which it ends.

        Blocks that end their conversation (``final``) insert behind their last row
        until the goal is reached.
        """
        at, state = self.first.copy(), entry.copy()
        letters: list[list[int]] = [[] for _ in entry]
        active = np.arange(len(entry))
        while len(active):
            layer, s = at[active], state[active]
            here = best[layer, s]
            row = self.row[layer]
            after = np.minimum(layer + 1, len(self.row) - 1)
            keep_to = self.kept[layer, s]
            drop = row & (here == best[after, s] + DELETE)
            put = (row & (here == best[layer, NEXT[s]] + INSERT)) | (~row & final[active] & (GOAL[s] > 0))
            keep = row & (keep_to >= 0) & (here == best[after, np.maximum(keep_to, 0)] + KEEP + self.more[layer])
            change = row & ~self.must[layer] & (here == best[after, NEXT[s]] + REROLE + self.more[layer])
            letter = np.select([drop, put, keep, change], [68, 73, 75, 82], 0)  # D I K R
            at[active] = np.where(np.isin(letter, (68, 75, 82)), layer + 1, layer)
            state[active] = np.select([letter == 75, (letter == 73) | (letter == 82)], [keep_to, NEXT[s]], s)
            for i, x in zip(active[letter > 0], letter[letter > 0], strict=True):
                letters[i].append(int(x))
            active = active[letter > 0]
        return [bytes(x) for x in letters], state


def _graph(frame: pd.DataFrame) -> Graph:
    return Graph(list(frame["initials"]), list(frame["faults"]))


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Least cost through each block from every state to every state."""
    for frame in batches:
        graph = _graph(frame)
        out = np.empty((len(frame), 4, 4), np.int64)
        for state in range(4):
            behind = np.full((len(frame), 4), FAR)
            behind[:, state] = 0
            out[:, :, state] = graph.distances(behind)[graph.first]
        yield pd.DataFrame({"part": frame["part"], "at": frame["at"], "through": list(out.reshape(-1, 16))})


def _behind(frame: pd.DataFrame) -> pd.DataFrame:
    """Distances behind each block of one conversation, from the last block to the first."""
    frame = frame.sort_values(["part", "at"], ascending=False)
    now, out = GOAL.copy(), []
    for through in frame["through"]:
        out.append(now)
        now = np.minimum(np.min(np.asarray(through).reshape(4, 4) + now[None, :], axis=1), FAR)
    return pd.DataFrame({"part": frame["part"], "at": frame["at"], "behind": out})


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in which the walk leaves each block, for every state in which it can come."""
    for frame in batches:
        graph = _graph(frame)
        best = graph.distances(np.stack([np.asarray(x) for x in frame["behind"]]))
        none = np.zeros(len(frame), bool)
        ends = [graph.walk(best, np.full(len(frame), s), none)[1] for s in range(4)]
        yield pd.DataFrame({"part": frame["part"], "at": frame["at"], "leaves": list(np.stack(ends, 1))})


def _entries(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values(["part", "at"])
    state, out = START, []
    for leaves in frame["leaves"]:
        out.append(state)
        state = int(leaves[state])
    final = np.arange(len(frame)) == len(frame) - 1
    return pd.DataFrame({"part": frame["part"], "at": frame["at"], "entry": out, "final": final})


def _repaired(audit: bytes, entry: int, roles, texts) -> list[str]:
    """The ``role:text`` lines that an audit makes of a block's rows."""
    lines, i, state = [], 0, entry
    names = {USER: "user", ASSISTANT: "assistant"}
    for letter in audit:
        if letter == 75:
            lines.append(f"{roles[i]}:{texts[i]}")
            state = SYSTEM if state == START and roles[i][:1] == "s" else NEXT[state]
        elif letter in (73, 82):
            state = int(NEXT[state])
            lines.append(f"{names[state]}:{texts[i] if letter == 82 else ''}")
        i += letter != 73
    return lines


_SOLVED = "conv_id long, part long, at long, n long, audit string, cost long, blank long, duplicate long, truncated long, turn_lo long, turn_hi long, turns long, first long, last long, head string, tail string, illegal long, lines array<string>"


def _solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Audit, cost and repaired lines of blocks whose entry and what lies behind them are known."""
    for frame in batches:
        frame = frame.reset_index(drop=True)
        graph = _graph(frame)
        behind = np.stack([np.asarray(x) for x in frame["behind"]])
        entry, final = frame["entry"].to_numpy(np.int64), frame["final"].to_numpy(bool)
        best = graph.distances(behind)
        audits, leaves = graph.walk(best, entry, final)
        # No row, no edit: a block of dropped rows alone.
        cost = best[graph.first, entry] - np.where(final, 0, behind[np.arange(len(frame)), leaves])
        kinds = [np.frombuffer(x, np.uint8) for x in frame["faults"]]
        out = frame[["conv_id", "part", "at", "n", "turn_lo", "turn_hi", "turns", "first", "last", "head", "tail", "illegal"]].copy()
        out["audit"], out["cost"] = [a.decode() for a in audits], cost
        for name, kind in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", CUT_OFF)):
            out[name] = [int((k == kind).sum()) for k in kinds]
        out["lines"] = [_repaired(a, e, r, t) for a, e, r, t in zip(audits, entry, frame["roles"], frame["texts"], strict=True)]
        yield out[[c.split()[0] for c in _SOLVED.split(", ")]]


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each conversation whose blocks come sorted: one running hash, whatever its length."""
    now, state, empty = None, None, True
    for frame in batches:
        out = []
        for conv, lines in zip(frame["conv_id"], frame["lines"], strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append((now[0], state.hexdigest()))
                now, state, empty = (conv,), hashlib.sha256(), True
            if len(lines):
                state.update(("" if empty else "\n").encode() + "\n".join(lines).encode("utf-8", "surrogatepass"))
                empty = False
        if out:
            yield pd.DataFrame(out, columns=["conv_id", "sha"])
    if now is not None:
        yield pd.DataFrame([(now[0], state.hexdigest())], columns=["conv_id", "sha"])


def solved_blocks(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Stored solved blocks, in order of ``(part, at)`` within a conversation, and the ids of conversations of several blocks."""
    kinds = {"through": "array<long>", "behind": "array<long>", "leaves": "array<long>"}
    place = "part long, at long"
    blocks = stored(_map(_ordered(damaged(conversations)).select("conv_id", "turn", "role", "text", "gone"), _packer(block_rows), _BLOCK), "conversation-blocks")
    many = stored(blocks.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("many")), "long-conversations")
    same = F.col("conv_id").eqNullSafe(F.col("many"))
    whole = blocks.join(many, same, "left_anti").withColumns({"behind": F.array(*[F.lit(int(x)).cast("long") for x in GOAL]), "entry": F.lit(START).cast("long"), "final": F.lit(True)})

    # Rows said in an earlier block of the conversation: the first block of each, then all later ones.
    long = blocks.join(many, same, "left_semi")
    said = long.select("conv_id", "part", "at", F.explode(F.array_distinct("keys")).alias("key"))
    order = F.struct("part", "at")
    first = said.groupBy(F.col("conv_id").alias("c"), F.col("key").alias("k")).agg(F.min(order).alias("least"))
    again = said.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k"))).where(order != F.col("least"))
    again = stored(again.groupBy(F.col("part").alias("p"), F.col("at").alias("i")).agg(F.collect_list("key").alias("old")), "said-before")
    marked = long.join(again, (F.col("part") == F.col("p")) & (F.col("at") == F.col("i")), "left").drop("p", "i")
    long = stored(_map(marked, _mark_old, _BLOCK), "long-blocks")

    shape = long.select("conv_id", "part", "at", "initials", "faults")
    costs = stored(_map(shape, _matrices, f"{place}, through {kinds['through']}"), "block-costs")
    ids = long.select("conv_id", F.col("part").alias("p"), F.col("at").alias("i"))
    of_block = (F.col("part") == F.col("p")) & (F.col("at") == F.col("i"))
    behind = stored(ids.join(costs, of_block).select("conv_id", "part", "at", "through").groupBy("conv_id").applyInPandas(_behind, f"{place}, behind {kinds['behind']}"), "block-goals")
    known = shape.join(behind.toDF("p", "i", "behind"), of_block).drop("p", "i")
    exits = stored(_map(known, _exits, f"{place}, leaves {kinds['leaves']}"), "block-exits")
    entries = stored(ids.join(exits, of_block).select("conv_id", "part", "at", "leaves").groupBy("conv_id").applyInPandas(_entries, f"{place}, entry long, final boolean"), "block-entries")
    ready = long.join(behind.toDF("p", "i", "behind"), of_block).drop("p", "i").join(entries.toDF("p", "i", "entry", "final"), of_block).drop("p", "i")
    out = stored(_map(whole.unionByName(ready), _solve, _SOLVED), "solved-blocks")
    discard(blocks, again, long, costs, behind, exits, entries)
    return out, many


def _mark_old(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        faults = []
        for kinds, keys, old in zip(frame["faults"], frame["keys"], frame["old"], strict=True):
            seen = set() if old is None else {bytes(x) for x in old}
            faults.append(bytes(DUPLICATE if f != BLANK and bytes(k) in seen else f for f, k in zip(kinds, keys, strict=True)))
        yield frame.drop(columns="old").assign(faults=faults)


def repair(conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation: what is damaged, the cheapest edits and the hash of the repaired text.

    ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``. The rows are first damaged as the hash of their key says.
    Rows of one turn follow by role, then by the first 64 characters of the text,
    then by its hash; repeated rows are duplicates. A null ``conv_id`` is one
    conversation; a null turn comes first; null roles and texts are one space. A
    conversation of which no row is left has zeros, an empty audit and the hash
    of the empty string. Very long texts and conversations are taken whole, the
    latter in blocks; only the hash and the audit of one conversation, each one
    value, are put together in one task, as a stream of sorted blocks. Other
    columns are ignored; an empty table gives an empty result.
    """
    solved, many = solved_blocks(conversations, block_rows)
    same = F.col("conv_id").eqNullSafe(F.col("many"))
    numbers = ["n", "cost", "blank", "duplicate", "truncated", "turn_lo", "turn_hi", "turns", "illegal"]
    none = F.sha2(F.lit(""), 256)
    short = solved.join(many, same, "left_anti")
    text = F.when(F.size("lines") > 0, F.sha2(F.array_join("lines", "\n"), 256)).otherwise(none)
    short = short.select("conv_id", *numbers, F.lit(0).alias("seams"), F.lit(0).alias("twice"), "audit", text.alias("sha"))

    long = solved.join(many, same, "left_semi")
    # Blocks without rows say nothing on what lies side by side.
    turn = Window.partitionBy("conv_id").orderBy("part", "at")
    pieces = long.select("conv_id", "part", "at", "audit", *numbers, "head", "tail", "first", "last")
    full = pieces.where("n > 0").withColumns({"__tail": F.lag("tail").over(turn), "__last": F.last("last", True).over(turn.rowsBetween(Window.unboundedPreceding, -1))})
    seam = F.when(F.col("__tail").isNotNull() & ~F.concat("__tail", "head").isin(*_SINGLE), 1).otherwise(0)
    full = full.unionByName(pieces.where("n = 0"), allowMissingColumns=True)
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "at", "audit"))), lambda x: x["audit"]), "")
    sums = [F.sum(c).alias(c) for c in ("n", "cost", "blank", "duplicate", "truncated")]
    whole = full.groupBy("conv_id").agg(*sums, F.min("turn_lo").alias("turn_lo"), F.max("turn_hi").alias("turn_hi"), F.sum("turns").alias("turns"), F.sum("illegal").alias("illegal"), F.sum(seam).alias("seams"), F.count(F.when(F.col("__last") == F.col("first"), 1)).alias("twice"), joined.alias("audit"))
    lines = long.select("conv_id", "part", "at", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "part", "at")
    hashes = _map(lines.select("conv_id", "lines"), _hashed, "conv_id long, sha string")
    whole = whole.join(hashes.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    both = short.unionByName(whole.select(short.columns))
    gaps = F.coalesce(F.col("turn_hi") - F.col("turn_lo") + 1 - (F.col("turns") - F.col("twice")), F.lit(0))
    longs = [F.col(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    return both.select("conv_id", gaps.cast("long").alias("gaps"), *longs, (F.col("illegal") + F.col("seams")).cast("long").alias("illegal"), F.col("cost").cast("long").alias("cost"), "audit", F.col("sha").alias("repaired_sha256"))
