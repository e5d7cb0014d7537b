"""Language-model scoring by a hashed maximum-entropy model with class-factored softmax.

P(word | history) = P(class | history) * P(slot | class, history) * P(word | slot).
The class of a word comes from its last two bytes. The ``SLOTS - 1`` most frequent
words of a class have a slot each; the others share slot 0, in which a word has its
smoothed share of all training counts. Both softmaxes run over hashed features:
the word before, the word two before (a skip), both together, and their classes;
those of the second are hashed with the class. They start at the share of each
class and slot and are trained by gradient steps: the training texts are dealt by
hash of id and text into ``rounds`` rounds of shards of about ``SHARD_TOKENS``, every shard takes
minibatch steps on its own texts in a fixed order, and the steps are averaged,
weighted by tokens. Each training text is used once, and the weights do not depend
on how the input is partitioned. The hash tables grow with the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored
from .text_arrays import Block, SortedHashes, blocks, mix

CLASSES = 16
SLOTS = 24
KINDS = 4
#: Bits of the rows of each kind of feature: those of the number of distinct tokens over 16, within these bounds.
BITS = (11, 14)
ROUNDS = 3
SHARD_TOKENS = 4_000_000
MINIBATCH = 16_384
RATE = 0.15
#: So many mentions of a row are added by n-th mention.
MENTIONS = 16
#: Exponents up to this size neither overflow nor vanish, nor do sums of them.
EXPONENT = 60
ADD = 0.1
#: Counts of at most so many frequent tokens are broadcast; the others are joined.
TOP = 1 << 18
_END, _BEGIN = mix(np.array([7_001, 7_002], np.uint64))
_CLASS_OF = (1 + mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(CLASSES - 1)).astype(np.uint8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Model(NamedTuple):
    """``classes (KINDS, rows, CLASSES)`` and ``slots (KINDS, rows, SLOTS)`` with their start values; ``words``, sorted, have the slots ``word_slots``."""

    classes: np.ndarray
    slots: np.ndarray
    class_bias: np.ndarray
    slot_bias: np.ndarray
    words: np.ndarray
    word_slots: np.ndarray

    @property
    def bits(self) -> int:
        return self.classes.shape[1].bit_length() - 1


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == 0


def tokens(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hash, class and first place of each text: its words, then one end (class 0)."""
    start, end, owner = block.words()
    value = block.span_hashes(block.prefix_sums(fold_case=True), start, end)
    low = _FOLD[block.data]
    kind = _CLASS_OF[(low[np.maximum(end - 2, start)].astype(np.int64) << 8) | low[end - 1]] if len(end) else np.zeros(0, np.uint8)
    bounds = np.searchsorted(owner, np.arange(block.rows + 1), "left")
    token, cls = np.full(len(value) + block.rows, _END), np.zeros(len(value) + block.rows, np.uint8)
    place = np.arange(len(value)) + owner
    token[place], cls[place] = value, kind
    return token, cls, bounds + np.arange(block.rows + 1)


def features(token: np.ndarray, cls: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each kind of feature for each token, ``(KINDS, n)``."""
    before = [np.full(len(token), _BEGIN), np.full(len(token), _BEGIN)]
    kinds = [np.zeros(len(token), np.uint64), np.zeros(len(token), np.uint64)]
    for k in (1, 2):
        before[k - 1][k:], kinds[k - 1][k:] = token[:-k], cls[:-k]
    starts = first[:-1]
    before[0][starts], kinds[0][starts] = _BEGIN, 0
    for at in (starts, starts + 1):
        at = at[at < len(token)]
        before[1][at], kinds[1][at] = _BEGIN, 0
    pair = kinds[0] * np.uint64(CLASSES) + kinds[1]
    return np.stack([mix(before[0] ^ np.uint64(1)), mix(before[1] ^ np.uint64(2)), mix(before[0] * np.uint64(3) + before[1] * np.uint64(5)), mix(pair + np.uint64(1 << 20))])


def table_rows(hashed: np.ndarray, cls: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the features in the table of classes, and in that of slots."""
    shift = np.uint64(64 - bits)
    within = hashed * (cls.astype(np.uint64) * np.uint64(2) + np.uint64(3))
    return (hashed >> shift).astype(np.uint16), (within >> shift).astype(np.uint16)


def slots_of(model: Model, token: np.ndarray) -> np.ndarray:
    at = SortedHashes(model.words).find(token)
    return np.r_[model.word_slots, 0][at].astype(np.uint8)  # the last for words without a place


def logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """``bias`` and the summed rows of weights, ``(n, choices)``; lowered by the largest of its row where exponents might overflow or vanish."""
    score = weights[0].take(rows[0], axis=0, mode="clip")
    score += bias
    for k in range(1, KINDS):
        score += weights[k].take(rows[k], axis=0, mode="clip")
    if len(score) and max(score.max(), -score.min()) > EXPONENT:
        score -= score.max(1, keepdims=True)
    return score


def _row_totals(x: np.ndarray) -> np.ndarray:
    """Sum of each row, the same wherever the row is."""
    return np.einsum("ij->i", x)


def log_odds(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Natural log of the share of the wanted choice in the softmax of each row."""
    score = logits(weights, bias, rows)
    wanted = score[np.arange(len(want)), want]
    return wanted - np.log(_row_totals(np.exp(score, out=score)))


def sums_by_row(slope: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``rows`` (of at most ``MINIBATCH``), and the sum of ``slope`` over the mentions of each.

    The n-th mentions of all rows are added at once; what a row has beyond ``MENTIONS`` is added row by row.
    """
    order = np.argsort(rows, kind="stable")
    ordered = rows[order]
    begin = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    times = np.diff(begin, append=len(rows))
    most_first = np.argsort(times.astype(np.uint16), kind="stable")[::-1]
    begin, times = begin[most_first], times[most_first]
    total = slope[order[begin]]
    with_more = len(times) - np.cumsum(np.bincount(np.minimum(times, MENTIONS + 1)))
    for nth in range(1, min(MENTIONS, times[0])):
        some = with_more[nth]
        total[:some] += slope.take(order[begin[:some] + nth], axis=0, mode="clip")
    if some := int(np.count_nonzero(times > MENTIONS)):
        rest = times[:some] - MENTIONS
        first = np.cumsum(rest) - rest
        place = np.arange(rest.sum()) + np.repeat(begin[:some] + MENTIONS - first, rest)
        # Two choices at a time, as one complex number.
        pairs = slope.take(order[place], axis=0, mode="clip").view(np.complex64)
        total[:some] += np.add.reduceat(pairs, first, axis=0).view(np.float32)
    return ordered[begin], total


def _step(weights: np.ndarray, bias: np.ndarray, state: np.ndarray, rows: np.ndarray, want: np.ndarray, rate: float) -> None:
    """One gradient step (scaled by past squares) over a minibatch, in place."""
    slope = logits(weights, bias, rows)
    np.exp(slope, out=slope)
    slope *= (1 / _row_totals(slope))[:, None]
    slope[np.arange(len(want)), want] -= 1
    for k in range(KINDS):
        used, step = sums_by_row(slope, rows[k])
        squares = state[k].take(used, axis=0, mode="clip")
        squares += step * step
        state[k][used] = squares
        squares += 1
        step *= rate
        step /= np.sqrt(squares, out=squares)
        weights[k][used] -= step


def train_locally(model: Model, state: tuple[np.ndarray, np.ndarray], token: np.ndarray, cls: np.ndarray, first: np.ndarray, rate: float = RATE) -> None:
    """Steps of both softmaxes over the texts of a block, in place."""
    hashed, slot = features(token, cls, first), slots_of(model, token)
    for at in range(0, len(token), MINIBATCH):
        part = slice(at, at + MINIBATCH)
        class_rows, slot_rows = table_rows(hashed[:, part], cls[part], model.bits)
        _step(model.classes, model.class_bias, state[0], class_rows, cls[part], rate)
        _step(model.slots, model.slot_bias[cls[part]], state[1], slot_rows, slot[part], rate)


def log_probabilities(model: Model, token: np.ndarray, cls: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 P(class, slot | history) and slot of each token."""
    hashed, slot, out = features(token, cls, first), slots_of(model, token), np.empty(len(token))
    for at in range(0, len(token), MINIBATCH):
        part = slice(at, at + MINIBATCH)
        class_rows, slot_rows = table_rows(hashed[:, part], cls[part], model.bits)
        out[part] = log_odds(model.classes, model.class_bias, class_rows, cls[part])
        out[part] += log_odds(model.slots, model.slot_bias[cls[part]], slot_rows, slot[part])
    return out / np.log(10), slot


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def merged() -> tuple:
        token, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        cls = np.zeros(len(token), np.uint8)
        cls[place] = np.concatenate([h[2] for h in held])
        return token, np.bincount(place, np.concatenate([h[1] for h in held])).astype(np.int64), cls

    def rows(x: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1]), pa.array(x[2].astype(np.int32))], ["token", "n", "cls"])

    for batch in batches:
        for block in blocks(batch.column("text")):
            token, cls, _ = tokens(block)
            one, at, n = np.unique(token, return_index=True, return_counts=True)
            held.append((one, n, cls[at]))
            if sum(len(h[0]) for h in held) > 2_000_000:
                held[:] = [merged()]
                if len(held[0][0]) > 1_000_000:
                    yield rows(held.pop())
    if held:
        yield rows(merged())


def _gradient(broadcast, parts: int):
    def train(frame: pd.DataFrame) -> pd.DataFrame:
        start = broadcast.value
        model = start._replace(classes=start.classes.copy(), slots=start.slots.copy())
        state, seen = (np.zeros_like(model.classes), np.zeros_like(model.slots)), 0
        for block in blocks(pa.array(frame.sort_values(["order", "text"])["text"], pa.large_string())):
            token, cls, first = tokens(block)
            train_locally(model, state, token, cls, first)
            seen += len(token)
        change = np.concatenate([(model.classes - start.classes).ravel(), (model.slots - start.slots).ravel()]) * np.float32(seen)
        shard = frame["shard"].iloc[0]
        return pd.DataFrame({"part": np.arange(parts), "shard": shard, "seen": seen, "change": list(change.reshape(parts, -1))})

    return train


def _sum_changes(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.sort_values("shard")
    total = np.sum(np.stack(list(frame["change"])).astype(np.float64), axis=0).astype(np.float32)
    return pd.DataFrame({"part": frame["part"].iloc[:1], "shard": frame["shard"].iloc[:1], "seen": [frame["seen"].sum()], "change": [total]})


def train(docs: DataFrame, model: Model, n_tokens: int, rounds: int = ROUNDS, shard_tokens: int = SHARD_TOKENS, parts: int = 32) -> Model:
    """``model`` after ``rounds`` rounds over the texts; only the model itself (a few MB) passes through the driver."""
    context = docs.sparkSession.sparkContext
    shards = max(1, -(-n_tokens // (rounds * shard_tokens)))
    dealt = docs.select("text", F.xxhash64("doc_id", "text", F.lit(99)).alias("order"))  # the id parts copies of one text
    dealt = dealt.withColumns({"round": F.pmod("order", F.lit(rounds)), "shard": F.pmod(F.xxhash64("order"), F.lit(shards))})
    schema = "part int, shard long, seen long, change array<float>"
    for k in range(rounds):
        local = dealt.where(F.col("round") == k).groupBy("shard").applyInPandas(_gradient(context.broadcast(model), parts), schema)
        # Two levels of sums, the first of 64 shards each; the order is that of the shards.
        some = local.groupBy("part", F.floor(F.col("shard") / 64)).applyInPandas(_sum_changes, schema)
        rows = some.groupBy("part").applyInPandas(_sum_changes, schema).collect()
        if rows:
            change = np.concatenate([np.array(r["change"], np.float32) / np.float32(r["seen"]) for r in sorted(rows, key=lambda r: r["part"])])
            cut = model.classes.size
            model = model._replace(classes=model.classes + change[:cut].reshape(model.classes.shape), slots=model.slots + change[cut:].reshape(model.slots.shape))
    return model


def start_model(frequent: pd.DataFrame, by_class: dict[int, tuple[int, int]]) -> tuple[Model, np.ndarray]:
    """The model before training, and the log10 of the mass that the words of slot 0 share in each class.

    ``frequent`` has ``token, n, cls``; ``by_class`` the tokens and distinct tokens of each class.
    """
    ranked = frequent[frequent["n"] > 0].sort_values(["cls", "n", "token"], ascending=[True, False, True])
    own = ranked[ranked.groupby("cls").cumcount() < SLOTS - 1]
    slot = own.groupby("cls").cumcount().to_numpy() + 1
    cls, n = own["cls"].to_numpy(np.int64), own["n"].to_numpy()
    mass = np.full((CLASSES, SLOTS), 1e-6)  # of slots without a word
    mass[:, 0] = ADD
    mass[cls, slot] = n + ADD
    held = np.bincount(cls, n, CLASSES), np.bincount(cls, minlength=CLASSES)
    for c, (count, distinct) in by_class.items():
        mass[c, 0] = count - held[0][c] + ADD * (distinct - held[1][c] + 1)
    words = own["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(words)
    bits = min(max((sum(v for _, v in by_class.values()) // 16).bit_length(), BITS[0]), BITS[1])
    zero = np.zeros((KINDS, 1 << bits, CLASSES), np.float32), np.zeros((KINDS, 1 << bits, SLOTS), np.float32)
    class_bias, slot_bias = np.log(mass.sum(1) / mass.sum()), np.log(mass / mass.sum(1, keepdims=True))
    return Model(*zero, class_bias.astype(np.float32), slot_bias.astype(np.float32), words[order], slot[order]), np.log10(mass[:, 0])


def _score_rows(broadcast):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, log_rest, top, top_log = broadcast.value
        places, log_count = SortedHashes(top), np.r_[top_log, 0.0]
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            for block in blocks(batch.column("text")):
                token, cls, first = tokens(block)
                log_p, slot = log_probabilities(model, token, cls, first)
                found = places.find(token)
                known, counted = found >= 0, log_count[found]
                log_p += np.where(slot == 0, counted - log_rest[cls], 0.0)
                starts = first[:-1]
                owner = np.repeat(np.arange(block.rows), np.diff(first))
                rare, counts = token[~known].view(np.int64), np.bincount(owner[~known], minlength=block.rows)
                offsets = np.r_[0, np.cumsum(counts)].astype(np.int32)
                held = [batch.column(c).slice(block.first_row, block.rows) for c in ("doc_id", "held_out")]
                data = [
                    *held,
                    pa.array(uid + np.arange(block.rows)),
                    pa.array(np.diff(first).astype(np.int64)),
                    pa.array(np.add.reduceat(log_p, starts)),
                    pa.array(np.add.reduceat(counted, starts)),
                    pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(rare)),
                ]
                uid += block.rows
                yield pa.RecordBatch.from_arrays(data, ["doc_id", "held_out", "uid", "n_tokens", "log_model", "log_count", "n_known", "rare"])

    return score


def score(docs: DataFrame, *, rounds: int = ROUNDS, top: int = TOP, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, a row for each document.

    A null text counts as empty: its one token is the end. A null id counts as
    the empty string in the split into folds. Without training texts every token
    is unknown. Rows alike are scored alike; other columns are ignored; an empty
    table gives an empty result. Very long texts are scored whole. Frequent words
    that tie for a slot take it in the order of their hash. Tokens are known by
    64 bits of hash. Reruns and other partitionings of the input give the same.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    learn = rows.where("not held_out").select("doc_id", "text")
    counts = learn.select("text").mapInArrow(_count_rows, "token long, n long, cls int").groupBy("token").agg(F.sum("n").alias("n"), F.min("cls").alias("cls"))
    counts = stored(counts, "token-counts")
    by_class = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = (sum(x[k] for x in by_class.values()) for k in (0, 1))

    # The counts above a level that at most ``top`` tokens reach.
    level = F.floor(F.log2("n") * 4)
    least, reached = float("inf"), 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        reached += r["count"]
        if reached > top:
            break
        least = r["level"]
    none = pd.DataFrame({"token": [0], "n": [0], "cls": [0]})
    frequent = counts.where(level >= F.lit(least)).select("token", "n", "cls").toPandas() if least < float("inf") else none
    start, log_rest = start_model(frequent, by_class)
    model = train(learn, start, total, rounds, shard_tokens)
    frequent_tokens = frequent["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(frequent_tokens)
    held = spark.sparkContext.broadcast((model, log_rest, frequent_tokens[order], np.log10(frequent["n"].to_numpy()[order] + ADD)))
    schema = "doc_id long, held_out boolean, uid long, n_tokens long, log_model double, log_count double, n_known long, rare array<long>"
    scored = stored(rows.mapInArrow(_score_rows(held), schema), "scored")

    rare = scored.select("uid", F.explode("rare").alias("t"))
    joined = rare.join(counts.where(level < F.lit(least)).select("token", "n"), F.col("t") == F.col("token"), "left")
    value = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADD))
    sums = joined.groupBy(F.col("uid").alias("u")).agg(F.sum(value).alias("rare_log"), F.count("n").alias("rare_known"))
    whole = F.lit(float(np.log10(total + ADD * (distinct + 1))))
    log_counts = F.col("log_count") + F.coalesce("rare_log", F.lit(0.0))
    return scored.drop("rare").join(sums, F.col("uid") == F.col("u"), "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * whole).alias("base_score"),
        (F.col("log_model") + F.coalesce("rare_log", F.lit(0.0))).alias("score"),
    )
