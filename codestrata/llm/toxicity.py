"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

The features are lexicon densities, how near insults are to words of address,
capitals, punctuation and obfuscation rates. One lexicon is fixed; the other,
word stems that toxic training texts hold far more often, is learned. Labels
are used of at most ``max_labels`` training rows, dealt by text into three parts:
stems, trees and calibration, so that no part judges what it was fitted on.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stored

# Insults, and words of address in several languages.
INSULTS = (
    "idiot idiots moron morons stupid dumb loser losers trash garbage scum pathetic worthless disgusting clown clowns "
    "jerk fool imbecile retard filth vermin pig bastard bitch asshole crap shit fuck fucking damn hate ugly"
).split()
ADDRESS = "you your yours u ur tu te toi vous votre du dich dir dein sie ihr usted ti tus vos".split()
MAX_LABELS = 24_000
MAX_STEMS = 4_000
STEM_LENGTHS = (3, 4, 5, 6, 7, 8)
NAMES = ("words", "insults", "insult_kinds", "stems", "stem_weight", "stem_kinds", "stem_top", "addressed", "capitals", "shouted", "marks", "exclaims", "symbols", "digits", "obfuscated", "masked")
_LETTERS = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{3,}\b")
_ODD = re.compile(r"[a-z]+[0-9@$!*.\-]+[a-z][a-z0-9@$!*]*")
_PLAIN = str.maketrans("013457@$!", "oieastasi", "*.-")


def train_row(doc_id: Column) -> Column:
    """Whether labels of the row may be learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 != 1


class _Weights(dict):
    """Word -> weight of its heaviest stem."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems

    def __missing__(self, word: str) -> float:
        weight = max([self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if n <= len(word)], default=0.0)
        if len(self) > 400_000:
            self.clear()
        self[word] = weight
        return weight


def text_features(text: str, weights: _Weights) -> list[float]:
    """The features of one text in the order of ``NAMES``; all 0 for an empty one."""
    words = _LETTERS.findall(text.lower())
    n, size = max(len(words), 1), max(len(text), 1)
    insults = [i for i, w in enumerate(words) if w in _INSULT_SET]
    near = sum(1 for i in insults if not _ADDRESS_SET.isdisjoint(words[max(0, i - 4) : i + 5]))
    stems = [(x, w) for w in words if (x := weights[w])]
    odd = _ODD.findall(text.lower())
    return [
        float(np.log1p(len(words))),
        len(insults) / n,
        float(len({words[i] for i in insults})),
        len(stems) / n,
        sum(x for x, _ in stems) / n,
        float(len({w for _, w in stems})),
        max([x for x, _ in stems], default=0.0),
        near / n,
        sum(map(text.count, _UPPER)) / size,
        len(_SHOUT.findall(text)) / n,
        sum(map(text.count, ".,;:?")) / size,
        text.count("!") / size,
        sum(map(text.count, "#*$%&|<>@")) / size,
        sum(map(text.count, "0123456789")) / size,
        len(odd) / n,
        float(sum(1 for w in odd if w.translate(_PLAIN) in _INSULT_SET)),
    ]


_INSULT_SET, _ADDRESS_SET, _UPPER = frozenset(INSULTS), frozenset(ADDRESS), "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _feature_rows(stems, keep: list[str]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = _Weights(stems.value)
        for batch in batches:
            rows = [text_features(text.as_py() or "", weights) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(rows, pa.list_(pa.float64()))], [*keep, "dense"])

    return extract


def labelled(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS) -> DataFrame:
    """``text, toxic, part`` of the training rows that are used; rows that share their least five-word shingle count once.

    Of such rows the toxic one stays, then the one with the least hash, so that reruns learn from the same.
    """
    good = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & train_row(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "toxic")
    good = good.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_labels)
    rows = docs.select("doc_id", "text").join(F.broadcast(good), F.col("doc_id") == F.col("id")).where("text is not null")
    words = rows.withColumn("w", F.split(F.lower("text"), r"\s+"))
    shingle = F.array_min(F.transform(F.col("w"), lambda x, i: F.xxhash64(x, *[F.get(F.col("w"), i + k) for k in range(1, 5)])))
    once = words.withColumn("least", shingle).groupBy("least").agg(F.min_by(F.struct("text", "toxic"), F.struct(-F.col("toxic"), F.xxhash64("text"), "text")).alias("row"))
    return stored(once.select("row.*", F.pmod("least", F.lit(5)).cast("int").alias("part")), "labelled")


def learn_stems(rows: DataFrame, limit: int = MAX_STEMS) -> dict[str, float]:
    """Stems found in toxic texts at least 8 times as often as in others, and their log odds; at most ``limit``."""
    totals = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not other:
        return {}
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(*[F.substring(w, 1, n) for n in STEM_LENGTHS]))))
    counts = rows.select("toxic", F.explode(stems).alias("stem")).where(F.length("stem") >= STEM_LENGTHS[0])
    counts = counts.groupBy("stem").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    odds = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (other + 1)))
    least = max(4, toxic // 150)
    found = counts.where(F.col("t") >= least).withColumn("odds", odds).where(F.col("odds") >= float(np.log(8))).orderBy(F.desc(F.col("t") * F.col("odds")), "stem").limit(limit)
    return {r["stem"]: r["odds"] for r in found.collect()}


def score(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, max_labels: int = MAX_LABELS) -> DataFrame:
    """``doc_id, held_out, score, predicted``, a row for each document; null texts count as empty.

    A null id counts as the empty string in the split and has no label. Without
    both labels among the training rows every score is their mean (0 without
    rows). Very long texts are read whole; an empty table gives an empty result.
    A score on the threshold is predicted 1. Rows alike in text score alike; columns beside ``doc_id`` and ``text``
    are never looked at.
    """
    context = docs.sparkSession.sparkContext
    rows = labelled(docs, labels, max_labels)
    stems = context.broadcast(learn_stems(rows.where("part < 2")))
    out = docs.select("doc_id", (~train_row(F.col("doc_id"))).alias("held_out"), "text")

    dense = rows.select("text", "toxic", "part").mapInArrow(_feature_rows(stems, ["toxic", "part"]), "toxic int, part int, dense array<double>")
    train = stored(dense.withColumns({"features": array_to_vector("dense"), "label": F.col("toxic").cast("double")}).coalesce(6), "toxic-features")
    kinds = {(r["later"], r["toxic"]) for r in train.where("part >= 2").groupBy((F.col("part") == 4).alias("later"), "toxic").count().collect()}
    if len(kinds) < 4:
        mean = rows.agg(F.avg("toxic").alias("m")).first()["m"] or 0.0
        return out.select("doc_id", "held_out", F.lit(float(mean)).alias("score"), F.lit(int(mean >= threshold)).alias("predicted"))
    trees = GBTClassifier(maxIter=16, maxDepth=4, stepSize=0.2, seed=3, maxBins=32, cacheNodeIds=False).fit(train.where("part in (2, 3)"))
    judged = trees.transform(train.where("part = 4")).select(F.col("label"), vector_to_array("probability")[1].alias("p"))
    calibration = IsotonicRegression(featuresCol="p", labelCol="label").fit(judged)

    scored = out.mapInArrow(_feature_rows(stems, ["doc_id", "held_out"]), "doc_id long, held_out boolean, dense array<double>")
    scored = trees.transform(scored.withColumn("features", array_to_vector("dense")))
    scored = calibration.transform(scored.select("doc_id", "held_out", vector_to_array("probability")[1].alias("p")))
    score = F.least(F.greatest(F.col("prediction"), F.lit(0.0)), F.lit(1.0))
    return scored.select("doc_id", "held_out", score.alias("score"), (score >= threshold).cast("int").alias("predicted"), F.col("p").alias("uncalibrated"))
