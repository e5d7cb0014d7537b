"""Quality rules: counts per text and a hashed n-gram log-likelihood ratio (DataFrame functions only).

The ratio compares two multinomials over hashed 1- and 2-grams: one counted over
trusted documents, one over the whole corpus. Its mean per n-gram is held against
a fixed threshold, so the verdict on a text depends on nothing but the text and
those two tables.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
#: n-grams run over words and runs of punctuation, so that `word###` is two tokens.
TOKEN = r"[^\s\p{Punct}]+|\p{Punct}+"
BUCKETS = 1 << 14
#: At most so many trusted ids (those with the smallest hash) are used; they are broadcast.
MAX_TRUSTED = 20_000
THRESHOLD = -0.25


def _bucket(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, BLANK), "")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def trusted_ids(labels: DataFrame, limit: int = MAX_TRUSTED) -> DataFrame:
    """``doc_id`` of at most ``limit`` documents labelled good, by smallest hash of the id."""
    good = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted share / corpus share) of each bucket, shrunk towards 0 where the trusted texts say little.

    One scan of all texts; counts are combined before the shuffle and only
    ``BUCKETS`` rows reach the driver. Without trusted texts every ratio is 0.
    """
    marked = trusted.select(F.col("doc_id").alias("__id"), F.lit(1).alias("__good"))
    texts = docs.select("doc_id", _tokens(F.col("text")).alias("tokens"))
    texts = texts.join(F.broadcast(marked), F.col("doc_id") == F.col("__id"), "left")
    each = texts.select("__good", "tokens", F.posexplode("tokens").alias("i", "x"))
    after = F.get("tokens", F.col("i") + 1)
    grams = F.array(_bucket(F.col("x")), F.when(after.isNotNull(), _bucket(F.col("x"), after)))
    grams = each.select("__good", F.explode(grams).alias("bucket")).where("bucket is not null")
    counts = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__good").alias("good")).collect()
    all_raw, all_good = sum(r["raw"] for r in counts), sum(r["good"] for r in counts)
    ratios = [0.0] * BUCKETS
    if all_good:
        for r in counts:
            share = r["raw"] / all_raw
            ratios[r["bucket"]] = math.log((r["good"] + BUCKETS * share) / (all_good + BUCKETS) / share)
    return ratios


def _repeat_words(words: str, hashed=F.xxhash64) -> tuple[dict[str, Column], ...]:
    """Steps to ``__covered``: words in a 3-word window that is found at least twice.

    Most texts repeat no window, which the distinct hashes show. In the others
    windows are sorted by hash, words and place, so that equal ones lie side by
    side at any length of the text, also where hashes collide.
    """
    at = lambda i: F.get(F.col(words), i)
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: hashed(x, at(i + 1), at(i + 2)))
    repeats = F.size(F.array_distinct("__windows")) < F.size("__windows")
    placed = F.when(repeats, F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), at(i).alias("x"), at(i + 1).alias("y"), at(i + 2).alias("z"), i.alias("i")))))

    def alike(one: Column, i: Column) -> Column:
        same = lambda other: F.coalesce(reduce(and_, [one[k] == other[k] for k in "hxyz"]), F.lit(False))
        return same(F.get(F.col("__placed"), i - 1)) | same(F.get(F.col("__placed"), i + 1))

    places = F.sort_array(F.transform(F.filter("__placed", alike), lambda x: x["i"]))
    start = F.struct(F.lit(-9).alias("last"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate("__places", start, lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")))
    return {"__windows": windows}, {"__placed": placed}, {"__places": places}, {"__covered": F.coalesce(covered["n"], F.lit(0))}


def apply_rules(docs: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` and ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept``.

    A null or empty text has no words, fails the base rules and is not kept. Very
    long texts are counted whole. Rows alike get equal verdicts; a ratio on the
    threshold passes. No row is shuffled. Columns of the same names in ``docs``
    are replaced. An empty table gives an empty result.
    """
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")]
    out = docs.select(*names, _words(text).alias("__words"), _tokens(text).alias("__tokens"))
    for step in _repeat_words("__words"):
        out = out.withColumns(step)
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))

    after = lambda i: F.get(F.col("__tokens"), i + 1)
    single = lambda x: F.get(weights, _bucket(x))
    ratio = F.transform("__tokens", lambda x, i: F.when(after(i).isNull(), single(x)).otherwise(single(x) + F.get(weights, _bucket(x, after(i)))))
    total = F.aggregate(ratio, F.lit(0.0), lambda a, x: a + x)
    n_grams = 2 * F.size("__tokens") - 1
    out = out.withColumns(
        {
            "n_words": F.size("__words").cast("long"),
            "word_chars": F.length(F.array_join("__words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("long"),
            "__lines": lines,
            "n_repeat_words": F.col("__covered").cast("long"),
            "llr": F.when(n_grams > 0, total / n_grams).otherwise(F.lit(0.0)),
        }
    )
    out = out.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
    # Through a generator: Spark would push a caller's filter below the words and split the text anew for each of them.
    found = F.struct("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "llr", "kept")
    return out.select(*names, F.explode(F.array(found)).alias("__found")).select(*names, "__found.*")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Both scans: count n-grams over all texts, then judge every text."""
    return apply_rules(docs, log_ratios(docs, trusted_ids(labels)), threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that are kept, with the columns of ``docs``."""
    return apply_rules(docs, log_ratios(docs, trusted_ids(labels)), threshold).where("kept").select(*docs.columns)
