"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Each document starts with the same real number of copies as all of its source:
target words / source words. The whole part is taken; the fractions are rounded
in pairs. A pair hands words from one document to the other until one of the
two is whole, at odds that keep every expected value, so that the words a
source takes stay put until its last open document is rounded. Groups of about
``fan_in`` open documents are folded at once and each leaves one open document
for the next level: a reduction tree over any number of documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: Below this many sources their table is broadcast; above, Spark chooses the join.
BROADCAST_SOURCES = 10_000
_TINY = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source, source_size, target, n_rows`` from one row per source (``source, source_size, n_rows``).

    Weights repeat over the sources by code point, null last. The targets share
    ``share`` of all words by weight; one that would pass ``most`` times its
    source stays there and the others take the excess. One row per source is
    ordered here, never one per document.
    """
    order = Window.orderBy(F.asc_nulls_last("source"))
    place = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    ranked = ranked.withColumn("full", F.col("source_size") * F.lit(most)).withColumn("ratio", F.col("full") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.asc_nulls_last("source"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(Window.partitionBy()) * F.lit(share) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("level") <= F.col("ratio"))
    first_open = F.min(F.when(F.col("open"), F.col("ratio"))).over(Window.partitionBy())
    final = F.max(F.when(F.col("open") & (F.col("ratio") == first_open), F.col("level"))).over(Window.partitionBy())
    target = F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least("full", F.coalesce(final * F.col("weight"), F.col("full"))))
    return ranked.select("source", "source_size", "n_rows", target.alias("target"))


def _fold(units: Column, level: int, seed: int) -> Column:
    """Fold an array of open documents: ``done`` (key, up) and ``rest``, the one left open."""
    unit_type = "struct<size:bigint,key:bigint,p:double>"

    def step(state: Column, unit: Column) -> Column:
        held = state["rest"]
        ratio = unit["size"] / held["size"]
        up = F.least(1 - held["p"], unit["p"] * ratio)
        down = F.least(held["p"], (1 - unit["p"]) * ratio)
        draw = F.shiftrightunsigned(F.xxhash64(held["key"], unit["key"], F.lit(seed + level)), 11) / F.lit(float(1 << 53))
        rise = draw * (up + down) < down
        p1 = F.when(rise, held["p"] + up).otherwise(held["p"] - down)
        p2 = unit["p"] + (held["p"] - p1) / ratio

        def whole(p: Column) -> Column:
            return (p < _TINY) | (p > 1 - _TINY)

        def settled(x: Column, p: Column) -> Column:
            return F.array(F.struct(x["key"].alias("key"), (p > 0.5).alias("up")))

        def still(x: Column, p: Column) -> Column:
            return F.struct(x["size"].alias("size"), x["key"].alias("key"), p.alias("p"))

        none = F.lit(None).cast(unit_type)
        paired = (
            F.when(whole(p1) & whole(p2), F.struct(F.concat(state["done"], settled(held, p1), settled(unit, p2)).alias("done"), none.alias("rest")))
            .when(whole(p1), F.struct(F.concat(state["done"], settled(held, p1)).alias("done"), still(unit, p2).alias("rest")))
            .otherwise(F.struct(F.concat(state["done"], settled(unit, p2)).alias("done"), still(held, p1).alias("rest")))
        )
        return F.when(held.isNull(), F.struct(state["done"].alias("done"), still(unit, unit["p"]).alias("rest"))).otherwise(paired)

    start = F.struct(F.array().cast("array<struct<key:bigint,up:boolean>>").alias("done"), F.lit(None).cast(unit_type).alias("rest"))
    return F.aggregate(units, start, step)


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, fan_in: int = 64, seed: int = 7) -> DataFrame:
    """``doc_id, source, key, size, source_size, target, copies, taken, n_rows``, a row for each document.

    ``docs`` needs ``doc_id, text, source``; other columns are ignored. A null
    text has no words; a document without words is never taken. Null sources
    are one source, ordered last. Rows alike in id, source and text are one
    unit with ``n_rows``: they share one rounding and get their own rows back.
    An empty table gives an empty result. No document is taken more than
    ceil(``most``) times, and reruns agree.
    """
    key = F.xxhash64("doc_id", "text")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("key"))
    slim = stored(slim.groupBy("doc_id", "source", "size", "key").agg(F.count("*").alias("n_alike")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum(F.col("size") * F.col("n_alike")).cast("long").alias("source_size"), F.count("*").alias("n_rows"))
    targets = stored(source_targets(sizes, weights, share, most), "mix-targets")
    bound = targets.agg(F.count("*").alias("sources"), F.max("n_rows").alias("rows")).first()
    small = F.broadcast(targets) if bound["sources"] <= BROADCAST_SOURCES else targets
    units = slim.join(small.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    # Rows alike differ in nothing: of their shared fractions all but one settle among themselves.
    mass = (copies - F.floor(copies)) * F.col("n_alike")
    units = units.withColumns({"base": F.floor(copies), "among": F.floor(mass + _TINY), "p": F.greatest(mass - F.floor(mass + _TINY), F.lit(0.0))})
    units = units.withColumn("sid", F.xxhash64(F.coalesce("source", F.lit("")), F.col("source").isNull()))

    loose = units.where((F.col("size") > 0) & (F.col("p") > _TINY)).select("sid", "size", F.xxhash64("key", "source", "size").alias("key"), "p", F.col("n_rows").alias("n"))
    settled = None
    for level in range(max(1, math.ceil(math.log(max(bound["rows"] or 1, 2), fan_in))) + 8):
        n_groups = F.ceil(F.col("n") / F.lit(fan_in))
        group = F.pmod(F.xxhash64("key", F.lit(seed * 1000 + level)), n_groups)
        folded = loose.groupBy("sid", group.alias("g")).agg(
            _fold(F.sort_array(F.collect_list(F.struct("size", "key", "p")), asc=False), level, seed).alias("x"), F.max(n_groups).alias("n")
        )
        folded = stored(folded, "mix-level")
        done = folded.select("sid", F.explode("x.done").alias("d")).select("sid", "d.key", "d.up")
        settled = done if settled is None else settled.unionByName(done)
        loose = folded.where("x.rest is not null").select("sid", "x.rest.*", "n")
        if not loose.where("n > 1").limit(1).count():
            break
    # One document of a source is left open at the root; it goes to the nearer side.
    last = loose.select("sid", "key", (F.col("p") >= 0.5).alias("up"))
    settled = settled.unionByName(last).withColumnRenamed("key", "ukey").withColumnRenamed("sid", "usid")

    units = units.withColumn("ukey", F.xxhash64("key", "source", "size"))
    joined = units.join(settled, (units["ukey"] == settled["ukey"]) & (units["sid"] == settled["usid"]), "left").drop(settled["ukey"])
    ups = F.col("among") + F.coalesce(F.col("up").cast("long"), F.lit(0))
    ups = F.when(F.col("size") > 0, ups).otherwise(F.lit(0))
    parts = F.filter(
        F.array(
            F.struct((F.col("base") + 1).cast("long").alias("copies"), ups.cast("long").alias("times")),
            F.struct(F.col("base").cast("long").alias("copies"), (F.col("n_alike") - ups).cast("long").alias("times")),
        ),
        lambda x: x["times"] > 0,
    )
    rows = joined.withColumn("part", F.explode(parts)).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), F.col("part.times"))))
    taken_copies = F.when(F.col("size") > 0, F.col("part.copies")).otherwise(F.lit(0).cast("long"))
    return rows.select("doc_id", "source", "key", "size", "source_size", "target", taken_copies.alias("copies"), (F.col("size") * taken_copies).alias("taken"), "n_alike")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``."""
    plan = mix(docs, **options).where("copies > 0")
    total = plan.groupBy(F.col("key").alias("__k"), F.col("doc_id").alias("__id"), F.col("source").alias("__src"))
    total = total.agg(F.sum("copies").alias("__times"), F.max("n_alike").alias("__alike"))
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    on = (F.col("__key") == F.col("__k")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__src"))
    joined = keyed.join(total, on)
    if total.where("__alike > 1").limit(1).count():
        # Rows alike each stand for their share of the copies; the first of them for the remainder.
        share = F.floor(F.col("__times") / F.col("__alike"))
        nth = F.row_number().over(Window.partitionBy("__k", "__id", "__src").orderBy("__k"))
        several = joined.where("__alike > 1").withColumn("__nth", nth)
        spare = F.when(F.col("__nth") <= F.col("__times") - share * F.col("__alike"), 1).otherwise(0)
        several = several.withColumn("__times", (share + spare).cast("long")).drop("__nth")
        joined = joined.where("__alike = 1").unionByName(several)
    joined = joined.where("__times > 0").withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    return joined.select(*docs.columns)
