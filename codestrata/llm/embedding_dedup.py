"""Near-duplicate vectors by a forest of random-projection trees.

Every tree splits the vectors at random directions, again and again; vectors
near a split go to both sides. Vectors are compared only inside leaves, by
cosine in double precision. The upper splits are fitted on a bounded sample of
vectors (``SAMPLE``); a leaf that holds more than ``max_leaf`` of all vectors is
split further, at the mean of its own projections, until it does not. A cell that
hardly spreads against the distance of a link (``TIGHT``) is not split: all its
pairs are compared, in blocks that are dealt over tasks. A pair that shares
several leaves counts in the first of them only, so links are counted without
listing pairs.

Recall: a pair at the threshold is parted by a split with a chance of a few
hundredths, and has to be parted in every tree to be lost; a cut keeps off
places where the vectors crowd. Tests measure recall against brute force, also
where a third of all vectors are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .ngram_join import local_roots
from .shared import stored

#: Vectors that the upper splits are fitted on (those with the smallest hash of the id).
SAMPLE = 8192
TREES = 7
#: Vectors this near a split, in standard deviations of the projection, go to both sides.
SPILL = 0.15
LEAF = 384
MAX_LEAF = 4096
#: Cells whose deviation along a direction is under so many times that of a link at the threshold are compared whole.
TIGHT = 1.4
#: A part that keeps more than this share of the cell that was split is compared whole too, so that splitting ends.
STUCK = 0.98
#: Vectors of a block of such a cell.
BLOCK = 2048
#: Directions that the spread of a cell is read from; the first is the one it is split at.
PROBES = 8


def _sparse_cut(p: np.ndarray, reach: float) -> float:
    """The median, or a place between the quantiles 0.3 and 0.7 with far fewer values within ``reach``."""
    p = np.sort(p)
    places = np.r_[np.median(p), np.quantile(p, np.linspace(0.3, 0.7, 41))]
    crowd = np.searchsorted(p, places + reach) - np.searchsorted(p, places - reach)
    return float(places[0] if crowd[0] <= 1.5 * crowd.min() else places[crowd.argmin()])


def _fit_tree(sample: np.ndarray, leaf: int, spill: float, seed: int, link: float) -> list[tuple]:
    """Nodes ``(direction, threshold, margin, left, right)``; negative children are leaves -1 - number."""
    rng = np.random.default_rng(seed)
    nodes: list = []
    leaves = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal leaves
        if len(rows) > leaf and np.sqrt(sample[rows].var(0).mean()) >= TIGHT * link:
            direction = rng.standard_normal(sample.shape[1])
            p = sample[rows] @ (direction / np.linalg.norm(direction))
            sigma = float(p.std())
            margin = max(spill * sigma, min(link, sigma) / 2)
            cut = _sparse_cut(p, margin)
            left, right = rows[p < cut + margin], rows[p > cut - margin]
            if max(len(left), len(right)) < len(rows):
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (direction / np.linalg.norm(direction), cut, margin, grow(left), grow(right))
                return at
        leaves += 1
        return -leaves

    root = grow(np.arange(len(sample)))
    return nodes if root == 0 else []


def _route(tree: list[tuple], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and leaf number of every leaf that each row of ``x`` goes to."""
    rows, leaves = [], []
    todo = [(0 if tree else -1, np.arange(len(x)))]
    while todo:
        at, mine = todo.pop()
        if not len(mine):
            continue
        if at < 0:
            rows.append(mine), leaves.append(np.full(len(mine), -at))
            continue
        direction, cut, margin, left, right = tree[at]
        p = x[mine] @ direction
        todo += [(left, mine[p < cut + margin]), (right, mine[p > cut - margin])]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *leaves])


def _unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _route_rows(forests):
    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for size, part in frame.groupby(frame["vec"].map(len)):
                ids, x = part["id"].to_numpy(), _unit(list(part["vec"]))
                for t, tree in enumerate(forests.value.get(size, [[]])):
                    row, leaf = _route(tree, x)
                    yield pd.DataFrame({"id": ids[row], "cell": (leaf * 1000 + t) * 100_000 + size})

    return route


def _project_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        p = np.zeros((len(frame), PROBES))
        cells = frame["cell"].to_numpy()
        for cell in np.unique(cells):
            mine = np.flatnonzero(cells == cell)
            x = _unit([frame["vec"].iloc[i] for i in mine])
            directions = np.random.default_rng(abs(int(cell))).standard_normal((x.shape[1], PROBES))
            p[mine] = x @ (directions / np.linalg.norm(directions, axis=0))
        yield pd.DataFrame({"id": frame["id"], "cell": cells, "width": frame["vec"].map(len), **{f"p{k}": p[:, k] for k in range(PROBES)}})


def _compare(threshold: float, step: int = 1024):
    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        cell = frame["cell"].iloc[0]
        frame = frame.sort_values("id")
        x, ids, copies = _unit(list(frame["vec"])), frame["id"].to_numpy(), frame["copies"].to_numpy()
        link = np.zeros((len(x), len(x)), bool)
        for first in range(0, len(x), step):
            link[first : first + step] = x[first : first + step] @ x.T >= threshold
        np.fill_diagonal(link, False)
        if frame["lo"].iloc[0] != frame["hi"].iloc[0]:  # two blocks: the pairs inside each are compared elsewhere
            block = frame["block"].to_numpy()
            link &= block[:, None] != block[None, :]
        linked = np.flatnonzero(link.any(1))
        if not len(linked):
            return pd.DataFrame({"id": ids[:0], "links": copies[:0], "root": ids[:0]})
        link = link[np.ix_(linked, linked)]
        # Pairs that also share an earlier cell are counted there.
        cells = [np.asarray(frame["cells"].iloc[i]) for i in linked]
        earlier = [c[c < cell] for c in cells]
        seen, place = np.unique(np.concatenate(earlier), return_inverse=True)
        if len(seen):
            member = np.zeros((len(linked), len(seen)), np.float32)
            member[np.repeat(np.arange(len(linked)), [len(c) for c in earlier]), place] = 1
            first_here = link & (member @ member.T == 0)
        else:
            first_here = link
        root = local_roots(link)
        return pd.DataFrame({"id": ids[linked], "links": first_here @ copies[linked], "root": ids[linked][root]})

    return compare


def near_duplicates(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", *, threshold: float = 0.95, trees: int = TREES, spill: float = SPILL, leaf: int = LEAF, max_leaf: int = MAX_LEAF, sample: int = SAMPLE, block: int = BLOCK
) -> DataFrame:
    """``id, n_links, component_id, kept``, a row for each vector.

    Vectors that are null or zero, or hold null or non-finite parts, link with
    nothing and are their own component; so are vectors of another length than
    all others. Equal vectors are compared once and link with each other. A null
    id keeps a null component and is kept. Rows that share an id are one node.
    Other columns are ignored. An empty table gives an empty result. A cosine on
    the threshold links.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0) & F.col("id").isNotNull(), F.lit(False))
    rows = rows.withColumn("valid", valid)
    distinct = stored(rows.where("valid").groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "vectors")

    total = distinct.count()
    taken = distinct.select("id", "vec").orderBy(F.xxhash64("id")).limit(sample).toPandas()
    forests = {}
    for size, part in taken.groupby(taken["vec"].map(len)) if len(taken) else []:
        x = _unit(list(part["vec"]))
        rows_per_leaf = max(24, leaf * len(taken) // max(total, 1))
        forests[size] = [_fit_tree(x, rows_per_leaf, spill, seed, float(np.sqrt(2 * (1 - threshold) / size))) for seed in range(trees)]
    forest = spark.sparkContext.broadcast(forests)

    cells = stored(distinct.select("id", "vec").mapInPandas(_route_rows(forest), "id long, cell long"), "cells")
    cells = cells.withColumn("above", F.lit(None).cast("long"))
    final = None
    while True:
        counts = cells.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("n"), F.max("above").alias("m"))
        counts = stored(counts.withColumn("split", (F.col("n") > max_leaf) & F.coalesce(F.col("n") <= STUCK * F.col("m"), F.lit(True))), "cell-sizes")
        large = counts.where("split")
        if not large.limit(1).count():
            break
        done = cells.join(counts.where("not split"), F.col("cell") == F.col("c")).select("id", "cell")
        final = done if final is None else final.unionByName(done)
        split = cells.join(large, F.col("cell") == F.col("c")).select(F.col("id").alias("i"), "cell").join(distinct, F.col("i") == F.col("id"))
        probes = [f"p{k}" for k in range(PROBES)]
        split = stored(split.select("id", "cell", "vec").mapInPandas(_project_rows, "id long, cell long, width int, " + ", ".join(f"{p} double" for p in probes)), "projections")
        spread = F.sqrt(sum(F.var_pop(p) for p in probes) / PROBES)
        link = F.sqrt(F.lit(2 * (1 - threshold)) / F.max("width"))
        sigma = F.stddev_pop("p0")
        margin = F.greatest(sigma * spill, F.least(link, sigma) / 2)
        middle = split.groupBy(F.col("cell").alias("c")).agg(F.avg("p0").alias("mean"), margin.alias("margin"), (spread < TIGHT * link).alias("tight"), F.count("*").alias("n"))
        middle = stored(middle, "cell-means")
        tight = split.join(middle.where("tight"), F.col("cell") == F.col("c")).select("id", "cell")
        final = tight if final is None else final.unionByName(tight)
        sides = F.filter(F.array(F.when(F.col("p0") < F.col("mean") + F.col("margin"), 0), F.when(F.col("p0") >= F.col("mean") - F.col("margin"), 1)), lambda s: s.isNotNull())
        deeper = split.join(middle.where("not tight"), F.col("cell") == F.col("c")).withColumn("side", F.explode(sides))
        cells = stored(deeper.select("id", F.xxhash64("cell", "side").alias("cell"), F.col("n").alias("above")), "cells")
    cells = cells.drop("above") if final is None else final.unionByName(cells.drop("above"))

    own = cells.groupBy(F.col("id").alias("i")).agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    routed = distinct.join(own, F.col("id") == F.col("i")).select("id", "vec", "copies", "cells", F.explode("cells").alias("cell"))
    # Cells over ``max_leaf`` are left only where they are tight or stuck: every two of their blocks meet in a task of their own.
    sizes = cells.groupBy(F.col("cell").alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > max_leaf)
    sizes = stored(sizes.select("c", F.ceil(F.col("n") / F.lit(block)).cast("int").alias("blocks")), "whole-cells")
    routed = routed.join(F.broadcast(sizes), F.col("cell") == F.col("c"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    routed = routed.withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")).cast("int"))
    routed = routed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    routed = routed.select("id", "vec", "copies", "cells", "cell", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    found = routed.groupBy("cell", "lo", "hi").applyInPandas(_compare(threshold), "id long, links long, root long")
    found = stored(found, "vector-links")
    links = found.groupBy(F.col("id").alias("i")).agg(F.sum("links").alias("links"))
    linked = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    result = distinct.join(links, F.col("id") == F.col("i"), "left").join(linked, F.col("id") == F.col("node"), "left")
    result = stored(
        result.select(
            F.col("vec").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id")
        ),
        "vector-result",
    )
    out = rows.where("valid").join(result, F.col("vec") == F.col("v")).select("id", "n_links", "component_id")
    alone = rows.where("not valid").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
    return out.withColumnRenamed("id", id_column)
