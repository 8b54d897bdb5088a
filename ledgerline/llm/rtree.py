"""Hard negatives by best-first search in STR-packed R-trees of integer vectors.

Sort-tile-recursive packing in two steps: all rows are tiled into slabs along the two coordinates that vary most, at
quantiles of the whole table, and each tile is packed into a tree of its own, by the same rule along DIMENSIONS
coordinates. A tree is one row of the index: its vectors in leaf order and, for each level, the minimum bounding boxes.
The product of an anchor with any vector of a box lies between sums of per-coordinate bounds; a queue takes boxes by
their upper bound and drops those outside every score window or strictly below the k-th best. Anchors meet the trees in
blocks; the best of all trees are the result, and exact, since all products are integers.

Components become floor(SCALE * x). Rows with a null label, vector or id, or a null or non-finite component, take no part,
nor do empty vectors. Vectors are compared only with those of their own length. Ties of score go to the smaller id, of
repeated ids to either; each repeated row counts for itself, and only the anchor's own row is left out. Products are exact below 2 ** 53;
beyond, an error is raised. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SCALE = 256
#: Rows of a tile, of a leaf; boxes of an inner node; coordinates that a tile is packed along.
TILE_ROWS, LEAF_ROWS, FAN, DIMENSIONS = 8_192, 512, 8, 3
#: Anchors that one task searches a tree for.
BLOCK_ANCHORS = 1_000
EXACT = 2.0**53


def usable(vectors: DataFrame, label: str = "label") -> DataFrame:
    """row, vec_id, label, vector (integers as doubles); row is a number of its own, written so that it stays."""
    e = F.col("embedding").cast("array<double>")
    clean = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), e.alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = clean.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & fine)
    # floor as a double: far components would not fit an integer, and are refused later
    whole = F.transform("e", lambda x: F.when(F.abs(x) < 2.0**40, F.floor(x * SCALE).cast("double")).otherwise(x * SCALE))
    return common.settle(kept.select("row", "vec_id", "label", whole.alias("vector")))


# --- the index


def tiled(rows: DataFrame) -> DataFrame:
    """rows with their dim and tile. Tiles hold about TILE_ROWS; rows that no coordinate parts are dealt by their number."""
    dims = F.size("vector").alias("dim")
    sizes = {r.dim: r["count"] for r in rows.groupBy(dims).count().collect()}  # a row for each length of vectors
    out = None
    for dim, n in sizes.items():
        same = rows.where(F.size("vector") == dim)
        tiles = -(-n // TILE_ROWS)
        if tiles == 1:
            cut = same.withColumn("tile", F.lit("0"))
        else:
            spread = same.agg(*(F.stddev_pop(F.get("vector", F.lit(i))).alias(str(i)) for i in range(dim))).first()
            widest = sorted(range(dim), key=lambda i: -spread[i])
            slabs = int(np.ceil(np.sqrt(tiles)))
            cut = slab(same.withColumn("tile", F.lit("0")), widest[0], slabs)
            if dim > 1:
                cut = slab(cut, widest[1], -(-tiles // slabs))
            cut = common.settle(cut)
            many = cut.groupBy("tile").agg(F.ceil(F.count(F.lit(1)) / (2 * TILE_ROWS)).alias("shares"))  # a row for each tile
            cut = common.join_measured(cut, many, ["tile"], "inner").withColumn("tile", F.concat_ws(".", "tile", F.pmod(F.xxhash64("row"), "shares"))).drop("shares")
        cut = cut.select(F.lit(dim).alias("dim"), "tile", "row", "vec_id", "label", "vector")
        out = cut if out is None else out.unionByName(cut)
    return rows.select(F.lit(0).alias("dim"), F.lit("").alias("tile"), "*").limit(0) if out is None else out


def slab(rows: DataFrame, axis: int, slabs: int) -> DataFrame:
    """Cut every tile into slabs along a coordinate, at its quantiles."""
    if slabs <= 1:
        return rows
    x = F.get("vector", F.lit(axis))
    cuts = rows.groupBy("tile").agg(F.percentile_approx(x, F.lit([i / slabs for i in range(1, slabs)]), F.lit(10_000)).alias("cuts"))
    below = F.size(F.filter("cuts", lambda c: c < x))
    return common.join_measured(rows, cuts, ["tile"], "inner").withColumn("tile", F.concat_ws(".", "tile", below)).drop("cuts")


def str_order(v: np.ndarray) -> np.ndarray:
    """Rows in the order of the leaves: slabs along the widest coordinate, each into slabs along the next, and so on."""
    widest = np.argsort(-v.std(0), kind="stable")[:DIMENSIONS]

    def pack(rows: np.ndarray, axes: np.ndarray) -> np.ndarray:
        rows = rows[np.argsort(v[rows, axes[0]], kind="stable")]
        leaves = -(-len(rows) // LEAF_ROWS)
        if len(axes) == 1 or leaves <= 1:
            return rows
        slabs = int(np.ceil(leaves ** (1 / len(axes))))
        size = -(-leaves // slabs) * LEAF_ROWS
        return np.concatenate([pack(rows[i : i + size], axes[1:]) for i in range(0, len(rows), size)])

    return pack(np.arange(len(v)), widest)


def boxes(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Low and high corners of the leaves, of the nodes over FAN of them, and so on up to one root."""
    starts = np.arange(0, len(v), LEAF_ROWS)
    levels = [(np.minimum.reduceat(v, starts), np.maximum.reduceat(v, starts))]
    while len(levels[-1][0]) > 1:
        low, high = levels[-1]
        starts = np.arange(0, len(low), FAN)
        levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))
    return levels


def index(rows: DataFrame) -> DataFrame:
    """A row for each tree: dim, tile, and its arrays as bytes."""

    def build(key: tuple, some: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(some.vector.to_numpy()).astype(float)
        if np.abs(v).max() ** 2 * v.shape[1] >= EXACT:
            raise ValueError("components are too large for exact products")
        order = str_order(v)
        v, some = v[order], some.iloc[order]
        levels = [np.concatenate(side).tobytes() for level in boxes(v) for side in [level]]
        return pd.DataFrame([{"dim": key[0], "tile": key[1], "rows": some.row.to_numpy(np.int64).tobytes(), "ids": some.vec_id.to_numpy(np.int64).tobytes(), "labels": some.label.to_numpy(np.int64).tobytes(), "vectors": v.tobytes(), "levels": levels}])

    schema = "dim int, tile string, rows binary, ids binary, labels binary, vectors binary, levels array<binary>"
    return common.settle(tiled(rows).groupBy("dim", "tile").applyInPandas(build, schema))


# --- the search


@dataclass
class Tree:
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def read(dim: int, one) -> Tree:
        numbers = (np.frombuffer(one[c], np.int64) for c in ("rows", "ids", "labels"))
        corners = (np.frombuffer(b).reshape(2, -1, dim) for b in one["levels"])
        return Tree(*numbers, np.frombuffer(one["vectors"]).reshape(-1, dim), [(c[0], c[1]) for c in corners])


class Best:
    """The k best (score, smaller id) of those in a window of scores."""

    def __init__(self, k: int, low: float = -np.inf, high: float = np.inf) -> None:
        self.k, self.low, self.high, self.held = k, low, high, []

    def least(self) -> float:
        """Scores strictly below can no longer count."""
        return max(self.low, self.held[0][0]) if len(self.held) == self.k else self.low

    def wants(self, low: float, high: float) -> bool:
        """Whether a box with scores from low to high may hold one that counts."""
        return low <= self.high and min(high, self.high) >= self.least()

    def take(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = ((scores <= self.high) & (scores >= self.least())).nonzero()[0]
        if len(fit) > self.k:  # of a leaf no more than the k best can count, and what ties with the last of them
            own = scores[fit]
            fit = fit[own >= np.partition(own, len(own) - self.k)[len(own) - self.k]]
        for one in zip(scores[fit].tolist(), (-ids[fit]).tolist(), (-rows[fit]).tolist()):
            if len(self.held) < self.k:
                heapq.heappush(self.held, one)
            elif one > self.held[0]:
                heapq.heapreplace(self.held, one)


def best_first(tree: Tree, anchor: np.ndarray, fits: np.ndarray, wanted: list[Best]) -> int:
    """Fill wanted from the rows of the tree where fits; returns how many leaves were read."""
    up, down = np.maximum(anchor, 0), np.minimum(anchor, 0)
    top = len(tree.levels) - 1

    def bounds(level: int, first: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = (corner[first:end] for corner in tree.levels[level])
        return low @ up + high @ down, high @ up + low @ down

    low, high = bounds(top, 0, 1)
    queue, read = [(-high[0], low[0], top, 0)], 0
    while queue:
        high, low, level, node = heapq.heappop(queue)
        if -high < min(w.least() for w in wanted):
            break
        if not any(w.wants(low, -high) for w in wanted):
            continue
        if level:
            first, end = node * FAN, min((node + 1) * FAN, len(tree.levels[level - 1][0]))
            for i, (l, h) in enumerate(zip(*bounds(level - 1, first, end))):
                if any(w.wants(l, h) for w in wanted):
                    heapq.heappush(queue, (-h, l, level - 1, first + i))
            continue
        read += 1
        start, end = node * LEAF_ROWS, (node + 1) * LEAF_ROWS
        scores = tree.vectors[start:end] @ anchor
        least, most = min(w.least() for w in wanted), max(w.high for w in wanted)
        own = ((scores >= least) & (scores <= most) & fits[start:end]).nonzero()[0]
        if len(own):
            scores, ids, rows = scores[own], tree.ids[start:end][own], tree.rows[start:end][own]
            for w in wanted:
                w.take(scores, ids, rows)
    return read


def in_blocks(anchors: DataFrame, trees: DataFrame, search, schema: str) -> DataFrame:
    """search(key, anchors, tree) for every block of anchors and every tree of their length. Anchors have dim and row."""
    blocks = -(-anchors.count() // BLOCK_ANCHORS) or 1
    tiles = trees.select(F.col("dim").alias("dim"), F.col("tile").alias("tile"))
    cut = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    many = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = cut.join(tiles, "dim")
    keys = ["dim", "tile", "block"]
    return dealt.groupBy(keys).cogroup(many.groupBy(keys)).applyInPandas(search, schema)


def positives(anchors: DataFrame, trees: DataFrame, k: int) -> DataFrame:
    """anchor (row), positive_id, positive_score, place: the k best other rows with the anchor's label."""

    def search(key: tuple, some: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one):
            tree = Tree.read(key[0], one.iloc[0])
            for label, same in some.groupby("label"):
                alike = tree.labels == label
                for a in same.itertuples():
                    best, own = Best(k), alike & (tree.rows != a.row)
                    best_first(tree, np.asarray(a.vector, float), own, [best])
                    out += [(a.row, -i, -r, int(s)) for s, i, r in best.held]
        return pd.DataFrame(out, columns=["anchor", "positive_id", "positive_row", "positive_score"])

    found = in_blocks(anchors, trees, search, "anchor long, positive_id long, positive_row long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive_row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def negatives(anchors: DataFrame, trees: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """For each of an anchor's positives (array of place, positive_score): the k best rows of other labels whose score is
    between low and high percent of the positive's."""

    def search(key: tuple, some: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one):
            tree = Tree.read(key[0], one.iloc[0])
            for label, same in some.groupby("label"):
                others = tree.labels != label
                for a in same.itertuples():
                    windows = {p["place"]: Best(k, -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100) for p in a.positives}
                    windows = {p: w for p, w in windows.items() if w.low <= w.high}
                    if windows:
                        best_first(tree, np.asarray(a.vector, float), others, list(windows.values()))
                    out += [(a.row, p, -i, -r, int(s)) for p, w in windows.items() for s, i, r in w.held]
        return pd.DataFrame(out, columns=["anchor", "place", "negative_id", "negative_row", "negative_score"])

    found = in_blocks(anchors, trees, search, "anchor long, place int, negative_id long, negative_row long, negative_score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("negative_score"), "negative_id", "negative_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: str, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where is_anchor (SQL on vec_id).

    label is SQL too, so that a caller may state labels of its own.
    """
    rows = usable(vectors, label)
    trees = index(rows)
    anchors = common.settle(rows.where(is_anchor).select(F.size("vector").alias("dim"), "row", "vec_id", "label", "vector"))
    found = common.settle(positives(anchors, trees, n_positives))
    lists = found.groupBy("anchor").agg(F.collect_list(F.struct("place", "positive_score")).alias("positives"))  # n_positives at most
    asked = common.settle(anchors.join(lists.withColumnRenamed("anchor", "row"), "row"))
    named = asked.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = negatives(asked, trees, n_negatives, low, high).join(found, ["anchor", "place"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
