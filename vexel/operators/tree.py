"""A balanced k-means tree: nodes are split level by level until each holds few rows.

All nodes of a level that are too large are split at once. A node's centroids are fitted by one task on a bounded sample, for several
factors of a penalty on size, and the factor that gives the most even sizes is kept; then all rows of all nodes choose by
distance plus penalty, in expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions.distance import l2
from vexel.operators.cluster import PER_CENTROID
from vexel.operators.coarse import Centroids
from vexel.operators.ivf import IvfIndex
from vexel.plans.storage import materialize, ship

#: Penalties tried, as shares of the mean squared distance to the node's mean, for a child that has all rows.
FACTORS = (0.0, 0.5, 1.0, 2.0, 4.0, 8.0)


def balanced(x: np.ndarray, k: int, factor: float, rounds: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centroids, each one's penalty and its number of rows, by k-means in which a row's cost grows with the share of rows a centroid had in the round before."""
    scale = ((x - x.mean(0)) ** 2).sum(1).mean() * factor
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    size = np.full(len(c), len(x) / len(c))
    for _ in range(rounds):
        at = ((c**2).sum(1)[None] - 2 * x @ c.T + scale * size / len(x)).argmin(1)
        now = np.bincount(at, minlength=len(c))
        for j in np.flatnonzero(now):
            c[j] = x[at == j].mean(0)
        size = (size + now) / 2  # halfway, so that sizes settle
    penalty = scale * size / len(x)
    at = ((c**2).sum(1)[None] - 2 * x @ c.T + penalty).argmin(1)
    return c, penalty, np.bincount(at, minlength=len(c))


@dataclass
class Tree:
    """nodes: node, parent, level, vec (its centre) and n (its rows); rows: id, vec and node, the leaf that a row is in."""

    nodes: DataFrame
    rows: DataFrame

    @staticmethod
    def build(base: DataFrame, k: int = 8, leaf: int = 64, rounds: int = 10, seed: int = 1, most: int = 30) -> Tree:
        """Leaves have at most so many rows, but for rows that are all equal. The root is node 1, the children of a node are k * node + 0 to k - 1 and so on, which keeps numbers apart for k >= 2 and ``most`` levels."""
        ship(base.sparkSession)
        if k**most >= 1 << 62:
            most = int(62 / np.log2(k)) - 1
        rows = materialize(base.where("vec IS NOT NULL").select("id", F.col("vec").cast("array<double>").alias("vec"), F.lit(1).cast("long").alias("node")), "tree")
        settled, nodes = rows.limit(0), None

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            x, node = np.stack(frame.sort_values("place")["vec"]).astype(float), int(frame["node"].iloc[0])
            if (x == x[0]).all():
                return pd.DataFrame({"node": [node], "c": [[]]})
            tried = [balanced(x, min(k, len(x)), f, rounds, seed) for f in FACTORS]
            c, penalty, size = min(tried, key=lambda t: t[2].std())
            return pd.DataFrame({"node": [node], "c": [[(j, v.tolist(), float(p)) for j, (v, p) in enumerate(zip(c, penalty, strict=True))]]})

        for level in range(most):
            sizes = rows.groupBy("node").agg(F.count("*").alias("n"))
            wide = materialize(sizes.where(F.col("n") > leaf).select("node"), "wide")
            settled = settled.union(rows.join(wide, "node", "left_anti").select("id", "vec", "node"))
            if not wide.limit(1).count():
                break
            open_ = rows.join(wide, "node", "left_semi")
            lot = Window.partitionBy("node").orderBy(F.xxhash64("id", F.lit(seed)), "id")
            sample = open_.withColumn("place", F.row_number().over(lot)).where(F.col("place") <= PER_CENTROID * k)
            split = materialize(sample.select("node", "vec", "place").groupBy("node").applyInPandas(fit, "node long, c array<struct<j: int, vec: array<double>, penalty: double>>"), "split")
            placed = open_.join(split, "node").withColumn("best", F.array_min(F.transform("c", lambda e: F.struct((l2(F.col("vec"), e["vec"]) + e["penalty"]).alias("cost"), e["j"].alias("j")))))
            settled = settled.union(placed.where("best IS NULL").select("id", "vec", "node"))  # equal rows aren't split
            rows = materialize(placed.where("best IS NOT NULL").select("id", "vec", (F.col("node") * k + F.col("best.j")).alias("node")), "tree")
            settled = materialize(settled, "leaves")
            made = split.select(F.col("node").alias("parent"), F.explode("c").alias("e")).select((F.col("parent") * k + F.col("e.j")).alias("node"), "parent", F.lit(level + 1).alias("level"), F.col("e.vec").alias("vec"))
            made = materialize(made.join(rows.groupBy("node").agg(F.count("*").alias("n")), "node"), "nodes")
            nodes = made if nodes is None else nodes.unionByName(made)
        else:
            settled = settled.union(rows)
        empty = base.sparkSession.createDataFrame([], "node long, parent long, level int, vec array<double>, n long")
        return Tree(empty if nodes is None else nodes, materialize(settled, "leaves"))

    def leaf_sizes(self) -> DataFrame:
        return self.rows.groupBy("node").agg(F.count("*").alias("n"))

    def index(self) -> IvfIndex:
        """The leaves as inverted lists around their means."""
        means = self.rows.select("node", F.posexplode("vec").alias("pos", "v")).groupBy("node", "pos").agg(F.avg("v").alias("v"))
        leaves = means.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("c")).select("node", F.col("c.v").alias("vec")).orderBy("node").collect()  # a centroid a list, as of any index
        numbers = self.rows.sparkSession.createDataFrame([(r["node"], i) for i, r in enumerate(leaves)], "node long, list_no int")
        return IvfIndex(None, materialize(self.rows.join(numbers, "node").select("list_no", "id", "vec"), "lists"), "l2", Centroids(np.array([r["vec"] for r in leaves])))
