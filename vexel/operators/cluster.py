"""K-means over DataFrames. A pass sends each task the centroids and gets back a sum and a count for each centroid."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions.kernels import matrix
from vexel.plans.storage import materialize, ship

PER_CENTROID, EPS = 256, 1 / 1024


@dataclass
class Kmeans:
    k: int
    rounds: int = 25
    spherical: bool = False
    integers: bool = False
    frozen: bool = False
    seed: int = 1234
    per_centroid: int = PER_CENTROID
    centroids: np.ndarray | None = None
    history: list[dict] = field(default_factory=list)

    def start(self, rows: DataFrame) -> np.ndarray:
        """The k rows of least seeded hash."""
        first = rows.orderBy(F.xxhash64("id", F.lit(self.seed)), "id").limit(self.k).select("vec").collect()
        return np.array([r["vec"] for r in first], np.float64)

    def fit(self, vectors: DataFrame, init: np.ndarray | None = None, sample: bool = True) -> Kmeans:
        """Columns id and vec, and weight if there is one. With sample, at most k * per_centroid rows of least hash, as the reference does."""
        rows = vectors.where("vec IS NOT NULL")
        rows = rows.select("id", "vec", F.col("weight").cast("double") if "weight" in rows.columns else F.lit(1.0).alias("weight"))
        if sample:
            rows = rows.orderBy(F.xxhash64("id", F.lit(self.seed + 1)), "id").limit(self.k * self.per_centroid)
        rows = rows.persist()
        c = self.start(rows) if init is None else np.array(init, np.float64)
        for _ in range(self.rounds):
            sums, sizes, cost = step(rows, c)
            if not self.frozen:
                alive = sizes > 0
                c[alive] = sums[alive] / sizes[alive, None]
                splits = split_empty(c, sizes)
                if self.spherical:
                    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-30)
                if self.integers:
                    c = np.round(c)
            self.history.append({"objective": cost, "imbalance": imbalance(sizes), "splits": 0 if self.frozen else splits})
        rows.unpersist()
        self.centroids = c
        return self

    def assign(self, vectors: DataFrame) -> DataFrame:
        return assign(vectors, self.centroids)

    def table(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(self.centroids)], "list_no int, vec array<double>")


def _near(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x**2).sum(1)[:, None] - 2 * (x @ c.T) + (c**2).sum(1)[None]
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def step(rows: DataFrame, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted sums and weights of each centroid's rows, and the summed squared distance."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, sizes, cost = np.zeros_like(c), np.zeros(len(c)), np.zeros(len(c))
        for b in batches:
            if b.num_rows:
                x, w = matrix(b.column(0)), b.column(1).to_numpy()
                at, d = _near(x, c)
                np.add.at(sums, at, x * w[:, None])
                sizes += np.bincount(at, w, len(c))
                cost += np.bincount(at, d * w, len(c))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(c))), pa.array(list(sums), pa.list_(pa.float64())), pa.array(sizes), pa.array(cost)], ["c", "s", "n", "e"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"c": [frame["c"].iloc[0]], "s": [np.sum(np.stack(frame["s"]), axis=0)], "n": [frame["n"].sum()], "e": [frame["e"].sum()]})

    kind = "c long, s array<double>, n double, e double"
    sums, sizes, cost = np.zeros_like(c), np.zeros(len(c)), 0.0
    for r in rows.select("vec", "weight").mapInArrow(run, kind).groupBy("c").applyInPandas(add, kind).collect():  # a row per centroid
        sums[r["c"]], sizes[r["c"]], cost = r["s"], r["n"], cost + r["e"]
    return sums, sizes, cost


def assign(vectors: DataFrame, c: np.ndarray) -> DataFrame:
    """id, vec, list_no and distance: each row's nearest centroid."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, d = _near(matrix(b.column(1)), c) if b.num_rows else (np.zeros(0, int), np.zeros(0))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(at, pa.int32()), pa.array(d)], ["id", "vec", "list_no", "distance"])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("id", "vec").where("vec IS NOT NULL").mapInArrow(run, f"id long, vec {kind}, list_no int, distance double")


def split_empty(c: np.ndarray, sizes: np.ndarray) -> int:
    """Each empty centroid becomes a copy of a large one, both moved apart a little, coordinate by coordinate in turn."""
    n = 0
    for i in np.flatnonzero(sizes == 0):
        j = int(sizes.argmax())
        c[i] = c[j]
        sign = np.where(np.arange(c.shape[1]) % 2 == 0, 1, -1) * EPS
        c[i], c[j] = c[i] * (1 + sign), c[j] * (1 - sign)
        sizes[i] = sizes[j] / 2
        sizes[j] -= sizes[i]
        n += 1
    return n


def imbalance(sizes: np.ndarray) -> float:
    return float(len(sizes) * (sizes**2).sum() / max(sizes.sum(), 1e-30) ** 2)


def imbalance_factor(assigned: DataFrame, k: int) -> DataFrame:
    sizes = assigned.groupBy("list_no").agg(F.count("*").alias("n"))
    return sizes.agg((k * F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), 2)).alias("imbalance"))


def compute_centroids(assigned: DataFrame) -> DataFrame:
    """list_no, pos and the weighted mean of that coordinate, in expressions."""
    long = assigned.select("list_no", F.col("weight").cast("double") if "weight" in assigned.columns else F.lit(1.0).alias("weight"), F.posexplode("vec").alias("pos", "x"))
    return long.groupBy("list_no", "pos").agg((F.sum(F.col("x").cast("double") * F.col("weight")) / F.sum("weight")).alias("mean"))


def bucket_start(vectors: DataFrame, k: int) -> np.ndarray:
    """Rows i * floor(n / k) by id, as deterministic centroids.

    Ids are sorted over partitions and stored with their place in one; the driver gets the partitions' sizes and k vectors.
    """
    places = materialize(vectors.select("id").orderBy("id").select("id", F.monotonically_increasing_id().alias("at")), "places")
    part = F.shiftright("at", 33)
    sizes = places.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    ends = np.cumsum([r["n"] for r in sizes])
    ranks = np.arange(k) * (int(ends[-1]) // k)
    block = np.searchsorted(ends, ranks, side="right")
    wanted = [(sizes[b]["part"] << 33) + int(r - (ends[b - 1] if b else 0)) for b, r in zip(block.tolist(), ranks, strict=True)]
    picked = vectors.join(F.broadcast(places.where(F.col("at").isin(wanted))), "id").orderBy("at").select("vec").collect()  # k rows
    return np.array([r["vec"] for r in picked], np.float64)


def kmeans_1d(values: np.ndarray, k: int) -> np.ndarray:
    """Optimal centroids of numbers, by dynamic programming with divide and conquer."""
    x = np.sort(np.asarray(values, float))
    n, k = len(x), min(k, len(x))
    s, q = np.r_[0, np.cumsum(x)], np.r_[0, np.cumsum(x * x)]
    cost = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / np.maximum(b - a, 1)
    best, back = cost(0, np.arange(n + 1)), np.zeros((k, n + 1), int)
    for c in range(1, k):
        new, todo = np.full(n + 1, np.inf), [(c, n, c, n)]
        while todo:
            lo, hi, a, b = todo.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            cuts = np.arange(a - 1, min(b, mid))
            v = best[cuts] + cost(cuts, mid) if len(cuts) else np.array([np.inf])
            j = int(v.argmin())
            new[mid], back[c, mid] = v[j], cuts[j] if len(cuts) else 0
            todo += [(lo, mid - 1, a, back[c, mid] + 1), (mid + 1, hi, back[c, mid], b)]
        best = new
    ends = [n]
    for c in range(k - 1, 0, -1):
        ends.append(back[c, ends[-1]])
    ends = [*ends[::-1]]
    starts = [0, *ends[:-1]]
    return np.array([x[a:b].mean() for a, b in zip(starts, ends, strict=True)])


def two_level(vectors: DataFrame, k1: int, k2: int, rounds: int = 10, seed: int = 1234) -> tuple[np.ndarray, DataFrame]:
    """First-level centroids, and some k2 second-level ones (list_no, sub_no, vec, rep_id) in proportion to the sizes.

    Second-level centroids are fitted on a bounded sample of each list; the representative is the nearest of all rows that belong to one,
    and those without rows are dropped."""
    first = Kmeans(k1, rounds, seed=seed).fit(vectors)
    placed = materialize(first.assign(vectors).select("list_no", "id", "vec"), "placed")
    sizes = {r["list_no"]: r["count"] for r in placed.groupBy("list_no").count().collect()}
    n = sum(sizes.values())
    share = {c: max(1, round(k2 * m / n)) for c, m in sizes.items()}
    order = Window.partitionBy("list_no").orderBy(F.xxhash64("id", F.lit(seed)), "id")
    bounded = placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PER_CENTROID * max(share.values(), default=1))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("r")
        x, c = np.stack(frame["vec"]).astype(float), share[int(frame["list_no"].iloc[0])]
        m = x[:c].copy()
        for _ in range(rounds):
            at, _d = _near(x, m)
            size = np.bincount(at, minlength=len(m)).astype(float)
            total = np.zeros_like(m)
            np.add.at(total, at, x)
            m[size > 0] = total[size > 0] / size[size > 0, None]
        return pd.DataFrame({"list_no": frame["list_no"].iloc[0], "sub_no": range(len(m)), "vec": m.tolist()})

    subs = materialize(bounded.groupBy("list_no").applyInPandas(fit, "list_no int, sub_no int, vec array<double>"), "second-level")
    return first.centroids, subs.join(representatives(placed, subs), ["list_no", "sub_no"])


def representatives(placed: DataFrame, subs: DataFrame) -> DataFrame:
    """list_no, sub_no and rep_id: of the rows (list_no, id, vec) nearest to each second-level centroid of their list, the nearest."""
    ship(placed.sparkSession)
    books: dict[int, list] = {}
    for r in subs.orderBy("list_no", "sub_no").collect():  # the model, which is as large as the caller asked for
        books.setdefault(r["list_no"], []).append((r["sub_no"], r["vec"]))
    books = {c: (np.array([n for n, _ in rows]), np.array([v for _, v in rows], float)) for c, rows in books.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            lists, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2))
            found = []
            for c in np.unique(lists):
                mine = np.flatnonzero(lists == c)
                at, d = _near(x[mine], books[int(c)][1])
                order = np.lexsort((ids[mine], d, at))
                first = order[np.r_[True, at[order][1:] != at[order][:-1]]]
                found.append((np.full(len(first), c), books[int(c)][0][at[first]], d[first], ids[mine][first]))
            c, sub, d, i = (np.concatenate(v) for v in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(sub, pa.int32()), pa.array(d), pa.array(i, pa.int64())], ["list_no", "sub_no", "d", "id"])

    near = placed.where("vec IS NOT NULL").select("list_no", "id", "vec").mapInArrow(run, "list_no int, sub_no int, d double, id long")
    return near.groupBy("list_no", "sub_no").agg(F.min(F.struct("d", "id"))["id"].alias("rep_id"))


def growing_dimensions(vectors: DataFrame, k: int, steps: int = 4, rounds: int = 10, seed: int = 1234) -> Kmeans:
    """K-means in the first principal dimensions, then from its centroids in more and more of them, and last in all: the fitted model, with centroids in the vectors' own dimensions and the history of all steps."""
    from vexel.operators.transforms import pca

    d = len(vectors.where("vec IS NOT NULL").select("vec").first()["vec"])
    turn = pca(vectors, d)
    turned, model, c, history = materialize(turn.apply(vectors), "turned"), None, None, []
    for step_no in range(steps):
        wide = max(1, round(d ** ((step_no + 1) / steps)))
        model = Kmeans(k, rounds, seed=seed)
        rows = turned.select("id", F.slice("vec", 1, wide).alias("vec"))
        model.fit(rows, None if c is None else np.pad(c, ((0, 0), (0, wide - c.shape[1]))))
        c = model.centroids
        history += [h | {"dimensions": wide} for h in model.history]
    model.centroids, model.history = (c - turn.b) @ turn.a, history
    return model


def sparse_assign(rows: DataFrame, centroids: DataFrame) -> DataFrame:
    """Nearest centroid of sparse rows (row, col, val) among sparse centroids (list_no, col, val), by joins and sums."""
    own = rows.groupBy("row").agg(F.sum(F.col("val") * F.col("val")).alias("nn"))
    norms = centroids.groupBy("list_no").agg(F.sum(F.col("val") * F.col("val")).alias("cc"))
    dots = rows.join(centroids.withColumnRenamed("val", "w"), "col").groupBy("row", "list_no").agg(F.sum(F.col("val") * F.col("w")).alias("dot"))
    pairs = own.crossJoin(F.broadcast(norms)).join(dots, ["row", "list_no"], "left")  # a row per centroid
    return pairs.groupBy("row").agg(F.min_by("list_no", F.struct(F.col("nn") + F.col("cc") - 2 * F.coalesce("dot", F.lit(0.0)), "list_no")).alias("list_no"))
