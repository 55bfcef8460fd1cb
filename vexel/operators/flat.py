"""Exhaustive search. Tables of vectors have columns id and vec, tables of queries query_id and vec.

``knn`` scans the base once. Queries go to the workers in blocks of a checked number of bytes; each Arrow batch of base vectors
meets a block tile by tile in matrix products of at most ``CELLS`` distances, each task keeps the k best of each query, and a window picks the k best overall by (distance,
id). A selector filters the base before any of that. ``knn_columns`` is the same in Column expressions, for plans that must stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import distance as D
from vexel.functions.kernels import Nearest, matrix, pairwise, tiles, within_reach
from vexel.plans.storage import materialize, ship

#: Bytes of query vectors that a task holds at once.
QUERY_BYTES = 32 << 20
#: Lists that a scan names to the file reader.
NAMED = 1000
#: knn_columns: one row in so many gives the bounds; most coordinates that are written out.
SHARE, SPREAD = 128, 100
FOUND = "query_id long, id long, distance double"


def query_blocks(queries: DataFrame, limit: int = QUERY_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries in blocks of at most so many bytes; one block at a time is on the driver."""
    ids, rows, size = [], [], 0
    for r in queries.select("query_id", "vec").toLocalIterator():
        if r["vec"] is None:
            continue
        ids.append(r["query_id"]), rows.append(r["vec"])
        size += 8 * len(r["vec"])
        if size >= limit:
            yield np.array(ids), np.array(rows, np.float64)
            ids, rows, size = [], [], 0
    if ids:
        yield np.array(ids), np.array(rows, np.float64)


def probed_blocks(queries: DataFrame, probes: DataFrame | None, column: str = "vec", kind: type = np.float64) -> Iterator[tuple[np.ndarray, np.ndarray, dict[int, np.ndarray] | None]]:
    """Queries in blocks of ``QUERY_BYTES`` with their probes, and for each list the queries that probe it."""
    if probes is None:
        yield from ((names, block, None) for names, block in query_blocks(queries))
        return
    asked = queries.where(F.col(column).isNotNull()).join(probes.where("list_no >= 0").groupBy("query_id").agg(F.collect_list("list_no").alias("lists")), "query_id")  # nprobe lists each
    held, size = [], 0

    def block():
        who: dict[int, list[int]] = {}
        for i, r in enumerate(held):
            for n in r["lists"]:
                who.setdefault(n, []).append(i)
        return np.array([r["query_id"] for r in held]), np.array([r[column] for r in held], kind), {n: np.array(w) for n, w in who.items()}

    for r in asked.select("query_id", column, "lists").toLocalIterator():
        held.append(r)
        size += 8 * (np.size(r[column]) + len(r["lists"]))
        if size >= QUERY_BYTES:
            yield block()
            held, size = [], 0
    if held:
        yield block()


def nearest_in_lists(lists: DataFrame, queries: DataFrame, probes: DataFrame, k: int, metric: str = "l2", column: str = "vec", kind: type = np.float64) -> DataFrame:
    """query_id, id, distance and rank of the k nearest rows (list_no, id and vec or another column) of the lists that each query probes.

    The lists are scanned where they are: each task keeps k rows a query, and nothing else is shuffled."""
    def scan(names: np.ndarray, block: np.ndarray, who: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(names, block, k, metric)
            for x, ids, asked in _met(batches, who, column):
                near.see(x, ids, asked)
            yield near.found()

        return run

    return best(_scanned(lists, queries, probes, column, kind, scan), k, metric in D.SIMILARITIES)


def within_lists(lists: DataFrame, queries: DataFrame, probes: DataFrame, radius: float, metric: str = "l2") -> DataFrame:
    """query_id, id and distance of all rows strictly within the radius (strictly above it for similarities) of the lists that each query probes.

    The lists are scanned where they are: no vector is shuffled, and only pairs within the radius leave a task."""
    sign = -1.0 if metric in D.SIMILARITIES else 1.0
    edge = sign * radius

    def scan(names: np.ndarray, block: np.ndarray, who: dict[int, np.ndarray]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, ids, asked in _met(batches, who, "vec"):
                for q, c, key in within_reach(metric, block, x, asked, 3.0, lambda key, asked: np.full(len(asked), edge)):
                    inside = key < edge
                    yield pa.RecordBatch.from_arrays([pa.array(names[q[inside]], pa.int64()), pa.array(ids[c[inside]], pa.int64()), pa.array(sign * key[inside], pa.float64())], ["query_id", "id", "distance"])

        return run

    return _scanned(lists, queries, probes, "vec", np.float64, scan)


def _met(batches: Iterator[pa.RecordBatch], who: dict[int, np.ndarray], column: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The rows of each batch by list: vectors, ids and the places of the queries that probe the list, if any do."""
    for b in batches:
        if not b.num_rows:
            continue
        no, ids, x = b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)) if column == "vec" else b.column(2).to_numpy()
        order = np.argsort(no, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(no[order])) + 1):
            asked = who.get(int(no[mine[0]]))
            if asked is not None:
                yield x[mine], ids[mine], asked


def _scanned(lists: DataFrame, queries: DataFrame, probes: DataFrame, column: str, kind: type, scan) -> DataFrame:
    """What scan(names, block, who) finds in the lists for each block of queries."""
    ship(lists.sparkSession)
    rows = lists.where(F.col(column).isNotNull()).select("list_no", "id", column)

    def parts() -> Iterator[DataFrame]:
        for names, block, who in probed_blocks(queries, probes, column, kind):
            asked = rows if len(who) > NAMED else rows.where(F.col("list_no").isin(sorted(who)))
            yield asked.mapInArrow(scan(names, block, who), FOUND)

    return reduce(DataFrame.unionByName, parts(), lists.sparkSession.createDataFrame([], FOUND))


def best(found: DataFrame, k: int, descending: bool = False, by: str = "query_id") -> DataFrame:
    """The k best of each query with their ranks from 1; equal distances by id."""
    order = Window.partitionBy(by).orderBy(F.desc("distance") if descending else F.asc("distance"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None, p: float = 3.0) -> DataFrame:
    """query_id, rank, id and distance of the k nearest rows; fewer if there are fewer."""
    ship(base.sparkSession)
    rows = (base if where is None else base.where(where)).where("vec IS NOT NULL").select("id", "vec")
    descending = metric in D.SIMILARITIES

    def scan(names: np.ndarray, block: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = Nearest(names, block, k, metric, p)
            for batch in batches:
                if batch.num_rows:
                    near.see(matrix(batch.column(1)), batch.column(0).to_numpy())
            yield near.found()

        return run

    parts = [rows.mapInArrow(scan(n, b), FOUND) for n, b in query_blocks(queries)]
    if not parts:
        return base.sparkSession.createDataFrame([], FOUND + ", rank int")
    return best(reduce(DataFrame.unionByName, parts), k, descending)


def knn_columns(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """knn in Column expressions, over nested-loop joins with blocks of queries of at most ``QUERY_BYTES``.

    The k nearest of one row in ``SHARE`` give each query a bound; of all pairs only those within it are ranked. Sums over up to
    ``SPREAD`` coordinates are written out, with a column for each."""
    rows = (base if where is None else base.where(where)).where("vec IS NOT NULL").select("id", "vec")
    queries = queries.where("vec IS NOT NULL").select("query_id", "vec")
    sizes = F.min(F.size("vec")), F.max(F.size("vec"))
    least, most = rows.agg(*sizes).union(queries.agg(*sizes)).agg(F.min(F.col("min(size(vec))")), F.max(F.col("max(size(vec))"))).first()
    if most is None:
        return base.sparkSession.createDataFrame([], FOUND + ", rank int")
    descending, each = metric in D.SIMILARITIES, range(most)
    wide = metric in D.SUMS and least == most and 0 < most <= SPREAD
    told = lambda name: [F.coalesce(F.get("vec", F.lit(i)).cast("double"), F.lit(float("nan"))).alias(f"{name}{i}") for i in each] if wide else [F.col("vec").alias(f"{name}vec")]
    distance = reduce(lambda s, i: s + D.SUMS[metric](F.col(f"q{i}"), F.col(f"x{i}")), each, F.lit(0.0)) if wide else D.METRICS[metric](F.col("qvec"), F.col("xvec"))
    asked, rows = materialize(queries.select("query_id", *told("q")), "queries"), rows.select("id", *told("x"))
    blocks = max(1, -(-asked.count() * 8 * (most + 2) // QUERY_BYTES))

    def pairs(rows: DataFrame, asked: DataFrame, inside: Column) -> DataFrame:
        dealt = rows.repartition("id")  # a row takes as long as there are queries
        parts = [dealt.join(F.broadcast(asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)), inside) for b in range(blocks)]  # QUERY_BYTES at most
        return reduce(DataFrame.unionByName, [p.select("query_id", "id", distance.alias("distance")) for p in parts])

    some = best(pairs(rows.where(F.pmod(F.xxhash64("id"), F.lit(SHARE)) == 0), asked, F.lit(True)), k, descending)
    asked = materialize(asked.join(some.where(F.col("rank") == k).select("query_id", F.col("distance").alias("bound")), "query_id", "left"), "queries")
    bound = F.coalesce("bound", F.lit(float("-inf" if descending else "nan")))  # NaN is beyond all numbers
    return best(pairs(rows, asked, ~(distance < bound) if descending else ~(distance > bound)), k, descending)


def range_search(base: DataFrame, queries: DataFrame, radius: float, metric: str = "l2", where: Column | None = None) -> DataFrame:
    """query_id, id and distance of all rows strictly within the radius (strictly above it for similarities)."""
    ship(base.sparkSession)
    rows = (base if where is None else base.where(where)).where("vec IS NOT NULL").select("id", "vec")
    descending = metric in D.SIMILARITIES

    def scan(names: np.ndarray, block: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column(1))
                for s in tiles(len(block), len(x)) if len(x) else ():
                    d = pairwise(metric, block[s], x)
                    q, c = np.nonzero(d > radius if descending else d < radius)
                    yield pa.RecordBatch.from_arrays([pa.array(names[s][q]), batch.column(0).take(pa.array(c)), pa.array(d[q, c])], ["query_id", "id", "distance"])

        return run

    parts = [rows.mapInArrow(scan(n, b), FOUND) for n, b in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else base.sparkSession.createDataFrame([], FOUND)


def nearest_pairs(base: DataFrame, queries: DataFrame, n: int, radius: float = np.inf, metric: str = "l2") -> DataFrame:
    """query_id, id and distance of pairs strictly within the radius, n of the nearest of each task: those that range_search needs for what asks for the n nearest pairs of all."""
    if metric in D.SIMILARITIES:
        raise ValueError("pairs are taken by distance")
    ship(base.sparkSession)
    rows = base.where("vec IS NOT NULL").select("id", "vec")

    def scan(names: np.ndarray, block: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, edge = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)], radius
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()

                def limit(key: np.ndarray, asked: np.ndarray) -> np.ndarray:
                    return np.full(len(asked), np.fmin(edge, np.partition(key, n - 1, axis=None)[n - 1]) if key.size > n else edge)

                for q, c, d in within_reach(metric, block, matrix(batch.column(1)), np.arange(len(block)), 3.0, limit):
                    inside = d < edge if len(held[0]) < n else d <= edge
                    if not inside.any():
                        continue
                    held = [np.r_[held[0], names[q[inside]]], np.r_[held[1], ids[c[inside]]], np.r_[held[2], d[inside]]]
                    order = np.lexsort((held[1], held[0], held[2]))[:n]
                    held = [h[order] for h in held]
                    edge = held[2][-1] if len(order) == n else radius
            yield pa.RecordBatch.from_arrays([pa.array(h) for h in held], ["query_id", "id", "distance"])

        return run

    parts = [rows.mapInArrow(scan(m, b), FOUND) for m, b in query_blocks(queries)]
    return reduce(DataFrame.unionByName, parts) if parts else base.sparkSession.createDataFrame([], FOUND)


def assign(base: DataFrame, queries: DataFrame, metric: str = "l2") -> DataFrame:
    return knn(base, queries, 1, metric).select("query_id", "id")


def reconstruct(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The stored vectors of the given ids."""
    return base.join(ids.select("id").distinct(), "id", "left_semi").select("id", "vec")


def search_and_reconstruct(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    return knn(base, queries, k, metric).join(base.select("id", "vec"), "id")


def distance_subset(base: DataFrame, queries: DataFrame, wanted: DataFrame, metric: str = "l2") -> DataFrame:
    """Distances of the named pairs (query_id, id) only."""
    pairs = wanted.select("query_id", "id").join(base.select("id", "vec"), "id").join(queries.select("query_id", F.col("vec").alias("query_vec")), "query_id")
    return pairs.select("query_id", "id", D.METRICS[metric](F.col("query_vec"), F.col("vec")).alias("distance"))


def residual(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """id and vec minus the centroid named by list_no."""
    return vectors.join(centroids.select("list_no", F.col("vec").alias("centre")), "list_no").select("id", "list_no", D.subtract(F.col("vec"), F.col("centre")).alias("vec"))


def merge_results(parts: list[DataFrame], k: int, descending: bool = False) -> DataFrame:
    """The k best of several results, as shards give them."""
    return best(reduce(DataFrame.unionByName, [p.select("query_id", "id", "distance") for p in parts]), k, descending)


def nearest_1d(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """k nearest numbers by absolute difference; base has id and value, queries query_id and value."""
    near = lambda b, q: b.select("id", F.array(F.col("value").cast("double")).alias("vec"))
    return knn(near(base, queries), queries.select("query_id", F.array(F.col("value").cast("double")).alias("vec")), k, "l1")


def to_dense(found: DataFrame, k: int) -> DataFrame:
    """A row per query with arrays of ids and distances; missing places have id -1 and null distance."""
    cells = found.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "distance"))).alias("r"))
    place = F.sequence(F.lit(0), F.lit(k - 1))
    return cells.select("query_id", F.transform(place, lambda i: F.coalesce(F.get("r", i)["id"], F.lit(-1))).alias("ids"), F.transform(place, lambda i: F.get("r", i)["distance"]).alias("distances"))
