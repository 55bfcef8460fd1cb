"""Coarse quantizers: which list a vector belongs to, and which lists a query probes.

Each has ``size`` (how many lists), ``assign`` (list_no, id and vec), ``probes`` (query_id, probe_rank and list_no) and ``centres`` (vectors of given
lists, for workers). What a worker holds are codebooks, not the lists' centres, so a multi-index has as many lists as two
codebooks have pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.functions.kernels import matrix
from vexel.operators import cluster
from vexel.operators.flat import best, knn
from vexel.operators.quantizers import Residual
from vexel.operators.transforms import sample_matrix
from vexel.plans.storage import ship


def _table(spark, x: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")


def _probes(found: DataFrame) -> DataFrame:
    return found.select("query_id", F.col("rank").alias("probe_rank"), F.col("id").cast("int").alias("list_no"))


def _assigned(vectors: DataFrame, nearest) -> DataFrame:
    """nearest gives a list for each row of a matrix."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = nearest(matrix(b.column(1))) if b.num_rows else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), b.column(1)], ["list_no", "id", "vec"])

    kind = vectors.schema["vec"].dataType.simpleString()
    return vectors.select("id", "vec").where("vec IS NOT NULL").mapInArrow(run, f"list_no int, id long, vec {kind}")


@dataclass
class Centroids:
    """A list around each centroid. ``searcher`` is an index over the centroids, such as a graph, for probes; without one they are searched exactly."""

    centroids: np.ndarray
    metric: str = "l2"
    searcher: object = None
    options: dict = field(default_factory=dict)

    def __getstate__(self) -> dict:
        """Workers get the centroids only."""
        return self.__dict__ | {"searcher": None}

    @property
    def size(self) -> int:
        return len(self.centroids)

    def assign(self, vectors: DataFrame) -> DataFrame:
        return cluster.assign(vectors, self.centroids).select("list_no", "id", "vec")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        n = min(nprobe, self.size)
        return _probes(self.searcher.search(queries, n, **self.options) if self.searcher else knn(_table(queries.sparkSession, self.centroids), queries, n, self.metric))

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists]


@dataclass
class MultiIndex:
    """A codebook for each part of the vector; a list for each choice of one centroid a part, t0 + t1 * n + t2 * n^2 + ... for n = 2^bits."""

    books: list[np.ndarray]
    bits: int

    @staticmethod
    def fit(base: DataFrame, bits: int, parts: int = 2, rounds: int = 10) -> MultiIndex:
        d = len(base.where("vec IS NOT NULL").select("vec").first()["vec"])
        if d % parts:
            raise ValueError(f"{d} dimensions aren't {parts} equal parts")
        one = lambda p: base.select("id", F.slice("vec", 1 + p * (d // parts), d // parts).alias("vec"))
        return MultiIndex([cluster.Kmeans(1 << bits, rounds).fit(one(p)).centroids for p in range(parts)], bits)

    @property
    def size(self) -> int:
        return 1 << self.bits * len(self.books)

    def _cells(self, x: np.ndarray) -> np.ndarray:
        near = [((b**2).sum(1)[None] - 2 * s @ b.T).argmin(1) for s, b in zip(np.split(x, len(self.books), axis=1), self.books, strict=True)]
        return sum(t << (self.bits * p) for p, t in enumerate(near))

    def assign(self, vectors: DataFrame) -> DataFrame:
        return _assigned(vectors, self._cells)

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """The lists of least summed distance, in order of (distance, list).

        Each part's centroids are ranked. A pair of ranks i and j has i * j pairs, itself included, that come no later, so the first
        n pairs are among those with i * j <= n, some n * ln(n) of them. Parts are taken in one after another.
        """
        sums, width = None, self.books[0].shape[1]
        for p, book in enumerate(self.books):
            part = queries.select("query_id", F.slice("vec", 1 + p * width, width).alias("vec"))
            found = knn(_table(queries.sparkSession, book), part, min(nprobe, len(book))).select("query_id", "rank", "id", "distance")
            if sums is None:
                sums = found
                continue
            more = found.select("query_id", F.col("rank").alias("r"), F.col("id").alias("t"), F.col("distance").alias("d"))
            pairs = sums.join(more, "query_id").where(F.col("rank") * F.col("r") <= nprobe)
            sums = best(pairs.select("query_id", (F.col("id") + F.shiftleft("t", self.bits * p)).alias("id"), (F.col("distance") + F.col("d")).alias("distance")), nprobe)
        return _probes(sums)

    def centres(self, lists: np.ndarray) -> np.ndarray:
        lists, low = np.asarray(lists), (1 << self.bits) - 1
        return np.concatenate([b[lists >> (self.bits * p) & low] for p, b in enumerate(self.books)], axis=1)


@dataclass
class Additive:
    """Codebooks of an additive codec; a list for each choice of one entry a book, and its centre is their sum."""

    codec: Residual
    beam: int = 16

    @staticmethod
    def fit(base: DataFrame, codec: Residual, beam: int = 16) -> Additive:
        return Additive(codec.fit(sample_matrix(base)), beam)

    @property
    def _shifts(self) -> list[int]:
        return [0, *np.cumsum(self.codec.widths).tolist()][:-1]

    @property
    def size(self) -> int:
        return 1 << sum(self.codec.widths)

    def assign(self, vectors: DataFrame) -> DataFrame:
        return _assigned(vectors, lambda x: (self.codec.encode(x) << np.array(self._shifts)).sum(1))

    def _nearest_sums(self, q: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists and distances of the n nearest sums that a beam finds, best first; a beam of as many as there are sums is exact."""
        width = max(n, self.beam)
        lists, rest = np.zeros(1, np.int64), q[None]
        for book, shift in zip(self.codec.books, self._shifts, strict=True):
            d = ((rest[:, None] - book[None]) ** 2).sum(2)
            keep = np.argsort(d, axis=None, kind="stable")[:width]
            i, j = np.unravel_index(keep, d.shape)
            lists, rest = lists[i] + (j << shift), rest[i] - book[j]
        return lists[:n], (rest**2).sum(1)[:n]

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, id (a list), distance and rank."""
        ship(queries.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for name, q in zip(b.column(0).to_pylist(), matrix(b.column(1)), strict=True):
                    lists, d = self._nearest_sums(q, k)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(lists), pa.int64()), pa.array(lists), pa.array(d), pa.array(np.arange(1, len(lists) + 1, dtype=np.int32))], ["query_id", "id", "distance", "rank"])

        return queries.select("query_id", F.col("vec").cast("array<double>").alias("vec")).where("vec IS NOT NULL").mapInArrow(run, "query_id long, id long, distance double, rank int")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        return _probes(self.search(queries, nprobe))

    def centres(self, lists: np.ndarray) -> np.ndarray:
        codes = np.stack([np.asarray(lists) >> s & (1 << w) - 1 for s, w in zip(self._shifts, self.codec.widths, strict=True)], axis=1)
        return self.codec.decode(codes)
