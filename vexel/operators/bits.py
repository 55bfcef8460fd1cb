"""Binary vectors of any number of bits: tables with id and code, a BINARY of whole bytes, the least bit of a byte first.

Codes are searched as other codes are, with a codec that counts differing bits. Where a quantizer or a graph works on coordinates,
a bit is a coordinate of 0 or 1, and the squared distance is the Hamming distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.functions.distance import hamming_words
from vexel.operators.coarse import Centroids
from vexel.operators.coded import CodedIvf, FlatCodes
from vexel.operators.cluster import Kmeans
from vexel.operators.flat import best
from vexel.operators.graph import GraphIndex
from vexel.plans.storage import ship


@dataclass
class Bits:
    """A codec of coordinates 0 and 1: eight to a byte."""

    d: int = 0

    @property
    def widths(self) -> list[int]:
        return [8] * ((self.d + 7) // 8)

    def fit(self, x: np.ndarray) -> Bits:
        self.d = x.shape[1]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x > 0.5, axis=1, bitorder="little").astype(np.int64)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.unpackbits(codes.astype(np.uint8), axis=1, count=self.d, bitorder="little").astype(float)

    def distances(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        return np.bitwise_count(codes ^ self.encode(q[None])).sum(1).astype(float)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def coordinates(codes: DataFrame, name: str = "id") -> DataFrame:
    """name and vec, a coordinate a bit; null codes are left out."""
    ship(codes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.unpackbits(_matrix(b.column(1)), axis=1, bitorder="little").astype(float)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(x), pa.list_(pa.float64()))], [name, "vec"])

    return codes.where("code IS NOT NULL").select(name, "code").mapInArrow(run, f"{name} long, vec array<double>")


def _whole(found: DataFrame) -> DataFrame:
    return found.withColumn("distance", F.round("distance").cast("int"))


@dataclass
class BinaryIndex:
    """Search of codes by an index over their bits."""

    inner: FlatCodes | CodedIvf | GraphIndex

    @staticmethod
    def flat(base: DataFrame) -> BinaryIndex:
        return BinaryIndex(FlatCodes.build(coordinates(base), Bits()))

    @staticmethod
    def lists(base: DataFrame, nlist: int, rounds: int = 10, graph: int = 0) -> BinaryIndex:
        """Lists around majority centres; with graph, that many links a centre, and probes are found by a walk."""
        rows = coordinates(base)
        coarse = Centroids(Kmeans(nlist, rounds, integers=True).fit(rows).centroids)
        if graph:
            table = base.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(coarse.centroids)], "id long, vec array<double>")
            coarse.searcher, coarse.options = GraphIndex.build(table, 1, graph), {"ef": max(64, nlist // 4)}
        return BinaryIndex(CodedIvf.around(coarse, rows, Bits(), residual=False))

    @staticmethod
    def graph(base: DataFrame, m: int) -> BinaryIndex:
        return BinaryIndex(GraphIndex.build(coordinates(base), m=m))

    def search(self, queries: DataFrame, k: int, **options) -> DataFrame:
        return _whole(self.inner.search(coordinates(queries, "query_id"), k, **options))

    def range_search(self, queries: DataFrame, radius: int, nprobe: int = 1) -> DataFrame:
        """Strictly within the radius, in lists."""
        return _whole(self.inner.range_search(coordinates(queries, "query_id"), radius, nprobe))


@dataclass
class HashTables:
    """Rows by keys of so many bits: table t takes the bits from t * bits on."""

    rows: DataFrame
    bits: int
    tables: int = 1

    @staticmethod
    def keyed(codes: DataFrame, bits: int, tables: int, name: str = "id") -> DataFrame:
        """name, words (longs) and keys, one a table."""
        ship(codes.sparkSession)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                raw = _matrix(b.column(1))
                each = np.unpackbits(raw, axis=1, bitorder="little").astype(np.int64)
                keys = np.stack([each[:, t * bits : (t + 1) * bits] @ (1 << np.arange(each[:, t * bits : (t + 1) * bits].shape[1])) for t in range(tables)], axis=1)
                words = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view("<i8")
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(words), pa.list_(pa.int64())), pa.array(list(keys), pa.list_(pa.int64()))], [name, "words", "keys"])

        return codes.where("code IS NOT NULL").select(name, "code").mapInArrow(run, f"{name} long, words array<long>, keys array<long>")

    @staticmethod
    def build(base: DataFrame, bits: int, tables: int = 1) -> HashTables:
        if not 1 <= bits <= 62:
            raise ValueError("keys have 1 to 62 bits")
        return HashTables(HashTables.keyed(base, bits, tables), bits, tables)

    def search(self, queries: DataFrame, k: int, nflip: int = 1) -> DataFrame:
        """Rows that share a key with the query up to so many flips in any table, by their whole distance."""
        masks = F.array(*[F.lit(sum(1 << b for b in c)).cast("long") for n in range(nflip + 1) for c in combinations(range(self.bits), n)])
        stored = self.rows.select("id", "words", F.posexplode("keys").alias("t", "v"))
        asked = self.keyed(queries, self.bits, self.tables, "query_id").select("query_id", F.col("words").alias("asked"), F.posexplode("keys").alias("t", "v"))
        asked = asked.select("query_id", "asked", "t", F.explode(F.transform(masks, lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
        met = stored.join(asked, ["t", "v"]).select("query_id", "id", hamming_words(F.col("words"), F.col("asked")).alias("distance")).distinct()
        return best(met, k)
