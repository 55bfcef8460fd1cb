"""Vector transforms: fitted on the driver from moments or a bounded sample, applied in Arrow batches or expressions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import distance as D
from vexel.functions.kernels import matrix
from vexel.plans.storage import ship

SAMPLE = 65_536


def sample_matrix(vectors: DataFrame, most: int = SAMPLE) -> np.ndarray:
    """At most so many vectors, those of least hash of id."""
    rows = vectors.where("vec IS NOT NULL").select(F.struct(F.xxhash64("id"), "id").alias("key"), "vec")
    last = rows.orderBy("key").limit(most).agg(F.max("key").alias("last"))  # a table of one row; a limit on the vectors themselves brings so many of each task to the driver
    found = rows.join(F.broadcast(last), F.col("key") <= F.col("last")).select("key", "vec").collect()
    return np.array([r["vec"] for r in sorted(found, key=lambda r: r["key"])[:most]], np.float64)


@dataclass
class Linear:
    """y = A x + b."""

    a: np.ndarray
    b: np.ndarray

    def apply(self, vectors: DataFrame) -> DataFrame:
        return map_vectors(vectors, lambda x: x @ self.a.T + self.b)

    def reverse(self, vectors: DataFrame) -> DataFrame:
        """By the transpose, for orthonormal rows."""
        return map_vectors(vectors, lambda y: (y - self.b) @ self.a)


def map_vectors(vectors: DataFrame, f) -> DataFrame:
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = f(matrix(b.column(1))) if b.num_rows else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(made), pa.list_(pa.float64()))], ["id", "vec"])

    return vectors.select("id", "vec").where("vec IS NOT NULL").mapInArrow(run, "id long, vec array<double>")


def random_rotation(d_in: int, d_out: int, seed: int = 12345) -> Linear:
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(d_in, d_out), max(d_in, d_out))))
    return Linear(q[:d_out, :d_in], np.zeros(d_out))


def moments(vectors: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance over all rows: a row of partial sums from each task."""
    ship(vectors.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, None, None
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(0))
                n, s, p = n + len(x), (0 if s is None else s) + x.sum(0), (0 if p is None else p) + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([s.tolist()]), pa.array([p.ravel().tolist()])], ["n", "s", "p"])

    parts = vectors.where("vec IS NOT NULL").select("vec").mapInArrow(run, "n long, s array<double>, p array<double>")
    n, s, p = 0, 0.0, 0.0
    for r in parts.toLocalIterator():
        n, s, p = n + r["n"], s + np.array(r["s"]), p + np.array(r["p"])
    mean = s / n
    d = len(mean)
    return n, mean, p.reshape(d, d) / n - np.outer(mean, mean)


def pca(vectors: DataFrame, d_out: int, eigen_power: float = 0.0, rotate: bool = False, scatter: bool = False, seed: int = 12345) -> Linear:
    """Principal axes; eigen_power -0.5 whitens. With scatter, eigenvalues are those of the sum and not of the mean, as in the reference."""
    n, mean, cov = moments(vectors)
    values, axes = np.linalg.eigh(cov * (n if scatter else 1))
    order = np.argsort(-values)[:d_out]
    a = axes[:, order].T * (np.maximum(values[order], 1e-12) ** eigen_power)[:, None]
    if rotate:
        a = random_rotation(d_out, d_out, seed).a @ a
    return Linear(a, -a @ mean)


def itq(x: np.ndarray, rounds: int = 50, seed: int = 123) -> np.ndarray:
    """A rotation that brings vectors near their signs."""
    r = random_rotation(x.shape[1], x.shape[1], seed).a
    for _ in range(rounds):
        u, _, v = np.linalg.svd(np.where(x @ r.T >= 0, 1.0, -1.0).T @ x)
        r = u @ v
    return r


def opq(x: np.ndarray, m: int, rounds: int = 20, bits: int = 4, seed: int = 1, out: int | None = None) -> Linear:
    """A rotation for product quantization, or with out a projection to so many dimensions, by turns of quantizing and Procrustes."""
    from vexel.operators.quantizers import Product

    out = out or x.shape[1]
    r = random_rotation(x.shape[1], x.shape[1], seed).a[:out]
    for _ in range(rounds):
        y = x @ r.T
        q = Product(m, bits, rounds=4).fit(y)
        u, _, v = np.linalg.svd(q.decode(q.encode(y)).T @ x, full_matrices=False)
        r = u @ v
    return Linear(r, np.zeros(len(r)))


def pad(vectors: DataFrame, d: int) -> DataFrame:
    """Zeros up to d coordinates."""
    return vectors.withColumn("vec", F.when(F.col("vec").isNotNull(), F.concat("vec", F.array_repeat(F.lit(0.0).cast(vectors.schema["vec"].dataType.elementType), F.greatest(F.lit(0), d - F.size("vec"))))))


def center(vectors: DataFrame) -> DataFrame:
    """Vectors minus their mean; the mean is one row."""
    mean = vectors.select(F.posexplode("vec").alias("p", "x")).groupBy("p").agg(F.avg(F.col("x").cast("double")).alias("m")).agg(F.sort_array(F.collect_list(F.struct("p", "m")))["m"].alias("mean"))
    return vectors.join(F.broadcast(mean)).select("id", D.subtract(F.col("vec"), F.col("mean")).alias("vec"))


def normalize(vectors: DataFrame) -> DataFrame:
    return vectors.select("id", D.normalize(F.col("vec")).alias("vec"))


def remap(vec: Column, places: list[int]) -> Column:
    """Coordinates by place; -1 gives zero."""
    return F.array(*[F.lit(0.0) if p < 0 else F.get(vec, F.lit(p)).cast("double") for p in places])
