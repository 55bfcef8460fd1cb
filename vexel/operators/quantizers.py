"""Codecs: numpy classes that fit on a bounded sample, encode a matrix to small integers of ``widths`` bits and decode them; and scalar codes in expressions. Tables of codes are in ``codes``."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.operators.flat import best


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int = 1) -> np.ndarray:
    k = min(k, len(x))
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = _nearest(x, c)
        n = np.bincount(at, minlength=k)
        s = np.stack([np.bincount(at, column, k) for column in x.T], axis=1)
        c[n > 0] = s[n > 0] / n[n > 0, None]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1)[None] - 2 * x @ c.T).argmin(1)


@dataclass
class Product:
    """m slices with 2^bits centroids each."""

    m: int
    bits: int = 8
    rounds: int = 15
    books: list[np.ndarray] = field(default_factory=list)
    polysemous: bool = False

    @property
    def widths(self) -> list[int]:
        return [self.bits] * self.m

    def fit(self, x: np.ndarray) -> Product:
        self.books = [_kmeans(s, 1 << self.bits, self.rounds) for s in np.split(x, self.m, axis=1)]
        return self.order_codes() if self.polysemous else self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.stack([_nearest(s, b) for s, b in zip(np.split(x, self.m, axis=1), self.books, strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([b[codes[:, j]] for j, b in enumerate(self.books)], axis=1)

    def tables(self, q: np.ndarray, metric: str = "l2") -> np.ndarray:
        """For each slice and centroid its part of the distance to a query."""
        return np.stack([b @ s if metric == "ip" else ((b - s) ** 2).sum(1) for s, b in zip(np.split(q, self.m), self.books, strict=True)])

    def distances(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        return self.tables(q, metric)[np.arange(self.m), codes].sum(1)

    def order_codes(self, rounds: int = 2000, seed: int = 7) -> Product:
        """Polysemous order: swap centroids while their Hamming distances come nearer to their own distances."""
        rng = np.random.default_rng(seed)
        for j, b in enumerate(self.books):
            n = len(b)
            d = ((b[:, None] - b[None]) ** 2).sum(2)
            h = np.bitwise_count(np.arange(n)[:, None] ^ np.arange(n)[None]).astype(float)
            d = d / max(d.mean(), 1e-30) * h.mean()
            p = np.arange(n)
            for a, c in rng.integers(n, size=(rounds, 2)).tolist():
                u, v = p[a], p[c]
                if u == v:
                    continue
                # two rows and columns change; their entries with each other stay as they are
                old, new = (d[u, p] - h[a]) ** 2 + (d[v, p] - h[c]) ** 2, (d[v, p] - h[a]) ** 2 + (d[u, p] - h[c]) ** 2
                old[[a, c]] = new[[a, c]] = 0
                if new.sum() < old.sum():
                    p[a], p[c] = v, u
            self.books[j] = b[p]
        return self


@dataclass
class Residual:
    """m codebooks on what is left, encoded with a beam. bits is one number, or one for each book."""

    m: int
    bits: int | tuple[int, ...] = 4
    beam: int = 5
    rounds: int = 15
    books: list[np.ndarray] = field(default_factory=list)

    @property
    def widths(self) -> list[int]:
        return [self.bits] * self.m if isinstance(self.bits, int) else list(self.bits)

    def fit(self, x: np.ndarray) -> Residual:
        self.books, rest = [], x.copy()
        for bits in self.widths:
            self.books.append(_kmeans(rest, 1 << bits, self.rounds))
            rest = rest - self.books[-1][_nearest(rest, self.books[-1])]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The codes that a beam finds, for all rows at once: of equal errors the first."""
        rows, codes, rest = np.arange(len(x))[:, None], np.zeros((len(x), 1, 0), int), x[:, None, :]
        for b in self.books:
            error = (rest**2).sum(2)[:, :, None] - 2 * rest @ b.T + (b**2).sum(1)
            keep = np.argsort(error.reshape(len(x), -1), axis=1, kind="stable")[:, : self.beam]
            at, c = keep // len(b), keep % len(b)
            codes, rest = np.concatenate([codes[rows, at], c[:, :, None]], axis=2), rest[rows, at] - b[c]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(b[codes[:, j]] for j, b in enumerate(self.books))

    def dots(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Inner products of a query with what codes decode to, from a table a book."""
        return sum((b @ q)[codes[:, j]] for j, b in enumerate(self.books))


@dataclass
class LocalSearch(Residual):
    """Additive codes bettered by iterated conditional modes, with codebooks refitted by least squares."""

    sweeps: int = 4
    refits: int = 3

    def fit(self, x: np.ndarray) -> LocalSearch:
        super().fit(x)
        for _ in range(self.refits):
            codes = self.encode(x)
            ends = np.cumsum([len(b) for b in self.books])
            onehot = np.zeros((len(x), ends[-1]))
            onehot[np.arange(len(x))[:, None], codes + np.r_[0, ends[:-1]]] = 1
            self.books = np.split(np.linalg.solve(onehot.T @ onehot + 1e-3 * np.eye(ends[-1]), onehot.T @ x), ends[:-1])
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = super().encode(x)
        for _ in range(self.sweeps):
            for j, b in enumerate(self.books):
                rest = x - self.decode(codes) + b[codes[:, j]]
                codes[:, j] = _nearest(rest, b)
        return codes


@dataclass
class ProductAdditive:
    """Slices, each with an additive codec."""

    slices: int
    codec: type = Residual
    m: int = 2
    bits: int = 4
    parts: list = field(default_factory=list)

    @property
    def widths(self) -> list[int]:
        return [w for p in self.parts for w in p.widths]

    def fit(self, x: np.ndarray) -> ProductAdditive:
        self.parts = [self.codec(self.m, self.bits).fit(s) for s in np.split(x, self.slices, axis=1)]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([p.encode(s) for p, s in zip(self.parts, np.split(x, self.slices, axis=1), strict=True)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([p.decode(c) for p, c in zip(self.parts, np.split(codes, self.slices, axis=1), strict=True)], axis=1)

    def dots(self, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return sum(p.dots(s, c) for p, s, c in zip(self.parts, np.split(q, self.slices), np.split(codes, self.slices, axis=1), strict=True))


@dataclass
class Scalar:
    """A code of so many bits a coordinate, between its least and greatest value."""

    bits: int = 8
    low: np.ndarray | None = None
    span: np.ndarray | None = None

    @property
    def widths(self) -> list[int]:
        return [self.bits] * len(self.low)

    def learn(self, vectors: DataFrame) -> Scalar:
        """From all rows; a row a coordinate comes to the driver."""
        ranges = scalar_ranges(vectors.where("vec IS NOT NULL")).orderBy("pos").collect()
        self.low, self.span = np.array([r["vmin"] for r in ranges]), np.array([r["vdiff"] for r in ranges])
        return self

    def fit(self, x: np.ndarray) -> Scalar:
        self.low, self.span = x.min(0), x.max(0) - x.min(0)
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        share = np.divide(x - self.low, self.span, out=np.zeros_like(x), where=self.span != 0)
        return np.floor(np.clip(share, 0, 1) * ((1 << self.bits) - 1)).astype(int)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.low + (codes + 0.5) / ((1 << self.bits) - 1) * self.span


@dataclass
class Normed:
    """An additive codec whose codes also hold the squared norm of what they decode to, so that distances come from tables of inner products.

    kind: none (norms count as zero, for inner products and normalised vectors), float (32 bits), qint8 and qint4 (steps between the sample's extremes), cqint8 and cqint4 (1-d centroids), lsq2x4 and rq2x4 (an additive code of the norm)."""

    codec: Residual | ProductAdditive
    kind: str = "float"
    low: float = 0.0
    step: float = 1.0
    book: np.ndarray | None = None
    inner: Residual | None = None

    @property
    def widths(self) -> list[int]:
        return self.codec.widths + {"none": [], "float": [32], "qint8": [8], "qint4": [4], "cqint8": [8], "cqint4": [4], "lsq2x4": [4, 4], "rq2x4": [4, 4]}[self.kind]

    def fit(self, x: np.ndarray) -> Normed:
        self.codec.fit(x)
        norms = self._norms(self.codec.encode(x))
        if self.kind.startswith("q"):
            self.low, self.step = float(norms.min()), float(norms.max() - norms.min()) / ((1 << self.widths[-1]) - 1) or 1.0
        elif self.kind.startswith("cq"):
            self.book = np.sort(_kmeans(norms[:, None], 1 << self.widths[-1], 15)[:, 0])
        elif self.kind not in ("float", "none"):
            self.inner = (LocalSearch if self.kind == "lsq2x4" else Residual)(2, 4).fit(norms[:, None])
        return self

    def _norms(self, codes: np.ndarray) -> np.ndarray:
        return (self.codec.decode(codes) ** 2).sum(1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        codes = self.codec.encode(x)
        norms = self._norms(codes)
        if self.kind == "none":
            return codes
        if self.kind == "float":
            own = norms.astype(np.float32).view(np.uint32).astype(np.int64)[:, None]
        elif self.kind.startswith("q"):
            own = np.clip(np.round((norms - self.low) / self.step), 0, (1 << self.widths[-1]) - 1).astype(int)[:, None]
        else:
            own = np.abs(norms[:, None] - self.book).argmin(1)[:, None] if self.inner is None else self.inner.encode(norms[:, None])
        return np.concatenate([codes, own], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.codec.decode(codes[:, : len(self.codec.widths)])

    def distances(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        m = len(self.codec.widths)
        dots, own = self.codec.dots(q, codes[:, :m]), codes[:, m:]
        if metric == "ip":
            return dots
        if self.kind == "none":
            norms = 0.0
        elif self.kind == "float":
            norms = own[:, 0].astype(np.uint32).view(np.float32).astype(float)
        elif self.kind.startswith("q"):
            norms = self.low + own[:, 0] * self.step
        else:
            norms = self.book[own[:, 0]] if self.inner is None else self.inner.decode(own)[:, 0]
        return (q**2).sum() + norms - 2 * dots


@dataclass
class Half:
    """Coordinates as half-precision floats, a code the 16 bits of one; values out of range become the largest finite one."""

    d: int = 0

    @property
    def widths(self) -> list[int]:
        return [16] * self.d

    def fit(self, x: np.ndarray) -> Half:
        self.d = x.shape[1]
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        most = float(np.finfo(np.float16).max)
        return np.clip(x, -most, most).astype(np.float16).view(np.uint16).astype(np.int32)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return codes.astype(np.uint16).view(np.float16).astype(np.float64)


@dataclass
class RowScaled:
    """Each row scaled to [0, 1] by its own extremes, which go before the inner codec's code as floats of 32 or 16 bits."""

    codec: object
    half: bool = False

    @property
    def widths(self) -> list[int]:
        return [16 if self.half else 32] * 2 + self.codec.widths

    def _split(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = np.float16 if self.half else np.float32
        ends = np.stack([x.min(1), x.max(1) - x.min(1)], axis=1).astype(kind)
        span = ends[:, 1:].astype(float)
        return ends, np.divide(x - ends[:, :1].astype(float), span, out=np.zeros_like(x), where=span > 0)

    def fit(self, x: np.ndarray) -> RowScaled:
        self.codec.fit(self._split(x)[1])
        return self

    def encode(self, x: np.ndarray) -> np.ndarray:
        ends, scaled = self._split(x)
        return np.concatenate([ends.view(np.uint16 if self.half else np.uint32).astype(np.int64), self.codec.encode(scaled)], axis=1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        ends = codes[:, :2].astype(np.uint16 if self.half else np.uint32).view(np.float16 if self.half else np.float32).astype(float)
        return ends[:, :1] + self.codec.decode(codes[:, 2:]) * ends[:, 1:]


def refine(found: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances of found rows, and the k best by them."""
    from vexel.operators.flat import distance_subset

    return best(distance_subset(base, queries, found, metric), k, metric in ("ip", "cosine", "jaccard"))


def scalar_ranges(vectors: DataFrame, mode: str = "minmax", arg: float = 0.0) -> DataFrame:
    """pos, vmin and vdiff of each coordinate: minmax widened by arg of the range, or the mean and arg deviations, or order statistics."""
    long = vectors.select(F.posexplode("vec").alias("pos", "x")).select("pos", F.col("x").cast("double").alias("x"))
    if mode == "minmax":
        one = long.groupBy("pos").agg(F.min("x").alias("a"), F.max("x").alias("b"))
        return one.select("pos", (F.col("a") - arg * (F.col("b") - F.col("a"))).alias("vmin"), ((F.col("b") - F.col("a")) * (1 + 2 * arg)).alias("vdiff"))
    if mode == "meanstd":
        one = long.groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
        return one.select("pos", (F.col("m") - arg * F.col("s")).alias("vmin"), (2 * arg * F.col("s")).alias("vdiff"))
    one = long.groupBy("pos").agg(F.percentile("x", arg).alias("a"), F.percentile("x", 1 - arg).alias("b"))
    return one.select("pos", F.col("a").alias("vmin"), (F.col("b") - F.col("a")).alias("vdiff"))


def scalar_codes(vectors: DataFrame, ranges: DataFrame, bits: int = 8) -> DataFrame:
    """id and code; coordinates are clipped to the range, and a range of zero gives zero. The ranges are one row per coordinate."""
    wide = ranges.agg(F.sort_array(F.collect_list(F.struct("pos", "vmin", "vdiff"))).alias("r"))
    top = (1 << bits) - 1
    x = lambda v, i: F.when(F.get("r", i)["vdiff"] != 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v.cast("double") - F.get("r", i)["vmin"]) / F.get("r", i)["vdiff"]))).otherwise(0.0)
    return vectors.join(F.broadcast(wide)).select("id", F.transform("vec", lambda v, i: F.floor(x(v, i) * top).cast("int")).alias("code"))


def scalar_decode(codes: DataFrame, ranges: DataFrame, bits: int = 8) -> DataFrame:
    wide = ranges.agg(F.sort_array(F.collect_list(F.struct("pos", "vmin", "vdiff"))).alias("r"))
    return codes.join(F.broadcast(wide)).select("id", F.transform("code", lambda c, i: F.get("r", i)["vmin"] + (c + 0.5) / ((1 << bits) - 1) * F.get("r", i)["vdiff"]).alias("vec"))


def row_minmax(vec: Column) -> Column:
    """A row scaled to [0, 1], with its scale and least value."""
    low, span = F.array_min(vec).cast("double"), (F.array_max(vec) - F.array_min(vec)).cast("double")
    return F.struct(span.alias("scale"), low.alias("least"), F.transform(vec, lambda x: F.when(span > 0, (x.cast("double") - low) / span).otherwise(0.0)).alias("vec"))


def row_minmax_back(packed: Column) -> Column:
    return F.transform(packed["vec"], lambda x: x * packed["scale"] + packed["least"])


def sphere_lattice(x: np.ndarray, r2: int) -> np.ndarray:
    """The integer vectors of squared norm r2 with the greatest inner product, by enumerating sorted compositions of r2."""
    d = x.shape[1]

    def atoms(rest: int, most: int, left: int) -> Iterator[list[int]]:
        if left == 0:
            if rest == 0:
                yield []
            return
        for v in range(min(most, int(rest**0.5)), -1, -1):
            for tail in atoms(rest - v * v, v, left - 1):
                yield [v, *tail]

    table = np.array(list(atoms(r2, int(r2**0.5), d)), float)
    out = np.zeros_like(x)
    for i, v in enumerate(x):
        order = np.argsort(-np.abs(v), kind="stable")
        out[i, order] = table[(table @ np.abs(v)[order]).argmax()]
        out[i] *= np.where(v < 0, -1, 1)
    return out
