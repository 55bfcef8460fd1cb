"""Inverted lists that hold codes: of the vectors' residuals to their list's centre, or of the vectors themselves.

Lists are a table (list_no, id, code) as ``codes`` makes it. Indexes are stored as Parquet and one row of JSON, and opened without
being built again.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, is_dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession

from vexel.operators import codes as C
from vexel.operators import quantizers
from vexel.operators.cluster import Kmeans
from vexel.operators.coarse import Additive, Centroids, MultiIndex
from vexel.operators.ivf import IvfIndex, within
from vexel.operators.transforms import sample_matrix
from vexel.plans.storage import materialize


def learned(codec, vectors: DataFrame):
    """A codec fitted on all rows where it can learn in expressions, else on a bounded sample."""
    return codec.learn(vectors) if hasattr(codec, "learn") else codec.fit(sample_matrix(vectors))


@dataclass
class CodedIvf:
    """codes (list_no, id, code, and finer where there is a second codec), the quantizer of lists and what decodes them."""

    coarse: Centroids | MultiIndex | Additive
    codes: DataFrame
    codec: object
    metric: str = "l2"
    residual: bool = True
    finer: object = None

    @staticmethod
    def build(base: DataFrame, nlist: int, codec, metric: str = "l2", residual: bool = True, rounds: int = 10, init: np.ndarray | None = None) -> CodedIvf:
        return CodedIvf.around(Centroids(Kmeans(nlist, rounds, spherical=metric == "ip").fit(base, init).centroids, metric), base, codec, metric, residual)

    @staticmethod
    def around(coarse, base: DataFrame, codec, metric: str = "l2", residual: bool = True, finer=None) -> CodedIvf:
        """Lists of a quantizer of the module ``coarse``; with finer, a second codec for what the first leaves."""
        placed = materialize(coarse.assign(base), "assigned")
        rest = C.residuals(placed, coarse) if residual else placed
        learned(codec, rest)
        if finer:
            x = sample_matrix(rest)
            finer.fit(x - codec.decode(codec.encode(x)))
        index = CodedIvf(coarse, placed, codec, metric, residual, finer)
        index.codes = C.store(index._encoded(placed))
        return index

    @property
    def _centre(self):
        return self.coarse if self.residual else None

    def _encoded(self, placed: DataFrame) -> DataFrame:
        return C.encode(placed, self.codec, self._centre, self.finer)

    def add(self, more: DataFrame) -> CodedIvf:
        return replace(self, codes=self.codes.unionByName(self._encoded(self.coarse.assign(more))))

    def remove(self, ids: DataFrame) -> CodedIvf:
        return replace(self, codes=self.codes.join(ids.select("id"), "id", "left_anti").select(*self.codes.columns))

    def reconstruct(self, where: Column | None = None) -> DataFrame:
        """list_no, id and vec, as the first code tells it, of the rows that a condition on list_no and id keeps."""
        return C.decode(self.codes if where is None else self.codes.where(where), self.codec, self._centre)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, where: Column | None = None, max_codes: int | None = None, ht: int = 0, **more) -> DataFrame:
        return self.search_preassigned(queries, self.coarse.probes(queries, nprobe), k, where, max_codes, ht, **more)

    def search_preassigned(self, queries: DataFrame, probes: DataFrame, k: int, where: Column | None = None, max_codes: int | None = None, ht: int = 0, **more) -> DataFrame:
        probes = within(probes, self.codes, max_codes)
        return C.search(self.codes, self.codec, queries, k, self.metric, probes, self._centre, ht, where, finer=self.finer, **more)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, where: Column | None = None) -> DataFrame:
        return C.search(self.codes, self.codec, queries, 0, self.metric, self.coarse.probes(queries, nprobe), self._centre, 0, where, radius)


@dataclass
class FlatCodes:
    """Codes of all vectors, without lists to probe; coarse gives the centres that they are residuals to, if they are."""

    codes: DataFrame
    codec: object
    metric: str = "l2"
    coarse: object = None

    @staticmethod
    def build(base: DataFrame, codec, metric: str = "l2", coarse=None) -> FlatCodes:
        if coarse is None:
            return FlatCodes(materialize(C.encode(base.select("id", "vec"), learned(codec, base)), "codes"), codec, metric)
        made = CodedIvf.around(coarse, base, codec, metric)
        return FlatCodes(made.codes, made.codec, metric, coarse)

    def search(self, queries: DataFrame, k: int, ht: int = 0, where: Column | None = None) -> DataFrame:
        return C.search(self.codes, self.codec, queries, k, self.metric, None, self.coarse, ht, where)

    def reconstruct(self) -> DataFrame:
        return C.decode(self.codes, self.codec, self.coarse)


KINDS = {c.__name__: c for c in (quantizers.Product, quantizers.Residual, quantizers.LocalSearch, quantizers.ProductAdditive, quantizers.Half, quantizers.Scalar, quantizers.Normed, quantizers.RowScaled, Centroids, MultiIndex, Additive)}


def to_plain(v, arrays: list):
    """A codec or quantizer as JSON holds it; arrays go to a list and leave their place in it."""
    if is_dataclass(v) and type(v).__name__ in KINDS:
        return {"kind": type(v).__name__, "fields": {f.name: to_plain(getattr(v, f.name), arrays) for f in fields(v)}}
    if isinstance(v, type) and v.__name__ in KINDS:
        return {"type": v.__name__}
    if isinstance(v, np.ndarray):
        arrays.append(v)
        return {"array": len(arrays) - 1, "shape": list(v.shape)}
    if isinstance(v, (list, tuple)):
        return [to_plain(x, arrays) for x in v]
    if isinstance(v, dict):
        return {"dict": {k: to_plain(x, arrays) for k, x in v.items()}}
    if v is None or isinstance(v, (str, int, float, bool)):
        return v
    raise NotImplementedError(f"{type(v).__name__} can't be stored")


def from_plain(v, arrays: dict):
    if isinstance(v, list):
        return [from_plain(x, arrays) for x in v]
    if not isinstance(v, dict):
        return v
    if "kind" in v:
        return KINDS[v["kind"]](**{k: from_plain(x, arrays) for k, x in v["fields"].items()})
    if "type" in v:
        return KINDS[v["type"]]
    if "array" in v:
        return np.array(arrays.get(v["array"], []), float).reshape(v["shape"])
    return {k: from_plain(x, arrays) for k, x in v["dict"].items()}


def save(index: IvfIndex | CodedIvf | FlatCodes, path: str) -> None:
    """Store an index in a new folder: its rows, the arrays of codebooks and centroids, and a description, which is written last, so that a folder without it is not an index."""
    rows, arrays = index.lists if isinstance(index, IvfIndex) else index.codes, []
    told = {f.name: to_plain(getattr(index, f.name), arrays) for f in fields(index) if f.name not in ("lists", "codes")}
    spark = rows.sparkSession
    rows.write.parquet(f"{path}/lists")
    flat = [(n, i, [float(x) for x in np.ravel(r)]) for n, a in enumerate(arrays) for i, r in enumerate(a)]
    spark.createDataFrame(flat, "no int, place int, row array<double>").write.parquet(f"{path}/arrays")
    spark.createDataFrame([(json.dumps({"index": type(index).__name__, "fields": told}),)], "told string").coalesce(1).write.parquet(f"{path}/about")


def load(spark: SparkSession, path: str) -> IvfIndex | CodedIvf | FlatCodes:
    told, arrays = json.loads(spark.read.parquet(f"{path}/about").first()["told"]), {}
    for r in spark.read.parquet(f"{path}/arrays").orderBy("no", "place").collect():  # codebooks, which the driver holds anyway
        arrays.setdefault(r["no"], []).extend(r["row"])
    kind = {c.__name__: c for c in (IvfIndex, CodedIvf, FlatCodes)}[told["index"]]
    rows = {"lists" if kind is IvfIndex else "codes": spark.read.parquet(f"{path}/lists")}
    return kind(**rows, **{k: from_plain(v, arrays) for k, v in told["fields"].items()})
