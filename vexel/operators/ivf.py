"""Inverted lists: vectors in a table by list_no, searched by probing the lists of the nearest centroids."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import distance as D
from vexel.operators.cluster import Kmeans, assign
from vexel.operators.flat import best, knn, nearest_in_lists, within_lists
from vexel.plans.storage import materialize


@dataclass
class IvfIndex:
    """centroids (k x d) and lists (list_no, id, vec). With coarse, that quantizer says where a vector belongs and a query looks, in place of the centroids."""

    centroids: np.ndarray | None
    lists: DataFrame
    metric: str = "l2"
    coarse: object = None

    @staticmethod
    def build(base: DataFrame, nlist: int, metric: str = "l2", rounds: int = 10, init: np.ndarray | None = None, sample: bool = True) -> IvfIndex:
        fitted = Kmeans(nlist, rounds, spherical=metric == "ip").fit(base, init, sample)
        return IvfIndex(fitted.centroids, assign(base, fitted.centroids).select("list_no", "id", "vec"), metric)

    @staticmethod
    def around(coarse, base: DataFrame, metric: str = "l2") -> IvfIndex:
        """Lists of a quantizer of the module ``coarse``."""
        return IvfIndex(None, materialize(coarse.assign(base), "lists"), metric, coarse)

    def _with(self, lists: DataFrame) -> IvfIndex:
        return replace(self, lists=lists)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return self.coarse.assign(rows) if self.coarse else assign(rows, self.centroids).select("list_no", "id", "vec")

    def _centres(self, spark) -> DataFrame:
        return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(self.centroids)], "id long, vec array<double>")

    def probes(self, queries: DataFrame, nprobe: int) -> DataFrame:
        """query_id, probe_rank and list_no."""
        if self.coarse:
            return self.coarse.probes(queries, nprobe)
        found = knn(self._centres(queries.sparkSession), queries, min(nprobe, len(self.centroids)), self.metric)
        return found.select("query_id", F.col("rank").alias("probe_rank"), F.col("id").cast("int").alias("list_no"))

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, where: Column | None = None, max_codes: int | None = None) -> DataFrame:
        return self.search_preassigned(queries, self.probes(queries, nprobe), k, where, max_codes)

    def search_preassigned(self, queries: DataFrame, probes: DataFrame, k: int, where: Column | None = None, max_codes: int | None = None) -> DataFrame:
        """Lists named by the caller; -1 is skipped. With max_codes, a list is scanned if fewer codes came before it."""
        probes = within(probes, self.lists, max_codes)
        return nearest_in_lists(self.lists if where is None else self.lists.where(where), queries, probes, k, self.metric)

    def range_search(self, queries: DataFrame, radius: float, nprobe: int = 1, where: Column | None = None) -> DataFrame:
        return within_lists(self.lists if where is None else self.lists.where(where), queries, self.probes(queries, nprobe), radius, self.metric)

    def add(self, more: DataFrame) -> IvfIndex:
        return self._with(self.lists.unionByName(self._placed(more)))

    def remove(self, ids: DataFrame) -> IvfIndex:
        return self._with(self.lists.join(ids.select("id"), "id", "left_anti").select("list_no", "id", "vec"))

    def update(self, changed: DataFrame) -> IvfIndex:
        return self.remove(changed).add(changed)

    def merge(self, other: IvfIndex, add_id: int = 0) -> IvfIndex:
        if other.metric != self.metric or other.coarse is not self.coarse or not self.coarse and not np.array_equal(other.centroids, self.centroids):
            raise ValueError("indexes have other centroids or metrics")
        return self._with(self.lists.unionByName(other.lists.withColumn("id", F.col("id") + add_id)))

    def subset(self, kind: str, a: int, b: int) -> IvfIndex:
        """id_range [a, b), id_mod (id % a == b), list_range [a, b), or element_range [a, b) in the order of lists and ids."""
        if kind == "element_range":
            sizes = self.lists.groupBy("list_no").agg(F.count("*").alias("n"))  # ranks within lists, so that no task gets all rows
            before = sizes.withColumn("before", F.sum("n").over(Window.orderBy("list_no")) - F.col("n")).select("list_no", "before")
            ranked = self.lists.withColumn("r", F.row_number().over(Window.partitionBy("list_no").orderBy("id")) - 1).join(before, "list_no")
            return self._with(ranked.where((F.col("before") + F.col("r")).between(a, b - 1)).select("list_no", "id", "vec"))
        rule = {"id_range": F.col("id").between(a, b - 1), "id_mod": F.col("id") % a == b, "list_range": F.col("list_no").between(a, b - 1)}[kind]
        return self._with(self.lists.where(rule))

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        """list_no, id and vec of the ids that are stored."""
        return self.lists.join(ids.select("id").distinct(), "id", "left_semi").select("list_no", "id", "vec")

    def reset(self) -> IvfIndex:
        """The same centroids and no rows."""
        return self._with(self.lists.limit(0))

    def list_sizes(self) -> DataFrame:
        return self.lists.groupBy("list_no").agg(F.count("*").alias("n"))


class DedupIndex(IvfIndex):
    """Equal vectors of a list are stored and scanned once, and all named in results."""

    @staticmethod
    def around(coarse, base: DataFrame, metric: str = "l2") -> DedupIndex:
        return DedupIndex(None, materialize(dedup_lists(coarse.assign(base)), "lists"), metric, coarse)

    def search(self, queries: DataFrame, k: int, nprobe: int = 1, **more) -> DataFrame:
        return expand(super().search(queries, k, nprobe, **more), self.lists, k, self.metric in D.SIMILARITIES)


def within(probes: DataFrame, lists: DataFrame, max_codes: int | None) -> DataFrame:
    """Probes, in their order, as long as fewer than max_codes rows came before."""
    if not max_codes:
        return probes
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("query_id").orderBy("probe_rank").rowsBetween(Window.unboundedPreceding, -1))
    return probes.join(sizes, "list_no").withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < max_codes).drop("n", "before")


def dedup_lists(lists: DataFrame) -> DataFrame:
    """Equal vectors of a list stored once: list_no, vec, id (the least) and ids."""
    return lists.groupBy("list_no", "vec").agg(F.min("id").alias("id"), F.sort_array(F.collect_list("id")).alias("ids"))


def expand(found: DataFrame, stored: DataFrame, k: int, descending: bool = False) -> DataFrame:
    """Results over deduplicated lists with every duplicate named again, k in all."""
    return best(found.select("query_id", "id", "distance").join(stored.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("id"), "distance"), k, descending)


def find_duplicates(codes: DataFrame) -> DataFrame:
    """Groups of two or more equal codes within a list."""
    return codes.groupBy("list_no", "code").agg(F.sort_array(F.collect_list("id")).alias("ids")).where(F.size("ids") > 1)


def stack(parts: list[DataFrame]) -> DataFrame:
    """List ranges of several tables one after another: parts are (lists, nlist) in order."""
    out, offset = None, 0
    for lists, nlist in parts:
        moved = lists.withColumn("list_no", F.col("list_no") + offset)
        out, offset = moved if out is None else out.unionByName(moved), offset + nlist
    return out


def masked(a: DataFrame, b: DataFrame) -> DataFrame:
    """Lists of a; where a has none, those of b."""
    return a.unionByName(b.join(a.select("list_no").distinct(), "list_no", "left_anti").select(*a.columns))


def without_stop_lists(lists: DataFrame, most: int) -> DataFrame:
    """Without lists of that many rows or more."""
    small = lists.groupBy("list_no").agg(F.count("*").alias("n")).where(F.col("n") < most)
    return lists.join(small.select("list_no"), "list_no", "left_semi")


def slide(slices: DataFrame, width: int) -> DataFrame:
    """The newest slices of a table with column slice_no."""
    newest = slices.agg(F.max("slice_no").alias("newest"))
    return slices.join(F.broadcast(newest)).where(F.col("slice_no") > F.col("newest") - width).drop("newest")  # newest is one row
