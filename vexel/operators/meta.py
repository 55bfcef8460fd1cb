"""Selectors, id maps, shards and split vectors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.operators.flat import knn, merge_results


def id_range(low: int, high: int) -> Column:
    return (F.col("id") >= low) & (F.col("id") < high)


def id_set(ids: list[int]) -> Column:
    return F.col("id").isin(ids)


def xor(a: Column, b: Column) -> Column:
    return a != b


def select_ids(base: DataFrame, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows whose id is (or isn't) in a table of ids."""
    return base.join(ids.select("id").distinct(), "id", "left_semi" if keep else "left_anti")


def translate(found: DataFrame, names: DataFrame) -> DataFrame:
    """Results with the ids that a map (id, user_id) gives."""
    return found.join(names, "id").drop("id").withColumnRenamed("user_id", "id")


def sharded_knn(shards: list[DataFrame], queries: DataFrame, k: int, metric: str = "l2", offsets: list[int] | None = None) -> DataFrame:
    """Each shard searched by itself, the ids shifted if offsets are given, the results merged."""
    parts = [knn(s, queries, k, metric) for s in shards]
    if offsets:
        parts = [p.withColumn("id", F.col("id") + o) for p, o in zip(parts, offsets, strict=True)]
    return merge_results(parts, k, metric in ("ip", "cosine", "jaccard"))


def split_vectors_nearest(slices: list[tuple[DataFrame, int]], queries: DataFrame, widths: list[int]) -> DataFrame:
    """query_id, id and distance: nearest row of each slice's table, distances added and ids combined with the earlier tables' sizes. Slices are (table, its number of rows)."""
    parts, start, scale = [], 1, 1
    for (table, n), w in zip(slices, widths, strict=True):
        q = queries.select("query_id", F.slice("vec", start, w).alias("vec"))
        parts.append(knn(table, q, 1).select("query_id", (F.col("id") * scale).alias("id"), "distance"))
        start, scale = start + w, scale * n
    return reduce(DataFrame.unionByName, parts).groupBy("query_id").agg(F.sum("id").alias("id"), F.sum("distance").alias("distance"))


def random_results(base: DataFrame, queries: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """A baseline: k rows in seeded hash order for each query."""
    from vexel.operators.flat import best

    pairs = base.select("id").crossJoin(queries.select("query_id"))
    return best(pairs.withColumn("distance", F.pmod(F.xxhash64("id", "query_id", F.lit(seed)), F.lit(1 << 31)).cast("double")), k)
