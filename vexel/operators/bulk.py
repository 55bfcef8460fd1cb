"""Bulk search over inverted lists, list by list, that can be taken up again after it broke off.

Lists are taken in ranges. A range's result, the k best of each query within it, is a table of its own in the run's folder, written
whole or not at all; a later call with the same folder searches only what is missing and merges all. So no range is searched twice, codes of a
range are read once for all queries, and what a broken run loses is one range.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vexel.functions.distance import SIMILARITIES
from vexel.operators.flat import best
from vexel.plans.storage import exists


def _kept(make, spark, path: str) -> DataFrame:
    """The table at a path, made and written first if it isn't there whole."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ranges(lists: DataFrame, rows: int) -> list[tuple[int, int]]:
    """Ranges [a, b) of list numbers that hold about so many rows each, from the sizes of lists."""
    sizes = lists.groupBy("list_no").agg(F.count("*").alias("n")).orderBy("list_no").toLocalIterator()
    out, start, held = [], None, 0
    for r in sizes:
        start = r["list_no"] if start is None else start
        held += r["n"]
        if held >= rows:
            out.append((start, r["list_no"] + 1))
            start, held = None, 0
        last = r["list_no"]
    return out + ([(start, last + 1)] if start is not None else [])


def search(index, queries: DataFrame, k: int, nprobe: int, path: str, rows: int = 100_000_000) -> DataFrame:
    """index.search(queries, k, nprobe), by ranges of lists with about so many rows, kept in the folder path.

    index is an IvfIndex or a CodedIvf. A folder holds one run: with another k, nprobe or number of rows it raises ValueError.
    """
    spark, table = queries.sparkSession, index.codes if hasattr(index, "codes") else index.lists
    plan = _kept(lambda: spark.createDataFrame([(json.dumps({"k": k, "nprobe": nprobe, "rows": rows, "ranges": ranges(table, rows)}),)], "told string"), spark, f"{path}/plan")
    told = json.loads(plan.first()["told"])
    if (told["k"], told["nprobe"], told["rows"]) != (k, nprobe, rows):
        raise ValueError(f"{path} holds another run")
    probes = _kept(lambda: index.coarse.probes(queries, nprobe) if index.coarse else index.probes(queries, nprobe), spark, f"{path}/probes")
    parts = [_kept(lambda a=a, b=b: index.search_preassigned(queries, probes.where(F.col("list_no").between(a, b - 1)), k).select("query_id", "id", "distance"), spark, f"{path}/found-{a}-{b}") for a, b in told["ranges"]]
    none = spark.createDataFrame([], "query_id long, id long, distance double")
    return best(reduce(DataFrame.unionByName, parts, none), k, index.metric in SIMILARITIES)
